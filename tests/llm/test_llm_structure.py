"""Periodic runs, repaired conversations and the main text of pages, against brute force."""

from __future__ import annotations

import hashlib
import heapq
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skyframe.llm import queries, repair
from skyframe.llm.html import extract_main_text, main_text
from skyframe.llm.repair import repair_conversations, repaired_pieces, written_digest
from skyframe.llm.runs import collapse_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs ----


def expected_runs(words):
    """Every run, by looking at every lag."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length < max(6, 4 * q):
                continue
            stretch = words[start : start + length]
            if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found)


def expected_collapse(words, runs):
    gone = set()
    for start, length, q in runs:
        gone.update(range(start + q, start + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " * 40, "A a A a A a A a a", "é é é é é é", "a\x85a a\xa0a " * 5]
    for _ in range(250):
        alphabet = rnd.choice(["ab", "abc", "abcdefgh"])
        words = []
        for _ in range(rnd.randint(1, 6)):
            block = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 7))]
            words += block * rnd.randint(1, 9) + block[: rnd.randint(0, len(block))]
        texts.append(rnd.choice([" ", "\n", "  \t"]).join(words))
    texts += [" ".join(rnd.choice("ab") for _ in range(200)) for _ in range(60)]
    block = [f"w{rnd.randint(0, 99)}" for _ in range(1500)]
    texts += [" ".join(block * 4 + block[:7]), " ".join(block * 4)[:-2], "hot line\n" * 3000]
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    return texts + [" ".join(fib[-1])] + ["a a a a a a a"] * 5


def test_runs_are_those_of_every_lag(spark):
    rows = [(i, t, "r", 9) for i, t in enumerate(periodic_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, runs int").repartition(3)
    got = {r.row.doc_id: r for r in collapse_runs(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = expected_runs(words) if len(words) < 7000 else None
        assert got[i].n_words == len(words) and got[i].row.text == text
        if runs is not None:
            assert [tuple(r) for r in got[i].runs] == runs, text
            assert got[i].collapsed == expected_collapse(words, runs)
    assert collapse_runs(df.limit(0)).count() == 0


def test_op11_is_the_contract(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    some = 0
    for doc_id, text in documents:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = expected_runs(words) if n < 4000 else [tuple(r) for r in ()]
        r = got[doc_id]
        if n >= 4000:
            continue
        some += bool(runs)
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        want = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want and r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(expected_collapse(words, runs))
    assert some > 5


# ---- conversations ----


def expected_repair(rows):
    """By Dijkstra over (rows read, last role), ties to the least letters; rows are (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        due = "a" if state == "u" else "u"
        heapq.heappush(queue, (cost + 5, audit + "I", i, due))
        if i == len(rows):
            continue
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
        if faults[i] in ("blank", "duplicate"):
            continue
        more, initial = (5 if faults[i] else 0), rows[i][0][:1]
        heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, due))
        if initial == due or (initial == "s" and state == ""):
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, initial))
    lines, i, state = [], 0, ""
    for letter in audit:
        due = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[due]
        if letter == "I":
            lines.append(f"{name}:")
            state = due
            continue
        role, text = rows[i]
        i += 1
        if letter != "D":
            lines.append(f"{name if letter == 'R' else role}:{text}")
            state = due if letter == "R" else role[:1]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
    return (*counts, illegal, cost, audit, sha("\n".join(lines)))


def expected_gaps(turns):
    turns = [t for t in turns if t is not None]
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def by_conversation(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        found.setdefault(conv, []).append(((turn is not None, turn or 0), role, text, turn))
    return {conv: sorted(own, key=lambda r: (r[0], r[1].encode(), r[2].encode())) for conv, own in found.items()}


def odd_conversations():
    rnd = random.Random(8)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle", "User"], ["Hi.", "no", "ok!", "", None, " \t", "é?", "x. \n", "a:b\nc."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.randint(0, 9)):
            rows.append((conv, rnd.choice([turn, turn, turn + 2, None, 3]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"said {turn}."))
    rows += [(500, t, rnd.choice(["user", "user", "assistant", "system"]), f"turn {t}" + rnd.choice([".", ".", ""])) for t in range(400)]
    rows += [(501, 1, "user", "same.")] * 70 + [(502, None, None, None)] * 40 + [(503, 2**62, "user", "w " * 50_000 + "."), (503, -(2**62), "user", "Hi.")]
    rows += [(None, t, "user", "third.") for t in range(300)]
    rnd.shuffle(rows)
    return rows


def test_repairs_are_the_cheapest(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 5)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, place string")
    plan, repaired = repair_conversations(df.repartition(5))
    got = {r.conv: r for r in plan.collect()}
    digests = {r.conv: r.repaired_sha256 for r in written_digest(repaired).collect()}
    want = by_conversation(rows)
    assert got.keys() == want.keys() == digests.keys()
    for conv, own in want.items():
        r = got[conv]
        mine = (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[conv])
        assert mine == expected_repair([(role, text) for _, role, text, _ in own]), conv
        assert r.gaps == expected_gaps([turn for *_, turn in own])
    assert sum(len(part.letters) for part in got[500].parts) == len(got[500].audit) and len(got[500].parts) > 5


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan, repaired = repair_conversations(empty)
    assert plan.count() == repaired.count() == written_digest(repaired).count() == 0


def test_op12_is_the_contract(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept = []
    for conv, turn, role, text in rows:
        damage = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        kept += [(conv, turn, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    want = by_conversation(kept)
    found = queries.op12_conversation_repair(spark, sf_dir).collect()
    assert sorted(r.conv_id for r in found) == sorted({r[0] for r in rows})
    for r in found:
        own = want.get(r.conv_id, [])
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == expected_repair([(a, b) for _, a, b, _ in own])
        assert r.gaps == expected_gaps([turn for *_, turn in own])


# ---- pages ----


def test_op13_is_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = queries.op13_html_extraction(spark, sf_dir).collect()
    assert {r.page_id for r in found} == pages.keys()
    for r in found:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        blocks = [" ".join(html.unescape(block).split()) for block in blocks]
        assert r.text == "\n".join(block for block in blocks if block) and r.n_chars == len(r.text)


LONG = "Some words of the story, with more to say than any menu has, and then a little more of it."
PAGES = [
    # No article: the container of the text, without what its names say is something else.
    (
        f'<body><div class="top-nav"><a href="/">Home</a> <a href="/b">B</a></div><div id="content"><h1>T</h1><p>{LONG}</p><p>Short.</p>'
        f'<div class="ad-slot">Buy</div><ul><li>One</li><li>Two &amp; a half</li></ul><p>{LONG}</p></div><div id="sidebar">x {LONG}</div>'
        '<div class="comments"><p>' + "I think so too. " * 90 + "</p></div><div>&copy; us</div></body>",
        f"T\n{LONG}\nShort.\nOne\nTwo & a half\n{LONG}",
    ),
    # A list of links and a form inside the article; the title in its header.
    (
        f"<main><article><header><h1>T</h1><span>by me</span></header><p>{LONG}</p><ul><li><a>a</a></li><li><a>b</a></li></ul>"
        f"<form><input><label>mail</label></form><p>End.</p><footer>f</footer><section id='reader-comments'><p>{LONG}</p></section></article></main>",
        f"T\n{LONG}\nEnd.",
    ),
    (f"<form id=aspnet><nav>n</nav><main><p>{LONG}</p></main></form>", LONG),
    (f"<body class='has-sidebar'><div class='cookie-notice'>{LONG}</div><div>{LONG}<br>\n more</div></body>", f"{LONG} more"),
    (f"<article><p>{LONG}<p>cut &am", f"{LONG}\ncut &am"),
    (f"<article><p>{LONG}</p><p>cut</p><a href='x", f"{LONG}\ncut"),
    (f"<article><p>{LONG}</p><!-- not this <p>{LONG}", LONG),
    (f"<![if IE]><article><p>{LONG}</p></article><![endif]>", LONG),
    ("<p>a &lt;b&gt; &#233; &areference; <pre>c\n  d</pre>", "a <b> é &areference;\nc d"),
    ("only text\n\nand more", "only text and more"),
    ("<nav><a>menu</a></nav><script>var x = '</p>'</script><style>p{}</style><footer>f</footer>", ""),
    ("<title>t", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_odd_pages_end(spark):
    odd = ["<" * 100_000, "<a " * 100_000, "<div>" * 20_000, "<p>" * 20_000 + "x", "</div>" * 20_000, "<a href='" * 20_000, "&" * 100_000, "<li>x" * 20_000, "<!" * 50_000]
    rows = [(i, t, "r", 1) for i, t in enumerate([*odd, None, "", "<p>x", "<p>x"])]
    df = spark.createDataFrame(rows, "page_id long, html string, row string, main_text int")
    found = {r.row.page_id: r for r in extract_main_text(df).collect()}
    assert len(found) == len(rows) and found[3].main_text == "x" and found[12].main_chars == 1
    assert found[7].main_chars == 2 * 20_000 - 1
    assert extract_main_text(df.limit(0)).count() == 0
