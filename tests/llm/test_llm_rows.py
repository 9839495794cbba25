"""Operators on vectors, conversations and URLs, and the pipeline, against plain Python."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import chat, queries, topk, urls
from skyframe.llm.chat import branches, conversation_nodes, format_branches, masked_texts, parsed
from skyframe.llm.topk import top_k
from skyframe.llm.urls import ALLOW, BLOCK, Rule, judge

# ---- top-k ----


def best(rows, k, every=100, scale=1024):
    usable = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(usable):
        if i % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(usable) if other != at and len(w) == len(v)]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BINS", 16)
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.normal(0, 1, 4)]) for i in range(400)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(400, 600)]
    rows += [(700, [2.0, 2.0, 2.0, 2.0])] * 3 + [(800, [2.0, 2.0, 2.0, 2.0])]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [math.nan, 1.0, 1.0, 1.0]), (903, [math.inf] * 4), (None, [9.0] * 4)]
    rows += [(1000, [1.0]), (1001, [2.0]), (1002, []), (1100, []), (1200, [-1.0, -2.0, -3.0, -4.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, row int").repartition(4)
    for k in (1, 10, 1000):
        got = sorted(tuple(r) for r in top_k(df, lambda c: c % 100 == 0, k).collect())
        want = best(rows, k)
        assert got == want
    assert top_k(df.limit(0), lambda c: c % 100 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [3e12 + i, -1e10 * i]) for i in range(0, 301, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, lambda c: c % 100 == 0, 2, scale=1).collect()
    limit = (1 << 63) - 1
    for r in got:
        a, b = (next([math.floor(x) for x in v] for i, v in rows if i == which) for which in (r.query_id, r.vec_id))
        assert r.score == max(-limit, min(limit, sum(x * y for x, y in zip(a, b))))


# ---- conversations ----

HARD = ["</turn>", "<turn>", "<\\turn>", "<\\\\/turn", "a\\b", "", None, "x</turn>\n<turn>user\nhi", "<", "\\", "<\\", "é 日本 <//turn>", "turn>", "\\n\n"]


def test_any_text_is_read_back(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "sys\ntem", "</turn>\\b", None) for t in HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_branches(conversation_nodes(df))
    read = out.select(parsed(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(t) for t in read.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert read.loss == [t or "" for _, _, r, t in rows if r == "assistant"]


def test_trees_of_every_shape(spark):
    random = np.random.default_rng(4)
    nodes = []
    for tree in range(12):
        for node in range(60):
            parent = int(random.integers(max(0, node - 9), node)) if node else None
            nodes.append((tree, node, parent, float(random.integers(0, 5))))
    nodes += [(50, k, k - 1 if k else None, 1.0) for k in range(300)]
    nodes += [(60, 0, 1, 0.0), (60, 1, 0, 0.0), (60, 2, 1, 0.0), (60, 3, None, 2.0), (60, 4, 99, None)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double").repartition(3)
    got = {}
    for r in branches(df).collect():
        got.setdefault((r.tree, r["rank"], r.leaf, round(r.branch_score, 9)), []).append((r.at, r.node))
    want = {}
    by_tree = {}
    for tree, node, parent, score in nodes:
        by_tree.setdefault(tree, {})[node] = (parent, score or 0.0)
    for tree, own in by_tree.items():
        parents = {p for p, _ in own.values()}
        paths = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            paths.append((-sum(own[n][1] for n in path) / len(path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(paths), 1):
            want[tree, rank, leaf, round(-score, 9)] = list(enumerate(path))
    assert {k: sorted(v) for k, v in got.items()} == want
    first = branches(df, keep=1).select("tree", "leaf").distinct().collect()
    assert {tuple(r) for r in first} == {(t, leaf) for t, rank, leaf, _ in want if rank == 1}


def test_no_conversation(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert format_branches(conversation_nodes(df.limit(0))).count() == 0
    loose = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (3, None, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.formatted for r in format_branches(conversation_nodes(loose)).collect()}
    assert got == {"<turn>user\na</turn>\n" * 2, "<turn>assistant\nb</turn>\n"}


# ---- URLs ----

RULES = queries.URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[:end]


def longest_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.pattern), r.pattern), default=None)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/7#x", "http://a.example.com/en/70?x=/en/", "http://notexample.com/en/7", "x://com/en/",
    "http://xcom/en/", "http://net/de/8", "http://b.example.net/de/8/9", "http://É.ORG/es/", "http://a.org?x=/es/", "http://a.org/es", "http://u:p@h:8/p?://q", "http://a\n.com/en/",
]


def test_urls(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    got = {r.page_id: r for r in queries.op10_url_filter(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page_id, url in pages:
        host, path = split_url(url)
        rule, r = longest_rule(host, path), got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in (BLOCK, ALLOW)


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(ODD_URLS)], "page_id long, url string, row string, host string")
    got = {r.page_id: r for r in judge(df, RULES).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    for i, url in enumerate(ODD_URLS):
        host, path = split_url(url)
        rule = longest_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.pattern if rule else None), url
    assert judge(df.limit(0), RULES).count() == 0
    none = judge(df, [Rule("nowhere.test/", BLOCK)]).select("verdict").distinct().collect()
    assert [r.verdict for r in none] == [ALLOW]


def test_trees_learn_what_urls_show(spark):
    rows = [(k, f"http://shop{k % 40}.test/{'buy' if k % 2 else 'read'}/{'9' * 12 if k % 2 else 'a-page'}-{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    # Rules know half of the hosts.
    rules = [Rule(f"shop{k}.test/{part}/", verdict) for k in range(20) for part, verdict in (("buy", BLOCK), ("read", ALLOW))]
    got = judge(df, rules).select("row.page_id", "rule", "verdict").where("rule IS NULL").collect()
    right = sum((r.verdict == BLOCK) == bool(r.page_id % 2) for r in got)
    assert len(got) == 300 and right >= 285


# ---- the pipeline ----


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, and some of each kind that a stage has to act on."""
    random = np.random.default_rng(9)
    syllables = {"en": ["the", "ing", "er", "th", "an", "ed", "ou"], "fr": ["le", "qu", "eau", "é", "tion", "ai", "eux"]}

    def prose(lang, n=120):
        return " ".join("".join(random.choice(syllables[lang], 3)) for _ in range(n))

    rows = [(i, prose("en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(120)]
    item = prose("en", 30) + ". " + prose("en", 12) + "."
    rows += [(200, "12345 ... 678", None), (201, None, None)]
    rows += [(300 + k, rows[5][1], "en") for k in range(20)]
    rows += [(400, rows[7][1] + " added", "en")]
    rows += [(500, prose("en") + " " + item + " " + prose("en"), "en")]
    rows = [(i, (t + "\nRead more on our site" if t and i < 100 else t), l, "src", len(t or "")) for i, t, l in rows]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_act_on_what_was_planted(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    everyone = ids(docs)

    told = stages["language_id"](spark, docs, planted)
    assert told.columns == columns and ids(told) == everyone - {200, 201}
    lines = stages["line_dedup"](spark, told, planted)
    assert lines.columns == columns and ids(lines) == ids(told)
    for r in lines.collect():
        assert "Read more" not in r.text and (r.doc_id >= 100 or r.n_chars == len(r.text))
    lines = lines.withColumn("text", F.col("text"))
    once = stages["near_dedup"](spark, lines, planted)
    assert once.columns == columns
    # The copies of one text differ from it by the line that was dropped, or not at all.
    assert len([i for i in ids(once) if i == 5 or 300 <= i < 400]) == 1
    assert ids(once) >= set(range(120)) - {5, 7}
    clean = stages["decontamination"](spark, once, planted)
    assert clean.columns == columns and ids(once) - ids(clean) == {500}
    packed = stages["packing"](spark, clean, planted)
    assert ids(packed) == ids(clean)


def test_run_is_its_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, planted)
    got = corpus_pipeline.run(spark, planted)
    # Places among pieces of one length may be dealt otherwise.
    shape = lambda df: sorted((r.doc_id, r.piece, r.n_tokens) for r in df.collect())
    assert shape(got) == shape(docs)
    assert got.columns == docs.columns


def test_copies_without_an_id(spark, planted):
    """Of a group one stays, also where no row has an id, and where one id is there twice."""
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id IN (5, 6, 8)")
    none = docs.where("doc_id IN (5, 8)").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.where("doc_id <> 8").unionByName(docs.where("doc_id = 6")).unionByName(none).unionByName(none)
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, rows, planted).collect()]
    # 5 and 6, and one of the two copies of 8, which has no id.
    assert sorted(got, key=str) == [5, 6, None]


def test_near_copies_are_told_by_shingles(spark, planted):
    """Similarity 0.8 of five-word shingles decides, whatever the fingerprints are."""
    random = np.random.default_rng(17)

    def similarity(a, b):
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    rows, near = [], set()
    for k in range(40):
        text = [f"w{w}" for w in random.integers(0, 5000, 120)]
        copy = list(text)
        for at in range(20, 20 + 20 * (2 if k % 2 else 4), 20):
            copy[at] = f"new{k}"
        rows += [(k, " ".join(text), "en", "src", 0), (100 + k, " ".join(copy), "en", "src", 0)]
        near |= {100 + k} if similarity(text, copy) >= 0.8 else set()
    # A chain, of which only neighbours are near copies.
    chain = [[f"c{w}" for w in range(120)]]
    for k in range(12):
        chain.append([f"d{k}" if at == 9 * k + 6 else w for at, w in enumerate(chain[-1])])
    rows += [(200 + k, " ".join(words), "en", "src", 0) for k, words in enumerate(chain)]
    assert len(near) == 20 and similarity(chain[0], chain[-1]) < 0.8 < similarity(chain[3], chain[4])
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{planted}/documents.parquet").schema)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, planted).collect()}
    assert got == {r[0] for r in rows} - near - set(range(201, 213))


def test_a_leak_takes_no_other_text_along(spark, planted):
    """Documents without an id, and unlike texts under one id, are told apart by their texts."""
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id IN (5, 6, 500)")
    for same in (None, 9):
        rows = docs.withColumn("doc_id", F.lit(same).cast("long"))
        once = corpus_pipeline.near_dedup(spark, rows, planted)
        assert once.count() == 3
        clean = {r.text for r in corpus_pipeline.decontamination(spark, rows, planted).collect()}
        assert clean == {r.text for r in docs.where("doc_id <> 500").collect()}


def test_pipeline_of_nothing(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, planted).count() == 0, name


def test_digests_of_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    own = {}
    for conv, turn, role, text in sorted(rows):
        own.setdefault(conv, []).append((role, text or ""))
    got = {r.conv_id: r for r in queries.op3_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(own)
    for conv, turns in own.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == chat.ASSISTANT)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_suffix_statistics_cover_all_labelled_urls(spark):
    """The trees are fitted on a sample; what is known of a suffix is not."""
    rows = [(k, f"http://www.host{k % 400}.test/{'en' if k % 3 else 'xx'}/{k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = df.select("url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), F.when(F.col("page_id") % 3 == 0, BLOCK).otherwise(ALLOW).alias("verdict"))
    model = urls.fit(labelled, rows=100)
    assert model.trees is not None
    got = {r.suffix: (r.suffix_blocked, r.suffix_seen) for r in model.suffixes.collect()}
    for k in range(400):
        own = [i % 3 == 0 for i in range(k, 2000, 400)]
        blocked, seen = got[f"host{k}.test"]
        assert blocked == pytest.approx((sum(own) + 1) / (len(own) + 2)) and seen == pytest.approx(math.log1p(len(own)))


def test_a_very_long_url(spark):
    rows = [(k, f"http://a.com/en/{k}") for k in range(30)] + [(99, "http://b.org/" + "x/" * 200_000 + "?q=" + "1" * 100_000), (100, "http://b.net/de/1")]
    got = {r.row.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), [Rule("com/en/", BLOCK), Rule("net/de/", ALLOW)]).collect()}
    assert got[99].host == "b.org" and len(got[99].path) == 400_001 and got[99].verdict in (BLOCK, ALLOW)


def shingled(text, width=5):
    found = text.split()
    return {tuple(found[k : k + width]) for k in range(max(1, len(found) - width + 1))}


def test_groups_around_the_limit_are_those_of_all_pairs(spark):
    """Copies of a few texts with words dropped, replaced and put in, most of them not similar to
    each other, some only through a third; and texts cut short step by step."""
    from skyframe.llm.similar import first_of_similar
    from skyframe.llm.tables import text_key

    random = np.random.default_rng(12)
    texts = []
    for base in range(4):
        words = [f"w{base}x{k}" for k in random.integers(0, 400, 130)]
        for _ in range(110):
            own, rate = [], random.choice([0.01, 0.02, 0.03, 0.05])
            for word in words:
                kind = random.random()
                if kind < rate * 0.4:
                    continue
                own.append(f"z{random.integers(0, 30)}" if kind < rate * 0.8 else word)
                if kind > 1 - rate * 0.2:
                    own.append(f"y{random.integers(0, 9)}")
            texts.append(" ".join(own))
        if base % 2:
            texts.append(" ".join(words))
        texts += [" ".join(words[: 130 - 7 * k]) for k in range(1, 14)]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", text_key(F.col("text")))
    got = sorted(r.id for r in first_of_similar(df.repartition(4)).collect())
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            share = both / (len(sets[i]) + len(sets[j]) - both)
            near += 0.6 < share < 0.8
            if share >= 0.8 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert near > 3000 and got == sorted({find(i) for i in range(len(texts))})


def test_no_side_that_can_grow_in_memory_is_broadcast(spark, monkeypatch):
    """Exploded bands and buckets, and sets of shingles, which are stored in a few pages if alike."""
    from skyframe.llm import similar, tables
    from skyframe.llm.tables import text_key

    monkeypatch.setattr(tables, "SURE_BYTES", 0, raising=False)
    plans = {}

    def seen(df, name):
        plans.setdefault(name, "")
        plans[name] += df._jdf.queryExecution().sparkPlan().toString()
        return own(df, name)

    own = similar.stored
    monkeypatch.setattr(similar, "stored", seen)
    rows = [(k, " ".join(f"w{i}" if i % 40 or i >= 25 * (k % 40) else f"copy{k % 7}" for i in range(600))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("key", text_key(F.col("text")))
    assert [r.id for r in similar.first_of_similar(df.repartition(4)).collect()] == [0]
    for name in ("shared-bands", "star-pairs", "similar-ends", "judged", "similar", "meeting", "marks", "differing"):
        assert "Join" in plans[name] or name == "marks"
        assert "BroadcastHashJoin" not in plans[name], name


def test_close_fingerprints_join_similar_texts_without_a_band(spark, monkeypatch):
    """And only similar ones: the last two have one fingerprint and few shingles in common."""
    from skyframe.llm import similar
    from skyframe.llm.simhash import with_fingerprint
    from skyframe.llm.tables import text_key

    def apart(texts, width):
        return np.array([[hash((text, band)) for band in range(similar.BANDS)] for text in texts], np.int64).reshape(-1, similar.BANDS)

    monkeypatch.setattr(similar, "_bands", apart)
    random, texts = np.random.default_rng(3), []
    for base in range(12):
        words = [f"w{w}" for w in random.integers(0, 5000, 400)]
        for at in range(0, 3 * base, 3):
            words[at * 10] = "new"
            texts.append(" ".join(words))
        texts.append(" ".join(words).upper())
    texts += ["q " * 100, "q " * 100 + "and four more words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", text_key(F.col("text")))
    prints = {r.row.id: r.fp for r in with_fingerprint(df.select("id", "text"), width=5).collect()}
    sets, root = [shingled(t.lower()) for t in texts], list(range(len(texts)))
    assert prints[len(texts) - 1] == prints[len(texts) - 2]
    for i in range(len(texts)):
        for j in range(i):
            close = ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= similar.BITS_APART
            if close and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(i for i, own in enumerate(root) if own == r) for r in root}
    assert 12 < len(least) < len(texts) - 10
    assert sorted(r.id for r in similar.first_of_similar(df.repartition(4)).collect()) == sorted(least.values())


def test_stages_take_columns_of_any_name(spark, planted):
    df = spark.createDataFrame([(1, "One two three.", "a", "k"), (1, "One two three.", "a", "k"), (2, None, "b", "k")], "doc_id long, text string, __id string, __key string")
    kept = corpus_pipeline.near_dedup(spark, df, planted)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "One two three.", "a", "k"), (2, None, "b", "k")]
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, df, planted).collect()) == [1, 1, 2]
