"""Finding test items inside training documents: BM25 with block-max pruning, then verification.

The test items are the indexed side and every passage of every document is a query. A passage has
to be retrieved for an item if its BM25 score reaches a share of the score that the item has with
itself, so thresholds are fixed and nothing is ranked or cut. Impacts are stored as shares of the
threshold. The index keeps, per word, its items in blocks with each block's largest impact. For a
passage, the sum of its words' block maxima bounds the score of every item in the block (Ding and
Suel, 2011); only blocks whose bound reaches the threshold are scored item by item. Bounds and
scores of a batch of passages are computed together in numpy.

Retrieved pairs are verified on the words themselves: of the item's five-word shingles a share has
to be in the passage, and as large a share of the words of its question, and of its answer.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skyframe.llm.tables import stored, with_row
from skyframe.llm.words import slices, words_of

K1, B = 1.2, 0.75
# Of an item's score with itself, what a passage has to reach.
RETRIEVED = 0.5
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCK = 16
# Items of one index, by the bytes of their text: what a broadcast may hold.
INDEX_BYTES = 8 << 20
# Entries of a table of passages by blocks that a batch may take.
_CELLS = 1 << 21

# Letters and digits stay, signs become spaces: punctuation that was added to a word hides nothing.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass
class Index:
    """Words by hash, ascending; for each its blocks and their largest impacts, and its items and
    impacts. `parts[i]` holds item i's shingles, and the words of its question and its answer."""

    ids: list
    words: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_impact: np.ndarray
    first: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    window: int
    parts: list[tuple[set, set, set]]


def _clean(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_LETTERS)


def _shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """Runs of `width` words; a shorter text is one run, an empty one has none."""
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def question_and_answer(text: str) -> tuple[str, str]:
    """A test item's last sentence is its answer and what stands before it the question. One
    sentence is all question."""
    cut = [m.end() for m in re.finditer(r"[.!?:]\s+", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


@dataclass
class Statistics:
    """Of all items of a benchmark that have a word: how many, their mean and their greatest number
    of words, and of some words how many items have each."""

    items: int
    mean: float
    longest: int
    having: dict[bytes, int]


def statistics(rows: list[tuple]) -> Statistics:
    """Of all (id, text) rows of a benchmark."""
    bags = [words for _, text in rows if (words := _clean(text).split())]
    having: dict[bytes, int] = defaultdict(int)
    for words in bags:
        for word in set(words):
            having[word] += 1
    sizes = [len(words) for words in bags]
    return Statistics(len(bags), sum(sizes) / max(1, len(bags)), max(sizes, default=1), having)


def build_index(rows: list[tuple], share: float = RETRIEVED, told: Statistics | None = None) -> Index:
    """Of (id, text) rows. An item without a word is never found. `told` are the statistics of the
    whole benchmark, where the rows are a part of it."""
    told = statistics(rows) if told is None else told
    ids, bags, parts = [], [], []
    for item_id, text in rows:
        words = _clean(text).split()
        if not words:
            continue
        question, answer = question_and_answer(text)
        ids.append(item_id)
        bags.append(words)
        parts.append((_shingles(words, SHINGLE_WORDS), set(_clean(question).split()), set(_clean(answer).split())))
    postings: dict[bytes, dict[int, float]] = defaultdict(dict)
    for i, words in enumerate(bags):
        for word in words:
            postings[word][i] = postings[word].get(i, 0) + 1
    own = np.zeros(len(bags))
    for word, items in postings.items():
        having = told.having[word]
        idf = math.log(1 + (told.items - having + 0.5) / (having + 0.5))
        for i, tf in items.items():
            items[i] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(bags[i]) / told.mean))
            own[i] += items[i]
    names = list(postings)
    found = words_of([b" ".join(names)])
    hashes = found.hashes() if names else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    columns: dict[str, list] = {k: [] for k in ("blocks", "block_impact", "items", "impact")}
    block_first, first = [0], [0]
    for k in order:
        largest: dict[int, float] = {}
        for i, impact in sorted(postings[names[k]].items()):
            impact /= share * own[i]
            columns["items"].append(i)
            columns["impact"].append(impact)
            largest[i // BLOCK] = max(largest.get(i // BLOCK, 0.0), impact)
        columns["blocks"] += largest
        columns["block_impact"] += largest.values()
        block_first.append(len(columns["blocks"]))
        first.append(len(columns["items"]))
    return Index(
        ids,
        hashes[order],
        np.array(block_first),
        np.array(columns["blocks"], np.int64),
        np.array(columns["block_impact"]),
        np.array(first),
        np.array(columns["items"], np.int64),
        np.array(columns["impact"]),
        told.longest,
        parts,
    )


def _runs(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of each list in `which`, and how many each has."""
    sizes = first[which + 1] - first[which]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - sizes), sizes), sizes


def _retrieved(index: Index, passage: np.ndarray, word: np.ndarray, passages: int) -> np.ndarray:
    """(passage, item) of every score that reaches the threshold, from the distinct (passage, word)
    pairs, by passage."""
    blocks = (len(index.ids) + BLOCK - 1) // BLOCK
    out = []
    # A passage whose words could not reach the threshold even with their largest impacts is skipped.
    most = np.maximum.reduceat(index.block_impact, index.block_first[:-1])
    able = np.bincount(passage, most[word], passages) >= 1 - 1e-9
    keep = able[passage]
    passage, word = passage[keep], word[keep]
    step = max(1, _CELLS // max(1, blocks))
    for low in range(0, passages, step):
        some = slice(*np.searchsorted(passage, (low, low + step)))
        p, w = passage[some] - low, word[some]
        size = min(step, passages - low)
        at, sizes = _runs(index.block_first, w)
        cells = np.repeat(p, sizes) * blocks + index.blocks[at]
        bound = np.bincount(cells, index.block_impact[at], size * blocks)
        open_ = bound >= 1 - 1e-9
        live = open_.reshape(size, blocks).any(axis=1)[p]
        if not live.any():
            continue
        at, sizes = _runs(index.first, w[live])
        p_, items = np.repeat(p[live], sizes), index.items[at]
        keep = open_[p_ * blocks + items // BLOCK]
        pairs, where = np.unique(p_[keep] * len(index.ids) + items[keep], return_inverse=True)
        score = np.bincount(where, index.impact[at][keep], len(pairs))
        pairs = pairs[score >= 1 - 1e-9]
        out.append(np.stack((pairs // len(index.ids) + low, pairs % len(index.ids))))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def _share(part: set, seen: set) -> float:
    return len(part & seen) / len(part) if part else 1.0


def _matches(index: Index, cleaned: list[bytes]) -> list[tuple[int, int, float, float, float]]:
    """(text, item, share of its shingles, of its question's words, of its answer's) of all verified
    pairs of some texts."""
    begins, passages, found = retrieved(index, cleaned)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    seen: dict[int, tuple[set, set, list]] = {}
    for p, i in zip(passages.tolist(), found.tolist()):
        t = int(np.searchsorted(begins, p, "right") - 1)
        if p not in seen:
            low = (p - int(begins[t])) * index.window
            body = cleaned[t].split()[low : low + 2 * index.window]
            seen[p] = (_shingles(body, SHINGLE_WORDS), set(body), body)
        shingles, bag, body = seen[p]
        own, question, answer = index.parts[i]
        width = min(map(len, own))
        shares = (_share(own, shingles if width == SHINGLE_WORDS else _shingles(body, width)), _share(question, bag), _share(answer, bag))
        if min(shares) >= SIMILARITY:
            best[t, i] = max(best.get((t, i), (0.0, 0.0, 0.0)), shares)
    return [(t, i, *shares) for (t, i), shares in best.items()]


def retrieved(index: Index, cleaned: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages of some texts, as the first of each text, and the (passage, item) pairs whose
    score reaches the threshold.

    A passage is a window of twice the longest item, begun after each such length, so whatever is
    as long as an item is whole in one of them.
    """
    none = np.empty(0, np.int64)
    words = words_of(cleaned)
    hashes = words.hashes()
    at = np.searchsorted(index.words, hashes)
    at[at == len(index.words)] = 0
    known = np.flatnonzero(index.words[at] == hashes) if len(index.words) else np.empty(0, np.int64)
    counts = words.counts()
    each = np.maximum(1, -(-counts // index.window) - 1)
    begins = np.concatenate(([0], np.cumsum(each)))
    if not len(known):
        return begins, none, none
    text = np.searchsorted(words.first, known, "right") - 1
    place = (known - words.first[text]) // index.window
    # A word is in the window that begins in its stretch and in the one before.
    both = np.concatenate((np.minimum(place, each[text] - 1), np.maximum(place - 1, 0)))
    passage = np.concatenate((begins[text], begins[text])) + both
    pairs = np.unique(passage * len(index.words) + np.concatenate((at[known], at[known])))
    return begins, *_retrieved(index, pairs // len(index.words), pairs % len(index.words), int(begins[-1]))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(row, item_id, overlap, question_overlap, answer_overlap): every test item found in a
    document, once, with the shares that verify it.

    `row` is a struct of the document's columns but its text. Texts are compared by their runs of
    letters and digits, lower-cased. An item is found if one passage holds 0.8 of
    its five-word shingles, and 0.8 of the words of its question and of its answer, which is its
    last sentence. An item of fewer words is one shingle. Null, empty and wordless texts and items match nothing.
    Repeated rows are found each; repeated items, each under its id.

    Items are taken by parts of bounded bytes, each indexed and broadcast in turn: with one part,
    which is usual, the documents are read once. An item too long for that is a part of its own.
    Document frequencies, lengths and the window are those of the whole benchmark, so that what is
    retrieved does not depend on the parts.
    """
    columns = [F.col(f"`{name}`") for name in documents.columns if name != text]
    source = documents.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = with_row(source, f"item_id {kind.simpleString()}, overlap double, question_overlap double, answer_overlap double")
    id_type = to_arrow_type(kind)

    def search(index: Index) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_clean(value.as_py()) for value in batch.column(1)]
                for begin, end in slices(texts):
                    found = _matches(index, texts[begin:end])
                    if not found:
                        continue
                    rows, items, *shares = zip(*found)
                    ids = pa.array([index.ids[i] for i in items], id_type)
                    own = [batch.column(0).take(pa.array([begin + t for t in rows])), ids, *map(pa.array, shares)]
                    yield pa.RecordBatch.from_arrays(own, ["row", "item_id", "overlap", "question_overlap", "answer_overlap"])

        return source.mapInArrow(run, schema)

    found = None
    for index in indexes(benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))):
        found = search(index) if found is None else found.unionByName(search(index))
    return found


def indexes(items: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of (item_id, text) rows, by parts of `most_bytes` of text."""
    items = items.where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))
    if parts == 1:
        yield build_index([tuple(row) for row in items.collect()])
        return
    items = stored(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "benchmark")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each word of an item once, and its number of words under no word.
        for batch in batches:
            rows = []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _clean(text).split()
                rows += [(part, word, 0) for word in set(own)] + ([(part, None, len(own))] if own else [])
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "word", "size"])

    named = stored(items.select("part", "text").mapInArrow(words, "part bigint, word binary, size bigint"), "benchmark-words")
    told = named.where("word IS NULL").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest")).first()
    having = stored(named.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")), "benchmark-frequencies")
    for part in range(parts):
        rows = [tuple(row) for row in items.where(F.col("part") == part).select("item_id", "text").collect()]
        own = having.join(named.where(F.col("part") == part).select("word").distinct(), "word").collect()
        own = {bytes(row["word"]): row["n"] for row in own}
        yield build_index(rows, told=Statistics(told.n, (told.total or 0) / max(1, told.n), told.longest or 1, own))
