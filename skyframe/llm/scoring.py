"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980).

The probability of a word is a mixture: a uniform one, the unigram's maximum-likelihood estimate,
the bigram's, and so on up to `order`. The weights depend on how often the longest context was
seen, in buckets of powers of two, and are learned by expectation-maximisation on texts held out
from the counts that the estimates are then taken from.

How it moves. Texts are dealt into chunks by hash. A chunk, once its texts have met, names the
distinct n-grams that it holds, as hashes in ascending order, with their counts, cut by range of hash
into shards: one list a chunk, shard and n, however many parts the input has. A shard
adds up what all chunks say and answers each chunk with the totals of the n-grams it named, in the
order it named them, so an answer is a list of counts and no key travels back. Hashes in ascending
order are sent as the steps between them, and lists in as many bytes a number as its largest needs.
A chunk then scores
its texts from the answers, a slice of them at a time. Copies of a text are in one chunk, but only
one of them travels there from each part of the input, and rows get their scores by the text's hash.
An n-gram that is everywhere is one entry a chunk, so no shard is hot;
chunks and shards both grow in number with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import scratch, stored, swept, text_key
from skyframe.llm.words import mixed, slices, words_of

ORDER = 2
# Text in a chunk; several times that is the memory a task needs. Raise it with the executors'.
CHUNK_BYTES = 8 << 20
LEAST_CHUNKS = 40
# One chunk in so many is held out to learn the weights on.
HELD = 10
# Chunks to a shard: a task holds as many n-grams of a shard as so many chunks have.
CHUNKS_A_SHARD = 2

_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xD1342543DE82EF95)
# Bytes of text that a chunk is scored at a time.
_SLICE = 2 << 20
# Bins of a probability's logarithm to base two, in each of which its mean is exact.
_FINE = 4


@dataclass(frozen=True)
class Model:
    """weights[bucket][k]: the share of the k-gram estimate, the uniform one at k = 0."""

    order: int
    tokens: int
    types: int
    weights: list[list[float]]


def _grams(texts: list[bytes | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, by n; the end of each text among the tokens."""
    words = words_of(texts)
    counts = words.counts()
    ends = np.cumsum(counts + 1) - 1
    tokens = np.empty(len(words.starts) + len(texts), np.uint64)
    plain = np.ones(len(tokens), bool)
    plain[ends] = False
    tokens[plain] = words.hashes()
    tokens[ends] = _END
    begins = ends - counts
    grams = [tokens]
    for n in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = grams[-1][:-1]
        before[begins] = _BEGIN
        grams.append(mixed(before * _STEP + tokens + np.uint64(n)))
    return grams, ends


def _limits(shards: int) -> np.ndarray:
    """The hash that each shard's range begins with."""
    return np.array([(k << 64) // shards for k in range(shards)], np.uint64)


def _ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values. By sorting: `np.unique` makes a hash table, which takes ten times as long."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


_NAMED = "shard int, chunk int, n int, grams binary, counts binary"
_TOTALS = ["types", "tokens", "rest_types", "rest_tokens"]
_ANSWERED = "chunk int, shard int, n int, every binary, rest binary, " + ", ".join(f"{name} bigint" for name in _TOTALS)
_TEXTS = "chunk int, key binary, text binary, weight bigint"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, with how many learned rows have it."""
    for batch in batches:
        codes = batch.column("key").dictionary_encode().indices.to_numpy()
        number = int(codes.max()) + 1 if len(codes) else 0
        first = np.zeros(number, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        weight = np.bincount(codes, batch.column("learned").to_numpy(zero_copy_only=False), number).astype(np.int64)
        at = pa.array(first)
        own = [batch.column(name).take(at) for name in ("chunk", "key", "text")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(weight)], ["chunk", "key", "text", "weight"])


def _unique(texts: pa.Table) -> tuple[list[bytes], list[bytes | None], np.ndarray]:
    """The texts of a chunk, each once: their keys, themselves, and the learned rows of each."""
    keys = texts.column("key").to_pylist()
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(key, len(place)) for key in keys], np.int64)
    weight = np.bincount(which, texts.column("weight").to_numpy(), len(place)) if len(place) else np.zeros(0)
    first = np.zeros(len(place), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return list(place), texts.column("text").take(pa.array(first)).to_pylist(), weight.astype(np.int64)


def _distinct(texts: list[bytes | None], order: int) -> list[np.ndarray]:
    """The distinct n-grams of some texts by n, ascending."""
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    for low, high in slices(texts, _SLICE):
        for n, keys in enumerate(_grams(texts[low:high], order)[0]):
            parts[n].append(_ascending(keys))
    return [_ascending(np.concatenate(part)) if part else np.empty(0, np.uint64) for part in parts]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)


def _counted(texts: list[bytes | None], weight: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of some texts by n, ascending, and how often they are in learned rows."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for low, high in slices(texts, _SLICE):
        grams, ends = _grams(texts[low:high], order)
        each = np.repeat(weight[low:high], np.diff(np.concatenate(([-1], ends))))
        for n, keys in enumerate(grams):
            parts[n].append(_summed(keys, each))
    return [part[0] if len(part) == 1 else _summed(*map(np.concatenate, zip(*part))) for part in parts]


def _planes(values: np.ndarray) -> bytes:
    """Integers, not negative, in as many bytes each as the largest needs, after how many that is;
    all their first bytes together, then all second ones, and so on, as a shuffle's compression
    likes them."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(buffer: bytes) -> np.ndarray:
    planes = np.frombuffer(buffer, np.uint8, offset=1).reshape(buffer[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.view("<u8").ravel()


def _named(order: int, shards: int):
    """Of a chunk, for each n and shard: its distinct n-grams with their learned counts."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        _, rows, weight = _unique(texts)
        limits, out = _limits(shards), []
        for n, (distinct, counts) in enumerate(_counted(rows, weight, order), 1):
            cuts = [*np.searchsorted(distinct, limits).tolist(), len(distinct)]
            for shard, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                if low < high:
                    steps = np.diff(distinct[low:high], prepend=limits[shard])
                    out.append((shard, key[0].as_py(), n, _planes(steps), _planes(counts[low:high])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)]
        return pa.table(columns, ["shard", "chunk", "n", "grams", "counts"])

    return run


def _answered(shards: int):
    """What a shard has counted: the totals for each chunk, and its own totals as chunk -1.

    `every` counts all learned texts, `rest` all but those of held-out chunks. Held-out chunks are
    answered with both.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, out = key[0].as_py(), []
        numbers = table.column("n").to_numpy()
        for n in np.unique(numbers):
            part = table.filter(pa.array(numbers == n))
            chunks = part.column("chunk").to_numpy()
            lists = [_unplaned(buffer) for buffer in part.column("grams").to_pylist()]
            sizes = np.array([len(steps) for steps in lists])
            keys = np.concatenate([np.cumsum(steps) for steps in lists]) + _limits(shards)[shard]
            counts = np.concatenate([_unplaned(buffer) for buffer in part.column("counts").to_pylist()]).astype(np.int64)
            del lists, part
            distinct, where = np.unique(keys, return_inverse=True)
            del keys
            every = np.bincount(where, counts, len(distinct)).astype(np.int64)
            held = np.repeat(chunks % HELD == 0, sizes)
            rest = every - np.bincount(where[held], counts[held], len(distinct)).astype(np.int64)
            ends = np.cumsum(sizes)
            for chunk, a, b in zip(chunks.tolist(), (ends - sizes).tolist(), ends.tolist()):
                own = where[a:b]
                answer = _planes(rest[own]) if chunk % HELD == 0 else b""
                out.append((chunk, shard, int(n), _planes(every[own]), answer, None, None, None, None))
            totals = [int(y) for x in (every, rest) for y in ((x > 0).sum(), x.sum())]
            out.append((-1, shard, int(n), b"", b"", *totals))
        return _answers(out)

    return run


def _answers(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out))
    return pa.table(
        {
            "chunk": pa.array(columns[0], pa.int32()),
            "shard": pa.array(columns[1], pa.int32()),
            "n": pa.array(columns[2], pa.int32()),
            "every": pa.array(columns[3], pa.binary()),
            "rest": pa.array(columns[4], pa.binary()),
            **{name: pa.array(column, pa.int64()) for name, column in zip(_TOTALS, columns[5:])},
        }
    )


def _lookup(table: pa.Table, column: str, n: int, size: int) -> np.ndarray:
    """The answers to one chunk for one n, in the order its n-grams were named in."""
    part = table.filter(pa.array(table.column("n").to_numpy() == n)).sort_by("shard")
    lists = [_unplaned(buffer) for buffer in part.column(column).to_pylist()]
    counts = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
    if len(counts) != size:
        raise ValueError(f"a chunk named {size} {n}-grams and was answered {len(counts)}")
    return counts


def _estimates(texts, distinct: list[np.ndarray], answers: list[np.ndarray], tokens: int):
    """For every token: the estimates by n from 1, and how often the longest context was seen.

    A context's count is that of its own n-gram, since every word has a next one; what begins a
    text was seen as often as what ends one. Also the unigram counts, and the ends of texts.
    """
    order = len(distinct)
    grams, ends = _grams(texts, order)
    begins = np.concatenate(([0], ends[:-1] + 1))
    probabilities, context, first = [], None, None
    for n, keys in enumerate(grams, 1):
        # In ascending order they are looked up several times as fast.
        own, where = np.unique(keys, return_inverse=True)
        counts = answers[n - 1][np.searchsorted(distinct[n - 1], own)][where]
        if n == 1:
            first = counts
            probabilities.append(counts / max(tokens, 1))
        else:
            probabilities.append(counts / np.maximum(context, 1))
        if n < order:
            context = np.empty_like(counts)
            context[1:] = counts[:-1]
            context[begins] = first[ends]
    if context is None:
        context = np.full(len(first), tokens)
    return probabilities, _bucket(context), first, ends


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its count's logarithm to base two."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64) * (context > 0)


def _histogram(order: int, tokens: int):
    """Of a held-out chunk: tokens by bucket and by the logarithms of their estimates."""

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        columns = ["bucket", "bins", "tokens", *[f"p{n}" for n in range(1, order + 1)]]
        _, rows, weight = _unique(texts)
        distinct = _distinct(rows, order)
        counts = [_lookup(answers, "rest", n, len(own)) for n, own in enumerate(distinct, 1)]
        out = []
        for low, high in slices(rows, _SLICE):
            probabilities, bucket, _, ends = _estimates(rows[low:high], distinct, counts, tokens)
            wanted = np.repeat(weight[low:high], np.diff(np.concatenate(([-1], ends))))
            bins = np.zeros(len(bucket), np.int64)
            for p in probabilities:
                log = np.round(-_FINE * np.log2(np.where(p > 0, p, 1.0))).astype(np.int64)
                bins = bins * 1024 + np.where(p > 0, 1 + log, 0)
            # Ten bits an estimate, and the bucket above them.
            code, where = np.unique((bucket << 10 * order) + bins, return_inverse=True)
            sums = [np.bincount(where, p * wanted, len(code)) for p in probabilities]
            number = np.bincount(where, wanted, len(code)).astype(np.int64)
            own = pa.table([*map(pa.array, (code >> 10 * order, code & ((1 << 10 * order) - 1), number, *sums))], columns)
            out.append(own.filter(pa.array(number > 0)))
        if not out:
            out = [pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * order, columns)]
        return pa.concat_tables(out)

    return run


def mixed_estimates(model: Model, probabilities: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """The model's probability of every token, from its estimates and the bucket of its context."""
    weights = np.array(model.weights)
    share = weights[np.minimum(bucket, len(weights) - 1)]
    total = share[:, 0] / (model.types + 1)
    for n, p in enumerate(probabilities, 1):
        total += share[:, n] * p
    return total


_SCORED = "key binary, n_tokens bigint, n_known bigint, base_score double, score double"


def _scores(model: Model):
    """Of a chunk: what the model and the base say of each of its texts."""

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, rows, _ = _unique(texts)
        distinct = _distinct(rows, model.order)
        counts = [_lookup(answers, "every", n, len(own)) for n, own in enumerate(distinct, 1)]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for low, high in slices(rows, _SLICE):
            probabilities, bucket, seen, ends = _estimates(rows[low:high], distinct, counts, model.tokens)
            begins = np.concatenate(([0], ends[:-1] + 1))
            base = np.log10((seen + 1) / (model.tokens + model.types + 1))
            score = np.log10(mixed_estimates(model, probabilities, bucket))
            known = (seen > 0).astype(np.int64)
            sums = [np.add.reduceat(values, begins) for values in (known, base, score)]
            for column, values in zip(columns, (ends - begins + 1, *sums)):
                column.append(values)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        own = [pa.array(np.concatenate(column) if column else [], kind) for column, kind in zip(columns, kinds)]
        return pa.table([pa.array(keys, pa.binary()), *own], ["key", "n_tokens", "n_known", "base_score", "score"])

    return run


def _em(rows, order: int, tokens: int, types: int, rounds: int = 200) -> list[list[float]]:
    """Weights by bucket that make the held-out tokens most likely.

    A bucket without held-out tokens takes the nearest's; without any at all only the uniform
    estimate counts. Where the context was never seen, bucket 0, the longest estimate is zero and
    has no weight; without held-out tokens of its own, that bucket's other weights are those that
    are best for all tokens without the longest.
    """
    parts: dict[int, list] = {}
    for row in rows:
        n = float(row["tokens"])
        parts.setdefault(row["bucket"], []).append((n, [1 / (types + 1), *(row[f"p{k}"] / n for k in range(1, order + 1))]))
    if parts and 0 not in parts and order > 1:
        parts[0] = [(n, [*x[:-1], 0.0]) for entries in list(parts.values()) for n, x in entries]
    learned: dict[int, np.ndarray] = {}
    for bucket, entries in parts.items():
        count = np.array([n for n, _ in entries])
        p = np.array([x for _, x in entries])
        weight = np.full(order + 1, 1 / (order + 1))
        if bucket == 0 and order > 1:
            weight = np.array([1 / order] * order + [0.0])
        for _ in range(rounds):
            each = p * weight
            new = (count[:, None] * each / each.sum(axis=1, keepdims=True)).sum(axis=0) / count.sum()
            done = np.abs(new - weight).max() < 1e-9
            weight = new
            if done:
                break
        # Something never seen has to stay possible.
        weight = np.maximum(weight, [1e-6] + [0.0] * order)
        learned[bucket] = weight / weight.sum()
    if not learned:
        learned = {0: np.array([1.0] + [0.0] * order)}
    last = 64
    return [learned[min(learned, key=lambda b: (abs(b - k), b))].tolist() for k in range(last + 1)]


def interpolated_scores(
    documents: DataFrame,
    learned: Column,
    text: str = "text",
    order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Every row of `documents`: a struct `row` of its columns but the text, and `n_tokens`,
    `n_known` (tokens that learned texts hold), `train_tokens`, `train_types`, `base_score` (add-one
    unigrams) and `score` (the model's log10 probability of the text).

    The model learns from rows where `learned` is true; a null there is false. Tokens are a text's
    words and one end, so a null or empty text is one token. Without learned rows every probability
    is the uniform one. Repeated rows count each, and get equal scores. An empty table gives an
    empty one. Counts cover all learned rows. Only the totals and a histogram of held-out tokens,
    bounded by 64 buckets and the bins of `order` logarithms, reach the driver.
    """
    spark = documents.sparkSession
    value = F.col(f"`{text}`")
    size = documents.agg(F.sum(F.coalesce(F.octet_length(value), F.lit(0)) + 1)).first()[0] or 0
    chunks = HELD * max(LEAST_CHUNKS // HELD, math.ceil(size / chunk_bytes / HELD))
    shards = math.ceil(chunks / CHUNKS_A_SHARD)
    columns = [F.col(f"`{name}`") for name in documents.columns if name != text]
    source = documents.select(
        F.struct(*columns).alias("row"),
        F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(chunks)).cast("int").alias("chunk"),
        text_key(value).alias("key"),
        F.coalesce(learned, F.lit(False)).alias("learned"),
        value.cast("binary").alias("text"),
    )

    with scratch():
        # Answers are in the order of all that a chunk named, so texts that are not learned are sent along.
        texts = source.select("chunk", "key", "learned", "text").mapInArrow(_once, _TEXTS)
        named = texts.groupBy("chunk").applyInArrow(_named(order, shards), _NAMED)
        with swept(spark):
            answers = stored(named.groupBy("shard").applyInArrow(_answered(shards), _ANSWERED), "gram-counts")
        totals = answers.where("chunk = -1 AND n = 1").agg(*[F.sum(name).alias(name) for name in _TOTALS]).first()
        types, tokens = totals.types or 0, totals.tokens or 0

        schema = "bucket bigint, bins bigint, tokens bigint, " + ", ".join(f"p{n} double" for n in range(1, order + 1))
        counted = (
            source.where(F.col("chunk") % HELD == 0)
            .select("chunk", "key", "learned", "text")
            .mapInArrow(_once, _TEXTS)
            .groupBy("chunk")
            .cogroup(answers.where(F.col("chunk") % HELD == 0).groupBy("chunk"))
            .applyInArrow(_histogram(order, totals.rest_tokens or 0), schema)
            .groupBy("bucket", "bins")
            .agg(F.sum("tokens").alias("tokens"), *[F.sum(f"p{n}").alias(f"p{n}") for n in range(1, order + 1)])
            .collect()
        )
        model = Model(order, tokens, types, _em(counted, order, tokens, totals.rest_types or 0))
        scored = texts.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(_scores(model), _SCORED)
        scored = stored(scored, "scores", keep=True)
    scored = source.select("row", "key").join(scored, "key").drop("key")
    return scored.withColumns({"train_tokens": F.lit(tokens).cast("bigint"), "train_types": F.lit(types).cast("bigint")})
