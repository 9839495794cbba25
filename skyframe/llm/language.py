"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its character n-grams, hashed into buckets; the mean of their embeddings goes
through a linear layer (Joulin et al., 2016). Both are trained together by stochastic gradient
descent in numpy, on a bounded sample. A temperature fitted on part of the sample makes scores
probabilities, and what scores far below nearly all of that part is rejected. So is a text most of whose subwords
were never seen: buckets are shared, and would give it some language's score all the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import with_row

# Labelled rows that are learned from, over all languages. A row gives SIGNATURES numbers at most.
SAMPLE_ROWS = 4_000
# Subwords are told apart by this many hashes, and share this many embeddings.
SIGNATURES = 1 << 18
BUCKETS = 1 << 14
SUBWORDS = (2, 3)
DIMENSION = 16
EPOCHS = 12
# Subwords of a text that the temperature is fitted on.
FEW = 12
# Of the texts kept for calibration, the share that is lowest: limits are half way to those, from
# chance for a score, and from nothing for how many subwords were seen.
LOWEST = 0.002
UNKNOWN = "und"
# Characters that are hashed at once.
_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    """classes by name; table[bucket] is what one subword adds to each class's logit, and
    seen[signature] whether it was learned from. A text is rejected that scores below `limit`, or
    of whose subwords a smaller share than `familiar` was seen."""

    classes: list[str]
    table: np.ndarray
    seen: np.ndarray
    temperature: float
    limit: float
    familiar: float


def _subwords(text: str):
    """Signatures of the n-grams of a text, a part of it at a time; whitespace counts as one space.

    Parts overlap by what an n-gram needs, so the n-grams are those of the whole text.
    """
    words = " " + " ".join(text.lower().split()) + " "
    longest = max(SUBWORDS)
    for at in range(0, len(words), _AT_ONCE):
        part = words[at : at + _AT_ONCE + longest - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in SUBWORDS:
            size = min(len(codes) - n + 1, _AT_ONCE)
            if size <= 0:
                continue
            key = np.full(size, n, np.uint32)
            for k in range(n):
                key = (key ^ codes[k : k + size]) * np.uint32(0x01000193 + 2 * k)
                key ^= key >> np.uint32(15)
            yield (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - (SIGNATURES.bit_length() - 1))


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a text and how often each is there."""
    counts = np.zeros(SIGNATURES, np.int64)
    for signatures in _subwords(text):
        counts += np.bincount(signatures, minlength=SIGNATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class _Text:
    """A labelled text: its signatures, and how often each is there."""

    lang: str
    at: np.ndarray
    n: np.ndarray


def _sampled(documents: DataFrame, text: str, lang: str, learned: Column, rows: int) -> list[_Text]:
    """At most about `rows` labelled rows as sparse counts, as many of each language where it has
    them: those whose text hashes lowest, so the sample does not depend on the order of rows."""
    value, label = F.col(f"`{text}`"), F.col(f"`{lang}`")
    known = documents.where(learned & label.isNotNull() & value.isNotNull())
    known = known.select(label.cast("string").alias("lang"), value.alias("text"), F.pmod(F.xxhash64(value), F.lit(1 << 30)).alias("draw"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not sizes:
        return []
    each = max(1, rows // len(sizes))
    shares = [(row["lang"], int((1 << 30) * min(1.0, each / row["count"]))) for row in sizes]
    # One row a language, and no more than `rows` of them.
    shares = F.broadcast(documents.sparkSession.createDataFrame(shares, "lang string, share long"))
    picked = known.join(shares, "lang").where("draw < share").select("lang", "draw", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang_, draw, body in zip(*(batch.column(k) for k in range(3))):
                if _has_letter(body.as_py()):
                    at, counts = _counts(body.as_py())
                    sparse = [pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang_.as_py()]), pa.array([draw.as_py()]), *sparse], ["lang", "draw", "at", "n"])

    found = picked.mapInArrow(run, "lang string, draw bigint, at array<int>, n array<int>")
    # Copies of one text share its draw; the cut keeps the bound whatever is copied.
    table = found.dropDuplicates(["lang", "draw"]).orderBy("draw", "lang").limit(2 * rows).toArrow()
    at, n = (table.column(name).combine_chunks() for name in ("at", "n"))
    cuts = at.offsets.to_numpy()
    at, n = at.values.to_numpy(), n.values.to_numpy()
    return [_Text(lang, at[a:b], n[a:b]) for lang, a, b in zip(table.column("lang").to_pylist(), cuts[:-1], cuts[1:])]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(documents: DataFrame, learned: Column, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the languages in `lang`, from a sample of the rows where `learned` is true.

    None if no such row has a language and a text with a letter.
    """
    sample = _sampled(documents, text, lang, learned, rows)
    if not sample:
        return None
    classes = sorted({row.lang for row in sample})
    label = np.array([classes.index(row.lang) for row in sample])
    random = np.random.default_rng(7)
    order = random.permutation(len(sample))
    aside = order[: len(sample) // 5]
    train = order[len(aside) :] if len(sample) >= 20 else order

    def dense(which) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for k, i in enumerate(which):
            x[k] = np.bincount(sample[i].at % BUCKETS, sample[i].n, BUCKETS)
        return x / x.sum(axis=1, keepdims=True)

    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    output = random.normal(0, 0.1, (DIMENSION, len(classes))).astype(np.float32)
    # Steps by the running mean square of each gradient: buckets differ a lot in how often they come.
    seen = [np.full_like(embedding, 1e-8), np.full_like(output, 1e-8)]
    steps = 0
    for epoch in range(EPOCHS):
        rate = 0.1 * (1 - epoch / EPOCHS)
        turn = random.permutation(train)
        for at in range(0, len(turn), 32):
            which = turn[at : at + 32]
            x = dense(which)
            hidden = x @ embedding
            wrong = _softmax(hidden @ output)
            wrong[np.arange(len(which)), label[which]] -= 1
            wrong /= len(which)
            gradients = [x.T @ (wrong @ output.T), hidden.T @ wrong]
            for weight, gradient, square in zip((embedding, output), gradients, seen):
                square *= 0.99
                square += 0.01 * gradient * gradient
                weight -= rate * gradient / (np.sqrt(square) + 1e-6)
            steps += 1
    table = embedding @ output

    held = aside if len(sample) >= 20 else order
    logits = np.concatenate([dense(held[k : k + 256]) @ table for k in range(0, len(held), 256)])
    # Whole texts leave no doubt to learn the temperature from; a few subwords of each do.
    few = []
    for i in held:
        drawn = random.choice(sample[i].at, FEW, p=sample[i].n / sample[i].n.sum())
        few.append(table[drawn % BUCKETS].mean(axis=0))
    few, truth = np.array(few), label[held]
    scales = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(_softmax(few / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    top = np.sort(_softmax(logits / temperature).max(axis=1))
    # A text of no known language scores near chance; one of two mixed scores less than the others,
    # but well above it, and is kept.
    chance = 1 / len(classes)
    limit = chance + (float(top[int(LOWEST * len(top))]) - chance) / 2
    seen = np.zeros(SIGNATURES, bool)
    for i in train:
        seen[sample[i].at] = True
    shares = np.sort([np.average(seen[sample[i].at], weights=sample[i].n) for i in held])
    familiar = float(shares[int(LOWEST * len(shares))]) / 2
    return LanguageModel(classes, table.astype(np.float32), seen, temperature, limit, familiar)


def _judged(model: LanguageModel | None, text: str | None) -> tuple[str, float, bool]:
    if model is None or not _has_letter(text):
        return UNKNOWN, 0.0, False
    total, size, known = np.zeros(len(model.classes)), 0, 0
    for signatures in _subwords(text):
        buckets = signatures % np.uint32(BUCKETS)
        if len(buckets) > BUCKETS:
            total += np.bincount(buckets, minlength=BUCKETS) @ model.table
        else:
            total += model.table[buckets].sum(axis=0, dtype=np.float64)
        size += len(buckets)
        known += int(model.seen[signatures].sum())
    p = _softmax((total / size / model.temperature)[None])[0]
    best = int(p.argmax())
    return model.classes[best], float(p[best]), bool(p[best] >= model.limit and known >= model.familiar * size)


def identify(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Every row of `documents`, its columns as they are in a struct `row`, with `lang_pred`,
    `lang_score` (0 to 1) and `accepted`.

    A null text, or one without a letter, is `und`, scores 0 and is rejected; so is everything
    where there was nothing to learn from. Others get the likeliest language, and are rejected if
    that scores below the model's limit or too few of the subwords are known. Whole texts are read, a part at a time. The model is a
    table of BUCKETS times languages numbers and SIGNATURES flags, sent with every task. Ties go to the language that
    sorts first. An empty table gives an empty one.
    """
    source = documents.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_judged(model, value.as_py()) for value in batch.column(1)]
            lang, score, accepted = (list(column) for column in zip(*found)) if found else ([], [], [])
            own = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], ["row", "lang_pred", "lang_score", "accepted"])

    return source.mapInArrow(run, with_row(source, "lang_pred string, lang_score double, accepted boolean"))
