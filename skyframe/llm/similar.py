"""Texts that share most of their shingles, found by SimHash and MinHash and verified shingle by shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.llm.components import components
from skyframe.llm.simhash import links, star_links, with_fingerprint
from skyframe.llm.tables import stored, text_key, unsent
from skyframe.llm.words import mixed, words_of

SHINGLE_WORDS = 5
# Jaccard similarity in tenths, so that it is compared in whole numbers.
TENTHS = 8
# Similar texts differ in at most one in nine of the shingles of both, counted together.
_NINE = (10 + TENTHS) // (10 - TENTHS)
# Bits in which two fingerprints may differ: the most that op6's three segments find.
BITS_APART = 5
# A pair of similarity s shares no band with odds (1 - s**ROWS)**BANDS: 3.1e-6 at 0.8, less above.
BANDS, ROWS = 32, 5
# Bytes of text that are hashed at once.
_AT_ONCE = 1 << 20
# Words of 64 bits that the marks of what a text differs in take.
_MARKS = 16

_constants = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _constants[: BANDS * ROWS] | np.uint64(1), _constants[BANDS * ROWS :]


def _shingles(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and where each text's begin and end.

    A text of fewer words is one shingle, one without words has none.
    """
    words = words_of(texts)
    counts, hashes = words.counts(), words.hashes()
    sizes = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - words.first[:-1], sizes)
    ends = np.repeat(words.first[1:], sizes)
    hashes = np.concatenate((hashes, np.zeros(width, np.uint64)))
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < ends, hashes[at + j], np.uint64(0))
    return mixed(total), cuts


def _bands(texts: list[bytes | None], width: int) -> np.ndarray:
    """(texts, BANDS) keys; texts of equal least hashes in all rows of a band share its key."""
    shingles, cuts = _shingles(texts, width)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        begins = cuts[:-1][some]
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mixed(key ^ np.minimum.reduceat(shingles * _FACTORS[k] + _SHIFTS[k], begins))
            keys[some, band] = key
    return keys.view(np.int64)


def _stretches(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Consecutive texts of about `_AT_ONCE` bytes, with the place of the first."""
    begin, part, size = 0, [], 0
    for at, value in enumerate(texts):
        part.append(value.as_py())
        size += len(part[-1] or b"")
        if size >= _AT_ONCE:
            yield begin, part
            begin, part, size = at + 1, [], 0
    if part:
        yield begin, part


def _mapped(source: DataFrame, name: str, width: int, whole: bool) -> DataFrame:
    """`source`, whose last column is a text, with an array of bigint in its place: the distinct
    shingles if `whole`, else the keys of the bands."""
    kept = source.columns[:-1]
    source = source.select(*kept, F.col(source.columns[-1]).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _stretches(batch.column(len(kept))):
                if whole:
                    shingles, cuts = _shingles(texts, width)
                    sets = [np.unique(shingles[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])]
                    values, sizes = np.concatenate(sets), [len(s) for s in sets]
                else:
                    values, sizes = _bands(texts, width).reshape(-1), [BANDS] * len(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                own = [column.slice(begin, len(texts)) for column in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, pa.array(values))], [*kept, name])

    schema = source.select(*kept, F.lit(None).cast("array<bigint>").alias(name)).schema
    return source.mapInArrow(run, schema)


def _sets(keys: DataFrame, texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of some texts. `texts` names one row of each text."""
    chosen = stored(texts.select("key", "id").join(unsent(keys.distinct()), "key", "left_semi"), "similar-ends")
    bodies = rows.select("key", "id", "text").join(chosen, ["key", "id"], "left_semi").dropDuplicates(["key", "id"])
    return stored(_mapped(bodies.select("key", "text"), "shingles", width, True), "similar-shingles")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys with their shingles, `s` and `t`."""
    both = pairs.join(unsent(sets.select(F.col("key").alias("a"), F.col("shingles").alias("s"))), "a")
    return both.join(unsent(sets.select(F.col("key").alias("b"), F.col("shingles").alias("t"))), "b")


def _similar() -> Column:
    shared = F.size(F.array_intersect("s", "t"))
    return (10 + TENTHS) * shared >= TENTHS * (F.size("s") + F.size("t"))


def _verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) of text keys that are similar."""
    pairs = stored(pairs, "similar-pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    both = _beside(pairs, _sets(ends, texts, rows, width))
    return stored(both.where(_similar()).select("a", "b"), "similar")


def _unordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _close(rows: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of keys of unlike texts whose SimHash fingerprints are close: of those that are
    equal the least with each other, of a dense set as many as join it, and every one across sets."""
    prints = with_fingerprint(rows.select("key", "text"), width=width).select("row.key", "fp")
    prints = stored(prints.where(F.col("key") != text_key(F.lit(""))).distinct(), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    equal = prints.join(least, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    star = stored(star_links(least.select("fp"), BITS_APART), "star-links")
    groups = stored(components(star), "star-groups")
    rooted = least.join(groups, least["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    found = star.unionByName(links(stored(rooted, "rooted"), BITS_APART)).distinct()
    for end in ("a", "b"):
        found = found.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_key")), end)
    return equal.unionByName(found.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def first_of_similar(rows: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(key, id): of each group of similar texts, the least id and its text's key.

    `rows` have a bigint `id`, a `text` and its `key`, which is `text_key`'s. Texts are linked whose
    sets of `width`-word shingles have a Jaccard similarity of 0.8 or more, and grouped by links.
    Wordless texts have one key between them, and are a group.

    Candidates have close SimHash fingerprints, or share a band of a MinHash signature, which finds
    those further apart too; each is verified on all of its shingles.
    Texts of a band are first compared with its centre, the text that shares bands with the most
    others. Most near copies are linked by that. Two of the others, or one of them and one that is
    linked, can only be similar if their differences from the centre overlap, see `_differing`, and
    only those are compared. No pair that could join two groups is left out.
    """
    signed = stored(_mapped(rows.select("key", "id", "text"), "bands", width, False), "bands")
    texts = stored(signed.groupBy("key").agg(F.min("id").alias("id"), F.min("bands").alias("bands")), "texts")
    wordless = text_key(F.lit(""))
    entries = texts.where(F.col("key") != wordless).select("key", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    entries = stored(entries.join(unsent(shared), "band"), "shared-bands")
    # What others were made from shares bands with the most of them.
    central = entries.groupBy("key").agg(F.sum("n").alias("weight"))
    weighed = entries.join(unsent(central), "key")
    centres = weighed.groupBy("band").agg(F.max_by("key", F.struct("weight", "key")).alias("centre"))
    star = entries.join(unsent(centres), "band").where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    star = stored(star.distinct(), "star-pairs")
    ends = star.select(F.col("a").alias("key")).unionByName(star.select(F.col("b").alias("key")))
    sets = _sets(ends, texts, rows, width)
    judged = stored(_beside(star, sets).select("a", "b", _similar().alias("linked")), "judged")
    close = _verified(_close(rows, width), texts, rows, width)
    groups = _grouped(components(judged.where("linked").select("a", "b").unionByName(close)))

    # Centres with another text beside one that is not linked to them.
    open_ = judged.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("apart"))
    open_ = stored(judged.join(open_.where("n > 1 AND apart > 0").select("a"), "a"), "open-centres")
    if not open_.isEmpty():
        groups = _joined(_differing(_beside(open_, sets)), groups, texts, rows, width)
    member = texts.select("key", "id").join(groups, "key", "left")
    member = member.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("id", "key")).alias("least"))
    return member.select("least.key", "least.id")


def _grouped(found: DataFrame) -> DataFrame:
    """(key, root), for texts that some link joins to others."""
    return stored(found.select(F.col("node").alias("key"), "root"), "similar-groups")


def _rooted(df: DataFrame, groups: DataFrame, key: str, root: str) -> DataFrame:
    """`df` with the group that the text in column `key` is in: itself where nothing joined it."""
    own = groups.select(F.col("key").alias("__node"), F.col("root").alias("__root"))
    df = df.join(own, F.col(key) == F.col("__node"), "left")
    return df.withColumn(root, F.coalesce("__root", key)).drop("__node", "__root")


def _profiles(both: DataFrame) -> DataFrame:
    """Of each text `b` beside a centre `a`: how many shingles it has, the `buckets` of those that
    only one of the two has, and how many of these are its `firsts` as `_differing` means."""
    centre = F.xxhash64("a")
    added = F.transform(F.sort_array(F.array_except("t", "s")), lambda h: F.xxhash64(centre, h, F.lit(True)))
    removed = F.transform(F.sort_array(F.array_except("s", "t")), lambda h: F.xxhash64(centre, h, F.lit(False)))
    sizes = [F.size("s").alias("centre_size"), F.size("t").alias("size")]
    rows = both.select("a", "b", "linked", *sizes, F.concat(added, removed).alias("buckets"))
    unlike = F.size("buckets")
    # Whole numbers: more than m / 18 is at least floor(m / 18) + 1.
    held = F.floor((_NINE * unlike + F.col("centre_size") - F.col("size")) / (2 * _NINE)) + 1
    firsts = F.least(unlike, F.greatest(F.lit(0), unlike - held + 1)).cast("int")
    return rows.select("a", "b", "linked", "size", "buckets", unlike.alias("unlike"), firsts.alias("firsts"))


def _marked(profiles: DataFrame) -> DataFrame:
    """Profiles with `marks` in place of the buckets: a bit that each of them sets, so that two texts
    have no more buckets in common than one has, less the marks that only it has."""
    source = profiles.select("a", "b", "size", "unlike", "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, _MARKS), np.uint64)
            for i in range(batch.num_rows):
                buckets = batch.column(4)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                np.bitwise_or.at(out[i], (buckets >> np.uint64(6)) % np.uint64(_MARKS), np.uint64(1) << (buckets & np.uint64(63)))
            marks = [pa.array(out[:, k].copy().view(np.int64)) for k in range(_MARKS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *marks], names)

    more = T.StructType.fromDDL(", ".join(f"m{k} bigint" for k in range(_MARKS)))
    schema = T.StructType([*source.select("a", "b", "size", "unlike").schema.fields, *more.fields])
    names = schema.names
    return source.mapInArrow(run, schema)


def _differing(both: DataFrame) -> DataFrame:
    """(bucket, key, linked, first, n) with the text's profile: texts by what they differ in from a
    centre, of buckets of which something can come; `n` is how many of a bucket's are first.

    With d(x) the shingles that x or its centre c has and not both, two texts differ by
    |d(x)| + |d(y)| - 2 |d(x) & d(y)| shingles, and are similar if that is at most (|x| + |y|) / 9.
    If x is not linked, |d(x)| is over (|x| + |c|) / 9, so d(x) has to hold more than
    (|d(y)| + (|c| - |y|) / 9) / 2 of d(y), whatever y is. Then one of the first shingles of d(y),
    in any order, is among them: of |d(y)| less that number, and one more. What c lacks is put
    first, which other copies seldom have. Those first ones are the buckets of y (`first`), all of
    d(x) those of a text that is not linked.
    """
    profiles = stored(_profiles(both), "profiles")
    wanted = F.when(F.col("linked"), F.slice("buckets", F.lit(1), F.col("firsts"))).otherwise(F.col("buckets"))
    rows = profiles.select("a", "b", "linked", "firsts", F.posexplode(wanted).alias("at", "bucket"))
    rows = rows.select("bucket", "a", "b", "linked", (F.col("at") < F.col("firsts")).alias("first"))
    counted = rows.groupBy("bucket").agg(
        F.count("*").alias("texts"), F.count_if("first").alias("n"), F.count_if(~F.col("linked")).alias("apart")
    )
    rows = rows.join(unsent(counted.where("texts > 1 AND n > 0 AND apart > 0").select("bucket", "n")), "bucket")
    rows = stored(rows, "meeting")
    some = profiles.join(unsent(rows.select("a", "b").distinct()), ["a", "b"], "left_semi")
    rows = rows.join(unsent(stored(_marked(some), "marks")), ["a", "b"])
    return stored(rows.withColumnRenamed("b", "key").drop("a"), "differing")


def _can_be_similar() -> Column:
    """Whether two profiles, `y` and `x`, leave it open that the texts are similar."""
    unlike, sizes = F.col("y.unlike") + F.col("x.unlike"), F.col("y.size") + F.col("x.size")
    alone = lambda p, q: sum((F.bit_count(F.col(f"{p}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.m{k}")))) for k in range(_MARKS)), F.lit(0))
    shared = F.least(F.col("y.unlike") - alone("y", "x"), F.col("x.unlike") - alone("x", "y"))
    return _NINE * (unlike - 2 * shared) <= sizes


def _joined(buckets: DataFrame, groups: DataFrame, texts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """`groups` after all pairs of a bucket's first texts and its texts that are not linked were
    compared, unless they came to be of one group meanwhile.

    A hash draws the first texts, one a bucket and then sixteen times as many in every round, so that
    a large bucket of texts that are similar costs what it has members. Pairs whose marks rule them
    out are not written.
    """
    most, low, high = buckets.agg(F.max("n")).first()[0] or 0, 0, 1
    while low < most:
        placed = stored(_rooted(buckets.where(f"n > {low}"), groups, "key", "root"), "placed")
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) * F.col("n") / (1 << 30)
        drawn = placed.where(F.col("first") & (draw >= low) & (draw < high)).alias("y")
        apart = placed.where("NOT linked").alias("x")
        on = (F.col("y.bucket") == F.col("x.bucket")) & (F.col("y.root") != F.col("x.root")) & _can_be_similar()
        across = drawn.join(unsent(apart), on).select(*_unordered(F.col("x.key"), F.col("y.key"))).distinct()
        more = _rooted(_rooted(_verified(across, texts, rows, width), groups, "a", "g"), groups, "b", "h")
        more = stored(more.select(*_unordered(F.col("g"), F.col("h"))).where("a <> b").distinct(), "joining")
        if not more.isEmpty():
            new = _grouped(components(more))
            # Groups of more than one text move as their roots do; texts that were alone come in.
            moved = _rooted(groups, new, "root", "to").select("key", F.col("to").alias("root"))
            groups = stored(moved.unionByName(new.join(groups, "key", "left_anti")), "similar-groups")
        low, high = high, 16 * high
    return groups
