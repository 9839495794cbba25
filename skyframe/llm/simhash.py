"""Near-duplicates by SimHash, with links found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.components import components
from skyframe.llm.tables import scratch, stored, unsent
from skyframe.llm.words import words_of

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
BITS = 64
# Fingerprints that may share one value of a segment before it is cut a second time.
CROWDED = 2_000
# Shingles whose bits are counted at once.
_AT_ONCE = 1 << 16


def _fingerprint(text: bytes | None, width: int) -> int:
    words = words_of([text])
    n = len(words.starts)
    if not n:
        return 0
    width = min(width, n)
    if words.ends[-1] - words.starts[0] == (words.ends - words.starts).sum() + n - 1 and (
        words.data.count(b" ", words.starts[0], words.ends[-1]) == n - 1
    ):
        data, starts, ends = words.data, words.starts, words.ends
    else:
        pieces = words.data.split()
        data = b" ".join(pieces)
        ends = np.cumsum(words.ends - words.starts + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    begins, stops = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, total = np.zeros(BITS, np.int64), len(begins)
    for at in range(0, total, _AT_ONCE):
        hashes = [digest(data[s:e], SEED) for s, e in zip(begins[at : at + _AT_ONCE], stops[at : at + _AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8)).view(">u8")[0])


def with_fingerprint(documents: DataFrame, text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """Of every row: a struct `row` of its columns but the text, and `fp`, the SimHash as a signed
    bigint. A null text, or one without words, has fingerprint zero."""
    columns = [F.col(f"`{name}`") for name in documents.columns if name != text]
    source = documents.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (value.as_py() for value in batch.column(1))
            prints = np.fromiter((_fingerprint(text, width) for text in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["row", "fp"])

    schema = source.select("row", F.lit(0).cast("bigint").alias("fp")).schema
    return source.mapInArrow(run, schema)


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs by at most one bit.

    If each of m segments differed by two bits or more, all would differ by 2 m; so m is the least
    with 2 m over the distance, and two at least.
    """
    m = max(2, distance // 2 + 1)
    cuts = [BITS * k // m for k in range(m + 1)]
    return list(zip(cuts[:-1], (b - a for a, b in zip(cuts[:-1], cuts[1:]))))


def _variants(fp: Column, parts: list[tuple[int, int]]) -> Column:
    """One entry for each bit of each segment: the segment with that bit blotted out.

    `key` holds segment, bit and what is left; `bit` is the bit itself and `lead` whether it is its
    segment's first. Two segments that differ in bit i alone meet under i with unlike `bit`. Equal
    ones would meet under every bit, and are taken under the first alone.
    """
    entries = []
    for number, (begin, width) in enumerate(parts):
        value = F.shiftrightunsigned(fp, begin).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        entries += [
            F.struct(
                value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)).cast("bigint"))
                .bitwiseOR(F.lit((number * BITS + i) << 48).cast("bigint"))
                .alias("key"),
                F.shiftright(value, i).bitwiseAND(F.lit(1).cast("bigint")).cast("tinyint").alias("bit"),
                F.lit(i == 0).alias("lead"),
            )
            for i in range(width)
        ]
    return F.array(*entries)


def _met(a: str, b: str, distance: int) -> Column:
    unlike = F.col(f"{a}.bit") != F.col(f"{b}.bit")
    close = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance
    apart = F.col(f"{a}.root") != F.col(f"{b}.root")
    return (F.col(f"{a}.fp") < F.col(f"{b}.fp")) & (unlike | F.col(f"{a}.lead")) & close & apart


def star_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): of every segment's value the least of the distinct fingerprints `fp` that have it,
    with each other one that is close to it. One link a fingerprint and segment at most."""
    values = [
        F.shiftrightunsigned("fp", begin).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).bitwiseOR(F.lit(number << 48).cast("bigint"))
        for number, (begin, width) in enumerate(segments(distance))
    ]
    entries = prints.select("fp", F.explode(F.array(*values)).alias("value"))
    least = entries.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance
    return entries.join(unsent(least), "value").where((F.col("a") < F.col("fp")) & close).select("a", F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: every two of the distinct fingerprints `fp` that differ by `distance` bits or
    fewer, once or a few times. If there is a `root`, only those with unlike ones.

    An equality join over the one-wildcard variants, verified by the whole distance. Fingerprints
    that share a segment's value with more than `crowded` others are cut a second time: the bits
    outside that segment differ by no more than the distance either, so one of as many segments of
    those differs by at most one bit, and both keys have to be equal. No bucket is capped.
    """
    parts = segments(distance)
    prints = prints if "root" in prints.columns else prints.withColumn("root", F.col("fp"))
    keyed = prints.select("fp", "root", F.explode(_variants(F.col("fp"), parts)).alias("v")).select("fp", "root", "v.*")
    sizes = [
        prints.groupBy(F.shiftrightunsigned("fp", begin).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).alias("value"))
        .count()
        .where(F.col("count") > crowded)
        .select(F.lit(number).alias("number"), "value")
        for number, (begin, width) in enumerate(parts)
    ]
    hot = sizes[0]
    for more in sizes[1:]:
        hot = hot.unionByName(more)
    found = keyed.alias("a").join(unsent(keyed.alias("b")), (F.col("a.key") == F.col("b.key")) & _met("a", "b", distance))
    if hot.isEmpty():
        return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    # The wildcard keys that hold a crowded value, with the bit set or not.
    hot = stored(hot, "crowded-segments")
    keys = None
    for number, (_, width) in enumerate(parts):
        bits = F.array(
            *[
                F.col("value").bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)).cast("bigint"))
                .bitwiseOR(F.lit((number * BITS + i) << 48).cast("bigint"))
                for i in range(width)
            ]
        )
        some = hot.where(F.col("number") == number).select(F.explode(bits).alias("key"))
        keys = some if keys is None else keys.unionByName(some)
    keys = stored(keys.distinct(), "crowded-keys")
    cold = keyed.join(keys, "key", "left_anti")
    found = cold.alias("a").join(unsent(cold.alias("b")), (F.col("a.key") == F.col("b.key")) & _met("a", "b", distance))
    found = found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    crowd = keyed.join(keys, "key", "left_semi")
    for number, (begin, width) in enumerate(parts):
        # The bits outside the segment, moved together, and cut again.
        low = F.col("fp").bitwiseAND(F.lit((1 << begin) - 1).cast("bigint"))
        rest = F.shiftleft(F.shiftrightunsigned("fp", begin + width), begin).bitwiseOR(low) if begin + width < BITS else low
        m, left = len(parts), BITS - width
        cuts = [left * k // m for k in range(m + 1)]
        again = list(zip(cuts[:-1], (q - p for p, q in zip(cuts[:-1], cuts[1:]))))
        own = crowd.where(F.shiftrightunsigned("key", 48).between(number * BITS, number * BITS + BITS - 1))
        twice = own.withColumn("w", F.explode(_variants(rest, again))).select(
            "fp", "root", "key", "bit", "lead", F.col("w.key").alias("key2"), F.col("w.bit").alias("bit2"), F.col("w.lead").alias("lead2")
        )
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.key2") == F.col("b.key2")) & _met("a", "b", distance)
        on = on & ((F.col("a.bit2") != F.col("b.bit2")) | F.col("a.lead2"))
        more = twice.alias("a").join(unsent(twice.alias("b")), on)
        found = found.unionByName(more.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    return found


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per row of `documents`: a struct `row` of its columns but the text, `fp`, and
    `component_id`, the smallest id of those that links reach, itself included.

    Links join fingerprints that differ by `distance` bits or fewer. Copies of a text have one
    fingerprint, which is joined once however many they are; only distinct fingerprints are linked
    and grouped. A null id never names a group unless all ids of it are null, and then the group's
    id is null. Null and empty texts have fingerprint zero, and are linked like any other. An
    empty table gives an empty one.
    """
    with scratch():
        marked = stored(with_fingerprint(documents, text, width), "fingerprints", keep=True)
        least = F.min(F.col("row").getField(doc_id)).alias("least")
        prints = stored(marked.groupBy("fp").agg(least), "prints")
        # Links to the least of a segment's value first, which leave a dense set in one group; then only
        # those between groups.
        groups = stored(components(stored(star_links(prints.select("fp"), distance), "star-links")), "star-groups")
        rooted = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
        rooted = stored(rooted, "rooted")
        across = links(rooted, distance)
        for end in ("a", "b"):
            own = rooted.select(F.col("fp").alias(end), F.col("root").alias(f"{end}_root"))
            across = across.join(own, end)
        across = stored(across.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if not across.isEmpty():
            joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("to"))
            groups = rooted.join(joined, "root", "left").select(F.col("fp").alias("node"), F.coalesce("to", "root").alias("root"))
        # Of each group of fingerprints, the smallest id; fingerprints without a link are their own.
        member = prints.join(groups, prints["fp"] == groups["node"], "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
        named = member.groupBy("root").agg(F.min("least").alias("component_id"))
        labels = stored(member.join(named, "root").select("fp", "component_id"), "labels", keep=True)
    return marked.join(labels, "fp").select("row", "fp", "component_id")
