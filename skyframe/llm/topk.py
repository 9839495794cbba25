"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, in blocks. A first pass finds the range of each query's
scores. Then histograms over that range, summed over all blocks, tell in which bin the k-th highest
score lies, and that bin is cut again until it is one score wide. The last pass keeps what reaches
that score and settles ties by id.

A block sends only its highest bins, as far down as they hold k scores: the k-th highest of a block
is never above the k-th highest of all, so what lies below it cannot matter. No pass moves more
than k rows a query and block, and no query's scores are ever together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.tables import stored

# Vectors in a block, and queries in a block.
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024
BINS = 1024
# Integers up to this are exact as doubles, and so are sums of them.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): every vector with finite components only, as floor(scale * component).

    What would not fit a long is set to the nearest that does.
    """
    value = F.col(f"`{vector}`")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(value, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return vectors.where(value.isNotNull() & finite).select(F.col(f"`{vec_id}`").alias("id"), whole.cast("array<bigint>").alias("v"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as longs. Doubles where they are exact; else whole numbers of any size,
    set to the nearest long."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    largest = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(vectors.astype(np.float64)).max())
    if largest * queries.shape[1] < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def _scored(queries: pa.Table, vectors: pa.Table):
    """The scores of a block, and which of them are a row with itself."""
    scores = _products(_matrix(queries.column("v"), queries.num_rows), _matrix(vectors.column("v"), vectors.num_rows))
    own = queries.column("row").to_numpy()[:, None] == vectors.column("row").to_numpy()[None, :]
    return scores, own


def _table(columns: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _ranges(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
    names = ["row", "low", "high"]
    if not queries.num_rows or not vectors.num_rows:
        return _table([[], [], []], names)
    scores, own = _scored(queries, vectors)
    low = np.where(own, _LONG, scores).min(axis=1)
    high = np.where(own, -_LONG, scores).max(axis=1)
    some = (~own).any(axis=1)
    return _table([queries.column("row").to_numpy()[some], low[some], high[some]], names)


def _bins(k: int):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["row", "bin", "n"]
        if not queries.num_rows or not vectors.num_rows:
            return _table([[], [], []], names)
        scores, own = _scored(queries, vectors)
        low, width, bins = (queries.column(name).to_numpy() for name in ("low", "width", "bins"))
        out = []
        for at, row in enumerate(queries.column("row").to_numpy()):
            s = scores[at][~own[at]]
            s = s[s >= low[at]]
            # Above the range is what earlier passes have counted.
            b = ((s - low[at]).astype(np.uint64) // np.uint64(width[at])).astype(np.int64)
            found, n = np.unique(b[b < bins[at]], return_counts=True)
            top = np.cumsum(n[::-1])[::-1] - n < k
            out.append((np.full(int(top.sum()), row), found[top], n[top]))
        return _table([np.concatenate(c) for c in zip(*out)], names)

    return run


def _highest(k: int):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["row", "vec_id", "vec_row", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return _table([[], [], [], []], names)
        scores, own = _scored(queries, vectors)
        ids, rows = vectors.column("id").to_numpy(), vectors.column("row").to_numpy()
        low, out = queries.column("low").to_numpy(), []
        for at, row in enumerate(queries.column("row").to_numpy()):
            which = np.flatnonzero((scores[at] >= low[at]) & ~own[at])
            best = which[np.lexsort((rows[which], ids[which], -scores[at][which]))[:k]]
            out.append((np.full(len(best), row), ids[best], rows[best], scores[at][best]))
        return _table([np.concatenate(c) for c in zip(*out)], names)

    return run


def top_k(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` highest inner products of every query with every
    row but itself, from rank 1; all if there are fewer.

    Components become floor(scale * x) and products are whole numbers, so scores are exact. Ties go
    to the smaller id, and between rows of one id to either. `is_query` makes a condition of the id.
    Vectors that are null or hold a null, a NaN or an infinity take no part, nor do rows without an
    id; vectors of different lengths do not meet. A repeated row is a row of its own: it finds its
    copies, and each copy that is a query is answered. An empty table gives an empty one.
    """
    # A row is told apart by its place in the stored table.
    rows = quantised(vectors.where(F.col(f"`{vec_id}`").isNotNull()), vec_id, vector, scale)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "vectors")
    questions = stored(rows.where(is_query(F.col("id"))), "queries")

    slots = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    parts = max(1, math.ceil(questions.count() / BLOCK_QUERIES))
    blocks = rows.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )

    def against_all(asked: DataFrame):
        each = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn(
            "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
        )
        keys = ["slot", "part", "size"]
        return each.groupBy(*keys).cogroup(blocks.groupBy(*keys))

    ranges = against_all(questions).applyInArrow(_ranges, "row bigint, low bigint, high bigint")
    ranges = ranges.groupBy("row").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # The width that cuts the widest range into BINS, a power of BINS, so all queries end together.
    span = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1
    ranges = stored(ranges.withColumn("span", span).withColumn("need", F.lit(k).cast("bigint")), "score-ranges")
    widest = int(ranges.agg(F.max("span")).first()[0] or 1)
    width = 1
    while width * BINS < widest:
        width *= BINS
    state, bins = ranges.select("row", "low", "need"), BINS
    while True:
        asked = questions.join(state, "row").withColumns(
            {"width": F.lit(width).cast("bigint"), "bins": F.lit(bins).cast("bigint")}
        )
        counted = against_all(asked).applyInArrow(_bins(k), "row bigint, bin bigint, n bigint")
        counted = counted.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")))
        # The highest bin at which enough are counted; with fewer than k in all, the lowest one.
        counted = counted.withColumn("upto", upto).join(state, "row")
        chosen = counted.groupBy("row").agg(
            F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "n"))).alias("enough"),
            F.min(F.struct("bin", "upto", "n")).alias("last"),
            F.first("low").alias("low"),
            F.first("need").alias("need"),
        )
        picked = F.coalesce("enough", "last")
        new = chosen.select(
            "row",
            (F.col("low") + picked.getField("bin") * width).alias("low"),
            (F.col("need") - (picked.getField("upto") - picked.getField("n"))).alias("need"),
        )
        state = stored(new, "score-bins")
        if width == 1:
            break
        width //= BINS
    asked = questions.join(state, "row")
    kept = against_all(asked).applyInArrow(_highest(k), "row bigint, vec_id bigint, vec_row bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = questions.select("row", F.col("id").alias("query_id"))
    return ranked.join(names, "row").select("query_id", "rank", "vec_id", "score")
