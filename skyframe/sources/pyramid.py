"""Summaries of a catalog by cell, at every order from the whole base faces down, stored beside it.

A region's summary is put together from the cells that lie inside it, as large as they come, and
from the rows of what is left along its boundary. So the rows read grow with the boundary and not
with the area. What is kept of a cell can be united with another's: counts, sums, extremes, and
sketches of distinct values (HyperLogLog) and of quantiles (KLL).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.healpix import MAX_ORDER, shift_right
from skyframe.operators.coverage import on_index_order, ranges_of
from skyframe.operators.regions import Moc, merged
from skyframe.sources.catalog import Catalog
from skyframe.sources.files import shared_folder

# Bits of a distinct count's sketch: its relative standard error is 1.04 / sqrt(2 ** bits).
HLL_BITS = 12
# A quantile sketch's size: its ranks are within about 0.9 % with 99 % confidence.
KLL_SIZE = 400
# Orders below the deepest partition's that the finest cells are at.
FINER = 3
# Ranges of cells inside a region, and of those around it.
RANGES = 64


@dataclass(frozen=True)
class Measures:
    """What is summed up: columns by name, the groups first."""

    by: list[str] = field(default_factory=list)
    sums: list[str] = field(default_factory=list)
    extremes: list[str] = field(default_factory=list)
    distinct: list[str] = field(default_factory=list)
    quantiles: list[str] = field(default_factory=list)

    def of_rows(self) -> list[Column]:
        found = [F.count(F.lit(1)).alias("n")]
        for name in self.sums:
            value = F.col(f"`{name}`").cast("double")
            found += [F.sum(value).alias(f"sum_{name}"), F.count(value).alias(f"n_{name}")]
        for name in self.extremes:
            found += [F.min(f"`{name}`").alias(f"min_{name}"), F.max(f"`{name}`").alias(f"max_{name}")]
        found += [F.hll_sketch_agg(F.col(f"`{name}`"), HLL_BITS).alias(f"hll_{name}") for name in self.distinct]
        found += [F.kll_sketch_agg_double(F.col(f"`{name}`").cast("double"), KLL_SIZE).alias(f"kll_{name}") for name in self.quantiles]
        return found

    def united(self) -> list[Column]:
        """The same of summaries."""
        found = [F.sum("n").alias("n")]
        for name in self.sums:
            found += [F.sum(f"`{part}_{name}`").alias(f"{part}_{name}") for part in ("sum", "n")]
        for name in self.extremes:
            found += [F.min(f"`min_{name}`").alias(f"min_{name}"), F.max(f"`max_{name}`").alias(f"max_{name}")]
        found += [F.hll_union_agg(F.col(f"`hll_{name}`")).alias(f"hll_{name}") for name in self.distinct]
        found += [F.kll_merge_agg_double(F.col(f"`kll_{name}`"), KLL_SIZE).alias(f"kll_{name}") for name in self.quantiles]
        return found


@dataclass(frozen=True)
class Pyramid:
    """`order`, `cell`, the groups and what was measured, one row for each that has rows."""

    catalog: Catalog
    root: str
    finest: int
    measures: Measures

    def read(self, order: int) -> DataFrame:
        return self.catalog.spark.read.parquet(f"{self.root}/order={order}")

    def parts(self, regions) -> tuple[dict[int, list[tuple[int, int]]], list[tuple[int, int]]]:
        """A region as half-open ranges of whole cells inside it by order, and closed ranges of the
        catalog's index that hold all the rest of it."""
        inner, outer = ranges_of(self.catalog.spark, regions, self.finest, RANGES)
        shift = 2 * (MAX_ORDER - self.finest)
        whole = [(low << shift, high << shift) for low, high in on_index_order(inner, self.finest, outward=False)]
        by_order: dict[int, list[tuple[int, int]]] = {}
        for order, cell in Moc(tuple(whole)).cells() if whole else []:
            by_order.setdefault(order, []).append((cell, cell + 1))
        edge = []
        for low, high in outer:
            for a, b in sorted(whole):
                if b <= low or a >= high:
                    continue
                if low < a:
                    edge.append((low, a))
                low = b
            if low < high:
                edge.append((low, high))
        _, order = self.catalog.healpix
        down = 2 * (MAX_ORDER - order)
        closed = [(low >> down, (high - 1) >> down) for low, high in edge]
        return {order: merged(cells) for order, cells in by_order.items()}, closed

    def pieces(self, regions=None) -> tuple[DataFrame | None, DataFrame | None]:
        """The stored summaries of a region's inside, and the rows of its edge."""
        if regions is None:
            return self.read(0), None
        listed = regions if isinstance(regions, (list, tuple)) else [regions]
        inside, edge = self.parts(list(listed))
        stored = None
        for order, cells in sorted(inside.items()):
            own = self.read(order).where(" OR ".join(f"cell BETWEEN {low}L AND {high - 1}L" for low, high in cells))
            stored = own if stored is None else stored.unionByName(own)
        return stored, self.catalog.select(regions, cells=edge) if edge else None

    def summary(self, regions=None, by: list[str] | None = None) -> DataFrame:
        """What was measured, united over a region (or everything) and groups: `by` are some of the
        stored groups, all if not given. A group without a row in the region is not there."""
        groups = self.measures.by if by is None else by
        stored, rows = self.pieces(regions)
        names = [F.col(f"`{name}`") for name in groups]
        parts = []
        if stored is not None:
            parts.append(stored.groupBy(*names).agg(*self.measures.united()))
        if rows is not None:
            parts.append(rows.groupBy(*names).agg(*self.measures.of_rows()))
        if not parts:
            parts = [self.read(0).limit(0).groupBy(*names).agg(*self.measures.united())]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        found = both.groupBy(*names).agg(*self.measures.united())
        return found.where("n > 0")


def distinct_count(name: str) -> Column:
    """About how many distinct values of a column a summary has seen, within about 5 %."""
    return F.hll_sketch_estimate(F.col(f"`hll_{name}`"))


def quantile(name: str, share: float) -> Column:
    """A value with about that share of the column's values at or below it; null without any."""
    sketch = F.col(f"`kll_{name}`")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def build_pyramid(catalog: Catalog, measures: Measures, root: str | None = None, finest: int | None = None) -> Pyramid:
    """Summaries of a catalog, written to `root`, or to the shared folder.

    The finest cells are summed up from the rows, once, and every order above from the one below, so
    a row is read once. Rows without a cell are in no region and in no summary. Each order is a
    table sorted by cell, so that a range of cells reads few row groups.
    """
    if catalog.healpix is None:
        raise ValueError("summaries by cell need a cell column")
    column, order = catalog.healpix
    finest = min(order, catalog.deepest + FINER) if finest is None else finest
    if not 0 <= finest <= order:
        raise ValueError(f"cells of order {finest} are finer than the catalog's index")
    root = root or shared_folder(catalog.spark, "pyramid")
    cell = shift_right(F.col(f"`{column}`").cast("bigint"), 2 * (order - finest)).alias("cell")
    names = [F.col(f"`{name}`") for name in measures.by]
    rows = catalog.read().where(F.col(f"`{column}`").isNotNull())
    level = rows.groupBy(cell, *names).agg(*measures.of_rows())
    for at in range(finest, -1, -1):
        path = f"{root}/order={at}"
        level.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(path)
        level = catalog.spark.read.parquet(path)
        level = level.groupBy(shift_right(F.col("cell"), 2).alias("cell"), *names).agg(*measures.united())
    return Pyramid(catalog, root, finest, measures)
