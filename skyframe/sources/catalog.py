"""HEALPix-partitioned catalogs: opening one, choosing its partitions, and reading them.

The partition table is metadata, one small row per partition file, as Spark's own file listing
is. Choosing partitions is a job over that table; what comes back to the driver is the list of
paths to read, which a scan needs there in any case.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.geometry import PAD, distance, quoted
from skyframe.functions.healpix import (
    CELL_RADIUS,
    DEFAULT_INDEX,
    MAX_ORDER,
    cell_count,
    cell_radius,
    shift_left,
    shift_right,
)
from skyframe.operators.coverage import BOUNDARY, INSIDE, OUTSIDE, cap_steps, closed_up, shape_cover
from skyframe.operators.crossmatch import where_any_circle
from skyframe.operators.projection import select_columns, where_text
from skyframe.operators.region_filter import COVERED_SHAPES, region_column, where_region
from skyframe.operators.regions import Circle, Moc, merged, shapes
from skyframe.operators.sets import among
from skyframe.operators.skew import broadcast_if_small, small
from skyframe.sources import index as indexes
from skyframe.sources import partitions as tables
from skyframe.sources.files import kept

# Orders below a partition's own at which it is classified.
DETAIL = 2
# Ranges of cells in front of the rows of all the partitions on a region's boundary together.
RANGES = 48
# Past this many partitions a scan is given the dataset's root, and rows are joined with the chosen
# cells; the region's ranges still skip files by their statistics.
LISTED_PATHS = 20_000
# Rows of the partition table that come to the driver at a time where they are read in order.
PLANNED_AT_ONCE = 512
# A position in floats may lie that many degrees outside of its cell.
FLOAT_SLACK = 1e-4
# Cell values an identifier lookup may turn into an IN list; more are ranges around them.
LISTED_CELLS = 1_000
_PROPERTIES = ("hats.properties", "properties")
# Closed ranges of index values, as numbers.
Ranges = list[tuple[int, int]]


def _read_properties(spark: SparkSession, paths: list[str]) -> dict[str, str] | None:
    """key=value lines of the first of the files that is there."""
    for path in paths:
        try:
            lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#!]|$)")).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        pairs = (line.value.partition("=") for line in lines)
        return {key.strip(): value.strip() for key, _, value in pairs if value.strip()}
    return None


def _inside(named: str, key: str) -> str:
    if "://" in named or named.startswith(("/", "\\")) or any(p in ("..", "") for p in named.rstrip("/").split("/")):
        raise ValueError(f"{key} may only lead to a folder inside the collection, not to {named}")
    return named.rstrip("/")


@dataclass(frozen=True)
class _Wanted:
    """Identifiers that a selection asks for, and what their index says of them if there is one."""

    values: list | DataFrame
    entries: DataFrame | None
    # Whether a table of values has been measured to be small enough to hand out.
    few: bool = False


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    root: str
    properties: dict[str, str]
    partitions: DataFrame
    schema: T.StructType
    indexes: dict[str, str] = field(default_factory=dict)
    deepest: int = 0
    # How many partitions are handed over as a list of paths, if not LISTED_PATHS.
    listed_paths: int | None = None

    # ---- what the properties say ----

    @property
    def position(self) -> tuple[str, str] | None:
        ra, dec = self.properties.get("hats_col_ra"), self.properties.get("hats_col_dec")
        return (ra, dec) if ra and dec else None

    @property
    def healpix(self) -> tuple[str, int] | None:
        """The cell column and its order: as named, or the recommended one where it is there."""
        column = self.properties.get("hats_col_healpix", DEFAULT_INDEX)
        order = int(self.properties.get("hats_col_healpix_order", MAX_ORDER))
        if column in self.schema.names:
            return column, order
        if "hats_col_healpix" in self.properties:
            raise ValueError(f"this catalog names the cell column {column} and has no such column")
        return None

    @property
    def suffix(self) -> str:
        return self.properties.get("hats_npix_suffix", ".parquet")

    # ---- choosing partitions ----

    def plan(self, regions=None, identifiers: dict | None = None, cells: Ranges | None = None) -> DataFrame:
        """The partitions a selection reads, in catalog order, and whether their rows still need
        the region's test: the partition table with `cover` and `needs_test`. No row is read."""
        return self._plan(regions, self._listed(identifiers), cells)

    def _listed(self, identifiers: dict | None) -> dict:
        """The identifiers with their values as lists where they are few."""
        found = {}
        for column, wanted in (identifiers or {}).items():
            values = indexes.listed(self.spark, wanted, self.schema[column].dataType, column)
            few = isinstance(values, DataFrame) and small(values)
            entries = self._entries(column, values, few) if column in self.indexes else None
            found[column] = _Wanted(values, entries, few)
        return found

    def _plan(self, regions, identifiers: dict, cells: Ranges | None = None) -> DataFrame:
        chosen = self._covered(regions)
        if cells is not None:
            chosen = chosen.where(self._reaching(cells))
        for wanted in identifiers.values():
            if wanted.entries is not None:
                chosen = chosen.join(indexes.partitions_of(wanted.entries), ["Norder", "Npix"], "left_semi")
        return chosen.withColumn("needs_test", F.col("cover") == BOUNDARY).orderBy("lo", "Norder")

    def _reaching(self, cells: Ranges) -> str:
        """Whether a partition can hold a cell of some closed ranges of the catalog's own index."""
        _, order = self.healpix or (None, MAX_ORDER)
        shift, top = 2 * (MAX_ORDER - order), cell_count(order) - 1
        spans = [(max(0, low), min(top, high)) for low, high in cells]
        spans = closed_up(merged([(low << shift, (high + 1) << shift) for low, high in spans if low <= high]), RANGES)
        return " OR ".join(f"(lo < {high}L AND hi > {low}L)" for low, high in spans) or "false"

    def estimate(self, regions=None, identifiers: dict | None = None) -> DataFrame:
        """What a selection would read, in one row. A total of rows or bytes is given only where
        every partition's is known."""
        plan = self.plan(regions, identifiers)
        totals = [
            F.when(F.count(name) == F.count("*"), F.coalesce(F.sum(name), F.lit(0))).alias(name)
            for name in ("rows", "bytes")
        ]
        return plan.agg(F.count("*").alias("partitions"), F.count_if("needs_test").alias("tested"), *totals)

    def _covered(self, regions) -> DataFrame:
        if regions is None:
            return self.partitions.select(*_PARTITION, F.lit(INSIDE).alias("cover"))
        listed = shapes(regions)
        drawn = [shape for shape in listed if not isinstance(shape, Moc)]
        spans = merged([span for shape in listed if isinstance(shape, Moc) for span in shape.ranges])
        chosen = self.partitions.select("*", F.lit(OUTSIDE).alias("cover"))
        if len(drawn) > COVERED_SHAPES:
            circles = [shape for shape in drawn if isinstance(shape, Circle)]
            drawn = [shape for shape in drawn if not isinstance(shape, Circle)]
            rows = [(shape.ra, shape.dec, shape.radius) for shape in circles]
            chosen = _circles_cover(chosen, self.spark.createDataFrame(rows, "ra double, dec double, radius double"))
        if drawn:
            chosen = _drawn_cover(chosen, drawn)
        if spans:
            chosen = _moc_cover(chosen, Moc(tuple(spans)))
        return chosen.where(F.col("cover") != OUTSIDE).select(*_PARTITION, "cover")

    def within_index_range(self, low: int, high: int) -> DataFrame:
        """The partitions that hold any index value of `low..high`, for a range written by hand."""
        return self.partitions.where(self._reaching([(low, high)])).select(*_PARTITION).orderBy("lo")

    def _entries(self, column: str, values, few: bool = False) -> DataFrame:
        root = self.indexes[column]
        index = indexes.read_index(self.spark, root, column)
        if not isinstance(values, DataFrame):
            files = indexes.files_with(self.spark, root, column, values, index.schema[column].dataType)
            if files is not None:
                index = self.spark.read.schema(index.schema).parquet(*files) if files else index.limit(0)
        return indexes.entries(index, column, values, few)

    # ---- reading ----

    def read(self, chosen: DataFrame | None = None) -> DataFrame:
        """All rows of the chosen partitions, or of the whole catalog, under its one schema."""
        if chosen is None:
            return self._scan(None)
        found = chosen.select("path").limit(self._most_paths() + 1).collect()
        return self._scan([row.path for row in found]) if len(found) <= self._most_paths() else self._of(chosen)

    def _most_paths(self) -> int:
        return LISTED_PATHS if self.listed_paths is None else self.listed_paths

    def _of(self, chosen: DataFrame, located: bool = False) -> DataFrame:
        """The rows of chosen partitions that are too many to list: of all files, those that a
        partition of the table is written in, by the cell that the file's name says."""
        rows = self._scan(None, located=True)
        order, pixel = (F.regexp_extract(F.col("__path"), tables.PATH_CELL, k) for k in (1, 2))
        rows = rows.withColumns({"__order": order.try_cast("int"), "__pixel": pixel.try_cast("bigint")})
        cells = chosen.select(F.col("Norder").alias("__order"), F.col("Npix").alias("__pixel"))
        rows = rows.join(broadcast_if_small(cells), ["__order", "__pixel"], "left_semi").drop("__order", "__pixel")
        return rows if located else rows.drop(*_LOCATION)

    def _scan(self, paths: list[str] | None, located: bool = False) -> DataFrame:
        """The catalog's columns out of the given partitions, or all of them; `located` adds
        where each row was written."""
        names = [F.col(f"`{name}`") for name in self.schema.names]
        if located:
            names += [F.col(f"_metadata.{field}").alias(name) for name, field in _LOCATION.items()]
        dataset = f"{self.root}/dataset"
        reader = self.spark.read.schema(self.schema).option("basePath", dataset)
        df = reader.parquet(*(paths or [dataset])).select(*names)
        return df.limit(0) if paths is not None and not paths else df

    def select(self, regions=None, where: str | Column | None = None, columns: list[str] | None = None,
               identifiers: dict | None = None, cells: Ranges | None = None) -> DataFrame:
        """Rows by region, identifier, closed ranges of the catalog's index, and predicate; then columns.

        Partitions wholly inside the region are read without its test. Identifiers narrow by the
        catalog's indexes where it has them, and are exact with or without. What a predicate says of
        cells or identifiers chooses no partitions: say it in `cells` and `identifiers`.
        """
        return self._shaped(self._rows(regions, where, identifiers, cells), columns)

    def select_circles(
        self, circles: DataFrame, where: str | Column | None = None, columns: list[str] | None = None
    ) -> DataFrame:
        """Rows in any circle of a table of `ra`, `dec`, `radius`, each row once: a list of sources
        of any length, of which the partitions it reaches are read."""
        if self.position is None:
            raise ValueError("this catalog does not name its position columns")
        circles = circles.select(*[F.col(name).cast("double").alias(name) for name in ("ra", "dec", "radius")])
        cells = _circles_cover(self.partitions.select("*", F.lit(OUTSIDE).alias("cover")), circles)
        rows = where_any_circle(self.read(cells.where(F.col("cover") != OUTSIDE)), circles, position=self.position)
        if where is not None:
            rows = where_text(rows, where) if isinstance(where, str) else rows.where(where)
        return self._shaped(rows, columns)

    def _shaped(self, df: DataFrame, columns: list[str] | None) -> DataFrame:
        df = df.select(*[F.col(f"`{name}`") for name in self.schema.names])
        return df if columns is None else select_columns(df, columns)

    def _rows(self, regions, where, identifiers, cells: Ranges | None = None) -> DataFrame:
        identifiers = self._listed(identifiers)
        plan = self._plan(regions, identifiers, cells)
        chosen = plan.select("path", "needs_test").limit(self._most_paths() + 1).collect()
        if len(chosen) > self._most_paths():
            df = self._of(plan.where(~F.col("needs_test")))
            if regions is not None:
                df = df.unionByName(self._in_region(self._of(plan.where("needs_test")), regions))
        else:
            sure = self._scan([row.path for row in chosen if not row.needs_test])
            edge = [row.path for row in chosen if row.needs_test]
            df = sure
            if edge:
                tested = self._in_region(self._scan(edge), regions)
                df = tested if len(edge) == len(chosen) else sure.unionByName(tested)
        if cells is not None:
            df = df.where(self._in_cells(cells))
        for column, wanted in identifiers.items():
            df = self._identified(df, column, wanted)
        if where is not None:
            df = where_text(df, where) if isinstance(where, str) else df.where(where)
        return df

    def _in_cells(self, cells: Ranges) -> str:
        if self.healpix is None:
            raise ValueError("this catalog has no cell column to take ranges of")
        spans = merged([(low, high + 1) for low, high in cells if low <= high])
        return " OR ".join(f"{quoted(self.healpix[0])} BETWEEN {low}L AND {high - 1}L" for low, high in spans) or "false"

    def _in_region(self, df: DataFrame, regions) -> DataFrame:
        ra, dec = self.position or (None, None)
        column, order = self.healpix or (None, None)
        return where_region(
            df, regions, ra, dec, healpix=column, healpix_order=order, floor=self.deepest + DETAIL, budget=RANGES
        )

    def _identified(self, df: DataFrame, column: str, wanted: _Wanted) -> DataFrame:
        """The rows with one of the values, narrowed first by the cells the index gives, which
        prune row groups: each cell of a list's where they are few, else ranges around them."""
        if wanted.entries is not None and self.healpix is not None and self.healpix[0] in wanted.entries.columns:
            name, order = self.healpix
            cells = []
            if not isinstance(wanted.values, DataFrame):
                cells = wanted.entries.select(F.col(name).cast("bigint")).distinct().limit(LISTED_CELLS + 1).collect()
            if not isinstance(wanted.values, DataFrame) and len(cells) <= LISTED_CELLS:
                df = df.where(F.col(name).isin([cell[0] for cell in cells]))
            else:
                spans = indexes.cell_ranges(wanted.entries, name, order, RANGES)
                df = df.where(" OR ".join(f"`{name}` BETWEEN {low}L AND {high - 1}L" for low, high in spans) or "false")
        if isinstance(wanted.values, DataFrame):
            return among(df, column, wanted.values, wanted.few)
        return df.where(F.col(column).isin(wanted.values))

    # ---- front of the catalog, and order by the index ----

    def front(self, n: int, regions=None, where=None, columns: list[str] | None = None) -> DataFrame:
        """The first `n` rows in catalog order: by partition span, then as written in it."""
        if n == 0:
            return self._shaped(self._scan([]), columns)
        # The span start comes from the path, so it does not depend on what the columns say.
        path, row = (F.col(name) for name in _LOCATION)
        order = F.regexp_extract(path, tables.PATH_CELL, 1).cast("int")
        pixel = F.regexp_extract(path, tables.PATH_CELL, 2).cast("bigint")
        start = shift_left(pixel, 2 * (MAX_ORDER - order))
        return self._shaped(self._until_filled(n, regions, where, False, [start, path, row]), columns)

    def ordered_by_index(self, n: int, descending: bool = False, then: list[Column] | None = None,
                         regions=None, where=None, columns: list[str] | None = None) -> DataFrame:
        """`ORDER BY index [DESC], ... LIMIT n`, reading partitions from the end it starts at."""
        if self.healpix is None:
            raise ValueError("this catalog has no cell column to order by")
        key = F.col(self.healpix[0])
        keys = [key.desc() if descending else key.asc(), *(then or [])]
        return self._shaped(self._until_filled(n, regions, where, descending, keys), columns)

    def _until_filled(self, n: int, regions, where, descending: bool, order: list[Column]) -> DataFrame:
        """The first `n` qualifying rows in `order`, which the partitions are in, from one end.

        Batches double, so a catalog of P partitions is asked at most log2(P) times, and what a
        batch still owes, never more than `n` rows, is written to the shared folder: no batch is
        read twice. A limit that no prefix fills ends at every chosen partition, which is the
        answer anyway. Of the partitions those come to the driver that are read, and a few more.
        """
        keys = [F.col(name).desc() if descending else F.col(name).asc() for name in ("lo", "Norder")]
        plan = self._plan(regions, {}).select("path", "needs_test", "lo", "hi", "Norder").orderBy(*keys)
        shift = 2 * (MAX_ORDER - (self.healpix[1] if self.healpix else MAX_ORDER))
        df, held, batch, cells = None, 0, 1, _Listed(plan)
        while held < n and cells.some():
            # A partition boundary inside one cell of a coarser index: both sides belong together.
            due = self._batch(cells.take(batch, lambda one, other: _shares_cell(one, other, shift)), regions, where)
            counted = Observation()
            due = due.orderBy(*order).limit(n - held).observe(counted, F.count(F.lit(1)).alias("n"))
            rows = kept(due, "front")
            held += counted.get["n"]
            df = rows if df is None else df.unionByName(rows)
            batch *= 2
        return self._scan([], located=True) if df is None else df.orderBy(*order)

    def nearest(
        self,
        n: int,
        ra: float,
        dec: float,
        where: str | Column | None = None,
        columns: list[str] | None = None,
        then: list[Column] | None = None,
        separation: str = "separation",
    ) -> tuple[DataFrame, int]:
        """The `n` rows nearest to a point, nearest first, ties by `then`; and how many partitions
        were opened for them.

        Best first: partitions are read in the order of the least separation that a row of theirs
        can have, twice as many each time, until `n` rows are there. Of the rest only those that
        could still hold a nearer row than the last of these are read, together. Rows without a
        position are near nothing.
        """
        if self.position is None:
            raise ValueError("this catalog does not name its position columns")
        centre = Circle(ra, dec, 180.0)
        point = (centre.ra, centre.dec)
        narrow = any(isinstance(self.schema[name].dataType, T.FloatType) for name in self.position)
        reach = cell_radius(F.col("Norder")) + (FLOAT_SLACK if narrow else PAD)
        least = F.greatest(distance(("centre_ra", "centre_dec"), point) - reach, F.lit(0.0))
        plan = self.partitions.select("path", "lo", least.alias("least")).orderBy("least", "lo")
        order = [F.col(separation), *(then or [])]
        found, opened, batch, cells = None, 0, 1, _Listed(plan)

        def best(paths: list[str]) -> DataFrame:
            rows = self._scan(paths)
            if where is not None:
                rows = where_text(rows, where) if isinstance(where, str) else rows.where(where)
            rows = rows.withColumn(separation, distance(self.position, point)).where(f"{separation} <= 180")
            rows = rows if found is None else rows.unionByName(found)
            return rows.orderBy(*order).limit(n)

        last, told = None, {"n": 0}
        while n > 0 and told["n"] < n and cells.some():
            paths = [cell.path for cell in cells.take(batch)]
            counted = Observation()
            seen = [F.count(F.lit(1)).alias("n"), F.max(separation).alias("last")]
            found = kept(best(paths).observe(counted, *seen), "nearest")
            told, opened, batch = counted.get, opened + len(paths), 2 * batch
            last = told["last"]
        if found is None:
            found = best([])
        elif told["n"] >= n:
            nearer = plan.where(F.col("least") <= last).offset(opened).limit(self._most_paths() + 1).collect()
            if len(nearer) > self._most_paths():
                raise ValueError("more partitions than are listed hold rows as near as that; ask for fewer rows")
            if nearer:
                found, opened = best([cell.path for cell in nearer]), opened + len(nearer)
        found = found.orderBy(*order)
        names = self.schema.names if columns is None else columns
        shaped = select_columns(found, [*names, separation]) if columns is not None else found.select(*[F.col(f"`{c}`") for c in names], separation)
        return shaped, opened

    def _batch(self, cells, regions, where) -> DataFrame:
        sure = [cell.path for cell in cells if not cell.needs_test]
        edge = [cell.path for cell in cells if cell.needs_test]
        parts = [self._scan(sure, located=True)] if sure else []
        if edge:
            parts.append(self._in_region(self._scan(edge, located=True), regions))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if where is None:
            return df
        return where_text(df, where) if isinstance(where, str) else df.where(where)

    # ---- the catalog as a table ----

    def create_view(self, name: str) -> None:
        """The whole catalog under a name, for Spark SQL, with the partition that each row is in as
        `Norder` and `Npix`; and the partition table as `name_partitions`.

        Comparisons of the two leave files out when the statement is planned. A join with the
        partition table on both leaves them out when it runs, by what the statement says of the
        spans `lo` and `hi`, as Spark prunes partitions by any other dimension.
        """
        df = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/dataset").parquet(f"{self.root}/dataset")
        path = F.col("_metadata.file_path")
        cell = {"Norder": F.regexp_extract(path, tables.PATH_CELL, 1), "Npix": F.regexp_extract(path, tables.PATH_CELL, 2)}
        added = []
        for column, named in cell.items():
            if column not in self.schema.names:
                # A folder's name is a column of Spark's; a file's is not.
                added.append((F.col(column) if column in df.columns else named).cast("bigint").alias(column))
        df.select(*[F.col(f"`{column}`") for column in self.schema.names], *added).createOrReplaceTempView(name)
        # As files: Spark does not prune by what it has cached.
        kept(self.partitions.select(*_PARTITION), "partitions").createOrReplaceTempView(f"{name}_partitions")

    def sql(
        self, statement: str, name: str = "catalog", regions=None, identifiers: dict | None = None,
        cells: Ranges | None = None, **others: DataFrame,
    ) -> DataFrame:
        """A statement that names this catalog as {catalog}, and other tables by their own names.
        What the catalog is there is what `select` gives for the same arguments."""
        return self.spark.sql(statement, **{name: self.select(regions, None, None, identifiers, cells)}, **others)

    def contains(self, shape) -> Column:
        """The region test for this catalog's own position and cell columns."""
        ra, dec = self.position or (None, None)
        column, order = self.healpix or (None, None)
        return region_column(self._scan(None), shape, ra, dec, healpix=column, healpix_order=order)


# Where a row was written: the column it is carried in, and the metadata field it comes from.
_LOCATION = {"__path": "file_path", "__row": "row_index"}
_PARTITION = ["Norder", "Npix", "lo", "hi", "rows", "bytes", "path"]


class _Listed:
    """The rows of a table of partitions in order, some at a time."""

    def __init__(self, plan: DataFrame):
        self.plan, self.rows, self.at, self.asked, self.whole = plan, [], 0, 0, False

    def _until(self, upto: int) -> None:
        while not self.whole and len(self.rows) < upto:
            size = max(PLANNED_AT_ONCE, upto - len(self.rows))
            more = self.plan.offset(self.asked).limit(size).collect()
            self.rows, self.asked, self.whole = self.rows + more, self.asked + size, len(more) < size

    def some(self) -> bool:
        self._until(self.at + 1)
        return self.at < len(self.rows)

    def take(self, n: int, together=lambda one, other: False) -> list:
        """The next `n`, and those after them that belong with the last."""
        self._until(self.at + n + 1)
        upto = min(len(self.rows), self.at + n)
        while upto < len(self.rows) and together(self.rows[upto - 1], self.rows[upto]):
            upto += 1
            self._until(upto + 1)
        taken, self.at = self.rows[self.at : upto], upto
        return taken


def _shares_cell(one, other, shift: int) -> bool:
    low, high = sorted([one, other], key=lambda cell: cell.lo)
    return shift > 0 and (high.lo >> shift) <= ((low.hi - 1) >> shift)


def _drawn_cover(cells: DataFrame, drawn) -> DataFrame:
    """`cover` raised to how each partition lies to the union of the drawn shapes.

    A partition is looked at as its descendants two orders down: outside if all of them are,
    inside if each lies in some shape whole, and otherwise on the boundary.
    """
    steps = 1 << DETAIL
    digits = "conv(CAST(Npix - shiftleft(shiftright(Npix, 2 * Norder), 2 * Norder) AS STRING), 10, 4)"
    covers = [shape_cover(shape) for shape in drawn]
    best = covers[0] if len(covers) == 1 else f"greatest({', '.join(covers)})"
    carried = ", ".join(cells.columns)
    kept = ", ".join(f"first({name}) AS {name}" for name in cells.columns if name not in ("Norder", "Npix", "cover"))
    # Partitions are told apart by their cell, and are as few as there are files.
    return cells.sparkSession.sql(
        f"""WITH whole AS (
            SELECT *, shiftright(Npix, 2 * Norder) AS face, shiftleft({steps}L, Norder) AS side,
                CAST(conv(translate({digits}, '0123', '0101'), 2, 10) AS BIGINT) * {steps} AS east0,
                CAST(conv(translate({digits}, '0123', '0011'), 2, 10) AS BIGINT) * {steps} AS west0,
                explode(sequence(0, {steps * steps - 1})) AS child
            FROM {{cells}}),
        parts AS (SELECT *, east0 + child % {steps} AS east, west0 + child div {steps} AS west FROM whole),
        {cap_steps('parts', carried, 'caps')},
        marks AS (SELECT {carried}, greatest(cover, {best}) AS here FROM caps),
        judged AS (
            SELECT Norder, Npix, {kept}, max(here) AS top, min(here) AS bottom FROM marks GROUP BY Norder, Npix)
        SELECT * EXCEPT (top, bottom), CASE WHEN top = {OUTSIDE} THEN {OUTSIDE}
            WHEN bottom = {INSIDE} THEN {INSIDE} ELSE {BOUNDARY} END AS cover FROM judged""",
        cells=cells,
    )


def _circles_cover(cells: DataFrame, circles: DataFrame) -> DataFrame:
    """`cover` raised to Boundary where any circle of a table reaches a partition's cap.

    The partitions' centres are joined with the circles by position, each order with the circles
    widened by the radius of its cells.
    """
    reached = []
    for (order,) in cells.select("Norder").distinct().collect():
        wide = F.least(F.col("radius") + CELL_RADIUS / (1 << order) + PAD, F.lit(180.0))
        centres = cells.where(F.col("Norder") == order).select("Norder", "Npix", "centre_ra", "centre_dec")
        position = ("centre_ra", "centre_dec")
        reached.append(where_any_circle(centres, circles.withColumn("radius", wide), position=position, split_hot=False))
    if not reached:
        return cells
    marks = reduce(DataFrame.unionByName, reached).select("Norder", "Npix", F.lit(BOUNDARY).alias("m"))
    return _raised(cells, marks)


def _raised(cells: DataFrame, marks: DataFrame) -> DataFrame:
    marked = cells.join(marks, ["Norder", "Npix"], "left")
    return marked.withColumn("cover", F.greatest("cover", F.coalesce("m", F.lit(OUTSIDE)))).drop("m")


def _moc_cover(cells: DataFrame, moc: Moc) -> DataFrame:
    """`cover` raised to how each partition lies to a moc: two equi-joins on whole cells.

    A partition is inside if one of its ancestors is a cell of the moc, and reached if it is an
    ancestor of one. A moc's cells are as few as can be, so four that make up a whole are one.
    """
    spark = cells.sparkSession
    listed = spark.createDataFrame(moc.cells(), "order int, cell bigint")
    up = cells.select("Norder", "Npix", F.explode(F.sequence(F.lit(0), F.col("Norder"))).alias("order"))
    up = up.withColumn("cell", shift_right(F.col("Npix"), (2 * (F.col("Norder") - F.col("order"))).cast("int")))
    inside = up.join(listed, ["order", "cell"], "left_semi").select("Norder", "Npix").withColumn("m", F.lit(INSIDE))
    down = listed.select("order", "cell", F.explode(F.sequence(F.lit(0), F.col("order"))).alias("Norder"))
    down = down.select(
        "Norder", shift_right(F.col("cell"), (2 * (F.col("order") - F.col("Norder"))).cast("int")).alias("Npix")
    ).distinct()
    reached = cells.join(down, ["Norder", "Npix"], "left_semi").select("Norder", "Npix")
    marks = inside.unionByName(reached.withColumn("m", F.lit(BOUNDARY)))
    return _raised(cells, marks.groupBy("Norder", "Npix").agg(F.max("m").alias("m")))


_TABLES = {"info": tables.from_partition_info, "listing": tables.from_listing, "data": tables.from_data}


def open_catalog(spark: SparkSession, root: str, partitions_from: str | None = None) -> Catalog:
    """A catalog, or a collection's primary table with the collection's indexes.

    The partitions are those of `partition_info.csv`, else of the listing. `partitions_from` asks
    for one of "info", "listing", which knows bytes, and "data", which knows rows as well.
    """
    root = root.rstrip("/")
    collection = _read_properties(spark, [f"{root}/collection.properties"])
    found: dict[str, str] = {}
    if collection is not None:
        if "hats_primary_table_url" not in collection:
            raise ValueError("collection.properties lacks hats_primary_table_url")
        pairs = collection.get("all_indexes", "").split()
        if len(pairs) % 2:
            raise ValueError("all_indexes is a list of pairs, a column and the folder of its index")
        found = {
            column: f"{root}/{_inside(name, 'all_indexes')}"
            for column, name in zip(pairs[::2], pairs[1::2], strict=True)
        }
        root = f"{root}/{_inside(collection['hats_primary_table_url'], 'hats_primary_table_url')}"
    properties = _read_properties(spark, [f"{root}/{name}" for name in _PROPERTIES])
    if properties is None:
        raise ValueError(f"{root} is not a catalog: it has no properties file")
    suffix = properties.get("hats_npix_suffix", ".parquet")
    try:
        partitions = _TABLES[partitions_from or "info"](spark, root, suffix)
    except AnalysisException as error:
        if partitions_from is not None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        partitions = tables.from_listing(spark, root, suffix)
    # Asked again by every selection, and one small row per file.
    partitions = partitions.persist()
    known = partitions.agg(F.max("Norder").alias("deepest"), F.min_by("path", "lo").alias("first")).first()
    schema = _schema(spark, root, known.first)
    return Catalog(spark, root, properties, partitions, schema, found, known.deepest or 0)


def _schema(spark: SparkSession, root: str, first: str | None) -> T.StructType:
    """One schema for every partition: the common one if there is one, else the first's."""
    try:
        return spark.read.parquet(f"{root}/dataset/_common_metadata").schema
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if first is None:
        raise ValueError(f"neither a common schema nor a partition is there under {root}")
    return spark.read.parquet(first).schema
