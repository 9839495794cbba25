"""Secondary indexes: tables of `(Norder, Npix, value [, healpix])`, sorted by value.

Beside an index may stand its manifest: of every file the least and the greatest value, and a Bloom
filter of its values, cut into stretches of bits that are looked up by number. A few values are then
looked up in that first, and a file that cannot hold one of them is not opened: most files for
values far apart, and all of them for values that are not there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.operators.coverage import closed_up
from skyframe.operators.regions import merged
from skyframe.operators.sets import among
from skyframe.sources.files import kept
from skyframe.sources.sinks import TASK_ROWS, ranged, write_parquet

# Values that are looked up as a list; more are a join.
LISTED_VALUES = 1_000
# Bits of a file's filter for each of its rows, and how many of them a value sets: about one value in
# a hundred that is not there seems to be.
BITS_EACH, HASHES = 10, 7
# Bits of a stretch, as Spark's bitmaps have them.
_STRETCH = 32_768
# The order at which the cells of very many entries are told to the driver: 49,152 at most.
COARSE = 6


def read_index(spark: SparkSession, root: str, column: str) -> DataFrame:
    """An index catalog. Without the two columns that name a partition it is not one."""
    index = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/dataset")
    missing = [name for name in (column, "Norder", "Npix") if name not in index.columns]
    if missing:
        raise ValueError(f"this index for {column} has no {', '.join(missing)} column")
    return index


def write_index(rows: DataFrame, root: str, column: str) -> None:
    """An index catalog and its manifest. `rows` have the column, `Norder`, `Npix` and maybe cells.

    Sorted by range of the value and then by cell, so that one very frequent value is spread over
    files; row groups have the filters that parquet knows too.
    """
    others = [name for name in rows.columns if name not in (column, "Norder", "Npix")]
    write_parquet(ranged(rows, column, *others).sortWithinPartitions(column), f"{root}/dataset", bloom=[column])
    write_manifest(rows.sparkSession, root, column)


def _bits(value: Column, size: Column) -> Column:
    """The bits of a filter of `size` bits that a value sets."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), value), size) for k in range(HASHES)])


def write_manifest(spark: SparkSession, root: str, column: str) -> None:
    """The manifest of an index that is there. Values are counted once a file before they move, so
    a value that a third of all rows have sets its bits once a task."""
    index = read_index(spark, root, column)
    rows = index.where(F.col(column).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("value"))
    files = rows.groupBy("file").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    size = F.ceil(F.col("n") * BITS_EACH / _STRETCH).cast("bigint") * _STRETCH
    files.withColumn("size", size).coalesce(1).write.parquet(f"{root}/manifest/files")
    # Sorted by a number for the file and so many values a task: paths would be most of its memory.
    # Should two files share a number, each has the other's bits as well.
    named = spark.read.parquet(f"{root}/manifest/files").select(F.xxhash64("file").alias("key"), "file", "size")
    values = rows.select(F.xxhash64("file").alias("key"), "value").distinct()
    values = values.repartition(max(1, -(-rows.count() // TASK_ROWS)), "key", "value").join(named.drop("file"), "key")
    values = values.select("key", F.explode(_bits(F.col("value"), F.col("size"))).alias("bit"))
    stretch = values.groupBy("key", F.floor(F.col("bit") / _STRETCH).alias("stretch"))
    bits = stretch.agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_STRETCH))).alias("bits"))
    bits = bits.join(named.drop("size"), "key").select("file", "stretch", "bits")
    write_parquet(bits.repartitionByRange("file", "stretch").sortWithinPartitions("file", "stretch"), f"{root}/manifest/bits")


def _manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    try:
        return tuple(spark.read.parquet(f"{root}/manifest/{name}") for name in ("files", "bits"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def files_with(spark: SparkSession, root: str, column: str, values: list, data_type: T.DataType) -> list[str] | None:
    """The files of an index that can hold one of a list of values; None if it has no manifest."""
    found = _manifest(spark, root)
    if found is None:
        return None
    files, bits = found
    wanted = F.array(*[F.lit(value).cast(data_type) for value in values if value is not None]).cast(T.ArrayType(data_type))
    within = F.filter(wanted, lambda value: value.between(F.col("low"), F.col("high")))
    asked = files.select("file", "size", F.explode(within).alias("value"))
    asked = asked.select("file", "value", F.explode(_bits(F.col("value"), F.col("size"))).alias("bit"))
    asked = asked.select("file", "value", F.floor(F.col("bit") / _STRETCH).alias("stretch"), F.pmod("bit", F.lit(_STRETCH)).cast("int").alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.col("at") % 8).bitwiseAND(F.lit(1)) == 1
    looked = asked.join(bits, ["file", "stretch"], "left")
    held = looked.groupBy("file", "value").agg(F.bool_and(F.coalesce(is_set, F.lit(False))).alias("held")).where("held")
    return sorted(row.file for row in held.select("file").distinct().collect())


def listed(spark: SparkSession, values, data_type: T.DataType, column: str):
    """Wanted values as a list where they are few, else as a stored table of distinct ones, so
    that whatever they come from is evaluated once."""
    if not isinstance(values, DataFrame):
        values = list(dict.fromkeys(values))
        if len(values) <= LISTED_VALUES:
            return values
        values = spark.createDataFrame([(value,) for value in values], T.StructType([T.StructField(column, data_type)]))
    wanted = values.select(F.col(column).cast(data_type).alias(column)).distinct()
    wanted = kept(wanted, "wanted")
    few = wanted.limit(LISTED_VALUES + 1).collect()
    return wanted if len(few) > LISTED_VALUES else [row[0] for row in few]


def entries(index: DataFrame, column: str, values, few: bool = False) -> DataFrame:
    """The index rows of the wanted values: what partition, and where in it if the index says.

    A list is an IN over the index, which the statistics of its sorted files answer. A table, of
    distinct values and handed out if `few`, is joined, once: partitions and cells are both taken
    from what that gives.
    """
    if not isinstance(values, DataFrame):
        return index.where(F.col(column).isin(values))
    found = among(index, column, values.select(F.col(column).cast(index.schema[column].dataType).alias(column)), few)
    return kept(found, "entries")


def cell_ranges(found: DataFrame, cell: str, order: int, budget: int) -> list[tuple[int, int]]:
    """Ranges of index values, at most `budget`, that hold the cells of some entries. What comes to
    the driver is cells of a coarse order, of which there are a bounded number."""
    up = 2 * max(0, order - COARSE)
    coarse = found.select(F.shiftright(F.col(cell).cast("bigint"), up).alias("c")).where("c IS NOT NULL").distinct()
    spans = merged([(row.c << up, (row.c + 1) << up) for row in coarse.collect()])
    return closed_up(spans, budget)


def partitions_of(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("Norder").cast("int").alias("Norder"), F.col("Npix").cast("bigint").alias("Npix")
    ).where(F.col("Norder").isNotNull() & F.col("Npix").isNotNull()).distinct()
