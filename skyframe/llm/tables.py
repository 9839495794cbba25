"""Tables that a job writes for itself, and ids as the contracts use them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"

# How many times as large as Spark takes it for a table may be in memory, and how large it may be then.
TIMES, SURE_BYTES = 64, 10 << 20

# What separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyframe-llm-"))
            given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get()
    return root.rstrip("/")


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that `stored` writes inside are deleted at the end, but for those it is told to keep:
    for steps whose results have been written by then, so that nothing reads the others again."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            _delete(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and a lost executor
    costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    if _scratch and not keep:
        _scratch[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended, not when the driver next happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` returned, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {path.rpartition("/")[0] for path in df.inputFiles()}
        for folder in folders:
            if folder.startswith("file:"):
                folder = "file:///" + folder.removeprefix("file:").lstrip("/")
            _delete(spark, folder)


def unsent(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that sends neither side to the driver and on to every executor. Spark
    takes an exploded table for as large as the one it came from, and a stored one for as large as
    its compressed file; either may be many times that in memory. What is small even so is left to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.hint("merge") if size * TIMES > SURE_BYTES else df


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; a null text has those of an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. `lower` is that for ASCII text, and far faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def flat_columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns that are neither nested nor named: enough to tell rows apart by a hash."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, nested) and f.name not in but]


def with_row(df: DataFrame, more: str) -> T.StructType:
    """The schema of `df`'s column `row` followed by the columns that `more` lists."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(more).fields])
