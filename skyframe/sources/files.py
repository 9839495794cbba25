"""Plain parquet tables, and where a job may put tables of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators.projection import select_columns, where_text

CHECKPOINT_DIR = "spark.checkpoint.dir"


def read_parquet(spark: SparkSession, path, names: str | None = None) -> DataFrame:
    """A parquet table. `names` is a glob its files' names match; the extension is not looked at."""
    reader = spark.read
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if not df.columns:
        raise ValueError(f"no parquet column is stored under {path}")
    return df


def from_nanoseconds(df: DataFrame, *columns: str) -> DataFrame:
    """Nanosecond timestamps, read as bigint under `spark.sql.legacy.parquet.nanosAsLong`, at
    the microsecond that Spark's timestamps hold."""
    return df.withColumns({name: F.timestamp_micros(F.floor(F.col(name) / 1000)) for name in columns})


def first_rows(
    spark: SparkSession,
    path: str,
    n: int,
    columns: list[str] | None = None,
    where: str | None = None,
    names: str | None = None,
) -> DataFrame:
    """The front of a table's files, the same rows every time: by file, then by row in it.

    Files are taken in order, twice as many each time, until they hold `n` rows, so the front of
    a large table is found without reading the rest of it.
    """
    whole = read_parquet(spark, path, names)
    files, upto = sorted(whole.inputFiles()), 1
    # Below a folder, names of folders may hold columns, also where there is but one file.
    reader = spark.read.schema(whole.schema)
    if len(files) > 1 or not (set(path) & set("*?[{") or files[0].endswith(path.rpartition("/")[2])):
        reader = reader.option("basePath", path)
    while True:
        df = reader.parquet(*files[:upto])
        df = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
        if where is not None:
            df = where_text(df, where)
        if upto >= len(files) or df.limit(n).count() >= n:
            break
        upto *= 2
    front = df.orderBy("__path", "__row").limit(n).drop("__path", "__row")
    return front if columns is None else select_columns(front, columns)


_local_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a table of this job's own, in the folder the cluster shares.

    That is the one `spark.checkpoint.dir` names. Only a local run that names none is given a
    temporary folder of its machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        application = spark.sparkContext.applicationId
        if application not in _local_roots:
            _local_roots[application] = tempfile.mkdtemp(prefix="skyframe-")
        root = _local_roots[application]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read there: lineage ends with them, and an executor
    that is lost costs only the tasks it was running."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
