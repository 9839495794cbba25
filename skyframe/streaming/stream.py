"""The stateless operators over unbounded input. They are the batch ones: a region test and a row
predicate are column expressions, and a crossmatch with a static catalog is an equi-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyframe.operators.crossmatch import crossmatch
from skyframe.operators.projection import select_columns, where_text
from skyframe.operators.region_filter import where_region


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive. A stream's schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def select_stream(
    stream: DataFrame, regions=None, where: str | None = None, columns: list[str] | None = None, **options
) -> DataFrame:
    """Rows of a stream by region, then predicate, then columns; append mode, no state kept."""
    if regions is not None:
        stream = where_region(stream, regions, **options)
    if where is not None:
        stream = where_text(stream, where)
    return stream if columns is None else select_columns(stream, columns)


def crossmatch_stream(stream: DataFrame, catalog: DataFrame, radius: float, **options) -> DataFrame:
    """Every arriving row with the static catalog's rows around it.

    Its radius is a number: a column's would have to be looked at before the stream has begun.
    """
    if not isinstance(radius, (int, float)):
        raise ValueError("a stream is matched within one radius, in degrees")
    return crossmatch(stream, catalog, radius, **options)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """What has arrived of a stream, batch by batch through `each`, under `path`; read it with
    `spark.read.parquet(path)`.

    A batch has a folder of its own, named by its number, and replaces what is there: one that was
    cut short is run again under its number when the query is started anew from its checkpoint, and
    no row is there twice or is missing.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crossmatch_batches(
    stream: DataFrame, catalog: Callable[[], DataFrame], radius, path: str, checkpoint: str, columns: list[str] | None = None, **options
) -> StreamingQuery:
    """Every arriving row with the rows around it of a catalog that is read anew for each batch.

    A batch is an ordinary table: its hot buckets are counted on both sides, and the radius may be a
    column of it. Of the pairs `columns` are written, or all.
    """

    def pairs(batch: DataFrame) -> DataFrame:
        found = crossmatch(batch, catalog(), radius, **options)
        return found if columns is None else select_columns(found, columns)

    return write_batches(stream, path, checkpoint, pairs)
