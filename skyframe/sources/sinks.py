"""Writers: parquet, JSON rows, and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the parquet layout: small pages make a small range of rows cheap to fetch.
PARQUET = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "16384",
}
DATE = "yyyy-MM-dd"
LONGEST_NULL = 128


# Rows that a task sorts and writes, whatever the table's size.
TASK_ROWS = 50_000


def ranged(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by range to as many tasks as they need, so that a task's memory does not grow."""
    return df.repartitionByRange(max(1, -(-df.count() // TASK_ROWS)), *columns)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", bloom: list[str] | None = None) -> None:
    """Parquet in the layout above. Columns in `bloom` get a filter a row group, by which a reader
    skips the groups that a value is not in, wherever they are sorted."""
    filters = {f"parquet.bloom.filter.enabled#{name}": "true" for name in bloom or []}
    df.write.mode(mode).options(**PARQUET, **filters).parquet(path)


def _instant(column: Column, data_type: T.DataType) -> Column | None:
    """`YYYY-MM-DDThh:mm:ss[.f]`, with the fraction a value has and no more; a zoned one in UTC,
    marked so. Instants inside structs, lists and maps too; None where there is none to write."""
    if isinstance(data_type, T.TimestampType):
        # The session's zone is what a cast prints in, so the instant is moved to UTC first.
        utc = F.to_utc_timestamp(column, F.current_timezone()).cast("string")
        return F.concat(F.translate(utc, " ", "T"), F.lit("Z"))
    if isinstance(data_type, T.TimestampNTZType):
        return F.translate(column.cast("string"), " ", "T")
    if isinstance(data_type, T.DateType):
        return F.date_format(column, DATE)
    if isinstance(data_type, T.StructType):
        fields = {f.name: (column.getField(f.name), f.dataType) for f in data_type.fields}
        written = {name: _instant(value, kind) for name, (value, kind) in fields.items()}
        if all(value is None for value in written.values()):
            return None
        parts = [(fields[name][0] if value is None else value).alias(name) for name, value in written.items()]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.ArrayType):
        if not _has_instant(data_type.elementType):
            return None
        return F.transform(column, lambda item: _instant(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        if _has_instant(data_type.valueType):
            column = F.transform_values(column, lambda _, value: _instant(value, data_type.valueType))
        if _has_instant(data_type.keyType):
            return F.transform_keys(column, lambda key, _: _instant(key, data_type.keyType))
        return column if _has_instant(data_type.valueType) else None
    return None


def _has_instant(data_type: T.DataType) -> bool:
    return _instant(F.lit(None), data_type) is not None


def with_instants(df: DataFrame) -> DataFrame:
    """Dates and times as the text they are written as."""
    written = {f.name: _instant(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return df.withColumns({name: value for name, value in written.items() if value is not None})


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A row a line, nulls written; NaN and the infinities as strings."""
    with_instants(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def check_null_value(value: str) -> None:
    """A null sentinel is compared with whole cells, so nothing that splits cells may be in it."""
    if len(value.encode()) > LONGEST_NULL:
        raise ValueError(f"a null sentinel is at most {LONGEST_NULL} bytes")
    bad = [c for c in value if c in ",\t\n\r" or ord(c) < 32 or 127 <= ord(c) < 160]
    if bad:
        raise ValueError(f"a null sentinel does not hold {bad[0]!r}")


def write_delimited(
    df: DataFrame, path: str, separator: str = ",", null: str = "", mode: str = "errorifexists"
) -> None:
    """CSV or TSV with a header. A nested column has no form in it and is refused by name."""
    check_null_value(null)
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    for f in df.schema.fields:
        if isinstance(f.dataType, nested):
            raise ValueError(f"column {f.name!r} is nested; write json or parquet, or leave it out")
    finite = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.col(f"`{f.name}`")
            # An infinity is spelled inf here, which Spark spells Infinity.
            finite[f.name] = (
                F.when(value == float("inf"), "inf").when(value == -float("inf"), "-inf").otherwise(value.cast("string"))
            )
    (
        with_instants(df)
        .withColumns(finite)
        .write.mode(mode)
        .option("header", True)
        .option("sep", separator)
        .option("nullValue", null)
        .option("emptyValue", "")
        .csv(path)
    )
