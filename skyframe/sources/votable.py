"""Ingest of VOTable TABLEDATA: rows by Spark's XML reader, cells typed by the FIELDs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# VOTable datatype -> (Spark type, hexadecimal digits).
_INTEGERS = {"unsignedByte": ("smallint", 2), "short": ("smallint", 4), "int": ("int", 8), "long": ("bigint", 16)}
_FLOATS = {"float": "float", "double": "double", "floatComplex": "float", "doubleComplex": "double"}
_RANGES = {
    "unsignedByte": (0, 255),
    "short": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "long": (-(2**63), 2**63 - 1),
}
_FIELD = (
    "_name string, _ID string, _datatype string, _arraysize string, VALUES struct<_null:string>"
)


@dataclass(frozen=True)
class Field:
    name: str
    datatype: str
    arraysize: str | None
    null: str | None

    @property
    def is_text(self) -> bool:
        return self.datatype in ("char", "unicodeChar")

    @property
    def is_list(self) -> bool:
        if self.datatype.endswith("Complex"):
            return True
        if self.is_text:
            return "x" in (self.arraysize or "")
        return self.arraysize not in (None, "", "1")

    @property
    def width(self) -> int | None:
        """Characters of a fixed-width string; None where they are counted."""
        if self.arraysize in (None, ""):
            return 1
        first = self.arraysize.split("x")[0].rstrip("*")
        return int(first) if first and not (self.arraysize.endswith("*") and "x" not in self.arraysize) else None

    @property
    def count(self) -> tuple[int, bool]:
        """How many values a cell holds, or a multiple of what where that varies."""
        pairs = 2 if self.datatype.endswith("Complex") else 1
        if self.arraysize in (None, ""):
            return pairs, True
        sizes = self.arraysize.split("x")
        total = pairs
        for size in sizes:
            if size.endswith("*"):
                return total, False
            total *= int(size)
        return total, True


def fields_of(spark: SparkSession, path: str) -> list[Field]:
    """The FIELDs of the documents, which all have to say the same."""
    reader = spark.read.format("xml").option("rowTag", "FIELD").schema(_FIELD)
    rows = (
        reader.load(path)
        .select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("at", "_name", "_ID", "_datatype", "_arraysize", F.col("VALUES._null").alias("null")))).alias("fields"))
        .select(F.transform("fields", lambda f: f.dropFields("at")).alias("fields"))
        .distinct()
        .limit(2)
        .collect()
    )
    if len(rows) != 1:
        raise ValueError("the documents have no FIELDs" if not rows else "the documents' FIELDs differ")
    found = []
    for at, row in enumerate(rows[0].fields):
        name = row["_name"] or row["_ID"] or f"col{at + 1}"
        if row["_datatype"] not in {*_INTEGERS, *_FLOATS, "boolean", "bit", "char", "unicodeChar"}:
            raise ValueError(f"FIELD {name} has datatype {row['_datatype']!r}, which is not one of VOTable's")
        found.append(Field(name, row["_datatype"], row["_arraysize"], row["null"]))
    return found


def _refused(token: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit("'"), token, F.lit(f"' is not {what}")))


def _integer(token: Column, datatype: str) -> Column:
    """Decimal, or 0x and as many hexadecimal digits as the type has, which are its own bits."""
    kind, digits = _INTEGERS[datatype]
    low, high = _RANGES[datatype]
    hexadecimal = token.rlike(f"^0[xX][0-9a-fA-F]{{1,{digits}}}$")
    raw = F.conv(F.substring(token, 3, 16), 16, -10).cast("decimal(20,0)")
    wrapped = raw if datatype in ("unsignedByte", "long") else F.when(raw > high, raw - 2 ** (4 * digits)).otherwise(raw)
    decimal = token.rlike(r"^[+-]?[0-9]+$") & token.try_cast("decimal(20,0)").between(low, high)
    return (
        F.when(token.isNull(), F.lit(None).cast(kind))
        .when(hexadecimal, wrapped.cast(kind))
        .when(decimal, token.try_cast(kind))
        .otherwise(_refused(token, f"a {datatype}").cast(kind))
    )


def _float(token: Column, datatype: str) -> Column:
    kind = _FLOATS[datatype]
    lower = F.lower(token)
    number = token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return (
        F.when(token.isNull(), F.lit(None).cast(kind))
        .when(number, token.try_cast(kind))
        .when(lower.rlike(r"^[+-]?nan$"), F.lit(float("nan")).cast(kind))
        .when(lower.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")).cast(kind))
        .when(lower.rlike(r"^-inf(inity)?$"), F.lit(-float("inf")).cast(kind))
        .otherwise(_refused(token, f"a {datatype}").cast(kind))
    )


def _boolean(token: Column) -> Column:
    lower = F.lower(token)
    return (
        F.when(lower.isin("t", "1", "true"), True)
        .when(lower.isin("f", "0", "false"), False)
        .when(token.isNull() | lower.isin("", "?"), F.lit(None).cast("boolean"))
        .otherwise(_refused(token, "a boolean").cast("boolean"))
    )


def _bit(token: Column) -> Column:
    known = F.when(token.isNull(), F.lit(None).cast("boolean")).when(token == "1", True).when(token == "0", False)
    return known.otherwise(_refused(token, "a bit").cast("boolean"))


def _value(token: Column, field: Field) -> Column:
    if field.datatype in _INTEGERS:
        value = _integer(token, field.datatype)
    elif field.datatype in _FLOATS:
        value = _float(token, field.datatype)
    else:
        value = _boolean(token) if field.datatype == "boolean" else _bit(token)
    if field.null is None or field.datatype in ("boolean", "bit"):
        return value
    # The value that stands for none, wherever it is found: compared as values, so 099 is 99.
    sentinel = _integer if field.datatype in _INTEGERS else _float
    return F.when(~value.eqNullSafe(sentinel(F.lit(field.null.strip()), field.datatype)), value)


def _text(text: Column, field: Field) -> Column:
    """A string ends at a NUL; one of fixed width is cut to it and loses its trailing blanks."""
    ended = F.substring_index(text, "\0", 1)
    if field.width is None:
        return ended
    cut = F.substring(ended, 1, field.width)
    return F.regexp_replace(cut, " +$", "") if field.width > 1 else cut


def _texts(text: Column, field: Field) -> Column:
    """Several strings of one width, run together; a short cell is filled with empty ones."""
    wanted, fixed = field.count
    pieces = F.ceil(F.char_length(text) / field.width).cast("int")
    inner = wanted // field.width
    length = F.lit(inner) if fixed else (F.ceil(pieces / max(1, inner)) * max(1, inner)).cast("int")
    strings = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda at: _text(F.substring(text, at * field.width + 1, F.lit(field.width)), field),
    )
    return F.when(text.isNull(), F.lit(None)).when(pieces <= length, strings).otherwise(
        _refused(text, f"a cell of arraysize {field.arraysize}").cast("array<string>")
    )


def cell(text: Column, field: Field) -> Column:
    """One TD as its column's type. An empty one is null, whatever the column holds."""
    text = F.when(F.length(text) > 0, text)
    if field.is_text:
        return _texts(text, field) if field.is_list else _text(text, field)
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    if not field.is_list:
        if field.datatype == "boolean":
            return _value(trimmed, field)
        return _value(F.when(F.length(trimmed) > 0, trimmed), field)
    if field.datatype == "bit":
        tokens = F.split(F.regexp_replace(trimmed, r"\s+", ""), "(?<=.)(?=.)")
    elif field.datatype == "boolean":
        # `TTF` is three values; a lone word is one.
        runs = ~trimmed.rlike(r"\s") & ~F.lower(trimmed).isin("true", "false")
        tokens = F.when(runs, F.split(trimmed, "(?<=.)(?=.)")).otherwise(F.split(trimmed, r"\s+"))
    else:
        tokens = F.split(F.when(F.length(trimmed) > 0, trimmed), r"\s+")
    wanted, fixed = field.count
    fits = (F.size(tokens) == wanted) if fixed else (F.size(tokens) % wanted == 0)
    values = F.transform(tokens, lambda token: _value(token, field))
    wrong = _refused(text, f"a cell of arraysize {field.arraysize}")
    return F.when(tokens.isNull(), F.lit(None)).when(fits, values).otherwise(wrong.cast(_list_type(field)))


def _list_type(field: Field) -> str:
    if field.datatype in _INTEGERS:
        return f"array<{_INTEGERS[field.datatype][0]}>"
    return f"array<{_FLOATS.get(field.datatype, 'boolean')}>"


def read_votable(
    spark: SparkSession, path: str, names: str | None = None, fields_from: str | None = None
) -> DataFrame:
    """The rows of a folder of TABLEDATA documents, typed by their FIELDs.

    Finding the FIELDs of every document, to see that they agree, is a pass over all of them.
    `fields_from` is the caller's word that they do: the one document to read them from.
    """
    fields = fields_of(spark, fields_from or path)
    reader = spark.read.format("xml").option("rowTag", "TR").schema("TD array<string>")
    reader = reader.option("ignoreSurroundingSpaces", "false").option("nullValue", "\0")
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    rows = reader.load(path)
    short = F.size("TD") != len(fields)
    wrong = F.raise_error(F.concat(F.lit("a row has "), F.size("TD"), F.lit(f" cells, not {len(fields)}")))
    cells = F.when(short, wrong.cast("array<string>")).otherwise(F.col("TD"))
    rows = rows.select(cells.alias("TD"))
    return rows.select(*[cell(F.col("TD")[at], field).alias(field.name) for at, field in enumerate(fields)])
