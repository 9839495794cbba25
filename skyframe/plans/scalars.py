"""Predicates, scalar functions, nested columns, writers, ingest and streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import numeric
from skyframe.operators.projection import select_columns, where_text
from skyframe.operators.regions import Circle
from skyframe.plans.inputs import (
    DETECTIONS,
    STARS,
    detections,
    in_circle_sql,
    light_curves,
    rounded,
    stars,
    table,
    with_position,
)
from skyframe.plans.registry import query
from skyframe.sources.files import read_parquet, shared_folder
from skyframe.sources.sinks import write_delimited, write_json, write_parquet
from skyframe.sources.votable import read_votable
from skyframe.streaming.stream import crossmatch_batches, crossmatch_stream, read_stream, select_stream


@query(
    "SELECT p_partkey FROM part WHERE (p_brand LIKE 'Brand#1%' AND p_size * 2 + 1 > 20) "
    "OR NOT (p_retailprice < 1500 OR p_size IN (1, 2, 3)) AND p_size BETWEEN 5 AND 30"
)
def predicates(spark, sf_dir):
    return where_text(
        table(spark, sf_dir, "part"),
        "(p_brand LIKE 'Brand#1%' AND p_size * 2 + 1 > 20) "
        "OR NOT (p_retailprice < 1500 OR p_size IN (1, 2, 3)) AND p_size BETWEEN 5 AND 30",
    ).select("p_partkey")


@query("SELECT p_partkey, regexp_matches(p_type, '(STANDARD|SMALL|promo)') AS similar FROM part")
def similar_to(spark, sf_dir):
    """`SIMILAR TO` is a regular expression found anywhere in the value."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").rlike("(STANDARD|SMALL|promo)").alias("similar")
    )


_FLAG = "(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END)"


@query(
    f"SELECT count(*) FILTER (WHERE {_FLAG} IS TRUE) AS t, count(*) FILTER (WHERE {_FLAG} IS NOT TRUE) AS nt, "
    f"count(*) FILTER (WHERE {_FLAG} IS FALSE) AS f, count(*) FILTER (WHERE {_FLAG} IS NULL) AS u, "
    f"count(*) FILTER (WHERE {_FLAG} IS NOT NULL) AS nu FROM events"
)
def three_valued(spark, sf_dir):
    flagged = table(spark, sf_dir, "events").selectExpr(f"{_FLAG} AS flag")
    tests = {"t": "IS TRUE", "nt": "IS NOT TRUE", "f": "IS FALSE", "u": "IS UNKNOWN", "nu": "IS NOT UNKNOWN"}
    return flagged.agg(*[F.count_if(F.expr(f"flag {test}")).alias(name) for name, test in tests.items()])


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS first_mag, l_quantity + 2 AS last_mjd, 2 AS fields FROM lineitem WHERE l_tax < 0.05"
)
def nested_projection(spark, sf_dir):
    """Two fields of a nested column come back as one column of two fields, in the order named."""
    curves = where_text(light_curves(spark, sf_dir), "element_at(lightcurve.mag, 3) < 0.05")
    kept = select_columns(curves, ["l_orderkey", "lightcurve.mag", "l_linenumber", "lightcurve.mjd"])
    assert kept.schema["Lightcurve"].dataType.names == ["mag", "mjd"]
    return kept.select(
        "l_orderkey",
        "l_linenumber",
        F.col("Lightcurve.mag")[0].alias("first_mag"),
        F.col("Lightcurve.mjd")[2].alias("last_mjd"),
        F.lit(len(kept.schema["Lightcurve"].dataType.names)).alias("fields"),
    )


_X = "(value - 40)"


@query(
    f"SELECT event_id, abs({_X}) AS abs_x, floor({_X})::DOUBLE AS floor_x, ceil({_X})::DOUBLE AS ceil_x, round({_X}, 2) AS round_x, "
    f"round(sqrt(abs({_X})), 9) AS sqrt_x, round(cbrt({_X}), 9) AS cbrt_x, round(exp({_X} / 100), 9) AS exp_x, "
    f"round(pow(abs({_X}), 1.5), 6) AS pow_x, round(degrees(pi()), 9) AS deg, round(radians({_X}), 9) AS rad, sign({_X})::DOUBLE AS sign_x FROM events"
)
def math_functions(spark, sf_dir):
    x = F.col("value") - 40
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.abs(x).alias("abs_x"),
        numeric.floor(x).alias("floor_x"),
        numeric.ceil(x).alias("ceil_x"),
        F.round(x, 2).alias("round_x"),
        rounded(F.sqrt(F.abs(x)), 9).alias("sqrt_x"),
        rounded(F.cbrt(x), 9).alias("cbrt_x"),
        rounded(F.exp(x / 100), 9).alias("exp_x"),
        rounded(F.pow(F.abs(x), F.lit(1.5)), 6).alias("pow_x"),
        rounded(F.degrees(F.pi()), 9).alias("deg"),
        rounded(F.radians(x), 9).alias("rad"),
        F.signum(x).alias("sign_x"),
    )


@query(
    f"SELECT event_id, round(sin({_X}), 9) AS s, round(cos({_X}), 9) AS c, round(tan({_X} / 100), 9) AS t, round(asin({_X} / 1000), 9) AS ras, "
    f"round(acos({_X} / 1000), 9) AS rac, round(atan({_X}), 9) AS rat, round(atan2({_X}, 3), 9) AS rat2, "
    f"round(cos({_X} / 100 + 2) / sin({_X} / 100 + 2), 6) AS ct, round(sinh({_X} / 100), 9) AS sh, round(cosh({_X} / 100), 9) AS ch, "
    f"round(tanh({_X} / 100), 9) AS th, round(asinh({_X}), 9) AS ash, round(acosh(abs({_X}) + 1), 9) AS ach, round(atanh({_X} / 1000), 9) AS ath FROM events"
)
def trigonometry(spark, sf_dir):
    x = F.col("value") - 40
    shown = {
        "s": F.sin(x), "c": F.cos(x), "t": F.tan(x / 100), "ras": F.asin(x / 1000), "rac": F.acos(x / 1000),
        "rat": F.atan(x), "rat2": F.atan2(x, F.lit(3.0)), "sh": F.sinh(x / 100), "ch": F.cosh(x / 100),
        "th": F.tanh(x / 100), "ash": F.asinh(x), "ach": F.acosh(F.abs(x) + 1), "ath": F.atanh(x / 1000),
    }
    columns = [rounded(value, 9).alias(name) for name, value in shown.items()]
    return table(spark, sf_dir, "events").select("event_id", *columns, rounded(F.cot(x / 100 + 2), 6).alias("ct"))


_LOGS = "CASE WHEN {v} > 0 THEN round({f}({v}), 9) WHEN {v} = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS {n}"
_K = "(event_id % 11 - 3)::DOUBLE"


@query(
    f"SELECT event_id, CASE WHEN {_X} < 0 THEN ceil({_X}) ELSE floor({_X}) END::DOUBLE AS cut, "
    f"(CASE WHEN {_X} < 0 THEN ceil({_X} * 100) ELSE floor({_X} * 100) END / 100)::DOUBLE AS cut2, "
    f"(event_id % 11 - 5) % 3 AS remainder, {_LOGS.format(v=_K, f='ln', n='natural')}, "
    f"{_LOGS.format(v=_K, f='log2', n='binary')}, {_LOGS.format(v=_K, f='log10', n='common')} FROM events"
)
def trunc_mod_log(spark, sf_dir):
    x, k = F.col("value") - 40, F.col("event_id") % 11 - 3
    return table(spark, sf_dir, "events").select(
        "event_id",
        numeric.trunc(x).alias("cut"),
        numeric.trunc(x, 2).alias("cut2"),
        numeric.mod(F.col("event_id") % 11 - 5, F.lit(3)).alias("remainder"),
        rounded(numeric.ln(k), 9).alias("natural"),
        rounded(numeric.log2(k), 9).alias("binary"),
        rounded(numeric.log10(k), 9).alias("common"),
    )


@query(
    "SELECT event_id, gcd(event_id * 6, user_id * 4)::BIGINT AS g, lcm(event_id % 100, user_id % 40)::BIGINT AS l, "
    "factorial((event_id % 21)::INTEGER)::BIGINT AS f, (event_id % 7 = 0) AS zero FROM events"
)
def integer_functions(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        numeric.gcd(e * 6, u * 4).alias("g"),
        numeric.lcm(e % 100, u % 40).alias("l"),
        numeric.factorial(e % 21).alias("f"),
        numeric.iszero(e % 7).alias("zero"),
    )


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END "
    "ELSE round((event_id % 3) / (event_id % 4)::DOUBLE, 9) END AS ratio, event_id % 12 = 0 AS undefined, "
    "CASE WHEN event_id % 12 = 0 THEN -1::DOUBLE WHEN event_id % 4 = 0 THEN 'inf'::DOUBLE "
    "ELSE round((event_id % 3) / (event_id % 4)::DOUBLE, 9) END AS filled FROM events"
)
def not_a_number(spark, sf_dir):
    ratio = numeric.divide(F.col("event_id") % 3, F.col("event_id") % 4)
    rows = table(spark, sf_dir, "events").select("event_id", rounded(ratio, 9).alias("ratio"))
    return rows.select(
        "event_id", "ratio", F.isnan("ratio").alias("undefined"), F.nanvl("ratio", F.lit(-1.0)).alias("filled")
    )


@query("SELECT unnest(range(5)) AS fifth, 0.2::DOUBLE AS share, true AS apart FROM (SELECT count(*) FROM events)")
def random_numbers(spark, sf_dir):
    """A fifth of the numbers in each fifth of 0 to 1, none outside, and hardly one drawn twice."""
    drawn = table(spark, sf_dir, "events").select(numeric.rand(7).alias("r"))
    parts = drawn.groupBy(F.floor(F.col("r") * 5).alias("fifth")).agg(F.count("*").alias("n"), F.count_distinct("r").alias("unlike"))
    total = table(spark, sf_dir, "events").agg(F.count("*").alias("total"))
    parts = parts.join(F.broadcast(total))
    return parts.select("fifth", F.round(F.col("n") / F.col("total"), 1).alias("share"), (F.col("unlike") > 0.99 * F.col("n")).alias("apart"))


@query(
    "SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, p_type || '/' || p_brand AS both, p_name ILIKE '%A%' AS has_a FROM part"
)
def string_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower("p_name").alias("low"),
        F.upper("p_brand").alias("up"),
        F.concat("p_type", F.lit("/"), "p_brand").alias("both"),
        F.col("p_name").ilike("%A%").alias("has_a"),
    )


@query(
    "SELECT event_id, CAST(floor(value) AS INTEGER) AS whole, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN event_type ELSE '12' END AS INTEGER) AS tried, "
    "coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, 'none') AS kind, "
    "CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS level FROM events"
)
def cast_coalesce(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("12"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor("value").cast("int").alias("whole"),
        text.try_cast("int").alias("tried"),
        F.coalesce(kind, F.lit("none")).alias("kind"),
        F.when(F.col("value") > 80, "high").when(F.col("value") > 20, "mid").otherwise("low").alias("level"),
    )


@query("SELECT p_partkey, p_size + 1 AS bigger, p_brand AS brand FROM part WHERE p_size > 10")
def struct_fields(spark, sf_dir):
    built = F.struct((F.col("p_size") + 1).alias("bigger"), F.col("p_brand").alias("brand"))
    rows = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", built.alias("s"))
    return rows.select("p_partkey", F.col("s").getField("bigger").alias("bigger"), F.col("s.brand"))


# ---- what is written reads back ----


@query("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def parquet_round_trip(spark, sf_dir):
    path = shared_folder(spark, "parquet")
    write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), path)
    return spark.read.parquet(path)


def _awkward(spark, sf_dir) -> DataFrame:
    ratio = numeric.divide(F.col("event_id") % 3 - 1, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select(
        "event_id", ratio.alias("ratio"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"), "ts"
    )


_RATIO = (
    "CASE WHEN event_id % 4 <> 0 THEN '' || '' WHEN event_id % 3 = 1 THEN 'NaN' WHEN event_id % 3 = 2 THEN '{inf}' ELSE '-{inf}' END AS odd"
)
_KIND = "CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind"


@query(
    f"SELECT event_id, {_RATIO.format(inf='Infinity')}, {_KIND}, event_id % 5 = 0 AS null_written FROM events"
)
def json_rows(spark, sf_dir):
    path = shared_folder(spark, "json")
    write_json(_awkward(spark, sf_dir), path)
    written = spark.read.text(path)
    odd = F.regexp_extract("value", r'"ratio":"(-?[A-Za-z]+)"', 1)
    shape = "event_id BIGINT, kind STRING"
    rows = written.select(
        F.from_json("value", shape).alias("r"), odd.alias("odd"), F.col("value").contains('"kind":null').alias("null_written")
    )
    return rows.select("r.event_id", "odd", "r.kind", "null_written")


@query("SELECT event_id, '[{\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.123456\",\"day\":\"' || strftime(ts, '%Y-%m-%d') || '\"}]' AS seen FROM events")
def json_nested_instants(spark, sf_dir):
    """Instants inside a list of structs keep all their digits."""
    path = shared_folder(spark, "json")
    second = F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    at = (second + F.expr("INTERVAL 123456 MICROSECONDS")).alias("at")
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.struct(at, F.to_date("ts").alias("day"))).alias("seen"))
    write_json(rows, path)
    written = spark.read.text(path)
    return written.select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("value", "$.seen").alias("seen")
    )


@query(
    f"SELECT event_id::VARCHAR AS event_id, {_RATIO.format(inf='inf')}, coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, 'NULL') AS kind, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events"
)
def csv_rows(spark, sf_dir):
    path = shared_folder(spark, "csv")
    write_delimited(_awkward(spark, sf_dir), path, separator="\t", null="NULL")
    rows = spark.read.csv(path, sep="\t", header=True, schema="event_id STRING, ratio STRING, kind STRING, ts STRING")
    odd = F.when(F.col("ratio").rlike("[A-Za-z]{3}"), F.col("ratio")).otherwise("")
    return rows.select("event_id", odd.alias("odd"), "kind", F.substring("ts", 1, 19).alias("at"))


_FIELDS = [
    ("event_id", 'datatype="long"'), ("value", 'datatype="double"'), ("event_type", 'datatype="char" arraysize="*"'),
    ("flag", 'datatype="boolean"'), ("code", 'datatype="short"'), ("pair", 'datatype="int" arraysize="2"'),
]


def _documents(spark, sf_dir) -> str:
    """The events as TABLEDATA documents, one a task: a header, a line a row, a footer."""
    e = F.col("event_id")
    code = F.concat(F.lit("0x"), F.lpad(F.hex(e % 65536), 4, "0"))
    cells = [
        e.cast("string"),
        F.when(e % 7 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string")),
        F.when(e % 5 != 0, F.col("event_type")).otherwise(F.lit("a &lt; b")),
        F.element_at(F.array(*[F.lit(v) for v in ("T", "f", "?", "1", "")]), (e % 5 + 1).cast("int")),
        F.when(e % 9 == 0, F.lit("")).when(e % 9 == 1, F.lit("99")).otherwise(code),
        F.concat_ws(" ", e % 10, -(e % 4)),
    ]
    row = F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), cell, F.lit("</TD>")) for cell in cells], F.lit("</TR>"))
    fields = "".join(
        f'<FIELD name="{name}" {kind}>' + ('<VALUES null="99"/>' if name == "code" else "") + "</FIELD>"
        for name, kind in _FIELDS
    )
    head = f'<VOTABLE version="1.5"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>'
    foot = "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"

    path = shared_folder(spark, "votable")
    # A document for every thousand ids, in one line of a file of its own.
    rows = table(spark, sf_dir, "events").select(F.floor(e / 1000).alias("part"), row.alias("row"))
    inside = F.array_join(F.collect_list("row"), "")
    documents = rows.groupBy("part").agg(F.concat(F.lit(head), inside, F.lit(foot)).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE round(value, 6) END AS value, "
    "CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'a < b' END AS event_type, "
    "CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS flag, "
    "(CASE WHEN event_id % 9 > 1 AND event_id % 65536 <> 99 THEN (event_id + 32768) % 65536 - 32768 END)::SMALLINT AS code, "
    "(event_id % 10)::INTEGER AS first, (-(event_id % 4))::INTEGER AS second FROM events"
)
def votable_ingest(spark, sf_dir):
    rows = read_votable(spark, _documents(spark, sf_dir))
    return rows.select(
        "event_id", F.round("value", 6).alias("value"), "event_type", "flag", "code",
        F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"),
    )


# ---- streams ----


def _streamed(spark, sf_dir, name: str, transform) -> DataFrame:
    """A stream over a given table run until it has no more input, and what it appended."""
    schema = read_parquet(spark, f"{sf_dir}/events.parquet").schema
    # A stream reads folders: the glob picks the one table out of this one.
    source = read_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    target = shared_folder(spark, name)
    running = (
        transform(source)
        .writeStream.format("parquet")
        .option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{target}/rows")


@query(f"WITH {STARS} SELECT event_id, round(value, 6) AS value FROM stars WHERE {in_circle_sql(45, -20, 30)} AND value > 10")
def stream_region(spark, sf_dir):
    def transform(source):
        return select_stream(with_position(source, "event_id"), Circle(45, -20, 30), "value > 10", ["event_id", "value"])

    return _streamed(spark, sf_dir, "region", transform).select("event_id", F.round("value", 6).alias("value"))


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT a.event_id, b.o_orderkey FROM stars a JOIN detections b "
    f"ON abs(a.dec - b.dec) <= 0.4 AND {in_circle_sql('b.ra', 'b.dec', 0.3, 'a.')}"
)
def stream_match(spark, sf_dir):
    catalog = detections(spark, sf_dir).select("o_orderkey", "ra", "dec")

    def transform(source):
        left = with_position(source, "event_id").select("event_id", "ra", "dec")
        return crossmatch_stream(left, catalog, 0.3, separation=None).select("event_id", "o_orderkey")

    return _streamed(spark, sf_dir, "match", transform)


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT a.event_id, b.o_orderkey FROM stars a JOIN detections b "
    f"ON abs(a.dec - b.dec) <= 0.4 AND {in_circle_sql('b.ra', 'b.dec', 0.3, 'a.')}"
)
def stream_restart(spark, sf_dir):
    """A stream that is cut short in the middle of a batch, twice, and started anew each time."""
    folder = shared_folder(spark, "arriving")
    left = stars(spark, sf_dir).select("event_id", "ra", "dec")
    left.repartition(4, "event_id").write.parquet(f"{folder}/in")
    batches, pair = [], ["event_id", "o_orderkey"]

    def catalog():
        # Read anew for every batch; the second and the fourth time something is amiss.
        batches.append(len(batches))
        if len(batches) in (2, 4):
            raise OSError("the catalog is out of reach")
        return detections(spark, sf_dir).select("o_orderkey", "ra", "dec")

    while True:
        source = read_stream(spark, f"{folder}/in", left.schema, files_per_trigger=1)
        running = crossmatch_batches(source, catalog, 0.3, f"{folder}/out", f"{folder}/progress", columns=pair, separation=None)
        try:
            running.awaitTermination()
            break
        except StreamingQueryException:
            if len(batches) > 4:
                raise
    return spark.read.parquet(f"{folder}/out").select(*pair)
