from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skyframe.functions import numeric
from skyframe.functions.geometry import distance
from skyframe.functions.sql import register
from skyframe.operators.limits import capped, top, with_overflow
from skyframe.operators.projection import exact_names, resolve, select_columns, where_text
from skyframe.sources.files import first_rows, from_nanoseconds, read_parquet


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(10).selectExpr("id AS objectid", "15D + id AS Gmag")


@pytest.fixture(scope="module")
def nested(spark):
    return spark.range(3).selectExpr(
        "id AS objectid",
        "named_struct('mjd', array(10D * id, 10D * id + 1), 'Band', 'g', 'deep', named_struct('a', id, 'b', 2)) AS Sources",
    )


def test_a_name_is_the_files_spelling_or_its_lowercase(mixed):
    assert select_columns(mixed, ["gmag", "objectid"]).columns == ["Gmag", "objectid"]
    assert select_columns(mixed, ["Gmag"]).columns == ["Gmag"]
    with pytest.raises(ValueError, match="names no column"):
        select_columns(mixed, ["GMAG"])
    with pytest.raises(ValueError):
        select_columns(mixed, ['"gmag"'])
    with pytest.raises(ValueError):
        select_columns(mixed, [])
    assert resolve(mixed.schema, "GMAG", any_case=True) == ("Gmag",)


def test_a_lowercase_two_columns_share_names_neither(spark, mixed):
    with exact_names(spark):
        both = mixed.select(F.col("Gmag").alias("Flux"), F.col("objectid").alias("FLUX"), "objectid")
    with pytest.raises(ValueError):
        select_columns(both, ["flux"])
    assert select_columns(both, ["FLUX", "Flux"]).columns == ["FLUX", "Flux"]
    with exact_names(spark):
        one = mixed.select(F.col("Gmag").alias("Flux"), F.col("objectid").alias("flux"))
    assert select_columns(one, ["flux"]).first()[0] == 0
    assert where_text(one, "flux = 3 AND Flux > 17").count() == 1


def test_a_predicate_follows_the_same_rule(mixed):
    assert where_text(mixed, "gmag > 20 AND Gmag < 23").count() == 2
    assert where_text(mixed, "gmag > 20").columns == ["objectid", "Gmag"]
    with pytest.raises(Exception, match="GMAG"):
        where_text(mixed, "GMAG > 20").count()


def test_fields_of_one_column_come_back_as_one(nested):
    out = select_columns(nested, ["sources.mjd", "objectid", "sources.Band"])
    assert out.columns == ["Sources", "objectid"]
    assert out.schema["Sources"].dataType.names == ["mjd", "Band"]
    assert select_columns(nested, ["Sources.band", "Sources"]).schema["Sources"] == nested.schema["Sources"]
    deep = select_columns(nested, ["Sources.deep.b", "Sources.Band", "Sources.deep.a"])
    assert deep.schema["Sources"].dataType.simpleString() == "struct<deep:struct<b:int,a:bigint>,Band:string>"
    with pytest.raises(ValueError):
        select_columns(nested, ["Sources.nothing"])


def test_only_the_named_leaves_are_read(spark, nested, tmp_path):
    path = str(tmp_path / "nested")
    nested.write.parquet(path)
    out = select_columns(read_parquet(spark, path), ["sources.mjd"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Sources:struct<mjd:array<double>>>" in plan


def test_a_cap_says_when_it_cut(mixed):
    kept, told = capped(mixed.orderBy("objectid"), 4)
    assert [r.objectid for r in kept.collect()] == [0, 1, 2, 3] and told.get["overflow"] is True
    kept, told = capped(mixed.repartition(3), 10)
    assert kept.count() == 10 and told.get["overflow"] is False
    none, told = capped(mixed, 0)
    assert none.columns == mixed.columns and none.collect() == [] and told.get["overflow"] is True
    flagged = with_overflow(mixed.orderBy("objectid"), 4).collect()
    assert [(r.objectid, r.overflow) for r in flagged] == [(k, True) for k in range(4)]
    assert [r.overflow for r in with_overflow(mixed.repartition(3), 10).collect()] == [False] * 10
    with pytest.raises(ValueError):
        capped(mixed, -1)
    assert [r.objectid for r in top(mixed.orderBy("objectid"), 2, offset=3).collect()] == [3, 4]


@pytest.mark.parametrize("files", [1, 5])
def test_the_front_of_a_file_does_not_depend_on_its_layout(spark, tmp_path, files):
    path = str(tmp_path / f"front{files}")
    spark.range(0, 5000, 1, files).selectExpr("id", "id % 7 AS k").write.option("parquet.block.size", "4096").parquet(path)
    assert [r.id for r in first_rows(spark, path, 1500).collect()] == list(range(1500))
    some = first_rows(spark, path, 300, ["id"], where="k = 3")
    assert [r.id for r in some.collect()] == list(range(3, 2100, 7))[:300]


def test_files_are_chosen_by_name(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "a").glob("part-*"))
    part.rename(tmp_path / "a" / "rows.data")
    assert read_parquet(spark, str(tmp_path / "a"), "*.data").count() == 5


def test_nanoseconds(spark):
    df = spark.createDataFrame([(1_500_000_000_123_456_789,)], "t bigint")
    assert str(from_nanoseconds(df, "t").first().t) == "2017-07-14 02:40:00.123456"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: numeric.floor(F.lit(-2.5)), -3.0),
        (lambda: numeric.ceil(F.lit(-2.5)), -2.0),
        (lambda: numeric.trunc(F.lit(-2.789)), -2.0),
        (lambda: numeric.trunc(F.lit(2.789), 2), 2.78),
        (lambda: F.round(F.lit(2.5)), 3.0),
        (lambda: numeric.mod(F.lit(-7), F.lit(3)), -1),
        (lambda: numeric.ln(F.lit(0.0)), -math.inf),
        (lambda: numeric.log10(F.lit(1000.0)), 3.0),
        (lambda: numeric.divide(F.lit(1.0), F.lit(0.0)), math.inf),
        (lambda: numeric.divide(F.lit(1.0), F.lit(-0.0)), -math.inf),
        (lambda: numeric.divide(F.lit(-1.0), F.lit(0)), -math.inf),
        (lambda: numeric.divide(F.lit(None), F.lit(2.0)), None),
        (lambda: numeric.gcd(F.lit(-12), F.lit(18)), 6),
        (lambda: numeric.gcd(F.lit(7540113804746346429), F.lit(4660046610375530309)), 1),
        (lambda: numeric.gcd(F.lit(0), F.lit(5)), 5),
        (lambda: numeric.lcm(F.lit(4), F.lit(-6)), 12),
        (lambda: numeric.lcm(F.lit(0), F.lit(6)), 0),
        (lambda: numeric.factorial(F.lit(20)), 2432902008176640000),
        (lambda: numeric.iszero(F.lit(-0.0)), True),
        (lambda: distance((F.lit(0.0), F.lit(0.0)), (180.0, 0.0)), 180.0),
        (lambda: distance((F.lit(None), F.lit(0.0)), (180.0, 0.0)), None),
    ],
)
def test_scalar_values(spark, column, wanted):
    got = value(spark, column())
    assert got == wanted or (wanted is not None and math.isfinite(wanted) and abs(got - wanted) < 1e-12)


def test_values_that_are_not_numbers(spark):
    assert math.isnan(value(spark, numeric.ln(F.lit(-1.0))))
    assert math.isnan(value(spark, numeric.divide(F.lit(0.0), F.lit(0.0))))
    with pytest.raises(Exception, match="overflows"):
        value(spark, numeric.factorial(F.lit(21)))


def test_sql_functions_push_their_bounds(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "sky")
    spark.range(1000).selectExpr("id", "id * 0.36D AS ra", "id * 0.18D - 90 AS dec").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("sql_sky")
    df = spark.sql("SELECT id FROM sql_sky WHERE sky_in_circle(ra, dec, 180D, 0D, 3D)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dec,-3" in plan
    near = spark.sql("SELECT count(*) AS n FROM sql_sky WHERE sky_distance(ra, dec, 180D, 0D) <= 3D").first().n
    assert df.count() == near > 0
    assert spark.sql("SELECT sky_trunc(-2.789D, 1) AS v").first().v == -2.7
