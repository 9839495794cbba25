"""Writers, VOTable ingest and streams."""

from __future__ import annotations

import glob
import math

import pytest

from skyframe.operators.regions import Circle
from skyframe.sources.files import shared_folder
from skyframe.sources.sinks import check_null_value, write_delimited, write_json, write_parquet
from skyframe.sources.votable import read_votable
from skyframe.streaming.stream import crossmatch_stream, read_stream, select_stream


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1, double('NaN'), cast(NULL AS STRING), timestamp_ntz'2020-01-02 03:04:05.5', date'2020-01-02'), "
        "(2, double('Infinity'), '', timestamp_ntz'2020-01-02 03:04:05', NULL), "
        "(3, double('-Infinity'), 'g', NULL, NULL) AS t(id, x, band, at, day)"
    )


def lines(path, pattern="part-*"):
    return sorted(line for file in glob.glob(f"{path}/{pattern}") for line in open(file).read().splitlines())


def test_parquet_is_zstd(spark, awkward, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "p")
    write_parquet(awkward, path)
    file = glob.glob(f"{path}/part-*")[0]
    assert file.endswith(".zstd.parquet")
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
    assert spark.read.parquet(path).count() == 3


def test_json_writes_nulls_and_what_is_not_a_number(awkward, tmp_path):
    path = str(tmp_path / "j")
    write_json(awkward, path)
    assert lines(path) == [
        '{"id":1,"x":"NaN","band":null,"at":"2020-01-02T03:04:05.5","day":"2020-01-02"}',
        '{"id":2,"x":"Infinity","band":"","at":"2020-01-02T03:04:05","day":null}',
        '{"id":3,"x":"-Infinity","band":"g","at":null,"day":null}',
    ]


def test_delimited_text(awkward, tmp_path):
    path = str(tmp_path / "t")
    write_delimited(awkward.coalesce(1), path, separator="\t", null="\\N")
    assert lines(path) == [
        "1\tNaN\t\\N\t2020-01-02T03:04:05.5\t2020-01-02",
        "2\tinf\t\t2020-01-02T03:04:05\t\\N",
        "3\t-inf\tg\t\\N\t\\N",
        "id\tx\tband\tat\tday",
    ]


def test_zoned_instants_are_written_in_utc(spark, tmp_path):
    path = str(tmp_path / "z")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
    try:
        df = spark.sql("SELECT timestamp'2020-06-02 03:04:05.25' AS at")
        write_json(df, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert lines(path) == ['{"at":"2020-06-02T07:04:05.25Z"}']


def test_nested_columns_are_refused_by_name(spark, tmp_path):
    with pytest.raises(ValueError, match="'many'"):
        write_delimited(spark.sql("SELECT array(1) AS many"), str(tmp_path / "n"))


@pytest.mark.parametrize("value", ["a,b", "a\tb", "\n", "x" * 129, "\x01"])
def test_null_sentinels_that_would_split_cells(value):
    with pytest.raises(ValueError):
        check_null_value(value)


def test_the_shared_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark, "x").startswith(named)


class Elsewhere:
    """A session that names no folder, as far as choosing one goes."""

    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"
        self.sparkContext = self.conf = self

    def get(self, _, default):
        return default


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Elsewhere("yarn"), "x")
    one, two = (shared_folder(Elsewhere("local[4]"), "x") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


FIELDS = """
<FIELD name="b" datatype="boolean"/><FIELD name="bits" datatype="bit" arraysize="4"/>
<FIELD name="u" datatype="unsignedByte"/><FIELD name="s" datatype="short"><VALUES null="99"/></FIELD>
<FIELD ID="i" datatype="int"/><FIELD name="l" datatype="long"/>
<FIELD name="f" datatype="float"/><FIELD name="d" datatype="double"><VALUES null="-1"/></FIELD>
<FIELD name="c" datatype="char" arraysize="*"/><FIELD name="w" datatype="char" arraysize="5"/>
<FIELD name="v" datatype="double" arraysize="*"/><FIELD name="z" datatype="doubleComplex"/>
<FIELD name="names" datatype="char" arraysize="3x2"/><FIELD name="flags" datatype="boolean" arraysize="3"/>
"""


def document(path, *rows, fields=FIELDS):
    body = "".join("<TR>" + "".join(f"<TD>{cell}</TD>" for cell in row) + "</TR>\n" for row in rows)
    path.write_text(
        f"<?xml version='1.0'?><VOTABLE version='1.5'><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>\n{body}"
        "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"
    )
    return str(path)


def test_cells_are_typed_by_their_fields(spark, tmp_path):
    path = document(
        tmp_path / "a.vot",
        ["T", "1010", "0xFF", "0xFFFF", "-7", "9223372036854775807", "1.5", "+Inf", "a &amp; b ", "Apple  ", "1 2.5 NaN", "1 -2", "ab cde", "TF?"],
        ["?", "0 0 0 1", "7", "99", "0x7FFFFFFF", "0x8000000000000000", "-inf", "-1", "", "Apples", "", "", "abc", "t f 1"],
        [""] * 14,
    )
    first, second, third = read_votable(spark, path).collect()
    assert first.b is True and first.bits == [True, False, True, False]
    assert (first.u, first.s, first.i, first.l) == (255, -1, -7, 2**63 - 1)
    assert first.f == 1.5 and first.d == math.inf and first.c == "a & b " and first.w == "Apple"
    assert first.v[:2] == [1.0, 2.5] and math.isnan(first.v[2]) and first.z == [1.0, -2.0]
    assert first.names == ["ab", "cde"] and first.flags == [True, False, None]
    assert second.b is None and second.bits == [False, False, False, True]
    assert (second.u, second.s, second.i, second.l) == (7, None, 2**31 - 1, -(2**63))
    assert second.f == -math.inf and second.d is None and second.c is None and second.w == "Apple"
    assert second.v is None and second.z is None and second.names == ["abc", ""]
    assert second.flags == [True, False, True]
    assert all(v is None for v in third)


@pytest.mark.parametrize(
    ("field", "cell"),
    [
        ('datatype="short"', "40000"), ('datatype="int"', "x"), ('datatype="unsignedByte"', "0x100"),
        ('datatype="boolean"', "maybe"), ('datatype="double"', "1.2.3"), ('datatype="int" arraysize="2"', "1 2 3"),
        ('datatype="bit" arraysize="2"', "12"),
    ],
)
def test_a_cell_its_field_does_not_allow(spark, tmp_path, field, cell):
    path = document(tmp_path / "bad.vot", [cell], fields=f'<FIELD name="x" {field}/>')
    with pytest.raises(Exception, match="is not a"):
        read_votable(spark, path).collect()


def test_a_folder_of_documents(spark, tmp_path):
    field = '<FIELD name="x" datatype="int"/>'
    for n in range(3):
        document(tmp_path / f"{n}.vot", *[[str(10 * n + i)] for i in range(4)], fields=field)
    assert sorted(r.x for r in read_votable(spark, str(tmp_path)).collect()) == [10 * n + i for n in range(3) for i in range(4)]
    first = read_votable(spark, str(tmp_path), names="[01].vot", fields_from=str(tmp_path / "2.vot"))
    assert first.columns == ["x"] and first.count() == 8
    document(tmp_path / "other.vot", ["1"], fields='<FIELD name="y" datatype="int"/>')
    with pytest.raises(ValueError, match="differ"):
        read_votable(spark, str(tmp_path))


def test_streams_answer_as_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 400, 1, 4).selectExpr("id", "(id * 7.3D) % 360 AS ra", "(id * 3.1D) % 120 - 60 AS dec").write.parquet(source)
    batch = spark.read.parquet(source)
    stream = read_stream(spark, source, batch.schema, files_per_trigger=1)

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(row) for row in spark.table(name).collect())

    shape = Circle(100.0, 0.0, 40.0)
    wanted = sorted(tuple(r) for r in select_stream(batch, shape, "id % 2 = 0", ["id"]).collect())
    assert wanted and run(select_stream(stream, shape, "id % 2 = 0", ["id"]), "region_out") == wanted
    catalog = spark.range(300).selectExpr("id AS rid", "(id * 1.3D) % 360 AS ra", "(id * 0.7D) % 100 - 50 AS dec")
    pairs = crossmatch_stream(batch, catalog, 2.0, separation=None).select("id", "rid")
    matched = run(crossmatch_stream(stream, catalog, 2.0, separation=None).select("id", "rid"), "match_out")
    split = run(crossmatch_stream(stream, catalog, 2.0, separation=None, hot_rows=2).select("id", "rid"), "split_out")
    assert split == matched
    assert matched == sorted(tuple(r) for r in pairs.collect()) and matched
    with pytest.raises(ValueError):
        crossmatch_stream(stream, catalog, "ra")


def test_a_task_is_dealt_so_many_rows_whatever_the_table(spark, monkeypatch):
    from skyframe.sources import sinks

    monkeypatch.setattr(sinks, "TASK_ROWS", 100)
    dealt = sinks.ranged(spark.range(2_000), "id").selectExpr("spark_partition_id() AS part").groupBy("part").count().collect()
    assert len(dealt) >= 15 and max(row["count"] for row in dealt) < 400
    assert sinks.ranged(spark.range(0), "id").count() == 0
