"""Finding and splitting hot join keys, and broadcasting only what has been measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.sources.files import shared_folder

# Rows of one key that a task is given: what a task holds, whatever the table's size.
HOT_ROWS = 100_000

# Copies of one row that stay together when they are counted instead of shuffled.
COPIES = 1_000

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a join with how many ways each is split on each side, as a stored table of
    `key`, `__lways` and `__rways`; none if there is no hot key."""

    table: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.table is not None


def hot_keys(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HotKeys:
    """The values of a bigint join key that more than `hot_rows` rows of a side have.

    Counted, in one pass over the keys of both sides with partial counts before the shuffle, so a
    key is found however many others there are. The table is written to the shared folder: there
    are at most rows / hot_rows of them, which is not few at every size.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(F.col(key).alias("key"), one.alias("l"), none.alias("r")).unionByName(
        right.select(F.col(key).alias("key"), none.alias("l"), one.alias("r"))
    )
    counts = both.where("key IS NOT NULL").groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    ways = {f"__{side}ways": F.ceil(F.greatest(F.col(side), one) / hot_rows).cast("int") for side in ("l", "r")}
    hot = counts.where((F.col("l") > hot_rows) | (F.col("r") > hot_rows)).withColumns(ways).drop("l", "r")
    path = shared_folder(left.sparkSession, "hot-keys")
    hot.write.parquet(path)
    table = left.sparkSession.read.schema(hot.schema).parquet(path)
    return HotKeys(None if table.isEmpty() else table)


def _hashable(df: DataFrame) -> list[str]:
    """The flat columns: enough to tell rows apart, without reading nested ones to do it."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, nested)]


def handed_out(df: DataFrame) -> bool:
    """Whether Spark takes a table for small enough to broadcast of itself, by the sizes of files.
    Then the other side is not shuffled, and no key of it can be hot. No job is run to tell."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def ways_table(key: str, hot: HotKeys) -> DataFrame:
    """The hot keys under the name that `key` has in a join, handed out if they measure few."""
    return broadcast_if_small(hot.table.withColumnRenamed("key", key))


def salted(df: DataFrame, key: str, hot: HotKeys, side: str, own: Column | None = None) -> DataFrame:
    """One side of a join on `key`, with `__lsalt` and `__rsalt` to join on as well.

    A side's own salt is a hash of the row, the other side's salts are all written out, so every
    pair of rows meets under exactly one pair of salts. A hash and not a random number: a task
    run again after a lost executor has to send each row where it went before.
    """
    if not hot:
        return df.withColumns({"__lsalt": F.lit(0), "__rsalt": F.lit(0)})
    mine, other = ("__lways", "__rways") if side == "left" else ("__rways", "__lways")
    number = F.xxhash64(*_hashable(df.drop(key))) if own is None else own
    df = df.join(ways_table(key, hot), key, "left").withColumns(
        {
            "__own": F.coalesce(F.pmod(number, F.col(mine)), F.lit(0)).cast("int"),
            "__each": F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)),
        }
    )
    first, second = ("__own", "__each") if side == "left" else ("__each", "__own")
    return df.withColumns({"__lsalt": F.col(first), "__rsalt": F.col(second)}).drop(
        "__lways", "__rways", "__own", "__each"
    )


def _collapsed(df: DataFrame, name: str) -> DataFrame:
    """Copies of a row as one row with `name` of them, COPIES at most, and numbered chunks.

    Copies hash alike, so a hash cannot part them; counted, before they are shuffled, they are
    parted by chunk. What cannot be grouped by, a map, is left as it is.
    """
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields):
        return df.withColumns({name: F.lit(1).cast("bigint"), f"{name}_chunk": F.lit(0).cast("bigint")})
    columns = [F.col(f"`{column}`") for column in df.columns]
    counted = df.groupBy(*columns).agg(F.count("*").alias("__all"))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__all") - 1) / COPIES))
    counted = counted.select(*columns, "__all", F.explode(chunks).alias(f"{name}_chunk"))
    size = F.least(F.lit(COPIES).cast("bigint"), F.col("__all") - F.col(f"{name}_chunk") * COPIES)
    return counted.withColumn(name, size).drop("__all")


def split_join(left: DataFrame, right: DataFrame, key: str, right_key: str, residual: Column, hot: HotKeys) -> DataFrame:
    """The inner join on `key` and `residual`, its hot keys apart from the rest.

    Cold keys are an ordinary equi-join. Hot ones have their copies counted, are salted on both
    sides, and each pair found is written out as often as its two rows had copies.
    """
    plain = F.col(key) == F.col(right_key)
    if not hot:
        return left.join(right, plain & residual)
    names = [*left.columns, *right.columns]
    keys = ways_table(key, hot).select(key)
    right_keys = ways_table(right_key, hot).select(right_key)
    cold = left.join(keys, key, "left_anti").join(right.join(right_keys, right_key, "left_anti"), plain & residual)

    def side(df: DataFrame, on: str, wanted: DataFrame, which: str) -> DataFrame:
        few = _collapsed(df.join(wanted, on, "left_semi"), f"__{which}_copies")
        chunk = f"__{which}_copies_chunk"
        spread = F.xxhash64(*_hashable(few.drop(on, chunk))) + F.col(chunk)
        few = salted(few, on, hot, which, own=spread).drop(chunk)
        return few.withColumnsRenamed({salt: f"{which}{salt}" for salt in ("__lsalt", "__rsalt")})

    a, b = side(left, key, keys, "left"), side(right, right_key, right_keys, "right")
    on = plain & residual
    for salt in ("__lsalt", "__rsalt"):
        on = on & (F.col(f"left{salt}") == F.col(f"right{salt}"))
    copies = F.col("__left_copies") * F.col("__right_copies")
    pairs = a.join(b, on).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    quoted = [F.col(f"`{name}`") for name in names]
    return cold.select(*quoted).unionByName(pairs.select(*quoted))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """`left` with the columns of a table that has one row per key, nulls being a key too.

    A hot key's rows have their copies counted, which a hash could not part, are split, and meet a
    copy each of the one row there is; then each is written out as often as it was there.
    """
    added = [name for name in right.columns if name not in keys]
    columns = [F.col(f"a.`{name}`") for name in left.columns] + [F.col(f"b.`{name}`") for name in added]
    left = left.withColumn("__key", F.xxhash64(*keys))
    right = right.withColumn("__key", F.xxhash64(*keys))
    spared = hot_rows >= HOT_ROWS and handed_out(right)
    hot = HotKeys() if spared else hot_keys(left, right.limit(0), "__key", hot_rows)
    on = F.col("a.__key") == F.col("b.__key")
    for key in keys:
        on = on & F.col(f"a.`{key}`").eqNullSafe(F.col(f"b.`{key}`"))
    if not hot:
        return left.alias("a").join(right.alias("b"), on, "left").select(*columns)
    wanted = ways_table("__key", hot).select("__key")
    cold = left.join(wanted, "__key", "left_anti").alias("a").join(right.alias("b"), on, "left").select(*columns)
    few = _collapsed(left.join(wanted, "__key", "left_semi"), "__copies")
    spread = F.xxhash64(*_hashable(few.drop("__key", "__copies_chunk"))) + F.col("__copies_chunk")
    few = salted(few, "__key", hot, "left", own=spread).alias("a")
    on = on & (F.col("a.__lsalt") == F.col("b.__lsalt"))
    found = few.join(salted(right, "__key", hot, "right").alias("b"), on, "left")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("a.__copies")))
    return cold.unionByName(found.select(*columns, copies.alias("__copy")).drop("__copy"))


def _row_bytes(df: DataFrame) -> Column:
    widths = []
    for f in df.schema.fields:
        name = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(name), F.lit(0)) + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16)
        else:
            widths.append(F.lit(16))
    total = F.lit(0).cast("bigint")
    for width in widths:
        total = total + width
    return total


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has been measured to be small enough to hand to every executor."""
    measured = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("bytes")
    ).first()
    return measured.n <= max_rows and (measured.bytes or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds) -> DataFrame:
    return F.broadcast(df) if small(df, **bounds) else df
