"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import SPACES, ascii_lower, stored

FREQUENT_DOCUMENTS = 10
LEAST_LENGTH = 1


def line_key(line: Column) -> Column:
    """A line as it is compared: stripped at both ends, A-Z lower-cased."""
    return F.btrim(ascii_lower(line), F.lit(SPACES))


def _hashes(value: Column, name: str) -> list[Column]:
    """128 bits, as two hashes of different seeds: equal only for equal values, in practice."""
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(1), value).alias(f"{name}2")]


def drop_frequent_lines(
    documents: DataFrame,
    text: str = "text",
    at_least: int = FREQUENT_DOCUMENTS,
    least_length: int = LEAST_LENGTH,
) -> DataFrame:
    """Every row of `documents`, its columns as they are, in a struct `row`, with `n_lines`,
    `n_dropped` and `kept_text`.

    A line goes, everywhere, if its key has `least_length` code points and is found in `at_least`
    rows. A row counts once for a key, however often the line stands in it; repeated rows count
    each. A text is one line at least: a null or empty one is one empty line, and gives an empty
    text. A text that loses all its lines becomes empty too. An empty table gives an empty one.

    Lines are exploded, but only their hashes move. Which positions to drop depends on the text
    alone, so copies share one answer, found by the text's hash, and each text is shuffled once,
    to meet it. Counts are summed before they are shuffled. Both joins read stored tables on the
    small side, so that adaptive execution can split a very common line or text.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    keys = F.transform(lines, line_key)

    each = documents.select(F.explode(F.array_distinct(keys)).alias("key")).where(F.char_length("key") >= least_length)
    counts = each.select(*_hashes(F.col("key"), "h")).groupBy("h1", "h2").count()
    frequent = stored(counts.where(F.col("count") >= at_least).select("h1", "h2"), "frequent-lines")

    # The text is hashed before its lines are exploded, not for each of them.
    places = documents.select(*_hashes(whole, "t"), keys.alias("keys")).select("t1", "t2", F.posexplode("keys").alias("at", "key"))
    places = places.where(F.char_length("key") >= least_length).select("t1", "t2", "at", *_hashes(F.col("key"), "h"))
    found = places.join(frequent, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("drop"))
    dropped = stored(found, "dropped-lines")

    rows = documents.select(F.struct("*").alias("row"), whole.alias("whole"), *_hashes(whole, "t"))
    rows = rows.join(dropped, ["t1", "t2"], "left").withColumn("lines", F.split("whole", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept_text = F.array_join(F.transform(kept, lambda at: F.get("lines", at)), "\n")
    return rows.select(
        "row",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("whole")).otherwise(kept_text).alias("kept_text"),
    )
