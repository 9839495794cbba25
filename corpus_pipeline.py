"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
`documents`; a stage's result is written as Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.decontamination import contaminated
from skyframe.llm.language import fit, identify
from skyframe.llm.lines import drop_frequent_lines
from skyframe.llm.packing import pack
from skyframe.llm.similar import first_of_similar
from skyframe.llm.tables import SPACES, remainder, scratch, stored, text_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence stay, repeated rows as often as they are
    there. Without text, or where no document to learn from has a language, none do."""
    model = fit(docs, remainder(F.col("doc_id"), 4) != 2)
    return identify(docs, model).where("accepted").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; `n_chars`, if there is one, follows the text. Every row
    stays, repeated ones and those without a text too."""
    kept = drop_frequent_lines(docs)
    changed = F.col("row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(F.when(F.col("n_dropped") > 0, changed).otherwise(F.col("row")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once.

    Near copies share 0.8 of the five-word shingles of both; close SimHash fingerprints or a shared
    MinHash band tell which are compared. Documents without an id come after
    all others, by their text. Unlike texts under one id are documents of their own; of repeated
    rows one stays, and so of all documents without a word. Other columns are not looked at.
    """
    last = F.lit((1 << 63) - 1)
    worded = F.when(F.rlike("text", F.lit(f"[^{SPACES}]")), F.col("text")).otherwise("")
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), last).alias("id"), text_key(worded).alias("key")
    )
    with scratch():
        kept = stored(first_of_similar(rows.select("id", "key", F.col("row.text").alias("text"))), "kept", keep=True)
    # Copies of a row are dropped before it moves; the join then finds rows dealt as it needs them.
    once = rows.groupBy("id", "key").agg(F.first("row").alias("row"))
    return once.join(kept, ["id", "key"], "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; others of their id, or without one as they are, stay, and
    so do those without a text, and repeated rows as often as they are there."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    leaks = stored(contaminated(keyed, benchmark).select("row.doc_id", "row.key").distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(leaks["doc_id"]) & (text_key(docs["text"]) == leaks["key"])
    return docs.join(leaks, same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of what is left in a training sequence. Without documents, none."""
    packed = pack(docs.select("doc_id", "text"))
    return packed.select("row.doc_id", *[name for name in packed.columns if name != "row"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The language model, fingerprints and passages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
