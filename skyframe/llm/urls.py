"""URL filters: listed rules first, and gradient-boosted trees where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import LOWER, UPPER, stored

BLOCK, ALLOW = "block", "allow"
# Labelled URLs that the trees are fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 20, 4


@dataclass(frozen=True)
class Rule:
    """A host with what a path begins with, as in `example.com/news/`, and what it decides."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for
    null and for what has no `://`."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty as `host_of` is."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of size, pattern and verdict; null if none does.

    A rule fits its host and all hosts below it, if the path begins with the rule's. Of rules of
    one length the one that sorts last wins, which can only be one written twice.
    """
    fits = [
        F.when(
            ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path)),
            F.struct(F.lit(len(rule.pattern)).alias("size"), F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict")),
        )
        for rule in rules
    ]
    return F.array_max(F.array(*fits))


def _ratio(text: Column, pattern: str) -> Column:
    size = F.char_length(text)
    return F.when(size > 0, F.char_length(F.regexp_replace(text, pattern, "")) / size).otherwise(0.0)


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters that URLs are made of, in bits."""
    size = F.char_length(text)
    counts = F.transform(
        F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#&=%:+@"]),
        lambda c: (size - F.char_length(F.replace(text, c, F.lit("")))) / size,
    )
    bits = F.aggregate(counts, F.lit(0.0), lambda total, p: total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.when(size > 0, bits).otherwise(0.0)


def _suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers about the spelling of a URL."""
    whole = F.lower(F.coalesce(url, F.lit("")))
    query = F.regexp_extract(whole, r"(?s)\?([^#]*)", 1)
    count = lambda text, mark: F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))
    named = {
        "length": F.char_length(whole),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "labels": count(host, "."),
        "depth": count(path, "/"),
        "digit_ratio": _ratio(whole, r"[^0-9]"),
        "host_digit_ratio": _ratio(host, r"[^0-9]"),
        "sign_ratio": _ratio(whole, r"[a-z0-9]"),
        "host_hyphens": count(host, "-"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(F.lower(path)),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "fragment": F.contains(whole, F.lit("#")).cast("int"),
        "secure": F.startswith(whole, F.lit("https:")).cast("int"),
        "first_number": F.coalesce(F.try_to_number(F.regexp_extract(path, r"([0-9]{1,9})", 1), F.lit("999999999")).cast("double"), F.lit(-1.0)),
        "last_extension": F.char_length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
    }
    return {name: column.cast("double") for name, column in named.items()}


@dataclass
class UrlModel:
    """Trees, or the one verdict that all labelled URLs had, and how often suffixes were blocked."""

    trees: GBTClassificationModel | None
    only: str
    suffixes: DataFrame


def _inputs(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """`rows` with a vector of their features. Suffixes grow with the input: whether they are handed
    out is left to Spark, by their size."""
    found = features(F.col("url"), F.col("host"), F.col("path"))
    given = rows.withColumn("suffix", _suffix(F.col("host"))).join(suffixes, "suffix", "left")
    given = given.withColumns(
        {
            **found,
            "suffix_blocked": F.coalesce("suffix_blocked", F.lit(0.5)),
            "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0)),
        }
    )
    names = [*found, "suffix_blocked", "suffix_seen"]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(given)
    return assembled.drop(*names, "suffix")


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> UrlModel:
    """Trees from (url, host, path, verdict), on at most `rows` distinct URLs: those whose hashes
    are lowest, in parts of them that the number of URLs decides. What is known of suffixes is
    counted over all rows."""
    spark = labelled.sparkSession
    known = labelled.where(F.col("url").isNotNull() & F.col("verdict").isin(BLOCK, ALLOW))
    total = known.count()
    share = min(1.0, 1.5 * rows / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy("url").agg(*[F.max(name).alias(name) for name in ("host", "path", "verdict")])
    sample = stored(drawn.orderBy(F.xxhash64("url"), "url").limit(rows), "labelled-urls")
    sample = sample.withColumn("label", (F.col("verdict") == BLOCK).cast("double"))
    blocked = F.count_if(F.col("verdict") == BLOCK)
    suffixes = known.groupBy(_suffix(F.col("host")).alias("suffix")).agg(
        ((blocked + 1) / (F.count("*") + 2)).alias("suffix_blocked"), F.log1p(F.count("*")).alias("suffix_seen")
    )
    suffixes = stored(suffixes, "url-suffixes")
    labels = [row["verdict"] for row in sample.select("verdict").distinct().collect()]
    if len(labels) < 2:
        return UrlModel(None, labels[0] if labels else ALLOW, suffixes)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, checkpointInterval=-1)
    return UrlModel(learner.fit(_inputs(sample, suffixes).select("features", "label")), ALLOW, suffixes)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of `pages`, its columns in a struct `row`, with `host`, `path`, `rule` and `verdict`.

    The verdict is that of the longest rule that fits; `rule` is its pattern. Elsewhere it is the
    trees', which learn from the URLs that rules decide. Where rules decide none, or all alike,
    that one verdict holds, and `allow` where there is nothing to learn from. A null URL, or one
    without `://`, has an empty host and path. Repeated rows are judged alike. An empty table gives
    an empty one. Rules are a list that the driver holds, and are compared one by one.
    """
    address = F.col(f"`{url}`").cast("string")
    source = pages.select(F.struct("*").alias("row"), address.alias("url"), host_of(address).alias("host"), path_of(address).alias("path"))
    decided = source.withColumn("decision", rule_for(F.col("host"), F.col("path"), rules))
    labelled = decided.where("decision IS NOT NULL").select("url", "host", "path", F.col("decision.verdict").alias("verdict"))
    model = fit(labelled, rows)
    if model.trees is None:
        other = F.lit(model.only)
    else:
        decided = model.trees.transform(_inputs(decided, model.suffixes))
        other = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("decision.verdict"), other)
    return decided.select("row", "host", "path", F.col("decision.pattern").alias("rule"), verdict.alias("verdict"))
