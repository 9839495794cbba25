"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.chat import conversation_nodes, format_branches, masked_texts, parsed
from skyframe.llm.decontamination import contaminated
from skyframe.llm.html import extract_main_text
from skyframe.llm.language import fit, identify
from skyframe.llm.lines import drop_frequent_lines
from skyframe.llm.packing import pack
from skyframe.llm.repair import repair_conversations, written_digest
from skyframe.llm.runs import collapse_runs
from skyframe.llm.scoring import interpolated_scores
from skyframe.llm.secrets import find_secrets, written
from skyframe.llm.simhash import near_duplicates
from skyframe.llm.tables import SPACES, remainder
from skyframe.llm.topk import top_k
from skyframe.llm.urls import ALLOW, BLOCK, Rule, judge

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    learned = remainder(F.col("doc_id"), 7) != 2
    scored = interpolated_scores(documents, learned)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        (remainder(F.col("row.doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


_TOP = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query(_TOP)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


_CHAT = r"""
WITH own AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 6 + length(role) + 1 + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + 8 AS size FROM own)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query(_CHAT)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = format_branches(conversation_nodes(rows.unionByName(extra)), keep=1)
    read_back = formatted.select(
        F.col("tree.conv_id").alias("conv_id"),
        "formatted",
        parsed(F.col("formatted")).alias("turns"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("row.doc_id", *[name for name in packed.columns if name != "row"])


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(documents, read(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "item_id", "overlap", "question_overlap", "answer_overlap")


_LINES = """
WITH doc AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc),
keyed AS (SELECT id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT id) >= 10),
kept AS (SELECT id, pos, line, key IN (SELECT key FROM frequent) AS gone FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept JOIN doc USING (id) GROUP BY id
"""


@query(_LINES)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = identify(documents.select("doc_id", "text"), fit(documents, ~held_out))
    return found.select(
        "row.doc_id",
        (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        "accepted",
    )


URL_RULES = [
    Rule("com/en/", BLOCK),
    Rule("example.com/en/7", ALLOW),
    Rule("net/de/", ALLOW),
    Rule("example.net/de/8", BLOCK),
    Rule("org/es/", BLOCK),
]


@query()
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def made_periodic(documents: DataFrame) -> DataFrame:
    """`documents` with the words of one in ten made periodic from some word on, by its id."""
    h = remainder(F.col("doc_id"), 1 << 32)
    words = F.split(F.btrim("text", F.lit(SPACES)), f"[{SPACES}]+")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    worded = F.rlike("text", F.lit(f"[^{SPACES}]"))
    return documents.withColumn("text", F.when((h % 10 == 0) & worded, changed).otherwise(F.col("text")))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = made_periodic(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = collapse_runs(documents)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", longest)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with one in five rows damaged, by its id and turn: dropped, emptied, without
    its full stops, repeated, or said by the user. Nulls are one space, but for the order by turn."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(damage == 4, "user").otherwise(filled("role"))
    copies = F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    plan, repaired = repair_conversations(damaged(conversations))
    digests = written_digest(repaired).withColumnRenamed("conv", "digested")
    plan = plan.drop("parts").join(digests, F.col("conv").eqNullSafe(F.col("digested")))
    ids = conversations.select("conv_id").distinct()
    found = ids.join(plan, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query()
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
