"""How the driver's tables stand in for the evaluation data model.

Every frame here is derived from the given Parquet tables with built-in
expressions, so its size grows with them:

* ``events`` -> candidate executions: ``question_id = floor(event_id / 16)``,
  ``ord = event_id % 16``, result fingerprint = ``event_type``, a candidate is
  invalid when its type is ``error``;
* gold result per question: ``question_id % 5`` picks click, view, signup,
  purchase or the empty result;
* difficulty: ``question_id % 7``: 0-2 simple, 3-4 moderate, 5 challenging,
  6 missing;
* ``benchmark`` -> questions; ``conversations`` -> raw model responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.session import table_path

# Fixed values of the stand-in mapping.
CANDIDATES_PER_QUESTION = 16
GOLD_RESULTS = ["click", "view", "signup", "purchase"]  # position 4 = empty result
EMPTY_GOLD_POS = 4
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TEXT_TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def difficulty_of(qid: Column) -> Column:
    m = qid % 7
    return (F.when(m <= 2, F.lit("simple"))
            .when(m <= 4, F.lit("moderate"))
            .when(m == 5, F.lit("challenging")))


def gold_fp_of(qid: Column) -> Column:
    pos = (qid % 5).cast("int")
    return F.when(pos == EMPTY_GOLD_POS, F.lit("empty")).otherwise(
        F.element_at(F.array(*[F.lit(g) for g in GOLD_RESULTS]), pos + 1))


def event_executions(spark: SparkSession, sf_dir: str,
                     n: int = CANDIDATES_PER_QUESTION) -> DataFrame:
    """Candidate executions with voting correctness (empty gold never right)."""
    ev = read(spark, sf_dir, "events").select("event_id", "event_type")
    qid = F.expr(f"event_id div {int(n)}").cast("bigint")
    valid = F.coalesce(F.col("event_type") != F.lit("error"), F.lit(False))
    gold_pos = (qid % 5).cast("int")
    correct = valid & (gold_pos != EMPTY_GOLD_POS) & (F.col("event_type") == gold_fp_of(qid))
    return ev.select(
        qid.alias("question_id"),
        (F.col("event_id") % F.lit(n)).cast("int").alias("ord"),
        F.concat(F.lit("SELECT '"), F.col("event_type"), F.lit("' /* candidate "),
                 F.col("event_id").cast("string"), F.lit(" */")).alias("sql"),
        valid.alias("valid"),
        F.col("event_type").alias("fp"),
        F.coalesce(correct, F.lit(False)).cast("int").alias("correct"),
        difficulty_of(qid).alias("difficulty"),
    )


def event_questions(execs: DataFrame) -> DataFrame:
    """One row per question of the candidate frame, with its difficulty."""
    return execs.groupBy("question_id").agg(F.first("difficulty").alias("difficulty"))


def with_difficulty(scores: DataFrame) -> DataFrame:
    return scores.withColumn("difficulty", difficulty_of(F.col("question_id")))

# Columns of the given tables (name, Spark type), in file order.
TABLE_COLUMNS = {
    "region": [("r_regionkey", "INT"), ("r_name", "STRING")],
    "nation": [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_nationkey", "INT"),
                 ("c_acctbal", "DOUBLE"), ("c_mktsegment", "STRING")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "STRING"), ("s_nationkey", "INT"),
                 ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INT"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "STRING"),
               ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP_NTZ"), ("o_orderpriority", "STRING")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"),
                 ("l_linenumber", "INT"), ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"),
                 ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"), ("l_returnflag", "STRING"),
                 ("l_linestatus", "STRING"), ("l_shipdate", "TIMESTAMP_NTZ")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP_NTZ"), ("user_id", "BIGINT"), ("event_type", "STRING"),
               ("value", "DOUBLE"), ("props", "STRING")],
    "documents": [("doc_id", "BIGINT"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"),
                  ("n_chars", "BIGINT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "ARRAY<FLOAT>"), ("label", "INT")],
    "pages": [("page_id", "BIGINT"), ("url", "STRING"), ("html", "STRING")],
    "benchmark": [("item_id", "BIGINT"), ("text", "STRING")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INT"), ("toxic", "INT")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "STRING"), ("text", "STRING")],
}

# Declared keys of the two stand-in databases.
PRIMARY_KEYS = [
    ("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("customer", ["c_custkey"]),
    ("supplier", ["s_suppkey"]), ("part", ["p_partkey"]), ("orders", ["o_orderkey"]),
    ("events", ["event_id"]), ("documents", ["doc_id"]), ("embeddings", ["vec_id"]),
    ("pages", ["page_id"]), ("benchmark", ["item_id"]), ("conversations", ["conv_id", "turn"]),
]
CANDIDATE_KEYS = [("lineitem", ["l_orderkey", "l_linenumber"])]  # expected not to hold
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def db_of(table: str) -> str:
    return "star" if table in STAR_TABLES else "text"


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model responses from the assistant turns of ``conversations``:
    the text wrapped in a fenced ``sql`` block with a trailing comment, except
    every third turn, left bare (a response without a statement)."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    bare = ((F.col("conv_id") + F.col("turn")) % 3) == 0
    resp = F.when(bare, F.col("text")).otherwise(
        F.concat(F.lit("```sql\n"), F.col("text"), F.lit(" -- generated\n```")))
    return c.select("conv_id", "turn", resp.alias("response"))


def reasoning_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<think>`` / ``<answer>`` responses: the user turn's text as the
    reasoning of the next assistant turn; every third one lacks the tags."""
    c = read(spark, sf_dir, "conversations")
    bare = ((F.col("conv_id") + F.col("turn")) % 3) == 0
    resp = F.when(bare, F.col("text")).otherwise(F.concat(
        F.lit("<think>\n"), F.col("text"), F.lit("\n</think>\n<answer> "),
        F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit(" </answer>")))
    return c.select("conv_id", "turn", resp.alias("response"))


def bench_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from ``benchmark``: database ``star`` or ``text`` by parity,
    the first sentence as evidence except for every third item."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("question_id"),
        F.when(F.col("item_id") % 2 == 0, F.lit("star")).otherwise(F.lit("text")).alias("db_id"),
        F.col("text").alias("question"),
        F.when(F.col("item_id") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring_index("text", ".", 1)).alias("evidence"),
        difficulty_of(F.col("item_id")).alias("difficulty"))


def echo_model(prompts: list, n: int) -> list:
    """Deterministic stand-in for a model callable (tests and registered
    queries): candidate j of a prompt is a statement naming j and the
    prompt length."""
    return [[f"```sql\nSELECT {j} AS candidate, {len(p)} AS prompt_chars\n```" for j in range(n)]
            for p in prompts]


# Executors import this module to find the stand-ins; the catalogs read the
# workload's file as they are imported, which executors don't have.

def thinking_model(texts: list, n: int) -> list:
    """A stand-in model: the answer's tags are there for every other length of prompt only."""
    return [[f"<think> {len(t)} </think> <answer> SELECT {j} </answer>" if len(t) % 2 else f"SELECT {j}" for j in range(n)] for t in texts]


def no_model(texts: list, n: int) -> list:
    raise AssertionError("asked again")
