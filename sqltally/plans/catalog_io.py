"""Registered queries for the file formats and the streaming forms.

Each query derives its input from the given tables, writes it in the kit's
format (or as several files for a stream) under ``spark.checkpoint.dir``,
and reads it back with the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.functions import text as T
from sqltally.operators import profile
from sqltally.plans import schema as S
from sqltally.plans import tables as TB
from sqltally.operators import vote
from sqltally.plans.catalog import _CANDIDATES_CTE, ORACLE, register
from sqltally.operators.keys import union_all
from sqltally.plans.catalog_schema import _columns_values, _defaults_sql
from sqltally.plans.catalog_text import _EXTRACT
from sqltally.session import scratch_path
from sqltally.sources import files, ordered, sinks
from sqltally.streaming import incremental as INC

WS = T.PY_SPACE
TURNS = 1 << 32  # ids are conversation * TURNS + turn


def _predictions(spark, sf_dir):
    r = TB.model_responses(spark, sf_dir)
    return r.select((F.col("conv_id") * TURNS + F.col("turn")).alias("question_id"),
                    T.extract_sql("response").alias("sql"),
                    F.when(F.col("conv_id") % 2 == 0, F.lit("star")).otherwise(F.lit("text")).alias("db_id"))


_PRED_ORACLE = f"""
SELECT CAST(conv_id * {TURNS} + turn AS BIGINT) AS question_id, sql,
       CASE WHEN sql IS NULL THEN NULL WHEN conv_id % 2 = 0 THEN 'star' ELSE 'text' END AS db_id,
       CASE WHEN sql IS NULL THEN 'no_sql' ELSE 'ok' END AS status
FROM ({_EXTRACT}) e
"""


@register("predictions_roundtrip", _PRED_ORACLE)
def q_predictions_roundtrip(spark, sf_dir):
    """K4 (single document, failures as 0) -> S3 (VARIANT parse, unpack)."""
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(_predictions(spark, sf_dir), path, single_document=True)
    return files.read_predictions(spark, path, fmt="document")


@register("predictions_jsonl_roundtrip", _PRED_ORACLE)
def q_predictions_jsonl_roundtrip(spark, sf_dir):
    """K4 as JSON Lines (written in parallel) -> S3 line by line."""
    path = scratch_path(spark, "predictions-jsonl")
    sinks.write_predictions(_predictions(spark, sf_dir), path)
    return files.read_predictions(spark, path, fmt="jsonl")


@register("gold_roundtrip", f"""
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS question_id,
       CASE WHEN item_id % 7 = 3 THEN NULL
            ELSE regexp_replace(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '^{WS}+', '') END AS sql,
       CASE WHEN item_id % 7 = 3 THEN NULL WHEN item_id % 2 = 0 THEN 'star' ELSE 'text' END AS db_id,
       item_id % 7 <> 3 AS ok
FROM benchmark
""")
def q_gold_roundtrip(spark, sf_dir):
    """A gold file (one ``sql<TAB>db_id`` per line, every 7th line malformed)
    written in id order, read back by line position (S4)."""
    b = TB.read(spark, sf_dir, "benchmark")
    flat = F.regexp_replace("text", "[\\t\\r\\n]", " ")
    db = F.when(F.col("item_id") % 2 == 0, F.lit("star")).otherwise(F.lit("text"))
    line = F.when(F.col("item_id") % 7 == 3, flat).otherwise(F.concat(flat, F.lit("\t"), db))
    path = scratch_path(spark, "gold")
    ordered.write_ordered(b.select("item_id", line.alias("value")), path, "item_id", "value")
    return files.read_gold(spark, path)


@register("questions_roundtrip", """
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS question_id, text AS question,
       CASE WHEN item_id % 3 = 0 THEN NULL ELSE split_part(text, '.', 1) END AS evidence,
       CASE WHEN item_id % 2 = 0 THEN 'star' ELSE 'text' END AS db_id,
       CAST(NULL AS VARCHAR) AS gold_sql,
       CASE WHEN item_id % 7 <= 2 THEN 'simple' WHEN item_id % 7 <= 4 THEN 'moderate'
            WHEN item_id % 7 = 5 THEN 'challenging' END AS difficulty
FROM benchmark
""")
def q_questions_roundtrip(spark, sf_dir):
    """A JSON array of question objects (id = position) read back."""
    q = TB.bench_questions(spark, sf_dir)
    obj = F.struct(F.col("question"), F.col("evidence"), F.col("db_id"),
                   F.lit(None).cast("string").alias("SQL"), F.col("difficulty"))
    path = scratch_path(spark, "questions")
    ordered.write_ordered(q.select("question_id", F.to_json(obj).alias("o")), path, "question_id", "o", "[", "]", ", ")
    return files.read_questions(spark, path)


@register("progress_roundtrip", f"""
SELECT CAST(conv_id * {TURNS} + turn AS BIGINT) AS idx, role || ': ' || CAST(length(text) AS VARCHAR) AS value
FROM conversations
""")
def q_progress_roundtrip(spark, sf_dir):
    """K3 appends (two runs) -> S6 (JSON Lines, VARIANT values)."""
    c = TB.read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("question_id"), "turn",
        F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("value"))
    path = scratch_path(spark, "progress")
    sinks.append_progress(c.filter(F.col("turn") < 2), path)
    sinks.append_progress(c.filter(F.col("turn") >= 2), path)
    log = files.read_progress_log(spark, path)
    return log.select("idx", F.variant_get("value", "$", "string").alias("value"))


@register("schema_roundtrip", f"""
SELECT c.db_id, c.table_name, c.column_name, c.type, c.pk AS primary_key, d."default", coalesce(d.autoincrement, false) AS autoincrement,
       'the ' || c.table_name || ' table' AS table_comment
FROM {_columns_values()} c LEFT JOIN ({_defaults_sql()}) d ON d.table_name = c.table_name AND d.column_name = c.column_name
""")
def q_schema_roundtrip(spark, sf_dir):
    """K8 schema documents, with defaults and table comments -> S9 loader."""
    dbs = S.databases(spark, sf_dir)
    cols = S.columns(spark, dbs)
    pk = S.primary_keys(spark).select("db_id", "table_name", "column_name").withColumn("primary_key", F.lit(True))
    ex = profile.clean_examples(S.examples(dbs)).groupBy("db_id", "table_name", "column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("examples"))
    full = cols.join(pk, ["db_id", "table_name", "column_name"], "left") \
               .join(ex, ["db_id", "table_name", "column_name"], "left").drop("default") \
               .join(S.defaults(S.all_tables(dbs)), ["table_name", "column_name"], "left") \
               .select("db_id", "table_name", "position", "column_name", F.col("full_type").alias("type"),
                       "primary_key", "nullable", "default", "autoincrement", "comment", "examples")
    comments = union_all([profile.table_comments(spark, d, t, {x: f"the {x} table" for x in t}) for d, t in dbs.items()])
    path = scratch_path(spark, "schema")
    sinks.save_schema(full, S.foreign_keys(spark), path, comments=comments)
    back = files.load_schema(spark, path)
    return (back["columns"].join(back["tables"].withColumnRenamed("comment", "table_comment"), ["db_id", "table_name"])
            .select("db_id", "table_name", "column_name", "type", "primary_key", "default", "autoincrement", "table_comment"))


# --- streaming forms ---

def _split_files(df, name, spark):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path, df.schema


@register("stream_clean", _EXTRACT)
def q_stream_clean(spark, sf_dir):
    """Responses arriving as files, cleaned exactly once into a sink."""
    src, schema = _split_files(TB.model_responses(spark, sf_dir), "responses-in", spark)
    sink, ckpt = scratch_path(spark, "clean-out"), scratch_path(spark, "clean-ckpt")
    INC.clean_stream(INC.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ckpt)
    return spark.read.parquet(sink)


@register("stream_accuracy", "WITH " + _CANDIDATES_CTE + """
SELECT coalesce(difficulty, 'none') AS level, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(correct) AS BIGINT) AS correct
FROM win GROUP BY 1
""")
def q_stream_accuracy(spark, sf_dir):
    """Every question's voted answer as a scored prediction, each sent
    twice (a retry), joined with the static question table; running counts
    by difficulty."""
    execs = TB.event_executions(spark, sf_dir)
    scored = vote.consensus(execs.drop("difficulty"))["winner"].select("question_id", "correct")
    src, schema = _split_files(scored.unionByName(scored), "scored-in", spark)
    # the static side is a table: written once, scanned by each micro-batch
    qpath = scratch_path(spark, "questions-static")
    TB.event_questions(execs).write.parquet(qpath)
    questions = spark.read.parquet(qpath)
    sink, ckpt = scratch_path(spark, "acc-out"), scratch_path(spark, "acc-ckpt")
    INC.accuracy_stream(INC.file_stream(spark, src, schema, max_files_per_trigger=1), questions, sink, ckpt,
                        state_partitions=spark.sparkContext.defaultParallelism)
    return INC.latest(spark, sink, ["level"])


@register("stream_votes", ORACLE["vote_groups"])
def q_stream_votes(spark, sf_dir):
    """Candidate executions arriving as files; running vote groups."""
    execs = TB.event_executions(spark, sf_dir).drop("difficulty")
    src, schema = _split_files(execs, "execs-in", spark)
    sink, ckpt = scratch_path(spark, "votes-out"), scratch_path(spark, "votes-ckpt")
    INC.vote_stream(INC.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ckpt,
                    state_partitions=spark.sparkContext.defaultParallelism)
    v = INC.latest(spark, sink, ["question_id", "fp"])
    return v.select("question_id", "fp", F.col("votes").cast("bigint").alias("votes"),
                    "first_ord", "sql", "correct")
