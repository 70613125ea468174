"""Incremental forms of cleaning, accuracy and vote counting.

The kit's append-only progress log becomes a Structured Streaming query with
a checkpoint: each new input file is processed exactly once, and a restarted
query resumes from its checkpoint instead of counting lines.

* :func:`clean_stream` - new responses -> cleaned statements, appended to a
  Parquet sink (stateless).
* :func:`accuracy_stream` - scored predictions joined with the static
  question table, duplicates (retries) dropped by id, running counts per
  difficulty.
* :func:`vote_stream` - running vote groups per (question, result).

Stateful outputs use ``update`` mode and ``foreachBatch``: every micro-batch
appends only the groups it changed, tagged with its batch id; the current
state is the latest row per key (:func:`latest`).  State is bounded by the
number of questions / vote groups; the data model has no event time, so no
watermark applies (with an arrival time, ``dropDuplicatesWithinWatermark``
would bound it further).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.functions.text import extract_sql


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def clean_stream(responses: DataFrame, sink: str, checkpoint: str,
                 keys: tuple = ("conv_id", "turn")) -> None:
    """Run to completion on what is available (``availableNow``)."""
    out = responses.select(*keys, extract_sql(F.col("response")).alias("sql"))
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _append_batches(agg: DataFrame, sink: str, checkpoint: str,
                    state_partitions: int | None = None) -> None:
    """``state_partitions`` fixes the number of state-store partitions of a
    new query (recorded in its checkpoint; later restarts keep it).  It is
    applied only while the query starts: the query runs on its own copy of
    the session settings, and the caller's setting is restored."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(sink)

    spark = agg.sparkSession
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (agg.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Current state of an update-mode sink: the last batch's row per key."""
    d = spark.read.parquet(sink)
    vals = [c for c in d.columns if c not in keys and c != "batch_id"]
    agg = d.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("s"))
    return agg.select(*keys, *[F.col(f"s.{c}").alias(c) for c in vals])


def accuracy_stream(scored: DataFrame, questions: DataFrame, sink: str, checkpoint: str,
                    score_col: str = "correct", state_partitions: int | None = None) -> None:
    """``scored`` (stream of ``question_id, correct``) joined with static
    ``questions(question_id, difficulty)``; each question counts once."""
    s = scored.dropDuplicates(["question_id"]).join(questions, "question_id")
    level = F.coalesce(F.col("difficulty"), F.lit("none")).alias("level")
    agg = s.groupBy(level).agg(F.count(F.lit(1)).alias("n"),
                               F.sum(F.col(score_col).cast("bigint")).alias("correct"))
    _append_batches(agg, sink, checkpoint, state_partitions)


def vote_stream(execs: DataFrame, sink: str, checkpoint: str,
                state_partitions: int | None = None) -> None:
    """Running ``votes, first_ord, sql`` per (question, result)."""
    agg = (execs.filter(F.col("valid")).groupBy("question_id", "fp")
           .agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first_ord"),
                F.min_by("sql", "ord").alias("sql"), F.max("correct").alias("correct")))
    _append_batches(agg, sink, checkpoint, state_partitions)
