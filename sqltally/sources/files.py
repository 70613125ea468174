"""Readers for the evaluation kit's files.

Position-keyed files (a JSON array of questions, a gold file with one
statement per line, a single ``{"idx": sql}`` document) carry their id only
as a position.  They are split at byte ranges all the same, and positions
come from sums over the splits (see ``sources.ordered``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions.text import strip_py, unpack
from sqltally.sources.ordered import json_elements, numbered_lines

QUESTION_FIELDS = ("question STRING, evidence STRING, db_id STRING, SQL STRING, difficulty STRING")


def read_questions(spark: SparkSession, path: str, fmt: str = "json_array") -> DataFrame:
    """``question_id, question, evidence, db_id, gold_sql, difficulty``.

    ``json_array``: the id is the position in the array; ``jsonl`` and
    ``parquet`` must carry ``question_id``.
    """
    if fmt == "json_array":
        q = json_elements(spark, path).select(F.col("position").alias("question_id"),
                                              F.from_json("element", QUESTION_FIELDS).alias("q")).select("question_id", "q.*")
    elif fmt == "jsonl":
        q = spark.read.schema(f"question_id BIGINT, {QUESTION_FIELDS}").json(path)
    else:
        q = spark.read.parquet(path)
    return q.select("question_id", "question", "evidence", "db_id",
                    F.col("SQL").alias("gold_sql"), "difficulty")


def db_file_path(root: str, db_id) -> F.Column:
    """``<root>/<db_id>/<db_id>.sqlite`` as a column (for reports)."""
    c = F.col(db_id) if isinstance(db_id, str) else db_id
    return F.concat(F.lit(root.rstrip("/") + "/"), c, F.lit("/"), c, F.lit(".sqlite"))


def _as_map(col: str) -> F.Column:
    """A JSON object as ``MAP<STRING, VARIANT>``: values keep their JSON type."""
    return F.variant_get(F.parse_json(col), "$", "map<string,variant>")


def read_predictions(spark: SparkSession, path: str, fmt: str = "document") -> DataFrame:
    """S3: packed predictions -> ``question_id, sql, db_id, status``.

    A non-text value (the kit writes ``0``) is status ``no_sql``; text without
    exactly one separator is ``malformed``; otherwise ``ok``.  Values are
    parsed as VARIANT so their JSON type stays visible.
    ``fmt``: ``document`` (one JSON object; of a repeated key the last entry
    counts) or ``jsonl`` (one object per line).
    """
    if fmt == "document":
        entry = F.concat(F.lit("{"), "element", F.lit("}"))
        src = json_elements(spark, path).select("position", entry.alias("value"))
        kv = src.select("position", F.explode(_as_map("value")).alias("key", "v"))
        kv = kv.groupBy("key").agg(F.max_by("v", "position").alias("v"))
    else:
        kv = spark.read.text(path).select(F.explode(_as_map("value")).alias("key", "v"))
    is_text = F.schema_of_variant("v") == "STRING"
    packed = F.when(is_text, F.variant_get("v", "$", "string"))
    u = kv.select(F.col("key").cast("bigint").alias("question_id"), packed.alias("packed")) \
          .withColumn("u", unpack("packed"))
    status = (F.when(F.col("packed").isNull(), F.lit("no_sql"))
              .when(~F.col("u.ok"), F.lit("malformed")).otherwise(F.lit("ok")))
    return u.select("question_id", F.col("u.sql").alias("sql"), F.col("u.db_id").alias("db_id"),
                    status.alias("status"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One ``sql<TAB>db_id`` per line; the line number (0-based) is the id.

    Lines that do not split into exactly two parts get ``ok = false`` instead
    of failing the run.
    """
    lines = numbered_lines(spark, path)
    parts = F.split(strip_py(F.col("value")), "\t", -1)
    ok = F.size(parts) == 2
    return lines.select(F.col("position").alias("question_id"),
                        F.when(ok, parts[0]).alias("sql"), F.when(ok, parts[1]).alias("db_id"),
                        ok.alias("ok"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, newline removed (``value``)."""
    return spark.read.text(path)


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines ``{"<idx>": value}`` -> ``idx, value (VARIANT)``; a
    repeated idx keeps its last record: files by their time of writing (their
    names are random), records of a file by their place in it."""
    m = F.col("_metadata")
    src = spark.read.text(path).select(
        m["file_modification_time"].alias("_t"), m["file_name"].alias("_f"), m["file_block_start"].alias("_b"),
        F.monotonically_increasing_id().alias("_o"), "value")
    kv = src.select("_t", "_f", "_b", "_o", F.explode(_as_map("value")).alias("key", "v"))
    return kv.groupBy(F.col("key").cast("bigint").alias("idx")).agg(
        F.max_by("v", F.struct("_t", "_f", "_b", "_o")).alias("value"))


def cached_table(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                 mode: str = "errorifexists") -> DataFrame:
    """Read the Parquet table at ``path`` if present, else compute, write
    and read it back.  Put everything the result depends on into ``path``
    (e.g. a hash of the database list) so a stale table is never reused."""
    try:
        spark.read.text(f"{path}/_SUCCESS")  # a finished write
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    compute().write.mode(mode).parquet(path)
    return spark.read.parquet(path)


_FIELD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("primary_key", T.BooleanType()),
    T.StructField("nullable", T.BooleanType()), T.StructField("default", T.StringType()),
    T.StructField("autoincrement", T.BooleanType()), T.StructField("comment", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StringType()))])
_TABLE = T.StructType([
    T.StructField("fields", T.MapType(T.StringType(), _FIELD)),
    T.StructField("examples", T.ArrayType(T.StringType())), T.StructField("comment", T.StringType())])
SCHEMA_DUMP = T.StructType([
    T.StructField("db_id", T.StringType()), T.StructField("schema", T.StringType()),
    T.StructField("tables", T.MapType(T.StringType(), _TABLE)),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.StringType())))])


def load_schema(spark: SparkSession, path: str, multi_line: bool = False) -> dict:
    """Saved schema documents -> ``columns``, ``foreign_keys`` and ``tables`` frames.

    ``multi_line=False`` reads one document per line (as ``save_schema``
    writes them, split across tasks); ``True`` reads pretty-printed files
    holding one document each.

    Field order inside a table is not kept by a JSON map; ``position`` is
    therefore the order of field names.
    """
    doc = spark.read.schema(SCHEMA_DUMP).option("multiLine", str(multi_line).lower()).json(path)
    t = doc.select("db_id", F.explode("tables").alias("table_name", "t"))
    cols = t.select("db_id", "table_name", F.posexplode(F.map_entries("t.fields")).alias("position", "f")) \
            .select("db_id", "table_name", "position", F.col("f.key").alias("column_name"),
                    F.col("f.value.type").alias("type"), F.col("f.value.primary_key").alias("primary_key"),
                    F.col("f.value.nullable").alias("nullable"), F.col("f.value.default").alias("default"),
                    F.col("f.value.autoincrement").alias("autoincrement"), F.col("f.value.comment").alias("comment"),
                    F.col("f.value.examples").alias("examples"))
    fks = doc.select("db_id", F.explode("foreign_keys").alias("fk")).select(
        "db_id", F.col("fk")[0].alias("table_name"), F.col("fk")[1].alias("column_name"),
        F.col("fk")[3].alias("ref_table"), F.col("fk")[4].alias("ref_column"))
    return {"columns": cols, "foreign_keys": fks,
            "tables": t.select("db_id", "table_name", F.col("t.comment").alias("comment"))}
