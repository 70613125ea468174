"""Writers for the evaluation kit's files (K1-K9).

``write_*_if_absent`` keep an existing output as the kit does (``ignore``
mode); everything else defaults to failing on an existing path.  Keyed forms
(JSON Lines, Parquet) are the default; a single document is written as
numbered parts, range by range (``sources.ordered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.functions.text import pack
from sqltally.sources.ordered import write_ordered


def write_json_if_absent(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("ignore").json(path)


def write_text_if_absent(df: DataFrame, path: str, column: str = "value") -> None:
    """K2: one line per row of ``column``."""
    df.select(F.col(column).alias("value")).write.mode("ignore").text(path)


def append_progress(df: DataFrame, path: str, idx: str = "question_id", value: str = "value") -> None:
    """K3: append ``{"<idx>": value}`` lines (JSON Lines progress log)."""
    line = F.to_json(F.create_map(F.col(idx).cast("string"), F.col(value)))
    df.select(line.alias("value")).write.mode("append").text(path)


def packed_predictions(df: DataFrame, idx: str = "question_id", sql: str = "sql",
                       db_id: str = "db_id") -> DataFrame:
    """C4 over a frame: ``question_id, packed`` (NULL where there is no SQL)."""
    return df.select(F.col(idx).alias("question_id"), pack(F.col(sql), F.col(db_id)).alias("packed"))


def write_predictions(df: DataFrame, path: str, single_document: bool = False,
                      mode: str = "errorifexists") -> None:
    """K4: predictions ``{idx: packed}``; a missing statement is written as
    the number ``0``, as the kit does.

    Default: JSON Lines, one ``{"idx": value}`` per question, written in
    parallel.  ``single_document=True``: one object sorted by id, in numbered
    parts that make the document when put together.
    """
    p = packed_predictions(df)
    as_json = F.regexp_extract(F.to_json(F.array("packed")), r"(?s)^\[(.*)\]$", 1)
    value = F.when(F.col("packed").isNull(), F.lit("0")).otherwise(as_json)
    entry = F.concat(F.lit('"'), F.col("question_id").cast("string"), F.lit('": '), value)
    if not single_document:
        p.select(F.concat(F.lit("{"), entry, F.lit("}")).alias("value")).write.mode(mode).text(path)
        return
    write_ordered(p.select("question_id", entry.alias("e")), path, "question_id", "e", "{", "}", ", ", mode)


def save_schema(columns: DataFrame, foreign_keys: DataFrame, path: str, mode: str = "errorifexists",
                comments: DataFrame | None = None) -> None:
    """K8: one schema document per database (``db_id, schema, tables,
    foreign_keys``), tables and fields as JSON objects keyed by name.

    ``columns`` may hold ``default`` and ``autoincrement``; ``comments(db_id,
    table_name, comment)`` are those of the tables."""
    given = lambda name, other: F.col(name) if name in columns.columns else other
    field = F.struct(F.col("type"), F.coalesce(F.col("primary_key"), F.lit(False)).alias("primary_key"),
                     F.col("nullable"), given("default", F.lit(None)).cast("string").alias("default"),
                     F.coalesce(given("autoincrement", F.lit(False)), F.lit(False)).alias("autoincrement"),
                     F.coalesce(F.col("comment"), F.lit("")).alias("comment"),
                     F.coalesce(F.col("examples"), F.array().cast("array<string>")).alias("examples"))
    if comments is None:
        comments = columns.select("db_id", "table_name", F.lit("").alias("comment")).distinct()
    tables = (columns.groupBy("db_id", "table_name")
              .agg(F.map_from_entries(F.transform(
                  F.sort_array(F.collect_list(F.struct("position", "column_name", field.alias("f")))),
                  lambda s: F.struct(s["column_name"], s["f"]))).alias("fields"))
              .join(comments.select("db_id", "table_name", "comment"), ["db_id", "table_name"], "left")
              .select("db_id", "table_name", F.struct(
                  "fields", F.array().cast("array<string>").alias("examples"),
                  F.coalesce("comment", F.lit("")).alias("comment")).alias("t")))
    by_name = lambda a, b: F.when(a["table_name"] < b["table_name"], -1).when(
        a["table_name"] > b["table_name"], 1).otherwise(0)
    per_db = tables.groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("table_name", "t")), by_name)).alias("tables"))
    fks = foreign_keys.groupBy("db_id").agg(F.sort_array(F.collect_list(F.array(
        "table_name", "column_name", F.lit(None).cast("string"), "ref_table", "ref_column"))).alias("foreign_keys"))
    out = per_db.join(fks, "db_id", "left").select(
        "db_id", F.lit(None).cast("string").alias("schema"), "tables",
        F.coalesce("foreign_keys", F.array().cast("array<array<string>>")).alias("foreign_keys"))
    out.write.mode(mode).json(path)
