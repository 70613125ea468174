"""Schema descriptions as text (P7-P11), built with string and array functions.

M-Schema form (one text per database)::

    【DB_ID】 <db>
    【Schema】
    # Table: <table>[, <comment>]
    [
    (<column>:<TYPE>[, <comment>][, Primary Key][, Examples: [a, b]]),
    ...
    ]
    【Foreign keys】
    <table>.<column>=<ref_table>.<ref_column>

Example rules per column: the cleaned examples (``profile.clean_examples``),
at most ``example_num``; date/time columns show one; if the longest is over
50 characters none, over 20 characters only the first.

Inputs are the profiling frames, so text for any number of databases is
produced by two ``groupBy`` levels (column lines -> table text -> database
text); only per-table lists of column lines are collected, bounded by the
number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The section markers of the M-Schema text.
DB_MARK = "【DB_ID】"
SCHEMA_MARK = "【Schema】"
FK_MARK = "【Foreign keys】"

DATE_TYPES = ("DATE", "TIME", "DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ")


def _examples_per_column(examples: DataFrame, example_num: int) -> DataFrame:
    key = ["db_id", "table_name", "column_name"]
    agg = examples.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_ex"))
    ex = F.slice(F.transform("_ex", lambda s: s["value"]), 1, max(example_num, 1))
    longest = F.array_max(F.transform(ex, lambda v: F.length(v)))
    return agg.select(*key, ex.alias("_ex"), longest.alias("_longest"))


def column_lines(columns: DataFrame, examples: DataFrame, primary_keys: DataFrame,
                 example_num: int = 3, show_type_detail: bool = False) -> DataFrame:
    """One ``line`` per column; ``primary_keys(db_id, table_name, column_name)``."""
    key = ["db_id", "table_name", "column_name"]
    pk = primary_keys.select(*key).distinct().withColumn("_pk", F.lit(True))
    ex = _examples_per_column(examples, example_num)
    c = columns.join(pk, key, "left").join(ex, key, "left")
    typ = F.col("full_type") if show_type_detail else F.col("type")
    shown = (F.when(F.lit(example_num) <= 0, F.array().cast("array<string>"))
             .when(F.col("_ex").isNull(), F.array().cast("array<string>"))
             .when(typ.isin(*DATE_TYPES), F.slice("_ex", 1, 1))
             .when(F.col("_longest") > 50, F.array().cast("array<string>"))
             .when(F.col("_longest") > 20, F.slice("_ex", 1, 1))
             .otherwise(F.col("_ex")))
    comment = F.coalesce(F.trim("comment"), F.lit(""))
    line = F.concat(
        F.lit("("), F.col("column_name"), F.lit(":"), F.upper(typ),
        F.when(comment != "", F.concat(F.lit(", "), comment)).otherwise(F.lit("")),
        F.when(F.col("_pk"), F.lit(", Primary Key")).otherwise(F.lit("")),
        F.when(F.size(shown) > 0, F.concat(F.lit(", Examples: ["), F.array_join(shown, ", "), F.lit("]")))
         .otherwise(F.lit("")),
        F.lit(")"))
    return c.select(*key, "position", line.alias("line"))


def table_texts(lines: DataFrame, table_comments: DataFrame | None = None) -> DataFrame:
    """``db_id, table_name, text`` for each table."""
    t = lines.groupBy("db_id", "table_name").agg(
        F.sort_array(F.collect_list(F.struct("position", "line"))).alias("_l"))
    if table_comments is not None:
        t = t.join(table_comments.select("db_id", "table_name", F.col("comment").alias("_tc")),
                   ["db_id", "table_name"], "left")
    else:
        t = t.withColumn("_tc", F.lit(None).cast("string"))
    tc = F.coalesce(F.trim("_tc"), F.lit(""))
    head = F.concat(F.lit("# Table: "), F.col("table_name"),
                    F.when(tc != "", F.concat(F.lit(", "), tc)).otherwise(F.lit("")))
    body = F.array_join(F.transform("_l", lambda s: s["line"]), ",\n")
    return t.select("db_id", "table_name", F.concat_ws("\n", head, F.lit("["), body, F.lit("]")).alias("text"))


def fk_lines(foreign_keys: DataFrame) -> DataFrame:
    return foreign_keys.select(
        "db_id", "table_name", "column_name", "ref_table", "ref_column",
        F.concat_ws("", "table_name", F.lit("."), "column_name", F.lit("="),
                    "ref_table", F.lit("."), "ref_column").alias("line"))


def database_texts(tables_text: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """``db_id, text``: header, tables by name, then foreign keys if any."""
    t = tables_text.groupBy("db_id").agg(
        F.sort_array(F.collect_list(F.struct("table_name", "text"))).alias("_t"))
    if foreign_keys is not None:
        fk = fk_lines(foreign_keys).groupBy("db_id").agg(
            F.sort_array(F.collect_list(F.struct("table_name", "column_name", "line"))).alias("_f"))
        t = t.join(fk, "db_id", "left")
    else:
        t = t.withColumn("_f", F.lit(None).cast("array<struct<table_name:string,column_name:string,line:string>>"))
    tabs = F.array_join(F.transform("_t", lambda s: s["text"]), "\n")
    fks = F.when(F.size(F.coalesce("_f", F.array())) > 0,
                 F.concat(F.lit(FK_MARK + "\n"), F.array_join(F.transform("_f", lambda s: s["line"]), "\n")))
    text = F.concat_ws("\n", F.concat(F.lit(DB_MARK + " "), F.col("db_id")), F.lit(SCHEMA_MARK), tabs, fks)
    return t.select("db_id", text.alias("text"))


def render_mschema(columns: DataFrame, examples: DataFrame, primary_keys: DataFrame,
                   foreign_keys: DataFrame | None = None, table_comments: DataFrame | None = None,
                   example_num: int = 3, show_type_detail: bool = False) -> DataFrame:
    lines = column_lines(columns, examples, primary_keys, example_num, show_type_detail)
    return database_texts(table_texts(lines, table_comments), foreign_keys)


def split_selected_column(sel) -> tuple:
    """``[schema.]table.column`` -> (table part, column part), split at the last dot."""
    s = F.lower(F.col(sel) if isinstance(sel, str) else sel)
    return F.regexp_extract(s, r"^(.*)\.[^.]*$", 1), F.substring_index(s, ".", -1)


def select_subset(columns: DataFrame, foreign_keys: DataFrame | None,
                  selected_tables: DataFrame | None = None,
                  selected_columns: DataFrame | None = None):
    """Restrict columns (and foreign keys) to a selection, case-insensitive.

    ``selected_tables(db_id, name)``; ``selected_columns(db_id, name)`` with
    names ``table.column`` (columns imply their tables).  A foreign key is
    kept only when both its tables are selected.
    """
    cols = columns.withColumn("_t", F.lower("table_name")).withColumn("_c", F.lower("column_name"))
    tabs_sel = None
    if selected_columns is not None:
        t, c = split_selected_column("name")
        sc = selected_columns.select("db_id", t.alias("_t"), c.alias("_c"))
        cols = cols.join(sc.distinct(), ["db_id", "_t", "_c"], "left_semi")
        tabs_sel = sc.select("db_id", "_t").distinct()
    elif selected_tables is not None:
        tabs_sel = selected_tables.select("db_id", F.lower("name").alias("_t")).distinct()
        cols = cols.join(tabs_sel, ["db_id", "_t"], "left_semi")
    cols = cols.drop("_t", "_c")
    fks = foreign_keys
    if fks is not None and tabs_sel is not None:
        fks = (fks.withColumn("_t", F.lower("table_name"))
               .join(tabs_sel, ["db_id", "_t"], "left_semi").drop("_t")
               .withColumn("_t", F.lower("ref_table"))
               .join(tabs_sel, ["db_id", "_t"], "left_semi").drop("_t"))
    return cols, fks


def ddl_texts(columns: DataFrame, primary_keys: DataFrame | None = None,
              foreign_keys: DataFrame | None = None) -> DataFrame:
    """P10: ``db_id, table_name, text`` with a ``CREATE TABLE`` statement per
    table; every identifier in backticks (names with spaces stay valid)."""
    q = lambda c: F.concat(F.lit("`"), F.col(c) if isinstance(c, str) else c, F.lit("`"))
    col_line = F.concat(F.lit("  "), q("column_name"), F.lit(" "), F.col("full_type"),
                        F.when(~F.col("nullable"), F.lit(" NOT NULL")).otherwise(F.lit("")))
    lines = columns.select("db_id", "table_name", F.struct("position", col_line.alias("line")).alias("s"))
    extra = []
    if primary_keys is not None:
        pk = primary_keys.groupBy("db_id", "table_name").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))),
                                     lambda s: F.concat(F.lit("`"), s["column_name"], F.lit("`"))), ", ").alias("k"))
        extra.append(pk.select("db_id", "table_name", F.struct(
            F.lit(1_000_000).alias("position"),
            F.concat(F.lit("  PRIMARY KEY ("), F.col("k"), F.lit(")")).alias("line")).alias("s")))
    if foreign_keys is not None:
        extra.append(foreign_keys.select("db_id", "table_name", F.struct(
            (F.lit(2_000_000) + F.dense_rank().over(
                Window.partitionBy("db_id", "table_name").orderBy("column_name", "ref_table"))).alias("position"),
            F.concat(F.lit("  FOREIGN KEY ("), q("column_name"), F.lit(") REFERENCES "), q("ref_table"),
                     F.lit("("), q("ref_column"), F.lit(")")).alias("line")).alias("s")))
    for e in extra:
        lines = lines.unionByName(e)
    t = lines.groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list("s")).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s["line"]), ",\n")
    return t.select("db_id", "table_name",
                    F.concat(F.lit("CREATE TABLE "), q("table_name"), F.lit(" (\n"), body, F.lit("\n)")).alias("text"))


def sample_rows_text(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows (ordered by all columns, so deterministic) as
    an aligned block: header and cells right-justified to the widest entry,
    each followed by one space; NULL shows as ``None``, an array or map as
    its type and size (``array<float>[384]``).

    ``orderBy(...).limit(n)`` plans as a per-partition top-n and a merge, so
    only ``n`` rows per partition move.
    """
    names = df.columns
    cols = [F.col(f"`{c}`") for c in names]
    top = df.orderBy(*cols).limit(n)

    def cell(c, dtype):
        # arrays and maps are shown by type and size, not element by element
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            text = F.concat(F.lit(dtype.simpleString() + "["), F.size(c).cast("string"), F.lit("]"))
        elif isinstance(dtype, T.StructType):
            text = F.lit(dtype.simpleString())
        else:
            text = c.cast("string")
        return F.when(c.isNull(), F.lit("None")).otherwise(text)

    cells = top.select(F.array(*[cell(c, f.dataType) for c, f in zip(cols, df.schema.fields)]).alias("cells"),
                       F.struct(*cols).alias("_o"))
    header = F.array(*[F.lit(c) for c in names])
    agg = cells.agg(F.sort_array(F.collect_list(F.struct("_o", "cells"))).alias("_r"))
    rows = F.transform("_r", lambda s: s["cells"])
    widths = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.greatest(
        F.length(F.element_at(header, i + 1)),
        F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(F.element_at(r, i + 1)))), F.lit(0))))

    def render(arr):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.concat(
            F.lpad(F.element_at(arr, i + 1), F.element_at(widths, i + 1), " "), F.lit(" "))), "")

    text = F.concat(render(header), F.lit("\n"), F.array_join(F.transform(rows, render), "\n"))
    return agg.select(text.alias("text"))


def with_sample_rows(ddl: DataFrame, rows_text: DataFrame, n: int) -> DataFrame:
    """P10+P11: each table's DDL followed by its sample-row block.

    ``rows_text(db_id, table_name, text)`` from :func:`sample_rows_text`.
    """
    r = rows_text.select("db_id", "table_name", F.col("text").alias("_rows"))
    block = F.concat(F.lit(f" \n /* \n {n} example rows: \n SELECT * FROM `"), F.col("table_name"),
                     F.lit(f"` LIMIT {n}; \n "), F.col("_rows"), F.lit(" \n */"))
    return ddl.join(r, ["db_id", "table_name"], "left").select(
        "db_id", "table_name",
        F.when(F.col("_rows").isNull(), F.col("text")).otherwise(F.concat(F.col("text"), block)).alias("text"))


def ddl_database_texts(ddl: DataFrame) -> DataFrame:
    """P10: one DDL text per database, tables by name, separated by a blank line."""
    t = ddl.groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("table_name", "text"))).alias("_t"))
    return t.select("db_id", F.array_join(F.transform("_t", lambda s: s["text"]), "\n\n").alias("text"))
