"""Plan: profile the given tables as two databases and describe them as text.

``star`` = region ... lineitem, ``text`` = the other seven tables.  Declared
keys are the fixed lists in :mod:`sqltally.plans.tables`; they are checked
against the data before they are printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.operators import keys, profile, schema_text
from sqltally.plans import tables as TB
from sqltally.session import checkpoint_dir


def databases(spark: SparkSession, sf_dir: str) -> dict:
    dbs: dict = {"star": {}, "text": {}}
    for t in TB.STAR_TABLES + TB.TEXT_TABLES:
        dbs[TB.db_of(t)][t] = TB.read(spark, sf_dir, t)
    return dbs


def all_tables(dbs: dict) -> dict:
    return {t: df for d in dbs.values() for t, df in d.items()}


def columns(spark: SparkSession, dbs: dict) -> DataFrame:
    out = None
    for db_id in sorted(dbs):
        c = profile.profile_columns(spark, db_id, dbs[db_id])
        out = c if out is None else out.unionByName(c)
    return out


def examples(dbs: dict, k: int = 5, store: str | None = None) -> DataFrame:
    if store:
        return profile.stored_examples(dbs, store, k)
    out = None
    for db_id in sorted(dbs):
        e = profile.database_examples(db_id, dbs[db_id], k)
        out = e if out is None else out.unionByName(e)
    return out


def primary_keys(spark: SparkSession) -> DataFrame:
    rows = [(TB.db_of(t), t, c) for t, cols in TB.PRIMARY_KEYS for c in cols]
    pos = {(t, c): i for t, cols in TB.TABLE_COLUMNS.items() for i, (c, _) in enumerate(cols)}
    rows = [(d, t, c, pos[(t, c)]) for d, t, c in rows]
    return spark.createDataFrame(rows, "db_id string, table_name string, column_name string, position int")


def foreign_keys(spark: SparkSession) -> DataFrame:
    rows = [(TB.db_of(t), t, c, rt, rc) for t, c, rt, rc in TB.FOREIGN_KEYS]
    return spark.createDataFrame(
        rows, "db_id string, table_name string, column_name string, ref_table string, ref_column string")


def defaults(tables: dict) -> DataFrame:
    """``table_name, column_name, default, autoincrement`` found in the data."""
    statistics = keys.column_statistics(tables)
    return keys.column_defaults(tables, keys.candidate_keys(tables, 1, statistics), statistics)


def mschema(spark: SparkSession, sf_dir: str, example_num: int = 3, k: int = 5, only: set | None = None) -> dict:
    """Frames of the whole profiling flow (P1-P9), of all tables or ``only`` some;
    examples are kept file by file under the scratch folder."""
    dbs = databases(spark, sf_dir)
    if only is not None:
        dbs = {d: {t: df for t, df in ts.items() if t in only} for d, ts in dbs.items()}
        dbs = {d: ts for d, ts in dbs.items() if ts}
    cols = columns(spark, dbs)
    ex = profile.clean_examples(examples(dbs, k, f"{checkpoint_dir(spark)}/sqltally/examples"))
    pks, fks = primary_keys(spark), foreign_keys(spark)
    lines = schema_text.column_lines(cols, ex, pks, example_num)
    tables_text = schema_text.table_texts(lines)
    return {"columns": cols, "examples": ex, "pks": pks, "fks": fks, "lines": lines,
            "tables": tables_text, "databases": schema_text.database_texts(tables_text, fks)}


def subset_text(spark: SparkSession, sf_dir: str, db_id: str, selected_columns: list[str],
                example_num: int = 3) -> DataFrame:
    """M-Schema text of a column selection (``table.column`` names)."""
    tables = {s.rsplit(".", 1)[0].lower() for s in selected_columns}
    m = mschema(spark, sf_dir, example_num, only=tables)  # the selection comes before the scan
    sel = spark.createDataFrame([(db_id, s) for s in selected_columns], "db_id string, name string")
    cols, fks = schema_text.select_subset(m["columns"].filter(F.col("db_id") == db_id), m["fks"],
                                          selected_columns=sel)
    lines = schema_text.column_lines(cols, m["examples"], m["pks"], example_num)
    return schema_text.database_texts(schema_text.table_texts(lines), fks)


def cached_mschema(spark: SparkSession, sf_dir: str, example_num: int = 3, k: int = 5,
                   cache_root: str | None = None) -> DataFrame:
    """Database texts read from a Parquet cache when present, else built
    and written.  The cache key holds everything the text depends on: the
    tables' files with their sizes and times of change, the database/table
    set, example settings and the library version."""
    import hashlib

    import sqltally
    from sqltally.sources.files import cached_table
    from sqltally.sources.stored import files_version

    layout = ";".join(f"{TB.db_of(t)}.{t}" for t in sorted(TB.STAR_TABLES + TB.TEXT_TABLES))
    tabs = all_tables(databases(spark, sf_dir))
    version = files_version([tabs[t] for t in sorted(tabs)])
    key = hashlib.sha256(f"{version}|{layout}|{example_num}|{k}|{sqltally.__version__}".encode()).hexdigest()[:16]
    root = cache_root or f"{checkpoint_dir(spark)}/sqltally"
    return cached_table(spark, f"{root}/mschema-{key}",
                        lambda: mschema(spark, sf_dir, example_num, k)["databases"])
