"""Registered profiling and schema-text queries over all given tables.

The DuckDB twins are generated from the fixed table and key lists; they
compute examples, cleaning and text with DuckDB's own window, list and
``string_agg`` functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.operators import keys, profile, schema_text
from sqltally.plans import schema as S
from sqltally.plans import tables as TB
from sqltally.plans.catalog import register
from sqltally.session import scratch_path

NL = "chr(10)"
DATE_TYPES = "('DATE', 'TIME', 'DATETIME', 'TIMESTAMP', 'TIMESTAMP_NTZ')"
SUBSET = ["orders.o_orderkey", "ORDERS.O_CUSTKEY", "orders.o_orderdate", "customer.c_custkey",
          "customer.c_name", "customer.c_mktsegment"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _columns_values(tables=None) -> str:
    pk = {(t, c) for t, cols in TB.PRIMARY_KEYS for c in cols}
    rows = []
    for t, cols in TB.TABLE_COLUMNS.items():
        if tables is not None and t not in tables:
            continue
        for i, (c, typ) in enumerate(cols):
            rows.append(f"({_q(TB.db_of(t))}, {_q(t)}, {i}, {_q(c)}, {_q(typ)}, "
                        f"{'true' if (t, c) in pk else 'false'})")
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) +
            ") v(db_id, table_name, position, column_name, type, pk))")


def _examples_sql(k: int = 5) -> str:
    parts = []
    for t, cols in TB.TABLE_COLUMNS.items():
        for i, (c, typ) in enumerate(cols):
            if typ.startswith("ARRAY"):
                continue
            cond = f'"{c}" IS NOT NULL' + (f" AND \"{c}\" <> ''" if typ == "STRING" else "")
            parts.append(
                f"SELECT {_q(TB.db_of(t))} AS db_id, {_q(t)} AS table_name, CAST({i} AS INTEGER) AS position, "
                f"{_q(c)} AS column_name, {_q(typ)} AS type, CAST(rank AS INTEGER) AS rank, value FROM ("
                f"SELECT CAST(v AS VARCHAR) AS value, row_number() OVER (ORDER BY v) AS rank "
                f"FROM (SELECT DISTINCT \"{c}\" AS v FROM {t} WHERE {cond}) d) r WHERE rank <= {k}")
    return "\nUNION ALL\n".join(parts)


def _clean_sql(ex: str) -> str:
    return f"""
SELECT e.* FROM ({ex}) e JOIN (
  SELECT db_id, table_name, column_name,
         max(CASE WHEN regexp_matches(value, '^[\\w.-]+@[\\w.-]+\\.\\w+$')
                   OR contains(value, 'http://') OR contains(value, 'https://') THEN 1 ELSE 0 END) AS bad,
         min(rank) AS first_rank
  FROM ({ex}) x WHERE length(value) > 0 GROUP BY db_id, table_name, column_name
) b ON e.db_id = b.db_id AND e.table_name = b.table_name AND e.column_name = b.column_name
WHERE length(e.value) > 0 AND b.bad = 0 AND (e.type NOT IN {DATE_TYPES} OR e.rank = b.first_rank)
"""


def _lines_sql(example_num: int = 3, tables=None, column_filter: str = "TRUE") -> str:
    cl = _clean_sql(f"SELECT * FROM ({_examples_sql()}) q")
    return f"""
SELECT c.db_id, c.table_name, c.position, c.column_name,
       '(' || c.column_name || ':' || c.type
       || CASE WHEN c.pk THEN ', Primary Key' ELSE '' END
       || CASE WHEN len(s.shown) > 0 THEN ', Examples: [' || array_to_string(s.shown, ', ') || ']' ELSE '' END
       || ')' AS line
FROM {_columns_values(tables)} c
LEFT JOIN (
  SELECT db_id, table_name, column_name, type,
         CASE WHEN type IN {DATE_TYPES} THEN ex[1:1]
              WHEN list_max(list_transform(ex, lambda x: length(x))) > 50 THEN []
              WHEN list_max(list_transform(ex, lambda x: length(x))) > 20 THEN ex[1:1]
              ELSE ex END AS shown
  FROM (SELECT db_id, table_name, column_name, type, list(value ORDER BY rank)[1:{example_num}] AS ex
        FROM ({cl}) z GROUP BY db_id, table_name, column_name, type) y
) s ON c.db_id = s.db_id AND c.table_name = s.table_name AND c.column_name = s.column_name
WHERE {column_filter}
"""


def _tables_sql(lines: str) -> str:
    return f"""
SELECT db_id, table_name,
       '# Table: ' || table_name || {NL} || '[' || {NL}
       || string_agg(line, ',' || {NL} ORDER BY position) || {NL} || ']' AS text
FROM ({lines}) l GROUP BY db_id, table_name
"""


def _fk_values(keep=None) -> str:
    rows = [f"({_q(TB.db_of(t))}, {_q(t)}, {_q(c)}, {_q(rt)}, {_q(rc)})" for t, c, rt, rc in TB.FOREIGN_KEYS
            if keep is None or (t in keep and rt in keep)]
    if not rows:
        return "(SELECT NULL AS db_id, NULL AS table_name, NULL AS column_name, NULL AS ref_table, NULL AS ref_column WHERE FALSE)"
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) +
            ") v(db_id, table_name, column_name, ref_table, ref_column))")


def _db_sql(tables_sql: str, fks: str) -> str:
    return f"""
SELECT t.db_id,
       concat_ws({NL}, '【DB_ID】 ' || t.db_id, '【Schema】', t.body,
                 CASE WHEN f.body IS NOT NULL THEN '【Foreign keys】' || {NL} || f.body END) AS text
FROM (SELECT db_id, string_agg(text, {NL} ORDER BY table_name) AS body FROM ({tables_sql}) x GROUP BY db_id) t
LEFT JOIN (SELECT db_id, string_agg(table_name || '.' || column_name || '=' || ref_table || '.' || ref_column,
                                    {NL} ORDER BY table_name, column_name) AS body
           FROM {fks} f0 GROUP BY db_id) f ON t.db_id = f.db_id
"""


@register("profile_columns", """
SELECT CASE WHEN table_name IN ('region','nation','customer','supplier','part','orders','lineitem')
            THEN 'star' ELSE 'text' END AS db_id,
       table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT'
                      WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ'
                      WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' ELSE data_type END AS type
FROM information_schema.columns
WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem',
                     'events','documents','embeddings','pages','benchmark','labels','conversations')
""")
def q_profile_columns(spark, sf_dir):
    return S.columns(spark, S.databases(spark, sf_dir)).select(
        "db_id", "table_name", "position", "column_name", "full_type").withColumnRenamed("full_type", "type")


@register("column_examples", "SELECT db_id, table_name, position, column_name, rank, value FROM ("
          + _examples_sql() + ") q")
def q_column_examples(spark, sf_dir):
    return S.examples(S.databases(spark, sf_dir)).select(
        "db_id", "table_name", "position", "column_name", "rank", "value")


@register("stored_examples", "SELECT db_id, table_name, position, column_name, rank, value FROM ("
          + _examples_sql() + ") q")
def q_stored_examples(spark, sf_dir):
    """P3 + S8: kept by the first call, read without any data column by the second."""
    store = scratch_path(spark, "examples")
    S.examples(S.databases(spark, sf_dir), store=store)
    return S.examples(S.databases(spark, sf_dir), store=store).select(
        "db_id", "table_name", "position", "column_name", "rank", "value")


@register("examples_filtered", "SELECT db_id, table_name, column_name, rank, value FROM ("
          + _clean_sql("SELECT * FROM (" + _examples_sql() + ") q") + ") c")
def q_examples_filtered(spark, sf_dir):
    ex = S.examples(S.databases(spark, sf_dir))
    return profile.clean_examples(ex).select("db_id", "table_name", "column_name", "rank", "value")


def _pk_oracle() -> str:
    parts = []
    for t, cols in TB.PRIMARY_KEYS + TB.CANDIDATE_KEYS:
        key = ", ".join(cols)
        anynull = " OR ".join(f"{c} IS NULL" for c in cols)
        parts.append(
            f"SELECT {_q(t)} AS table_name, {_q(','.join(cols))} AS key_columns, "
            f"CAST((SELECT count(*) FROM (SELECT {key} FROM {t} WHERE NOT ({anynull}) GROUP BY {key} "
            f"HAVING count(*) > 1) d) AS BIGINT) AS n_duplicate_keys, "
            f"CAST((SELECT count(*) FROM {t} WHERE {anynull}) AS BIGINT) AS n_null_rows")
    return ("SELECT *, n_duplicate_keys = 0 AND n_null_rows = 0 AS holds FROM ("
            + "\nUNION ALL\n".join(parts) + ") p")


@register("pk_check", _pk_oracle())
def q_pk_check(spark, sf_dir):
    tabs = S.all_tables(S.databases(spark, sf_dir))
    return profile.check_primary_keys(tabs, TB.PRIMARY_KEYS + TB.CANDIDATE_KEYS)


def _fk_oracle() -> str:
    parts = []
    for t, c, rt, rc in TB.FOREIGN_KEYS:
        parts.append(
            f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, {_q(rt)} AS ref_table, {_q(rc)} AS ref_column, "
            f"CAST((SELECT count(*) FROM {t} x WHERE x.{c} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {rt} y WHERE y.{rc} = x.{c})) AS BIGINT) AS n_orphans")
    return "SELECT *, n_orphans = 0 AS holds FROM (" + "\nUNION ALL\n".join(parts) + ") f"


@register("fk_check", _fk_oracle())
def q_fk_check(spark, sf_dir):
    tabs = S.all_tables(S.databases(spark, sf_dir))
    return profile.check_foreign_keys(tabs, TB.FOREIGN_KEYS)


@register("schema_text_table", _tables_sql(_lines_sql()))
def q_schema_text_table(spark, sf_dir):
    return S.mschema(spark, sf_dir)["tables"]


@register("schema_text_db", _db_sql(_tables_sql(_lines_sql()), _fk_values()))
def q_schema_text_db(spark, sf_dir):
    return S.mschema(spark, sf_dir)["databases"]


def _subset_oracle() -> str:
    pairs = [s.lower().rsplit(".", 1) for s in SUBSET]
    cond = " OR ".join(f"(lower(c.table_name) = {_q(t)} AND lower(c.column_name) = {_q(col)})" for t, col in pairs)
    keep = {t for t, _ in pairs}
    return _db_sql(_tables_sql(_lines_sql(tables=keep, column_filter=f"({cond})")), _fk_values(keep))


@register("schema_subset", _subset_oracle())
def q_schema_subset(spark, sf_dir):
    return S.subset_text(spark, sf_dir, "star", SUBSET)


def _ddl_oracle() -> str:
    pk_lines = []
    for t, cols in TB.PRIMARY_KEYS:
        keys = ", ".join(f"`{c}`" for c in cols)
        pk_lines.append(f"({_q(TB.db_of(t))}, {_q(t)}, 1000000, {_q('  PRIMARY KEY (' + keys + ')')})")
    fk_sorted = {}
    for t, c, rt, rc in TB.FOREIGN_KEYS:
        fk_sorted.setdefault(t, []).append((c, rt, rc))
    for t, lst in fk_sorted.items():
        for i, (c, rt, rc) in enumerate(sorted(lst)):
            pk_lines.append(f"({_q(TB.db_of(t))}, {_q(t)}, {2000001 + i}, "
                            f"{_q('  FOREIGN KEY (`' + c + '`) REFERENCES `' + rt + '`(`' + rc + '`)')})")
    extra = "(SELECT * FROM (VALUES " + ", ".join(pk_lines) + ") v(db_id, table_name, position, line))"
    return f"""
SELECT db_id, table_name,
       'CREATE TABLE `' || table_name || '` (' || {NL} || string_agg(line, ',' || {NL} ORDER BY position)
       || {NL} || ')' AS text
FROM (
  SELECT db_id, table_name, position, '  `' || column_name || '` ' || type AS line FROM {_columns_values()} c
  UNION ALL SELECT * FROM {extra} e
) l GROUP BY db_id, table_name
"""


@register("ddl_text", _ddl_oracle())
def q_ddl_text(spark, sf_dir):
    dbs = S.databases(spark, sf_dir)
    return schema_text.ddl_texts(S.columns(spark, dbs), S.primary_keys(spark), S.foreign_keys(spark))


@register("ddl_db_text", f"""
SELECT db_id, string_agg(text, {NL} || {NL} ORDER BY table_name) AS text FROM ({_ddl_oracle()}) d GROUP BY db_id
""")
def q_ddl_db_text(spark, sf_dir):
    dbs = S.databases(spark, sf_dir)
    ddl = schema_text.ddl_texts(S.columns(spark, dbs), S.primary_keys(spark), S.foreign_keys(spark))
    return schema_text.ddl_database_texts(ddl)


def _sample_rows_oracle(n: int = 3) -> str:
    """DuckDB twin of ``sample_rows_text``: first ``n`` rows by all columns
    (NULLs first, as Spark sorts), cells as text (NULL shown as ``None``),
    right-justified to the widest entry, each followed by a space."""
    parts = []
    for t, cols in TB.TABLE_COLUMNS.items():
        names = [c for c, _ in cols]
        order = ", ".join(f'"{c}" ASC NULLS FIRST' for c in names)
        def cell(c, typ):
            if typ.startswith("ARRAY"):
                return f"CASE WHEN \"{c}\" IS NULL THEN 'None' ELSE {_q(typ.lower() + '[')} || len(\"{c}\") || ']' END"
            return f"coalesce(CAST(\"{c}\" AS VARCHAR), 'None')"
        vals = ", ".join(f"{cell(c, typ)} AS v{i}" for i, (c, typ) in enumerate(cols))
        widths = ", ".join(f"greatest({len(c)}, coalesce(max(length(v{i})), 0)) AS w{i}"
                           for i, c in enumerate(names))
        head = " || ".join(f"lpad({_q(c)}, CAST(w{i} AS INTEGER), ' ') || ' '" for i, c in enumerate(names))
        line = " || ".join(f"lpad(v{i}, CAST(w{i} AS INTEGER), ' ') || ' '" for i in range(len(names)))
        parts.append(f"""
SELECT {_q(TB.db_of(t))} AS db_id, {_q(t)} AS table_name, text FROM (
  WITH r AS (
    SELECT {vals}, row_number() OVER (ORDER BY {order}) AS rn
    FROM (SELECT * FROM {t} ORDER BY {order} LIMIT {n}) s),
  w AS (SELECT {widths} FROM r)
  SELECT (SELECT {head} FROM w) || {NL} ||
         coalesce((SELECT string_agg({line}, {NL} ORDER BY rn) FROM r, w), '') AS text) x""")
    return "\nUNION ALL\n".join(parts)


@register("sample_rows_text", _sample_rows_oracle())
def q_sample_rows_text(spark, sf_dir):
    """Rows-only check (value texts of floats and arrays are engine-specific);
    the layout is tested against a hand-worked block in the unit tests."""
    dbs = S.databases(spark, sf_dir)
    out = None
    for db_id in sorted(dbs):
        for t in sorted(dbs[db_id]):
            r = schema_text.sample_rows_text(dbs[db_id][t], 3).select(
                F.lit(db_id).alias("db_id"), F.lit(t).alias("table_name"), "text")
            out = r if out is None else out.unionByName(r)
    return out


@register("schema_check", """
WITH c AS (
  SELECT table_name, column_name FROM information_schema.columns
  WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem',
                       'events','documents','embeddings','pages','benchmark','labels','conversations')
),
refs AS (
  SELECT table_name, column_name FROM c
  UNION ALL SELECT table_name, upper(column_name) FROM c
  UNION ALL SELECT table_name || 's', column_name FROM c
)
SELECT r.table_name, r.column_name,
       r.table_name IN (SELECT table_name FROM c) AS has_table,
       EXISTS (SELECT 1 FROM c WHERE c.table_name = r.table_name AND c.column_name = r.column_name) AS has_column
FROM refs r
""")
def q_schema_check(spark, sf_dir):
    cols = S.columns(spark, S.databases(spark, sf_dir))
    base = cols.select("table_name", "column_name")
    refs = base.unionByName(base.select("table_name", F.upper("column_name").alias("column_name"))) \
               .unionByName(base.select(F.concat("table_name", F.lit("s")).alias("table_name"), "column_name"))
    return profile.schema_check(cols, refs)


# --- keys, references and defaults found in the data ---

INTS, FAMILY = ("INT", "BIGINT"), {"INT": "n", "BIGINT": "n", "STRING": "s", "TIMESTAMP_NTZ": "t"}


def _atomic_columns() -> list[tuple[str, str, str]]:
    return [(t, c, typ) for t, cols in TB.TABLE_COLUMNS.items() for c, typ in cols if not typ.startswith("ARRAY")]


def _single_keys_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, count(*) > 0 AND count({c}) = count(*) "
        f"AND count(DISTINCT {c}) = count(*) AS holds, count(*) > 0 AND count({c}) = count(*) AS filled FROM {t}"
        for t, c, _ in _atomic_columns())


def _unique_oracle() -> str:
    pairs = []
    for t, cols in TB.TABLE_COLUMNS.items():
        names = [c for c, typ in cols if not typ.startswith("ARRAY")]
        pairs += [f"SELECT {_q(t)} AS table_name, {_q(a)} AS a, {_q(b)} AS b, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) = "
                  f"(SELECT count(*) FROM {t}) AS holds" for i, a in enumerate(names) for b in names[i + 1:]]
    return f"""
WITH one AS ({_single_keys_sql()}), two AS ({' UNION ALL '.join(pairs)})
SELECT table_name, column_name AS key_columns, 1 AS n_columns FROM one WHERE holds
UNION ALL
SELECT p.table_name, p.a || ',' || p.b, 2 FROM two p JOIN one x ON x.table_name = p.table_name AND x.column_name = p.a
JOIN one y ON y.table_name = p.table_name AND y.column_name = p.b
WHERE p.holds AND x.filled AND y.filled AND NOT x.holds AND NOT y.holds
"""


@register("unique_check", _unique_oracle())
def q_unique_check(spark, sf_dir):
    """All minimal keys of up to two columns of all tables."""
    found = keys.candidate_keys(S.all_tables(S.databases(spark, sf_dir)))
    return spark.createDataFrame([(t, ",".join(c), len(c)) for t, c in found], "table_name string, key_columns string, n_columns int")


def _inclusion_sql() -> str:
    cols = [(t, c, FAMILY[typ]) for t, c, typ in _atomic_columns() if typ in FAMILY]
    parts = [f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, {_q(rt)} AS ref_table, {_q(rc)} AS ref_column, "
             f"(SELECT count(DISTINCT {c}) FROM {t}) AS n_values, "
             f"(SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL EXCEPT SELECT {rc} FROM {rt})) AS missing"
             for t, c, k in cols for rt, rc, rk in cols if k == rk and (t, c) != (rt, rc)]
    return f"""
WITH one AS ({_single_keys_sql()})
SELECT d.table_name, d.column_name, d.ref_table, d.ref_column, d.n_values::BIGINT AS n_values FROM ({' UNION ALL '.join(parts)}) d
JOIN one k ON k.table_name = d.ref_table AND k.column_name = d.ref_column WHERE k.holds AND d.missing = 0 AND d.n_values > 0
"""


@register("inclusion_check", _inclusion_sql())
def q_inclusion_check(spark, sf_dir):
    """Every column whose values all lie in a one-column key: all references that could be declared."""
    tabs = S.all_tables(S.databases(spark, sf_dir))
    return keys.inclusion_dependencies(tabs, keys.candidate_keys(tabs, most=1))


def _defaults_sql() -> str:
    parts = []
    for t, c, typ in _atomic_columns():
        even = "false"
        if typ in INTS:
            even = (f"(SELECT n > 1 AND n = d AND n = f AND (hi - lo) % (n - 1) = 0 AND (SELECT count(*) = 0 FROM {t} x "
                    f"WHERE (x.{c} - lo) % greatest((hi - lo) // (n - 1), 1) <> 0) FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d, "
                    f"count({c}) AS f, min({c})::BIGINT AS lo, max({c})::BIGINT AS hi FROM {t}) s)")
        parts.append(f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, (SELECT CAST({c} AS VARCHAR) FROM {t} WHERE {c} IS NOT NULL "
                     f"GROUP BY {c} HAVING count(*) * 2 > (SELECT count(*) FROM {t})) AS \"default\", coalesce({even}, false) AS autoincrement")
    return " UNION ALL ".join(parts)


@register("default_check", _defaults_sql())
def q_default_check(spark, sf_dir):
    """Defaults that the data suggests and counting columns."""
    tabs = S.all_tables(S.databases(spark, sf_dir))
    return S.defaults(tabs)
