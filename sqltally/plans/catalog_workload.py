"""Registered queries that execute real SQL workloads on the star schema.

Oracles are generated from ``workload/questions.json``: DuckDB runs the same
statements (counts of rows and distinct rows, set differences with
``EXCEPT``); where DuckDB cannot mirror Spark (errors, arity mismatch, typing
differences) the expectation written next to the candidate is used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.operators import compare, execute, fingerprint, metrics
from sqltally.plans import workload as W
from sqltally.plans.catalog import ORACLE, register

_WL = W.oracle_rows()


def _clean(sql: str) -> str:
    s = sql.strip()
    while s.endswith(";"):
        s = s[:-1].rstrip()
    return s


def _statements():
    for q in _WL:
        yield q, W.GOLD_ORD, q["gold_sql"], "gold", None
        for i, c in enumerate(q["candidates"]):
            yield q, i, c["sql"], c["expect"], c.get("oracle")


def _status_oracle() -> str:
    parts = []
    for q, ord_, sql, exp, _ in _statements():
        head = f"SELECT CAST({q['question_id']} AS BIGINT) AS question_id, CAST({ord_} AS INTEGER) AS ord, "
        if exp.startswith("error:"):
            cat = exp.split(":", 1)[1]
            parts.append(head + f"'error' AS status, '{cat}' AS detail, "
                                "CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS BIGINT) AS n_distinct")
        else:
            s = _clean(sql)
            parts.append(head + "'success' AS status, CAST(NULL AS VARCHAR) AS detail, "
                                f"(SELECT CAST(count(*) AS BIGINT) FROM (\n{s}\n) t) AS n_rows, "
                                f"(SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT * FROM (\n{s}\n) t) u) AS n_distinct")
    return "\nUNION ALL\n".join(parts)


def _ex_value(q, sql, exp, how) -> str:
    if exp.startswith("error:"):
        return "0"
    if how == "literal":
        return "1" if exp == "same" else "0"
    p, g = _clean(sql), _clean(q["gold_sql"])
    return (f"CASE WHEN NOT EXISTS (SELECT * FROM (\n{p}\n) a EXCEPT SELECT * FROM (\n{g}\n) b) "
            f"AND NOT EXISTS (SELECT * FROM (\n{g}\n) b EXCEPT SELECT * FROM (\n{p}\n) a) THEN 1 ELSE 0 END")


def _ex_oracle() -> str:
    parts = []
    for q, ord_, sql, exp, how in _statements():
        if ord_ == W.GOLD_ORD:
            continue
        parts.append(f"SELECT CAST({q['question_id']} AS BIGINT) AS question_id, CAST({ord_} AS INTEGER) AS ord, "
                     f"CAST({_ex_value(q, sql, exp, how)} AS INTEGER) AS res")
    return "\nUNION ALL\n".join(parts)


def _execs(spark, sf_dir):
    return W.executions(spark, sf_dir)


@register("workload_status", _status_oracle())
def q_workload_status(spark, sf_dir):
    return _execs(spark, sf_dir).select("question_id", "ord", "status", "detail", "n_rows", "n_distinct")


@register("workload_status_summary", "SELECT status, detail, CAST(count(*) AS BIGINT) AS n FROM ("
          + _status_oracle() + ") s GROUP BY status, detail")
def q_workload_status_summary(spark, sf_dir):
    return execute.status_summary(_execs(spark, sf_dir)).select(
        "status", "detail", F.col("n").cast("bigint").alias("n"))


@register("ex_compare", _ex_oracle())
def q_ex_compare(spark, sf_dir):
    return W.ex_scores(_execs(spark, sf_dir))


def _ex_accuracy_oracle() -> str:
    rows = []
    for q, ord_, sql, exp, how in _statements():
        if ord_ != 0:
            continue
        d = "NULL" if q["difficulty"] is None else f"'{q['difficulty']}'"
        rows.append(f"SELECT {d} AS difficulty, CAST({_ex_value(q, sql, exp, how)} AS INTEGER) AS correct")
    src = "(" + "\nUNION ALL\n".join(rows) + ") s"
    out = []
    for i, lv in enumerate(metrics.LEVELS):
        out.append(f"SELECT {i} AS level_ord, '{lv}' AS level, CAST(count(*) FILTER (WHERE difficulty = '{lv}') AS BIGINT) AS n, "
                   f"CAST(coalesce(sum(correct) FILTER (WHERE difficulty = '{lv}'), 0) AS BIGINT) AS correct FROM {src}")
    out.append(f"SELECT 3, 'total', CAST(count(*) AS BIGINT), CAST(coalesce(sum(correct), 0) AS BIGINT) FROM {src}")
    return ("SELECT level_ord, level, n, correct, CASE WHEN n > 0 THEN CAST(correct AS DOUBLE) * 100.0 / "
            "CAST(n AS DOUBLE) END AS accuracy FROM (" + "\nUNION ALL\n".join(out) + ")")


@register("ex_accuracy", _ex_accuracy_oracle())
def q_ex_accuracy(spark, sf_dir):
    """Plan A: the first candidate of each question as the prediction, EX by difficulty."""
    execs = _execs(spark, sf_dir)
    pred = execs.filter(F.col("ord") == 0)
    gold = execs.filter(F.col("ord") == W.GOLD_ORD)
    scores = compare.compare_results(pred, gold).withColumnRenamed("res", "correct")
    return metrics.accuracy_by_difficulty(scores, W.questions(spark))


# Canonical result set of one statement in DuckDB: each cell tagged by kind
# (NULL and non-finite numbers as NULL, text, number by value), rows
# de-duplicated and sorted into one string; NULL for an empty result.
_CANON_SET = """(SELECT string_agg(r, chr(30) ORDER BY r) FROM (
  SELECT DISTINCT concat_ws(chr(31), *COLUMNS(*)) AS r FROM (
    SELECT CASE WHEN COLUMNS(*) IS NULL THEN 'z'
                WHEN typeof(COLUMNS(*)) = 'VARCHAR' THEN 's:' || CAST(COLUMNS(*) AS VARCHAR)
                WHEN isinf(TRY_CAST(COLUMNS(*) AS DOUBLE)) OR isnan(TRY_CAST(COLUMNS(*) AS DOUBLE)) THEN 'z'
                WHEN TRY_CAST(COLUMNS(*) AS DOUBLE) = floor(TRY_CAST(COLUMNS(*) AS DOUBLE))
                     THEN 'n:' || CAST(CAST(TRY_CAST(COLUMNS(*) AS DOUBLE) AS HUGEINT) AS VARCHAR)
                ELSE 'n:' || CAST(TRY_CAST(COLUMNS(*) AS DOUBLE) AS VARCHAR) END
    FROM (
{sql}
) t) u) v)"""


def _vote_oracle() -> str:
    rows = []
    for q, ord_, sql, exp, _ in _statements():
        valid = not exp.startswith("error:")
        fp = f"coalesce({_CANON_SET.format(sql=_clean(sql))}, 'empty')" if valid else "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT CAST({q['question_id']} AS BIGINT) AS question_id, CAST({ord_} AS INTEGER) AS ord, "
                    f"{_q_sql(sql)} AS sql, {'true' if valid else 'false'} AS valid, {fp} AS fp")
    stmts = "\nUNION ALL\n".join(rows)
    return f"""
WITH s AS ({stmts}),
g AS (SELECT question_id, valid AS gold_valid, fp AS gold_fp FROM s WHERE ord = -1),
c AS (
  SELECT s.question_id, s.ord, s.sql, s.valid, s.fp,
         CASE WHEN s.valid AND g.gold_valid AND g.gold_fp <> 'empty' AND s.fp = g.gold_fp THEN 1 ELSE 0 END AS correct
  FROM s JOIN g ON s.question_id = g.question_id WHERE s.ord >= 0),
grp AS (
  SELECT question_id, fp, count(*) AS votes, min(ord) AS first_ord, arg_min(sql, ord) AS sql,
         max(correct) AS correct
  FROM c WHERE valid GROUP BY question_id, fp),
w AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_ord) AS rn
                 FROM grp) x WHERE rn = 1),
q AS (SELECT question_id, arg_min(sql, ord) AS first_sql FROM c GROUP BY question_id)
SELECT q.question_id, CAST(coalesce(w.votes, 1) AS BIGINT) AS votes,
       CAST(coalesce(w.correct, 0) AS INTEGER) AS correct, coalesce(w.sql, q.first_sql) AS sql,
       w.first_ord AS winner_ord
FROM q LEFT JOIN w ON q.question_id = w.question_id
"""


def _q_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register("workload_vote", _vote_oracle())
def q_workload_vote(spark, sf_dir):
    """Consensus over the real executions: fingerprints decide which
    candidates agree; the DuckDB twin canonicalises each result set itself."""
    return W.voted(_execs(spark, sf_dir))["winner"]


# --- single statements of each SQL shape the kit hands to a database (X2) ---

_SHAPES = {
    "shape_filter_agg": (
        "SELECT COUNT(*) AS n_orders, MAX(o_totalprice) AS max_price, ROUND(AVG(o_totalprice), 2) AS avg_price "
        "FROM orders WHERE o_orderstatus = 'F'",
        None),
    "shape_join_range": (
        "SELECT c.c_name AS c_name, o.o_orderkey AS o_orderkey, o.o_totalprice AS o_totalprice "
        "FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey "
        "WHERE c.c_nationkey = 3 AND o.o_totalprice BETWEEN 1000 AND 50000",
        None),
    "shape_topk_ratio": (
        "SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) / p_size AS `price per size` "
        "FROM part WHERE p_size > 0 ORDER BY `price per size` DESC, p_partkey LIMIT 1",
        "SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) / p_size AS \"price per size\" "
        "FROM part WHERE p_size > 0 ORDER BY \"price per size\" DESC, p_partkey LIMIT 1"),
    "shape_distinct_limit": ("SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5", None),
    "shape_star_limit": ("SELECT * FROM nation ORDER BY n_nationkey LIMIT 5", None),
    "shape_group_having": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10",
        None),
}


def _shape(name, spark_sql, duck_sql):
    def q(spark, sf_dir):
        return execute.run_rows(W.star_database(spark, sf_dir), spark_sql)
    q.__name__ = f"q_{name}"
    register(name, duck_sql or spark_sql)(q)


for _n, (_s, _d) in _SHAPES.items():
    _shape(_n, _s, _d)


# --- fixed pairs of statements compared as sets (R2/R4) ---

_PAIRS = [
    ("set_vs_bag", "SELECT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer", None),
    ("row_order", "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation", None),
    ("column_order", "SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation", 0),
    ("null_equal", "SELECT NULL AS x FROM region", "SELECT CAST(NULL AS INT) AS y FROM nation", None),
    ("int_vs_double", "SELECT COUNT(*) FROM orders", "SELECT CAST(COUNT(*) AS DOUBLE) FROM orders", None),
    ("text_vs_number", "SELECT CAST(COUNT(*) AS STRING) FROM region", "SELECT COUNT(*) FROM region", 0),
    ("arity", "SELECT r_name FROM region", "SELECT r_name, r_name FROM region", 0),
    ("empty_vs_empty", "SELECT o_orderkey FROM orders WHERE o_totalprice < -1",
     "SELECT c_name, c_custkey FROM customer WHERE c_acctbal < -100000", 1),
    ("filter_diff", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000",
     "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000", None),
]


def _pairs_oracle() -> str:
    rows = []
    for name, a, b, literal in _PAIRS:
        if literal is not None:
            v = str(literal)
        else:
            v = (f"CASE WHEN NOT EXISTS (SELECT * FROM ({a}) x EXCEPT SELECT * FROM ({b}) y) "
                 f"AND NOT EXISTS (SELECT * FROM ({b}) y EXCEPT SELECT * FROM ({a}) x) THEN 1 ELSE 0 END")
        rows.append(f"SELECT '{name}' AS pair, CAST({v} AS INTEGER) AS res")
    return "\nUNION ALL\n".join(rows)


@register("ex_pairs", _pairs_oracle())
def q_ex_pairs(spark, sf_dir):
    db = W.star_database(spark, sf_dir)
    parts = []
    for name, a, b, _ in _PAIRS:
        for side, sql in (("a", a), ("b", b)):
            parts.append(fingerprint.fingerprint(execute.run_rows(db, sql))
                         .select(F.lit(name).alias("pair"), F.lit(side).alias("side"), "fp"))
    tagged = parts[0]
    for p in parts[1:]:
        tagged = tagged.unionByName(p)
    return tagged.groupBy("pair").agg(
        (F.count_distinct("fp") == 1).cast("int").alias("res"))


_DIFF_A = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000"
_DIFF_B = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'P'"


@register("result_diff", f"""
SELECT 'a_only' AS side, 'n:' || CAST(o_orderkey AS VARCHAR) || '|' || coalesce('s:' || o_orderstatus, 'z') AS row_text
FROM ({_DIFF_A} EXCEPT {_DIFF_B}) d
UNION ALL
SELECT 'b_only', 'n:' || CAST(o_orderkey AS VARCHAR) || '|' || coalesce('s:' || o_orderstatus, 'z')
FROM ({_DIFF_B} EXCEPT {_DIFF_A}) d
""")
def q_result_diff(spark, sf_dir):
    db = W.star_database(spark, sf_dir)
    return compare.diff_results(execute.run_rows(db, _DIFF_A), execute.run_rows(db, _DIFF_B))


@register("result_diff_ranges", ORACLE["result_diff"])
def q_result_diff_ranges(spark, sf_dir):
    """R6 by digests of hash ranges: only rows of ranges that differ are compared."""
    db = W.star_database(spark, sf_dir)
    return compare.diff_by_ranges(execute.run_rows(db, _DIFF_A), execute.run_rows(db, _DIFF_B))


# a million steps a line: cut off long before its end
_SLOW = "SELECT sum(size(filter(sequence(1, 1000000), x -> x % l_orderkey = l_linenumber))) FROM lineitem"


@register("workload_timeout", """
SELECT 0::BIGINT AS question_id, 'timeout' AS status, 'execute sql timeout.' AS message
UNION ALL SELECT 1, 'success', NULL
""")
def q_workload_timeout(spark, sf_dir):
    """A statement that passes its deadline, next to one that does not."""
    db = W.star_database(spark, sf_dir)
    rows = spark.createDataFrame([(0, "star", _SLOW), (1, "star", "SELECT count(*) FROM region")], "question_id bigint, db_id string, sql string")
    ran = execute.run_workload(spark, rows, {"star": db}, timeout=5.0, statements_per_job=1)
    return ran.select("question_id", "status", "message")
