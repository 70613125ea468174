"""Registered queries: one per operator family, each over whole given tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the same tables as views) are collected from the sections below.
The oracle is written independently (windows and ``CASE`` where the Spark
side uses aggregations and joins), so agreement is a real check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.operators import metrics, vote
from sqltally.plans import tables
from sqltally.plans.consensus import vote_and_score

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------------------
# Voting and metrics over candidate executions derived from ``events``
# ---------------------------------------------------------------------------

_CANDIDATES_TEMPLATE = """
c AS (
  SELECT CAST(floor(event_id / {n}) AS BIGINT) AS question_id,
         CAST(event_id % {n} AS INTEGER) AS ord,
         'SELECT ''' || event_type || ''' /* candidate ' || CAST(event_id AS VARCHAR) || ' */' AS sql,
         coalesce(event_type <> 'error', false) AS valid,
         event_type AS fp,
         CASE WHEN coalesce(event_type <> 'error', false)
                   AND event_type = CASE CAST(floor(event_id / {n}) AS BIGINT) % 5
                                      WHEN 0 THEN 'click' WHEN 1 THEN 'view'
                                      WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' END
              THEN 1 ELSE 0 END AS correct
  FROM events
),
q AS (
  SELECT question_id,
         CASE WHEN question_id % 7 <= 2 THEN 'simple'
              WHEN question_id % 7 <= 4 THEN 'moderate'
              WHEN question_id % 7 = 5 THEN 'challenging' END AS difficulty,
         count(*) AS sampling_num,
         arg_min(sql, ord) AS first_sql,
         max(CASE WHEN valid THEN 1 ELSE 0 END) AS has_valid,
         max(correct) AS any_correct,
         arg_max(sql, CASE WHEN correct = 1 THEN ord END) AS last_correct_sql
  FROM c GROUP BY question_id
),
g AS (
  SELECT question_id, fp, count(*) AS votes, min(ord) AS first_ord,
         arg_min(sql, ord) AS sql, max(correct) AS correct
  FROM c WHERE valid GROUP BY question_id, fp
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_ord) AS rn
  FROM g
),
w AS (SELECT * FROM r WHERE rn = 1),
t AS (SELECT question_id, votes AS t_votes FROM r WHERE rn = 2),
rc AS (
  SELECT r.question_id, r.first_ord, r.sql, r.correct, r.votes,
         CASE WHEN r.first_ord < w.first_ord THEN 0 ELSE 1 END AS side
  FROM r JOIN w ON r.question_id = w.question_id
         JOIN t ON r.question_id = t.question_id
  WHERE r.votes = t.t_votes AND t.t_votes < w.votes
),
ru AS (
  SELECT * FROM (
    SELECT rc.*, row_number() OVER (PARTITION BY question_id
           ORDER BY side, CASE WHEN side = 0 THEN -first_ord ELSE first_ord END) AS k
    FROM rc) WHERE k = 1
),
win AS (
  SELECT q.question_id, q.difficulty, q.sampling_num,
         CAST(coalesce(w.votes, 1) AS BIGINT) AS votes,
         CAST(coalesce(w.correct, 0) AS INTEGER) AS correct,
         coalesce(w.sql, q.first_sql) AS sql,
         w.first_ord AS winner_ord,
         ru.sql AS r_sql, ru.correct AS r_correct, ru.votes AS r_votes,
         q.has_valid, q.any_correct, q.last_correct_sql, q.first_sql
  FROM q LEFT JOIN w ON q.question_id = w.question_id
         LEFT JOIN ru ON q.question_id = ru.question_id
),
top2 AS (
  SELECT question_id, difficulty,
         CAST(CASE WHEN has_valid = 1 THEN greatest(correct, coalesce(r_correct, 0)) ELSE 0 END AS INTEGER) AS correct
  FROM win
),
pass AS (
  SELECT question_id, difficulty,
         CAST(CASE WHEN has_valid = 1 THEN any_correct ELSE 0 END AS INTEGER) AS correct,
         CASE WHEN has_valid = 1 THEN coalesce(last_correct_sql, first_sql) ELSE sql END AS sql
  FROM win
)
"""


def _candidates_cte(n: int) -> str:
    """Oracle CTEs for candidates sliced ``n`` per question from ``events``."""
    return _CANDIDATES_TEMPLATE.replace("{n}", str(n))


_CANDIDATES_CTE = _candidates_cte(16)


def _execs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_executions(spark, sf_dir)


def _consensus(spark: SparkSession, sf_dir: str) -> dict:
    return vote.consensus(_execs(spark, sf_dir).drop("difficulty"))


@register("candidate_slice", """
SELECT CAST(floor(event_id / 16) AS BIGINT) AS question_id,
       CAST(event_id % 16 AS INTEGER) AS ord, event_id AS idx
FROM events
""")
def q_candidate_slice(spark, sf_dir):
    flat = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))
    return vote.candidate_slice(flat, tables.CANDIDATES_PER_QUESTION).select("question_id", "ord", "idx")


@register("vote_groups", "WITH " + _CANDIDATES_CTE + """
SELECT question_id, fp, votes, first_ord, sql, correct FROM g
""")
def q_vote_groups(spark, sf_dir):
    g = vote.vote_groups(_execs(spark, sf_dir))
    return g.select("question_id", "fp", F.col("votes").cast("bigint").alias("votes"),
                    "first_ord", "sql", "correct")


@register("vote_winner", "WITH " + _CANDIDATES_CTE + """
SELECT question_id, votes, correct, sql, winner_ord FROM win
""")
def q_vote_winner(spark, sf_dir):
    return _consensus(spark, sf_dir)["winner"]


def _top2_oracle(n: int) -> str:
    return "WITH " + _candidates_cte(n) + """
SELECT question_id, sampling_num,
       CAST(CASE WHEN has_valid = 1 THEN greatest(correct, coalesce(r_correct, correct)) ELSE 0 END AS INTEGER) AS correct,
       CAST(CASE WHEN r_sql IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_entries,
       CAST(CASE WHEN has_valid = 1 THEN votes ELSE 0 END AS BIGINT) AS votes_1,
       CAST(r_votes AS BIGINT) AS votes_2,
       CAST(correct AS INTEGER) AS correct_1,
       CAST(r_correct AS INTEGER) AS correct_2,
       sql AS sql_1,
       r_sql AS sql_2
FROM win
"""


def _flat_top2(t):
    n = F.size("sql_list")
    return t.select(
        "question_id", F.col("sampling_num").cast("bigint").alias("sampling_num"), "correct",
        n.cast("int").alias("n_entries"),
        F.col("vote_list")[0].alias("votes_1"),
        F.when(n == 2, F.col("vote_list")[1]).alias("votes_2"),
        F.col("correctness_list")[0].alias("correct_1"),
        F.when(n == 2, F.col("correctness_list")[1]).alias("correct_2"),
        F.col("sql_list")[0].alias("sql_1"),
        F.when(n == 2, F.col("sql_list")[1]).alias("sql_2"))


@register("vote_top2_pairs", _top2_oracle(2))
def q_vote_top2_pairs(spark, sf_dir):
    """V3-V6 with two candidates per question: ties at the top, single
    groups and all-invalid fallbacks all occur."""
    execs = tables.event_executions(spark, sf_dir, n=2).drop("difficulty")
    return _flat_top2(vote.consensus(execs)["top2"])


@register("vote_top2", _top2_oracle(16))
def q_vote_top2(spark, sf_dir):
    return _flat_top2(_consensus(spark, sf_dir)["top2"])


@register("pass_at_n", "WITH " + _CANDIDATES_CTE + """
SELECT question_id, correct, sql FROM pass
""")
def q_pass_at_n(spark, sf_dir):
    return _consensus(spark, sf_dir)["pass_at_n"]


_ALL_INVALID_SQL = (
    "WITH c AS (\n"
    "  SELECT CAST(floor(event_id / 2) AS BIGINT) AS question_id, CAST(event_id % 2 AS INTEGER) AS ord,\n"
    "         'SELECT ''' || event_type || ''' /* candidate ' || CAST(event_id AS VARCHAR) || ' */' AS sql,\n"
    "         coalesce(event_type <> 'error', false) AS valid\n"
    "  FROM events)\n"
    "SELECT question_id, CAST(count(*) AS BIGINT) AS sampling_num, arg_min(sql, ord) AS sql\n"
    "FROM c GROUP BY question_id HAVING max(CASE WHEN valid THEN 1 ELSE 0 END) = 0\n")


@register("vote_all_invalid", _ALL_INVALID_SQL)
def q_vote_all_invalid(spark, sf_dir):
    """V6 with two candidates per question (so that some questions have no
    valid candidate at all): the fallback SQL is candidate 0."""
    return vote.all_invalid(tables.event_executions(spark, sf_dir, n=2)).select(
        "question_id", F.col("sampling_num").cast("bigint").alias("sampling_num"), "sql")


_ACC_SQL = """
SELECT level_ord, level, n, correct,
       CASE WHEN n > 0 THEN CAST(correct AS DOUBLE) * 100.0 / CAST(n AS DOUBLE) END AS accuracy
FROM (
  SELECT 0 AS level_ord, 'simple' AS level, CAST(count(*) FILTER (WHERE difficulty = 'simple') AS BIGINT) AS n,
         CAST(coalesce(sum(correct) FILTER (WHERE difficulty = 'simple'), 0) AS BIGINT) AS correct FROM {src}
  UNION ALL
  SELECT 1, 'moderate', CAST(count(*) FILTER (WHERE difficulty = 'moderate') AS BIGINT),
         CAST(coalesce(sum(correct) FILTER (WHERE difficulty = 'moderate'), 0) AS BIGINT) FROM {src}
  UNION ALL
  SELECT 2, 'challenging', CAST(count(*) FILTER (WHERE difficulty = 'challenging') AS BIGINT),
         CAST(coalesce(sum(correct) FILTER (WHERE difficulty = 'challenging'), 0) AS BIGINT) FROM {src}
  UNION ALL
  SELECT 3, 'total', CAST(count(*) AS BIGINT), CAST(coalesce(sum(correct), 0) AS BIGINT) FROM {src}
)
"""


@register("acc_by_difficulty", "WITH " + _CANDIDATES_CTE + _ACC_SQL.format(src="win"))
def q_acc_by_difficulty(spark, sf_dir):
    winner = _consensus(spark, sf_dir)["winner"]
    return metrics.accuracy_by_difficulty(tables.with_difficulty(winner))


@register("metric_fraction", "WITH " + _CANDIDATES_CTE + """
SELECT level, n, correct, CASE WHEN n > 0 THEN CAST(correct AS DOUBLE) / CAST(n AS DOUBLE) END AS fraction
FROM (
  SELECT coalesce(difficulty, 'simple') AS level, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(correct) AS BIGINT) AS correct
  FROM pass GROUP BY 1
  UNION ALL
  SELECT 'total', CAST(count(*) AS BIGINT), CAST(sum(correct) AS BIGINT) FROM pass
)
""")
def q_metric_fraction(spark, sf_dir):
    p = _consensus(spark, sf_dir)["pass_at_n"]
    return metrics.fraction_by_difficulty(tables.with_difficulty(p))


@register("metric_wide", "WITH " + _CANDIDATES_CTE + """,
acc AS (""" + _ACC_SQL.format(src="win") + """)
SELECT 'count' AS measure,
       max(CASE WHEN level = 'simple' THEN CAST(n AS DOUBLE) END) AS simple,
       max(CASE WHEN level = 'moderate' THEN CAST(n AS DOUBLE) END) AS moderate,
       max(CASE WHEN level = 'challenging' THEN CAST(n AS DOUBLE) END) AS challenging,
       max(CASE WHEN level = 'total' THEN CAST(n AS DOUBLE) END) AS total
FROM acc
UNION ALL
SELECT 'accuracy',
       max(CASE WHEN level = 'simple' THEN accuracy END),
       max(CASE WHEN level = 'moderate' THEN accuracy END),
       max(CASE WHEN level = 'challenging' THEN accuracy END),
       max(CASE WHEN level = 'total' THEN accuracy END)
FROM acc
""")
def q_metric_wide(spark, sf_dir):
    winner = _consensus(spark, sf_dir)["winner"]
    return metrics.score_grid(metrics.accuracy_by_difficulty(tables.with_difficulty(winner)))


@register("tp_ids", "WITH " + _CANDIDATES_CTE + """
SELECT CAST(question_id + 1 AS BIGINT) AS tp_id FROM win WHERE correct = 1
""")
def q_tp_ids(spark, sf_dir):
    return metrics.correct_ids(_consensus(spark, sf_dir)["winner"])


@register("three_curves", "WITH " + _CANDIDATES_CTE + """,
u AS (
  SELECT 'vote' AS metric, coalesce(difficulty, 'simple') AS level, correct FROM win
  UNION ALL SELECT 'pass_at_n', coalesce(difficulty, 'simple'), correct FROM pass
  UNION ALL SELECT 'top2', coalesce(difficulty, 'simple'), correct FROM top2
)
SELECT metric, level, n, correct, CAST(correct AS DOUBLE) / CAST(n AS DOUBLE) AS fraction FROM (
  SELECT metric, level, CAST(count(*) AS BIGINT) AS n, CAST(sum(correct) AS BIGINT) AS correct
  FROM u GROUP BY metric, level
  UNION ALL
  SELECT metric, 'total', CAST(count(*) AS BIGINT), CAST(sum(correct) AS BIGINT) FROM u GROUP BY metric
)
""")
def q_three_curves(spark, sf_dir):
    execs = _execs(spark, sf_dir)
    res = vote_and_score(execs)
    return res["curves"]


# ---------------------------------------------------------------------------
# Sinks of the vote run, read back (K5-K7) and the id check (M4)
# ---------------------------------------------------------------------------

@register("winner_sql_file", "WITH " + _CANDIDATES_CTE + """
SELECT replace(sql, chr(10), ' ') AS value FROM win
""")
def q_winner_sql_file(spark, sf_dir):
    """K5: winners written one per line in id order, read back as lines."""
    from sqltally.plans.consensus import write_winner_sql
    from sqltally.session import scratch_path
    path = scratch_path(spark, "winners")
    write_winner_sql(_consensus(spark, sf_dir)["winner"], path)
    return spark.read.text(path)


@register("top2_table", "WITH " + _CANDIDATES_CTE + """
SELECT question_id, CAST(CASE WHEN r_sql IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_entries,
       CAST(CASE WHEN has_valid = 1 THEN votes ELSE 0 END AS BIGINT) AS votes_1, sql AS sql_1, r_sql AS sql_2
FROM win
""")
def q_top2_table(spark, sf_dir):
    """K6: the top-2 table written as Parquet (input of a later merge step)."""
    from sqltally.plans.consensus import write_top2
    from sqltally.session import scratch_path
    path = scratch_path(spark, "top2")
    write_top2(_consensus(spark, sf_dir)["top2"], path)
    t = spark.read.parquet(path)
    n = F.size("sql_list")
    return t.select("question_id", n.cast("int").alias("n_entries"),
                    F.col("vote_list")[0].alias("votes_1"), F.col("sql_list")[0].alias("sql_1"),
                    F.when(n == 2, F.col("sql_list")[1]).alias("sql_2"))


@register("metric_document", "WITH " + _CANDIDATES_CTE + ", acc AS (" + _ACC_SQL.format(src="win") + """)
SELECT level, n, accuracy FROM acc
""")
def q_metric_document(spark, sf_dir):
    """K7: the metric document as one JSON line, read back and flattened."""
    from sqltally.session import scratch_path
    acc = metrics.accuracy_by_difficulty(tables.with_difficulty(_consensus(spark, sf_dir)["winner"]))
    path = scratch_path(spark, "metric")
    metrics.metric_document(acc).coalesce(1).write.text(path)
    levels = metrics.LEVELS + [metrics.TOTAL]
    schema = ("counts STRUCT<" + ", ".join(f"{lv}: BIGINT" for lv in levels) + ">, accuracy STRUCT<"
              + ", ".join(f"{lv}: DOUBLE" for lv in levels) + ">")
    doc = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    rows = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"d.counts.{lv}").alias("n"),
                              F.col(f"d.accuracy.{lv}").alias("accuracy")) for lv in levels])
    return doc.select(F.inline(rows))


@register("unmatched_ids", """
SELECT DISTINCT CAST(floor(event_id / 16) AS BIGINT) AS question_id, 'scores_only' AS side FROM events
WHERE CAST(floor(event_id / 16) AS BIGINT) NOT IN (SELECT item_id FROM benchmark)
UNION ALL
SELECT item_id, 'questions_only' FROM benchmark
WHERE item_id NOT IN (SELECT CAST(floor(event_id / 16) AS BIGINT) FROM events)
""")
def q_unmatched_ids(spark, sf_dir):
    """M4: scores (events-derived questions) against the question table
    (``benchmark``); the ids on one side only."""
    winner = _consensus(spark, sf_dir)["winner"]
    questions = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    return metrics.unmatched_ids(winner, questions)


def _grid_text_oracle(width: int = 20) -> str:
    levels = metrics.LEVELS + [metrics.TOTAL]
    cell = lambda e: f"rpad({e}, {width}, ' ')"
    head = " || ".join([cell("''")] + [cell(f"'{lv}'") for lv in levels])
    cnt = " || ".join([cell("'count'")] + [cell(f"coalesce(CAST(max(CASE WHEN level = '{lv}' THEN n END) AS VARCHAR), '')")
                                          for lv in levels])
    acc = " || ".join([cell("'accuracy'")] + [cell(f"coalesce(printf('%.2f', max(CASE WHEN level = '{lv}' THEN accuracy END)), '')")
                                             for lv in levels])
    return ("WITH " + _CANDIDATES_CTE + ", acc AS (" + _ACC_SQL.format(src="win") + ")\n"
            f"SELECT {head} || chr(10) || {cnt} || chr(10) || {acc} AS text FROM acc")


@register("metric_grid_text", _grid_text_oracle())
def q_metric_grid_text(spark, sf_dir):
    """K9 as printed text: levels, counts and accuracy to two decimals."""
    acc = metrics.accuracy_by_difficulty(tables.with_difficulty(_consensus(spark, sf_dir)["winner"]))
    return metrics.grid_text(acc)
