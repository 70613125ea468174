"""Running SQL workloads read-only against Spark tables.

A *database* is a Spark session of its own (``spark.newSession()``: same
cluster, own temp views and SQL settings) with one temp view per table.
Candidate and gold statements run as ordinary Spark jobs; executors do all
the row work and each statement returns one fingerprint row.

Only statement texts (the control plane) pass through the driver: distinct
``(db_id, sql)`` pairs are streamed with ``toLocalIterator`` into a bounded
thread pool, each statement's jobs carry a job tag, and a deadline cancels
them by tag.  Finished rows are appended in batches to a results table under
``spark.checkpoint.dir``; a rerun skips statements already in it, so a lost
driver or executor costs at most one batch.
"""

from __future__ import annotations

import collections
import concurrent.futures as cf
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.operators.fingerprint import (EMPTY_FP, fingerprint, grouped_fingerprint_of_hashes,
                                            with_row_hashes)
from sqltally.session import scratch_path

# Error categories of the original kit, in matching order, with
# the SQLite message phrase and the Spark error condition that stand for each.
ERROR_CATEGORIES = [
    ("ambiguous column name", "AMBIGUOUS_REFERENCE"),
    ("no such column", "UNRESOLVED_COLUMN"),
    ("no such table", "TABLE_OR_VIEW_NOT_FOUND"),
    ("no such function", "UNRESOLVED_ROUTINE"),
    ("syntax error", "PARSE_SYNTAX_ERROR"),
]
OTHERS = "others"

# Rows a scan hands on between two looks at whether its task was cancelled: a
# slow expression goes on to the end of a batch, whatever the deadline.
ROWS_BETWEEN_CHECKS = 64

RESULT_SCHEMA = T.StructType([
    T.StructField("stmt_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("arity", T.IntegerType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_distinct", T.LongType()),
    T.StructField("fp", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
])


def category_of_condition(condition: str | None) -> str:
    """Category from a Spark error condition."""
    c = condition or ""
    for cat, cond in ERROR_CATEGORIES:
        if c.startswith(cond):
            return cat
    return OTHERS


def error_category(text: Column) -> Column:
    """X6 as a column function over logged error text (SQLite phrase or Spark
    condition), first match wins, in the fixed order."""
    expr = None
    for cat, cond in ERROR_CATEGORIES:
        hit = text.contains(cat) | text.contains(cond)
        expr = F.when(hit, F.lit(cat)) if expr is None else expr.when(hit, F.lit(cat))
    return expr.otherwise(F.lit(OTHERS))


def readonly_sql(sql: str) -> str:
    """Wrap a statement so only a query can run.

    DDL/DML inside ``SELECT * FROM ( ... )`` is a syntax error; CTEs, unions,
    ORDER BY ... LIMIT and duplicate column names still work.  A trailing
    ``;`` is removed and the newline before ``)`` keeps a trailing ``--``
    comment from swallowing it.
    """
    s = sql.strip()
    while s.endswith(";"):
        s = s[:-1].rstrip()
    return f"SELECT * FROM (\n{s}\n)"


@dataclass
class Database:
    """A named set of tables registered as temp views of their own session."""
    db_id: str
    session: SparkSession
    tables: dict = field(default_factory=dict)


def register_database(spark: SparkSession, db_id: str, tables: dict,
                      ansi: bool = False, cache: bool = False) -> Database:
    """``tables`` maps a view name to a Parquet path, a callable
    ``session -> DataFrame`` or a DataFrame.

    ANSI mode is off by default so that ``1/0`` is NULL as in SQLite.
    ``cache=True`` keeps base tables in memory when many statements scan them
    (sensible only where they fit the cluster's storage memory).
    """
    sess = spark.newSession()
    sess.conf.set("spark.sql.ansi.enabled", "true" if ansi else "false")
    for kind in ("parquet", "orc"):
        sess.conf.set(f"spark.sql.{kind}.columnarReaderBatchSize", str(ROWS_BETWEEN_CHECKS))
    frames = {}
    for name, src in tables.items():
        if isinstance(src, str):
            df = sess.read.parquet(src)
        elif callable(src):
            df = src(sess)
        else:  # a DataFrame of another session: share it through a global view
            gname = f"sqltally_{db_id}_{name}_{uuid.uuid4().hex[:8]}"
            src.createOrReplaceGlobalTempView(gname)
            df = sess.table(f"global_temp.{gname}")
        if cache:
            df = df.cache()
        df.createOrReplaceTempView(name)
        frames[name] = df
    return Database(db_id, sess, frames)


def statement_key(db_id: Column, sql: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", db_id, sql), 256)


def _error_row(e: Exception) -> dict:
    cond = e.getCondition() if hasattr(e, "getCondition") else None
    return {"status": "error", "detail": category_of_condition(cond),
            "message": (cond or type(e).__name__) + ": " + str(e)}


def _with_deadline(sc, timeout: float | None, fn):
    """Run ``fn()`` with its jobs tagged; cancel them by tag at the deadline.

    After the deadline the watchdog keeps cancelling the tag until ``fn``
    returns, so a job submitted just after the first cancel (planning can
    outlast a short deadline) is stopped too.  Spark cancellation is
    cooperative: a killed task stops at its next check; on a cluster,
    ``spark.task.reaper.enabled`` with ``spark.task.reaper.killTimeout``
    recycles executors whose tasks do not.  Driver-side planning (e.g.
    constant-folding a huge literal) cannot be interrupted.

    Returns ``(value, exception, timed_out)``."""
    tag = f"sqltally-{uuid.uuid4().hex}"
    fired = threading.Event()
    done = threading.Event()

    def watchdog():
        if done.wait(timeout):
            return
        fired.set()
        while not done.is_set():
            sc.cancelJobsWithTag(tag)
            done.wait(0.5)

    sc.addJobTag(tag)
    guard = threading.Thread(target=watchdog, daemon=True) if timeout else None
    try:
        if guard:
            guard.start()
        return fn(), None, False
    except Exception as e:  # noqa: BLE001 - reported as a row by the caller
        return None, e, fired.is_set()
    finally:
        done.set()
        sc.removeJobTag(tag)


def run_one(db: Database, sql: str, timeout: float | None) -> dict:
    """Run one statement under a deadline; never raises."""
    sess = db.session
    t0 = time.time()

    def go():
        df = sess.sql(readonly_sql(sql))  # analysis errors surface here, no job
        return fingerprint(df).collect()[0]

    row, err, timed_out = _with_deadline(sess.sparkContext, timeout, go)
    if err is None:
        out = {"status": "success", "detail": None, "message": None,
               "arity": int(row["arity"]), "n_rows": int(row["n_rows"]),
               "n_distinct": int(row["n_distinct"]), "fp": row["fp"]}
    elif timed_out:
        out = {"status": "timeout", "detail": None, "message": "execute sql timeout."}
    else:
        out = _error_row(err)
    out["seconds"] = time.time() - t0
    return out


class PlanResults:
    """Results of statements by the meaning of their analysed plans, of one database and run.

    Statements that differ in spelling only (spaces, case, table aliases, order of
    a conjunction) have equal plans and run once.  Plans are found by
    ``semanticHash`` and confirmed by ``sameSemantics``.  The last ``most`` plans
    are kept; one that is not there any more runs again.
    """

    def __init__(self, most: int = 4096):
        self.most, self.plans, self.lock, self.reused = most, collections.OrderedDict(), threading.Lock(), 0

    def find(self, df: DataFrame) -> dict | None:
        with self.lock:
            near = list(self.plans.get(df.semanticHash(), ()))
        for other, result in near:
            if other.sameSemantics(df):
                with self.lock:
                    self.reused += 1
                return {**result, "seconds": 0.0}
        return None

    def add(self, df: DataFrame, result: dict) -> None:
        if result["status"] == "success":
            with self.lock:
                self.plans.setdefault(df.semanticHash(), []).append((df, result))
                while len(self.plans) > self.most:
                    self.plans.popitem(last=False)


def run_batch(db: Database, items: list[tuple[str, str]], timeout: float | None,
              known: PlanResults | None = None) -> list[dict]:
    """Run several statements of one database as one Spark job.

    Each statement is analysed alone (errors need no job), and those of equal
    meaning run once; the rest are hashed and fingerprinted together, grouped by
    statement key.  If the job fails or misses the sum of their deadlines, every
    statement is run alone, so a bad or slow statement gets its own status and
    the others theirs.
    """
    known = known or PlanResults()
    out, first, again = [], [], []
    for key, sql in items:
        t0 = time.time()
        try:
            df = db.session.sql(readonly_sql(sql))
        except Exception as e:  # noqa: BLE001
            out.append({**_error_row(e), "stmt_key": key, "seconds": time.time() - t0})
            continue
        result = known.find(df)
        if result is not None:
            out.append({**result, "stmt_key": key})
        elif any(df.semanticHash() == d.semanticHash() and df.sameSemantics(d) for _, _, d in first):
            again.append((key, sql, df))
        else:
            first.append((key, sql, df))
    ran = {r["stmt_key"]: r for r in _run_together(db, first, timeout)}
    for key, _, df in first:
        known.add(df, ran[key])
    for key, sql, df in again:
        ran[key] = {**(known.find(df) or run_one(db, sql, timeout)), "stmt_key": key}
    return out + list(ran.values())


def _run_together(db: Database, analysed: list[tuple[str, str, DataFrame]], timeout: float | None) -> list[dict]:
    out: list[dict] = []
    if len(analysed) <= 1:
        return out + [{**run_one(db, sql, timeout), "stmt_key": key} for key, sql, _ in analysed]

    parts = [with_row_hashes(df).select(F.lit(key).alias("stmt_key"), "h1", "h2")
             for key, _, df in analysed]
    union = parts[0]
    for p_ in parts[1:]:
        union = union.unionAll(p_)
    summary = grouped_fingerprint_of_hashes(union, ["stmt_key"])
    t0 = time.time()
    limit = timeout * len(analysed) if timeout else timeout
    rows, err, _ = _with_deadline(db.session.sparkContext, limit, summary.collect)
    if err is not None:
        return out + [{**run_one(db, sql, timeout), "stmt_key": key} for key, sql, _ in analysed]
    elapsed = time.time() - t0
    got = {r["stmt_key"]: r for r in rows}
    for key, _, df in analysed:
        arity = len(df.columns)
        r = got.get(key)
        if r is None:  # no rows at all: the empty result
            out.append({"stmt_key": key, "status": "success", "detail": None, "message": None,
                        "arity": arity, "n_rows": 0, "n_distinct": 0, "fp": EMPTY_FP, "seconds": elapsed})
        else:
            out.append({"stmt_key": key, "status": "success", "detail": None, "message": None,
                        "arity": arity, "n_rows": int(r["n_rows"]), "n_distinct": int(r["n_distinct"]),
                        "fp": f"{arity}|{r['n_distinct']}|{r['s1']}|{r['x2']}", "seconds": elapsed})
    return out


def run_workload(spark: SparkSession, statements: DataFrame, databases: dict,
                 timeout: float | None = 30.0, parallelism: int = 16,
                 results_path: str | None = None, batch_size: int = 256,
                 statements_per_job: int = 8) -> DataFrame:
    """Execute every ``(db_id, sql)`` row of ``statements``.

    Returns ``statements`` with ``stmt_key, status, detail, message, valid,
    arity, n_rows, n_distinct, fp, seconds``.  Identical statements on the
    same database run once, and so do those whose analysed plans mean the same
    (:class:`PlanResults`); up to ``statements_per_job`` statements of one
    database share a Spark job (:func:`run_batch`).  A NULL ``sql`` is status
    ``no_sql``.  ``results_path`` (default: a new folder under
    ``spark.checkpoint.dir``) makes the run resumable; results are appended
    every ``batch_size`` statements.

    Sharing jobs pays off for many light statements.  A shared job has as much
    time as its statements have together; when it misses that, they run again
    one by one, each under its own deadline.

    The statements are written before the first one runs: a frame that comes
    from a sampling model must not be evaluated twice.  Stored timeouts and
    errors that are not the statement's own (e.g. a lost executor) run again.
    """
    results_path = results_path or scratch_path(spark, "workload")
    keyed_path = scratch_path(spark, "statements")
    statements.withColumn("stmt_key", statement_key(F.col("db_id"), F.col("sql"))).write.parquet(keyed_path)
    keyed = spark.read.parquet(keyed_path)
    todo = keyed.filter(F.col("sql").isNotNull()).select("stmt_key", "db_id", "sql") \
                .dropDuplicates(["stmt_key"])
    done = _read_results(spark, results_path)
    if done is not None:
        final = _latest(done).filter((F.col("status") == "success") | (F.col("status") == "error")
                                     & (F.coalesce("detail", F.lit("others")) != "others"))
        todo = todo.join(final.select("stmt_key"), "stmt_key", "left_anti")

    pending: list[dict] = []

    def flush():
        if pending:
            spark.createDataFrame(pending, RESULT_SCHEMA).write.mode("append").parquet(results_path)
            pending.clear()

    known = {d: PlanResults() for d in databases}

    def task(db_id, items):
        db = databases.get(db_id)
        if db is None:
            return [{"stmt_key": k, "status": "error", "detail": "no such table",
                     "message": f"unknown database {db_id}", "seconds": 0.0} for k, _ in items]
        return run_batch(db, items, timeout, known[db_id])

    with cf.ThreadPoolExecutor(max_workers=parallelism) as pool:
        inflight: set = set()
        buffers: dict = {}

        def submit(db_id):
            inflight.add(pool.submit(task, db_id, buffers.pop(db_id)))

        for r in todo.toLocalIterator():
            buffers.setdefault(r["db_id"], []).append((r["stmt_key"], r["sql"]))
            if len(buffers[r["db_id"]]) >= statements_per_job:
                submit(r["db_id"])
            if len(inflight) >= 2 * parallelism:
                finished, inflight = cf.wait(inflight, return_when=cf.FIRST_COMPLETED)
                pending.extend(_rows(finished))
                if len(pending) >= batch_size:
                    flush()
        for db_id in list(buffers):
            submit(db_id)
        finished, _ = cf.wait(inflight)
        pending.extend(_rows(finished))
        flush()

    results = _read_results(spark, results_path)
    if results is None:
        results = spark.createDataFrame([], RESULT_SCHEMA)
    out = keyed.join(_latest(results), "stmt_key", "left")
    return out.withColumn("status", F.when(F.col("sql").isNull(), F.lit("no_sql")).otherwise(F.col("status"))) \
              .withColumn("valid", F.coalesce(F.col("status") == "success", F.lit(False)))


def _rows(futures) -> list[dict]:
    rows = []
    for f in futures:
        for r in f.result():
            rows.append({k: r.get(k) for k in RESULT_SCHEMA.fieldNames()})
    return rows


def _read_results(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(path).withColumn("_at", F.col("_metadata.file_modification_time"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # nothing written yet
            return None
        raise


def _latest(results: DataFrame) -> DataFrame:
    """The last stored result of each statement; a success counts before any failure."""
    if "_at" not in results.columns:
        return results
    names = [c for c in results.columns if c not in ("stmt_key", "_at")]
    order = F.struct((F.col("status") == "success").cast("int"), F.col("_at"))
    return results.groupBy("stmt_key").agg(F.max_by(F.struct(*names), order).alias("r")).select("stmt_key", "r.*")


def status_summary(execs: DataFrame) -> DataFrame:
    """How many statements ended in each status and error category."""
    return execs.groupBy("status", "detail").agg(F.count(F.lit(1)).alias("n"))


def run_rows(db: Database, sql: str) -> DataFrame:
    """The rows of one statement as they are (read-only wrapper, lazy)."""
    return db.session.sql(readonly_sql(sql))
