import pytest
from pyspark.sql import functions as F

from sqltally.operators import compare, execute
from sqltally.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(spark):
    return execute.register_database(spark, "star", {
        "orders": f"{SF}/orders.parquet", "customer": f"{SF}/customer.parquet",
        "region": f"{SF}/region.parquet"})


# Error categories of failing statements on ``orders``.
@pytest.mark.parametrize("sql,category", [
    ("select nocol from orders", "no such column"),
    ("select * from notab", "no such table"),
    ("select nofn(1) from orders", "no such function"),
    ("selec 1", "syntax error"),
    ("select o_custkey from orders a join orders b on a.o_orderkey = b.o_orderkey", "ambiguous column name"),
    ("drop view orders", "syntax error"),
    ("select o_orderkey, count(*) from orders", "others"),
])
def test_error_categories(db, sql, category):
    r = execute.run_one(db, sql, timeout=30)
    assert r["status"] == "error"
    assert r["detail"] == category


def test_ansi_off_division(db):
    r = execute.run_one(db, "select 1/0", timeout=30)
    assert r["status"] == "success" and r["n_rows"] == 1


def test_ansi_on_division_is_error(spark):
    d = execute.register_database(spark, "x", {"region": f"{SF}/region.parquet"}, ansi=True)
    r = execute.run_one(d, "select 1/0", timeout=30)
    assert r["status"] == "error" and r["detail"] == "others"


def test_readonly_wrapper_keeps_queries(db):
    for sql in ["WITH a AS (SELECT 1 AS x) SELECT x FROM a;",
                "SELECT 1 AS a UNION ALL SELECT 2 -- trailing comment",
                "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3",
                "SELECT 1 AS a, 2 AS a"]:
        assert execute.run_one(db, sql, timeout=30)["status"] == "success", sql


def test_timeout_cancels(db):
    # data-dependent bounds: nothing the optimizer can fold on the driver
    slow = ("SELECT count(*) FROM orders "
            "LATERAL VIEW explode(sequence(1, CAST(o_custkey % 7 AS INT) + 1000000)) a AS x "
            "LATERAL VIEW explode(sequence(1, CAST(o_orderkey % 5 AS INT) + 1000)) b AS y")
    r = execute.run_one(db, slow, timeout=1.0)
    assert r["status"] == "timeout"
    assert r["seconds"] < 20


def test_run_workload_dedupes_and_never_aborts(spark, db):
    stmts = spark.createDataFrame([
        (0, 0, "star", "SELECT COUNT(*) FROM orders"),
        (0, 1, "star", "SELECT COUNT(*) FROM orders"),
        (0, 2, "star", "SELECT bad FROM orders"),
        (0, 3, "star", None),
        (0, 4, "nodb", "SELECT 1"),
    ], "question_id long, ord int, db_id string, sql string")
    path = scratch_path(spark, "t-workload")
    out = execute.run_workload(spark, stmts, {"star": db}, timeout=30, parallelism=2, results_path=path)
    rows = {r.ord: r for r in out.collect()}
    assert rows[0].status == rows[1].status == "success" and rows[0].fp == rows[1].fp
    assert rows[2].status == "error" and rows[2].detail == "no such column"
    assert rows[3].status == "no_sql" and rows[3].valid is False
    assert rows[4].status == "error"
    assert spark.read.parquet(path).count() == 3  # distinct statements ran once
    # a rerun resumes: nothing new is executed
    again = execute.run_workload(spark, stmts, {"star": db}, timeout=30, parallelism=2, results_path=path)
    assert again.count() == 5 and spark.read.parquet(path).count() == 3


def test_compare_results_and_exact_sets(spark, db):
    pred = spark.createDataFrame([(0, True, "a", 1), (1, False, None, None), (2, True, "empty", 0)],
                                 "question_id long, valid boolean, fp string, n_distinct long")
    gold = spark.createDataFrame([(0, True, "a", 1), (1, True, "b", 1), (2, True, "empty", 0), (3, True, "c", 1)],
                                 "question_id long, valid boolean, fp string, n_distinct long")
    res = {r.question_id: r.res for r in compare.compare_results(pred, gold).collect()}
    assert res == {0: 1, 1: 0, 2: 1, 3: 0}
    a = execute.run_rows(db, "SELECT r_name FROM region")
    b = execute.run_rows(db, "SELECT DISTINCT r_name FROM region ORDER BY r_name")
    assert compare.sets_equal(a, b)
    c = execute.run_rows(db, "SELECT r_name, r_regionkey FROM region")
    assert not compare.sets_equal(a, c)
    diff = compare.diff_results(a, execute.run_rows(db, "SELECT r_name FROM region WHERE r_regionkey > 0"))
    assert diff.filter(F.col("side") == "a_only").count() >= 1


def test_batch_equals_single(db):
    items = [("a", "SELECT r_name FROM region"), ("b", "SELECT COUNT(*) FROM orders"),
             ("c", "SELECT * FROM region WHERE r_regionkey < 0"), ("d", "SELECT nocol FROM region"),
             ("e", "SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus")]
    batch = {r["stmt_key"]: r for r in execute.run_batch(db, items, timeout=30)}
    for key, sql in items:
        one = execute.run_one(db, sql, timeout=30)
        for f in ("status", "detail", "arity", "n_rows", "n_distinct", "fp"):
            assert batch[key].get(f) == one.get(f), (key, f)


def test_batch_falls_back_on_timeout(db):
    # data-dependent bounds: nothing the optimizer can fold on the driver
    slow = ("SELECT count(*) FROM orders "
            "LATERAL VIEW explode(sequence(1, CAST(o_custkey % 7 AS INT) + 1000000)) a AS x "
            "LATERAL VIEW explode(sequence(1, CAST(o_orderkey % 5 AS INT) + 1000)) b AS y")
    items = [("fast", "SELECT COUNT(*) FROM region"), ("slow", slow)]
    got = {r["stmt_key"]: r for r in execute.run_batch(db, items, timeout=6.0)}
    assert got["fast"]["status"] == "success"
    assert got["slow"]["status"] == "timeout"


def test_statements_of_equal_meaning_run_once(spark):
    db = execute.register_database(spark, "d", {"t": spark.range(10).selectExpr("id", "id % 3 as m")})
    known = execute.PlanResults()
    items = [("a", "SELECT id FROM t WHERE m = 1 AND id > 2"), ("b", "select  y.ID from t y where Id > 2 and y.m = 1;"),
             ("c", "SELECT id FROM t WHERE m = 2"), ("d", "SELECT nope FROM t"), ("e", "SELECT id, m FROM t WHERE m = 2")]
    got = {r["stmt_key"]: r for r in execute.run_batch(db, items, 30, known)}
    alone = {k: execute.run_one(db, s, 30) for k, s in items}
    for k in "abcde":
        assert (got[k]["status"], got[k].get("fp"), got[k].get("n_rows")) == (alone[k]["status"], alone[k].get("fp"), alone[k].get("n_rows"))
    assert known.reused == 1 and got["b"]["seconds"] == 0.0
    more = execute.run_batch(db, [("f", "SELECT x.id FROM t x WHERE x.m = 2"), ("g", "SELECT rand() FROM t"), ("h", "SELECT rand() FROM t WHERE true")], 30, known)
    assert {r["stmt_key"]: r for r in more}["f"]["fp"] == got["c"]["fp"] and known.reused == 2


def test_kept_plans_are_bounded(spark):
    db = execute.register_database(spark, "d", {"t": spark.range(3).toDF("id")})
    known = execute.PlanResults(most=2)
    for i in range(5):
        execute.run_batch(db, [(str(i), f"SELECT id + {i} FROM t")], 30, known)
    assert len(known.plans) == 2 and execute.run_batch(db, [("x", "SELECT id + 0 FROM t")], 30, known)[0]["n_rows"] == 3
