"""Keys, references and defaults found in small tables."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from sqltally.operators import keys, profile
from sqltally.session import scratch_path
from sqltally.sources import files, sinks


@pytest.fixture(scope="module")
def tables(spark):
    n = 400
    day = dt.date(2020, 1, 1)
    order = spark.createDataFrame([(i, 1000 + 5 * i, i % 20, i // 20, f"name {i}", None if i == 3 else i, "open" if i % 3 else f"s{i}",
                                    day + dt.timedelta(i % 7)) for i in range(n)],
                                  "id long, code int, x int, y long, name string, holey int, state string, day date")
    item = spark.createDataFrame([(i % 50, 1000 + 5 * (i % 30), "name 7", i % 401, day) for i in range(600)],
                                 "order_id int, code long, name string, most int, day date")
    days = spark.createDataFrame([(day + dt.timedelta(i), i) for i in range(7)], "day date, number int")
    return {"order": order, "item": item, "days": days, "empty": spark.createDataFrame([], "id long, t string"),
            "nothing": spark.createDataFrame([([1],)], "a array<int>")}


def test_keys_are_minimal_and_exact(tables):
    found = set(keys.candidate_keys(tables))
    want = {("order", (c,)) for c in ("id", "code", "name")} | {("order", ("x", "y")), ("days", ("day",)), ("days", ("number",))}
    assert {k for k in found if k[0] in ("order", "days")} == want
    assert not any(t in ("empty", "nothing") for t, _ in found)
    assert set(keys.candidate_keys(tables, most=1)) == {k for k in found if len(k[1]) == 1}


def test_near_unique_is_no_key(spark):
    df = spark.createDataFrame([(max(i, 1), f"{i}", "a" * 100_000 if i < 2 else str(i)) for i in range(3000)], "a int, b string, c string")
    assert keys.candidate_keys({"t": df}) == [("t", ("b",))]


def test_inclusion_finds_what_holds(tables):
    got = {(r.table_name, r.column_name, r.ref_table, r.ref_column): r.n_values
           for r in keys.inclusion_dependencies(tables, keys.candidate_keys(tables, most=1)).collect()}
    assert got["item", "order_id", "order", "id"] == 50 and got["item", "code", "order", "code"] == 30
    assert got["item", "name", "order", "name"] == 1 and got["order", "day", "days", "day"] == 7
    assert ("item", "most", "order", "id") not in got  # 400 is missing
    assert ("order", "holey", "order", "id") in got  # nulls don't count
    assert not any(a == b for a, b in (((k[0], k[1]), (k[2], k[3])) for k in got))
    assert all(k[2:] not in {("order", "x"), ("item", "order_id")} for k in got)


def test_only_what_holds_is_kept(spark, tables):
    declared = spark.createDataFrame([("d", "item", "order_id", "order", "id"), ("d", "item", "most", "order", "id")],
                                     "db_id string, table_name string, column_name string, ref_table string, ref_column string")
    found = keys.inclusion_dependencies(tables, keys.candidate_keys(tables, most=1))
    assert [r.column_name for r in keys.holding(declared, found).collect()] == ["order_id"]


def test_no_tables_with_keys(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    assert keys.inclusion_dependencies({"t": df}, keys.candidate_keys({"t": df})).count() == 0
    assert [tuple(r) for r in keys.column_defaults({"t": df}, []).collect()] == [("t", "a", "1", False)]


def test_defaults_and_counters(spark, tables):
    facts = keys.database_facts(spark, tables, most=1)
    got = {(r.table_name, r.column_name): (r.default, r.autoincrement) for r in facts["defaults"].collect()}
    assert got["order", "id"] == (None, True) and got["order", "code"] == (None, True)
    assert got["order", "state"] == ("open", False) and got["item", "name"] == ("name 7", False)
    assert got["item", "day"] == ("2020-01-01", False) and got["order", "holey"] == (None, False)
    assert got["days", "number"] == (None, True) and got["empty", "id"] == (None, False)


def test_gaps_and_single_rows_do_not_count(spark):
    t = {"gap": spark.createDataFrame([(1,), (2,), (4,), (5,), (9,)], "a long"), "one": spark.createDataFrame([(7,)], "a long"),
         "half": spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "a long, b string"),
         "far": spark.createDataFrame([(-2**63,), (2**63 - 1,)], "a long")}
    got = {(r.table_name, r.column_name): (r.default, r.autoincrement) for r in keys.column_defaults(t, keys.candidate_keys(t, 1)).collect()}
    assert got["gap", "a"] == (None, False) and got["one", "a"] == ("7", False)
    assert got["half", "b"] == (None, False) and got["half", "a"] == (None, True) and got["far", "a"] == (None, True)


def test_declared_default_comes_first(spark):
    kind = T.StructType([T.StructField("a", T.StringType(), True, {"CURRENT_DEFAULT": "'new'"}), T.StructField("b", T.IntegerType())])
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], kind)
    assert {r.column_name: r.default for r in keys.column_defaults({"t": df}, []).collect()} == {"a": "'new'", "b": None}
    assert {r.column_name: r.default for r in profile.profile_columns(spark, "d", {"t": df}).collect()} == {"a": "'new'", "b": None}


def test_schema_document_keeps_all_fields(spark):
    cols = spark.createDataFrame([("d", "t", 0, "a", "INT", True, False, "7", True, "first", ["1", "2"]),
                                  ("d", "t", 1, "b", "STRING", None, True, None, None, None, None)],
                                 "db_id string, table_name string, position int, column_name string, type string, primary_key boolean, "
                                 "nullable boolean, default string, autoincrement boolean, comment string, examples array<string>")
    fks = spark.createDataFrame([("d", "t", "a", "u", "x")], "db_id string, table_name string, column_name string, ref_table string, ref_column string")
    comments = spark.createDataFrame([("d", "t", "all of it")], "db_id string, table_name string, comment string")
    path = scratch_path(spark, "schema")
    sinks.save_schema(cols, fks, path, comments=comments)
    back = files.load_schema(spark, path)
    rows = {r.column_name: r.asDict() for r in back["columns"].collect()}
    assert rows["a"] | {"position": 0} == cols.first().asDict()
    assert (rows["b"]["default"], rows["b"]["autoincrement"], rows["b"]["comment"], rows["b"]["examples"]) == (None, False, "", [])
    assert [tuple(r) for r in back["tables"].collect()] == [("d", "t", "all of it")]
    assert back["foreign_keys"].count() == 1


def test_sets_with_a_value_seen_twice_are_not_counted(spark, tables, monkeypatch):
    want = keys.candidate_keys(tables)
    monkeypatch.setattr(keys, "MANY_ROWS", 1)
    monkeypatch.setattr(keys, "PARTS", 2)
    counted, exact = [], keys._unique
    monkeypatch.setattr(keys, "_unique", lambda t, c: counted.extend(c) or exact(t, c))
    assert set(keys.candidate_keys(tables)) == set(want)
    nan = spark.createDataFrame([(i, float("nan") if i < 2 else i / 3, f"{i % 90}") for i in range(100)], "id int, near double, text string")
    counted.clear()
    assert keys.candidate_keys({"t": nan}, most=1) == [("t", ("id",))] and ("t", ("text",)) not in counted
