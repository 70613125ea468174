import datetime
import decimal
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sqltally.operators.fingerprint import EMPTY_FP, fingerprint, result_set


def fp(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return fingerprint(df).collect()[0]


def same(spark, a, sa, b, sb):
    return fp(spark, a, sa)["fp"] == fp(spark, b, sb)["fp"]


# Hand-worked cases of result equality (set semantics, typed by value).
def test_order_free(spark):
    s = "a long, b string"
    assert same(spark, [(1, "a"), (2, "b")], s, [(2, "b"), (1, "a")], s)


def test_duplicates_ignored(spark):
    assert same(spark, [(1,), (1,)], "a long", [(1,)], "a long")


def test_int_equals_double(spark):
    assert same(spark, [(1,)], "a long", [(1.0,)], "a double")


def test_int_equals_decimal_and_bool(spark):
    assert same(spark, [(1,)], "a long", [(decimal.Decimal("1.00"),)], "a decimal(10,2)")
    assert same(spark, [(1,)], "a int", [(True,)], "a boolean")


def test_half_decimal_equals_double(spark):
    assert same(spark, [(decimal.Decimal("0.50"),)], "a decimal(10,2)", [(0.5,)], "a double")


def test_text_not_number(spark):
    assert not same(spark, [(1,)], "a long", [("1",)], "a string")


def test_null_equals_null(spark):
    assert same(spark, [(None,)], "a long", [(None,)], "a string")


def test_null_not_empty_string(spark):
    assert not same(spark, [(None,)], "a string", [("",)], "a string")


def test_column_order_matters(spark):
    assert not same(spark, [(1, 2)], "a long, b long", [(2, 1)], "a long, b long")


def test_arity_matters(spark):
    assert not same(spark, [(1,)], "a long", [(1, 1)], "a long, b long")


def test_empty_equals_empty_any_arity(spark):
    a = fp(spark, [], "a long")
    b = fp(spark, [], "a long, b string")
    assert a["fp"] == b["fp"] == EMPTY_FP
    assert a["n_distinct"] == 0 and a["n_rows"] == 0


def test_big_integers_exact(spark):
    assert not same(spark, [(9007199254740993,)], "a long", [(9007199254740992,)], "a long")


def test_negative_zero(spark):
    assert same(spark, [(-0.0,)], "a double", [(0,)], "a long")


def test_nan_is_null(spark):
    assert same(spark, [(float("nan"),)], "a double", [(None,)], "a double")


def test_dates_as_text(spark):
    assert same(spark, [(datetime.date(2024, 1, 2),)], "a date", [("2024-01-02",)], "a string")


def test_counts(spark):
    r = fp(spark, [(1,), (1,), (2,)], "a long")
    assert (r["arity"], r["n_rows"], r["n_distinct"]) == (1, 3, 2)


def test_duplicate_column_names(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a")
    r = fingerprint(df).collect()[0]
    assert r["arity"] == 2 and r["n_distinct"] == 1


def test_property_shuffle_dup_repartition(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 50), rnd.choice(["x", "y", None]), rnd.random()) for _ in range(300)]
    schema = "a long, b string, c double"
    base = fp(spark, rows, schema)["fp"]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    assert fp(spark, shuffled + rows[:40], schema)["fp"] == base
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert fingerprint(df).collect()[0]["fp"] == base
    # any cell edit changes the fingerprint
    edited = rows[:]
    edited[5] = (edited[5][0] + 1000, edited[5][1], edited[5][2])
    assert fp(spark, edited, schema)["fp"] != base
    # a column swap changes it
    swapped = [(r[0], r[2], r[1]) for r in rows]
    assert fp(spark, swapped, "a long, c double, b string")["fp"] != base


def test_result_set_distinct(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a long")
    assert result_set(df).count() == 2


_TYPES = {"long": st.integers(-3, 3), "double": st.sampled_from([-1.0, 0.0, 1.0, 2.0, 2.5]),
          "string": st.sampled_from(["1", "2", "a", ""])}


@st.composite
def _result(draw, types):
    rows = draw(st.lists(st.tuples(*[st.one_of(st.none(), _TYPES[t]) for t in types]), max_size=6))
    return rows


@settings(max_examples=20, deadline=None)
@given(st.data())
def test_fingerprint_equals_python_set_semantics(spark, data):
    """Fingerprint equality == Python equality of the sets of row tuples
    (1 == 1.0, '1' != 1, None == None), with arity mattering unless both empty."""
    ta = data.draw(st.lists(st.sampled_from(list(_TYPES)), min_size=1, max_size=2))
    tb = data.draw(st.one_of(st.just(ta), st.lists(st.sampled_from(list(_TYPES)), min_size=1, max_size=2)))
    a, b = data.draw(_result(ta)), data.draw(_result(tb))
    if data.draw(st.booleans()):
        b = list(reversed(a)) + a[:1] if ta == tb else b  # same set, other order, a duplicate
    schema = lambda ts: ", ".join(f"c{i} {t}" for i, t in enumerate(ts))
    expect = (set(a) == set(b)) and (len(ta) == len(tb) or not a)
    if not a and not b:
        expect = True
    got = fp(spark, a, schema(ta))["fp"] == fp(spark, b, schema(tb))["fp"]
    assert got == expect, (ta, a, tb, b)


def test_range_diff_is_the_diff(spark):
    import random

    from sqltally.operators import compare
    r = random.Random(6)
    base = [(i % 700, r.choice(["x", "y", None]), r.random() < 0.5) for i in range(2000)]
    kind = "a int, b string, c boolean"
    a = spark.createDataFrame(base, kind)
    for rows in (base, base + base[:50], base[:-3], base + [(1, "new", None)], [(i + 1, s, c) for i, s, c in base], []):
        b = spark.createDataFrame(rows, kind)
        for bits, levels in ((12, 2), (2, 3), (1, 1)):
            want = sorted(tuple(x) for x in compare.diff_results(a, b).collect())
            assert sorted(tuple(x) for x in compare.diff_by_ranges(a, b, bits, levels).collect()) == want
    assert compare.diff_by_ranges(a, spark.range(3)).count() == compare.diff_results(a, spark.range(3)).count()
