"""Comparing executed results.

* :func:`compare_results` - execution accuracy (EX) per question from the
  executions of predictions and gold: right when both ran and their result
  sets are equal; an empty result equals an empty result.
* :func:`sets_equal` - exact check of two results without hashing: anti joins
  both ways on canonical rows.
* :func:`diff_results` - rows only in one side, for side-by-side debugging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.functions.canonical import canonical_row, positional
from sqltally.operators.fingerprint import result_set
from sqltally.sources.stored import written_once


def compare_results(pred: DataFrame, gold: DataFrame, key: str = "question_id",
                    empty_counts: bool = True) -> DataFrame:
    """``pred`` and ``gold`` are execution frames (``valid, fp, n_distinct``).

    A full outer join keeps ids present on one side only (scored 0) so that no
    question silently disappears.
    """
    p = pred.select(key, F.col("valid").alias("p_valid"), F.col("fp").alias("p_fp"))
    g = gold.select(key, F.col("valid").alias("g_valid"), F.col("fp").alias("g_fp"),
                    F.col("n_distinct").alias("g_n"))
    j = p.join(g, key, "full_outer")
    ok = F.coalesce(F.col("p_valid"), F.lit(False)) & F.coalesce(F.col("g_valid"), F.lit(False)) \
        & F.col("p_fp").eqNullSafe(F.col("g_fp"))
    if not empty_counts:
        ok = ok & (F.col("g_n") > 0)
    return j.select(key, F.coalesce(ok, F.lit(False)).cast("int").alias("res"))


def sets_equal(a: DataFrame, b: DataFrame) -> bool:
    """Exact set equality (R2): both differences empty; arity must agree
    unless both results are empty."""
    ra, rb = result_set(a), result_set(b)
    if len(a.columns) != len(b.columns):
        return ra.isEmpty() and rb.isEmpty()
    return ra.join(rb, "row", "left_anti").isEmpty() and rb.join(ra, "row", "left_anti").isEmpty()


def _one_sided(ra: DataFrame, rb: DataFrame, sep: str) -> DataFrame:
    # one grouping of both sides: each side is scanned and shuffled once
    both = (ra.withColumn("_in_b", F.lit(0)).unionByName(rb.withColumn("_in_b", F.lit(1)))
            .groupBy("row").agg(F.min("_in_b").alias("_first"), F.max("_in_b").alias("_last")))
    side = F.when(F.col("_last") == 0, F.lit("a_only")).otherwise(F.lit("b_only"))
    return both.where(F.col("_first") == F.col("_last")).select(
        side.alias("side"), F.array_join("row", sep).alias("row_text"))


def diff_results(a: DataFrame, b: DataFrame, sep: str = "|") -> DataFrame:
    """Canonical rows only in ``a`` (side ``a_only``) or only in ``b``.

    Rows are shown as their canonical cells joined by ``sep``.
    """
    return _one_sided(result_set(a), result_set(b), sep)


def diff_by_ranges(a: DataFrame, b: DataFrame, bits: int = 12, levels: int = 2, sep: str = "|") -> DataFrame:
    """R6 for large results that are nearly equal: the same rows as :func:`diff_results`.

    A row's hash says its range; each range of each side has a digest (rows, sum
    and xor of two 64-bit hashes).  Ranges whose digests differ are cut into
    ``2 ** bits`` again, ``levels`` times in all, and only the rows of ranges that
    still differ are compared.  So equal tables move digests only, a range
    once a task.  Rows that one side merely repeats make a range differ, not the
    result.
    """
    if len(a.columns) != len(b.columns):
        return diff_results(a, b, sep)
    sides = []
    for df in (a, b):
        body = positional(df)
        row = body.select(canonical_row(body).alias("row"))
        sides.append(row.select("row", F.xxhash64("row").alias("h1"), F.xxhash64(F.lit("row"), "row").alias("h2")))
    prefix = lambda level: F.shiftrightunsigned("h1", 64 - bits * level)
    apart = None
    for level in range(1, levels + 1):
        digests = []
        for s in sides:
            rows = s if apart is None else s.withColumn("p", prefix(level - 1)).join(apart, "p", "left_semi")
            digests.append(rows.groupBy(prefix(level).alias("p")).agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("s"), F.bit_xor("h2").alias("x")))
        left, right = (d.select("p", F.struct("n", "s", "x").alias(c)) for d, c in zip(digests, "ab"))
        apart = written_once(left.join(right, "p", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("p"), "ranges-apart")
    kept = [s.withColumn("p", prefix(levels)).join(apart, "p", "left_semi").select("row").distinct() for s in sides]
    return _one_sided(*kept, sep)
