"""Result sets as sets (R2) and as hashable keys.

A result set is reduced on the executors to one row::

    arity, n_rows, n_distinct, fp

``fp`` is an order-free, duplicate-free fingerprint: every canonical row is
hashed twice with independent salts (128 bits), rows are de-duplicated on the
hash pair (a 16-byte shuffle key instead of the whole row), and the distinct
pairs are folded with ``sum`` (exact, DECIMAL(38,0)) and ``bit_xor``.  Any
empty result gets the same constant fingerprint regardless of arity, because
two empty sets are equal.  Only this one row ever reaches the driver.

For an exact check without hashing use :func:`result_set` with
``compare.sets_equal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.functions.canonical import canonical_cell, canonical_row, positional

EMPTY_FP = "empty"
SALT = "sqltally/second-hash"


def with_row_hashes(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``h1, h2`` (two salted xxhash64 of the canonical row).

    Columns listed in ``keep`` are carried through unhashed; all others form
    the row, by position (duplicate result column names are fine).
    """
    keep = list(keep or [])
    names = df.columns
    keep_idx = [names.index(k) for k in keep]
    renamed = positional(df)
    body = [f for i, f in enumerate(renamed.schema.fields) if i not in keep_idx]
    arr = F.array(*[canonical_cell(F.col(f.name), f.dataType) for f in body])
    return renamed.select(*[F.col(f"c{i}").alias(k) for i, k in zip(keep_idx, keep)],
                          F.xxhash64(arr).alias("h1"),
                          F.xxhash64(F.lit(SALT), arr).alias("h2"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One-row summary ``(arity, n_rows, n_distinct, fp)`` of a result."""
    arity = len(df.columns)
    hashed = with_row_hashes(df)
    distinct = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    summary = distinct.agg(
        F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
        F.sum(F.col("h1").cast("decimal(38,0)")).alias("s1"),
        F.bit_xor("h2").alias("x2"),
    )
    return summary.select(
        F.lit(arity).alias("arity"),
        "n_rows",
        "n_distinct",
        F.when(F.col("n_distinct") == 0, F.lit(EMPTY_FP)).otherwise(
            F.format_string("%d|%d|%s|%d", F.lit(arity), F.col("n_distinct"),
                            F.col("s1").cast("string"), F.col("x2"))).alias("fp"),
    )


def grouped_fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint per key group, e.g. many results stacked in one table.

    ``df`` holds key columns plus the result columns (same arity for all
    groups).  Work is two partial-aggregating shuffles; a hot key group is
    split across map tasks by the partial aggregation.
    """
    arity = len(df.columns) - len(keys)
    hashed = with_row_hashes(df, keep=keys)
    distinct = hashed.groupBy(*keys, "h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    summary = distinct.groupBy(*keys).agg(
        F.sum("m").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
        F.sum(F.col("h1").cast("decimal(38,0)")).alias("s1"),
        F.bit_xor("h2").alias("x2"),
    )
    return summary.select(
        *keys,
        F.lit(arity).alias("arity"),
        "n_rows",
        "n_distinct",
        F.format_string("%d|%d|%s|%d", F.lit(arity), F.col("n_distinct"),
                        F.col("s1").cast("string"), F.col("x2")).alias("fp"),
    )


def grouped_fingerprint_of_hashes(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``n_rows, n_distinct, s1, x2`` from ``keys + h1, h2`` rows
    (several results stacked, e.g. a batch of statements)."""
    distinct = hashed.groupBy(*keys, "h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    return distinct.groupBy(*keys).agg(
        F.sum("m").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
        F.sum(F.col("h1").cast("decimal(38,0)")).cast("string").alias("s1"),
        F.bit_xor("h2").alias("x2"))


def result_set(df: DataFrame) -> DataFrame:
    """The result as a set of canonical rows (R2): one ``row`` array column."""
    body = positional(df)
    return body.select(canonical_row(body).alias("row")).distinct()
