"""Position-keyed files read by many tasks.

A gold file, a JSON array and a JSON object say a record's id by its place only.
Spark splits such files at any byte range (the text source, with a separator of
choice); what a split needs to know of the text before it is a sum over the
splits before, so each place comes from a sum within its split and one number
a split:

* a line's number: lines before it;
* for JSON, cut at commas: unescaped quotes before a piece (odd: it begins inside
  a string), then brackets open before it, then elements ended before it.  A
  comma ends an element where it stands outside strings at depth one.

Parts of a folder count as one text, in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["_file", "_block"]


def _records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(_file, _block, _row, value): records in the order of ``_row`` within each split."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                    F.monotonically_increasing_id().alias("_row"), "value")


def _before(totals: DataFrame, total: str) -> DataFrame:
    """For each split the sum of ``total`` over the splits before; one row a split, so one task can add them up."""
    return totals.withColumn(total, F.sum(total).over(Window.orderBy(*_SPLIT)) - F.col(total))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): the lines of a file or folder with their numbers from 0 on."""
    rows = _records(spark, path)
    splits = rows.groupBy(*_SPLIT).agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"))
    return rows.join(_before(splits, "_lines"), _SPLIT).select(
        (F.col("_lines") + F.col("_row") - F.col("_first")).alias("position"), "value")


def _running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before each."""
    rows = rows.withColumn("_amount", amount)
    totals = rows.groupBy(*_SPLIT).agg(F.sum("_amount").alias("_total"))
    here = F.sum("_amount").over(Window.partitionBy(*_SPLIT).orderBy("_row")) - F.col("_amount")
    return rows.join(_before(totals, "_total"), _SPLIT).withColumn(name, F.col("_total") + here).drop("_amount", "_total")


def _many(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(position, element): the elements of one JSON array, or the ``"key": value`` entries of one JSON object, as text.

    Text that is no JSON has elements that don't parse; an empty array or object has none.
    """
    rows = _records(spark, path, ",")
    # a part's last piece goes on in the next part without a comma
    ends = rows.groupBy("_file").agg(F.max(F.struct("_block", "_row")).alias("_end"))
    rows = rows.join(ends, "_file").withColumn(
        "_comma", F.when(F.struct("_block", "_row") == F.col("_end"), F.lit("")).otherwise(F.lit(","))).drop("_end")
    rows = rows.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))  # an escape never holds a comma
    rows = _running(rows, _many(F.col("_plain"), '"'), "_quotes")
    inside = F.col("_quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), "_plain"), '(?s)"[^"]*("|$)', "")
    rows = rows.withColumn("_open", (F.col("_quotes") + _many(F.col("_plain"), '"')) % 2 == 1).withColumn("_plain", outside)
    deeper = sum((_many(F.col("_plain"), c) for c in "[{"), F.lit(0)) - sum((_many(F.col("_plain"), c) for c in "]}"), F.lit(0))
    rows = _running(rows.withColumn("_deeper", deeper).drop("_plain"), F.col("_deeper"), "_depth")
    after = F.col("_depth") + F.col("_deeper")
    ended = ~F.col("_open") & (after == 1) & (F.col("_comma") == ",")
    rows = _running(rows.withColumn("_ended", ended.cast("int")).withColumn("_closed", ~F.col("_open") & (after == 0)),
                    F.col("_ended"), "position")
    # the comma that ends an element is not part of it
    text = F.concat("value", F.when(F.col("_ended") == 1, F.lit("")).otherwise(F.col("_comma")))
    parts = rows.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("_file", "_block", "_row", text.alias("t")))).alias("p"),
                                         F.max("_closed").alias("closed"))
    whole = F.array_join(F.transform("p", lambda s: s["t"]), "")
    whole = F.when(F.col("position") == 0, F.regexp_replace(whole, r"^﻿?\s*[\[{]", "")).otherwise(whole)
    whole = F.when(F.col("closed"), F.regexp_replace(whole, r"[\]}]\s*$", "")).otherwise(whole)
    return parts.select("position", F.regexp_replace(whole, r"^\s+|\s+$", "").alias("element")).where("element != ''")


def write_ordered(lines: DataFrame, path: str, key: str, text: str, open_: str = "", close: str = "", separator: str = "",
                  mode: str = "errorifexists") -> None:
    """``text`` in the order of ``key`` as numbered parts that make one document when put together.

    Parts are ranges of the key, so that no task gathers the whole.  The very
    first row (number 0 of part 0) brings ``open_``, others ``separator``; a row
    after all others brings ``close``.
    """
    rows = lines.select(F.lit(0).alias("_part"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    if close:
        edge = rows.sparkSession.range(1).select(F.lit(1).alias("_part"), F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"),
                                                 F.lit(close).alias("_text"))
        rows = rows.unionByName(edge)
    rows = rows.orderBy("_part", "_key").withColumn("_number", F.monotonically_increasing_id())
    before = F.when(F.col("_number") == 0, F.lit(open_)).when(F.col("_part") == 1, F.lit("")).otherwise(F.lit(separator))
    rows.select(F.concat(before, "_text").alias("value")).write.mode(mode).text(path)
