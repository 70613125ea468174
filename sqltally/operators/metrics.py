"""Evaluation metrics (M1-M6, K9).

Input is a *scores* frame, one row per question::

    question_id BIGINT, correct INT (0/1), difficulty STRING (may be NULL)

or scores plus a separate ``questions`` frame joined on ``question_id`` (M6;
position in the original files is replaced by an explicit id).

All metrics are single partial aggregations; only a handful of rows leave
the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three difficulty classes of the evaluation set, in order.
LEVELS = ["simple", "moderate", "challenging"]
TOTAL = "total"


def attach_difficulty(scores: DataFrame, questions: DataFrame | None) -> DataFrame:
    """M6: every question row with its score; a question without a score gets 0
    in each numeric column, so that it stays in the denominator.  Scores whose
    question is unknown are reported by :func:`unmatched_ids`."""
    if questions is None:
        return scores
    paired = questions.select("question_id", "difficulty").join(scores.drop("difficulty"), "question_id", "left")
    numeric = [c for c, t in scores.dtypes if c != "question_id" and t in ("int", "bigint", "smallint", "tinyint", "double")]
    return paired.fillna(0, subset=numeric) if numeric else paired


def _ratio(num: str, den: str, scale: float) -> F.Column:
    return F.when(F.col(den) > 0,
                  F.col(num).cast("double") * F.lit(scale) / F.col(den).cast("double"))


def accuracy_by_difficulty(scores: DataFrame, questions: DataFrame | None = None,
                           score_col: str = "correct") -> DataFrame:
    """M1: accuracy in percent and counts for the three classes and the total.

    A row outside the three classes (including NULL) counts in the total
    only.  An empty class yields ``accuracy`` NULL instead of a division error.
    Output ``level, n, correct, accuracy`` (4 rows, fixed order by ``level_ord``).
    """
    s = attach_difficulty(scores, questions)
    d, r = F.col("difficulty"), F.col(score_col).cast("bigint")
    aggs = []
    for lv in LEVELS:
        aggs += [F.count_if(d == lv).alias(f"n_{lv}"),
                 F.coalesce(F.sum(F.when(d == lv, r)), F.lit(0)).alias(f"c_{lv}")]
    aggs += [F.count(F.lit(1)).alias(f"n_{TOTAL}"),
             F.coalesce(F.sum(r), F.lit(0)).alias(f"c_{TOTAL}")]
    wide = s.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("level_ord"), F.lit(lv).alias("level"),
                     F.col(f"n_{lv}").cast("bigint").alias("n"),
                     F.col(f"c_{lv}").cast("bigint").alias("correct"))
            for i, lv in enumerate(LEVELS + [TOTAL])]
    long = wide.select(F.inline(F.array(*rows)))
    return long.withColumn("accuracy", _ratio("correct", "n", 100.0))


def fraction_by_difficulty(scores: DataFrame, questions: DataFrame | None = None,
                           score_col: str = "correct") -> DataFrame:
    """M2: fraction right per difficulty label, a missing label counting as
    ``simple``; any label allowed; plus the ``total`` row (a rollup level)."""
    s = attach_difficulty(scores, questions)
    lvl = F.coalesce(F.col("difficulty"), F.lit("simple")).alias("level")
    agg = (s.select(lvl, F.col(score_col).cast("bigint").alias("r"))
           .rollup("level")
           .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("r"), F.lit(0)).alias("correct"),
                F.grouping("level").alias("g")))
    return agg.select(
        F.when(F.col("g") == 1, F.lit(TOTAL)).otherwise(F.col("level")).alias("level"),
        F.col("n").cast("bigint").alias("n"),
        F.col("correct").cast("bigint").alias("correct"),
    ).withColumn("fraction", _ratio("correct", "n", 1.0))


def correct_ids(scores: DataFrame, score_col: str = "correct") -> DataFrame:
    """M3: 1-based ids of the questions answered right (long form)."""
    return scores.filter(F.col(score_col) == 1).select(
        (F.col("question_id") + 1).cast("bigint").alias("tp_id"))


def unmatched_ids(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """M4: ids present on one side only (the breakdown needs none)."""
    a = scores.select("question_id").join(questions.select("question_id"), "question_id", "left_anti")
    b = questions.select("question_id").join(scores.select("question_id"), "question_id", "left_anti")
    return a.withColumn("side", F.lit("scores_only")).unionByName(
        b.withColumn("side", F.lit("questions_only")))


def curves(score_frames: dict[str, DataFrame], questions: DataFrame | None = None,
           score_col: str = "correct") -> DataFrame:
    """M5: several score curves (e.g. vote, pass@n, top-2) in one aggregation.

    Output ``metric, level, n, correct, fraction`` with a ``total`` row per metric
    (missing difficulty counts as ``simple``, as in M2).
    """
    tagged = None
    for name, frame in score_frames.items():
        f = attach_difficulty(frame, questions).select(
            F.lit(name).alias("metric"),
            F.coalesce(F.col("difficulty"), F.lit("simple")).alias("level"),
            F.col(score_col).cast("bigint").alias("r"))
        tagged = f if tagged is None else tagged.unionByName(f)
    agg = (tagged.rollup("metric", "level")
           .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("r"), F.lit(0)).alias("correct"),
                F.grouping("metric").alias("gm"), F.grouping("level").alias("gl"))
           .filter(F.col("gm") == 0))
    return agg.select(
        "metric",
        F.when(F.col("gl") == 1, F.lit(TOTAL)).otherwise(F.col("level")).alias("level"),
        F.col("n").cast("bigint").alias("n"),
        F.col("correct").cast("bigint").alias("correct"),
    ).withColumn("fraction", _ratio("correct", "n", 1.0))


def curves_from_columns(per_question: DataFrame, score_cols: dict[str, str]) -> DataFrame:
    """M5 from one frame holding several 0/1 score columns per question
    (``{"vote": "vote_correct", ...}``): one pass, one rollup, no union of
    recomputed inputs.  Same output as :func:`curves`."""
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(col).cast("bigint").alias("r"))
                     for name, col in score_cols.items()])
    tagged = per_question.select(F.coalesce(F.col("difficulty"), F.lit("simple")).alias("level"),
                                 F.inline(rows))
    agg = (tagged.rollup("metric", "level")
           .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("r"), F.lit(0)).alias("correct"),
                F.grouping("metric").alias("gm"), F.grouping("level").alias("gl"))
           .filter(F.col("gm") == 0))
    return agg.select(
        "metric",
        F.when(F.col("gl") == 1, F.lit(TOTAL)).otherwise(F.col("level")).alias("level"),
        F.col("n").cast("bigint").alias("n"),
        F.col("correct").cast("bigint").alias("correct"),
    ).withColumn("fraction", _ratio("correct", "n", 1.0))


def score_grid(acc: DataFrame) -> DataFrame:
    """K9: the M1 frame as a grid, one row per measure, one column per level."""
    levels = LEVELS + [TOTAL]
    long = acc.select("level",
                      F.inline(F.array(
                          F.struct(F.lit("count").alias("measure"), F.col("n").cast("double").alias("value")),
                          F.struct(F.lit("accuracy").alias("measure"), F.col("accuracy").alias("value")))))
    return long.groupBy("measure").pivot("level", levels).agg(F.first("value"))


def metric_document(acc: DataFrame) -> DataFrame:
    """K7: one-row JSON text ``{"counts": {...}, "accuracy": {...}}``."""
    levels = LEVELS + [TOTAL]
    w = acc.agg(*[F.max(F.when(F.col("level") == lv, F.col("n"))).alias(f"n_{lv}") for lv in levels],
                *[F.max(F.when(F.col("level") == lv, F.col("accuracy"))).alias(f"a_{lv}") for lv in levels])
    doc = F.struct(
        F.struct(*[F.col(f"n_{lv}").alias(lv) for lv in levels]).alias("counts"),
        F.struct(*[F.col(f"a_{lv}").alias(lv) for lv in levels]).alias("accuracy"))
    return w.select(F.to_json(doc).alias("json"))


def grid_text(acc: DataFrame, width: int = 20) -> DataFrame:
    """K9 as text: a header of levels, a ``count`` row and an ``accuracy``
    row (two decimals), every cell left-aligned in ``width`` characters."""
    levels = LEVELS + [TOTAL]
    w = acc.agg(*[F.max(F.when(F.col("level") == lv, F.col("n"))).alias(f"n_{lv}") for lv in levels],
                *[F.max(F.when(F.col("level") == lv, F.col("accuracy"))).alias(f"a_{lv}") for lv in levels])

    def cell(c):
        return F.rpad(c, width, " ")

    header = F.concat(cell(F.lit("")), *[cell(F.lit(lv)) for lv in levels])
    counts = F.concat(cell(F.lit("count")), *[cell(F.coalesce(F.col(f"n_{lv}").cast("string"), F.lit("")))
                                             for lv in levels])
    accs = F.concat(cell(F.lit("accuracy")),
                    *[cell(F.coalesce(F.format_string("%.2f", F.col(f"a_{lv}")), F.lit(""))) for lv in levels])
    return w.select(F.concat_ws("\n", header, counts, accs).alias("text"))
