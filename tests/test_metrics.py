import pytest

from sqltally.operators import metrics

# Correct counts implied by the published accuracy table (simple/moderate/challenging
# out of 925/464/145) and the published percentages.
PUBLISHED = [
    (521, 178, 47, 56.32, 38.36, 32.41, 48.63),
    (586, 207, 51, 63.35, 44.61, 35.17, 55.02),
    (598, 227, 60, 64.65, 48.92, 41.38, 57.69),
    (563, 191, 56, 60.86, 41.16, 38.62, 52.80),
    (446, 153, 41, 48.22, 32.97, 28.28, 41.72),
    (666, 278, 78, 72.00, 59.91, 53.79, 66.62),
    (678, 290, 75, 73.30, 62.50, 51.72, 67.99),
    (692, 297, 78, 74.81, 64.01, 53.79, 69.56),
    (700, 303, 82, 75.68, 65.30, 56.55, 70.73),
]
SIZES = (925, 464, 145)


def scores_frame(spark, counts):
    rows, qid = [], 0
    for lv, size, right in zip(["simple", "moderate", "challenging"], SIZES, counts):
        for i in range(size):
            rows.append((qid, int(i < right), lv))
            qid += 1
    return spark.createDataFrame(rows, "question_id long, correct int, difficulty string")


@pytest.mark.parametrize("row", PUBLISHED)
def test_published_accuracy(spark, row):
    s = scores_frame(spark, row[:3])
    acc = {r.level: r for r in metrics.accuracy_by_difficulty(s).collect()}
    for lv, exp in zip(["simple", "moderate", "challenging", "total"], row[3:]):
        assert round(acc[lv].accuracy, 2) == pytest.approx(exp, abs=1e-9)
    assert acc["total"].n == 1534


def test_empty_class_and_null(spark):
    s = spark.createDataFrame([(0, 1, "simple"), (1, 0, None), (2, 1, "other")],
                              "question_id long, correct int, difficulty string")
    acc = {r.level: r for r in metrics.accuracy_by_difficulty(s).collect()}
    assert acc["moderate"].n == 0 and acc["moderate"].accuracy is None
    assert acc["total"].n == 3 and acc["total"].correct == 2
    frac = {r.level: r for r in metrics.fraction_by_difficulty(s).collect()}
    assert frac["simple"].n == 2  # missing label counts as simple
    assert frac["other"].n == 1
    assert frac["total"].n == 3


def test_correct_ids_one_based(spark):
    s = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "question_id long, correct int")
    assert sorted(r.tp_id for r in metrics.correct_ids(s).collect()) == [1, 3]


def test_unmatched_ids(spark):
    s = spark.createDataFrame([(0, 1), (5, 0)], "question_id long, correct int")
    q = spark.createDataFrame([(0, "simple"), (1, "moderate")], "question_id long, difficulty string")
    got = {(r.question_id, r.side) for r in metrics.unmatched_ids(s, q).collect()}
    assert got == {(5, "scores_only"), (1, "questions_only")}


def test_grid_and_document(spark):
    s = scores_frame(spark, (666, 278, 78))
    acc = metrics.accuracy_by_difficulty(s)
    grid = {r.measure: r for r in metrics.score_grid(acc).collect()}
    assert grid["count"].total == 1534.0
    assert round(grid["accuracy"].total, 2) == 66.62
    doc = metrics.metric_document(acc).collect()[0].json
    assert '"counts":{"simple":925' in doc


def test_grid_text(spark):
    s = scores_frame(spark, (666, 278, 78))
    text = metrics.grid_text(metrics.accuracy_by_difficulty(s)).collect()[0].text
    lines = text.split("\n")
    assert lines[0].split() == ["simple", "moderate", "challenging", "total"]
    assert lines[1].split() == ["count", "925", "464", "145", "1534"]
    assert lines[2].split() == ["accuracy", "72.00", "59.91", "53.79", "66.62"]
