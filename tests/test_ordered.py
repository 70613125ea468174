"""Position-keyed files: read in many splits, written in many parts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sqltally.session import local_path, scratch_path
from sqltally.sources import files, ordered, sinks


@pytest.fixture(params=[64, 200, 1 << 20])
def split(spark, request):
    """Splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(spark, *texts):
    path = local_path(scratch_path(spark, "text"))
    os.makedirs(path)
    for i, t in enumerate(texts):
        with open(f"{path}/part-{i:05d}", "w", encoding="utf-8", newline="") as f:
            f.write(t)
    return path


def joined_parts(path):
    path = local_path(path)
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(f"{path}/{n}", encoding="utf-8").read() for n in names), len(names)


NASTY = ["plain", "", 'a "quoted" , comma', "brackets ]}[{ ,", "back\\slash", 'ends with \\', '\\"', "é 日本 \U0001F600", "tab\tline\nend", ",,,", '","', "x" * 300]


def rows(n, seed=1):
    r = random.Random(seed)
    return [{"question": r.choice(NASTY) + str(i), "evidence": r.choice([None, *NASTY]), "db_id": r.choice(["a", "b"]),
             "SQL": r.choice(NASTY), "difficulty": r.choice(["simple", None])} for i in range(n)]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}])
def test_json_array_in_splits(spark, split, style):
    want = rows(60)
    got = files.read_questions(spark, put(spark, json.dumps(want, **style))).orderBy("question_id").collect()
    assert [r.question_id for r in got] == list(range(60))
    assert [(r.question, r.evidence, r.db_id, r.gold_sql, r.difficulty) for r in got] == [tuple(x.values()) for x in want]


def test_elements_of_any_kind(spark, split):
    values = [1, "a,b", None, [1, [2, "]"], {"k": "},{"}], {"x": [], "y": {"z": ", "}}, "", True, -2.5e3, {}]
    got = ordered.json_elements(spark, put(spark, json.dumps(values))).orderBy("position").collect()
    assert [json.loads(r.element) for r in got] == values and [r.position for r in got] == list(range(len(values)))


@pytest.mark.parametrize("text", ["", "[]", "{}", " [ \n ] ", "\n"])
def test_nothing_in_it(spark, split, text):
    assert ordered.json_elements(spark, put(spark, text)).count() == 0


def test_object_in_splits_and_repeated_keys(spark, split):
    doc = {str(i): (0 if i % 5 == 0 else f"SELECT '{NASTY[i % len(NASTY)]}'\t----- bird -----\tdb{i % 3}") for i in range(80)}
    text = json.dumps(doc)[:-1] + ', "3": "SELECT 9\\t----- bird -----\\tlast"}'
    got = {r.question_id: r for r in files.read_predictions(spark, put(spark, text)).collect()}
    assert len(got) == 80 and got[3].db_id == "last" and got[3].sql == "SELECT 9"
    assert all((got[i].status == "no_sql") == (i % 5 == 0) for i in range(80))
    assert got[7].sql == f"SELECT '{NASTY[7]}'" or got[7].status == "ok"


def test_array_over_parts(spark, split):
    want = rows(30, 2)
    text = json.dumps(want)
    cuts = sorted(random.Random(3).sample(range(1, len(text)), 4))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    # a part may end inside a string, but not inside an escape
    if any(p.endswith("\\") or "\\u" in p[-6:] for p in parts[:-1]):
        parts = [text]
    got = files.read_questions(spark, put(spark, *parts)).orderBy("question_id").collect()
    assert [r.question for r in got] == [x["question"] for x in want]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_numbers(spark, split, end):
    lines = [f"SELECT {i}, '{'x' * (i % 50)}'\tdb{i % 3}" if i % 7 else ("" if i % 2 else "bad line") for i in range(200)]
    path = put(spark, end.join(lines[:90]) + end, end.join(lines[90:150]), "", end.join(lines[150:]) + end)
    got = ordered.numbered_lines(spark, path).orderBy("position").collect()
    assert [(r.position, r.value) for r in got] == list(enumerate(lines))
    gold = {r.question_id: r for r in files.read_gold(spark, path).collect()}
    assert [gold[i].ok for i in range(200)] == [bool(i % 7) for i in range(200)]
    assert gold[8].db_id == "db2" and spark.read.text(path).rdd.getNumPartitions() > (1 if split < 1000 else 0)


def test_document_in_parts(spark):
    df = spark.range(5000).select(F.col("id").alias("question_id"), F.when(F.col("id") % 9 > 0, F.concat(
        F.lit("SELECT \"a\", "), F.col("id").cast("string"))).alias("sql"), F.lit("db").alias("db_id")).repartition(7)
    path = scratch_path(spark, "document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_predictions(df, path, single_document=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text, parts = joined_parts(path)
    assert parts > 3
    doc = json.loads(text)
    assert list(doc) == [str(i) for i in range(5000)] and doc["9"] == 0 and doc["10"].startswith('SELECT "a", 10\t')
    back = files.read_predictions(spark, path)
    assert back.where("status = 'ok'").count() == sum(i % 9 > 0 for i in range(5000)) and back.count() == 5000


def test_empty_document(spark):
    path = scratch_path(spark, "empty-document")
    sinks.write_predictions(spark.createDataFrame([], "question_id long, sql string, db_id string"), path, single_document=True)
    assert json.loads(joined_parts(path)[0]) == {} and files.read_predictions(spark, path).count() == 0


def test_no_task_holds_the_file(spark):
    path = put(spark, json.dumps(rows(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 8
        assert files.read_questions(spark, path).count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
