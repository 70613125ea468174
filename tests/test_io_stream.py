import json
import os

from pyspark.sql import functions as F

from sqltally.operators import generate, vote
from sqltally.plans import tables as TB
from sqltally.session import local_path, scratch_path
from sqltally.sources import files, sinks
from sqltally.streaming import incremental as INC

SF = "/root/testdata/sf0.001"


def write_local(spark, name, text):
    path = local_path(scratch_path(spark, name))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_read_questions_positions(spark):
    doc = [{"question": "q0", "evidence": "", "db_id": "a", "SQL": "SELECT 1", "difficulty": "simple"},
           {"question": "q1", "evidence": None, "db_id": "b", "SQL": "SELECT 2"}]
    q = files.read_questions(spark, write_local(spark, "q.json", json.dumps(doc)))
    rows = {r.question_id: r for r in q.collect()}
    assert rows[0].gold_sql == "SELECT 1" and rows[1].difficulty is None and rows[1].db_id == "b"


def test_read_predictions_failures(spark):
    doc = {"0": "SELECT 1\t----- bird -----\tdb", "1": 0, "2": "no separator"}
    p = files.read_predictions(spark, write_local(spark, "p.json", json.dumps(doc)))
    rows = {r.question_id: r for r in p.collect()}
    assert (rows[0].sql, rows[0].db_id, rows[0].status) == ("SELECT 1", "db", "ok")
    assert rows[1].status == "no_sql" and rows[2].status == "malformed"


def test_read_gold_lines(spark):
    g = files.read_gold(spark, write_local(spark, "gold.sql", "SELECT 1\tdb1\n  SELECT 2\tdb2  \nbad\n"))
    rows = {r.question_id: r for r in g.collect()}
    assert len(rows) == 3
    assert (rows[1].sql, rows[1].db_id) == ("SELECT 2", "db2")
    assert rows[2].ok is False


def test_write_read_predictions(spark):
    df = spark.createDataFrame([(0, "SELECT 'a\"b'", "db"), (1, None, "db")],
                               "question_id long, sql string, db_id string")
    path = scratch_path(spark, "preds")
    sinks.write_predictions(df, path, single_document=True)
    back = {r.question_id: r for r in files.read_predictions(spark, path).collect()}
    assert back[0].sql == "SELECT 'a\"b'" and back[1].status == "no_sql"


def test_progress_log_append_and_read(spark):
    path = scratch_path(spark, "log")
    a = spark.createDataFrame([(0, "x"), (1, "y")], "question_id long, value string")
    sinks.append_progress(a, path)
    sinks.append_progress(spark.createDataFrame([(2, "z")], "question_id long, value string"), path)
    log = files.read_progress_log(spark, path)
    got = {r.idx: r.v for r in log.select("idx", F.variant_get("value", "$", "string").alias("v")).collect()}
    assert got == {0: "x", 1: "y", 2: "z"}


def test_cached_table(spark):
    path = scratch_path(spark, "cache")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert files.cached_table(spark, path, compute).count() == 3
    assert files.cached_table(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_stream_votes_equal_batch(spark):
    execs = TB.event_executions(spark, SF).drop("difficulty")
    src = scratch_path(spark, "ev")
    execs.repartition(5).write.parquet(src)
    sink, ckpt = scratch_path(spark, "v-out"), scratch_path(spark, "v-ckpt")
    INC.vote_stream(INC.file_stream(spark, src, execs.schema, max_files_per_trigger=1), sink, ckpt)
    assert spark.read.parquet(sink).select("batch_id").distinct().count() > 1
    streamed = INC.latest(spark, sink, ["question_id", "fp"])
    batch = vote.vote_groups(execs)
    cols = ["question_id", "fp", "votes", "first_ord", "sql", "correct"]
    a = streamed.select(*cols).exceptAll(batch.select(*cols))
    b = batch.select(*cols).exceptAll(streamed.select(*cols))
    assert a.count() == 0 and b.count() == 0


def test_stream_clean_exactly_once(spark):
    resp = TB.model_responses(spark, SF)
    src = scratch_path(spark, "resp")
    resp.repartition(3).write.parquet(src)
    sink, ckpt = scratch_path(spark, "c-out"), scratch_path(spark, "c-ckpt")
    stream = INC.file_stream(spark, src, resp.schema, max_files_per_trigger=1)
    INC.clean_stream(stream, sink, ckpt)
    INC.clean_stream(INC.file_stream(spark, src, resp.schema, max_files_per_trigger=1), sink, ckpt)  # restart
    assert spark.read.parquet(sink).count() == resp.count()


def test_generate_candidates_with_retry(spark):
    prompts = spark.createDataFrame([(0, "p0"), (1, "p11")], "question_id long, prompt string")
    calls = []

    def flaky(texts, n):
        calls.append(len(texts))
        return [["no block"] * n if len(calls) == 1 else TB.echo_model([t], n)[0] for t in texts]

    out = generate.generate_candidates(prompts, flaky, 2, max_attempts=3).collect()
    assert len(out) == 4 and all("```sql" in r.response for r in out)


def test_first_valid_attempt_and_resume(spark):
    att = spark.createDataFrame([(0, 0, "nothing"), (0, 1, "```sql\nSELECT 1\n```"), (1, 0, "x")],
                                "question_id long, attempt int, response string")
    r = {x.question_id: x for x in generate.first_valid_attempt(att).collect()}
    assert r[0].sql == "SELECT 1;" and r[0].attempt == 1 and r[1].sql is None
    todo = spark.range(5).withColumnRenamed("id", "question_id")
    done = spark.createDataFrame([(1,), (3,), (3,)], "question_id long")
    assert sorted(x.question_id for x in generate.resume(todo, done).collect()) == [0, 2, 4]


def test_generate_retries_until_think_answer(spark):
    prompts = spark.createDataFrame([(0, "p")], "question_id long, prompt string")
    calls = []

    def model(texts, n):
        calls.append(1)
        ok = len(calls) > 1
        return [["<think> t </think> <answer> SELECT 1 </answer>" if ok else "<answer>x</answer>"] * n
                for _ in texts]

    out = generate.generate_candidates(prompts, model, 1, max_attempts=3,
                                       is_valid=generate.has_think_answer).collect()
    assert out[0].response.startswith("<think>")


def test_write_if_absent_keeps_existing(spark):
    path = scratch_path(spark, "keep")
    sinks.write_json_if_absent(spark.createDataFrame([(1,)], "a int"), path)
    sinks.write_json_if_absent(spark.createDataFrame([(2,), (3,)], "a int"), path)
    assert [r.a for r in spark.read.json(path).collect()] == [1]
    tpath = scratch_path(spark, "keep-text")
    sinks.write_text_if_absent(spark.createDataFrame([("x",)], "value string"), tpath)
    sinks.write_text_if_absent(spark.createDataFrame([("y",)], "value string"), tpath)
    assert [r.value for r in spark.read.text(tpath).collect()] == ["x"]
