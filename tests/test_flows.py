import json

from pyspark.sql import functions as F

from sqltally.plans import flows
from sqltally.plans import tables as TB
from sqltally.plans import workload as W
from sqltally.session import scratch_path
from sqltally.sources import sinks

SF = "/root/testdata/sf0.001"


def test_flow_a_matches_workload_scores(spark):
    wl = W.oracle_rows()
    # predictions: first candidate per question, packed; gold file; questions array
    preds = spark.createDataFrame([(q["question_id"], q["candidates"][0]["sql"], q["db_id"]) for q in wl],
                                  "question_id long, sql string, db_id string")
    ppath = scratch_path(spark, "flow-preds")
    sinks.write_predictions(preds, ppath, single_document=True)
    gpath = scratch_path(spark, "flow-gold")
    gold_lines = spark.createDataFrame([(q["question_id"], q["gold_sql"].replace("\n", " ") + "\t" + q["db_id"])
                                        for q in wl], "question_id long, value string")
    gold_lines.orderBy("question_id").select("value").coalesce(1).write.text(gpath)
    qpath = scratch_path(spark, "flow-questions")
    doc = [{"question": q["question"], "evidence": q["evidence"], "db_id": q["db_id"], "SQL": q["gold_sql"],
            "difficulty": q["difficulty"]} for q in wl]
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(qpath)

    db = W.star_database(spark, SF)
    res = flows.evaluate_files(spark, ppath, gpath, qpath, {"star": db})
    got = {r.question_id: r.correct for r in res["scores"].collect()}
    expect = {r.question_id: r.res for r in W.ex_scores(W.executions(spark, SF, reuse=False))
              .filter(F.col("ord") == 0).collect()}
    assert got == expect
    total = [r for r in res["accuracy"].collect() if r.level == "total"][0]
    assert total.n == len(wl) and total.correct == sum(expect.values())
    assert res["unmatched"].count() == 0


def test_flow_c_generates_packed_sql(spark):
    q = TB.bench_questions(spark, SF)
    schemas = spark.createDataFrame([("star", "S1"), ("text", "S2")], "db_id string, text string")
    out = flows.generate_sql(spark, q, schemas, TB.echo_model, "{db_schema}: {question}").collect()
    assert len(out) == q.count()
    assert all(r.sql.startswith("SELECT 0 AS candidate") and r.packed.endswith(r.db_id) for r in out)


def test_flow_b_vote_equals_workload_vote(spark):
    wl = W.oracle_rows()
    by_prompt = {q["question"]: [c["sql"] for c in q["candidates"]] for q in wl}

    def model(texts, n):  # returns each question's workload candidates, fenced
        return [["```sql\n" + s + "\n```" for s in by_prompt[t][:n]] for t in texts]

    prompt_table = spark.createDataFrame([(q["question_id"], q["db_id"], q["question"]) for q in wl],
                                         "question_id long, db_id string, prompt string")
    questions = spark.createDataFrame([(q["question_id"], q["gold_sql"], q["difficulty"]) for q in wl],
                                      "question_id long, gold_sql string, difficulty string")
    db = W.star_database(spark, SF)
    res = flows.generate_and_vote(spark, prompt_table, questions, model, 8, {"star": db})
    got = {r.question_id: (r.votes, r.correct, r.winner_ord) for r in res["winner"].collect()}
    ref = W.voted(W.executions(spark, SF, reuse=False))["winner"]
    expect = {r.question_id: (r.votes, r.correct, r.winner_ord) for r in ref.collect()}
    assert got == expect
    assert res["curves"].filter(F.col("level") == "total").count() == 3
