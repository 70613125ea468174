"""Templates by model family of the registered query."""

from sqltally.operators import prompts
from sqltally.plans.catalog_text import FAMILIES


def test_every_family_is_told_everything(spark):
    q = spark.createDataFrame([(i, "d", "the question", "the hint", f) for i, f in enumerate([*FAMILIES, "unknown"])],
                              "question_id long, db_id string, question string, evidence string, family string")
    s = spark.createDataFrame([("d", "the schema")], "db_id string, text string")
    got = {r.family: r.prompt for r in prompts.build_prompts_by_family(q, s, "family", FAMILIES).collect()}
    assert len(got) == 3 and got.pop("unknown") is None
    for prompt in got.values():
        assert all(x in prompt for x in ("Spark SQL", "the schema", "the hint", "the question"))
    assert got["sql_expert"].count("the question") == 2
