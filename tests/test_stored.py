"""Stores: examples by file and generations by prompt."""

import os

from pyspark.sql import functions as F

from sqltally.operators import generate, profile
from sqltally.session import local_path, scratch_path
from sqltally.sources import stored


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_examples_by_file_follow_the_files(spark):
    path, store = scratch_path(spark, "t"), scratch_path(spark, "store")
    spark.range(100).select("id", F.concat(F.lit("s"), "id").alias("s"), F.when(F.col("id") < 0, 1).alias("none")).repartition(4).write.parquet(path)

    def both():
        df = spark.read.parquet(path)
        kept = profile.stored_examples({"d": {"t": df}}, store, 5)
        assert rows(kept) == rows(profile.column_examples("d", "t", df, 5))
        return len(os.listdir(local_path(store)))

    assert both() == 1 and both() == 1  # the second call reads no file
    spark.range(-3, 0).select("id", F.lit("a").alias("s"), F.lit(1).alias("none")).write.mode("append").parquet(path)
    assert both() == 2
    gone = sorted(n for n in os.listdir(local_path(path)) if n.startswith("part-"))[0]
    os.remove(f"{local_path(path)}/{gone}")
    assert both() == 2  # nothing new to read, what is gone no longer counts


def test_state_of_a_file_is_its_own(spark):
    path = scratch_path(spark, "files")
    spark.range(50).repartition(5).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
    try:  # one task reads several files
        state = profile._example_state(spark.read.parquet(path).coalesce(1), 3, by_file=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in state:
        if r.j >= 0:
            by.setdefault(r.file, []).append(int(r.k_int))
    want = {}
    for r in spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("f")).collect():
        want.setdefault(r.f, []).append(r.id)
    assert {f: sorted(v) for f, v in by.items()} == {f: sorted(v)[:3] for f, v in want.items()}
    assert sum(r.j == -1 for r in state) >= 5


def test_version_changes_with_a_file(spark):
    path = scratch_path(spark, "v")
    spark.range(10).write.parquet(path)
    first = stored.files_version([spark.read.parquet(path)])
    assert first == stored.files_version([spark.read.parquet(path)])
    spark.range(10, 11).write.mode("append").parquet(path)
    assert first != stored.files_version([spark.read.parquet(path)])


def test_generations_are_asked_once(spark):
    store, log = scratch_path(spark, "generations"), local_path(scratch_path(spark, "asked"))
    os.makedirs(log)

    def model(texts, n):
        for t in texts:
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(t + "\n")
        return [[f"{t}/{j}" for j in range(n)] if t != "mute" else [] for t in texts]

    def asked():
        return sorted(x for n in os.listdir(log) for x in open(f"{log}/{n}").read().split())

    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "mute"), (5, None)], "question_id long, prompt string")
    want = [(1, 0, "a/0"), (1, 1, "a/1"), (2, 0, "b/0"), (2, 1, "b/1"), (3, 0, "a/0"), (3, 1, "a/1"), (4, 0, None), (5, 0, "/0"), (5, 1, "/1")]
    assert rows(generate.stored_generations(prompts, model, 2, store, "m").where("response is not null")) == [w for w in want if w[2]]
    assert asked() == ["a", "b", "mute"]
    assert generate.stored_generations(prompts, model, 2, store, "m").count() == len(want) and asked() == ["a", "b", "mute"]
    more = spark.createDataFrame([(1, "a"), (2, "b!")], "question_id long, prompt string")
    assert generate.stored_generations(more, model, 2, store, "m").count() == 4 and asked() == ["a", "b", "b!", "mute"]
    assert generate.stored_generations(more, model, 2, store, "other").count() == 4
    assert asked() == ["a", "a", "b", "b!", "b!", "mute"]


def test_unfinished_additions_do_not_count(spark):
    store = scratch_path(spark, "half")
    df = spark.range(3)
    stored.add_to_store(df, store)
    os.makedirs(f"{local_path(store)}/broken")
    assert stored.read_store(spark, store, df.schema).count() == 3
    assert stored.read_store(spark, scratch_path(spark, "no"), df.schema).count() == 0
