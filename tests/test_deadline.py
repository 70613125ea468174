"""A statement past its deadline gives its tasks' cores back soon."""

import time

from sqltally.operators import execute


def test_cores_are_free_soon_after_the_deadline(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "slow.parquet")
    spark.range(0, 3000 * cores, 1, cores).write.parquet(path)  # a file a core
    db = execute.register_database(spark, "d", {"slow": path})
    slow = "SELECT sum(size(filter(sequence(1, 200000), x -> x % (id + 7) = 3))) FROM slow"
    assert execute.run_one(db, slow, 5.0)["status"] == "timeout"
    t0 = time.time()
    assert spark.range(0, cores, 1, cores).count() == cores
    assert time.time() - t0 < 15
