"""What executors get: the package's modules without the files around it."""

import subprocess
import sys
import zipfile

from pyspark import cloudpickle

from sqltally import session
from sqltally.operators import generate
from sqltally.plans import catalog_text  # noqa: F401  (reads the workload's file)
from sqltally.plans import tables as TB


def _pickled_ask(fn, **options) -> bytes:
    """The function that ``generate_candidates`` sends to executors."""
    class Prompts:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return cloudpickle.dumps(run)
    return generate.generate_candidates(Prompts(), fn, 1, **options)


def test_stand_in_models_run_from_the_shipped_package(tmp_path):
    path = tmp_path / "sqltally.zip"
    session.write_package(str(path))
    assert all(n.endswith(".py") for n in zipfile.ZipFile(path).namelist())
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import pickle, pandas as pd; run = pickle.loads(sys.stdin.buffer.read());"
            "print([list(r) for d in run([pd.DataFrame({'question_id': [1, 2], 'prompt': ['abc', 'ab']})]) for r in d.itertuples(index=False)])")
    for name in ("thinking_model", "echo_model"):
        fn = getattr(TB, name)
        # the function that the registered query of retries sends
        options = {"max_attempts": 3, "is_valid": generate.has_think_answer}
        r = subprocess.run([sys.executable, "-c", code, str(path)], input=_pickled_ask(fn, **options), capture_output=True, cwd=tmp_path, timeout=120)
        assert r.returncode == 0, r.stderr.decode()
        assert "[1, 0, " in r.stdout.decode() and "[2, 0, " in r.stdout.decode()


def test_queries_send_no_function_of_a_catalog(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, "ab")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sent = []
    ask = generate.generate_candidates
    monkeypatch.setattr(generate, "generate_candidates", lambda p, fn, *a, **k: sent.append(fn) or ask(p, fn, *a, **k))
    rows = catalog_text.q_retry_until_answer(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(1, "3", "SELECT 0"), (2, None, None)]
    assert [f.__module__ for f in sent] == ["sqltally.plans.tables"]
