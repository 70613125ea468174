"""The pass that keeps each column's smallest values, batch by batch."""

import datetime as dt
import decimal
import math
import random
import subprocess
import sys

import pyarrow as pa
import pytest

from sqltally.operators import profile


def _values(kind, rnd):
    n = rnd.choice([None, rnd.randint(-9, 9)])
    if n is None:
        return None
    return {"int": n, "text": "" if n == 0 else "x" * rnd.randint(0, 60) + str(n), "bool": n > 0, "binary": bytes([n + 9]),
            "double": math.nan if n == 5 else n / 4, "decimal": decimal.Decimal(n) / 8, "day": dt.date(2020, 1, 10 + n),
            "at": dt.datetime(2020, 1, 10 + n)}[kind]


KINDS = {"int": pa.int64(), "text": pa.string(), "bool": pa.bool_(), "binary": pa.binary(), "double": pa.float64(),
         "decimal": pa.decimal128(10, 4), "day": pa.date32(), "at": pa.timestamp("us")}


@pytest.mark.parametrize("step", [1, 200, 1 << 20])
def test_smallest_of_all_kinds_in_steps(monkeypatch, step):
    monkeypatch.setattr(profile, "STEP_BYTES", step)
    rnd = random.Random(step)
    for k in (1, 3, 40):
        batches = [pa.RecordBatch.from_arrays([pa.array([_values(kind, rnd) for _ in range(rnd.randint(0, 30))] + [None] * 30, t)[:30]
                                               for kind, t in KINDS.items()], names=list(KINDS)) for _ in range(6)]
        got = {name: [] for name in KINDS}
        for b in profile._local_smallest(k, {"text"})(iter(batches)):
            i = b.column(b.num_columns - 1)[0].as_py()
            got[b.schema.names[i]] += b.column(i).to_pylist()
        for i, name in enumerate(KINDS):
            seen = [v for b in batches for v in b.column(i).to_pylist() if v is not None and v != ""]
            nan = any(v != v for v in seen)
            want = (sorted({v for v in seen if v == v}) + [math.nan] * nan)[:k]
            assert repr(got[name]) == repr(want), (name, k)


_MEMORY = """
import sys; sys.path.insert(0, sys.argv[1])
import numpy as np, pyarrow as pa
from sqltally.operators import profile
def batches():
    for b in range(3):
        n, size = 4000, 8000  # 32 MB of text, held outside the pool
        data = np.random.default_rng(b).integers(97, 122, n * size, dtype=np.uint8)
        text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([text], names=["text"])
assert [b.num_rows for b in profile._local_smallest(5, {"text"})(batches())] == [5]
print(pa.default_memory_pool().max_memory())
"""


def test_memory_does_not_follow_the_batch():
    root = profile.__file__.rsplit("/sqltally/", 1)[0]
    r = subprocess.run([sys.executable, "-c", _MEMORY, root], capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr
    assert int(r.stdout) < 24 << 20  # copies only; a batch's text is 32 MB
