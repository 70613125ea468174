"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document's tokens are the plain call's of its tokenizer (a special token's string
is that token) and end with a closing id.  Only a document longer than a
sequence is cut, into pieces of a full sequence; its first piece may be shorter.

Only lengths matter for packing, and there are at most ``capacity`` of them, so
the plan is made from the counts of pieces by length (a table of fixed size):
fill a bin greedily with the longest pieces that fit, then replace the bin's
smallest piece by the two unpacked pieces that fit its expanded gap more
tightly, and use the pattern as often as the counts allow.  Each pattern uses up
a length, so there are about as many patterns as lengths, however many pieces.

Pieces take the plan's places by their ordinal among the pieces of their length.
Ordinals come from counts by (length, salt) and a row number within each, with
as many salts as keep a group small, so that a length that a third of all pieces
share is dealt out like any other.

Defined results: a null or empty text has the closing id alone; rows with equal
ids are packed each; an empty table gives an empty result; ``pieces`` keeps the
id column only, ``pack`` keeps all columns but for those named like the added
ones, which are replaced.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from sqltally.llm.alignment import by_ranks
from sqltally.llm.common import col, text_of, written
from sqltally.llm.tokens import steps

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 50_000  # pieces that a (length, salt) group has on average, at most


@functools.lru_cache(maxsize=2)
def _encoders(blob: str) -> tuple[Tokenizer, tiktoken.Encoding | None, tuple[str, ...]]:
    """The tokenizer; the same by ranks, where its merges are a plain byte-level BPE's; its special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Tokenizer.from_str(blob), *by_ranks(blob)


def encode_texts(texts: list[str], blob: str) -> list[bytes]:
    """Ids of each text as 32-bit integers in the machine's byte order, as the tokenizer's plain call gives them.

    A text that holds a special token's string goes to the tokenizer itself; nothing
    is kept between texts.
    """
    t, ranks, special = _encoders(blob)

    def plain(x: str) -> bytes:
        return array("I", t.encode(x, add_special_tokens=False).ids).tobytes()

    return [plain(x) if ranks is None or any(s in x for s in special) else ranks.encode_to_numpy(x, disallowed_special=()).tobytes()
            for x in texts]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): ``ids`` are little-endian unsigned 32-bit integers."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(col(id_col), text_of(text_col).alias("_text"))
    added = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
             StructField("ids", BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(iter([batch]), 1):
                row, number, start, length, ids = [], [], [], [], []
                for i, x in enumerate(encode_texts(b.column(1).to_pylist(), shared.value)):
                    x = np.append(np.frombuffer(x, np.uint32), np.uint32(end_id)).astype("<u4").tobytes()
                    n, at = len(x) // 4, 0
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        row.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(size)
                        ids.append(x[4 * at:4 * (at + size)])
                        at, size = at + size, capacity
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, StructType([rows.schema.fields[0], *added]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(pattern, how many bins) by best-two-fit; a pattern lists lengths, longest first."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    out = []
    while left:
        sizes = sorted(left, reverse=True)
        used: Counter = Counter()
        gap = capacity
        for n in sizes:
            fit = min(gap // n, left[n])
            if fit:
                used[n] += fit
                gap -= fit * n
            if not gap:
                break
        if gap:
            least = min(used)
            pair = _two(left - used, gap + least, least)
            if pair:
                used[least] -= 1
                used.update(pair)
        used += Counter()
        bins = min(left[n] // c for n, c in used.items())
        out.append((sorted(used.elements(), reverse=True), bins))
        left -= Counter({n: c * bins for n, c in used.items()})
    return out


def _two(left: Counter, gap: int, least: int) -> list[int] | None:
    """The two unpacked lengths that fill a gap best, if they fill it better than ``least`` does."""
    sizes = sorted(n for n in left if n < gap)
    best, pair, i, j = least, None, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > gap or i == j and left[sizes[i]] < 2:
            j -= 1
            continue
        if total > best:
            best, pair = total, [sizes[j], sizes[i]]
        i += 1
    return pair


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, its places pattern by pattern: ordinal of the first, first sequence, pieces a bin, and where the offsets are."""
    out: dict[int, list] = {}
    sequence = 0
    for pattern, bins in patterns:
        at: dict[int, list[int]] = {}
        for n, offset in zip(pattern, accumulate(pattern, initial=0)):
            at.setdefault(n, []).append(offset)
        for n, offsets in at.items():
            rows = out.setdefault(n, [[], [], [], [], [], 0, 0])
            for values, v in zip(rows, (rows[5], sequence, len(offsets), rows[6])):
                values.append(v)
            rows[4] += offsets
            rows[5] += bins * len(offsets)
            rows[6] += len(offsets)
        sequence += bins
    return {n: tuple(np.array(v, np.int64) for v in rows[:5]) for n, rows in out.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``rows`` with sequence_id and offset (both long); lengths from 1 to ``capacity``."""
    names = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    rows = written(rows.select(*[col(c) for c in names]), "pieces")
    spark, length = rows.sparkSession, col(length_col)
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # ``capacity`` rows at most
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    salts = 1 + sum(counts.values()) // GROUP_ROWS
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[col(c) for c in names]), F.lit(salts)))
    groups = salted.groupBy(length.alias("_length"), "_salt").count()
    before = groups.select("_length", "_salt", (F.sum("count").over(
        Window.partitionBy("_length").orderBy("_salt")) - F.col("count")).alias("_before"))
    number = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*[col(c) for c in names]))
    numbered = (salted.withColumn("_number", number - 1).alias("r")
                .join(before.alias("g"), (F.col(f"r.`{length_col}`") == F.col("g._length"))
                      & (F.col("r._salt") == F.col("g._salt")))
                .select(*[F.col(f"r.`{c}`") for c in names], (F.col("_before") + F.col("_number")).alias("_ordinal")))
    at, last = names.index(length_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ordinal = b.column(at).to_numpy(False), b.column(last).to_numpy(False)
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for size in np.unique(n):
                first, start, each, where, offsets = places.value[int(size)]
                mine = n == size
                k = np.searchsorted(first, ordinal[mine], "right") - 1
                bins, slot = np.divmod(ordinal[mine] - first[k], each[k])
                sequence[mine], offset[mine] = start[k] + bins, offsets[where[k] + slot]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, StructType([*rows.schema.fields, StructField("sequence_id", LongType()),
                                                StructField("offset", LongType())]))


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    cut = pieces(docs, tokenizer_path)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
