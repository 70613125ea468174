"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension: whether its value is above zero.
Different codes are dealt into shards of up to ``SHARD`` codes, and every query
goes to every shard, in blocks.  A shard's codes are cut into segments of about
log2(codes) bits, with a sorted list of each segment's values.  The search looks
up one segment after the other: step r changes r div s bits (s segments) of
segment r mod s.  After step r every code within a distance of r has been found,
since further away in each segment means further away in all; found codes are
verified by their full distance.  A query ends as soon as its k-th verified
distance is at most r.  Where a step would look up more values than there are
codes, the remaining codes are all compared instead.

Vectors with equal codes are one entry with the smallest k + 1 ids, all that a
top-k can use (one more, since a query leaves itself out); queries with equal
codes are one query.  Each shard returns k + 1 entries a query at most, ordered
by distance and smallest id, and the best of all shards are the result.

Defined results: a query is never its own neighbour, but a repeated row with
another id is; fewer than k others give fewer rows; ties go to the smaller id; a
null id, a null vector or a vector of another dimension than most rows has no
code and takes no part; a null value counts as not above zero; rows with equal
ids and codes count once; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sqltally.llm.common import col, written

K = 10
QUERY_EVERY = 50
SHARD = 1 << 20  # codes that one task indexes, at most about
SPREAD = 1 << 12  # codes that a shard has at least about, up to SHARDS shards
SHARDS = 64
QUERIES = 1024  # queries searched at once
PAIRS = 1 << 20  # pairs of query and code verified at once


def code_words(vector: Column, dim: int) -> Column:
    """array<bigint>: the code of a vector, 64 bits a word."""
    words = []
    for at in range(0, dim, 64):
        bits = [F.when(F.get(vector, at + i) > 0, F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0).cast("bigint"))
                for i in range(min(64, dim - at))]
        words.append(F.aggregate(F.array(*bits), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


class Index:
    """Codes of one shard, by segment."""

    def __init__(self, codes: np.ndarray, dim: int, bits: int | None = None):
        self.codes, self.dim = codes, dim
        want = bits or min(20, max(1, round(np.log2(max(2, len(codes))))))
        self.segments = []  # word, first bit, width
        for word, at in enumerate(range(0, dim, 64)):
            size = min(64, dim - at)
            parts = -(-size // want)
            cuts = [i * size // parts for i in range(parts + 1)]
            self.segments += [(word, p, q - p) for p, q in zip(cuts[:-1], cuts[1:])]
        values = [self.part(codes, s) for s in range(len(self.segments))]
        self.order = [np.argsort(v, kind="stable") for v in values]
        self.sorted = [v[o] for v, o in zip(values, self.order)]

    def part(self, codes: np.ndarray, segment: int) -> np.ndarray:
        word, first, width = self.segments[segment]
        return (codes[:, word] >> np.uint64(first)) & np.uint64((1 << width) - 1)

    def lookups(self, asked: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) pairs that are first found in a step."""
        segment, change = step % len(self.segments), step // len(self.segments)
        width = self.segments[segment][2]
        if change > width:
            return
        masks = np.array([sum(1 << b for b in some) for some in itertools.combinations(range(width), change)], np.uint64)
        probes = (self.part(asked, segment)[:, None] ^ masks).ravel()
        low, high = (np.searchsorted(self.sorted[segment], probes, side) for side in ("left", "right"))
        n = high - low
        ends = np.cumsum(n)
        at = 0
        while at < len(probes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            many = n[at:end]
            query = np.repeat(np.arange(at, end) // len(masks), many)
            entry = self.order[segment][np.repeat(low[at:end], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            new = np.ones(len(query), bool)
            for s in range(len(self.segments)):  # found before, where another segment was within its radius already
                if s != segment:
                    apart = np.bitwise_count(self.part(asked[query], s) ^ self.part(self.codes[entry], s))
                    new &= apart > (change if s < segment else change - 1)
            yield query[new], entry[new]
            at = end

    def nearest(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance): the ``k`` nearest entries of each query, of equal ones the first."""
        best = [np.zeros(0, np.int64)] * 3  # query, distance, entry: sorted, k for each query at most
        open_, n, step = np.arange(len(asked)), len(self.codes), 0

        def keep(query: np.ndarray, entry: np.ndarray) -> None:
            distance = np.bitwise_count(asked[query] ^ self.codes[entry]).sum(1, dtype=np.int64)
            every = [np.concatenate(x) for x in zip(best, (query, distance, entry))]
            order = np.lexsort(every[::-1])
            every = [x[order] for x in every]
            place = np.arange(len(order)) - np.searchsorted(every[0], every[0])
            best[:] = [x[place < k] for x in every]

        while len(open_) and step <= self.dim:
            width, change = self.segments[step % len(self.segments)][2], step // len(self.segments)
            if math.comb(width, change) > n:
                left = ~np.isin(best[0], open_)  # all codes are compared: what was found of these queries is found again
                best[:] = [x[left] for x in best]
                size = max(1, PAIRS // n)
                for q in (open_[p:p + size] for p in range(0, len(open_), size)):
                    keep(np.repeat(q, n), np.tile(np.arange(n), len(q)))
                break
            for query, entry in self.lookups(asked[open_], step):
                keep(open_[query], entry)
            within = np.bincount(best[0][best[1] <= step], minlength=len(asked))
            open_ = open_[within[open_] < min(k, n)]
            step += 1
        return best[0], best[2], best[1]


_TILE = StructType([StructField("q", LongType()), StructField("distance", IntegerType()), StructField("ids", ArrayType(LongType()))])


def _search_shards(rows: DataFrame, dim: int, k: int, bits: int | None) -> DataFrame:
    """(q, distance, ids) from rows (shard, kind, first, code, q, ids), sorted by shard and kind: its codes, then all queries."""
    kind = StructType([_TILE.fields[0], _TILE.fields[1], rows.schema["ids"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes, ids, index = None, [], [], None
        for b in batches:
            shards, kinds = (b[c].to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), b.num_rows]
            for p, q in zip(cuts[:-1], cuts[1:]):
                if p == q:
                    continue
                part = b.slice(p, q - p)
                if shards[p] != shard:
                    shard, codes, ids, index = shards[p], [], [], None
                words = part["code"].flatten().to_numpy().view(np.uint64).reshape(-1, -(-dim // 64))
                if kinds[p] == 0:
                    codes.append(words)
                    ids.append(part["ids"])
                    continue
                if not codes:
                    continue
                if index is None:
                    index, held = Index(np.concatenate(codes), dim, bits), pa.concat_arrays(ids)
                for at in range(0, len(words), QUERIES):
                    query, entry, distance = index.nearest(words[at:at + QUERIES], k)
                    yield pa.RecordBatch.from_arrays(
                        [part["q"].take(pa.array(query + at)), pa.array(distance.astype(np.int32)), held.take(pa.array(entry))],
                        names=["q", "distance", "ids"])

    return rows.mapInArrow(run, kind)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           bits: int | None = None) -> DataFrame:
    """(query, neighbour, distance, rank): the ``k`` nearest other vectors of each query by Hamming distance."""
    sizes = vectors.where(col(id_col).isNotNull()).groupBy(F.size(col(vector_col)).alias("n")).count().where("n > 0")
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    dim = top[0] if top else 1
    code = code_words(col(vector_col), dim).alias("code")
    usable = col(id_col).isNotNull() & (F.size(col(vector_col)) == dim)
    base = vectors.where(usable).select(col(id_col).alias("id"), code)
    place = Window.partitionBy("code", "part").orderBy("id")
    # the smallest ids of each code: first within parts of a code's rows, then of the parts
    parts = base.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = (parts.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
           .groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))
    codes = written(few, "codes")
    asked = written(queries.where(usable).select(col(id_col).alias("query"), code).distinct(), "queries")
    open_ = written(asked.select("code").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")

    n = codes.count()
    shards = max(-(-n // SHARD), min(SHARDS, -(-n // SPREAD)), 1)
    entries = codes.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                           F.col("ids")[0].alias("first"), "code", F.lit(None).cast("bigint").alias("q"), "ids")
    none = lambda c: F.lit(None).cast(entries.schema[c].dataType).alias(c)
    probes = open_.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
                          none("first"), "code", "q", none("ids"))
    rows = entries.union(probes).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "first")
    near = _search_shards(rows, dim, k + 1, bits)
    best = F.row_number().over(Window.partitionBy("q").orderBy("distance", F.col("ids")[0]))
    near = near.withColumn("place", best).where(F.col("place") <= k + 1).drop("place")
    pairs = (asked.join(open_, "code").select("query", "q").join(near, "q")
             .select("query", "distance", F.explode("ids").alias("neighbour")).where(F.col("query") != F.col("neighbour")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "neighbour", "distance", "rank")


def query(vectors: DataFrame) -> DataFrame:
    asked = vectors.where(F.col("vec_id") % QUERY_EVERY == 0)
    return search(vectors, asked).select(F.col("query").alias("query_id"), F.col("neighbour").alias("vec_id"),
                                         F.col("distance").cast("bigint").alias("distance"),
                                         F.col("rank").cast("bigint").alias("rank"))


ORACLE = f"""
WITH codes AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END),
    'string_agg', '')::BIT AS code FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::BIGINT AS distance
    FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
FROM pairs QUALIFY rank <= {K}
"""
