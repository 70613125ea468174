"""Phrase collocations, counted by dynamic itemset counting.

The corpus is dealt into ``SHARDS`` shards, which are scanned in a cycle.  Words
count from the first scan on.  Once both parts of a longer phrase (all words but
the last, all but the first) have reached the threshold in the scans so far, the
phrase is counted from the next scan on, next to the shorter ones that are still
open, until it has seen each shard once.  So lengths interleave, all counts that
matter are exact, and most phrases that can't reach the threshold are never
counted.

Which phrases have reached it is told by a table of ``SLOTS`` bytes, whatever the
corpus: a slot holds the number of the scan after which the first phrase of that
hash reached the threshold.  Two phrases in one slot can only start a count early or
without need, and a start never changes, so that counts stay exact.  Open counts
are a table by phrase; after each scan the new counts are added to it, whole
cycles leave it, and it is written anew.

Everything is per language.  A candidate is scored by its weakest cut,
floor(2000000 a / (l + r)), in decimals; one whose words stand inside a longer
candidate with nearly as many occurrences is dropped.

Defined results: words are runs without space and tab, cut by . , ; : ! ? and
line ends, A-Z as a-z; a null text is empty, a null language ``und``; repeated rows
count each; ties go by count and phrase; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sqltally.llm.common import col, discard, release, text_of, written
from sqltally.llm.tokens import classes, hashes, mixed, steps, words_of

LEAST = 30
LENGTHS = 4
ABSORB = 80  # percent of a phrase's occurrences in a longer one that make it a part only
TOP = 2000
SHARDS = 2
SLOTS = 1 << 25
SCALE = 2_000_000
KEYS = 100_000  # phrases made into text at once

_KINDS = classes(b" \t", b".,;:!?\n\v\f\r")
_NEVER = 255  # in the table of slots: not reached
_SLOT = np.uint64(64 - SLOTS.bit_length() + 1)
_BITS = 32768  # of a bitmap of bitmap_construct_agg


@functools.lru_cache(maxsize=1)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _wide(value: bytes) -> pa.Scalar:
    return pa.scalar(value, pa.large_binary())


def _phrases(texts: pa.Array, lang: str, table: np.ndarray, scan: int, shards: int) -> Iterator[tuple]:
    """(length, phrases with their language, slots, first scans, counts) of the open phrases of texts of one language."""
    w = words_of(texts, _KINDS)
    tail = b"\t" + lang.encode("utf-8", "surrogatepass")
    many, h = len(w.names), mixed(hashes(w.names.to_pylist()) + hashes([tail]))
    last = pc.binary_join_element_wise(w.names, _wide(tail), _wide(b""))
    place, unit = np.arange(len(w.ids)), w.ids.astype(np.int64)  # where phrases of this length begin, and the number of each
    parts, start = np.arange(many)[:, None], np.zeros(many, np.int64)  # of each phrase, its words and first scan
    for length in range(1, LENGTHS + 1):
        slot = (mixed(h) >> _SLOT).astype(np.int64)
        some = np.flatnonzero((start <= scan) & (scan < start + shards))
        times = np.bincount(unit, minlength=many)
        for at in (some[k:k + KEYS] for k in range(0, len(some), KEYS)):
            text = [w.names.take(pa.array(x)) for x in parts[at, :-1].T] + [last.take(pa.array(parts[at, -1]))]
            text = pc.binary_join_element_wise(*text, _wide(b" "))
            yield length, text.to_numpy(zero_copy_only=False), slot[at], start[at], times[at]
        if length == LENGTHS:
            return
        # a longer phrase begins where two phrases of this length that have reached the threshold follow each other
        ready = table[slot].astype(np.int64)
        number = np.full(len(w.ids) + 1, -1)
        number[place] = np.where(ready[unit] != _NEVER, unit, -1)
        place = place[(number[place] >= 0) & (number[place + 1] >= 0) & w.joined[place + length - 1]]
        left, right = number[place], number[place + 1]
        since = np.maximum(ready, start)  # a slot may be older than its phrase, which was not looked at before its own start
        first, second = h * np.uint64(3), mixed(h)
        # of those, only phrases that are open or have reached the threshold matter
        begin = np.maximum(since[left], since[right])
        matter = (begin <= scan) & (scan < begin + shards)
        if length + 1 < LENGTHS:
            matter |= table[(mixed(mixed(first[left] + second[right])) >> _SLOT).astype(np.int64)] != _NEVER
        place, left, right = place[matter], left[matter], right[matter]
        if not len(place):
            return
        _, at, unit = np.unique(left * many + right, return_index=True, return_inverse=True)
        left, right, many = left[at], right[at], len(at)
        parts = np.column_stack([parts[left], w.ids[place[at] + length]])
        start = np.maximum(since[left], since[right])
        h = mixed(first[left] + second[right])


# ``marks`` of a phrase: its slot, first scan and length in one number
_ROW = StructType([StructField("key", StringType()), StructField("marks", LongType()), StructField("n", LongType())])


def scan(docs: DataFrame, packed: bytes, number: int, shards: int) -> DataFrame:
    """(key, marks, n): open phrases of one scan; a key is phrase, tab, language; words also count under "", of length 0."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def rows(length: int, keys: list | np.ndarray, slot: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        marks = slot.astype(np.int64) << 16 | start.astype(np.int64) << 8 | length
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).view(pa.string()), pa.array(marks), pa.array(n.astype(np.int64))],
                                          names=["key", "marks", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        with np.errstate(over="ignore"):
            for b in steps(batches, 1):
                langs = b.column(0).dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = pa.array(np.flatnonzero(langs.indices.to_numpy() == k))
                    for part in _phrases(b.column(1).take(mine), lang, table, number, shards):
                        if part[0] == 1:
                            yield rows(0, [b"\t" + lang.encode("utf-8", "surrogatepass")], np.zeros(1), np.zeros(1), part[4].sum(keepdims=True))
                        yield rows(*part)

    return docs.select("lang", "text").mapInArrow(run, _ROW)


def _length() -> Column:
    return F.col("marks").bitwiseAND(F.lit(255))


def _start() -> Column:
    return F.shiftright("marks", 8).bitwiseAND(F.lit(255))


def _reached(now: DataFrame, least: int) -> np.ndarray:
    """Which slots have open phrases that have reached the threshold."""
    fresh = now.where((F.col("n") >= least) & _length().between(1, LENGTHS - 1))
    at = F.shiftright("marks", 16) + 1  # bitmaps count from 1
    maps = fresh.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(SLOTS, bool)
    for r in maps.collect():  # SLOTS / 8 bytes at most, whatever the corpus
        out[(r.bucket - 1) * _BITS:r.bucket * _BITS] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    return out


def count(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, length, phrase, n) of all phrases of up to LENGTHS words with ``least`` occurrences, and for length 0 all words; written."""
    spark = docs.sparkSession
    dealt = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"),
                        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    dealt = written(dealt, "phrase-shards", by="shard")
    table = np.full(SLOTS, _NEVER, np.uint8)
    open_, done, number, since = None, None, 0, 0
    while number < shards or since < shards:  # a phrase starts after its parts' scan, so it is whole ``shards`` scans on
        new = scan(dealt.where(F.col("shard") == number % shards), zlib.compress(table.tobytes(), 1), number, shards)
        if open_ is not None:
            new = new.unionByName(open_.where(_start() + shards > number))
        now = new.groupBy("key").agg(F.min("marks").alias("marks"), F.sum("n").alias("n"))
        now = written(now, f"phrase-counts-{number}")
        whole = now.where((_start() + shards - 1 == number) & ((F.col("n") >= least) | (_length() == 0)))
        whole = written(whole.select("key", _length().alias("length"), "n"), f"phrases-{number}")
        done = whole if done is None else done.unionByName(whole)
        hit = _reached(now, least)
        fresh = hit & (table == _NEVER)
        table[fresh] = number + 1
        since = 0 if fresh.any() else since + 1
        if open_ is not None:
            discard(open_)
        open_, number = now, number + 1
        release(spark)
    discard(open_)
    discard(dealt)
    phrase = F.substring_index("key", "\t", 1)
    return done.select(F.expr("substring(key, length(substring_index(key, '\t', 1)) + 2)").alias("lang"),
                       F.col("length").cast("int").alias("length"), phrase.alias("phrase"), "n")


def _part(words: Column, first: Column, many: Column) -> Column:
    return F.array_join(F.slice(words, first, many), " ")


def collocations(counts: DataFrame, least: int = LEAST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from the result of ``count``."""
    words = counts.where("length = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("length > 0")
    found = (known.where((F.col("length") > 1) & (F.col("n") >= least))
             .select("lang", "phrase", "length", F.col("n").alias("a"), F.split("phrase", " ").alias("words")))
    cuts = (found.select("lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
            .withColumn("head", _part(F.col("words"), F.lit(1), F.col("k")))
            .withColumn("rest", _part(F.col("words"), F.col("k") + 1, F.col("length") - F.col("k"))))
    side = lambda s, n: known.select("lang", F.col("phrase").alias(s), F.col("n").alias(n))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} * cast(a as decimal(30,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*"))
    # the most frequent longer candidate that holds each shorter one
    inner = found.where("length > 2").select("lang", "a", "words", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("length") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: F.struct(m.alias("m"), i.alias("i")))))).alias("at"))
    inner = inner.select("lang", _part(F.col("words"), F.col("at.i"), F.col("at.m")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(absorb).cast("decimal(20,0)") * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                                           F.col("total").alias("n"), "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(count(docs))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spans AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, 2000000::HUGEINT * c.a // (l.n + r.n) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, w, m, unnest(range(2, m)) AS size FROM cand WHERE m > 2),
parts AS (SELECT lang, a, w, size, unnest(range(1, m - size + 2)) AS i FROM inside),
longest AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longest g USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""
