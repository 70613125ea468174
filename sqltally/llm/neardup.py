"""Near duplicates by Order MinHash, verified by banded alignment.

1. Sketch.  A text's words are cut into k-mers (four words), each labelled with
   its occurrence number.  For each of ``SKETCHES`` hash functions the smallest
   k-mer gives a bucket, and the three smallest, put back into text order, a
   finer one.  Texts of up to ``SHORT`` words may have no k-mer in common and be
   similar all the same: they and the texts that can be similar to them also get
   a bucket for each piece of words of which one must stand unchanged in both
   (pigeonhole), so that no pair with a short text is missed.
2. Linking.  In each bucket every text is paired with one leader, the smallest
   key; these pairs grow in proportion to the texts and link most of them.
3. The rest.  In each bucket that still holds several classes, all pairs of
   texts of different classes are compared, in blocks of ``BLOCK`` texts, so
   that no large bucket lands in one task.  None is left out or cut short: their
   number grows with the square of a bucket of texts that are not similar, so
   that a matrix product compares their bags of words, in order of length.
   Partners with the most possible pairs (such as the text that the others were
   made from) go first; pairs that are in one class by then need no comparison.
4. Verification.  Pairs whose length or bag of words already rules them out go
   first; both are exact bounds.  The rest are aligned, word by word, within the
   band that the similarity allows (bit-parallel edit distance).
5. Classes are the connected components of the verified links, found by
   alternating star contraction with joins and grouped minima.

Texts are handled once each, by the MD5 of the text: copies meet again only at
the end.  Intermediate tables are written to the shared scratch folder.

Defined results: similarity is 1 - edit distance / longer length, in lower-case
words; texts of fewer than four words have one k-mer; texts without words (a
null counts as empty) are alike only if they are equal; the class id is the
smallest document id of the class (null if it has none); rows with equal id and
text stay as rows in ``classes`` and as one row in ``distinct``; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from sqltally.llm.common import add_column, col, discard, release, text_of, written

K = 4
SIMILARITY = 0.8
SKETCHES = 32
LEVELS = (1, 3)  # how many smallest k-mers make up a bucket's tuple; all pairs of the first level are settled
SHORT = 24  # pairs in which the shorter text has up to so many words are found without sketches
BLOCK = 4096  # texts of a bucket that are compared at once with as many others
BAG = 128  # counters in a short text's bag of words
LONG, MOST_COUNTERS = 512, 1 << 14  # texts of LONG words or more have about a counter for each word, up to so many
TIERS = 4  # counts of a bag that are compared at once by a matrix product
CELLS = 1 << 22  # numbers in such a matrix
FEW = 1 << 16  # pairs whose texts are picked without a shuffle of all texts
CACHE_WORDS = 100_000
HASHED = 1 << 17  # values of hash functions that are held at once

_WORDS = re.compile(r"\w+").findall
_RANDOM = np.random.default_rng(5)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, SKETCHES, np.uint64)
_LAST = np.uint64((1 << 64) - 1)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        v = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return v


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number mixed in."""
    n = max(1, len(hashes) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        h = _mixed(h + hashes[i:i + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(n)
    seen = np.empty(n, np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mixed(h + seen * _MIX)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A value for each hash function and level: all of the first level, then the next."""
    h = kmers(hashes)
    most = min(LEVELS[-1], len(h))
    low = np.empty((SKETCHES, most), np.int64)  # places of the smallest k-mers, smallest first
    many = max(1, HASHED // len(h))
    for i in range(0, SKETCHES, many):
        x = h * _MULTIPLY[i:i + many, None] + _ADD[i:i + many, None]  # different k-mers keep different values
        for k in range(most):
            low[i:i + many, k] = x.argmin(1)
            x[np.arange(len(x)), low[i:i + many, k]] = _LAST
    out = []
    for size in LEVELS:
        v = np.arange(SKETCHES, dtype=np.uint64)
        for place in np.sort(low[:, :size], 1).T:
            v = _mixed(v + h[place])
        out.append(v)
    return np.concatenate(out).view(np.int64)


def _segments(n: int) -> list[tuple[int, int]]:
    """(start, end) of one piece more than the edits that a text of ``n`` words allows."""
    pieces = int(_allowed(n)) + 1
    return [(i * n // pieces, (i + 1) * n // pieces) for i in range(pieces)]


def short_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of which a text shares one with each similar text, if the shorter has up to SHORT words.

    The longer text of a pair, of ``longer`` words, is cut into one piece more
    than the edits allowed, so that one piece stands whole in the shorter, moved
    by ``x`` words: at least abs(x) edits lie before it and abs(gap + x) after it.
    """
    n, out, runs = len(hashes), [], {}
    longer = n
    while longer - int(_allowed(longer)) <= min(n, SHORT):
        most, gap = int(_allowed(longer)), longer - n
        for i, (start, end) in enumerate(_segments(longer)):
            size = end - start
            if size not in runs:
                h = np.zeros(max(0, n - size + 1), np.uint64)
                for k in range(size):
                    h = _mixed(h + hashes[k:k + len(h)])
                runs[size] = h
            low, high = -((most + gap) // 2), (most - gap) // 2
            found = runs[size][max(0, start + low):max(0, start + high + 1)]
            out.append(_mixed(found + np.uint64(longer * 1024 + i) * _MIX))
        longer += 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """All buckets of a text: even numbers, but odd ones for the finer levels."""
    every, one = sketch(hashes).view(np.uint64), np.uint64(1)
    first, finer = every[:SKETCHES], every[SKETCHES:]
    return np.concatenate([np.unique(np.concatenate([first, short_buckets(hashes)]) & ~one),
                           np.unique(finer | one)]).view(np.int64)


def _counters(n: int) -> int:
    """Counters in the bag of a text of ``n`` words: a power of two, as the longer text's bag is folded to the shorter's."""
    return BAG if n < LONG else min(1 << (n.bit_length() - 1), MOST_COUNTERS)


def bag_of(hashes: np.ndarray) -> np.ndarray:
    size = _counters(len(hashes))
    return np.minimum(np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def folded(bags: list[bytes], size: int) -> np.ndarray:
    """The bags, a row each, as they are with ``size`` counters."""
    if all(len(b) == size for b in bags):
        return np.frombuffer(b"".join(bags), np.uint8).reshape(-1, size)
    return np.stack([np.minimum(np.frombuffer(b, np.uint8).reshape(-1, size).sum(0), 255).astype(np.uint8) for b in bags])


def _describe(known: _Hashes, texts: pa.Array) -> pa.Array:
    sizes, bags, buckets = [], [], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for t in texts.to_pylist():
            ws = words(t)
            h = np.array(list(map(known.__getitem__, ws)), np.uint64)
            if len(known) > CACHE_WORDS:
                known.clear()
            sizes.append(len(ws))
            bags.append(bag_of(h).tobytes())
            buckets.append(buckets_of(h) if ws else buckets[0])
    ends = np.cumsum([len(x) for x in buckets], dtype=np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int32()), pa.array(bags, pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(buckets))],
        ["n", "bag", "buckets"])


_DESCRIBED = StructType([StructField("n", IntegerType()), StructField("bag", BinaryType()),
                         StructField("buckets", ArrayType(LongType()))])


def text_key(text_col: str = "text") -> Column:
    return F.unhex(F.md5(text_of(text_col)))


def sketches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n, bag, buckets) for each different text with words, written."""
    rows = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("_t"))
    described = functools.partial(_describe, _Hashes())  # each task has its own cache
    rows = add_column(rows, "d", _DESCRIBED, described, "_t").where("d.n > 0").select("key", "d.*")
    return written(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "bag", "buckets")]), "order-minhash")


def members(texts: DataFrame) -> DataFrame:
    """(bucket, key, leader, size) of every text in a bucket of two or more, written."""
    rows = texts.select(F.explode("buckets").alias("bucket"), "key")
    shared = rows.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("size")).where("size > 1")
    return written(rows.join(shared, "bucket"), "near-buckets")


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of a bucket's leader and a member, and in how many buckets."""
    return (rows.where(F.col("key") != F.col("leader")).groupBy(F.col("leader").alias("a"), F.col("key").alias("b"))
            .agg(F.count("*").alias("shared")))


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An edit distance that texts with these bags, row by row, have at least."""
    d = x.astype(np.int16) - y
    more, all_ = np.maximum(d, 0).sum(1), d.sum(1)
    return np.maximum(more, more - all_)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that lengths and bags of words don't rule out."""
    for b in batches:
        if not b.num_rows:
            continue
        na, nb = b["na"].to_numpy(False), b["nb"].to_numpy(False)
        most = _allowed(np.maximum(na, nb))
        good = abs(na - nb) <= most
        bags_a, bags_b = b["bag_a"].to_pylist(), b["bag_b"].to_pylist()
        size = np.array([min(len(x), len(y)) for x, y in zip(bags_a, bags_b, strict=True)])
        for s in np.unique(size[good]):
            of = np.flatnonzero(good & (size == s))
            for at in (of[k:k + CELLS // s] for k in range(0, len(of), CELLS // s)):
                good[at] = _least(folded([bags_a[i] for i in at], s), folded([bags_b[i] for i in at], s)) <= most[at]
        yield b.select(["a", "b", "shared"]).filter(pa.array(good))


def _tiers(bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first TIERS of each count as zeros and ones, of which a product counts the words two bags share; how many are above."""
    return (np.concatenate([bags > t for t in range(TIERS)], 1).astype(np.float32),
            np.maximum(bags.astype(np.int16) - TIERS, 0).sum(1))


def _near(n: np.ndarray, bags: list[bytes], root: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of different roots (and of different ``own``, if given) that lengths and
    bags don't rule out; the texts are in the order of their lengths."""
    size, most = np.array([len(x) for x in bags]), _allowed(n)
    end = np.searchsorted(n, n / SIMILARITY + 1e-6, "right")  # longer texts are too long
    for s in np.unique(size):
        first, last = np.searchsorted(size, [s, s + 1])
        words_of = folded(bags[first:end[last - 1]], s)
        total = words_of.sum(1)
        step = max(1, CELLS // (s * TIERS))
        for at in range(first, last, min(step, 512)):
            i = np.arange(at, min(at + min(step, 512), last))
            for start in range(at, end[i[-1]], step):
                j = np.arange(start, min(start + step, end[i[-1]]))
                x, y = words_of[i - first], words_of[j - first]
                good = (i[:, None] < j) & (root[i][:, None] != root[j]) & (n[j] - n[i][:, None] <= most[j])
                if own is not None:
                    good &= own[i][:, None] != own[j]
                if np.count_nonzero(good) > 4 * (len(i) + len(j)):  # else one by one is cheaper
                    (tx, rx), (ty, ry) = _tiers(x), _tiers(y)
                    shared = tx @ ty.T + np.minimum(rx[:, None], ry)  # as many words or more are in both
                    good &= shared >= np.maximum(total[i - first][:, None], total[j - first]) - most[j]
                p, q = np.nonzero(good)
                for k in range(0, len(p), many := max(1, CELLS // s)):
                    u, v = p[k:k + many], q[k:k + many]
                    close = _least(x[u], y[v]) <= most[j[v]]
                    yield i[u[close]], j[v[close]]


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The possible pairs of different classes in each block of a bucket."""
    for b in batches:
        for row in range(b.num_rows):
            m = b["texts"][row].values
            m = m.take(pa.array(np.argsort(m.field("n").to_numpy(), kind="stable")))
            root = m.field("root").dictionary_encode().indices.to_numpy()
            # pairs inside one block have a group of their own
            own = m.field("own").to_numpy() if b["x"][row].as_py() != b["y"][row].as_py() else None
            key = m.field("key").to_pylist()
            for i, j in _near(m.field("n").to_numpy(), m.field("bag").to_pylist(), root, own):
                pairs = [(key[p], key[q]) if key[p] < key[q] else (key[q], key[p]) for p, q in zip(i, j, strict=True)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def crossing(rows: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, shared): all possible pairs of different classes in a bucket of the first level."""
    sides = (texts.join(known, "key", "left")
             .select("key", "n", "bag", F.coalesce("root", "key").alias("root")))
    rows = rows.where("bucket % 2 = 0").select("bucket", "key", "size").join(sides, "key")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rows = rows.join(several.select("bucket"), "bucket")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    blocks = rows.groupBy("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(
        F.collect_list(F.struct("key", "n", "bag", "root", "own")).alias("texts")).where(F.size("texts") > 1)
    return blocks.select("x", "y", "texts").mapInArrow(_crossing, _PAIR).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _allowed(longer):
    """The largest edit distance that SIMILARITY allows."""
    return np.floor((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)


def distance(where: dict[str, int], m: int, other: list[str], most: int) -> int:
    """Edit distance of a text of ``m`` words, given by the positions of each as
    bits, to another, or ``most`` + 1 if it is larger.

    Bit-parallel dynamic programming (Myers, Hyyro) over a band of 2 * ``most``
    + 1 diagonals; needs ``m`` > ``most`` and lengths no further apart than that.
    """
    n, width = len(other), 2 * most + 1
    full, diagonal, horizontal = (1 << width) - 1, 1 << (2 * most), 1 << (2 * most - 1) if most else 0
    vp, vn, score, worst = full & (full << most), 0, most, most + n - (m - most)
    for j, w in enumerate(other):
        x, start = where.get(w, 0), j - most
        x = (x >> start if start >= 0 else x << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if j < m - most:
            score += not d0 & diagonal
        else:
            score += bool(hp & horizontal) - bool(hn & horizontal)
            horizontal >>= 1
        if score > worst:
            return most + 1
        down = d0 >> 1
        vp, vn = hn | (full & ~(down | hp)), down & hp
    return min(score, most + 1)


def similar(a: list[str], b: list[str], where: dict[str, int] | None = None) -> bool:
    most = int(_allowed(max(len(a), len(b))))
    if abs(len(a) - len(b)) > most:
        return False
    return distance(positions(a) if where is None else where, len(a), b, most) <= most


def positions(ws: list[str]) -> dict[str, int]:
    out: dict[str, list[int]] = {}
    for i, w in enumerate(ws):
        out.setdefault(w, []).append(i)
    bits = {}
    for w, at in out.items():
        mask = np.zeros(at[-1] // 8 + 1, np.uint8)
        np.bitwise_or.at(mask, np.array(at) // 8, np.left_shift(1, np.array(at) % 8).astype(np.uint8))
        bits[w] = int.from_bytes(mask.tobytes(), "little")
    return bits


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, ws, where = None, [], {}
    for b in batches:
        keep = []
        for key, ta, tb in zip(b["a"].to_pylist(), b["ta"].to_pylist(), b["tb"].to_pylist(), strict=True):
            if key != last:
                last, ws = key, words(ta)
                where = positions(ws)
            keep.append(similar(ws, words(tb), where))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


_PAIR = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, written."""
    pairs = written(pairs.select("a", "b"), "near-pairs")
    if pairs.count() <= FEW:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        texts = texts.join(F.broadcast(ends), "key", "left_semi")
    both = (pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb"))
    links = written(both.mapInArrow(_aligned, _PAIR), "near-links")
    discard(pairs)
    return links


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each linked key's component (alternating star contraction)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, last = None, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("near")).select("v", F.least("v", "near").alias("m"))
        # large star: the larger neighbours of a node are hung on its smallest neighbour
        edges = wide = written(edges.join(low, "v").select("u", F.col("m").alias("v")).where("u != v").distinct(), "star")
        # small star: a node and its smaller neighbours are hung on the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hung.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "star")
        discard(wide, *([last] if last else []))
        last = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = now


def classes_of_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, root) of the texts that share a class with a different text."""
    spark = docs.sparkSession
    described = sketches(docs, text_col)
    side = lambda s: described.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("bag").alias(f"bag_{s}"))
    kind = StructType([*_PAIR.fields, StructField("shared", LongType())])
    rows = members(described)
    release(spark)
    pairs = written(candidates(rows).join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible, kind), "near-pairs")
    texts = (docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("text"))
             .groupBy("key").agg(F.first("text").alias("text")))
    texts = written(texts.join(rows.select("key").distinct(), "key", "left_semi"), "near-texts")
    release(spark)
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    known = linked(None, best, texts)
    known = linked(known, apart(pairs.join(best, ["a", "b"], "left_anti"), known), texts)
    # every other pair of a bucket whose texts are not in one class yet
    more = written(crossing(rows, described, known).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "near-crossing")
    discard(rows, described, pairs)
    release(spark)
    if not more.isEmpty():
        best = written(most_wanted(more), "near-wanted")
        known = linked(known, best, texts)
        known = linked(known, apart(more.join(best, ["a", "b"], "left_anti"), known), texts)
        discard(best)
    discard(more, texts)
    return known


def linked(known: DataFrame | None, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The components with the links among ``pairs``."""
    links = verify(pairs, texts)
    release(pairs.sparkSession)
    known = components(links if known is None else known.select(F.col("key").alias("a"), F.col("root").alias("b")).union(links))
    discard(links)
    release(pairs.sparkSession)
    return known


def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are not in one class."""
    root = lambda s: known.select(F.col("key").alias(s), F.col("root").alias(f"r{s}"))
    return (pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def most_wanted(pairs: DataFrame) -> DataFrame:
    """(a, b): of each text, the pair with the partner that has the most pairs."""
    ends = pairs.select(F.col("a").alias("key"), F.col("b").alias("mate"), "shared").union(
        pairs.select(F.col("b").alias("key"), F.col("a").alias("mate"), "shared"))
    degree = ends.groupBy(F.col("key").alias("mate")).agg(F.count("*").alias("degree"))
    best = ends.join(degree, "mate").groupBy("key").agg(F.max(F.struct("degree", "shared", "mate")).alias("m"))
    return best.select(F.least("key", "m.mate").alias("a"), F.greatest("key", "m.mate").alias("b")).distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _key, _class (smallest id of the class), _size and _first (the key of the row that stays)."""
    roots = classes_of_texts(docs, text_col)
    rows = docs.withColumn("_key", text_key(text_col))
    first = F.min(F.when(col(id_col).isNotNull(), F.struct(col(id_col).alias("id"), F.col("_key").alias("key"))))
    per_text = (rows.groupBy("_key").agg(first.alias("f"), F.count("*").alias("n"))
                .join(roots.withColumnRenamed("key", "_key"), "_key", "left")
                .withColumn("root", F.coalesce("root", "_key")))
    per_class = per_text.groupBy("root").agg(F.min("f").alias("g"), F.sum("n").alias("_size"), F.min("_key").alias("k"))
    of = per_text.select("_key", "root").join(per_class, "root").select(
        "_key", F.col("g.id").alias("_class"), "_size", F.coalesce("g.key", "k").alias("_first"))
    return rows.join(of, "_key")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) for every row of ``docs``."""
    m = _marked(docs.select(col(id_col), col(text_col)), id_col, text_col)
    return m.select(col(id_col), F.col("_class").alias("class_id"), F.col("_size").alias("class_size"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns."""
    m = _marked(docs, id_col, text_col)
    stays = (F.col("_key") == F.col("_first")) & col(id_col).eqNullSafe(F.col("_class"))
    return m.where(stays).dropDuplicates(["_key"]).select(*[col(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return classes(docs)


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form: one document of each class."""
    return distinct(docs)
