"""N-gram Jaccard join: documents whose sets of word shingles are alike.

1. Sets.  A document's set holds the 64-bit hashes of its different five-word
   shingles.  Documents with equal sets are one entry from here on.
2. Order.  A table of ``SLOTS`` counters, summed over all documents, says about
   how frequent each shingle is; any fixed order would give the same links, and
   with this one frequent shingles come last.
3. Keys.  Two sets that link share one of the first n - ceil(0.8 n) + 1 shingles
   of each; sets meet by these, and shingles that only one set has meet nobody.
4. Links to the first.  Under each shared shingle, every set is held against the
   first one; this settles most large groups with one pair a set.
5. Tiles.  Under each shingle that still holds several components, sets are dealt
   into bands of sizes (a link joins equal or neighbouring bands only) and blocks
   of ``BLOCK``; a tile is two blocks.  All its pairs of different components are
   looked at, none is left out; of those that the bound lets pass, a tile passes on
   as many as connect its sets, so that they grow with the sets.
6. Bound.  Each set has a bitmap in which every shingle flips one bit; larger sets
   have longer ones, and the halves of a longer one, put together, are the shorter.
   The bits in which two bitmaps differ are a lower bound of the shingles that only
   one of them has, so that sizes minus bits bound the overlap from above.
7. The pairs left are settled by intersecting their sorted arrays, made again from
   the texts.  Pairs that hang together go to one place, in blocks, so that an array
   travels once a block and not once a pair.
8. Groups.  Where pairs of tiles did not link, two components that they connect may
   link by others: there all sets of different components meet, in blocks, and are
   held against the bound and each other, until links connect them.
9. Components of the links, by grouped minima.

Defined results: words are runs without white space, A-Z as a-z; a text of fewer
than five words is one shingle; one without words (a null is empty) has an empty
set and its own id; a component's id is the smallest id of its rows (null if it
has none); rows with equal ids stay rows of their own; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from sqltally.llm.common import col, discard, text_of, written
from sqltally.llm.neardup import components
from sqltally.llm.tokens import classes, hashes, mixed, steps, words_of

SHINGLE = 5
PERCENT = 80
SLOTS = 1 << 22  # counters of shingles, whatever the corpus
SLOT_BLOCK = 1 << 16
LEAST_BITS, MOST_BITS = 64, 1 << 11  # of a bitmap; it has at least a bit a shingle in between
BLOCK = 1024  # sets of a shingle that a tile holds on each side
PLACE = 256  # sets of connected pairs that meet on each side when their arrays are compared
PAIRS = 200_000  # pairs looked at at once
HELD = 20_000  # sets unpacked at once, about
BAND = 100 / PERCENT  # sizes of a band differ by less than this factor

_SPACE = classes(b" \t\n\v\f\r")
_TOP = np.uint64(64 - SLOTS.bit_length() + 1)


def _values(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(doc, value): all shingles in the order of the texts."""
    w = words_of(texts, _SPACE)
    h, n = hashes(w.names.to_pylist())[w.ids], len(w.ids)
    end = np.searchsorted(w.doc, np.arange(len(texts)), "right")[w.doc]
    at = np.arange(n)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        more = at + k < end
        if more.all():
            value = mixed(value + (h[k:] if k else h))
        else:
            value[more] = mixed(value[more] + h[(at + k)[more]])
    first = np.ones(n, bool)
    first[1:] = w.doc[1:] != w.doc[:-1]
    whole = first | (at + size <= end)
    return w.doc[whole], value[whole]


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(doc, value): the different shingles of each text, by text and value."""
    doc, value = _values(texts, size)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for p, q in zip(ends[:-1], ends[1:]):
        value[p:q].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def least(n):
    """How many of ``n`` shingles a set must share to link with any other."""
    return -(-PERCENT * n // 100)


def frequencies(texts: DataFrame) -> bytes:
    """A level for each slot of shingles: twice the binary logarithm of its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.uint32)
        with np.errstate(over="ignore"):
            for b in steps(batches, 0):
                slot, times = np.unique((_values(b.column(0))[1] >> _TOP).astype(np.uint32), return_counts=True)
                n[slot] += times.astype(np.uint32)
        parts = [zlib.compress(n[k:k + SLOT_BLOCK].tobytes(), 1) for k in range(0, SLOTS, SLOT_BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                                         names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(counts.as_py()), np.uint32).astype(np.int64)
        levels = [np.floor(2 * np.log2(1 + n)).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())],
                                         names=["block", "counts"])

    kind = StructType([StructField("block", IntegerType()), StructField("counts", BinaryType())])
    blocks = texts.mapInArrow(count, kind).repartition(SLOTS // SLOT_BLOCK, "block").mapInArrow(add, kind)
    out = bytearray(SLOTS)
    for r in blocks.collect():  # SLOTS bytes, whatever the corpus
        out[r.block * SLOT_BLOCK:(r.block + 1) * SLOT_BLOCK] = r.counts
    return bytes(out)


def bits_of(n: np.ndarray) -> np.ndarray:
    """How many bits the bitmap of a set of ``n`` shingles has: a power of two."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmaps(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each text the parity of the shingles of each bit; ``n`` are the sets' sizes."""
    bits = bits_of(n)
    start = np.concatenate([[0], np.cumsum(bits)])
    at = start[doc] + (mixed(value).astype(np.int64) & (bits[doc] - 1))
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[p // 8:q // 8] for p, q in zip(start[:-1], start[1:])]


_DESCRIBED = [StructField("n", IntegerType()), StructField("key", BinaryType()), StructField("bits", BinaryType()),
              StructField("prefix", ArrayType(LongType()))]


def describe(rows: DataFrame, levels: bytes) -> DataFrame:
    """``rows`` (id, text_key, text) as (id, text_key, n, key, bits, prefix); no words: null but for n."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for b in steps(batches, 2):
            with np.errstate(over="ignore"):
                doc, value = shingles(b.column(2))
                n = np.bincount(doc, minlength=b.num_rows)
                bits = bitmaps(doc, value, n)
            ends = np.concatenate([[0], np.cumsum(n)])
            keys = [hashlib.md5(value[ends[i]:ends[i + 1]]).digest() if n[i] else None for i in range(b.num_rows)]
            rank, few = level[(value >> _TOP).astype(np.int64)], np.where(n > 0, n - least(n) + 1, 0)
            first = [np.argsort(rank[p:p + k], kind="stable")[:f] + p for p, k, f in zip(ends[:-1], n, few) if k]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32()),
                                              pa.array(value[np.concatenate(first) if first else []].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.binary()),
                 pa.array(bits, pa.binary()), prefix], names=["id", "text_key", "n", "key", "bits", "prefix"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *_DESCRIBED]))


class Sets:
    """Sizes and bitmaps of the sets of a batch."""

    def __init__(self, n: np.ndarray, bits: pa.Array):
        self.n, self.words = n, bits_of(n) // 64
        self.data = np.frombuffer(b"".join(bits.to_pylist()), np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.words)])

    def rows(self, which: np.ndarray, words: int) -> np.ndarray:
        """The bitmaps of some sets, halved down to ``words`` 64-bit words each."""
        out = np.empty((len(which), words), np.uint64)
        own = self.words[which]
        for w in np.unique(own).tolist():
            mine = np.flatnonzero(own == w)
            x = self.data[self.start[which[mine]][:, None] + np.arange(w)]
            while x.shape[1] > words:
                x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            out[mine] = x
        return out


def can_link(a: Sets, i: np.ndarray, b: Sets, j: np.ndarray) -> np.ndarray:
    """Of pairs of set i of ``a`` and set j of ``b``, whether sizes and bitmaps leave room for a link."""
    na, nb = a.n[i], b.n[j]
    out = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    words = np.minimum(a.words[i], b.words[j])
    for w in np.unique(words[out]).tolist():
        at = np.flatnonzero(out & (words == w))
        for k in (at[p:p + (1 << 19) // w] for p in range(0, len(at), (1 << 19) // w)):
            apart = np.bitwise_count(a.rows(i[k], w) ^ b.rows(j[k], w)).sum(1, dtype=np.int64)
            total = na[k] + nb[k]
            # overlap <= (total - apart) / 2, and it must be at least PERCENT of the union
            out[k] = (100 + PERCENT) * (total - apart) >= 2 * PERCENT * total
    return out


_PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(k, HELD) for k in range(0, whole.num_rows, HELD)):
            x, y = (Sets(b["n" + s].to_numpy(zero_copy_only=False).astype(np.int64), b["x" + s]) for s in "ab")
            at = np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(can_link(x, at, y, at)))


def _few_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of tiles that hold about HELD sets."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b["sets"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            yield b.slice(at, end - at)
            at = end


class Joined:
    """Which of a batch's components have been found to hang together."""

    def __init__(self, root: np.ndarray):
        self.roots, self.at = np.unique(root, return_inverse=True)
        self.of = np.arange(len(self.roots))

    def find(self, c: int) -> int:
        of = self.of
        while of[c] != c:
            of[c] = of[of[c]]
            c = of[c]
        return c

    def component(self) -> np.ndarray:
        """Of each set, its component by now."""
        while (self.of[self.of] != self.of).any():
            self.of = self.of[self.of]
        return self.of[self.at]

    def join(self, i: int, j: int) -> bool:
        """Whether sets ``i`` and ``j`` were apart; they are together from here on."""
        a, b = self.find(self.at[i]), self.find(self.at[j])
        self.of[max(a, b)] = min(a, b)
        return a != b

    def forest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of pairs (i, j) that, joined, connect all that the pairs connect: fewer than there are components."""
        of = self.component()
        low, high = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
        _, first = np.unique(low * len(self.roots) + high, return_index=True)
        return np.array([k for k in first.tolist() if self.join(i[k], j[k])], np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that connect all sets of different components that the bound lets pass in a tile.

    Every pair of a tile is looked at, but for those that others connect already:
    fewer pairs come out than sets went in.
    """
    for b in _few_sets(batches):
        m = b["sets"].flatten()
        band, own, root, sid, n = (m.field(c).to_numpy().astype(np.int64) for c in ("band", "own", "root", "sid", "n"))
        sets, joined = Sets(n, m.field("bits")), Joined(root)
        size = pc.list_value_length(b["sets"]).to_numpy(zero_copy_only=False)
        tile, apart = (np.repeat(x, size) for x in (b["tile"].to_numpy(), b["x"].to_numpy() != b["y"].to_numpy()))
        after = np.repeat(np.cumsum(size), size) - np.arange(len(n)) - 1  # sets that follow each in its tile
        done = np.concatenate([[0], np.cumsum(after)])
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(at, end), after[at:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[at:end] - done[at], after[at:end])
            of = joined.component()
            good = (of[i] != of[j]) & (abs(band[i] - band[j]) < 2)
            # a pair belongs to the higher band's tile; pairs inside one block have a tile of their own
            good &= ((tile[i] < 0) | (np.maximum(band[i], band[j]) == tile[i])) & (~apart[i] | (own[i] != own[j]))
            i, j = i[good], j[good]
            keep = can_link(sets, i, sets, j)
            i, j = i[keep], j[keep]
            some = joined.forest(i, j)
            yield _pairs(sid[i[some]], sid[j[some]])
            at = end


def crossing(members: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all sets of different components that the bound lets pass under a shared shingle."""
    root = known.select(F.col("key").alias("sid"), "root")
    rows = members.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    several = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rows = rows.join(several.select("token"), "token").join(sets.select("sid", "bits"), "sid")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (rows.withColumn("band", band).withColumn("own", F.pmod(F.xxhash64("sid"), parts).cast("int"))
            .withColumn("tile", F.explode(F.when(parts > 1, F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(-1)))))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))))
    tiles = rows.groupBy("token", "tile", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(
        F.collect_list(F.struct("band", "own", "root", "sid", "n", "bits")).alias("sets"))
    tiles = tiles.where((F.size("sets") > 1) & F.exists("sets", lambda s: s["root"] != F.col("sets")[0]["root"]))
    return tiles.select("tile", "x", "y", "sets").mapInArrow(_tiles, _PAIR).distinct()


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, 1):
        with np.errstate(over="ignore"):
            doc, value = shingles(b.column(1))
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
        made = [value[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["sid", "values"])


def arrays_of(sides: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, values): the sorted shingles of the sets ``sides`` (sid), made again from the texts."""
    wanted = sets.select("sid", "text_key").join(sides, "sid", "left_semi")
    # copies of a text are one before it travels
    found = texts.join(wanted, "text_key").groupBy("sid").agg(F.first("text").alias("text"))
    kind = StructType([StructField("sid", LongType()), StructField("values", BinaryType())])
    return found.select("sid", "text").mapInArrow(_arrays, kind)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays of shingles link."""
    if len(y) < len(x):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table that link, by intersecting their arrays, written."""
    made = arrays_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), sets, texts)
    # where pairs meet: the sets that they connect, in blocks
    group = components(pairs)
    nodes = written(group.union(group.select(F.col("root").alias("key"), "root").distinct()), "jaccard-nodes")
    parts = nodes.groupBy("root").agg(F.ceil(F.count("*") / PLACE).cast("int").alias("parts"))
    group = written(nodes.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")), "jaccard-places")
    side = lambda s: group.select(F.col("key").alias(s), F.col("part").alias(f"p{s}"))
    placed = (pairs.join(side("a"), "a").join(side("b"), "b").join(group.select(F.col("key").alias("a"), "root"), "a")
              .select("root", F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"), "a", "b"))
    spread = (made.join(group.withColumnRenamed("key", "sid"), "sid")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "sid", "values"))

    def linked(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = {k: np.frombuffer(v.as_buffer(), np.uint64) for k, v in zip(sets["sid"].to_pylist(), sets["values"])}
        keep = [_alike(of[a], of[b]) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    where = ["root", "x", "y"]
    return written(placed.groupBy(*where).cogroup(spread.groupBy(*where)).applyInArrow(linked, _PAIR), "jaccard-links")


def _blocks_met(group: pa.Table) -> pa.Table:
    """Pairs of two blocks of a group that link and connect all components that such pairs connect."""
    group = group.combine_chunks()
    n, root, sid, part = (group[c].to_numpy().astype(np.int64) for c in ("n", "root", "sid", "part"))
    values = [np.frombuffer(v.as_buffer(), np.uint64) for v in group["values"]]
    sets, joined = Sets(n, group["bits"]), Joined(root)
    low, high = int(group["x"][0].as_py()), int(group["y"][0].as_py())
    first, second = np.flatnonzero(part == low), np.flatnonzero(part == high)
    out = []
    step = max(1, PAIRS // max(1, len(second)))
    for k in range(0, len(first), step):
        i, j = (x.ravel() for x in np.meshgrid(first[k:k + step], second, indexing="ij"))
        of = joined.component()
        good = (of[i] != of[j]) & ((low != high) | (i < j))
        i, j = i[good], j[good]
        keep = can_link(sets, i, sets, j)
        for p, q in zip(i[keep].tolist(), j[keep].tolist()):
            if joined.find(joined.at[p]) != joined.find(joined.at[q]) and _alike(values[p], values[q]):
                joined.join(p, q)
                out.append((p, q))
    p, q = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
    return pa.Table.from_batches([_pairs(sid[p], sid[q])])


def settle(pairs: DataFrame, sets: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame | None:
    """(a, b): links that connect what links within the groups of components that ``pairs`` connect, written; None without groups.

    The sets of a group are dealt into blocks of PLACE, a large component into
    blocks of its own, that need not meet each other; all other blocks meet, two
    at a time, so that no large group lands in one task.
    """
    root = lambda s: known.select(F.col("key").alias(s), F.col("root").alias(f"r{s}"))
    ends = (pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b"))
    group = components(written(ends.distinct(), "jaccard-ends"))
    group = written(group.union(group.select(F.col("root").alias("key"), "root").distinct())
                    .select(F.col("key").alias("root"), F.col("root").alias("group")), "jaccard-groups")
    if group.isEmpty():
        return None
    nodes = group.join(known, "root").select("group", "root", F.col("key").alias("sid")).union(
        group.select("group", "root", F.col("root").alias("sid")))  # known names no root as a key
    large = nodes.groupBy("group", "root").agg(F.count("*").alias("size"))
    label = F.when(F.col("size") > PLACE, F.col("root"))  # null: the small components of a group share blocks
    nodes = written(nodes.join(large.select("root", label.alias("label")), "root"), "jaccard-nodes")
    parts = nodes.groupBy("group", "label").agg(F.ceil(F.count("*") / PLACE).cast("int").alias("parts"))
    before = F.sum("parts").over(Window.partitionBy("group").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")), "jaccard-parts")
    own = F.col("before") + F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    placed = nodes.join(parts.withColumnRenamed("group", "g").withColumnRenamed("label", "l"),
                        (F.col("group") == F.col("g")) & F.col("label").eqNullSafe(F.col("l")))
    placed = placed.select("group", "root", "sid", "label", own.alias("part"))
    others = parts.select("group", F.col("label").alias("l"), F.explode(F.sequence("before", F.col("before") + F.col("parts") - 1)).alias("other"))
    meet = ~F.col("label").eqNullSafe(F.col("l")) | F.col("label").isNull()
    placed = placed.join(others, "group").where(meet).select(
        "group", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "sid", "root", "part")
    made = written(arrays_of(nodes.select("sid"), sets, texts), "jaccard-arrays")
    sides = placed.join(sets.select("sid", "n", "bits"), "sid").join(made, "sid")
    return written(sides.groupBy("group", "x", "y").applyInArrow(_blocks_met, _PAIR), "jaccard-settled")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, component_size) for every row of ``docs``."""
    texts = docs.select(F.unhex(F.md5(text_of(text_col))).alias("text_key"), text_of(text_col).alias("text"))
    levels = frequencies(texts.select("text"))
    given = docs.select(col(id_col).alias("id"), F.unhex(F.md5(text_of(text_col))).alias("text_key"), text_of(text_col).alias("_text"))
    rows = written(describe(given, levels), "jaccard-rows")
    sets = rows.where("n > 0").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "bits", "prefix", "text_key")])
    sets = written(sets.withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")

    keyed = sets.select("sid", "n", F.explode("prefix").alias("token"))
    shared = keyed.groupBy("token").agg(F.count("*").alias("size"), F.min("sid").alias("first")).where("size > 1")
    members = written(keyed.join(shared, "token"), "jaccard-members")
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"x{s}"))
    pairs = members.where("sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded, _PAIR)
    known = components(verify(written(pairs, "jaccard-pairs"), sets, texts))
    more = lambda links: components(known.select(F.col("key").alias("a"), F.col("root").alias("b")).union(links))
    pairs = written(crossing(members, sets, known), "jaccard-crossing")
    discard(members)
    if not pairs.isEmpty():
        known = more(verify(pairs, sets, texts))
        links = settle(pairs, sets, texts, known)
        known = known if links is None else more(links)

    per_set = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    root = known.select(F.col("key").alias("sid"), "root")
    per_set = (per_set.join(sets.select("key", "sid"), "key").join(root, "sid", "left")
               .withColumn("root", F.coalesce("root", "sid")))
    smallest = per_set.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("rows").alias("component_size"))
    of = per_set.select("key", "root").join(smallest, "root").select("key", "component_id", "component_size")
    alone = F.col("n") == 0
    return rows.select("id", "n", "key").join(of, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("component_size")).cast("bigint").alias("component_size"))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM words),
sets AS (SELECT g, min(doc_id) AS sid, len(g) AS n FROM grams WHERE len(g) > 0 GROUP BY g),
tokens AS (SELECT sid, n, unnest(g) AS t FROM sets),
common AS (SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.sid < b.sid
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.sid, b.sid),
links AS (SELECT a, b FROM common WHERE 100 * same >= 80 * (na + nb - same)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT sid, sid AS to_sid FROM sets UNION SELECT r.sid, e.b FROM reach r JOIN edges e ON r.to_sid = e.a),
smallest AS (SELECT sid, min(to_sid) AS component FROM reach GROUP BY sid),
copies AS (SELECT s.g, s.sid, c.component FROM sets s JOIN smallest c USING (sid)),
sizes AS (SELECT c.component, count(*) AS component_size FROM grams d JOIN copies c ON d.g = c.g GROUP BY c.component)
SELECT d.doc_id, len(d.g)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
    coalesce(z.component_size, 1)::BIGINT AS component_size
FROM grams d LEFT JOIN copies c ON d.g = c.g LEFT JOIN sizes z ON z.component = c.component
"""
