"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A text's tokens under A and under B both cut the same bytes (a space and the
text).  The token ends of both are two sorted lists; merging them gives all
overlaps of an A token with a B token (one for each different end) and, where
both end at once, the cuts between groups.  The merge path is cut where its
diagonals, a fixed number of steps apart, cross it, which a binary search finds
for each diagonal alone.  So the pieces are equal work and independent: each
emits its overlaps, whatever the texts' lengths, as texts follow each other in
one list.  A pair of equal ends that falls on two pieces belongs to the first.

The corpus-wide count of an (A id, B id) pair says how many links hold it.
Texts are handled in blocks; a block numbers its different pairs, its texts hold
pair numbers, and the counts come back block by block, each pair once.

Defined results: a null or empty text, or one whose tokens do not spell a space
and the text (such as one holding U+2581), has no tokens, groups or links; special
tokens' strings are plain text; repeated rows count each; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)
from tokenizers import Tokenizer

from sqltally.llm.common import col, text_of, written
from sqltally.llm.tokens import bytes_of, steps

WORK = 1 << 16  # ends of both sides that a piece of the merge path holds
BLOCK_PAIRS = 2_000_000  # a block ends when it holds so many different pairs,
BLOCK_BYTES = 32 << 20  # or so much text
# How byte-level BPE splits a text (fixed, as in the tokenizer files).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Ids = tuple[np.ndarray, np.ndarray]  # the ids of several texts, and how many each has


class Side(NamedTuple):
    """One tokenizer: the ids of texts, each with a space before it, and its tokens' bytes."""

    encode: Callable[[list[str]], Ids]
    tokens: pa.Array
    lengths: np.ndarray


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(parts: list[bytes]) -> Ids:
    return (np.frombuffer(b"".join(parts), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in parts], np.int64))


def _side(encode: Callable[[list[str]], Ids], tokens: list[bytes]) -> Side:
    return Side(encode, pa.array(tokens, pa.large_binary()), np.array([len(x) for x in tokens], np.int64))


def byte_tokens(vocabulary: dict[str, int], special: set[int]) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary; of special ones their text."""
    of, tokens = byte_characters(), [b""] * (1 + max(vocabulary.values()))
    for s, i in vocabulary.items():
        tokens[i] = s.encode() if i in special else bytes(of[c] for c in s)
    return tokens


def by_ranks(blob: str) -> tuple[tiktoken.Encoding | None, tuple[str, ...]]:
    """The same encoding by ranks, and the strings of the special tokens.

    Where a byte-level BPE's ids are in the order of its merges, ranks say the same
    as merges do; for another tokenizer there is none.
    """
    given = json.loads(blob)
    vocabulary = Tokenizer.from_str(blob).get_vocab()
    special = {x["id"]: x["content"] for x in given.get("added_tokens", [])}
    splits = {k: v for k, v in (given.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}
    if splits != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
        return None, tuple(special.values())
    tokens = byte_tokens(vocabulary, set(special))
    merges = [x.split(" ") if isinstance(x, str) else x for x in given["model"]["merges"]]
    made = [vocabulary[x + y] for x, y in merges]
    ranks = {tokens[i]: i for i in vocabulary.values() if i not in special}
    simple = (made == sorted(set(made)) and len(ranks) == len(made) + 256 and not given.get("normalizer")
              and not given["model"].get("ignore_merges"))
    return (tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if simple else None,
            tuple(special.values()))


@functools.lru_cache(maxsize=2)
def byte_level(blob: str) -> Side:
    """A, from the JSON of a byte-level BPE tokenizer."""
    t, ranks = Tokenizer.from_str(blob), by_ranks(blob)[0]
    t.encode_special_tokens = True  # their strings in a text are ordinary text

    def one(text: str) -> bytes:
        return np.array(t.encode(" " + text, add_special_tokens=False).ids, np.uint32).tobytes() if text else b""

    def encode(texts: list[str]) -> Ids:
        if ranks is None:
            return _joined([one(x) for x in texts])
        return _joined([ranks.encode_to_numpy(" " + x, disallowed_special=()).tobytes() if x else b"" for x in texts])

    return _side(encode, byte_tokens(t.get_vocab(), {x["id"] for x in json.loads(blob).get("added_tokens", [])}))


@functools.lru_cache(maxsize=2)
def pieces_of(blob: bytes) -> Side:
    """B, from a sentencepiece model, which puts a space before a text itself."""
    m = sentencepiece.SentencePieceProcessor(model_proto=blob)
    names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    tokens = [bytes([int(s[3:5], 16)]) if m.is_byte(i) else s.replace("\u2581", " ").encode() for i, s in enumerate(names)]
    return _side(lambda texts: _joined([np.array(x, np.uint32).tobytes() for x in m.encode(texts, num_threads=1)]), tokens)


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the points at which the diagonals cross the merge path of two sorted lists, equal values of ``a`` first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2  # taking more of a is right while a[i] <= b[diagonal - i - 1]
        k = np.flatnonzero(open_)
        more = a[i[k]] <= b[diagonal[k] - i[k] - 1]
        low[k[more]] = i[k[more]] + 1
        high[k[~more]] = i[k[~more]]
    return low, diagonal - low


class Overlaps(NamedTuple):
    a: np.ndarray  # A token of each link, by its number
    b: np.ndarray
    cut_a: np.ndarray  # last A token of each group
    cut_b: np.ndarray


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Overlaps:
    """Links and groups of two lists of token ends (above zero, ending alike)."""
    i, j = merge_path(a, b, work)
    links, cuts = [], []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        mine, other = a[i0:i1], b[j0:j1]
        at = np.arange(i0, i1)
        over = j0 + np.searchsorted(other, mine)  # the first B end at or after each A end; it may begin the next piece
        links.append((at, over))
        equal = b[over] == mine
        cuts.append((at[equal], over[equal]))
        over = i0 + np.searchsorted(mine, other)
        # an equal A end has made the link already, here or as the last end of the piece before
        single = (a[np.minimum(over, len(a) - 1)] != other) & ((a[i0 - 1] != other) if i0 else True)
        links.append((over[single], np.arange(j0, j1)[single]))
    join = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    return Overlaps(join(links, 0), join(links, 1), join(cuts, 0), join(cuts, 1))


class Aligned(NamedTuple):
    """Tokens of several texts and how they overlap."""

    a: np.ndarray  # ids
    b: np.ndarray
    doc_a: np.ndarray  # the text of each token
    doc_b: np.ndarray
    links: Overlaps


def _spelt(side: Side, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which of the texts their tokens spell."""
    ends = np.concatenate([[0], np.cumsum(side.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    good = np.diff(ends) == np.array([len(t) for t in texts], np.int64)
    made, whole = bytes_of(side.tokens.take(pa.array(ids)))[1], np.frombuffer(b"".join(texts), np.uint8)
    if good.all() and np.array_equal(made, whole):
        return good
    return np.array([bool(g) and made[ends[k]:ends[k + 1]].tobytes() == t for k, (g, t) in enumerate(zip(good, texts))], bool)


def align_texts(texts: list[str], a: Side, b: Side) -> Aligned:
    ids, counts, whole = [], [], [(" " + t).encode() if t else b"" for t in texts]
    good = np.array([bool(t) for t in texts], bool)
    for side in (a, b):
        x, n = side.encode(texts)
        good &= _spelt(side, x, n, whole)
        ids.append(x)
        counts.append(n)
    docs = [np.repeat(np.arange(len(texts)), n) for n in counts]
    ids, docs = [x[good[d]] for x, d in zip(ids, docs)], [d[good[d]] for d in docs]
    return Aligned(*ids, *docs, overlaps(*[np.cumsum(s.lengths[x]) for s, x in zip((a, b), ids)]))


@functools.lru_cache(maxsize=2)
def _numbers(na: int, nb: int) -> pa.Array:
    """Ids as text with what follows them: in a group, at the A tokens' end, at a group's end, at a text's end."""
    return pa.array([f"{i}{x}" for i in range(na) for x in ",|"] + [f"{i}{x}" for i in range(nb) for x in (",", ";", "")],
                    pa.large_string())


def group_texts(x: Aligned, texts: int, a: Side, b: Side) -> pa.Array:
    """For each text ``a1,a2|b1;a3|b2,b3``: the ids of each group, A's and then B's."""
    cut_a, cut_b = x.links.cut_a, x.links.cut_b
    at_a, at_b = np.arange(len(x.a)), np.arange(len(x.b))
    of_a, of_b = np.searchsorted(cut_a, at_a), np.searchsorted(cut_b, at_b)  # the group of each token
    before = np.concatenate([[0], cut_b + 1])
    out = np.empty(len(x.a) + len(x.b), np.int64)
    out[at_a + before[of_a]] = 2 * x.a + (at_a == cut_a[of_a])
    last = np.ones(len(x.b), bool)
    last[:-1] = x.doc_b[1:] != x.doc_b[:-1]
    out[at_b + cut_a[of_b] + 1] = 2 * len(a.lengths) + 3 * x.b + (at_b == cut_b[of_b]) + last
    sizes = np.bincount(x.doc_a, minlength=texts) + np.bincount(x.doc_b, minlength=texts)
    parts = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])),
                                          _numbers(len(a.lengths), len(b.lengths)).take(pa.array(out)))
    return pc.binary_join(parts, pa.scalar("", pa.large_string()))


class _Numbering:
    """Numbers the different pairs of a block in the order of their first steps, and counts them."""

    def __init__(self):
        self.pairs, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted by pair
        self.count = np.zeros(0, np.int64)  # by number

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        different, which, n = np.unique(pairs, return_inverse=True, return_counts=True)
        new = np.setdiff1d(different, self.pairs, assume_unique=True)
        if len(new):
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every, kind="stable")
            self.number = np.concatenate([self.number, len(self.number) + np.arange(len(new))])[order]
            self.pairs = every[order]
            self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)])
        number = self.number[np.searchsorted(self.pairs, different)]
        self.count[number] += n
        return number[which]


def _inputs(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> tuple:
    """The rows (id, text), and a function that gives both sides on an executor."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(col(id_col).alias("id"), text_of(text_col).alias("_text"))
    return rows, lambda: (byte_level(shared.value[0]), pieces_of(shared.value[1]))


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): the aligned groups of ids of each document, as text."""
    rows, sides = _inputs(docs, a_path, b_path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides()
        for part in steps(batches, 1):
            made = group_texts(align_texts(part.column(1).to_pylist(), a, b), part.num_rows, a, b)
            yield pa.RecordBatch.from_arrays([part.column(0), made.cast(pa.string())], names=["id", "groups"])

    return rows.mapInArrow(run, StructType([rows.schema.fields[0], StructField("groups", StringType())])).withColumnRenamed("id", id_col)


_COUNTS = [StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
_PACK = "zstd"


def _documents(rows: DataFrame, sides: Callable) -> DataFrame:
    """A row for each document (its pair numbers packed in ``links``) and one for each block (``pairs`` and their ``counts``), written."""
    fields = [StructField("block", LongType()), rows.schema.fields[0], *_COUNTS, StructField("groups_sha256", StringType()),
              StructField("links", BinaryType()), StructField("pairs", BinaryType()), StructField("counts", BinaryType())]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides()
        names = [f.name for f in fields]
        block, seen, read, id_kind = TaskContext.get().partitionId() << 32, _Numbering(), 0, None

        def ended() -> pa.RecordBatch:
            order = np.argsort(seen.number)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, id_kind), *[pa.nulls(1, k) for k in kinds[:6]],
                 pa.array([seen.pairs[order].tobytes()], pa.binary()), pa.array([seen.count.tobytes()], pa.binary())], names=names)

        for part in steps(batches, 1):
            texts, n, id_kind = part.column(1).to_pylist(), part.num_rows, part.column(0).type
            x = align_texts(texts, a, b)
            doc = x.doc_a[x.links.a]
            order = np.argsort(doc, kind="stable")
            number = seen(x.a[x.links.a] << 32 | x.b[x.links.b])[order].astype("<u4")
            per_doc = [np.bincount(d, minlength=n) for d in (x.doc_a, x.doc_b, x.doc_a[x.links.cut_a], doc)]
            ends = np.concatenate([[0], np.cumsum(per_doc[3])])
            links = [pa.compress(number[p:q].tobytes(), codec=_PACK, asbytes=True) for p, q in zip(ends[:-1], ends[1:])]
            digests = [hashlib.sha256(g.as_buffer()).hexdigest() if k else ""
                       for g, k in zip(group_texts(x, n, a, b), per_doc[0], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), part.column(0), *[pa.array(c.astype(np.int64)) for c in per_doc],
                 pa.array(digests, pa.string()), pa.array(links, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
            read += part.column(1).nbytes
            if read >= BLOCK_BYTES or len(seen.pairs) >= BLOCK_PAIRS:
                yield ended()
                block, seen, read = block + 1, _Numbering(), 0
        if id_kind is not None:
            yield ended()

    return written(rows.mapInArrow(run, StructType(fields)), "alignment")


def pair_rows(made: DataFrame) -> DataFrame:
    """(block, number, pair, n): the different pairs of each block; a pair is A id << 32 | B id."""
    fields = [StructField(c, LongType()) for c in ("block", "number", "pair", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, n in zip(*[b.column(k) for k in range(3)], strict=True):
                pairs, n = (np.frombuffer(x.as_buffer(), np.int64) for x in (pairs, n))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(n), block.as_py()), np.arange(len(n)), pairs, n)],
                                                 names=[f.name for f in fields])

    return made.where(F.col("pairs").isNotNull()).select("block", "pairs", "counts").mapInArrow(run, StructType(fields))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): the links of each pair in the corpus, and whether no pair of its B id has more, written."""
    counts = written(rows.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.select("pair", "count", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    made = _documents(*_inputs(docs, a_path, b_path, id_col, text_col))
    rows = pair_rows(made)
    # a pair's rows of all blocks meet its count, each block's pairs once
    nothing = [F.lit(None).cast(t) for t in ("bigint", "boolean")]
    both = rows.select("block", "number", "pair", nothing[0].alias("count"), nothing[1].alias("best")).unionByName(
        pair_counts(rows).select(nothing[0].alias("block"), nothing[0].alias("number"), "pair", "count", "best"))
    pair = Window.partitionBy("pair")
    found = both.select("block", "number", F.max("count").over(pair).alias("count"), F.max("best").over(pair).alias("best"))
    found = found.where(F.col("block").isNotNull())
    own = made.where(F.col("pairs").isNull()).drop("pairs", "counts")
    out = StructType([own.schema["id"], *_COUNTS, StructField("n_best", LongType()), StructField("count_sum", LongType()),
                      StructField("groups_sha256", StringType())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["number"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        size = left["n_links"].to_numpy()
        sums = []
        for x, n in zip(left["links"], size, strict=True):
            k = np.frombuffer(pa.decompress(x.as_buffer(), 4 * int(n), codec=_PACK, asbytes=True), "<u4") if n else np.zeros(0, np.uint32)
            sums.append((int(best[k].sum()), int(count[k].sum())))
        return pa.table([left[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
                        + [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)] + [left["groups_sha256"]], names=out.names)

    joined = own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(add, out)
    return joined.withColumnRenamed("id", id_col)


def query(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return align(docs, a_path, b_path)
