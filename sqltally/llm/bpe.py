"""Byte-level BPE encoding and decoding by a rank file.

A piece (one match of the splitting pattern) is encoded without replaying the
merges.  The bytes, mapped one to one to Latin-1 characters, go through an
Aho-Corasick automaton of all tokens, which gives the longest token at each
position.  The encoder takes the longest match; if it cannot stand next to the
token before it, it goes on to the next shorter token; if none is left, it
takes back the token before and marks the position as a dead end.  Two tokens
can stand next to each other if no merge of an earlier rank crosses their
border while they are undone step by step; the answers are memoised.  Each
position is marked once at most, so the work is linear in the piece.

Executors get the rank file's bytes as a broadcast of fixed size; a worker
builds its tables once and keeps a bounded cache of encoded chunks.

Defined results: a null or empty text has no tokens and decodes to no bytes;
repeated rows give repeated results; an empty table gives an empty result;
texts are encoded as UTF-8 whole, however long; other columns of the input stay
as they are, but for one named like an output column, which is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sqltally.llm.common import add_column, col, text_of
from sqltally.llm.tokens import bytes_of, steps

# A space with white space next to it: the chunks between spaces are then not
# independent, and the text is split as a whole.
IRREGULAR = re.compile(r"\s[ ]|[ ]\s|[ ]$")
CACHE_ENTRIES = 300_000  # chunks and pieces that a worker remembers; others are encoded again in each batch
CACHE_CHARS = 64
MEMO_ENTRIES = 300_000  # remembered answers on adjacent tokens
LETTERS_BELOW = "\u02b0"  # up to here isalpha() and the pattern's letters are the same


class Encoder:
    """Exact BPE over the tokens of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.length = [len(t) for t in self.token]
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size  # the longest other token that a token begins with
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and not self._split(t, r):
                continue  # no merges lead to it: only a whole piece can be this token
            self.automaton.add_word(t.decode("latin-1"), (r, len(t) - 1))
        for r, _ in self.automaton.values():
            t = self.token[r]
            self.shorter[r] = next((s for n in range(len(t) - 1, 0, -1)
                                    if (s := ranks.get(t[:n], -1)) >= 0 and t[:n].decode("latin-1") in self.automaton), -1)
        self.automaton.make_automaton()

    def _split(self, t: bytes, r: int) -> bool:
        """Finds the last merge of a token: its halves stand next to each other under the earlier ranks."""
        for n in range(1, len(t)):
            a, b = self.ranks.get(t[:n], r), self.ranks.get(t[n:], r)
            if a < r and b < r and self._merged(a) and self._merged(b) and self.fits(a, b):
                self.left[r], self.right[r], self.merged[a, b] = a, b, r
                self.memo.pop((a, b), None)
                return True
        return False

    def _merged(self, r: int) -> bool:
        """Whether merges lead to a token."""
        return self.length[r] == 1 or self.left[r] != r

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE can leave tokens a and b side by side."""
        known = self.memo.get((a, b))
        if known is not None:
            return known
        key, limit, merged, left, right = (a, b), 1 << 62, self.merged, self.left, self.right
        while True:
            if merged.get((a, b), limit) < limit:
                ok = False
                break
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        ok = True
                        break
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        ok = True
                        break
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[key] = ok
        return ok

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [-1] * (len(data) + 1)  # the longest token that begins at each byte
        for end, (r, before) in self.automaton.iter(data.decode("latin-1")):
            longest[end - before] = r  # matches come by their ends: the last is the longest
        known, fits, shorter, length = self.memo.get, self.fits, self.shorter, self.length
        alive, out, pos = bytearray(b"\1") * len(longest), [], 0
        last, nxt = -1, longest[0]
        while nxt >= 0:
            t = nxt
            while True:
                end = pos + length[t]
                if alive[end]:
                    ok = last < 0 or known((last, t))
                    if ok is None:
                        ok = fits(last, t)
                    if ok:
                        out.append(t)
                        last, pos, nxt = t, end, longest[end]
                        break
                t = shorter[t]
                if t < 0:  # nothing fits here
                    alive[pos] = 0
                    nxt = out.pop()
                    last = out[-1] if out else -1
                    pos -= length[nxt]
                    break
        return out


def _ranks(blob: bytes) -> dict[bytes, int]:
    """Token to rank, from lines of base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x)}


@functools.lru_cache(maxsize=2)
def encoder(blob: bytes) -> Encoder:
    return Encoder(_ranks(blob))


@functools.lru_cache(maxsize=2)
def decoder(blob: bytes) -> dict[int, bytes]:
    return {r: t for t, r in _ranks(blob).items()}


class _Memory(dict):
    """Encoded strings by string: made when first asked for, the first ones kept between batches."""

    def __init__(self, make: Callable[[str], bytes], kept: dict[str, bytes]):
        self.make, self.kept = make, kept

    def __missing__(self, s: str) -> bytes:
        v = self.kept.get(s)
        if v is None:
            v = self.make(s)
            if len(self.kept) < CACHE_ENTRIES and len(s) <= CACHE_CHARS:
                self.kept[s] = v
        self[s] = v
        return v


@functools.lru_cache(maxsize=2)
def _kept(blob: bytes, pattern: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    return {}, {}


def encode_texts(texts: list[str], blob: bytes, pattern: str) -> list[bytes]:
    """Ids of each text as 32-bit integers in the machine's byte order.

    A text without doubled white space falls into chunks at its spaces that are
    split alike alone or in the text, so that a chunk seen before is looked up.
    """
    enc, split = encoder(blob), regex.compile(pattern).findall
    kept_pieces, kept_chunks = _kept(blob, pattern)
    piece = _Memory(lambda p: array("I", enc.piece(p.encode("utf-8", "surrogatepass"))).tobytes(), kept_pieces)

    def ids(text: str) -> bytes:
        return b"".join(map(piece.__getitem__, split(text)))

    def after_space(c: str) -> bytes:
        if c.isalpha() and max(c) < LETTERS_BELOW and words_whole:
            return piece[" " + c]
        return ids(" " + c)

    words_whole = split(" a") == [" a"] and split(" ab") == [" ab"]
    chunk = _Memory(after_space, kept_chunks)
    out = []
    for t in texts:
        if IRREGULAR.search(t):
            out.append(ids(t))
        else:
            first, *rest = t.split(" ")
            out.append(ids(first) + b"".join(map(chunk.__getitem__, rest)))
    return out


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` array<int>, the tokens of each whole text.

    The text column itself is left out of the result.
    """
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def made(texts: pa.Array) -> pa.Array:
        out = encode_texts(texts.to_pylist(), ranks.value, pattern)
        ends = np.cumsum([0] + [len(x) // 4 for x in out])
        values = pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    rest = [col(c) for c in df.columns if c.lower() not in (text_col.lower(), ids_col.lower())]
    texts = df.select(*rest, text_of(text_col).alias("_encode_text"))
    out = add_column(texts, ids_col, ArrayType(IntegerType()), made, "_encode_text")
    return out.drop("_encode_text")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` binary, the bytes that the ids stand for."""
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def made(ids: pa.Array) -> pa.Array:
        flat = tokens_of(ranks.value).take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64))])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), flat), pa.scalar(b"", pa.large_binary())).cast(pa.binary())

    return add_column(df, bytes_col, BinaryType(), made, ids_col)


@functools.lru_cache(maxsize=2)
def tokens_of(blob: bytes) -> pa.Array:
    """The bytes of each token, by rank."""
    tokens = [b""] * (1 + max(decoder(blob), default=-1))
    for r, t in decoder(blob).items():
        tokens[r] = t
    return pa.array(tokens, pa.large_binary())


@functools.lru_cache(maxsize=2)
def _decimals(size: int) -> pa.Array:
    return pa.array([str(i) for i in range(size)], pa.large_string())


def query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, in the pass that encodes."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", text_of("text").alias("_text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(ranks.value)
        length = pc.binary_length(tokens).to_numpy()
        for b in steps(batches, 1):
            encoded = encode_texts(b.column(1).to_pylist(), ranks.value, pattern)
            n = np.array([len(x) // 4 for x in encoded], np.int64)
            ids, ends = np.frombuffer(b"".join(encoded), np.int32), np.concatenate([[0], np.cumsum(n)])
            at = pa.array(ids)
            lists = pa.LargeListArray.from_arrays(pa.array(ends), _decimals(len(tokens)).take(at))
            texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, pa.scalar(" ", pa.large_string()))]
            data = memoryview(bytes_of(tokens.take(at))[1])
            places = np.concatenate([[0], np.cumsum(length[ids])])[ends].tolist()
            decoded = [hashlib.sha256(data[p:q]).hexdigest() for p, q in zip(places[:-1], places[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(texts, pa.string()), pa.array(decoded, pa.string())], names=names)

    kinds = [LongType(), StringType(), StringType()]
    return rows.mapInArrow(run, StructType([rows.schema.fields[0], *[StructField(c, k) for c, k in zip(names[1:], kinds)]]))
