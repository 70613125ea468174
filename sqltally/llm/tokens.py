"""Words of whole Arrow columns of texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

STEP_BYTES = 4 << 20  # text handled at once; a longer text makes a step of its own
_SHIFT, _MIX = np.uint64(29), np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Words(NamedTuple):
    """The words of several texts in order, as positions in a list of different words."""

    ids: np.ndarray  # of each word, its place in ``names``
    names: pa.Array  # the different words, as bytes
    doc: np.ndarray  # of each word, the text it stands in
    joined: np.ndarray  # whether the next word follows in the same piece of the same text


def classes(space: bytes, ends: bytes = b"") -> np.ndarray:
    """For each byte: 0 in a word, 1 between words, 2 also the end of a piece."""
    out = np.zeros(256, np.uint8)
    out[list(space)] = 1
    out[list(ends)] = 2
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data): the bytes of all values and, from 0 on, where each ends; a slice gives its own values only."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return ends.astype(np.int64) - int(ends[0]), data


def words_of(texts: pa.Array, kinds: np.ndarray) -> Words:
    """The words of UTF-8 texts without nulls; A-Z count as a-z."""
    ends, data = bytes_of(texts)
    data = _LOWER[data]
    kind = kinds[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.zeros(len(data) + 1, bool)  # places where a text begins
    edge[ends] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    stops = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                   [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])]).dictionary_encode()
    doc = np.searchsorted(ends, starts, "right") - 1
    broken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 2, out=broken[1:])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (doc[:-1] == doc[1:]) & (broken[stops[:-1]] == broken[starts[1:]])
    return Words(values.indices.to_numpy(), values.dictionary, doc, joined)


def hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def steps(batches: Iterator[pa.RecordBatch], column: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of up to ``most`` bytes of text, one row at least."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(at, end - at)
            at = end
