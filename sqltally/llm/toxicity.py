"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (``<word>`` cut
into 3 to 6 characters, and whole), hashed to a fixed number of buckets; a text
is the mean of its words; a linear softmax over the two classes reads it.
Embeddings and softmax are trained jointly in numpy, so that a misspelling
never seen still shares n-gram vectors with the words it comes from.

Training uses a bounded sample of labelled rows (``max_rows``, the first by a
hash of the id, among rows outside the held-out fold); executors reduce each of
them to its distinct words and counts, over the whole text.  After training the
softmax difference is folded into one weight for each bucket, and executors
score every whole text with these (a broadcast of fixed size).

Defined results: a null or empty text, or one without words, gets the score of
the bias alone; a null label is no label, and of several labels of an id the
highest counts; with no labels, or labels of one class only, every score is the
smoothed share of label 1; a null id counts as held out; repeated rows give
repeated results; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sqltally.llm.common import add_column, col, text_of

BUCKETS, DIM, LOW_N, HIGH_N = 1 << 20, 8, 3, 6
MAX_ROWS = 8_000
CACHE_WORDS = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def grams(some: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): the n-grams of the words in ``<word>`` form and the words whole, as positions and buckets.

    Polynomial hashes of code points, all words at once.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in some], np.int64)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(some)), size)
    left = ends[row] - np.arange(len(codes))  # characters from here to the end of the word
    powers = np.cumprod(np.full(int(size.max(initial=1)), _PRIME))
    whole = np.add.reduceat(codes * powers[size[row] - left], ends - size) if len(some) else codes
    rows, found = [np.arange(len(some))], [whole]
    for n in range(LOW_N, HIGH_N + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _PRIME + codes[at + k]
        rows.append(row[at])
        found.append(h)
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(31))) * _PRIME
    return np.concatenate(rows), ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket: log odds of label 1 that an n-gram adds
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells models apart in the workers' caches

    def of_words(self, some: list[str]) -> np.ndarray:
        """The log odds that each word adds: the mean over its n-grams."""
        row, bucket = grams(some)
        return np.bincount(row, self.weights[bucket], len(some)) / np.maximum(1, np.bincount(row, minlength=len(some)))


@functools.lru_cache(maxsize=1)
def _known(name: str) -> dict[str, float]:
    return {}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts = [Counter(words(t)) for t in b.pop("_text")]
        b["words"] = [" ".join(c) for c in counts]
        b["counts"] = [np.array(list(c.values()), np.int32).tobytes() for c in counts]
        yield b


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", max_rows: int = MAX_ROWS) -> pd.DataFrame:
    """The training rows: (label, words, counts), ``max_rows`` ids at most."""
    ids = (labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_label"))
           .where(F.col("_label").isNotNull() & F.col("_id").isNotNull())
           .where(~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    texts = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = texts.join(F.broadcast(ids), "_id").select("_id", "_label", "_text").dropDuplicates(["_id"])
    kind = dict(rows.dtypes)["_id"]
    bags = rows.mapInPandas(_bags, f"_id {kind}, _label int, words string, counts binary")
    return bags.toPandas().sort_values("_id", ignore_index=True)


def _shares(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: buckets and how much of the text's mean each makes up."""
    for ws, cs in zip(rows["words"], rows["counts"], strict=True):
        count, some = np.frombuffer(cs, np.int32), ws.split(" ") if ws else []
        row, bucket = grams(some)
        size = np.bincount(row, minlength=len(some))
        g, at = np.unique(bucket.astype(np.int32), return_inverse=True)
        yield g, np.bincount(at, (count / np.maximum(1, size * count.sum()))[row], len(g)).astype(np.float32)


def _features(rows: pd.DataFrame, y: np.ndarray, min_docs: int, min_z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, ends, places, shares): the trained buckets and, text after text, which of them it has and its shares.

    The mean of the words' means is linear in the embeddings, so that a text's
    n-grams can be summed up once, before training.  Only buckets that
    ``min_docs`` texts have and whose share of the texts differs between the
    classes by ``min_z`` standard errors are trained; the others would only
    learn single texts by heart, and their embeddings stay zero.  The texts are
    gone through twice, as the buckets of all of them take much memory.
    """
    df = np.zeros((2, BUCKETS), np.int32)
    for (g, _), label in zip(_shares(rows), y, strict=True):
        df[label, g] += 1
    n = np.bincount(y, minlength=2)
    share = df.sum(0) / n.sum()
    error = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-9
    told = (df.sum(0) >= min_docs) & (abs(df[1] / n[1] - df[0] / n[0]) >= min_z * error)
    buckets = np.union1d(0, np.flatnonzero(told))  # bucket 0 keeps a text without such buckets
    kept = [(np.append(g[k], np.int32(0)), np.append(x[k], np.float32(0))) for g, x in _shares(rows) for k in [told[g]]]
    ends = np.cumsum([0] + [len(g) for g, _ in kept])
    places = np.searchsorted(buckets, np.concatenate([g for g, _ in kept])).astype(np.int32)
    return buckets, ends, places, np.concatenate([x for _, x in kept])


def train(rows: pd.DataFrame, epochs: int = 15, batch: int = 32, rate: float = 2.0, seed: int = 7,
          min_docs: int = 5, min_z: float = 5.0) -> Model:
    """Fits embeddings and softmax jointly (AdaGrad on the cross entropy)."""
    y = (rows["_label"].to_numpy(np.int64) > 0).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 2))  # without labels a text counts as clean
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    buckets, ends, places, shares = _features(rows, y, min_docs, min_z)
    rnd = np.random.default_rng(seed)
    emb = np.zeros((len(buckets), DIM), np.float32)  # an n-gram that training never saw adds nothing
    soft, bias = rnd.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.array([-prior / 2, prior / 2], np.float32)
    emb_sum, soft_sum, bias_sum = (np.full_like(x, 1e-10) for x in (emb, soft, bias))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in np.array_split(rnd.permutation(len(y)), max(1, len(y) // batch)):
            size = ends[some + 1] - ends[some]
            g, x = (np.concatenate([v[ends[i]:ends[i + 1]] for i in some]) for v in (places, shares))
            doc = np.add.reduceat(emb[g] * x[:, None], np.concatenate([[0], np.cumsum(size)[:-1]]))
            z = doc @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            hit, at = np.unique(g, return_inverse=True)
            d_gram = np.repeat(p @ soft.T, size, 0) * x[:, None]
            d_emb = np.stack([np.bincount(at, d_gram[:, k], len(hit)) for k in range(DIM)], 1).astype(np.float32)
            emb_sum[hit] += d_emb * d_emb
            emb[hit] -= step * d_emb / np.sqrt(emb_sum[hit])
            for v, total, d in ((soft, soft_sum, doc.T @ p), (bias, bias_sum, p.sum(0))):
                total += d * d
                v -= step * d / np.sqrt(total)
    every = np.zeros((BUCKETS, DIM), np.float32)
    every[buckets] = emb
    return Model((every @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(texts: pa.Array) -> pa.Array:
        model = shared.value
        known, bags = _known(model.name), [words(t) for t in texts.to_pylist()]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set().union(*bags).difference(known))
        known.update(zip(new, model.of_words(new).tolist(), strict=True))
        z = [model.bias + (sum(map(known.__getitem__, b)) / len(b) if b else 0.0) for b in bags]
        return pa.array([1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in z], pa.float64())

    rows = docs.withColumn("_score_text", text_of(text_col))
    return add_column(rows, score_col, DoubleType(), made, "_score_text").drop("_score_text")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return train(sample(docs, labels, **options))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    return (score(docs, fit(docs, labels), score_col="_toxicity").where(F.col("_toxicity") < 0.5)
            .select(*[col(c) for c in docs.columns]))
