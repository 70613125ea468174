r"""Secret scan with corpus-wide ownership frequency.

1. Every whole text is searched for three base kinds of secrets (``assign``,
   ``access``, ``hex``) and for bare credential-like tokens: runs of 20 or more
   credential characters that look random: letters of both cases with digits,
   or letters of one case in which letters and digits alternate.
2. The hashes of all candidates are counted over the corpus by distinct owners
   (``owner_col``) and distinct repositories (``repo_col``).  A candidate that
   many owners show is a copied example; one that a single owner shows is
   owner-specific and looks live.
3. Base spans always stay, each with its class.  Bare tokens are added as spans
   of kind ``owned`` where a single owner shows them.  For bare tokens copies of
   one text count once, for the smallest of their owners, so that copying a text
   does not make its token a shared one.  ``redact`` also replaces the bare
   tokens that are shared.

Only hashes and positions leave the scan; the found rows are written once to
the shared scratch folder and both the counting and the marking read them.
Counting aggregates by (hash, owner, repository), then (hash, owner), then
hash, each with map-side partial sums, so a token that a third of all rows
share puts no large group in one task.

Defined results: a null or empty text has no spans (``base_sha256`` is then the
digest of the empty string); a null owner or repository counts as one owner or
repository; repeated rows give repeated results and count once per repository;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sqltally.llm.common import add_column, col, text_of, written

# The patterns of the base kinds, in their order.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs: the same as a run of any length, kept from 20 characters on
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_=-]{20,}"

FOUND = ArrayType(StructType([StructField("start", LongType()), StructField("kind", IntegerType()),
                              StructField("end", LongType()), StructField("hash", StringType()),
                              StructField("length", LongType())]))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _looks_random(s: str) -> bool:
    digit, upper, lower = any(c.isdigit() for c in s), any(c.isupper() for c in s), any(c.islower() for c in s)
    if digit and upper and lower:
        return _entropy(s) >= 3.5
    if not digit or not (upper or lower):
        return False
    # one case: words joined with a year or a number are common, letters and digits in turns are not
    return any(len(p) >= 20 and _turns(p) >= 3 and _entropy(p) >= 3.5 for p in re.split("[+/_=-]+", s))


def _turns(s: str) -> int:
    """How often a letter follows a digit or a digit a letter."""
    return sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))


def find(text: str, assign=re.compile(ASSIGN, re.I | re.A), access=re.compile(ACCESS), hexa=re.compile(HEX),
         bare=re.compile(BARE)) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of all candidates in one text, by start, then kind.

    A secret is the end of its span.
    """
    out = [(m.start(), 0, m.end(), m.group(2)) for m in assign.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end(), m.group()) for m in access.finditer(text)]
    out += [(m.start(), 2, m.end(), m.group()) for m in hexa.finditer(text)]
    taken, i = sorted((a, b) for a, _, b, _ in out), 0
    reach = 0  # end of the base spans that began before the token's end
    for m in bare.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= m.start() and _looks_random(m.group()):
            out.append((m.start(), 3, m.end(), m.group()))
    return sorted(out)


def _scan(texts: pa.Array) -> pa.Array:
    digest = lambda v: hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()
    return pa.array([[{"start": s, "kind": k, "end": e, "hash": digest(v), "length": len(v)} for s, k, e, v in find(t)]
                     for t in texts.to_pylist()], to_arrow_type(FOUND))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(_row, id, owner, repo, text digest, found) per row, written to the scratch folder."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), col(id_col).alias("_id"),
        col(owner_col).cast("string").alias("_owner"), col(repo_col).cast("string").alias("_repo"),
        F.sha2(text_of(text_col), 256).alias("_content"), text_of(text_col).alias("_text"))
    return written(add_column(rows, "found", FOUND, _scan, "_text").drop("_text"), "secret-candidates")


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos): how far each candidate is spread over the corpus."""
    seen = cands.select("_owner", "_repo", F.explode("found.hash").alias("hash"))
    by_repo = seen.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "_owner").agg(F.sum("one").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def text_owners(cands: DataFrame) -> DataFrame:
    """(hash, n_text_owners): distinct owners of the different texts that hold each bare token."""
    seen = cands.select("_content", F.coalesce("_owner", F.lit("\u0000")).alias("owner"), F.explode("found").alias("f"))
    by_text = seen.where("f.kind = 3").groupBy(F.col("f.hash").alias("hash"), "_content").agg(F.min("owner").alias("owner"))
    by_owner = by_text.groupBy("hash", "owner").agg(F.lit(1).alias("one"))
    return by_owner.groupBy("hash").agg(F.sum("one").alias("n_text_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", example_owners: int = 5, bare: tuple[str, ...] = ("live",)) -> DataFrame:
    """One row per row of ``docs``: (id, spans).

    ``spans`` is array<struct<start, kind, end, hash, length, n_owners, n_repos, cls>>
    by start, then kind (``length``: of the secret at the span's end); ``cls`` is ``live`` (one owner), ``example``
    (``example_owners`` or more) or ``shared``.  Bare tokens are
    judged by the owners of different texts and kept where their class is one of ``bare``.
    """
    cands = candidates(docs, id_col, text_col, owner_col, repo_col)
    spread = ownership(cands).join(text_owners(cands), "hash", "left")
    owners = F.when(F.col("kind") == 3, F.col("n_text_owners")).otherwise(F.col("n_owners"))
    cls = F.when(owners == 1, "live").when(owners >= example_owners, "example").otherwise("shared")
    marked = (cands.select("_row", F.explode("found").alias("f")).select("_row", "f.*").join(spread, "hash")
              .withColumn("cls", cls).where((F.col("kind") < 3) | F.col("cls").isin(*bare))
              .groupBy("_row").agg(F.array_sort(F.collect_list(
                  F.struct("start", "kind", "end", "hash", "length", "n_owners", "n_repos", "cls"))).alias("spans")))
    empty = F.array().cast(marked.schema["spans"].dataType)
    return (cands.select("_row", F.col("_id").alias(id_col)).join(marked, "_row", "left")
            .select(col(id_col), F.coalesce("spans", empty).alias("spans")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           repo_col: str = "doc_id", example_owners: int = 5) -> DataFrame:
    """``docs`` with each secret in its texts replaced by ``[example]`` (copied by many owners) or ``[secret]``.

    Every row stays; a null text stays null.  What a text holds and how far it
    is spread depend on the text alone, so rows meet their spans by its digest.
    """
    digest = F.sha2(text_of(text_col), 256).alias("_digest")
    keyed = docs.select("*", digest)
    spans = (scan(keyed, "_digest", text_col, owner_col, repo_col, example_owners, ("live", "shared")).where(F.size("spans") > 0)
             .dropDuplicates(["_digest"]))
    rows = keyed.join(spans.select("_digest", F.col("spans").alias("_spans")), "_digest", "left")
    rows = rows.withColumn("_work", F.struct(text_of(text_col).alias("text"), "_spans"))
    out = add_column(rows.drop("_digest", "_spans"), "_redacted", StringType(), _redacted, "_work")
    return out.select(*[F.when(col(c).isNotNull(), F.col("_redacted")).alias(c) if c == text_col else col(c)
                        for c in docs.columns])


def _redacted(work: pa.Array) -> pa.Array:
    out = []
    for w in work.to_pylist():
        text, done, parts = w["text"], 0, []
        for s in w["_spans"] or ():
            start = s["end"] - s["length"]
            if start >= done:
                parts += [text[done:start], "[example]" if s["cls"] == "example" else "[secret]"]
                done = s["end"]
        out.append("".join([*parts, text[done:]]))
    return pa.array(out, pa.string())


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    s = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    of = lambda c: F.size(F.filter("spans", lambda x: x["cls"] == c)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                    of("live").alias("n_live"), of("example").alias("n_example"))


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form: secrets replaced, ``n_chars`` counted anew where it is there."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out
