"""Document fingerprints by SpotSigs, with built-in functions only.

A text is cut into lower-case words.  Each common word (of ``ANCHORS``) is an
anchor; with the chain of the ``CHAIN`` content words that follow it, other
anchors skipped, it forms a spot signature.  A text's distinct signatures make
its fingerprint: their number and the digest of the sorted set.

Fingerprints are compared by the Jaccard similarity of their sets.  Sets are
partitioned by length so that two sets which can reach a given similarity lie
in equal or neighbouring partitions; ``likeness`` skips the intersection of
pairs that their partitions rule out.

``edited`` pairs each document with the next one by descending id.  Ids are cut
into buckets at their quantiles, as many as a few for each shuffle partition;
inside a bucket a window finds the next row, and the first row of each bucket is
handed to the bucket before it.  Texts move once.

Defined results: a null text is the empty text; a text without a full chain has
one signature, its words; so no set is empty, and equal texts have equal
fingerprints.  Null ids come last; rows with equal ids follow one another by
text hash, and equal rows are each other's next; the last row's next is the
first, which for a single row is itself; an empty table gives an empty result;
other columns are not looked at.  Ids are numbers or null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.llm.common import col, text_of

# Common words of four languages, the anchors of spot signatures.
ANCHORS = (
    "a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this "
    "to was were which will with "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour que qui sa "
    "se son sur un une vous "
    "als am auch auf aus bei das dass dem den der die durch ein eine einen er es für hat ich im ist mit nach nicht noch "
    "sich sie sind und von vor wie wir zu zum zur "
    "al como con del el ella era eran esta este fue hay las lo los más no nos para pero por sin sobre su sus también y ya"
)
CHAIN = 2
RUNS = 3  # a chain's words may stand before the next anchors, up to so many runs of content words
LENGTH_STEP = 0.8  # sets of neighbouring partitions may be as alike as this
NOT_WORD = r"[^\p{L}\p{N}]+"


def _anchor_pattern() -> str:
    return " (" + "|".join(sorted(set(ANCHORS.split()))) + ") "


def add_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out`` array<string>: the distinct spot signatures of column ``text``, sorted.

    One step a column: what a lambda refers to is then computed once a row.
    """
    df = df.withColumn("_plain", F.trim(F.regexp_replace(F.lower(col(text)), NOT_WORD, " ")))
    # each word gets a space of its own on both sides, so that anchors never share one
    spaced = F.concat(F.lit(" "), F.replace("_plain", F.lit(" "), F.lit("  ")), F.lit(" "))
    df = df.withColumn("_parts", F.split(F.regexp_replace(spaced, _anchor_pattern(), "\u0001$1 "), "\u0001"))
    df = df.withColumn("_parts", F.transform("_parts", lambda p: F.replace(p, F.lit("  "), F.lit(" "))))
    df = df.withColumn("_runs", F.transform("_parts", lambda p: F.substring(p, F.instr(p, " ") + 1, F.length(p))))

    def chain(part: Column, i: Column) -> Column:
        after = F.concat(*[F.coalesce(F.get("_runs", i + k), F.lit("")) for k in range(RUNS)])
        return F.struct((i > 0).alias("anchored"), F.substring_index(part, " ", 1).alias("anchor"), after.alias("after"))

    # a run's words end with one space each, so that spaces count words
    df = df.withColumn("_chains", F.filter(F.transform("_parts", chain), lambda c: c["anchored"] & (
        F.length(c["after"]) - F.length(F.replace(c["after"], F.lit(" "), F.lit(""))) >= CHAIN)))
    df = df.withColumn(out, F.array_sort(F.array_distinct(
        F.when(F.size("_chains") > 0, F.transform("_chains", lambda c: F.concat(
            c["anchor"], F.lit(" "), F.substring_index(c["after"], " ", CHAIN))))
        .otherwise(F.array("_plain")))))
    return df.drop("_plain", "_parts", "_runs", "_chains")


def fingerprint(sigs: Column) -> Column:
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.sha2(F.array_join(sigs, "\n"), 256))


def hashes(sigs: Column) -> Column:
    """array<bigint>: a set as hashes, to be compared."""
    return F.transform(sigs, lambda s: F.xxhash64(s))


def partition_of(size: Column) -> Column:
    """The partition of a set by its length: sets with a Jaccard similarity of LENGTH_STEP are one apart at most."""
    return F.floor(F.ln(size.cast("double")) / -math.log(LENGTH_STEP))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, or 0.0 where their lengths alone keep it below ``least``."""
    common = F.size(F.array_intersect(a, b))
    jaccard = common.cast("double") / (F.size(a) + F.size(b) - common)
    if least <= 0:
        return jaccard
    apart = math.ceil(math.log(least) / math.log(LENGTH_STEP)) + 1
    far = F.abs(partition_of(F.size(a)) - partition_of(F.size(b))) > apart
    return F.when(far | (F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b))), F.lit(0.0)).otherwise(jaccard)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signatures, fingerprint, length_partition) for every row of ``docs``."""
    rows = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    s = add_signatures(rows, "_text", "signatures")
    return s.select(F.col("_id").alias(id_col), "signatures", fingerprint(F.col("signatures")).alias("fingerprint"),
                    partition_of(F.size("signatures")).alias("length_partition"))


def _bucket(id_: Column, bounds: list) -> Column:
    """How many of the descending ``bounds`` lie above an id: found in two steps of about sqrt(bounds) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    above = lambda values: F.size(F.filter(values, lambda x: x > id_))
    whole = above(F.array(*[F.lit(g[-1]) for g in groups]))
    inside = F.get(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), whole)
    return F.when(id_.isNull(), F.lit(len(bounds))).otherwise(whole * step + F.coalesce(above(inside), F.lit(0)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _sigs, next_text, next_sigs): every document and the next one by descending id."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("_id", [k / n for k in range(1, n)], 10 * n)).first()[0]
    bounds = sorted(set(cuts or []), reverse=True)
    kind = rows.schema["_id"].dataType
    bucket = _bucket(F.col("_id"), bounds).alias("_bucket")
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text").desc()]
    # the first row of each bucket: at most one for each bound and one more
    tops = rows.select("_id", bucket).groupBy("_bucket").agg(F.max("_id").alias("_top"))
    some = sorted(r[0] for r in tops.select("_bucket").collect())
    before = dict(zip(some, some[-1:] + some[:-1], strict=True))
    first = (rows.select("*", bucket).join(F.broadcast(tops), "_bucket").where(F.col("_id").eqNullSafe(F.col("_top")))
             .groupBy("_bucket").agg(F.max(F.struct(F.xxhash64("_text").alias("h"), "_text", "_id")).alias("m")))
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    extra = first.select(F.col("m._id").cast(kind).alias("_id"), F.col("m._text").alias("_text"),
                         place[F.col("_bucket")].alias("_bucket"), F.lit(1).alias("_extra"))
    every = rows.select("_id", "_text", bucket, F.lit(0).alias("_extra")).union(extra).repartition("_bucket")
    every = add_signatures(every, "_text", "_sigs")
    window = Window.partitionBy("_bucket").orderBy("_extra", *order)
    after = [F.lead(k).over(window).alias(f"next{k}") for k in ("_text", "_sigs")]
    return every.select("*", *after).where("_extra = 0").drop("_extra", "_bucket")


def query(docs: DataFrame) -> DataFrame:
    rows = with_next(docs)
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select(F.col("_id").alias("doc_id"), n.cast("bigint").alias("n_chars"), "_sigs", "next_sigs",
                       edited.alias("_edited"))
    rows = add_signatures(rows, "_edited", "_edited_sigs")
    sets = {k: F.col(f"{k}_set") for k in ("_sigs", "next_sigs", "_edited_sigs")}
    rows = rows.select("*", *[hashes(F.col(k)).alias(f"{k}_set") for k in sets])
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_sigs")).alias("fingerprint"),
        fingerprint(F.col("_edited_sigs")).alias("edited_fingerprint"),
        likeness(sets["_sigs"], sets["_edited_sigs"]).alias("near_edited"),
        likeness(sets["_sigs"], sets["next_sigs"]).alias("near_next"))


def _sigs_sql(source: str, text: str, out: str) -> str:
    runs = " || ".join(["run"] + [f"coalesce(lead(run, {k}) OVER w, '')" for k in range(1, RUNS)])
    return f"""
{out}_plain AS (SELECT doc_id, trim(regexp_replace(lower({text}), '{NOT_WORD}', ' ', 'g'), ' ') AS plain FROM {source}),
{out}_split AS (SELECT doc_id, plain, string_split(regexp_replace(' ' || replace(plain, ' ', '  ') || ' ',
    '{_anchor_pattern()}', chr(1) || '\\1 ', 'g'), chr(1)) AS parts FROM {out}_plain),
{out}_parts AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM {out}_split),
{out}_runs AS (SELECT doc_id, part, i, substr(part, instr(part, ' ') + 1) AS run
    FROM (SELECT doc_id, i, replace(part, '  ', ' ') AS part FROM {out}_parts)),
{out}_after AS (SELECT doc_id, i, string_split(part, ' ')[1] AS anchor, string_split(rtrim({runs}, ' '), ' ') AS words
    FROM {out}_runs WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{out}_chains AS (SELECT doc_id, list_sort(list(DISTINCT anchor || ' ' || array_to_string(words[1:{CHAIN}], ' '))) AS sigs
    FROM {out}_after WHERE i > 1 AND len(words) >= {CHAIN} GROUP BY doc_id),
{out} AS (SELECT p.doc_id, coalesce(sigs, [plain]) AS sigs FROM {out}_plain p LEFT JOIN {out}_chains c ON p.doc_id = c.doc_id)"""


def _print_sql(sigs: str) -> str:
    return f"len({sigs}) || ':' || sha256(array_to_string({sigs}, chr(10)))"


def _jaccard_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"{common}::DOUBLE / (len({a}) + len({b}) - {common})"


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
changed AS (SELECT doc_id, n, next_id, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM pairs),
{_sigs_sql('docs', 'text', 'own')},
{_sigs_sql('changed', 'edited', 'other')}
SELECT c.doc_id, c.n AS n_chars, sha256(edited) AS edited_sha256, {_print_sql('a.sigs')} AS fingerprint,
    {_print_sql('b.sigs')} AS edited_fingerprint, {_jaccard_sql('a.sigs', 'b.sigs')} AS near_edited,
    {_jaccard_sql('a.sigs', 'x.sigs')} AS near_next
FROM changed c JOIN own a ON a.doc_id = c.doc_id JOIN other b ON b.doc_id = c.doc_id JOIN own x ON x.doc_id = c.next_id
"""
