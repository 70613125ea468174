"""Line dedup by distinct-site spread, with built-in functions only.

1. Every line of every text is hashed (two 64-bit hashes of the trimmed line).
   A HyperLogLog sketch of the sites per line hash, merged by aggregation,
   estimates on how many distinct sites the line stands.
2. Lines whose estimate is near the threshold (within ``band`` of it) get their
   exact distinct count; the rest are far enough for the sketch to decide.
3. A line on ``min_sites`` or more sites is cross-site boilerplate.  Its first
   occurrence, by (document id, text hash, position), stays; all others go.

Lines of fewer than three words are never boilerplate.  Sites are reduced to
distinct (line, site) rows before they are sketched, and every grouping has
map-side partial results, so that a line on a third of all rows stays cheap.
The texts move once, to meet the positions to be left out.

Defined results: a null text stays null and an empty one empty; a null site
counts as one site; a row repeated with the same id and text is one document,
so its copies keep the same lines; a text may end up empty, its row stays; an
empty table gives an empty result; other columns stay as they are, but for one
named like an added column, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.common import col, text_of, written

MIN_SITES = 10
LG_K = 12  # sketches of 4,096 registers: relative standard error 1.6 %
BAND = 0.1  # six standard errors
WORDS = "[^ ]+ +[^ ]+ +[^ ]"  # three words or more
SECOND = "second hash"  # seeds the second hash


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(h1, h2, site, doc, text_hash, pos) of every line that may be boilerplate."""
    text = text_of(text_col)
    rows = docs.select(col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"),
                       F.coalesce(col(site_col).cast("string"), F.lit("\u0000")).alias("site"),
                       F.posexplode(lines_of(text)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.col("line").rlike(WORDS))
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(SECOND)).alias("h2"),
                       "site", "doc", "text_hash", "pos")


def spread(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, sites): estimated distinct sites of every line hash."""
    by_site = _occurrences(docs, id_col, text_col, site_col).select("h1", "h2", "site").distinct()
    return (by_site.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
            .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", id_col: str = "doc_id",
          text_col: str = "text", n_lines_col: str = "n_lines", n_removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with the lines removed from its texts and two columns of counts."""
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    wide = written(spread(docs, site_col, id_col, text_col).where(F.col("sites") >= low), "line-spread")
    found = written(_occurrences(docs, id_col, text_col, site_col).join(wide, ["h1", "h2"]), "line-occurrences")
    near = F.col("sites").between(low, high)
    exact = (found.where(near).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2").agg(F.sum("one").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2"))
    sure = wide.where(~near).select("h1", "h2")
    here = F.struct("doc", "text_hash", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(here).alias("first"))
    boilerplate = first.join(sure.union(exact), ["h1", "h2"])
    out = (found.join(boilerplate, ["h1", "h2"]).where(here != F.col("first"))
           .groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("out")))
    hidden = [c for c in docs.columns if c.lower() in (n_lines_col.lower(), n_removed_col.lower())]
    rows = docs.drop(*hidden)
    text, lines = text_of(text_col), lines_of(text_of(text_col))
    joined = rows.alias("d").join(
        out.alias("o"), F.expr(f"d.`{id_col}` <=> o.doc") & (F.xxhash64(text) == F.col("o.text_hash")), "left")
    gone = F.col("o.out")
    cleaned = F.when(gone.isNull(), col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    kept = [cleaned.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in rows.columns]
    return joined.select(*kept, F.size(lines).cast("bigint").alias(n_lines_col),
                         F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(n_removed_col))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of ``docs``, ``n_chars`` counted anew where it is there."""
    out = dedup(docs, n_lines_col="_n_lines", n_removed_col="_n_removed").drop("_n_lines", "_n_removed")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


ORACLE = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
able AS (SELECT doc_id, source, pos, trim(line, ' ') AS line FROM lines
    WHERE regexp_matches(trim(line, ' '), '{WORDS}')),
boiler AS (SELECT line, min((doc_id, pos)) AS first FROM able GROUP BY line
    HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
gone AS (SELECT a.doc_id, a.pos FROM able a JOIN boiler b ON a.line = b.line AND (a.doc_id, a.pos) <> b.first),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
        count(*) AS n_lines, count(g.pos) AS n_removed
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT k.doc_id, n_lines, n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM kept k JOIN documents d ON d.doc_id = k.doc_id
"""
