"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the
stage before it kept.  ``run`` writes each stage's rows as Parquet to the shared
scratch folder and reads them again as the next one's ``docs``:

1. toxicity: rows scored 0.5 or more go;
2. line dedup: cross-site boilerplate lines go, but for their first occurrence;
3. near dedup: one document of each class of near duplicates stays;
4. secrets: found secrets are replaced in the texts, every row stays;
5. packing: the texts are tokenised and packed into sequences.

Defined results: a null text counts as empty (it is never toxic by its words, has no
lines to remove, no near copies and no secrets, and packs as its closing id); a
row without an id stays a row, but for near copies and repeated texts, of which
the row with the smallest id stays (any one, if none has an id); very long texts
are handled whole; ties go to the smaller id; empty tables give an empty result;
further columns pass through the first four stages.

All but the last return the columns of ``documents``.  The model of the first
stage is trained on the labels, so that SQL cannot express the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sqltally.llm import lines, neardup, packing, secrets, toxicity
from sqltally.llm.common import read, written

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: toxicity.stage(docs, read(spark, sf_dir, "labels"))),
    ("line_dedup", lambda spark, docs, sf_dir: lines.stage(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: neardup.stage(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.stage(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.query(docs, public_tokenizers.path("byte_bpe_50k.json"))),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
