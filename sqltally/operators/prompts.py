"""Prompt tables (G1-G7): questions joined with schema text, templates filled.

Templates are user data with the slots ``{question}``, ``{db_schema}``,
``{evidence}`` and ``{dialect}``.  A template is split once on the driver
into literal pieces and slots, and filled with one ``concat`` per row (a slot
value is never re-scanned for other slots, as with ``str.format``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = re.compile(r"\{(question|db_schema|evidence|dialect)\}")

def fill_template(template: str, values: dict) -> Column:
    """Fill ``template`` with columns/literals given per slot name."""
    parts, pos = [], 0
    for m in SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)], F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def attach_schema(questions: DataFrame, schemas: DataFrame) -> DataFrame:
    """G1: questions left-joined with ``schemas(db_id, text)``; a question of an
    unknown database keeps a NULL ``db_schema`` and ``schema_found = false``
    instead of failing the run.  One schema row per database is small next
    to the questions; AQE broadcasts it when its measured size allows."""
    s = schemas.select("db_id", F.col("text").alias("db_schema"))
    return questions.join(s, "db_id", "left").withColumn("schema_found", F.col("db_schema").isNotNull())


def build_prompts(questions: DataFrame, schemas: DataFrame, template: str,
                  dialect: str = "Spark SQL", use_evidence: bool = True) -> DataFrame:
    """``prompts(question_id, db_id, prompt, schema_found)``."""
    q = attach_schema(questions, schemas)
    ev = F.coalesce(F.col("evidence"), F.lit("")) if use_evidence else F.lit("")
    prompt = fill_template(template, {"question": F.col("question"), "db_schema": F.col("db_schema"),
                                      "evidence": ev, "dialect": F.lit(dialect)})
    return q.select("question_id", "db_id", prompt.alias("prompt"), "schema_found")


def by_evidence(values: dict, given: str, missing: str) -> Column:
    """Template ``given`` where there is evidence, else ``missing``."""
    evidence = values["evidence"]
    return F.when(evidence.isNotNull() & (evidence != ""), fill_template(given, values)).otherwise(fill_template(missing, values))


def combined_prompt(questions: DataFrame, schemas: DataFrame, given: str, missing: str, dialect: str = "Spark SQL",
                    use_evidence: bool = True, prefix: str = "", suffix: str = "") -> DataFrame:
    """One of two templates by evidence, between a ``prefix`` (such
    as worked examples) and a ``suffix`` (such as a cue to reason first)."""
    q = attach_schema(questions, schemas)
    values = {"question": F.col("question"), "db_schema": F.col("db_schema"), "dialect": F.lit(dialect),
              "evidence": F.col("evidence") if use_evidence else F.lit(None).cast("string")}
    prompt = F.concat(F.lit(prefix), by_evidence(values, given, missing), F.lit(suffix))
    return q.select("question_id", "db_id", prompt.alias("prompt"), "schema_found")


def chat_messages(prompts: DataFrame, system: str = "") -> DataFrame:
    """``messages ARRAY<STRUCT<role, content>>`` (system + user)."""
    msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                  F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return prompts.withColumn("messages", msg)


def build_prompts_by_family(questions: DataFrame, schemas: DataFrame, family_col: str,
                            templates: dict, dialect: str = "Spark SQL",
                            use_evidence: bool = True) -> DataFrame:
    """The template is chosen per row by a model-family column (``when``
    chain); a family without a template gets a NULL prompt and
    ``template_found = false`` instead of failing the run."""
    q = attach_schema(questions, schemas)
    ev = F.coalesce(F.col("evidence"), F.lit("")) if use_evidence else F.lit("")
    vals = {"question": F.col("question"), "db_schema": F.col("db_schema"), "evidence": ev,
            "dialect": F.lit(dialect)}
    prompt = None
    for family, template in templates.items():
        filled = fill_template(template, vals)
        hit = F.col(family_col) == F.lit(family)
        prompt = F.when(hit, filled) if prompt is None else prompt.when(hit, filled)
    return q.select("question_id", "db_id", family_col, prompt.alias("prompt"), "schema_found",
                    prompt.isNotNull().alias("template_found"))
