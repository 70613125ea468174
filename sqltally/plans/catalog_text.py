"""Registered queries for response cleaning, prompts and generation.

Responses come from ``conversations``, pages from ``pages``, questions from
``benchmark`` (see :mod:`sqltally.plans.tables`).  The DuckDB twins use RE2
patterns written with the same explicit line and space rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.functions import text as T
from sqltally.operators import execute, generate, profile, prompts
from sqltally.plans import schema as S
from sqltally.plans import tables as TB
from sqltally.plans import workload as W
from sqltally.plans.catalog import register
from sqltally.session import scratch_path
from sqltally.sources import files, sinks
from sqltally.plans.catalog_schema import _db_sql, _fk_values, _lines_sql, _q, _tables_sql

WS = T.PY_SPACE
NL = "chr(10)"
N_CANDIDATES = 4

_RESP = f"""
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 3 = 0 THEN text
            ELSE '```sql' || {NL} || text || ' -- generated' || {NL} || '```' END AS response
FROM conversations WHERE role = 'assistant'
"""


def _clean_sql_expr(col: str) -> str:
    body = f"regexp_replace(regexp_replace({col}, '--[^\\n]*', '', 'g'), '{WS}+$', '')"
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN ends_with({body}, ';') THEN {body} ELSE {body} || ';' END"


_BLOCK = "'(?s)```sql\\n(.*?)\\n```'"
_EXTRACT = f"""
SELECT conv_id, turn, {_clean_sql_expr('blk')} AS sql FROM (
  SELECT conv_id, turn,
         CASE WHEN regexp_matches(response, {_BLOCK}) THEN regexp_extract(response, {_BLOCK}, 1) END AS blk
  FROM ({_RESP}) r) b
"""


@register("extract_sql", _EXTRACT)
def q_extract_sql(spark, sf_dir):
    r = TB.model_responses(spark, sf_dir)
    return r.select("conv_id", "turn", T.extract_sql("response").alias("sql"))


@register("strip_comments", f"SELECT page_id, {_clean_sql_expr('html')} AS sql FROM pages")
def q_strip_comments(spark, sf_dir):
    p = TB.read(spark, sf_dir, "pages")
    return p.select("page_id", T.strip_comments("html").alias("sql"))


_TA = f"'(?s)<think>(.*?)</think>{WS}*<answer>(.*?)</answer>'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@register("extract_answer", f"""
SELECT conv_id, turn,
       CASE WHEN regexp_matches(response, {_TA}) THEN {_strip(f"regexp_extract(response, {_TA}, 1)")} END AS think,
       CASE WHEN regexp_matches(response, {_TA}) THEN {_strip(f"regexp_extract(response, {_TA}, 2)")} END AS answer
FROM (
  SELECT conv_id, turn,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN text
              ELSE '<think>' || {NL} || text || {NL} || '</think>' || {NL} || '<answer> ' || role || ' '
                   || CAST(turn AS VARCHAR) || ' </answer>' END AS response
  FROM conversations) r
""")
def q_extract_answer(spark, sf_dir):
    r = TB.reasoning_responses(spark, sf_dir)
    return r.select("conv_id", "turn", T.extract_answer("response").alias("a")).select(
        "conv_id", "turn", "a.think", "a.answer")


_SEP = "chr(9) || '----- bird -----' || chr(9)"


@register("pack_unpack", f"""
SELECT conv_id, turn, packed,
       CASE WHEN len(parts) = 2 THEN parts[1] END AS sql,
       CASE WHEN len(parts) = 2 THEN parts[2] END AS db_id,
       len(parts) = 2 AS ok
FROM (
  SELECT conv_id, turn, packed, string_split(packed, {_SEP}) AS parts FROM (
    SELECT conv_id, turn,
           CASE WHEN turn % 4 = 1 THEN text
                ELSE text || {_SEP} || CASE WHEN conv_id % 2 = 0 THEN 'star' ELSE 'text' END END AS packed
    FROM conversations WHERE role = 'assistant') a) b
""")
def q_pack_unpack(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    db = F.when(F.col("conv_id") % 2 == 0, F.lit("star")).otherwise(F.lit("text"))
    packed = F.when(F.col("turn") % 4 == 1, F.col("text")).otherwise(T.pack(F.col("text"), db))
    u = c.select("conv_id", "turn", packed.alias("packed")).withColumn("u", T.unpack("packed"))
    return u.select("conv_id", "turn", "packed", "u.sql", "u.db_id", "u.ok")


@register("db_name_from_path", """
SELECT page_id, split_part(string_split(url, '/')[-1], '.', 1) AS db_name FROM pages
""")
def q_db_name_from_path(spark, sf_dir):
    p = TB.read(spark, sf_dir, "pages")
    return p.select("page_id", T.db_name_from_path("url").alias("db_name"))


def _error_category_oracle() -> str:
    rows = []
    for q in W.oracle_rows():
        for i, c in enumerate(q["candidates"]):
            if c["expect"].startswith("error:"):
                rows.append(f"SELECT CAST({q['question_id']} AS BIGINT) AS question_id, CAST({i} AS INTEGER) AS ord, "
                            f"{_q(c['expect'].split(':', 1)[1])} AS category")
    return "\nUNION ALL\n".join(rows)


@register("error_category", _error_category_oracle())
def q_error_category(spark, sf_dir):
    """X6 as a column function over the logged error messages of the workload."""
    e = W.executions(spark, sf_dir).filter(F.col("status") == "error")
    return e.select("question_id", "ord", execute.error_category(F.col("message")).alias("category"))


# --- prompts ---

# Plain templates: what a prompt says is up to the user.
PLAIN = "{dialect}\n{db_schema}\n{evidence}\n{question}"
# every slot in each, in another order; the question stands on both sides of a long schema
FAMILIES = {"sql_expert": "{dialect}\n{question}\n{db_schema}\n{evidence}\n{question}",
            "reasoning": "{dialect} | {db_schema} | {evidence} | {question}"}
GIVEN, MISSING = "{db_schema}\n-- {evidence}\n-- {question}", "{db_schema}\n-- {question}"

_QUESTIONS = """
SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'star' ELSE 'text' END AS db_id,
       text AS question, CASE WHEN item_id % 3 = 0 THEN NULL ELSE split_part(text, '.', 1) END AS evidence
FROM benchmark
"""


def _schemas_sql() -> str:
    return _db_sql(_tables_sql(_lines_sql()), _fk_values())


def _template_sql(template: str, values: dict) -> str:
    parts, pos = [], 0
    for m in prompts.SLOT.finditer(template):
        if m.start() > pos:
            parts.append(_q(template[pos:m.start()]))
        parts.append(f"coalesce({values[m.group(1)]}, '')")
        pos = m.end()
    if pos < len(template):
        parts.append(_q(template[pos:]))
    return " || ".join(parts)


def _prompts_sql(use_evidence: bool = True) -> str:
    vals = {"question": "q.question", "db_schema": "s.text",
            "evidence": "q.evidence" if use_evidence else "''", "dialect": "'Spark SQL'"}
    return f"""
SELECT q.question_id, q.db_id, {_template_sql(PLAIN, vals)} AS prompt,
       s.text IS NOT NULL AS schema_found
FROM ({_QUESTIONS}) q LEFT JOIN ({_schemas_sql()}) s ON q.db_id = s.db_id
"""


def _schemas(spark, sf_dir):
    return S.mschema(spark, sf_dir)["databases"]


@register("build_prompts", _prompts_sql())
def q_build_prompts(spark, sf_dir):
    return prompts.build_prompts(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), PLAIN)


@register("evidence_off", _prompts_sql(use_evidence=False))
def q_evidence_off(spark, sf_dir):
    return prompts.build_prompts(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), PLAIN,
                                 use_evidence=False)


@register("messages", f"""
SELECT question_id, 0 AS msg_ord, 'system' AS role, '' AS content FROM ({_prompts_sql()}) p
UNION ALL
SELECT question_id, 1, 'user', prompt FROM ({_prompts_sql()}) p
""")
def q_messages(spark, sf_dir):
    p = prompts.chat_messages(prompts.build_prompts(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), PLAIN))
    return p.select("question_id", F.posexplode("messages").alias("msg_ord", "m")).select(
        "question_id", "msg_ord", "m.role", "m.content")


def _comment_sql(prefix: str = "", suffix: str = "") -> str:
    vals = {"question": "q.question", "db_schema": "s.text", "evidence": "q.evidence", "dialect": "'Spark SQL'"}
    return f"""
SELECT q.question_id, q.db_id, {_q(prefix)} || CASE WHEN q.evidence IS NOT NULL AND q.evidence <> '' THEN {_template_sql(GIVEN, vals)}
       ELSE {_template_sql(MISSING, vals)} END || {_q(suffix)} AS prompt, s.text IS NOT NULL AS schema_found
FROM ({_QUESTIONS}) q LEFT JOIN ({_schemas_sql()}) s ON q.db_id = s.db_id
"""


@register("comment_prompt", _comment_sql())
def q_comment_prompt(spark, sf_dir):
    return prompts.combined_prompt(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), GIVEN, MISSING)


SHOTS, CUE = "-- how many\nSELECT count(*)\n\n", "\n-- steps:"


@register("few_shot_prompt", _comment_sql(SHOTS, CUE))
def q_few_shot_prompt(spark, sf_dir):
    """The prompt between worked examples and a cue."""
    return prompts.combined_prompt(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), GIVEN, MISSING,
                                   prefix=SHOTS, suffix=CUE)


@register("generate_candidates", f"""
SELECT question_id, CAST(j AS INTEGER) AS ord,
       '```sql' || {NL} || 'SELECT ' || CAST(j AS VARCHAR) || ' AS candidate, ' || CAST(length(prompt) AS VARCHAR)
       || ' AS prompt_chars' || {NL} || '```' AS response
FROM (SELECT question_id, prompt, unnest(range({N_CANDIDATES})) AS j FROM ({_prompts_sql()}) p) x
""")
def q_generate_candidates(spark, sf_dir):
    p = prompts.build_prompts(TB.bench_questions(spark, sf_dir), _schemas(spark, sf_dir), PLAIN)
    return generate.generate_candidates(p, TB.echo_model, N_CANDIDATES)


@register("generate_stored", f"""
SELECT question_id, CAST(j AS INTEGER) AS ord,
       '```sql' || {NL} || 'SELECT ' || CAST(j AS VARCHAR) || ' AS candidate, ' || CAST(length(prompt) AS VARCHAR)
       || ' AS prompt_chars' || {NL} || '```' AS response
FROM (SELECT item_id AS question_id, text AS prompt, unnest(range({N_CANDIDATES})) AS j FROM benchmark) x
""")
def q_generate_stored(spark, sf_dir):
    """G8 + S8: generations kept by the first run; the second asks nothing."""
    p = TB.bench_questions(spark, sf_dir).select("question_id", F.col("question").alias("prompt"))
    store = scratch_path(spark, "generations")
    generate.stored_generations(p, TB.echo_model, N_CANDIDATES, store, "echo")
    return generate.stored_generations(p, TB.no_model, N_CANDIDATES, store, "echo")


@register("first_valid_attempt", f"""
SELECT a.conv_id, v.sql, v.attempt, a.n_attempts FROM (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_attempts FROM ({_EXTRACT}) e
  GROUP BY conv_id) a
LEFT JOIN (
  SELECT conv_id, arg_min(sql, turn) AS sql, min(turn) AS attempt FROM ({_EXTRACT}) e
  WHERE sql IS NOT NULL GROUP BY conv_id) v ON a.conv_id = v.conv_id
""")
def q_first_valid_attempt(spark, sf_dir):
    r = TB.model_responses(spark, sf_dir).withColumnRenamed("turn", "attempt")
    out = generate.first_valid_attempt(r, key="conv_id")
    return out.select("conv_id", "sql", "attempt", F.col("n_attempts").cast("bigint").alias("n_attempts"))


@register("resume", """
SELECT DISTINCT CAST(floor(event_id / 16) AS BIGINT) AS question_id FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase'
                  AND CAST(floor(d.event_id / 16) AS BIGINT) = CAST(floor(e.event_id / 16) AS BIGINT))
""")
def q_resume(spark, sf_dir):
    """Questions still to do, given a progress log (here: the questions
    that already have a ``purchase`` candidate count as done)."""
    execs = TB.event_executions(spark, sf_dir)
    todo = execs.select("question_id").distinct()
    done = execs.filter(F.col("fp") == "purchase").select("question_id")
    return generate.resume(todo, done)


def _family_sql() -> str:
    vals = {"question": "q.question", "db_schema": "s.text", "evidence": "q.evidence", "dialect": "'Spark SQL'"}
    fam = "CASE WHEN q.question_id % 5 = 4 THEN 'unknown' WHEN q.question_id % 2 = 0 THEN 'sql_expert' ELSE 'reasoning' END"
    return f"""
SELECT question_id, db_id, family, prompt, schema_found, prompt IS NOT NULL AS template_found FROM (
  SELECT q.question_id, q.db_id, {fam} AS family,
         CASE WHEN {fam} = 'sql_expert' THEN {_template_sql(FAMILIES['sql_expert'], vals)}
              WHEN {fam} = 'reasoning' THEN {_template_sql(FAMILIES['reasoning'], vals)} END AS prompt,
         s.text IS NOT NULL AS schema_found
  FROM ({_QUESTIONS}) q LEFT JOIN ({_schemas_sql()}) s ON q.db_id = s.db_id) x
"""


@register("prompts_by_family", _family_sql())
def q_prompts_by_family(spark, sf_dir):
    """Template chosen per question by a model-family column (one family
    has no template and is flagged)."""
    qid = F.col("question_id")
    fam = (F.when(qid % 5 == 4, F.lit("unknown")).when(qid % 2 == 0, F.lit("sql_expert"))
           .otherwise(F.lit("reasoning")))
    q = TB.bench_questions(spark, sf_dir).withColumn("family", fam)
    return prompts.build_prompts_by_family(q, _schemas(spark, sf_dir), "family", FAMILIES)


@register("retry_until_answer", """
SELECT item_id AS question_id, CASE WHEN length(text) % 2 = 1 THEN CAST(length(text) AS VARCHAR) END AS thinking,
       CASE WHEN length(text) % 2 = 1 THEN 'SELECT 0' END AS sql
FROM benchmark
""")
def q_retry_until_answer(spark, sf_dir):
    """Three attempts at most until thinking and answer are both there; a question without them stays, empty."""
    q = TB.bench_questions(spark, sf_dir).select("question_id", F.col("question").alias("prompt"))
    r = generate.generate_candidates(q, TB.thinking_model, 1, max_attempts=3, is_valid=generate.has_think_answer)
    both = q.join(r, "question_id", "left").withColumn("x", T.extract_answer("response"))
    return both.select("question_id", F.col("x.think").alias("thinking"), F.col("x.answer").alias("sql"))


@register("question_paths", f"""
SELECT question_id, 'dbs/' || db_id || '/' || db_id || '.sqlite' AS path, coalesce(evidence, '') AS evidence FROM ({_QUESTIONS}) q
""")
def q_question_paths(spark, sf_dir):
    """Each question with its database's place and its evidence."""
    q = TB.bench_questions(spark, sf_dir)
    return q.select("question_id", files.db_file_path("dbs/", "db_id").alias("path"), F.coalesce("evidence", F.lit("")).alias("evidence"))


@register("lines_kept", "SELECT DISTINCT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS value FROM benchmark")
def q_lines_kept(spark, sf_dir):
    """K2 twice (the first write stays) -> S5."""
    path = scratch_path(spark, "lines")
    flat = TB.read(spark, sf_dir, "benchmark").select(F.regexp_replace("text", "[\\r\\n]", " ").alias("value")).distinct()
    sinks.write_text_if_absent(flat, path)
    sinks.write_text_if_absent(flat.limit(1), path)
    return files.read_lines(spark, path)


@register("json_kept", "SELECT doc_id, quality, toxic FROM labels")
def q_json_kept(spark, sf_dir):
    """K1 twice (the first write stays), read back."""
    path = scratch_path(spark, "json")
    labels = TB.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sinks.write_json_if_absent(labels, path)
    sinks.write_json_if_absent(labels.limit(1), path)
    return spark.read.schema(labels.schema).json(path)


@register("table_comments", " UNION ALL ".join(
    f"SELECT {_q(TB.db_of(t))} AS db_id, {_q(t)} AS table_name, count(*) || ' rows' AS comment FROM {t}" for t in TB.STAR_TABLES + TB.TEXT_TABLES))
def q_table_comments(spark, sf_dir):
    """Comments of all tables, here their sizes."""
    dbs = S.databases(spark, sf_dir)
    counts = {t: f" {df.count()} rows " for d in dbs.values() for t, df in d.items()}
    out = [profile.table_comments(spark, d, ts, counts) for d, ts in sorted(dbs.items())]
    return out[0].unionByName(out[1])
