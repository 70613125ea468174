"""Response cleaning and small text functions (C1-C7, P5) as column expressions.

All are built-in regular-expression and string functions (JVM side, inside
whole-stage code generation); nothing here runs Python per row.

Java regular expressions differ from Python's in line and space handling, so
the patterns spell those out: ``(?d)`` makes ``\\n`` the only line end (as in
Python), and :data:`PY_SPACE` lists the characters Python's ``str.strip``
removes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator between a predicted statement and its database id
# in packed prediction files.
PACK_SEP = "\t----- bird -----\t"

# Characters Python treats as whitespace (str.isspace), as a regex class.
PY_SPACE = ("[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")

# The kit's patterns for a fenced sql block, a line comment,
# the reasoning/answer pair and an e-mail address (with the Java flags that
# give them Python's line and character rules).
SQL_BLOCK = "(?s)```sql\\n(.*?)\\n```"
LINE_COMMENT = "(?md)--.*?$"
THINK_ANSWER = "(?s)<think>(.*?)</think>" + PY_SPACE + "*<answer>(.*?)</answer>"
EMAIL = "(?Ud)^[\\w.-]+@[\\w.-]+\\.\\w+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rstrip_py(c) -> Column:
    return F.regexp_replace(_col(c), PY_SPACE + "+\\z", "")


def strip_py(c) -> Column:
    return F.regexp_replace(_col(c), "^" + PY_SPACE + "+|" + PY_SPACE + "+\\z", "")


def sql_block(c) -> Column:
    """The first fenced ``sql`` block, NULL when there is none."""
    c = _col(c)
    return F.when(c.rlike(SQL_BLOCK), F.regexp_extract(c, SQL_BLOCK, 1))


def strip_comments(c) -> Column:
    """Drop ``--`` comments to line end, trim the right, end with ``;``."""
    body = rstrip_py(F.regexp_replace(_col(c), LINE_COMMENT, ""))
    return F.when(body.endswith(";"), body).otherwise(F.concat(body, F.lit(";")))


def extract_sql(c) -> Column:
    """C1+C2: the cleaned statement of a model response, NULL on failure."""
    block = sql_block(c)
    return F.when(block.isNotNull(), strip_comments(block))


def extract_answer(c) -> Column:
    """``struct(think, answer)`` of ``<think>..</think> <answer>..</answer>``,
    both trimmed; NULL fields when the pattern is absent."""
    c = _col(c)
    hit = c.rlike(THINK_ANSWER)
    return F.struct(
        F.when(hit, strip_py(F.regexp_extract(c, THINK_ANSWER, 1))).alias("think"),
        F.when(hit, strip_py(F.regexp_extract(c, THINK_ANSWER, 2))).alias("answer"))


def pack(sql, db_id) -> Column:
    """C4: ``sql + separator + db_id`` (NULL when there is no statement)."""
    s = _col(sql)
    return F.when(s.isNotNull(), F.concat(s, F.lit(PACK_SEP), _col(db_id)))


def unpack(packed) -> Column:
    """``struct(sql, db_id, ok)``; ``ok`` is false unless exactly one separator."""
    parts = F.split(_col(packed), "\\Q" + PACK_SEP + "\\E", -1)
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, parts[0]).alias("sql"), F.when(ok, parts[1]).alias("db_id"),
                    F.coalesce(ok, F.lit(False)).alias("ok"))


def db_name_from_path(path) -> Column:
    """``.../name/name.sqlite`` -> ``name`` (last path part up to the first dot)."""
    return F.substring_index(F.substring_index(_col(path), "/", -1), ".", 1)


def is_email(c) -> Column:
    """P5: the whole text looks like one e-mail address."""
    return F.coalesce(_col(c).rlike(EMAIL), F.lit(False))


def has_url(c) -> Column:
    c = _col(c)
    return F.coalesce(c.contains("http://") | c.contains("https://"), F.lit(False))
