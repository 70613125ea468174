import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 40_000 + "end"
    rows = [row(1, "one two three four five six"), row(1, "one two three four five six"), row(2, None), row(3, ""),
            row(None, "no id here at all", None, None), row(4, long), row(5, "x" * 100_000), row(6, " \n \n"),
            (7, None, None, None, None), row(8, "one two three four five six", source="s1")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named like results or helpers."""
    names = ["score", "spans", "ids", "decoded", "sequence_id", "offset", "piece", "start", "length", "n_lines", "n_removed",
             "sites", "pos", "h1", "key", "class_id", "quality", "keep", "evidence", "found", "fingerprint", "hash",
             "licences", "sentence_ids", "n", "bag", "text_hash", "doc"]
    rows = [row(i, t) + ("x",) * len(names) for i, t in
            [(1, "first second third fourth fifth sixth"), (2, "password = abcdefgh1"), (3, None)]]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names))


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
