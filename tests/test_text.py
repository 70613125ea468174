from pyspark.sql import functions as F

from sqltally.functions import text as T

FENCE = "```"


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("r")).collect()[0]["r"]


# Hand-worked response-cleaning cases.
def test_fenced_block(spark):
    assert one(spark, T.extract_sql, f"x\n{FENCE}sql\nSELECT 1\n{FENCE}\ny") == "SELECT 1;"


def test_comment_removed(spark):
    resp = f"{FENCE}sql\nSELECT 1 -- c\nFROM t;\n{FENCE}"
    assert one(spark, T.extract_sql, resp) == "SELECT 1 \nFROM t;"


def test_first_of_two_blocks(spark):
    resp = f"{FENCE}sql\nSELECT 1\n{FENCE} and {FENCE}sql\nSELECT 2\n{FENCE}"
    assert one(spark, T.extract_sql, resp) == "SELECT 1;"


def test_plain_text_is_null(spark):
    assert one(spark, T.extract_sql, "SELECT 1") is None


def test_fence_without_newline_is_null(spark):
    assert one(spark, T.extract_sql, f"{FENCE}sql\nSELECT 1{FENCE}") is None


def test_trailing_python_whitespace(spark):
    # \x1c and \xa0 are whitespace for Python's rstrip
    assert one(spark, T.strip_comments, "SELECT 1 \x1c\xa0\n") == "SELECT 1;"


def test_carriage_return_kept_in_comment_line(spark):
    assert one(spark, T.strip_comments, "a -- x\r\nb") == "a \nb;"


def test_think_answer(spark):
    r = one(spark, T.extract_answer, "<think> a </think> <answer> b </answer>")
    assert (r["think"], r["answer"]) == ("a", "b")


def test_only_answer(spark):
    r = one(spark, T.extract_answer, "<answer> b </answer>")
    assert (r["think"], r["answer"]) == (None, None)


def test_pack_unpack(spark):
    df = spark.createDataFrame([("SELECT 1", "db1"), (None, "db2")], "s string, d string")
    rows = df.select(T.unpack(T.pack("s", "d")).alias("u")).collect()
    assert (rows[0].u.sql, rows[0].u.db_id, rows[0].u.ok) == ("SELECT 1", "db1", True)
    assert rows[1].u.ok is False


def test_db_name_from_path(spark):
    assert one(spark, T.db_name_from_path, "/data/dev/financial/financial.sqlite") == "financial"


def test_email(spark):
    assert one(spark, T.is_email, "me@x.org") is True
    assert one(spark, T.is_email, "me at x.org") is False
    assert one(spark, T.is_email, "müller@bücher.de") is True
