import datetime

from sqltally.operators import profile, prompts, schema_text


def examples_of(spark, rows, schema, k=5):
    df = spark.createDataFrame(rows, schema)
    ex = profile.clean_examples(profile.column_examples("db", "t", df, k))
    return [r.value for r in ex.orderBy("rank").collect()]


# Hand-worked example-cleaning cases (example_num 3 is applied in the text).
def test_smallest_distinct(spark):
    df = spark.createDataFrame([(v,) for v in [4, 2, 2, None, 3, 1, 10]], "a long")
    ex = profile.column_examples("db", "t", df.repartition(3), 3)
    assert [r.value for r in ex.orderBy("rank").collect()] == ["1", "2", "3"]


def test_email_drops_all(spark):
    assert examples_of(spark, [("a",), ("me@x.org",), ("b",)], "a string") == []


def test_url_drops_all(spark):
    assert examples_of(spark, [("a",), ("http://h",), ("b",)], "a string") == []


def test_date_keeps_first(spark):
    rows = [(datetime.date(2024, 1, 2),), (datetime.date(2024, 1, 1),)]
    assert examples_of(spark, rows, "a date") == ["2024-01-01"]


def test_decimal_as_float(spark):
    import decimal
    rows = [(decimal.Decimal("1.50"),), (decimal.Decimal("2.00"),)]
    assert examples_of(spark, rows, "a decimal(10,2)") == ["1.5", "2.0"]


def test_empty_and_null_dropped(spark):
    assert examples_of(spark, [("",), (None,), ("x",)], "a string") == ["x"]


def test_bare_com_kept(spark):
    assert examples_of(spark, [("a",), ("www.x.com",)], "a string") == ["a", "www.x.com"]


def _text(spark, values, typ="string"):
    cols = spark.createDataFrame([("db", "t", 0, "c", typ.upper(), typ.upper(), True, None, "")],
                                 "db_id string, table_name string, position int, column_name string, "
                                 "type string, full_type string, nullable boolean, default string, comment string")
    ex = spark.createDataFrame([("db", "t", "c", typ.upper(), i + 1, v) for i, v in enumerate(values)],
                               "db_id string, table_name string, column_name string, type string, rank int, value string")
    pk = spark.createDataFrame([], "db_id string, table_name string, column_name string")
    return schema_text.column_lines(cols, ex, pk, 3).collect()[0].line


def test_example_length_rules(spark):
    assert _text(spark, ["1", "2", "3", "4"]) == "(c:STRING, Examples: [1, 2, 3])"
    assert _text(spark, ["x" * 21, "b"]) == "(c:STRING, Examples: [" + "x" * 21 + "])"
    assert _text(spark, ["b", "x" * 51]) == "(c:STRING)"
    assert _text(spark, ["2024-01-01 00:00:00", "2024-01-02 00:00:00"], "timestamp") == \
        "(c:TIMESTAMP, Examples: [2024-01-01 00:00:00])"


def test_mschema_text_and_subset(spark):
    cols = spark.createDataFrame([
        ("db", "a", 0, "id", "BIGINT", "BIGINT", True, None, ""),
        ("db", "a", 1, "name", "STRING", "STRING", True, None, "the name"),
        ("db", "b", 0, "a_id", "BIGINT", "BIGINT", True, None, "")],
        "db_id string, table_name string, position int, column_name string, type string, full_type string, "
        "nullable boolean, default string, comment string")
    ex = spark.createDataFrame([("db", "a", "id", "BIGINT", 1, "1")],
                               "db_id string, table_name string, column_name string, type string, rank int, value string")
    pk = spark.createDataFrame([("db", "a", "id")], "db_id string, table_name string, column_name string")
    fk = spark.createDataFrame([("db", "b", "a_id", "a", "id")],
                               "db_id string, table_name string, column_name string, ref_table string, ref_column string")
    text = schema_text.render_mschema(cols, ex, pk, fk).collect()[0].text
    assert text == ("【DB_ID】 db\n【Schema】\n# Table: a\n[\n(id:BIGINT, Primary Key, Examples: [1]),\n"
                    "(name:STRING, the name)\n]\n# Table: b\n[\n(a_id:BIGINT)\n]\n【Foreign keys】\nb.a_id=a.id")
    sel = spark.createDataFrame([("db", "A.NAME")], "db_id string, name string")
    c2, f2 = schema_text.select_subset(cols, fk, selected_columns=sel)
    sub = schema_text.database_texts(schema_text.table_texts(schema_text.column_lines(c2, ex, pk)), f2)
    assert sub.collect()[0].text == "【DB_ID】 db\n【Schema】\n# Table: a\n[\n(name:STRING, the name)\n]"


def test_sample_rows_block(spark):
    df = spark.createDataFrame([(10, "x"), (2, None), (3, "long text")], "id int, v string")
    text = schema_text.sample_rows_text(df, 2).collect()[0].text
    header, rows = ["id", "v"], [["2", "None"], ["3", "long text"]]
    widths = [max(len(r[i]) for r in rows + [header]) for i in range(2)]
    expect = "\n".join("".join(v.rjust(w) + " " for v, w in zip(r, widths)) for r in [header] + rows)
    assert text == expect


def test_template_fill_is_single_pass(spark):
    q = spark.createDataFrame([(1, "db", "what is {db_schema}?", None)],
                              "question_id long, db_id string, question string, evidence string")
    s = spark.createDataFrame([("db", "SCHEMA")], "db_id string, text string")
    p = prompts.build_prompts(q, s, template="Q={question} S={db_schema} E={evidence} D={dialect}")
    assert p.collect()[0].prompt == "Q=what is {db_schema}? S=SCHEMA E= D=Spark SQL"


def test_unknown_database_flagged(spark):
    q = spark.createDataFrame([(1, "nodb", "q", "e")], "question_id long, db_id string, question string, evidence string")
    s = spark.createDataFrame([("db", "SCHEMA")], "db_id string, text string")
    r = prompts.build_prompts(q, s, "{question}").collect()[0]
    assert r.schema_found is False


def test_key_checks_count_rows(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    fk = profile.check_foreign_keys({"c": child, "p": parent}, [("c", "k", "p", "k")]).collect()[0]
    assert fk.n_orphans == 3 and fk.holds is False
    pk = profile.check_primary_keys({"p": parent}, [("p", ["k"])]).collect()[0]
    assert (pk.n_duplicate_keys, pk.n_null_rows, pk.holds) == (1, 1, False)


def test_ddl_database_text_with_rows(spark):
    cols = spark.createDataFrame([
        ("db", "b", 0, "x", "INT", "INT", True, None, ""),
        ("db", "a", 0, "id", "BIGINT", "BIGINT", False, None, "")],
        "db_id string, table_name string, position int, column_name string, type string, full_type string, "
        "nullable boolean, default string, comment string")
    ddl = schema_text.ddl_texts(cols)
    rows = spark.createDataFrame([("db", "a", "id \n 1 ")], "db_id string, table_name string, text string")
    text = schema_text.ddl_database_texts(schema_text.with_sample_rows(ddl, rows, 1)).collect()[0].text
    assert text == ("CREATE TABLE `a` (\n  `id` BIGINT NOT NULL\n) \n /* \n 1 example rows: \n"
                    " SELECT * FROM `a` LIMIT 1; \n id \n 1  \n */\n\nCREATE TABLE `b` (\n  `x` INT\n)")


def test_prompts_by_family(spark):
    q = spark.createDataFrame([(1, "db", "q1", "e1", "a"), (2, "db", "q2", None, "b"), (3, "db", "q3", "", "zz")],
                              "question_id long, db_id string, question string, evidence string, family string")
    s = spark.createDataFrame([("db", "S")], "db_id string, text string")
    p = {r.question_id: r for r in prompts.build_prompts_by_family(
        q, s, "family", {"a": "A:{question}/{evidence}", "b": "B:{db_schema}/{question}"}).collect()}
    assert p[1].prompt == "A:q1/e1" and p[2].prompt == "B:S/q2"
    assert p[3].prompt is None and p[3].template_found is False


def test_cached_mschema_reuses_and_keys(spark):
    from sqltally.plans import schema as S
    from sqltally.session import scratch_path
    root = scratch_path(spark, "mschema-cache")
    a = S.cached_mschema(spark, "/root/testdata/sf0.001", cache_root=root).orderBy("db_id").collect()
    b = S.cached_mschema(spark, "/root/testdata/sf0.001", cache_root=root).orderBy("db_id").collect()
    assert [r.text for r in a] == [r.text for r in b] and len(a) == 2
    c = S.cached_mschema(spark, "/root/testdata/sf0.001", example_num=1, cache_root=root).collect()
    assert len(c) == 2 and {r.text for r in c} != {r.text for r in a}
