import __spark_entry__ as entry


def test_entry_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r.level for r in sorted(rows, key=lambda r: r.level_ord)] == \
        ["simple", "moderate", "challenging", "total"]
    assert rows[-1].n > 0


def test_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 55
