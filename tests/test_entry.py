import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_taxonomy_matches_its_sql(spark):
    import duckdb

    rows = entry.queries()["taxonomy_risk"](spark, "").collect()
    assert sorted(map(tuple, rows)) == sorted(duckdb.sql(entry.oracle_sql()["taxonomy_risk"]).fetchall())
