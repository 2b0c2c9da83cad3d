import __spark_entry__ as entry


def test_names_and_oracles():
    found = entry.queries()
    assert len(found) >= 50 and set(entry.oracle_sql()) <= set(found)


def test_primitive_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "documents", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("date_rule", "clean_and_split", "eval_field_metrics"):
        got = entry.queries()[name](spark, sf).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        assert len(got) == len(want) and set(got.columns) == set(want.columns)


def test_a_missing_module_of_the_operators_leaves_the_rest(monkeypatch, caplog):
    import sys

    for name in [m for m in sys.modules if m == "docloom.llm" or m.startswith("docloom.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    found = entry.queries()
    assert len(found) >= 50 and not any(n.startswith("op") or n == "pipeline" for n in found)
    if entry._there("docloom.llm"):
        assert "xxhash" in caplog.text
