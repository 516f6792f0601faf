"""Quotes in upper case, with letters whose upper case is longer than themselves, against the SQL of the queries."""

import duckdb
import pytest

from attestra.plans import registry


@pytest.mark.parametrize("name", ["quote_find", "quote_fuzzy"])
def test_upper_case_quotes_of_letters_with_a_longer_upper_case(spark, tmp_path, name):
    texts = ["Die große Straße führt außen vorbei an den Häusern. " * 4, "Ein Gruß ohne Anlaß: ﬁnal ŉ ᾳ ǰ", "Straße " * 90 + "große Füße draußen " * 20, "nothing of that kind"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "große Straße führt"), (4, "Gruß ohne Anlaß: ﬁnal ŉ ᾳ ǰ"), (7, "an den Häusern."), (2, "Die große")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    made = registry.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(made.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want) and len(want) >= 3
