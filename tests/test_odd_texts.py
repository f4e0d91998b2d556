"""Queries on texts with letters beyond ASCII, beside their SQL."""

import duckdb
import pytest

from screenlake.plans import registry

TEXTS = {
    "prose_violations": ["seit é2019-05-06 und 2019-05-07ß", "éCondition.entry[3].code", "日2020-01-01日 5", "plain 12 -3", None],
    "span_claims": ["weiße Straße ging\nss\nxx", "STRASSE oben\nStraße\n- Straße oben\n  - a", "Straße\nSTRASSE\nstraße", None],
    "span_coverage": ["weiße Straße ging\nss\nxx", "STRASSE oben\nStraße\n- Straße oben\n  - a", "Straße\nSTRASSE\nstraße", None],
}


@pytest.mark.parametrize("name", TEXTS)
def test_odd_letters_are_read_as_by_the_sql(spark, tmp_path, name):
    rows = [(i, x) for i, x in enumerate(TEXTS[name], 1)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.SQL[name]).fetchall())
