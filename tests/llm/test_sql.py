"""The operators that SQL can express, against their SQL: on the smallest tables and on odd rows."""

import duckdb
import pytest

from flowlark.llm import queries

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages")


def rows_of(spark, name, d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'' if d == DIR else '/*.parquet'}')")
    df = queries.queries()[name](spark, d)
    result = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    return sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))), sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got, want = rows_of(spark, name, DIR)
    assert got == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{i % 70}" for i in range(3000))
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c d", long, long + " end", "É é İ x y z q r", long.upper(), "x " * 50]
    spark.createDataFrame([(i + 1, t, [None, "en", "de"][i % 3], [None, "a"][i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    vectors = [None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [-1.0, 0.0]]
    spark.createDataFrame([(i + 1, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    html = [None, "", "a", "a", "é\r\n\r\n0\r\n", "é\r\n\r\n0\r\n", "long " * 30000]
    spark.createDataFrame([(i + 1, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows_match_sql(spark, odd, name):
    got, want = rows_of(spark, name, odd)
    assert got == want
