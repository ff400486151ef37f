import sys

import duckdb
import pytest

from quillspark.plans import catalog, catalog_more, oracle

QUERIES, SQL = catalog.QUERIES | catalog_more.QUERIES, oracle.SQL | catalog_more.SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    return sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_stored_vector_search_is_exact_beyond_one_list(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS vec_id, CAST(i % 5 AS INTEGER) AS label, list_transform(range(8), lambda x: CAST(sin(i * 12.9898 + x * 78.233) * 43758.5453 % 1 AS FLOAT)) AS embedding FROM range(2500) t(i)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert rows(QUERIES["stored_vector_search"](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL["stored_vector_search"]).df()[["query", "key", "score", "rank"]])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["item_id", "doc_id", "score", "rank", "matched_terms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_limit_stays_below_the_filter(spark):
    plan = catalog.tfidf_rerank_filtered(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rank" in plan and "lang" in plan


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = catalog.token_stats(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan


def test_library_does_not_import_the_training_operators():
    import subprocess

    code = "import sys; import quillspark.plans.catalog, quillspark.plans.oracle, quillspark.sources.knowledge, quillspark.sources.sinks, quillspark.operators.split; print(any(m.startswith('quillspark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"
