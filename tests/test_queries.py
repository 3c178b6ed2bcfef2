"""Every registered query runs on the smallest tables; those with SQL give the rows of DuckDB."""

import glob
import os

import pytest

from corpusforge.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    import pandas as pd

    cols = sorted(df.columns)
    norm = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([norm(x) for x in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """What no SQL tells is held against the plain functions, row by row."""
    from corpusforge.operators import representations as R
    from corpusforge.sources import ingest

    got = QUERIES[name](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    if name == "html_extract":
        assert {(r.page_id, r.title, r.body) for r in got} == {(i, *ingest.read_html(x)) for i, x in pages.items()}
    elif name == "chunking_equivalence":
        new, old = ({(i, k): c[0] for i, t in docs.items() for k, c in enumerate(f(t))} for f in (R.chunk_prose, R.chunk_lines))
        equal = sum(new.get(k) == t for k, t in old.items())
        assert [tuple(r) for r in got] == [(equal, len(old.keys() & new.keys()) - equal, len(new.keys() - old.keys()), len(old.keys() - new.keys()))] and equal
    else:
        texts, key, cut = (docs, "doc_id", R.chunk_prose) if name == "prose_chunks" else (pages, "page_id", R.chunk_code)
        assert name in ("prose_chunks", "code_chunks")
        assert {(r[key], r.chunk_index, r.chunk_text, r.method, r.start) for r in got} == {(i, k, *c) for i, t in texts.items() for k, c in enumerate(cut(t))}
        for i, t in texts.items():
            assert R.coverage_ok(t or "", [r.chunk_text for r in sorted(got, key=lambda r: r.chunk_index) if r[key] == i])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
