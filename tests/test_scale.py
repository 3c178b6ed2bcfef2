"""Steps whose cost once grew beyond their input: results as before, by hand or by brute force."""

import numpy as np

from corpusforge.operators import semantic


def _vectors(spark, n: int, dimension: int = 8):
    """Rows with ties: every vector comes twice, and some are far from length one."""
    v = np.random.default_rng(3).normal(size=(n // 2, dimension)).round(2)
    v = np.concatenate([v, v]) * np.where(np.arange(n) % 5 == 0, 1e-120, 1.0)[:, None]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_nearest_batch_in_blocks_of_queries_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BROADCAST_QUERIES", 7)  # more queries than this were refused
    monkeypatch.setattr(semantic, "TILE", 16)
    v, rows = _vectors(spark, 120)
    asked = rows.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r.query_id, r.semantic_rank): (r.vec_id, round(r.distance, 9)) for r in semantic.nearest_batch(rows, asked, 6, 8).collect()}
    want = {}
    for i in range(0, 120, 4):
        d = [1 - sum(a * b for a, b in zip(x, v[i])) / (sum(a * a for a in x) ** 0.5 * sum(a * a for a in v[i]) ** 0.5) for x in v.tolist()]
        for rank, j in enumerate(sorted(range(120), key=lambda j: (d[j], j))[:6]):
            want[i, rank + 1] = j, round(d[j], 9)
    assert got == want


def test_nearest_batch_with_odd_vectors(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), (None, [0.0, 2.0])], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, None]), (4, [0.0, 0.0])], "query_id long, query array<double>")
    got = [tuple(r) for r in semantic.nearest_batch(rows, asked, 2, 2).orderBy("query_id", "semantic_rank").select("query_id", "vec_id", "distance").collect()]
    assert got == [(1, "a", 0.0), (1, "b", 0.0)] + [(q, x, None) for q in (2, 3, 4) for x in (None, "a")]
    assert semantic.nearest_batch(rows.limit(0), asked, 2, 2).count() == 0 and semantic.nearest_batch(rows, asked.limit(0), 2, 2).count() == 0


def test_lsh_found_is_what_lsh_candidates_lists(spark):
    v, rows = _vectors(spark, 200)
    asked = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    pairs = rows.select("vec_id").crossJoin(asked.select("query_id"))
    how = {"tables": 2, "bits": 4}
    want = {tuple(r) for r in semantic.lsh_candidates(rows, asked, 8, **how).collect()}
    got = [tuple(r) for r in semantic.lsh_found(pairs, rows, asked, 8, **how).collect()]
    assert set(got) == want and len(got) == len(want) and 0 < len(got) < 4000


def test_search_documents_write_no_bodies(spark, tmp_path, monkeypatch):
    from corpusforge.operators import lexical, search_index

    said = ["Wan-2.2 and more" + " of the text" * 400, "o f the", None, ""]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(said)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "of.the"), (1, 1, "user", "often")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(search_index, "shared_dir", lambda spark: f"{tmp_path}/shared")
    rows = search_index.search_documents(spark, str(tmp_path))
    assert {r.item_id for r in lexical.banded(rows, "of the").collect()} == {"0", "1", "1-0"}
    assert {r.item_id for r in lexical.ident_arm(rows, "of the").collect()} == {"1", "1-0"}  # the first sentence of document 0 ends before it
    assert not (tmp_path / "shared").exists()
    stored = spark.read.parquet(search_index.refresh(spark, str(tmp_path)))
    assert not set(search_index.OF_BODIES) & set(stored.columns)
    both = [{tuple(r) for r in search_index.prepared(x).select(*sorted(rows.columns)).collect()} for x in (stored, rows)]
    assert both[0] == both[1] and len(both[0]) == 7


def test_compact_contains_is_compact_that_contains(spark):
    from pyspark.sql import functions as F

    from corpusforge.functions import text as X

    said = ["of the", "OF- the", "o.f(t)he", "often", "of\x1cthe", "caf é x", "a+b", "aab", "\U0001f600 \U0001f600", "", None]
    for key in ("ofthe", "café", "a+b", "\U0001f600\U0001f600", "é"):
        rows = spark.createDataFrame([(x,) for x in said], "t string").select(X.compact_contains("t", key).alias("a"), X.compact("t").contains(key).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_stored_tables_have_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from corpusforge.llm.common import ROW_GROUP, Stored

    said = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(16)])
    table = Stored(spark.range(0, 60_000, 1, 1).select("id", said.alias("text")), "groups")  # some 60 MB in one task
    meta = pq.read_metadata(glob.glob(f"{table.path}/*.parquet")[0])
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 1.5 * ROW_GROUP and table.df.count() == 60_000
    table.drop()
