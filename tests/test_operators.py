"""Operators on small hand-made rows."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions import text as X
from corpusforge.functions import vectors as V
from corpusforge.operators import evaluation, lexical, lifecycle, quality, representations, search, semantic
from corpusforge.plans import query as Q
from corpusforge.sources import ingest, tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_rules(spark):
    ids = X.identifiers(F.lit("FLUX.1 and Wan2.2 / wan_2.2, LTX-Video ltx-2.19b_ic.lora=detailer"))
    assert sorted(one(spark, ids)) == ["and", "flux1", "ltx219biclora=detailer", "ltxvideo", "wan22"]
    assert one(spark, X.compact(F.lit(" Wan\u00a02.2 (x)"))) == "wan22x"
    assert one(spark, X.alias_forms(F.lit("a b"))) == ["ab", "a b"]
    assert one(spark, X.hash_form(F.lit("a \r\nb\t\n\n"))) == "a\nb"
    assert one(spark, X.clip(F.lit("x  y " * 300))).endswith("…")
    assert one(spark, X.entity_type(F.lit(" "))) is None and one(spark, X.entity_type(F.lit("article"))) == "resource"
    assert one(spark, X.cites(F.lit("message:1, resource:2,bad,message:1"))) == [("message", "1"), ("resource", "2")]
    assert "abc" not in one(spark, X.redact_error(F.lit("bearer abc and token=abc, https://u:abcdef@h")))
    assert one(spark, X.entropy(F.lit("aabb"))) == pytest.approx(1.0) and one(spark, X.entropy(F.lit(""))) == 0
    assert 0 <= one(spark, X.contract_id(F.lit("a"), F.lit("b"))) < 1 << 63


def test_secrets(spark):
    shapes = {"private_key_block": "-----BEGIN " + "PRIVATE KEY-----", "provider_token_prefix": "AKIA" + "A1" * 8, "credential_assignment": "api_key = '" + "aB3" * 8 + "'", "credential_url": "https://me:" + "pa55word" + "@host/x", "aws_env_var": "AWS_SECRET_ACCESS_KEY=" + "A" * 20}
    for reason, text in shapes.items():
        assert reason in one(spark, X.secret_reasons(F.lit(text))), reason
        assert one(spark, X.public_state(F.lit(text))) == "quarantined"
        assert text not in one(spark, X.redact(F.lit(text)))
    assert one(spark, X.secret_reasons(F.lit("A" * 400))) == [] and one(spark, X.public_state(F.lit("a"))) == "safe"
    got = representations.find_secrets(spark.createDataFrame([(1, "x " + shapes["provider_token_prefix"]), (2, None)], "id long, t string"), "id", "t").collect()
    assert [(r.id, r.start, r.length) for r in got] == [(1, 2, 20)]


def test_query_planning(spark):
    assert Q.distinctive("show me the ltx workflow 42", 4) == ["me", "ltx"] and Q.distinctive("the 42", 4) == ["the"]
    w = Q.WebQuery.parse('"block swap" -deluxe OR settings')
    for said, hit in (("a block swap here", True), ("block swap deluxe", False), ("swap block", False), ("settings deluxe", True)):
        assert one(spark, w.matches(X.tokens(F.lit(said)))) is hit
    assert Q.check_query("x", 1000) == 100 and Q.candidate_limit(100) == 500 and Q.arms("wan2.2") == ["fts", "phrase", "identifier"]
    for bad in ("", "x" * 2001):
        with pytest.raises(ValueError):
            Q.check_query(bad)
    with pytest.raises(ValueError):
        Q.Filters(item_ids=["1"]).check()


def test_lexical_bands_and_collapse(spark):
    rows = [("article", "s", "1", "Wan 2.2 guide", "text", None, None), ("message", "s", "2", None, "use wan2.2 now", "bo", "chan"), ("article", "s", "3", "t", "about wan-2_2", None, None), ("article", "s", "4", "x", "none", None, None)]
    feed = spark.createDataFrame(rows, "kind string, source string, item_id string, title string, body string, author string, context string").withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("url", F.lit(""))
    got = {r.item_id: r["rank"] for r in lexical.banded(feed, "wan2.2").collect()}
    assert got == {"1": pytest.approx(0.95), "2": pytest.approx(0.90), "3": pytest.approx(0.93)}
    found = lexical.search(feed, "wan2.2").collect()
    assert len({(r.entity_type, r.item_id) for r in found}) == len(found) and [r.keyword_rank for r in sorted(found, key=lambda r: r.keyword_rank)] == list(range(1, len(found) + 1))
    assert {r.item_id for r in search.wide(feed, "guide wan2.2").collect()} == {"1", "2"}


def test_metrics(spark):
    results = spark.createDataFrame([(1, i + 1, k) for i, k in enumerate("abc")] + [(2, 1, "x"), (2, 2, "a")], "case_id long, rank int, key string")
    judged = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (1, "c", 1), (2, "a", 3), (3, "q", 1)], "case_id long, key string, grade int")
    got = {r.case_id: r for r in evaluation.per_case(results, judged).collect()}
    assert got[1].recall_at_1 == 0.5 and got[1].reciprocal_rank == 1 and got[1].average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert got[1].ndcg_at_10 == pytest.approx((3 + 1 / 2) / (3 + 1 / math.log2(3))) and got[2].reciprocal_rank == 0.5 and got[3].recall_at_10 == 0
    four = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert [round(four.agg(evaluation.percentile_linear("v", p)).first()[0], 2) for p in (0.5, 0.95, 0.99)] == [2.5, 3.85, 3.97]
    empty = F.array().cast("array<string>")
    assert one(spark, evaluation.set_precision(empty, F.array(F.lit("a")))) == 1 and one(spark, evaluation.set_recall(F.array(F.lit("a")), empty)) == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.0, 0.0]])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.distance, 6)) for r in semantic.nearest(rows, [1.0, 0.0], 5).collect()]
    assert got == [(0, 0.0), (1, 0.2), (2, 1.0)]
    tie = spark.createDataFrame([(1, "code", 0, 0.2), (1, "prose", 3, 0.2), (1, "prose", 1, 0.2), (2, "code", 0, 0.1), (2, "prose", 0, 0.4)], "item long, representation string, chunk_index int, distance double")
    assert {(r.item, r.representation, r.chunk_index) for r in semantic.collapse(tie, ["item"]).collect()} == {(1, "prose", 1), (2, "code", 0)}
    assert one(spark, V.trigram_similarity(F.lit("word"), F.lit("word"))) == 1 and one(spark, V.norm(V.hashing_embedding(F.lit("a b c")))) == pytest.approx(1)


def test_jobs(spark):
    op, t, f, n = F.lit, F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    kinds = lambda c: [(j["representation"], j["job_kind"]) for j in one(spark, c)]
    assert kinds(lifecycle.message_jobs(op("insert"), n, f, n)) == [("prose", "embed")] and kinds(lifecycle.message_jobs(op("insert"), n, t, n)) == []
    assert kinds(lifecycle.message_jobs(op("update"), f, t, t)) == [("prose", "drop")] and kinds(lifecycle.message_jobs(op("update"), f, f, t)) == [("prose", "reembed")]
    assert kinds(lifecycle.resource_jobs(op("update"), t, f, t, t)) == [("prose", "reembed"), ("code", "drop")]
    assert kinds(lifecycle.distillation_jobs(op("update"), F.lit("rejected"), F.lit("approved"), f)) == [("prose", "reembed")]
    assert [one(spark, lifecycle.backoff(F.lit(i))) for i in (0, 1, 3, 9)] == [10, 10, 40, 300]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!é", max_size=1500), st.integers(5, 60))
def test_prose_chunks_cover(text, target):
    chunks = representations.chunk_prose(text, target=target, overlap=3)
    assert representations.coverage_ok(text, [c[0] for c in chunks]) and chunks == representations.chunk_prose(text, target=target, overlap=3)


def test_code_chunks():
    code = "import os\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    pass\n"
    got = representations.chunk_code(code, target=8)
    assert all(c[1] == "ast" for c in got) and representations.coverage_ok(code, [c[0] for c in got]) and any(c[0].startswith("@dec") for c in got)
    assert {c[1] for c in representations.chunk_code("def (:\n" * 100)} == {"lines"} and representations.chunk_code(None) == []


def test_ingest():
    title, body = ingest.read_html('<title>T</title><meta property="og:title" content="O  G"><nav>menu</nav><p>One <b>two</b></p><script>x</script><p>three')
    assert (title, body) == ("O G", "One two\nthree")
    vtt = "WEBVTT\n\nNOTE x\ny\n\n1\n00:01.000 --> 00:02.000\n<c>so we</c>\n\n00:02.000 --> 00:03.000\nso we go\n\n00:03.000 --> 00:04.000\nwe go home\n"
    assert ingest.roll_up(ingest.caption_lines(vtt)) == ["so we go", "home"]
    api = '{"1": {"class_type": "K", "inputs": {"seed": 5, "m": ["2", 0]}}, "name": "x"}'
    assert ingest.graph_nodes(api) == [("K", "[5]")] and ingest.graph_nodes('{"nodes": [{"type": "L", "widgets_values": [1]}]}') == [("L", "[1]")] and ingest.graph_nodes("{") == []
    assert ingest.leaves('{"a": [1, {"b": "x"}], "c": true, "d": " "}') == ["1", "x"]


def test_reports_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {(r.k, r.v) for r in tables.upsert(a, b, ["k"], ["v"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert "| 1 | a |" in tables.markdown_report(a.orderBy("k")) and '"k": 1' in tables.json_report(a.orderBy("k"))
    with pytest.raises(ValueError):
        tables.json_report(a.withColumn("embedding", F.lit(1)))
    assert quality.hygiene(["id", "raw_content"]) == ["raw_content"]


def test_contributions(spark):
    from corpusforge.operators import contribute

    known = spark.createDataFrame([(1, "how do I load a model", None), (2, "what is a sampler", None)], "id long, question string, supersedes_id long")
    new = spark.createDataFrame([(10, "how do I load a model?", None), (11, "why is the sky blue", 2), (12, "where are my keys", 9), (13, "who goes there", None)], "id long, question string, supersedes_id long")
    assert {(r.id, r.status) for r in contribute.accept_distillations(new, known).collect()} == {(11, "pending"), (13, "pending")}
    assert contribute.near_questions(new, known).first()["known_id"] == 1
    for body, said in (("[1]", "request must be an object"), ("{", "request must be an object"), ('{"action": "x"}', "unknown action"), (None, "request must be an object")):
        assert one(spark, contribute.request_problem(F.lit(body).cast("string"))) == said
    assert contribute.public_view(spark.createDataFrame([(1, True, "p"), (2, None, "p")], "id long, is_deleted boolean, payload string")).collect() == [(2, None)]


def test_retrievers_bound_the_metrics(spark):
    from corpusforge.plans import retrievers as R

    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2)], "case_id long, key string, grade int")
    cases = spark.createDataFrame([(1, "x"), (2, "y")], "case_id long, query string")
    best = evaluation.per_case(R.oracle(judged)(None, cases, 10), judged).collect()
    assert all(r.ndcg_at_10 == pytest.approx(1) and r.reciprocal_rank == 1 and r.recall_at_10 == 1 for r in best)
    worst = {r.case_id: r.ndcg_at_10 for r in evaluation.per_case(R.oracle(judged, reverse=True)(None, cases, 10), judged).collect()}
    assert worst[1] < 1 and R.REGISTRY["stub"](None, cases, 5).count() == 0
    assert R.probed(lambda *a: 1 / 0, None, cases, 5)["outcome"] == "error: ZeroDivisionError"


def test_scans_are_pruned(spark, tmp_path):
    from corpusforge.plans.retrievers import plan_facts

    spark.range(10).selectExpr("id", "id AS x", "'t' AS body").write.parquet(f"{tmp_path}/t")
    facts = plan_facts(spark.read.parquet(f"{tmp_path}/t").where("x > 3").select("id"))
    assert "x" in facts["pushed"][0] and "body" not in facts["columns"][0] and not facts["python"]


def test_cursor_is_swapped_only_at_the_expected_version(spark):
    c = spark.createDataFrame([("a", 5, 1, 0), ("b", 5, 1, 0)], "source string, cursor long, version int, done int")
    u = spark.createDataFrame([("a", 1, 9, 4), ("b", 7, 9, 4)], "source string, expected_version int, cursor long, done int")
    assert {tuple(r) for r in lifecycle.advance(c, u).collect()} == {("a", 9, 2, 4, True), ("b", 5, 1, 0, False)}


def test_batch_and_stream_agree(spark):
    from corpusforge.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(sf):
        pytest.skip("no test tables here")
    stream = {(r.user_id, r.event_id) for r in QUERIES["stream_latest_state"](spark, sf).collect()}
    assert stream == {(r.user_id, r.event_id) for r in QUERIES["upsert_latest"](spark, sf).collect()}


def test_lsh_recall(spark):
    import numpy as np

    from corpusforge.operators import semantic

    v = np.random.default_rng(7).normal(size=(600, 64)).round(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 30 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = semantic.recall(semantic.lsh_candidates(rows, asked, 64), semantic.nearest_batch(rows, asked, 10, 64)).toPandas()["recall"]
    assert len(got) == 20 and got.mean() >= 0.9


def test_line_chunks_overlap():
    text = "\n".join(f"line {i} " + "x" * (i % 7) for i in range(200))
    got = representations.chunk_lines(text, target=50, overlap=10)
    rows = text.split("\n")
    assert len(got) > 5 and all(len(c[0]) <= 50 * 4 for c in got) and {c[1] for c in got} == {"window"}
    covered = set()
    for t, _, first in got:
        assert t.split("\n") == [x.strip() if i in (0, len(t.split("\n")) - 1) else x for i, x in enumerate(rows[first - 1 : first - 1 + len(t.split("\n"))])] or t.replace(" ", "") == "\n".join(rows[first - 1 : first - 1 + len(t.split("\n"))]).replace(" ", "")
        covered |= set(range(first - 1, first - 1 + len(t.split("\n"))))
    assert covered == set(range(200)) and all(b[2] < a[2] + len(a[0].split("\n")) for a, b in zip(got, got[1:]))
    assert representations.chunk_lines("one\ntwo") == [("one\ntwo", "single", 1)] and representations.chunk_lines(None) == []
    assert [c[0] for c in representations.chunk_lines("y" * 5000 + "\nend", target=50)] == ["y" * 5000, "end"]


def test_captions_that_come_twice():
    assert ingest.roll_up(["we go", "we go home", "go home now", "go home now", "home now then"]) == ["we go home", "now", "then"]


def test_composed_and_decomposed_letters_are_one(spark):
    for f in (X.compact, X.preserve, X.query_form, X.text_hash):
        assert one(spark, f(F.lit("Cafe\u0301 X"))) == one(spark, f(F.lit("Caf\u00e9 X")))
    assert one(spark, X.compact(F.lit(None).cast("string"))) is None and one(spark, X.nfc(F.lit("\uac00 \u1100\u1161"))) == "\uac00 \uac00"


def test_stores_and_limits(spark, tmp_path):
    from corpusforge.operators import contribute
    from corpusforge.plans.protocols import ParquetStore, RateLimiter

    store = ParquetStore(spark, f"{tmp_path}/store")
    store.write(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "item long, chunk int, t string"))
    store.replace(spark.createDataFrame([(1, 0, "new")], "item long, chunk int, t string"), ["item"])
    store.drop(spark.createDataFrame([(2,)], "item long"), ["item", "chunk"])
    assert sorted(map(tuple, store.read().collect())) == [(1, 0, "new"), (3, 0, "d")]
    now, slept = [0.0], []
    limit = RateLimiter(2, 10, lambda: now[0], slept.append)
    assert [limit.wait() for _ in range(3)] == [0, 0, 10] and slept == [10]
    key, row = contribute.issue_key(7)
    known = spark.createDataFrame([(row["api_key_hash"], 7, None)], "api_key_hash string, id long, revoked_at string")
    asked = spark.createDataFrame([(1, key), (2, key + "x")], "n int, api_key string")
    assert [(r.n, r.author_id) for r in contribute.authorised(asked, known).collect()] == [(1, 7)]


def test_search_documents_follow_their_sources(spark, tmp_path):
    from corpusforge.operators import search_index

    docs = spark.createDataFrame([(1, "The stupid. Text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = search_index.refresh(spark, str(tmp_path))
    assert first == search_index.refresh(spark, str(tmp_path)) and spark.read.parquet(first).count() == 3
    docs.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    second = search_index.refresh(spark, str(tmp_path))
    assert second != first and spark.read.parquet(second).count() == 4


def test_retrievers_answer_all_cases_in_one_plan(spark):
    from corpusforge.plans import retrievers as R

    rows = [("article", "s", "1", "Wan 2.2 guide", "text", None, None), ("message", "s", "2", None, "use wan2.2 now", "bo", "chan"), ("article", "s", "3", "t", "guide about it", None, None)]
    feed = spark.createDataFrame(rows, "kind string, source string, item_id string, title string, body string, author string, context string").withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("url", F.lit(""))
    cases = spark.createDataFrame([(1, "wan2.2"), (2, "guide"), (3, "nowhere"), (4, None)], "case_id long, query string")
    got = {(r.case_id, r["rank"], r.key) for r in R.REGISTRY["lexical"](feed, cases, 5).collect()}
    assert got == {(1, 1, "resource:1"), (1, 2, "message:2"), (2, 1, "resource:1"), (2, 2, "resource:3")}
    kept = R.fixture(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (9, 1, "c")], "case_id long, rank int, key string"))
    assert [tuple(r) for r in kept(None, cases, 1).collect()] == [(1, 1, "a")]
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    corpus = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(v)], "key string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.05])], "case_id long, embedding array<double>")
    for near in (R.by_vectors(2), R.by_vectors(2, approximate=True)):
        assert near(corpus, asked, 1).first()["key"] == "k0" or near(corpus, asked, 1).first()["key"] == "k1"
