"""Operators and stages beside columns that are called like those they make for themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusforge.llm import chat, exact_dedup, langid, mixing, pii, simhash, suffix_dedup, token_file
from corpusforge.llm import context_tree as C
from corpusforge.llm import decontamination as D
from corpusforge.llm.common import unused, without
from corpusforge.llm.queries import tokenizer_path

NAMES = ["score", "lang_pred", "slot", "epoch", "place", "block_no", "_n", "_gone", "row", "word", "_key", "_i", "_slot", "_w", "_turn", "_rank", "_h", "_b", "_row", "_c", "h", "keys", "fp", "s", "k", "t", "w", "i", "base", "kept", "at", "runs", "held_out_"]
TEXTS = [(1, "the first words of a text stand here for all to see"), (2, "the first words of a text stand here for all to see"), (3, None), (4, ""), (None, "el otro texto dice otra cosa que nadie ha visto")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i else "es", "s", 9) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


def mine(df):
    return all(r[n] == f"mine {n}" for r in df.collect() for n in NAMES)


def test_stages_leave_other_columns_alone(spark, docs, tmp_path):
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() >= 1 and mine(out)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(TEXTS)


def test_operators_ignore_or_carry_other_columns(spark, docs):
    bench = spark.createDataFrame([(1, TEXTS[0][1], "x", "y")], "item_id long, text string, w string, doc_id string")
    assert {r.doc_id for r in D.contaminated(docs, bench).collect()} == {1, 2}
    left = D.decontaminate(docs, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "None"] and mine(left)
    one = simhash.simhash_dedup(docs)
    assert {r.doc_id for r in one.collect()} >= {1, 3} and mine(one)
    mixed = mixing.schedule(docs)
    assert mixed.count() >= len(TEXTS) and {r._n for r in mixed.collect()} == {"mine _n"}
    known = langid.identify(docs, langid.train(docs))
    assert {r.doc_id: r.lang_pred for r in known.collect()}[3] == "und"
    for f in (exact_dedup.exact_dedup, simhash.simhash_groups, pii.find_pii, suffix_dedup.remove_repeats, lambda d: C.score_documents(d.withColumn("held_out", F.lit(False))), lambda d: token_file.tokenize(d, tokenizer_path())):
        assert f(docs).count() == len(TEXTS)
    turns = docs.select(F.lit(7).cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("turn"), F.lit("us\ner").alias("role"), "text", *NAMES)
    assert chat.read_back(chat.format_chat(chat.events_of(turns)), in_order=True).first()["n_turns"] == len(TEXTS)


def test_names_that_are_free():
    assert unused(["_gone", "A"], "_gone", "a", "b", "B") == ["_gone_", "a_", "b", "B_"]


def test_null_ids_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (5, "c", 3)], "doc_id long, text string, _gone int")
    key = F.xxhash64("doc_id", "text")
    assert sorted(r.text for r in without(df, df.where("text = 'a'").select(key), key).collect()) == ["b", "c"]


def test_many_spans_take_linear_work(spark):
    n = 20_000
    text = " ".join(f"u{i}@mail.org" for i in range(n))
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == n and r.base.endswith(f"email:{len(text) - len(f'u{n - 1}@mail.org')}:{len(text)}")
