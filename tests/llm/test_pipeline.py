"""The pipeline against a brute-force version of its stages."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from corpusforge.llm import langid as L
from corpusforge.llm import mixing as M
from corpusforge.llm import near_copies as N
from corpusforge.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_brute_force import plain_leaks

SYLLABLES = {"aa": "tha ing er on the and".split(), "bb": "ción que los ez ado".split()}
LEAK = "the first law of motion says that bodies at rest remain at rest until a force acts"


def documents():
    rng = random.Random(9)
    say = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say("aa" if i % 3 else "bb", 60), "aa" if i % 3 else "bb", "big" if i % 4 else "small") for i in range(1, 160)]
    rows += [(200 + i, rows[i][1], rows[i][2], "copies") for i in range(5)] + [(210 + i, rows[i][1] + " aa", rows[i][2], "copies") for i in range(5, 8)] + [(300, None, "aa", "big"), (301, "12 34", None, None), (302, say("aa", 20) + " " + LEAK + ".", "aa", "big"), (303, say("bb", 50), "bb", None)]
    return rows


def brute(spark, rows, docs):
    from tokenizers import Tokenizer

    langs, log_p = L.train(docs)
    keep = []
    for r in rows:
        if (g := L.trigrams(r[1])) and L.infer([g], log_p)[0].max() >= 0.5:
            keep.append(r)
    stay: list = []
    for r in sorted(keep):
        mine = set(N.shingles(r[1]).tolist())
        if not any(len(mine & other) >= 0.8 * len(mine | other) for other, _ in stay):
            stay.append((mine, r))
    keep = [r for _, r in stay if not plain_leaks(r[1], LEAK)]
    sizes = Counter(r[3] for r in keep)
    share = M.whole_weights({k: n**M.TEMPERATURE for k, n in sizes.items()})
    total, blocks = sum(share.values()), {k: -(-n // M.BLOCK) for k, n in sizes.items()}
    horizon = max(-(-blocks[k] * total // share[k]) for k in sizes)
    order = M.period(share)
    turns = Counter(order[s % total] for s in range(horizon))
    encoder = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for k, n in turns.items():
        out[k] = n
    return keep, out, blocks, encoder


def test_pipeline(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    keep, turns, blocks, encoder = brute(spark, rows, docs)
    got = sorted(P.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    texts = {r[0]: r[1] for r in keep}
    assert {r.doc_id for r in got} == set(texts) and not {300, 301, 302} & set(texts) and not {200, 201, 202, 203, 204, 215, 216, 217} & set(texts)
    seen, at = Counter(r.doc_id for r in got), 0
    for k, n in blocks.items():  # every document is there once for each whole turn of its source's blocks, or once more
        times = {seen[r[0]] for r in keep if r[3] == k}
        assert times <= {turns[k] // n, -(-turns[k] // n)} and min(times) >= 1
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    for r in got:
        ids = [*encoder.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words stand here {i} times and more", "en", "s", 9) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_ten_queries_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 11))
