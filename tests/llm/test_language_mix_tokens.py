"""Language id, mixing and token files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import langid as L
from corpusforge.llm import mixing as M
from corpusforge.llm import token_file as K
from corpusforge.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, score double"
SYLLABLES = {"aa": "tha ing er on the and".split(), "bb": "ción que los ez ado".split(), "cc": "ung sch keit eine ü".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, l, 40), l, "s", 9.0) for i, l in enumerate(list(SYLLABLES) * 12)]
    train = spark.createDataFrame([*rows, (90, None, "aa", None, None), (91, "x y", None, None, None)], DOCS)
    model = L.train(train)
    assert model[0] == ["aa", "bb", "cc"]
    mixed = sentence(rng, "aa", 300) + " " + sentence(rng, "bb", 100)
    cases = [(1, sentence(rng, "aa", 30)), (2, sentence(rng, "bb", 30)), (3, mixed), (4, None), (5, ""), (6, "12 34 !"), (None, sentence(rng, "cc", 4)), (7, sentence(rng, "cc", 200_000)), (1, "the")]
    docs = spark.createDataFrame([(i, t, None, None, 0.1) for i, t in cases], DOCS)
    got = {(r.doc_id, r.text): r for r in L.identify(docs, model).collect()}
    assert len(got) == len(cases)
    pred = [got[c].lang_pred for c in cases]
    assert pred == ["aa", "bb", "aa", "und", "und", "und", "cc", "cc", "aa"]
    assert [got[c].score for c in cases[3:6]] == [0, 0, 0] and all(0 <= got[c].score <= 1 for c in cases)
    assert 0.65 < got[cases[2]].score < 0.85 and got[cases[0]].score == 1
    kept = {r.doc_id for r in L.keep_identified(train).collect()}
    assert 90 not in kept and kept >= {i for i, *_ in rows}


def test_language_id_learns_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    model = L.train(empty)
    assert L.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "words", None, None, None)], DOCS)
    assert L.identify(one, model).first().lang_pred == "und"


def test_trigrams_do_not_depend_on_blocks(monkeypatch):
    text = sentence(random.Random(2), "bb", 3000) + ". 12  x"
    whole = L.trigrams(text)
    monkeypatch.setattr(L, "_BLOCK", 101)
    part = L.trigrams(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


@pytest.mark.parametrize("target", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {i: i + 1 for i in range(40)}, {"x": 0.7, None: 0.3}])
def test_period_keeps_every_source_within_one_block(target):
    w = M.whole_weights(target, 500)
    total, got = sum(w.values()), {k: 0 for k in w}
    for t, k in enumerate(M.period(w), 1):
        got[k] += 1
        assert all(abs(got[s] - w[s] * t / total) < 1 for s in w)
    assert got == w


def test_schedule_against_simulation(spark):
    rows = [(i, f"t{i}", "l", s, 0.0) for i, s in enumerate(["big"] * 90 + ["mid"] * 31 + [None] * 7 + ["one"])] + [(None, None, None, "mid", None), (5, "t5", "l", "big", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"big": 4, "mid": 3, None: 2, "one": 1}
    got = M.schedule(docs, weights, block=4).collect()
    share = M.whole_weights(weights)
    order, total = M.period(share), sum(share.values())
    sizes = {s: sum(r[3] == s for r in rows) for s in weights}
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    horizon = max(-(-blocks[s] * total // share[s]) for s in weights)
    seen, want = {s: 0 for s in weights}, set()
    for slot in range(horizon):
        s = order[slot % total]
        b = seen[s] % blocks[s]
        want |= {(s, slot, seen[s] // blocks[s], b, p) for p in range(min(4, sizes[s] - 4 * b))}
        seen[s] += 1
    assert sorted(map(str, want)) == sorted(str((r.source, r.slot, r.epoch, r.block_no, r.place)) for r in got)
    assert all(n >= b for n, b in zip(seen.values(), blocks.values()))
    first = [(r.doc_id, r.text) for r in got if r.epoch == 0]
    assert sorted(map(str, first)) == sorted(str(r[:2]) for r in rows)
    again = {}
    for r in got:  # a document keeps its place in every epoch
        if r.doc_id not in (None, 5):
            assert again.setdefault(r.doc_id, (r.block_no, r.place)) == (r.block_no, r.place)
    assert M.schedule(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.schedule(docs, {"big": 1})


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in [np.empty(0), np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 70_000, 5000), rng.integers(0, 200, 1500), np.full(2000, 300)]:
        ids = ids.astype(np.uint32)
        s = K.Segment(K.pack_segment([3, None], [ids, ids[:7]]))
        assert s.doc_ids == [3, None] and (s.document(0) == ids).all() and (s.document(1) == ids[:7]).all()
        for i in range(0, len(ids), 97):
            assert s.token(i) == ids[i]
        for a, b in [(0, 1), (5, 600), (511, 513), (1000, 1400)]:
            assert (s.tokens(min(a, len(ids)), min(b, len(ids))) == ids[a:b]).all()


TEXTS = ["It's the Lord's, isn't it?\nNo.", "", None, "   ", "ÜBER straße ΑΣΣ İx xİ. xİ", "a b c\tD", "<|endoftext|> x<|startoftext|>y", "é ño Ä", "12 345 $9,99 ***%%%", "日本語 text 😀 ok", "x" * 3000, "word " * 5000]


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    enc = K.WordEncoder(tokenizer_path())
    for x in TEXTS + [f"{a} {b}" for a in TEXTS if a for b in TEXTS if b and len(a) + len(b) < 99]:
        want = t.encode((x or "").encode("utf-16", "surrogatepass").decode("utf-16"), add_special_tokens=False).ids
        assert enc.encode((x or "").encode("utf-16", "surrogatepass").decode("utf-16")).tolist() == want, x


def test_words_are_encoded_once(monkeypatch):
    enc, sent = K.WordEncoder(tokenizer_path()), []
    learn = K.WordEncoder._learn
    monkeypatch.setattr(K.WordEncoder, "_learn", lambda self, new: sent.append(len(new)) or learn(self, new))
    rng = random.Random(3)
    words = list({"".join(rng.choices("abcdefgh", k=7)) for _ in range(420_000)})
    batches = [pa.array([" ".join(words[at : at + 5000])]) for at in range(0, 320_000, 5000)]
    first = [enc.encode_all(b)[0] for b in batches]
    again = [enc.encode_all(b)[0] for b in batches]
    assert sum(sent) == 320_000
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    monkeypatch.setattr(K, "CACHE", 100_000)  # little memory: words are forgotten, not lost
    assert all((enc.encode_all(b)[0] == a).all() for a, b in zip(first, batches)) and len(enc.known) <= 5000


def test_letters_pass_without_places():
    """Words of letters get the same ids, and each its own, by the library's quick way, and where no token ends a word."""
    enc, marks = K.WordEncoder(tokenizer_path()), K.WordEncoder(tokenizer_path())
    marks.last[:] = False
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("aeinrstäöñçéœȷ", k=rng.randint(1, 30))) for _ in range(3000)} | {"a" * 400})
    want = [e.ids for e in enc.whole.encode_batch(words, add_special_tokens=False)]
    for by in (enc, marks):
        ids, lens = by._encode_letters(pa.array(words))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want
    none = enc._encode_letters(pa.array([], pa.string()))
    assert [len(x) for x in none] == [0, 0]


def test_tasks_leave_no_memory():
    """What a worker holds after a task does not grow with the number of tasks that it has run."""
    from corpusforge.llm.common import give_back

    rng, held = random.Random(5), []
    texts = pa.array([" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(60_000))])
    for _ in range(9):
        enc = K.encoder(tokenizer_path())
        enc.encode_all(texts)
        enc.forget()
        assert len(enc.known) == len(enc.ids) == len(enc.starts) == len(enc.lens) == 0
        del enc
        give_back()
        with open("/proc/self/smaps_rollup") as f:
            held.append(sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024)
    assert held[-1] - held[2] < 8, held


def test_small_tables_start_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "l", ["a", "b", None][i % 3], 0.0) for i in range(30)], DOCS)
    want = sorted(map(str, M.schedule(docs).collect()))

    def raises(*args, **how):
        raise AssertionError("rows of the driver went through Python workers")

    monkeypatch.setattr(spark.sparkContext, "parallelize", raises)
    assert sorted(map(str, M.schedule(docs).collect())) == want and len(want) >= 30
    assert K.tokenize(docs, tokenizer_path()).count() == 30
    assert M.schedule(docs.limit(0)).count() == K.tokenize(docs.limit(0), tokenizer_path()).count() == 0


def test_token_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [x if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16") for x in TEXTS]
    rows = [(50 - i, x, None, None, None) for i, x in enumerate(texts)] + [(None, "no id", None, None, None), (50, "again", None, None, None), (-3, "least", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for how in ({}, {"segment": 100}):
        got = sorted(K.tokenize(docs, tokenizer_path(), **how).collect(), key=lambda r: r.start)
        at = 0
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        for r, (i, x, *_) in zip(got, order, strict=True):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert K.tokenize(docs.limit(0), tokenizer_path()).count() == 0
