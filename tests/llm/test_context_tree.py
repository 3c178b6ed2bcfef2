"""Context-tree weighting: tables against a plain recursion, scores against a brute-force sum over whole texts."""

import math
import random

import numpy as np
import pytest

from corpusforge.llm import context_tree as C


def plain(lines, test):
    """log10 probability of a line under the weighted trees of lines, by plain recursion over dicts."""
    counts = {}
    for s in lines:
        for i in range(C.DEPTH, len(s)):
            for b in range(8):
                pre, bit = (1 << b) | (s[i] >> (8 - b)), s[i] >> (7 - b) & 1
                for d in range(C.DEPTH + 1):
                    counts.setdefault((s[i - d : i], pre), [0, 0])[bit] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    kids, memo = {}, {}
    for c, pre in counts:
        if c:
            kids.setdefault((c[1:], pre), []).append((c, pre))

    def weigh(node):
        if node not in memo:
            own = kt(counts[node])
            memo[node] = np.logaddexp(own, sum(map(weigh, kids[node]))) - math.log(2) if node in kids else own
        return memo[node]

    total = 0
    for i in range(C.DEPTH, len(test)):
        for b in range(8):
            pre, bit = (1 << b) | (test[i] >> (8 - b)), test[i] >> (7 - b) & 1
            p, left, last = 0, 1, 0.5
            for d in range(C.DEPTH + 1):
                node = (test[i - d : i], pre)
                if node not in counts:
                    break
                n = counts[node]
                last = (n[bit] + 0.5) / (sum(n) + 1)
                w = math.exp(kt(n) - math.log(2) - weigh(node)) if node in kids else 1
                p, left = p + left * w * last, left * (1 - w)
            total += math.log10(p + left * last)
    return total


def model(lines, n=None):
    keys, m = np.unique(C.keys_of(lines)[0], return_counts=True)
    m = m if n is None else n(m)
    names, logs = C.subtrees(keys, m)
    return keys, m, C.top_tables(*C._summed(keys & C._mask(C.TOP - 1), m.astype(float)), names, logs)


def lines_of(texts):
    return [C.line_of(t.encode()) for t in texts]


def test_costs_equal_plain_recursion():
    texts = ["the then the over", "été " + "a" * 9, "", "over the thenthe over\nthe"]
    keys, n, top = model(lines_of(texts))
    cost = dict(zip(keys.tolist(), C.costs(keys, n, top)))
    for t in texts:
        want = plain(lines_of(texts), C.line_of(t.encode()))
        assert sum(cost[k] for k in C.keys_of(lines_of([t]))[0].tolist()) == pytest.approx(want, abs=1e-8), t
    # Texts that were not learnt from: their contexts are in the trees without a count.
    for t in ["thx zzz", "overthe \x00\x00\x00\x00\x00\x00\x00 the"]:
        all_keys, inverse = np.unique(np.concatenate((keys, C.keys_of(lines_of([t]))[0])), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((n, np.zeros(len(inverse) - len(n)))))
        names, logs = C.subtrees(all_keys, counts)
        top = C.top_tables(*C._summed(all_keys & C._mask(C.TOP - 1), counts), names, logs)
        cost = dict(zip(all_keys.tolist(), C.costs(all_keys, counts, top)))
        assert sum(cost[k] for k in C.keys_of(lines_of([t]))[0].tolist()) == pytest.approx(plain(lines_of(texts), C.line_of(t.encode())), abs=1e-8), t


def test_bytes_sum_to_one():
    lines = lines_of(["banana band an"] * 3)
    keys, n, _ = model(lines)
    ctx = keys[keys & np.uint64(255) == ord("d")][0] & ~np.uint64(255)
    every = ctx | np.arange(255, dtype=np.uint64)  # 255 is no byte of UTF-8, but has its share
    both, inverse = np.unique(np.concatenate((keys, every, [ctx | np.uint64(255)])), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate((n, np.zeros(256))))
    top = C.top_tables(*C._summed(both & C._mask(C.TOP - 1), counts), *C.subtrees(both, counts))
    cost = C.costs(both, counts, top)
    assert (10 ** cost[(both & ~np.uint64(255)) == ctx]).sum() == pytest.approx(1, abs=1e-9)


def test_large_counts_stay_finite():
    for factor in (10**8, 10**12):
        keys, n, top = model(lines_of(["aaaa bbbb", "aaaa"]), lambda m: m * factor)
        odd = np.unique(np.concatenate((keys, keys & ~np.uint64(255) | np.uint64(ord("z")))))
        counts = np.zeros(len(odd))
        counts[np.searchsorted(odd, keys)] = n
        top = C.top_tables(*C._summed(odd & C._mask(C.TOP - 1), counts), *C.subtrees(odd, counts))
        cost = C.costs(odd, counts, top)
        assert np.isfinite(cost).all() and (cost <= 1e-12).all()


def test_lookup_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = C.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=float))
    got, lost = table(keys)
    there = np.setdiff1d(np.arange(len(keys)), lost)
    assert set(there) <= set(range(0, len(keys), 2)) and len(there) > 0.99 * len(keys) / 2
    assert (got[there] == there / 2).all() and (got[lost] == 0).all()


def rows_of(n=60):
    rng = random.Random(2)
    vocab = ["th" + "".join(rng.choice(["er", "on", "in", "at"]) for _ in range(rng.randint(0, 3))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(20)) + "\n Ünseen" * (i % 7 == 0), i % 5 == 1) for i in range(n)]
    return [*rows, (None, "The THE", None), (100, None, True), (101, "", False), (5, "qq\x0bzz", True), (5, "qq\x0bzz", True)]


@pytest.mark.parametrize("head,piece", [(0, 1 << 22), (5, 64), (1 << 21, 50)])
def test_scores(spark, monkeypatch, head, piece):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1.0, "x", 3, 4) for r in rows], "doc_id long, text string, held_out boolean, score double, word string, row int, key int")
    lines = [C.line_of((t or "").encode()) for _, t, h in rows if not h]
    train = [w for _, t, h in rows if not h for w in [*(t or "").encode().lower().split(), b""]]
    c, n = {w: train.count(w) for w in set(train)}, len(train)
    memo, want = {}, []
    for i, t, h in rows:
        words = [*(t or "").encode().lower().split(), b""]
        line = C.line_of((t or "").encode())
        if head == 0 or i in (1, 7, 5, None, 100):  # the plain recursion is slow
            memo[line] = plain(lines, line) if line not in memo else memo[line]
        want.append((i, bool(h), len(words), sum(w in c for w in words), n, sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (len(c) + 1))) for w in words), memo.get(line)))
    monkeypatch.setattr(C, "_PIECE", piece)
    got = sorted(map(tuple, C.score_documents(df, head=head, word_head=head).collect()), key=lambda r: str(r[:4]))
    for g, w in zip(got, sorted(want, key=lambda r: str(r[:4])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert w[6] is None or g[6] == pytest.approx(w[6], abs=1e-6)


def test_word_order_counts(spark):
    rows = [(i, "alpha beta gamma delta " * 5, False) for i in range(5)] + [(10, "alpha beta gamma delta", True), (11, "beta alpha delta gamma", True)]
    got = {r.doc_id: r for r in C.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[10].base_score == pytest.approx(got[11].base_score) and got[10].score > got[11].score + 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in C.score_documents(df).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == pytest.approx(5 * 8 * math.log10(0.5))
    assert C.score_documents(df.limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    from corpusforge.llm.queries import QUERIES

    rows = [r for r in QUERIES["op7_context_tree"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


class Worker:
    """Stands for a DataFrame, to run a map function here."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, form):
        return work


def test_counts_go_on_in_small_batches():
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["".join(chr(97 + rng.randrange(26)) for _ in range(9000)) + " the end" for _ in range(100)]
    table = pa.table({"text": texts, "held_out": [i % 5 == 1 for i in range(100)]})
    got = list(C._context_counts(Worker(), 64)(iter(table.to_batches(max_chunksize=10))))
    assert len(got) > 1 and all(b.nbytes < 6 << 20 for b in got)
    of = {}
    for b in got:
        for k, n, m in zip(*(c.to_pylist() for c in b.columns[1:])):
            for key, i, j in zip(np.frombuffer(k, "<u8").tolist(), np.frombuffer(n, "<u4").tolist(), np.frombuffer(m, "<u4").tolist()):
                x, y = of.get(key, (0, 0))
                of[key] = x + i, y + j
    every, m = np.unique(C.keys_of(lines_of(texts))[0], return_counts=True)
    learnt, n = np.unique(C.keys_of(lines_of(t for i, t in enumerate(texts) if i % 5 != 1))[0], return_counts=True)
    assert {k: y for k, (_, y) in of.items()} == dict(zip(every.tolist(), m.tolist()))
    assert {k: x for k, (x, _) in of.items() if x} == dict(zip(learnt.tolist(), n.tolist()))
