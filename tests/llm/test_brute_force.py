"""Language proportions and template windows against plain loops."""

import math
import random

import numpy as np
import pytest
import regex

from corpusforge.llm import decontamination as D
from corpusforge.llm import langid as L


def plain_infer(cells, counts, log_p):
    """Proportions by EM over all languages, the weakest dropped again and again; the best penalised set."""
    k, total = log_p.shape[1], int(counts.sum())
    cost = L.PENALTY * math.log1p(total)
    p = np.exp(log_p[cells].astype(float))
    alone = (np.log(p) * counts[:, None]).sum(axis=0)
    best, share = alone.max() - cost, np.eye(k)[alone.argmax()]
    allowed = list(range(k))
    while len(allowed) > 1:
        w = np.full(len(allowed), 1 / len(allowed))
        for _ in range(L.ROUNDS):
            z = p[:, allowed] * w
            w = (z / z.sum(axis=1, keepdims=True) * counts[:, None]).sum(axis=0) / total
        got = float((np.log(p[:, allowed] @ w) * counts).sum()) - cost * len(allowed)
        if got > best:
            best, share = got, np.zeros(k)
            share[allowed] = w
        allowed.pop(int(w.argmin()))
    return share


def test_proportions_equal_plain_em():
    rng = random.Random(3)
    kinds = ["the ing and of to".split(), "el que los ado y".split(), "der und sch ein zu".split()]
    say = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    counts = np.zeros((L.BUCKETS, 3))
    for k in range(3):
        at, n = L.trigrams(say(k, 3000))
        counts[at, k] = n
    log_p = np.log((counts + L.SMOOTH) / (counts.sum(axis=0) + L.SMOOTH * L.BUCKETS)).astype(np.float32)
    texts = [say(k, n) for k in range(3) for n in (1, 5, 60)] + [say(0, 50) + " " + say(1, 50), say(0, 90) + " " + say(2, 10), " ".join(say(k, 40) for k in range(3)), "qq"]
    grams = [L.trigrams(t) for t in texts]
    got = L.infer(grams, log_p)
    for g, row in zip(grams, got):
        assert row == pytest.approx(plain_infer(*g, log_p), abs=2e-3)
    assert sum((r > 0.05).sum() > 1 for r in got) >= 2


UNIT = rf"(?i)([0-9])\s?({D.UNITS})(?![\p{{L}}\p{{N}}])"


def plain_words(text):
    """(mark or None, value) of each word."""
    t = regex.sub(UNIT, lambda m: f"{m[1]} \x03{m[2]} ", text or "")
    t = regex.sub(r"[0-9]+(?:[.,:/][0-9]+)*", lambda m: f" \x02{m[0]} ", t)
    t = regex.sub(r"(?<=[\p{Ll},;] )\p{Lu}\p{L}+", lambda m: f"\x04{m[0]}", t).lower()
    parts = regex.findall(r"[\p{L}\p{N}\x02-\x04]+(?:(?<=[0-9])[.,:/](?=[0-9])[\p{L}\p{N}\x02-\x04]+)*", t)
    return [(w[0], w[1:]) if w < "\x05" else (None, w) for w in parts]


def plain_leaks(doc, item):
    d, b = plain_words(doc), plain_words(item)
    literal = lambda ws: sum(m is None for m, _ in ws)
    said = [v for _, v in b]
    if b and (literal(b) < D.MIN_WORDS or len(b) <= D.WINDOW) and any([v for _, v in d[i : i + len(b)]] == said for i in range(len(d) - len(b) + 1)):
        return True
    if literal(b) < D.MIN_WORDS:
        return False
    size, shape = min(D.WINDOW, len(b)), lambda ws: [m or v for m, v in ws]
    windows = [j for j in range(len(b) - size + 1) if literal(b[j : j + size]) >= min(D.MIN_LITERAL, math.ceil(size / 2))]
    found, most = set(), 0
    for off in range(-len(b), len(d)):
        hits = [j for j in windows if 0 <= j + off <= len(d) - size and shape(d[j + off : j + off + size]) == shape(b[j : j + size])]
        pairs = {(x[1], y[1]) for j in hits for x, y in zip(b[j : j + size], d[j + off : j + off + size]) if x[0]}
        copied = [j for j in hits if b[j : j + size] == d[j + off : j + off + size]]
        run, first = 0, None
        for a, j in enumerate(copied):
            first = j if a == 0 or j - copied[a - 1] > D.WINDOW else first
            run = max(run, j + D.WINDOW - first)
        same = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
        if same or run >= D.RUN:
            found |= set(hits if same else copied)
            most = max(most, run)
    return bool(windows) and (len(found) / len(windows) >= D.LEAST or most >= D.RUN)


def test_leaks_equal_plain_loops(spark):
    rng = random.Random(8)
    vocab = "the train leaves town and Anna has seen 12 of 30 km or 5.5 kg while Zoe paid 7 dollars, some words more: no 3/4".split()
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice((1, 3, 6, 8, 9, 14, 25)))) for i in range(25)]
    swap = lambda t: t.replace("12", "99").replace("Anna", "Bert").replace("km", "miles")
    docs = []
    for i in range(120):
        body = rng.choice(items)[1]
        cut = body.split()
        cut = " ".join(cut[: rng.randint(max(1, len(cut) // 3), len(cut))])
        docs.append((i, " ".join((say(rng.randint(0, 12)), rng.choice((body, cut, swap(body), swap(cut), "")), say(rng.randint(0, 12))))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    want = {(i, k) for i, t in docs for k, x in items if plain_leaks(t, x)}
    assert got == want and len(want) > 100
