"""Removal of repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusforge.llm import suffix_dedup as S


def brute(texts, length=200):
    """Removed mask of each text."""
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def digest(t, m):
    spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
    return len(t), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["er", "on", "th", "é", "a"]) for _ in range(rng.randint(1, 3)))
    said = lambda n: " ".join(word() for _ in range(n))
    shared = [said(n) for n in (40, 60, 90, 35)]
    out = [said(30) + s + said(20) for s in shared for _ in range(5)]
    near = said(200)
    out += [near, near[:300] + "X" + near[301:], near[50:], near + said(50), "a" * 500, "a" * 450 + "b", "ab" * 300, said(5), None, "", "short", "\0" * 260, "\0" * 230 + "\1", near[:200], near[:199]]
    edge = said(60)[:205]
    return out + [said(8) + edge[:k] + said(8) for k in range(196, 206)] + [out[-1]] * 2


def test_suffix_order_is_sorted():
    rng = random.Random(1)
    for kinds in ("ab", "abcdefgh ", "a"):
        parts = ["".join(rng.choice(kinds) for _ in range(rng.randint(1, 300))).encode() for _ in range(20)]
        text = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(lens), lens)
        got = S.suffix_order(text, ends, np.ones(len(text), bool), 300).tolist()
        keys = [bytes(text[i : ends[i]]) for i in got]
        assert sorted(got) == list(range(len(text))) and keys == sorted(keys)


@pytest.mark.parametrize("hot", [0, S.HOT])
def test_remove_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = list(enumerate(texts())) + [(None, "no id " * 60)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, row string, n_bytes int").repartition(4)
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(((i, *digest(t, m)) for (i, _), t, m in zip(rows, raw, brute(raw))), key=str)
    got = S.remove_repeats(df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert S.remove_repeats(df.limit(0)).count() == 0
