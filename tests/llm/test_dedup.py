"""Exact dedup and SimHash groups against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import exact_dedup as E
from corpusforge.llm import simhash as S

COLS = "doc_id long, text string, lang string, keep_id long, parts string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], COLS)


LONG = "\n".join(f"the quick era{i % 7} of rain {i} is on. And then" for i in range(4000))
ROWS = [(1, None), (2, ""), (3, "one two three four"), (4, "one two three four"), (5, "One two three four"), (6, LONG), (9, LONG), (7, LONG + "."), (None, "one two three four"), (None, "solo"), (3, "one two three four")]


@pytest.mark.parametrize("name", [None, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_exact_dedup(spark, name):
    got = sorted(map(tuple, E.exact_dedup(frame(spark, ROWS), name=name).collect()), key=str)
    want = []
    for i, t in ROWS:
        group = [j for j, u in ROWS if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_empty_and_chunks(spark):
    assert E.exact_dedup(frame(spark, [])).count() == 0
    got = frame(spark, [(1, LONG), (2, "x" * 20_000), (3, "short"), (4, "")]).select("text", E.chunks(F.col("text")).alias("c")).collect()
    for r in got:
        assert "".join(r.c) == r.text and all(len(c) <= E.MAX_CHARS for c in r.c)
    assert len(got[0].c) > 50


def brute_components(fps):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def brute_fp(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_fingerprint():
    for t in [None, "", " \t\n", "a", "A b", "a b c", "Ä b C d É e f", LONG[:3000]]:
        assert S.fingerprint(t) == brute_fp(t), t


def test_simhash_groups(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(120)) for _ in range(12)]
    rows = [(100 - i, b) for i, b in enumerate(base)]
    rows += [(200 + i, base[i % 12] + " extra") for i in range(20)] + [(300, None), (301, ""), (302, base[0]), (None, base[1]), (302, base[0])]
    fps = [brute_fp(t) for _, t in rows]
    root = brute_components(fps)
    want = []
    for (i, _), f, r in zip(rows, fps, root):
        ids = [j for (j, _), q in zip(rows, root) if q == r and j is not None]
        want.append((i, S._signed(f), min(ids, default=None)))
    got = S.simhash_groups(frame(spark, rows)).select("doc_id", "fp", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert S.simhash_groups(frame(spark, [])).count() == 0
    left = {r.doc_id for r in S.simhash_dedup(frame(spark, rows)).collect()}
    assert left == {c for _, _, c in want if c is not None}


def test_stars_match_brute_force_in_large_shards():
    rng = random.Random(3)
    mid = [rng.getrandbits(64) for _ in range(40)]
    fps = list({m ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for m in mid for _ in range(8)})
    root = brute_components(fps)
    for large in (10, 10_000):
        up = S._stars(fps, 3, 0, large)
        pairs = {(up.get(a, a) == up.get(b, b)) == (root[i] == root[j]) for i, a in enumerate(fps) for j, b in enumerate(fps)}
        assert pairs == {True}


@pytest.mark.parametrize("n", [10, 1 << 22, 1 << 30])
def test_every_link_shares_a_shard(n):
    rng = random.Random(n)
    masks = S.shard_masks(n)
    for _ in range(2000):
        a, b = rng.getrandbits(64), 0
        for i in rng.sample(range(64), 3):
            b |= 1 << i
        assert any(a & m == (a ^ b) & m for m in masks)


def test_components_of_a_chain(spark):
    from corpusforge.llm.common import components

    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(29)] + [(ids[i], ids[i + 1]) for i in range(30, 59)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (ids[:30], ids[30:]):
        assert {got.get(i, i) for i in part} == {min(part)}
