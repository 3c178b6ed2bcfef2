"""Personal data: base patterns against Python's re, and the bootstrap."""

import random
import re

from corpusforge.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        tot = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and tot % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    out = [(m.start(), n, m.end()) for n, k in enumerate(P.KINDS) for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]
    return ",".join(f"{P.KINDS[n]}:{s}:{e}" for s, n, e in sorted(out))


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "b", "s") for i, t in texts], "doc_id long, text string, base string, spans string")
    return P.find_pii(df).collect()


def test_base_matches_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a", ".", "@", "b.c", "1", "42", " ", "-", "+", "(5)", "_", "é😀", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "300.1.2.3", "+1 (555) 123-4567", "x@y.z", "", "  ", "0", "007.8.9.1"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    texts += [(1000, None), (None, "m@n.op"), (1001, "1 2 " * 20_000 + "x"), (1002, "a" * 100_000 + " " + "1" * 100_000), (1003, "a@" + "b." * 20_000 + "c"), (1003, "a@b.c"), (1004, "a@b.c_d@e.f.@g.h")]
    got = run(spark, texts)
    assert len(got) == len(texts)
    want = sorted((str(i), brute(t)) for i, t in texts)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    for r in got:
        assert r.n_email == r.base.count("email:") and r.n_ip == r.base.count("ip:") and r.n_card == r.base.count("card:") and r.n_phone == r.base.count("phone:")
        assert set(r.base.split(",")) - {""} <= set(r.spans.split(","))


def test_bootstrap_finds_unseen_identifiers(spark):
    texts = [(i, f"Words before. Please write to me{i % 2}@mail{i}.org or call us: +1 555 01{i:02d} 99{i % 10}1 now") for i in range(20)]
    texts += [(100, "Please write to jane (at) mail.org today"), (101, "or call us 555-123-4567."), (102, "the table has 555-123-4567 rows"), (103, "jane (at) mail.org"), (104, None)]
    got = {r.doc_id: r.spans for r in run(spark, texts)}
    assert got[100] == "email:16:34" and got[101] == "phone:11:23"
    assert got[102] == got[103] == got[104] == ""
    assert all(got[i].count(":") == 4 for i in range(20))


def test_empty(spark):
    assert run(spark, []) == []
