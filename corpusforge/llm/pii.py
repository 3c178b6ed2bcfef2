"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Base: fixed patterns find emails, ip addresses, card and phone numbers, leftmost and non-overlapping for each kind;
matches that fail their check are dropped. They are the seeds of the bootstrap. Strings of a looser shape (an email
with (at), a phone number without plus sign, a card number with a typing error, an IPv6 or longer address) are candidates.
The two words before a seed or candidate are its lexical pattern. Patterns and instances (kind and value) form a
graph: in each of ROUNDS rounds a pattern scores the mean of its instances' scores, shrunk by one instance, and an
instance that is no seed scores its best pattern that has SUPPORT. At the end, candidates behind a pattern of confidence
SURE and SUPPORT that overlap no base span are personal data too.

Spans are in code points, end exclusive. Nulls and the rest: null text counts as empty; a null doc_id is carried
along; repeated rows each get a row, and their values count once. An empty table gives no rows.

The patterns are written with possessive repeats, which give the same matches as the plain ones and take linear
time and no stack on very long texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5.0
SURE = 0.8

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match can begin where a run begins, or within one where the last match ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Single blanks and hyphens between digits become this character first; a card number then is one run.
_JOIN = ""
CARD = f"[0-9][0-9{_JOIN}]++"

#: Looser shapes: candidates of the bootstrap.
LOOSE = {
    "email": r"(?<![\w.%+@-])[\w.%+-]++ ?(?:\(at\)|\[at\]|\{at\}|@) ?[\w-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+_-])[0-9]{4}(?:[ -]?[0-9]{4}){2,3}[ -]?[0-9]{0,4}(?![0-9A-Za-z_-])",
    "phone": r"(?<![0-9A-Za-z.+_-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z_.-]?[0-9A-Za-z])",
}


def _let(value, use):
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values, combine, start):
    """combine of each value with all before it, in log n passes: what is combined over 2^k places is over 2^(k + 1) next."""

    def wider(held, k):
        return F.transform(held, lambda x, i: combine(x, F.coalesce(F.get(held, i - F.pow(F.lit(2), k).cast("int")), F.lit(start))))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), values, wider)


def spans(text, pattern: str):
    """Array of (s, e, m, b) of each match, in order: start, end, text, and what stands before it.

    b goes back to the third match before, 64 characters at most; it begins with a blank where the text begins.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda p: p["m"].isNotNull())

    def placed(p):
        ends = _running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda x, y: x + y, 0)
        tail = lambda c: F.substring(c, -64, 64)

        def before(x, i):
            one, two = F.get(p, i - 1), F.get(p, i - 2)
            head = F.when(i <= 2, " ").otherwise("")
            return tail(F.concat(head, *[F.coalesce(part, F.lit("")) for part in (tail(two["g"]), two["m"], tail(one["g"]), one["m"], tail(x["g"]))]))

        return F.zip_with(F.transform(p, lambda x, i: F.struct(x["m"].alias("m"), before(x, i).alias("b"))), ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"), x["b"].alias("b")))

    return _let(pairs, placed)


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits):
    """True if a string of digits passes Luhn's check."""

    def add(acc, i):
        d = F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text) -> dict:
    """The spans of each kind that pass their check."""
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")
    joined = F.regexp_replace(F.translate(text, _JOIN, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
    small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.when(text.contains("@"), spans(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda x: x["m"].rlike(rf"^{small}(?:\.{small}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][0-9 -]{12}"), F.filter(spans(joined, CARD), lambda x: F.when(F.length(_digits(x["m"])).between(14, 19), luhn(_digits(x["m"]))).otherwise(False))).otherwise(none),
        "phone": F.when(text.contains("+"), F.filter(spans(text, PHONE), lambda x: F.length(_digits(x["m"])).between(10, 15))).otherwise(none),
    }


def loose_spans(text) -> dict:
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")
    guard = {"email": text.rlike(r"@|\(at\)|\[at\]|\{at\}"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": text.rlike("[0-9][0-9 -]{10}"), "phone": text.rlike("[0-9][) .-]{1,2}[0-9]{3}")}
    return {k: F.when(guard[k], spans(text, LOOSE[k])).otherwise(none) for k in KINDS}


def _context(before):
    """The two words before a place, in lower case and without punctuation at their ends; none if they take over 60 characters."""
    two = F.regexp_extract(F.lower(F.translate(before, _JOIN, " ")), r"\s(\S+\s+\S+)\s*$", 1)
    return F.regexp_replace(F.regexp_replace(two, r"[^\p{L}\p{N}\s]+", ""), r"\s+", " ")


def _tagged(found: dict):
    return F.array_sort(F.concat(*[F.transform(found[k], _tag(n)) for n, k in enumerate(KINDS)]))


def _tag(n: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), F.lower(F.regexp_replace(x["m"], f"[\\s{_JOIN}-]+", "")).alias("v"), _context(x["b"]).alias("c"))


def _apart(base, loose):
    """The loose spans that overlap no base span, by running ends from the left and starts from the right."""
    most = (1 << 31) - 1

    def placed(every):
        ends = _running(F.transform(every, lambda x: F.when(x["t"] == 0, x["x"]["e"]).otherwise(-1)), lambda x, y: F.greatest(x, y), -1)
        starts = F.reverse(_running(F.transform(F.reverse(every), lambda x: F.when(x["t"] == 0, x["s"]).otherwise(most)), lambda x, y: F.least(x, y), most))
        free = F.zip_with(F.zip_with(every, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda p, s: F.when((p["x"]["t"] == 1) & (p["e"] <= p["x"]["s"]) & (s >= p["x"]["x"]["e"]), p["x"]["x"]))
        return F.filter(free, lambda x: x.isNotNull())

    of = lambda spans_, t: F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x.alias("x")))
    return _let(F.array_sort(F.concat(of(base, 0), of(loose, 1))), placed)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose: arrays of (s, k, e, v, c): start, kind number, end, value and context, in order."""
    text = F.col("_text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("base", _tagged(base_spans(text))).withColumn("loose", _tagged(loose_spans(text)))
    return rows.select("doc_id", "base", F.when(F.size("loose") > 0, _apart(F.col("base"), F.col("loose"))).otherwise(F.col("loose")).alias("loose"))


def confident_patterns(found: DataFrame) -> DataFrame:
    """k and c of the patterns that the bootstrap is sure of."""
    each = found.select(F.explode(F.concat(F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["c"].alias("c"), F.lit(1.0).alias("seed"))), F.transform("loose", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["c"].alias("c"), F.lit(0.0).alias("seed"))))).alias("x"))
    edges = stored(each.select("x.*").where("c != ''").groupBy("k", "v", "c").agg(F.max("seed").alias("seed")), "pii-edges")
    score = Stored(edges.groupBy("k", "v").agg(F.max("seed").alias("score")), "pii-score")
    patterns = None
    for _ in range(ROUNDS):
        heads = score.df.select(F.col("k").alias("k2"), F.col("v").alias("v2"), "score")
        weighed = edges.join(heads, F.expr("k = k2 AND v = v2")).groupBy("k", "c").agg(F.sum("score").alias("f"), F.count(F.lit(1)).alias("n"))
        patterns = stored(weighed.select("k", "c", "f", (F.col("f") / (F.col("n") + 1)).alias("sure")), "pii-patterns")
        strong = patterns.where(F.col("f") >= SUPPORT).select(F.col("k").alias("k2"), F.col("c").alias("c2"), "sure")
        risen = edges.join(strong, F.expr("k = k2 AND c = c2"), "left").groupBy("k", "v").agg(F.greatest(F.max("seed"), F.max(F.coalesce("sure", F.lit(0.0)))).alias("score"))
        before, score = score, Stored(risen, "pii-score")
        before.drop()
    return patterns.where((F.col("f") >= SUPPORT) & (F.col("sure") >= SURE)).select("k", "c")


def _said(all_spans):
    return F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, a count of base spans per kind, base (those spans) and spans (all), as kind:start:end."""
    found = stored(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    sure = confident_patterns(found)
    more = found.where(F.size("loose") > 0).select("row", F.explode("loose").alias("x")).join(sure, (F.col("x.k") == sure["k"]) & (F.col("x.c") == sure["c"]), "left_semi")
    more = more.groupBy("row").agg(F.collect_set("x").alias("new")).withColumnRenamed("row", "_row")
    rows = found.join(more, F.col("row") == F.col("_row"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(found.schema["base"].dataType))))
    counts = [F.size(F.filter("base", _is(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, _said(F.col("base")).alias("base"), _said(every).alias("spans"))


def _is(n: int):
    return lambda x: x["k"] == n
