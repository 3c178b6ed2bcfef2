"""Benchmark decontamination by template windows (DataFrame operations only).

Texts are made templates: numbers, units after a number and names (capitalised words inside a sentence) become typed
placeholders, so that a question with other numbers or names keeps its template. All windows of WINDOW template words
of all documents are hash-joined with those of the benchmark (a shorter item is one window). Hits on one alignment of
a document with an item must fill slots consistently: a value of the item always becomes one value of the document,
and the other way round. A document that covers LEAST of an item's windows by consistent alignments is contaminated, and so
is one that holds RUN words of it in a row with their own values. Templates of items with under MIN_WORDS literal words
tell nothing: these, and items no longer than a window, are searched as a whole by their plain words too.

Nulls and the rest: null text has no window. Windows with under MIN_LITERAL literal words (or half of a short item) are
too common to tell and are not searched. An item of a single word is found wherever the word stands. A row is known by a hash of its doc_id and text, so rows
that share a doc_id (or have none) are documents of their own; a leak is told once per doc_id and item. Other columns,
whatever their names, are carried along by decontaminate and ignored otherwise. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import stored, without

WINDOW = 8
LEAST = 0.5
MIN_WORDS = 4
MIN_LITERAL = 4
#: Words copied in a row that make a leak whatever the item's length.
RUN = 13
#: Most benchmark windows that are broadcast, about 150 bytes each; beyond, hashes and places of all windows are shuffled
#: (Spark puts a Bloom filter of the benchmark's hashes before them where it pays) and hits fetch their words.
BROADCAST_WINDOWS = 400_000
#: Unit words that make a typed placeholder after a number.
UNITS = (
    "km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|yards?|met(?:er|re)s?|kilomet(?:er|re)s?|kg|g|mg|grams?|kilograms?|pounds?|lbs?|oz|ounces?|"
    "l|ml|lit(?:er|re)s?|gallons?|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|percent|mph|kmh|degrees?"
)
_NUMBER, _UNIT, _NAME = "\u0002", "\u0003", "\u0004"


def words(text):
    """Words of a text in lower case; placeholders keep their value behind the mark of their type."""
    text = F.when(text.rlike(f"[{_NUMBER}-{_NAME}]"), F.translate(text, _NUMBER + _UNIT + _NAME, "   ")).otherwise(text)
    counted = F.regexp_replace(text, rf"(?i)([0-9])\s?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {_UNIT}$2 ")
    counted = F.regexp_replace(counted, r"[0-9]++(?:[.,:/][0-9]++)*+", f" {_NUMBER}$0 ")
    text = F.when(text.rlike("[0-9]"), counted).otherwise(text)
    text = F.regexp_replace(text, r" (?<=[\p{Ll},;] )(\p{Lu}\p{L}+)", f" {_NAME}$1")
    one = rf"[a-z0-9\p{{L}}\p{{N}}{_NUMBER}-{_NAME}]++"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{one}(?:(?<=[0-9])[.,:/](?=[0-9]){one})*+"), F.lit(0))


def _mark(w):
    return F.when(w < "\u0005", F.substring(w, 1, 1)).otherwise(w)


def _value(w):
    return F.when(w < "\u0005", F.substring(w, 2, 1 << 30)).otherwise(w)


def template(parts):
    """Words with the values of placeholders taken out."""
    return F.transform(parts, _mark)


def plain(parts):
    """Words without the marks of placeholders."""
    return F.transform(parts, _value)


def _hashes(parts, of):
    return F.transform(parts, lambda w: F.xxhash64(of(w)))


def _window(kind: int, hashes, at, size: int):
    """The hash of a window, from its words' hashes by their place: slicing would copy the whole text for every window."""
    return F.xxhash64(F.lit(kind), F.lit(size), *[F.get(hashes, at + k) for k in range(size)])


def _literals(parts):
    return F.size(F.filter(parts, lambda w: w >= "\u0005"))


def _sized(rows: DataFrame, kind: int, hashes: str) -> DataFrame:
    """rows with h, the hash of the window of `size` words at j; sizes are few: each gets an expression."""
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())  # no more than lengths of short items
    h = F.lit(None).cast("long")
    for size in sizes:
        h = F.when(F.col("size") == size, _window(kind, F.col(hashes), F.col("j"), size)).otherwise(h)
    return rows.withColumn("h", h)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, j (place), size, h (hash of the template), slots (values), n (windows of the item) to search for."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("t", template("w")).withColumn("hashes", _hashes("w", _mark))
    rows = rows.where(_literals("t") >= MIN_WORDS).withColumn("size", F.least(F.lit(window), F.size("t")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))))
    rows = rows.withColumn("shape", F.slice("t", F.col("j") + 1, F.col("size"))).withColumn("filled", F.slice("w", F.col("j") + 1, F.col("size")))
    rows = rows.where(_literals("shape") >= F.least(F.lit(MIN_LITERAL), F.ceil(F.col("size") / 2)))
    items = rows.groupBy(F.col("item_id").alias("_item")).agg(F.count(F.lit(1)).alias("n"))
    rows = _sized(rows, 0, "hashes").select("item_id", "j", "size", "h", F.filter("filled", lambda w: w < "\u0005").alias("slots"))
    return rows.join(items, F.expr("item_id <=> _item")).drop("_item")


def short_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same for items that are searched as a whole by their plain words: one window each, without slots."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("hashes", _hashes("w", _value)).withColumn("size", F.size("w"))
    rows = rows.where("size > 0").where((_literals("w") < MIN_WORDS) | (F.col("size") <= window)).withColumn("j", F.lit(0))
    none = F.lit(None).cast("array<string>")
    return _sized(rows, 1, "hashes").select("item_id", "j", "size", "h", none.alias("slots"), F.lit(1).cast("long").alias("n"))


def _hits(docs: DataFrame, known: DataFrame, kinds: list[tuple[int, int]], small: bool) -> DataFrame:
    """row, doc_id, item_id, j, i (place in the document), n, size, slots and values of the windows that docs share with known.

    Words are made and hashed once for windows of all kinds and sizes; a window is hashed as it is looked up.
    """
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("w"))
    texts = texts.select("doc_id", "row", "w", _hashes("w", _mark).alias("t"), *([_hashes("w", _value).alias("p")] if any(k for k, _ in kinds) else []))
    # explode_outer: a plain explode would have its argument computed once more, as a filter below.
    rows = texts.withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.size("w") - 1))).where("i >= 0")
    h = [F.when(F.col("i") <= F.size("w") - size, _window(kind, F.col("p" if kind else "t"), F.col("i"), size)) for kind, size in kinds]
    rows = rows.withColumn("h", h[0] if len(h) == 1 else F.explode_outer(F.array(*h)))
    values = F.filter(F.slice("w", F.col("i") + 1, F.col("size")), lambda w: w < "\u0005").alias("values")
    kept = ["row", "doc_id", "item_id", "j", "i", "n", "size", "slots"]
    if small:
        return rows.join(F.broadcast(known), "h").select(*kept, values)
    found = rows.select("row", "doc_id", "i", "h").join(known, "h").select(*kept)  # no text moves with its windows
    return found.join(texts.select(F.col("row").alias("_row"), "w").dropDuplicates(["_row"]), F.col("row") == F.col("_row")).select(*kept, values)


def _longest(places, window: int):
    """Words of the longest stretch that windows at these places cover without a gap."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-1 << 20).alias("last"), F.lit(0).alias("most"))

    def step(run, j):
        first = F.when(j - run["last"] <= window, run["first"]).otherwise(j)
        return F.struct(first.alias("first"), j.alias("last"), F.greatest(run["most"], j + window - first).alias("most"))

    return F.aggregate(F.array_sort(places), start, step, lambda run: run["most"])


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """row (a hash of doc_id and text) and the columns of `contaminated`."""
    known = benchmark_windows(benchmark, window).withColumn("kind", F.lit(0)).unionByName(short_windows(benchmark, window).withColumn("kind", F.lit(1)))
    known = stored(known, "windows")
    facts = known.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "size").collect()  # a row for each length
    small = sum(r["n"] for r in facts) <= BROADCAST_WINDOWS
    hits = _hits(docs, known, [(r["kind"], r["size"]) for r in facts] or [(0, window)], small)
    pair = F.zip_with("slots", "values", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = hits.select("row", "doc_id", "item_id", "n", "j", F.when(F.col("slots").isNotNull(), F.col("i") - F.col("j")).alias("diagonal"), pair.alias("pairs"))
    same = F.when(F.forall("pairs", lambda x: x["a"] == x["b"]), F.col("j"))
    lines = hits.groupBy("row", "doc_id", "item_id", "diagonal", "n").agg(F.collect_set("j").alias("js"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("p"), F.collect_set(same).alias("copied"))
    lines = lines.withColumn("run", _longest("copied", window))
    # One value for one value: as many pairs as there are values on either side. A short item, without a diagonal, is a hit.
    consistent = (F.size("p") == F.size(F.array_distinct("p.a"))) & (F.size("p") == F.size(F.array_distinct("p.b")))
    lines = lines.where(consistent | (F.col("run") >= RUN)).withColumn("js", F.when(consistent, F.col("js")).otherwise(F.col("copied")))
    found = lines.groupBy("row", "doc_id", "item_id", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_set("js")))).cast("long").alias("n_windows"), F.max("run").alias("run"))
    found = found.withColumn("coverage", F.col("n_windows") / F.col("n")).where((F.col("coverage") >= least) | (F.col("run") >= RUN))
    return found.select("row", "doc_id", "item_id", "n_windows", F.col("n").alias("item_windows"), "coverage")


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_windows (of the item found, in consistent alignments), item_windows and coverage of each leak."""
    found = contaminated_rows(docs, benchmark, **how)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", "item_windows")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.item_windows", "b.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated rows; all columns."""
    return without(docs, contaminated_rows(docs, benchmark, **how).select("row"), F.xxhash64("doc_id", "text"))
