"""Coverage gates, inventory, audits, capacity and checks of golden sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import text_hash, token_estimate
from corpusforge.operators.evaluation import ratio

#: Inclusive length buckets of the inventory.
BUCKETS = (("empty", 0, 0), ("tiny", 1, 200), ("short", 201, 1000), ("medium", 1001, 4000), ("long", 4001, 16000), ("huge", 16001, None))


def bucket(length) -> Column:
    """The first named range that holds a length."""
    c = F.col(length) if isinstance(length, str) else length
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BUCKETS):
        out = F.when((c >= low) & (F.lit(True) if high is None else c <= high), name).otherwise(out)
    return out


def histogram(rows: DataFrame, length) -> DataFrame:
    return rows.groupBy(bucket(length).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def inventory(rows: DataFrame, by: list[str], text: str = "body") -> DataFrame:
    size = F.length(text)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("chars"), F.max(size).cast("long").alias("longest"), F.sum(F.greatest(F.lit(1), token_estimate(text))).cast("long").alias("tokens"), F.count_if(F.trim(text) == "").alias("blank"))


def duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Texts that are equal in hash form, with how often and where first."""
    return rows.groupBy(text_hash(text).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def coverage_gates(samples: DataFrame) -> DataFrame:
    """One row of gates over samples (eligible, expected, stored: arrays of chunk hashes).

    covered: eligible items whose stored chunks are the expected ones; missing, stale, stray: the opposite, by how.
    """
    same = F.array_sort("expected") == F.array_sort("stored")
    none = F.size("stored") == 0
    live = F.col("eligible")
    n = F.count_if(live)
    return samples.agg(
        n.alias("eligible"), F.count_if(live & same & ~none).alias("covered"), F.count_if(live & none).alias("missing"), F.count_if(live & ~same & ~none).alias("stale"), F.count_if(~live & ~none).alias("stray"),
        ratio(F.count_if(live & same & ~none), n, 1.0).alias("coverage"), F.max(F.size("stored")).alias("most_chunks"),
    )


def chunk_gaps(chunks: DataFrame, item: list[str]) -> DataFrame:
    """first and last of each run of chunk numbers that an item lacks below its highest; a wild number makes one row."""
    w = Window.partitionBy(*item).orderBy("chunk_index")
    seen = chunks.select(*item, F.col("chunk_index").cast("long").alias("chunk_index")).distinct()
    seen = seen.withColumn("_before", F.coalesce(F.lag("chunk_index").over(w), F.lit(-1)))
    return seen.where(F.col("chunk_index") > F.col("_before") + 1).select(*item, (F.col("_before") + 1).alias("first"), (F.col("chunk_index") - 1).alias("last"))


def release_invariants(chunks: DataFrame, owners: DataFrame, item: list[str]) -> DataFrame:
    """Orphan chunks, repeated chunk hashes within an item, and gaps in chunk numbers."""
    orphans = chunks.join(owners.select(*item).distinct(), item, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    per = chunks.groupBy(*item).agg((F.count(F.lit(1)) - F.countDistinct("chunk_hash")).alias("repeated"))
    gaps = chunk_gaps(chunks, item).select(*item).distinct().agg(F.count(F.lit(1)).alias("items_with_gaps"))
    return orphans.crossJoin(per.agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_hashes"))).crossJoin(gaps)  # one row each


def missing_chunks(chunks: DataFrame, item: list[str], block: int = 10_000) -> DataFrame:
    """Numbers below the highest that an item lacks; long runs are told a block at a time."""
    runs = chunk_gaps(chunks, item).withColumn("_at", F.explode(F.sequence("first", "last", F.lit(block).cast("long"))))
    return runs.select(*item, F.explode(F.sequence("_at", F.least(F.col("_at") + block - 1, "last"))).alias("missing"))


def count_mismatch(state: DataFrame, chunks: DataFrame, item: list[str]) -> DataFrame:
    """Items whose stated chunk_count is not the number of their chunks."""
    counted = chunks.groupBy(*item).agg(F.count(F.lit(1)).alias("actual"))
    return state.join(counted, item, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.coalesce("chunk_count", F.lit(0)) != F.col("actual"))


def disagreements(stored: DataFrame, fresh: DataFrame, item: str) -> DataFrame:
    """item and codes: how stored state (public_state, hash, chunks) differs from what is computed afresh."""
    s = stored.select(F.col(item).alias("_i"), F.col("public_state").alias("_ps"), F.col("hash").alias("_h"), F.col("chunks").alias("_c"))
    both = fresh.join(s, fresh[item] == s["_i"], "full_outer")
    tests = {
        "state_missing": F.col("_i").isNull(), "secret_stale": (F.col("public_state") == "quarantined") & (F.col("_ps") == "safe"), "quarantine_stale": (F.col("public_state") == "safe") & (F.col("_ps") == "quarantined"),
        "chunk_drift": F.col("_c") != F.col("chunks"), "hash_drift": F.col("_h") != F.col("hash"), "source_gone": F.col(item).isNull(),
    }
    codes = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return both.select(F.coalesce(item, "_i").alias(item), codes.alias("codes")).where(F.size("codes") > 0)


def audit_class(parses: Column, covered: Column, reasons: Column, source: Column) -> Column:
    """Exclusive classes, the gravest first."""
    return F.when(F.size(reasons) > 0, "secret_quarantined").when(source.isNull() | ~source.rlike(r"\S"), "invalid_source").when(~covered, "coverage_failed").when(parses, "syntactically_valid").otherwise("parser_fallback")


def fingerprint(rows: DataFrame, hash_: str, *by: str) -> DataFrame:
    """A digest of the multiset of hashes, of all rows or by groups.

    Sums of hash words commute, so no group is gathered in one place.
    """
    words = [F.conv(F.substring(hash_, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return out.select(*by, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def term_probe(rows: DataFrame, terms: list[str], text: str, key: str) -> DataFrame:
    """How many rows hold each of a few terms, and the first of them."""
    low = F.lower(text)
    held = F.filter(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def golden_problems(cases: DataFrame, judgments: DataFrame, items: DataFrame, least_cases: int = 1) -> DataFrame:
    """One row per problem (code, what) of a golden set: cases (case_id, query), judgments, items (key)."""
    said = lambda df, code, what: df.select(F.lit(code).alias("code"), what.cast("string").alias("what"))
    parts = [
        said(cases.groupBy("case_id").count().where("count > 1"), "duplicate_case", F.col("case_id")),
        said(cases.groupBy(F.lower(F.trim("query")).alias("q")).count().where("count > 1"), "duplicate_query", F.col("q")),
        said(cases.where("trim(query) = ''"), "blank_query", F.col("case_id")),
        said(judgments.where("grade < 0 OR grade > 3"), "grade_range", F.concat_ws(":", "case_id", "key")),
        said(judgments.join(cases, "case_id", "left_anti"), "unknown_case", F.concat_ws(":", "case_id", "key")),
        said(judgments.join(items, "key", "left_anti"), "unknown_item", F.concat_ws(":", "case_id", "key")),
        said(cases.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least_cases), "too_few_cases", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def capacity(scenarios: DataFrame, overlap: int = 50, row_bytes: int = 96, graph_bytes: int = 160, gate_gb: float = 12.0) -> DataFrame:
    """Vectors, tokens, bytes and verdict of scenarios (name, items, mean_tokens, dimension, chunk_tokens)."""
    step = F.col("chunk_tokens") - overlap
    per = F.when(F.col("mean_tokens") <= F.col("chunk_tokens"), 1).otherwise(1 + F.ceil((F.col("mean_tokens") - F.col("chunk_tokens")) / step))
    rows = scenarios.withColumn("vectors", (F.col("items") * per).cast("long"))
    rows = rows.withColumn("tokens", (F.col("items") * F.col("mean_tokens") + (F.col("vectors") - F.col("items")) * overlap).cast("long"))
    vector = 4 * F.col("dimension") + 8
    rows = rows.withColumn("heap_bytes", F.col("vectors") * (vector + row_bytes)).withColumn("index_bytes", F.col("vectors") * (vector + graph_bytes))
    total = (F.col("heap_bytes") + F.col("index_bytes")) / 1e9
    return rows.withColumn("gb", F.round(total, 6)).withColumn("verdict", F.when(total <= 0.8 * gate_gb, "PASS").when(total <= gate_gb, "CONDITIONAL").otherwise("FAIL"))


def hygiene(columns: list[str], forbidden: tuple = ("embedding", "vector", "payload", "api_key", "raw_content")) -> list[str]:
    """Columns that a report must not carry."""
    return [c for c in columns if any(f in c.lower() for f in forbidden)]


def schema_inventory(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Column, type and whether its name says that it decides who may see a row."""
    return [(f.name, f.dataType.simpleString(), any(w in f.name.lower() for w in ("deleted", "status", "state", "sharing", "revoked"))) for f in df.schema]


def cohort(parts: list[DataFrame], key: list[str], high_water=None, column: str | None = None) -> DataFrame:
    """Rows of several sources, each once, none beyond a high-water mark that was pinned before reading."""
    rows = reduce(DataFrame.unionByName, parts)
    return (rows.where(F.col(column) <= high_water) if column else rows).dropDuplicates(key)


def high_water(rows: DataFrame, column: str):
    """The highest key there is now: read it before a cohort is, so that all parts end at the same place."""
    return rows.agg(F.max(column)).first()[0]
