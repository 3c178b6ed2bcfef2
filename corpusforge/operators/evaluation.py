"""Retrieval metrics over results (case_id, rank, key) and judgments (case_id, key, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top, bottom, empty: float = 0.0) -> Column:
    """A safe quotient: `empty` if the denominator is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


def per_case(results: DataFrame, judgments: DataFrame, ks: tuple = (1, 5, 10), ndcg_k: int = 10) -> DataFrame:
    """recall_at_k, reciprocal_rank, average_precision and ndcg of each judged case; a case without results scores 0."""
    good = judgments.where("grade > 0")
    ideal = Window.partitionBy("case_id").orderBy(F.desc("grade"), "key")
    wanted = good.withColumn("_i", F.row_number().over(ideal)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_i") <= ndcg_k, (F.pow(2.0, "grade") - 1) / F.log2(F.col("_i") + 1))).alias("idcg"))
    hits = results.join(good, ["case_id", "key"])
    order = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_so_far", F.count(F.lit(1)).over(order))
    sums = hits.groupBy("case_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks], F.min("rank").alias("_first"), F.sum(F.col("_so_far") / F.col("rank")).alias("_ap"), F.sum(F.when(F.col("rank") <= ndcg_k, (F.pow(2.0, "grade") - 1) / F.log2(F.col("rank") + 1))).alias("_dcg"),
    )
    rows = wanted.join(sums, "case_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "case_id", *[F.coalesce(F.col(f"_h{k}") / F.col("n"), zero).alias(f"recall_at_{k}") for k in ks], F.coalesce(1 / F.col("_first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("_ap") / F.col("n"), zero).alias("average_precision"), F.coalesce(ratio(F.col("_dcg"), F.col("idcg")), zero).alias(f"ndcg_at_{ndcg_k}"),
    )


def macro(cases: DataFrame, *by: str) -> DataFrame:
    """Means over cases, of all or by groups; an array column counts a case in each of its entries."""
    for c in by:
        if cases.schema[c].dataType.typeName() == "array":
            cases = cases.withColumn(c, F.explode(c))
    metrics = [c for c, t in cases.dtypes if t == "double"]
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for c in metrics])


def rates(outcomes: DataFrame) -> DataFrame:
    """Shares of zero results, timeouts, errors, and of rightly empty results among cases that expect none."""
    n = F.count(F.lit(1))
    return outcomes.agg(
        n.alias("cases"), ratio(F.count_if("zero_result"), n).alias("zero_result_rate"), ratio(F.count_if(F.col("outcome") == "timeout"), n).alias("timeout_rate"), ratio(F.count_if(F.col("outcome") == "error"), n).alias("error_rate"),
        ratio(F.count_if(F.col("expect_no_hit") & F.col("zero_result")), F.count_if("expect_no_hit")).alias("no_hit_accuracy"),
    )


def compare(old: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: means before and after, their difference, and cases that gained and lost."""
    both = old.select("case_id", *[F.col(m).alias(f"_o_{m}") for m in metrics]).join(new.select("case_id", *[F.col(m).alias(f"_n_{m}") for m in metrics]), "case_id")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_o_{m}").alias("o"), F.col(f"_n_{m}").alias("n")) for m in metrics])
    rows = both.select(F.explode(cells).alias("x")).select("x.*")
    return rows.groupBy("metric").agg(F.avg("o").alias("before"), F.avg("n").alias("after"), (F.avg("n") - F.avg("o")).alias("change"), F.count_if(F.col("n") > F.col("o")).alias("gained"), F.count_if(F.col("n") < F.col("o")).alias("lost"))


def winner(candidates: DataFrame, order: list) -> DataFrame:
    return candidates.orderBy(*order).limit(1)


def percentile_linear(c, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def percentile_floor(c, p: float) -> Column:
    return F.floor(F.percentile(c, F.lit(p)))


def percentile_nearest(c, p: float) -> Column:
    """The value at rank round-half-even(p * (n - 1)); exact, so for report-sized groups."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.bround(F.lit(p) * (F.size(values) - 1)).cast("int"))


def set_precision(returned, expected) -> Column:
    return ratio(F.size(F.array_intersect(returned, expected)), F.size(F.array_distinct(returned)), 1.0)


def set_recall(returned, expected) -> Column:
    return ratio(F.size(F.array_intersect(returned, expected)), F.size(expected), 0.0)


def later_chunk_rate(hits: DataFrame) -> DataFrame:
    """Of the best hits (rank 1) of all cases, the share found by a chunk behind the first."""
    return hits.where("rank = 1").agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("chunk_index") > 0).cast("double")).alias("later_rate"))
