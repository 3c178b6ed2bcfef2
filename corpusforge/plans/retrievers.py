"""Retrievers by name: each takes the corpus and cases (case_id, query) and gives results (case_id, rank, key)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators import lexical, semantic
from corpusforge.operators.search_index import prepared
from corpusforge.plans.query import WebQuery

Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
REGISTRY: dict[str, Retriever] = {}
FORM = "case_id long, rank int, key string"


def retriever(name: str):
    def keep(f: Retriever) -> Retriever:
        REGISTRY[name] = f
        return f

    return keep


@retriever("stub")
def stub(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
    """Never finds anything."""
    return cases.sparkSession.createDataFrame([], FORM)


#: Most cases of one run: each row of the corpus is tried against all of them.
MAX_CASES = 10_000


def _asked(cases: DataFrame, shape, form: str) -> DataFrame:
    """One row with the cases, a stated and checked number, as an array of structs that `shape` makes of a query."""
    got = cases.select(F.col("case_id").cast("long"), "query").limit(MAX_CASES + 1).collect()
    if len(got) > MAX_CASES:
        raise ValueError(f"more than {MAX_CASES} cases: split them into blocks")
    rows = cases.sparkSession.createDataFrame([(c["case_id"], *shape(c["query"] or "")) for c in got], f"case_id long, {form}")
    return F.broadcast(rows.agg(F.collect_list(F.struct(*rows.columns)).alias("asked")))


def _best(hits: DataFrame, limit: int) -> DataFrame:
    """case_id, rank and key of the best hits (case_id, points, created_at, entity_type, item_id); each task thins out its own first."""
    order = [F.desc_nulls_last("points"), F.desc_nulls_last("created_at"), "entity_type", "item_id"]
    mine = hits.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "_part").orderBy(*order)))
    ranked = mine.where(F.col("_n") <= limit).withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).select("case_id", "rank", F.concat_ws(":", "entity_type", "item_id").alias("key"))


@retriever("lexical")
def by_words(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
    """The banded rank for all cases in one scan of the corpus."""
    asked = _asked(cases, lambda q: (lexical._compact_literal(q), sorted(set(WebQuery.parse(q.replace('"', " ")).positive))), "name string, words array<string>")

    def points(c):
        in_body = F.when(F.col("entity_type") == "resource", lexical.CODE_IDENT).otherwise(lexical.MESSAGE_IDENT)
        by_name = F.when(F.col("compact_title").contains(c["name"]), lexical.TITLE_IDENT).when(F.col("compact_body").contains(c["name"]), in_body)
        in_title = lambda w: F.col("title_line").contains(F.concat(F.lit(" "), w, F.lit(" ")))
        every = (F.size(c["words"]) > 0) & F.forall(c["words"], lambda w: in_title(w) | F.col("body_line").contains(F.concat(F.lit(" "), w, F.lit(" "))))
        share = F.size(F.filter(c["words"], in_title)) / F.greatest(F.lit(1), F.size(c["words"]))
        by_rule = F.when(every, F.least(F.lit(lexical.FTS_TOP), F.lit(lexical.FTS_BASE) + F.lit(lexical.FTS_TITLE) * share))
        return F.greatest(F.when(c["name"] != "", by_name), by_rule)

    rows = prepared(feed).select("entity_type", "item_id", "created_at", "compact_title", "compact_body", "title_line", "body_line").crossJoin(asked)  # one row
    hits = F.filter(F.transform("asked", lambda c: F.struct(c["case_id"].alias("case_id"), points(c).alias("points"))), lambda h: h["points"].isNotNull())
    return _best(rows.select("entity_type", "item_id", "created_at", F.inline(hits)), limit)


@retriever("legacy")
def by_containing(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
    """Titles that contain the query, then bodies, for all cases in one scan."""
    asked = _asked(cases, lambda q: (q.lower().strip(),), "query string")
    rows = prepared(feed).select("entity_type", "item_id", "created_at", "low_title", "low_body").crossJoin(asked)  # one row
    points = lambda c: F.when(c["query"] == "", None).when(F.col("low_title").contains(c["query"]), 1.0).when(F.col("low_body").contains(c["query"]), 0.5)
    hits = F.filter(F.transform("asked", lambda c: F.struct(c["case_id"].alias("case_id"), points(c).alias("points"))), lambda h: h["points"].isNotNull())
    return _best(rows.select("entity_type", "item_id", "created_at", F.inline(hits)), limit)


def fixture(results: DataFrame) -> Retriever:
    """Gives results that were kept (case_id, rank, key)."""

    def find(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
        return results.where(F.col("rank") <= limit).join(cases.select("case_id"), "case_id", "left_semi").select("case_id", "rank", "key")

    return find


def by_vectors(dimension: int, approximate: bool = False) -> Retriever:
    """Nearest neighbours: the corpus has key and embedding, cases have case_id and embedding."""

    def find(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
        chunks = feed.select(F.col("key").alias("vec_id"), "embedding")
        asked = cases.select(F.col("case_id").alias("query_id"), F.col("embedding").alias("query"))
        near = semantic.nearest_approximate if approximate else semantic.nearest_batch
        return near(chunks, asked, limit, dimension).select(F.col("query_id").alias("case_id"), F.col("semantic_rank").alias("rank"), F.col("vec_id").alias("key"))

    return find


def oracle(judgments: DataFrame, reverse: bool = False) -> Retriever:
    """Gives the judged items, best first (or last): the bounds of every metric."""

    def find(feed: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
        w = Window.partitionBy("case_id").orderBy(F.asc("grade") if reverse else F.desc("grade"), "key")
        good = judgments.where("grade > 0").join(cases.select("case_id"), "case_id", "left_semi")
        return good.select("case_id", F.row_number().over(w).alias("rank"), "key").where(F.col("rank") <= limit)

    return find


def probed(find: Retriever, feed: DataFrame, cases: DataFrame, limit: int, budget_ms: float = 2000) -> dict:
    """Outcome and latency of one run of a retriever."""
    began = time.monotonic()
    try:
        n = find(feed, cases, limit).count()
        outcome = "success"
    except Exception as e:
        n, outcome = 0, f"error: {type(e).__name__}"
    ms = (time.monotonic() - began) * 1000
    return {"outcome": outcome, "rows": n, "latency_ms": ms, "over_budget": ms > budget_ms}


def plan_facts(df: DataFrame) -> dict:
    """What a physical plan does: pushed filters, columns read, exchanges, broadcasts, Python."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return {"pushed": re.findall(r"PushedFilters: \[([^\]]*)\]", text), "columns": re.findall(r"ReadSchema: struct<([^>]*)", text), "exchanges": len(re.findall(r"\bExchange ", text)), "broadcasts": len(re.findall("BroadcastExchange", text)), "python": bool(re.search("Python|Pandas|Arrow", text))}
