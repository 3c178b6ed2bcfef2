"""Keyword search by scopes with integer scores and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import clip
from corpusforge.plans.query import MAX_ARMS, POOL, RANK_TOKENS, SQL_TOKENS, distinctive, like_arms, variants
from corpusforge.sources.tables import written

#: Points of a hit.
TITLE, BODY, CONTEXT, APPROVED, PARSEABLE, PHRASE = 5, 3, 3, 4, 3, 2
AND_ENOUGH = 3


def score(query: str, title="title", body="body", context="context", approved: Column | None = None, parseable: Column | None = None) -> Column:
    """Points for each distinct token, in any of its spellings, per field; more for approved, parseable and phrase.

    Fields whose names begin with low_ are in lower case already.
    """
    total = F.lit(0)
    seen = dict.fromkeys(t.casefold() for t in distinctive(query, RANK_TOKENS))

    def has(field, needle: str) -> Column:
        at = F.col(field) if isinstance(field, str) else field
        return F.coalesce(F.contains(at if isinstance(field, str) and field.startswith("low_") else F.lower(at), F.lit(needle)), F.lit(False))

    for token in seen:
        for field, points in ((title, TITLE), (body, BODY), (context, CONTEXT)):
            total = total + F.when(reduce(lambda a, b: a | b, [has(field, v.lower()) for v in variants(token)]), points).otherwise(0)
    for flag, points in ((approved, APPROVED), (parseable, PARSEABLE)):
        if flag is not None:
            total = total + F.when(F.coalesce(flag, F.lit(False)), points).otherwise(0)
    if words := distinctive(query, SQL_TOKENS):
        phrase = " ".join(words).lower()
        total = total + F.when(has(title, phrase) | has(body, phrase), PHRASE).otherwise(0)
    return total


def narrow(rows: DataFrame, query: str, columns: tuple = ("title",)) -> DataFrame:
    """Every token in one of the columns."""
    return rows.where(reduce(lambda a, b: a & b, [like_arms(t, list(columns)) for t in distinctive(query, SQL_TOKENS)], F.lit(True)))


def wide(rows: DataFrame, query: str, columns: tuple = ("title", "body")) -> DataFrame:
    """Any token in any column, within the budget of arms."""
    words = distinctive(query, SQL_TOKENS)
    return rows.where(reduce(lambda a, b: a | b, [like_arms(t, list(columns), max(1, MAX_ARMS // len(words))) for t in words], F.lit(False)))


def widen(rows: DataFrame, query: str, enough: int = AND_ENOUGH) -> DataFrame:
    """The narrow pass, and the wide one behind it if that finds too little; one row per item, narrow hits first."""
    first = narrow(rows, query).withColumn("pass", F.lit(0))
    if first.limit(enough).count() >= enough:
        return first
    both = first.unionByName(wide(rows, query).withColumn("pass", F.lit(1)))
    w = Window.partitionBy("kind", "item_id").orderBy("pass")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pool(rows: DataFrame, n: int = POOL) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("item_id")).limit(n)


def page(rows: DataFrame, limit: int, offset: int = 0, by: str = "relevance") -> DataFrame:
    """A page in a total order, with the total, its number and what comes next.

    What is ranked is written once, so that the total and the page don't read the corpus twice; give narrow rows.
    """
    recent, points = F.desc_nulls_last("created_at"), F.desc("score")
    first = [points, recent] if by == "relevance" else [recent, points]
    order = [*first, F.desc("kind"), F.desc("item_id")]
    hits = written(rows, "page")
    n = F.lit(hits.count())
    best = hits.orderBy(*order).limit(offset + limit)
    out = best.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset).withColumn("total", n)
    return out.withColumns({"page": F.lit(offset // limit + 1), "pages": F.ceil(F.col("total") / limit), "has_more": F.col("total") > offset + limit, "next_offset": F.when(F.col("total") > offset + limit, offset + limit)})


def shape(rows: DataFrame) -> DataFrame:
    return rows.withColumn("truncated", F.length("body") > 400).withColumn("body", clip("body"))


def legacy_two_pass(rows: DataFrame, query: str, limit: int) -> DataFrame:
    """Titles that contain the query, then bodies, each limited by itself."""
    q = query.lower()
    passes = [rows.where(F.lower(c).contains(q)).orderBy("kind", "item_id").limit(limit).withColumn("pass", F.lit(i)) for i, c in enumerate(("title", "body"))]
    w = Window.partitionBy("kind", "item_id").orderBy("pass")
    return passes[0].unionByName(passes[1]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def envelope(rows: DataFrame, failed: list[str] | None = None, scopes: int = 3) -> DataFrame:
    """One row about a result: its size, whether no curated answer is in it, and what went wrong by the way."""
    failed = failed or []
    if failed and len(failed) >= scopes:
        raise RuntimeError("every scope failed: " + "; ".join(failed))
    warnings = F.array(*map(F.lit, failed)) if failed else F.array().cast("array<string>")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("kind") == "distillation") == 0).alias("nudge")).withColumn("warnings", F.array_join(warnings, "; "))


def page_json(hits: DataFrame, *columns: str) -> DataFrame:
    """One row with a page (of `page`, so of limited size) as a JSON list in the order of its places."""
    items = F.array_sort(F.collect_list(F.struct("place", *columns)))
    return hits.agg(F.to_json(items).alias("page"))
