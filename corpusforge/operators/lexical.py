"""Lexical search: arms over the feed, one row per item, a total order, then hydration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import compact, compact_contains, snippet, tokens
from corpusforge.operators.search_index import prepared
from corpusforge.plans.query import Filters, WebQuery, arms, candidate_limit, check_query

#: Rank of an exact or contained identifier, by where it is found.
TITLE_IDENT, CODE_IDENT, MESSAGE_IDENT, EQUAL_IDENT = 0.95, 0.93, 0.90, 1.0
FTS_BASE, FTS_TITLE, FTS_TOP = 0.75, 0.12, 0.89
WEIGHTS = {"title": 1.0, "context": 0.4, "body": 0.2}
TITLE_CHARS, MESSAGE_CHARS = 300, 8000


def _has(line: str, word: str) -> Column:
    return F.col(line).contains(f" {word} ").cast("int")


def term_score(words: list[str]) -> Column:
    """Weighted share of the query's words per field, squashed to r / (r + 1)."""
    raw = reduce(lambda a, b: a + b, [F.lit(w) * _has(f"{c}_line", x) for c, w in WEIGHTS.items() for x in dict.fromkeys(words)], F.lit(0.0))
    return raw / (raw + 1)


def _arm(rows: DataFrame, source: str, rank: Column, representation: str = "prose") -> DataFrame:
    return rows.select("entity_type", "item_id", F.lit(representation).alias("representation"), "snippet", rank.cast("double").alias("rank"), F.lit(source).alias("lexical_source"), "created_at")


def fts_arm(feed: DataFrame, query: str) -> DataFrame:
    """Items whose tokens satisfy the web-style query."""
    q = WebQuery.parse(query)
    rows = prepared(feed).where(q.may_match("low_title", "low_body", "low_context"))
    return _arm(rows.where(q.matches_lines("title_line", "body_line", "context_line")), "fts", term_score(q.positive))


def phrase_arm(feed: DataFrame, query: str) -> DataFrame:
    q = WebQuery.parse('"' + query.strip().strip('"') + '"')
    rows = prepared(feed).where(q.may_match("low_title", "low_body"))
    return _arm(rows.where(q.matches_lines("title_line", "body_line")), "phrase", term_score(q.positive))


def ident_arm(feed: DataFrame, query: str) -> DataFrame:
    """Items that contain the query without blanks and punctuation: in a message's text, in another item's title."""
    key, rows = _compact_literal(query), prepared(feed)
    if not key:
        return _arm(rows.where("false"), "identifier", F.lit(0.0))
    said, titled = F.col("compact_body"), F.col("compact_title")
    message = (F.col("entity_type") == "message") & F.col("body_chars").between(1, MESSAGE_CHARS) & said.contains(key)
    title = (F.col("entity_type") != "message") & F.col("title_chars").between(1, TITLE_CHARS) & titled.contains(key)
    rank = F.when(message & (said == key), EQUAL_IDENT).when(message, MESSAGE_IDENT).otherwise(TITLE_IDENT)
    return _arm(rows.where(F.coalesce(message, F.lit(False)) | F.coalesce(title, F.lit(False))), "identifier", rank)


def fragment_arm(chunks: DataFrame, query: str) -> DataFrame:
    """Items whose code chunks, joined, contain the query as identifier; shown by their newest matching chunk.

    chunks: entity_type, item_id, chunk_index, chunk_text, created_at.
    """
    key = _compact_literal(query)
    rows = chunks.withColumn("_norm", compact("chunk_text")).withColumn("_hit", F.col("_norm").contains(key))
    whole = rows.groupBy("entity_type", "item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_norm"))), lambda x: x["_norm"]), " ").alias("joined"),
        F.max_by(F.when(F.col("_hit"), F.col("chunk_text")), F.when(F.col("_hit"), F.struct("created_at", "chunk_index"))).alias("body"), F.max("created_at").alias("created_at"),
    )
    return _arm(whole.where(F.col("joined").contains(key)).withColumn("snippet", snippet("body")), "fragment", F.lit(CODE_IDENT), "code")


def safe_only(chunks: DataFrame, states: DataFrame, state: str = "safe") -> DataFrame:
    """The safety gate: chunks of workflows whose code is in the given state; states: item_id, kind, public_state."""
    good = states.where((F.col("kind") == "workflow") & (F.col("public_state") == state)).select("item_id")
    return chunks.join(good, "item_id", "left_semi")


def code_arm(chunks: DataFrame, query: str) -> DataFrame:
    """Items with a code chunk whose tokens satisfy the query, each by its best chunk; pass chunks through `safe_only`.

    chunks: entity_type, item_id, chunk_index, chunk_text, created_at. The rank is that of words in a body.
    """
    q, words = WebQuery.parse(query), tokens("chunk_text")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    raw = reduce(lambda a, b: a + b, [F.lit(WEIGHTS["body"]) * line.contains(f" {w} ").cast("int") for w in q.positive], F.lit(0.0))
    hits = chunks.where(q.matches(words)).withColumn("rank", raw / (raw + 1))
    best = hits.groupBy("entity_type", "item_id").agg(F.max_by(F.struct("chunk_text", "rank", "created_at"), F.struct("rank", "created_at", -F.col("chunk_index"))).alias("b"))
    rows = best.select("entity_type", "item_id", "b.*").withColumn("snippet", snippet("chunk_text"))
    return _arm(rows, "code_fts", F.col("rank"), "code")


def dense(rows: DataFrame, test: Column, enough: int = 4) -> DataFrame:
    """One row: whether `enough` rows at least pass a test, looking no further than these."""
    return rows.where(test).limit(enough).agg((F.count(F.lit(1)) >= enough).alias("dense"))


def _compact_literal(query: str) -> str:
    import re
    import unicodedata

    return re.sub(r"""[\s.\-_/\\,:;(){}\[\]@"'`]""", "", unicodedata.normalize("NFC", query).lower().strip())


def banded(feed: DataFrame, query: str) -> DataFrame:
    """Deterministic rank: identifier in title 0.95, in a resource's body 0.93, in a message 0.90, else by words."""
    key, words = _compact_literal(query), sorted(set(WebQuery.parse(query.replace('"', " ")).positive))
    in_body = F.when(F.col("entity_type") == "resource", CODE_IDENT).otherwise(MESSAGE_IDENT)
    by_name = F.when(compact_contains("title", key), TITLE_IDENT).when(compact_contains("body", key), in_body) if key else F.lit(None).cast("double")
    said = [F.coalesce(F.col("low_title").contains(w), F.lit(False)) | F.col("low_body").contains(w) for w in words]  # before the tokens, which cost more
    every = reduce(lambda a, b: a & b, [*said, *[F.col("title_line").contains(f" {w} ") | F.col("body_line").contains(f" {w} ") for w in words]], F.lit(bool(words)))
    share = reduce(lambda a, b: a + b, [_has("title_line", w) for w in words], F.lit(0)) / max(1, len(words))
    by_words = F.when(every, F.least(F.lit(FTS_TOP), F.lit(FTS_BASE) + F.lit(FTS_TITLE) * share))
    return prepared(feed).withColumn("rank", F.greatest(by_name, by_words)).where("rank IS NOT NULL")


def collapse(hits: DataFrame) -> DataFrame:
    """One row per item: highest rank, then code before prose, then the newest, then by source of the hit."""
    w = Window.partitionBy("entity_type", "item_id").orderBy(F.desc_nulls_last("rank"), F.when(F.col("representation") == "code", 0).otherwise(1), F.desc_nulls_last("created_at"), "lexical_source", "snippet")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc_nulls_last("rank"), F.desc_nulls_last("created_at"), "entity_type", "item_id").limit(limit)


def candidates(feed: DataFrame, query: str, filters: Filters | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """The union of all arms that the query asks for."""
    rows = prepared(feed)
    if filters:
        filters.check()
        rows = rows.where(filters.predicate())
    run = {"fts": fts_arm, "phrase": phrase_arm, "identifier": ident_arm}
    parts = [run[a](rows, query) for a in arms(query)]
    if chunks is not None:
        parts.append(fragment_arm(chunks, query))
    return reduce(DataFrame.unionByName, parts)


def search(feed: DataFrame, query: str, limit: int = 20, filters: Filters | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Hydrated results: the limit is taken on narrow rows, and only then are items joined."""
    limit = check_query(query, limit)
    found = top(collapse(candidates(feed, query, filters, chunks)), candidate_limit(limit))
    page = top(found, limit)
    w = Window.orderBy(F.desc_nulls_last("rank"), F.desc_nulls_last("created_at"), "entity_type", "item_id")
    items = prepared(feed).drop("created_at", "snippet")
    return F.broadcast(page).join(items, ["entity_type", "item_id"]).withColumn("keyword_rank", F.row_number().over(w))
