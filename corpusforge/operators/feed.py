"""The corpus model: messages, resources and curated answers in one feed, with lifecycle and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import entity_type

FEED = ["kind", "source", "item_id", "title", "body", "author", "context", "url", "created_at"]
MESSAGE_SOURCE, DISTILLATION_SOURCE = "conversations", "benchmark"
ELIGIBLE = ("pending", "approved")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as resources; the first sentence serves as title."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "source", F.col("doc_id").cast("string").alias("external_id"), F.expr("left(split_part(text, '.', 1), 80)").alias("title"), F.col("text").alias("body"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; a turn replies to the one before it."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("thread_id"), "turn", F.col("role").alias("author"), F.col("text").alias("content"),
        F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("reference_id"),
    )


def distillations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as curated answers in four states of their life."""
    b = read(spark, sf_dir, "benchmark")
    status = F.element_at(F.array(*[F.lit(x) for x in ("approved", "pending", "rejected", "superseded")]), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("id"), F.expr("left(text, 100)").alias("question"), F.col("text").alias("answer"), status.alias("status"), F.when(F.col("item_id") % 4 == 3, F.col("item_id") - 3).alias("supersedes_id"))


def unified_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items in one shape; answers that were rejected or superseded are left out."""
    none = F.lit(None).cast("string")
    when = F.lit(None).cast("timestamp_ntz")
    m = messages(spark, sf_dir).select(F.lit("message").alias("kind"), F.lit(MESSAGE_SOURCE).alias("source"), F.col("message_id").alias("item_id"), none.alias("title"), F.col("content").alias("body"), "author", F.col("thread_id").cast("string").alias("context"), F.concat(F.lit("/threads/"), F.col("thread_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"), when.alias("created_at"))
    r = resources(spark, sf_dir).select("kind", "source", F.col("id").cast("string").alias("item_id"), "title", "body", none.alias("author"), none.alias("context"), none.alias("url"), when.alias("created_at"))
    d = distillations(spark, sf_dir).where(F.col("status").isin(*ELIGIBLE)).select(F.lit("distillation").alias("kind"), F.lit(DISTILLATION_SOURCE).alias("source"), F.col("id").cast("string").alias("item_id"), F.col("question").alias("title"), F.col("answer").alias("body"), none.alias("author"), none.alias("context"), none.alias("url"), when.alias("created_at"))
    return m.unionByName(r).unionByName(d)


def typed(feed: DataFrame) -> DataFrame:
    return feed.withColumn("entity_type", entity_type("kind"))


def message_feed(events: DataFrame, members: DataFrame, reactions: DataFrame) -> DataFrame:
    """Live messages with the author's name and a list of the active reactions (null if there is none)."""
    active = reactions.where("removed_at IS NULL").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("emoji", "user_id"))).alias("reactions"))
    return events.join(members, events["author_id"] == members["member_id"], "left").join(active, "message_id", "left").drop("member_id")


def opted_in(messages_: DataFrame, members: DataFrame) -> DataFrame:
    """Messages of members who share (by default they do)."""
    return messages_.join(members.where(F.coalesce("allow_sharing", F.lit(True))).select(F.col("member_id").alias("author_id")), "author_id", "left_semi")


def without_bots(messages_: DataFrame, members: DataFrame) -> DataFrame:
    return messages_.join(members.where("bot OR system").select(F.col("member_id").alias("author_id")), "author_id", "left_anti")


def get_item(feed: DataFrame, kind: str, item_id: str) -> DataFrame:
    """One item; kind `resource` stands for every kind but message and distillation."""
    same = ~F.col("kind").isin("message", "distillation") if kind == "resource" else F.col("kind") == kind
    return feed.where(same & (F.col("item_id") == item_id))


def cited_by(feed: DataFrame, cites: DataFrame) -> DataFrame:
    """Distillations with each item that they cite: cites has distillation_id, item_kind, item_id."""
    left = feed.where("kind = 'distillation'").select(F.col("item_id").alias("distillation_id"), F.col("title").alias("question"))
    right = typed(feed).select(F.col("entity_type").alias("item_kind"), "item_id", F.col("title").alias("cited_title"))
    return cites.dropDuplicates(["distillation_id", "item_kind", "item_id"]).join(left, "distillation_id").join(right, ["item_kind", "item_id"])


def reply_chain(messages_: DataFrame) -> DataFrame:
    """Each message with the one that it replies to."""
    parent = messages_.select(F.col("message_id").alias("reference_id"), F.col("author").alias("parent_author"), F.length("content").alias("parent_chars"))
    return messages_.join(parent, "reference_id", "left")


def thread_rollup(messages_: DataFrame) -> DataFrame:
    return messages_.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("author").alias("n_authors"), F.max_by("author", "turn").alias("last_author"), F.sum(F.length("content")).cast("long").alias("chars"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key: the state after upserts."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def replace_representation(stored: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """All chunks of the identities in new are replaced together, stale tail chunks too."""
    return stored.join(new.select(*identity).distinct(), identity, "left_anti").unionByName(new)


def append_new(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is not stored yet, once each."""
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def key_page(rows: DataFrame, key: str, after, through, n: int) -> DataFrame:
    """The next n rows beyond a cursor and up to a high-water mark."""
    return rows.where((F.col(key) > after) & (F.col(key) <= through)).orderBy(key).limit(n)


def offset_page(rows: DataFrame, key: str, offset: int, n: int) -> DataFrame:
    """n rows in the order of a key, behind the first `offset`."""
    return rows.orderBy(key).offset(offset).limit(n)


def drop_identity(stored: DataFrame, gone: DataFrame, identity: list[str]) -> DataFrame:
    """Stored rows but for those of the identities in gone; a column that gone lacks stands for every value of it."""
    asked = [c for c in identity if c in gone.columns]
    return stored.join(gone.select(*asked).distinct(), asked, "left_anti")


def json_contains(column: str, needle: dict) -> Column:
    """Whether a JSON text contains a JSON object: its keys with its scalar values, in objects within objects, and of its
    lists each element."""
    v = F.try_parse_json(column)

    def test(path: str, x) -> Column:
        if isinstance(x, dict):
            return reduce(lambda a, b: a & b, [test(f"{path}.{k}", y) for k, y in x.items()], F.lit(True))
        if isinstance(x, list):
            held = F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
            return reduce(lambda a, b: a & b, [F.array_contains(held, str(y)) for y in x], F.try_variant_get(v, path, "array<string>").isNotNull())
        if x is None:
            return F.is_variant_null(F.try_variant_get(v, path, "variant"))
        kind = "boolean" if isinstance(x, bool) else "double" if isinstance(x, int | float) else "string"
        text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        return (F.try_variant_get(v, path, kind) == F.lit(x).cast(kind)) & (text if kind == "string" else ~text)

    return F.coalesce(test("$", needle), F.lit(False))
