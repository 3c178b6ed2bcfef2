"""Exact dedup by content-defined chunk recipes (DataFrame operations only).

Each text is cut where its own characters say so, so equal passages give equal chunks wherever they stand.
A chunk is named by a 64-bit hash; names are verified by SHA-256, and chunks whose names collide are told
apart by an ordinal. A text then is the ordered list of its chunk names, its recipe: two texts are equal
exactly if their recipes are. Long texts are read once, where they lie; only recipes are shuffled.

Nulls and repeated rows: a null text counts as empty and has the empty recipe. doc_id may be null; such a row
stays only if no row of its group has a doc_id. Rows that repeat a doc_id within a group are one document:
all of them are marked alike. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import stored

#: A cut comes after a vowel, a consonant of this class and white space, MIN to MAX characters after the last.
CUT = r"[aeiouäöüéèñ][b-dlnr-tx-z.,]\s"
MIN_CHARS, MAX_CHARS = 512, 4096


def chunks(text, least: int = MIN_CHARS, most: int = MAX_CHARS):
    """The chunks of a text, in order; joined, they give the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<={CUT})|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, name=None) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered verified chunk identifiers, comma-joined.

    name: the chunk hash, a column function; XXH64 unless a test asks for a weaker one.
    """
    name = name or (lambda c: F.xxhash64(c))
    text = F.coalesce("text", F.lit(""))
    named = stored(
        docs.select(
            "doc_id",
            F.sha2(text, 256).alias("text_sha256"),
            F.transform(chunks(text, least, most), lambda c: F.struct(name(c).alias("k"), F.unhex(F.sha2(c, 256)).alias("s"))).alias("parts"),
        ),
        "recipes",
    )
    known = named.select(F.explode("parts").alias("p")).select("p.k", "p.s").distinct()
    clash = known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    if clash.isEmpty():
        listed = named.withColumn("recipe", F.array_join(F.transform("parts", lambda p: p["k"].cast("string")), ","))
    else:  # tell chunks of one name apart by the rank of their SHA-256
        ranks = known.join(clash, "k").groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("all")).select("k", F.posexplode("all").alias("o", "s"))
        rows = named.withColumn("row", F.monotonically_increasing_id())
        rows = stored(rows, "recipe-rows")
        each = rows.select("row", F.posexplode("parts").alias("i", "p")).select("row", "i", "p.k", "p.s")
        each = each.join(ranks, ["k", "s"], "left").withColumn("id", F.concat_ws("#", F.col("k").cast("string"), F.col("o").cast("string")))
        lists = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("l")).select("row", F.array_join("l.id", ",").alias("recipe"))
        listed = rows.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.lit("")))
    return listed.select("doc_id", "text_sha256", "recipe")


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest doc_id stays."""
    rows = recipes(docs, **how)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A derived key, so that both sides of the join are dealt anew and AQE can split a hot group.
    groups = groups.select(F.concat("recipe", F.lit(".")).alias("key"), "keep_id", "group_size")
    return (
        rows.withColumn("key", F.concat("recipe", F.lit(".")))
        .join(groups, "key")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
