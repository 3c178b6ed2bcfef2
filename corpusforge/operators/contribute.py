"""Contributions: requests as JSON text are validated in the plan, keys are checked by hash, accepted rows appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.vectors import trigram_similarity
from corpusforge.operators.feed import append_new

ACTIONS = ("add_resource", "add_distillation")
CONFIDENCES = ("high", "medium", "low")
MAX_COMMENT, LEAST_RATING, MOST_RATING = 2000, 1, 10
SAME_QUESTION = 0.6


def _kind(body: Column, path: str) -> Column:
    """The JSON type at a path, in lower case; null if there is nothing."""
    return F.lower(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant")))


def _text(body: Column, path: str) -> Column:
    return F.when(_kind(body, path) == "string", F.try_variant_get(F.try_parse_json(body), path, "string"))


def _blank(body: Column, path: str) -> Column:
    return F.coalesce(F.trim(_text(body, path)) == "", F.lit(True))


def first_problem(*tests: tuple[Column, str]) -> Column:
    """The text of the first test that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(d)) for t, d in tests])


def request_problem(body: Column) -> Column:
    """What is wrong with a request, null if nothing is."""
    action, data = _text(body, "$.action"), _kind(body, "$.data")
    is_object = _kind(body, "$").startswith("object")
    add = action == "add_resource"
    fields = [(add & _blank(body, f"$.data.{f}"), f"data.{f} is required") for f in ("kind", "source", "title", "body")]
    fields += [((action == "add_distillation") & _blank(body, f"$.data.{f}"), f"data.{f} is required") for f in ("question", "answer")]
    fields += [(add & _kind(body, f"$.data.{f}").isNotNull() & ~_kind(body, f"$.data.{f}").isin("string", "void"), f"data.{f} must be a string") for f in ("external_id", "author", "url")]
    fields += [(add & ~F.coalesce(_kind(body, f"$.data.{f}").startswith("object") | (_kind(body, f"$.data.{f}") == "void"), F.lit(True)), f"data.{f} must be an object") for f in ("metadata", "payload")]
    fields.append(((action == "add_distillation") & ~F.coalesce(_text(body, "$.data.confidence").isin(*CONFIDENCES), F.lit(False)), "data.confidence is unknown"))
    return first_problem(
        (~F.coalesce(is_object, F.lit(False)), "request must be an object"), (action.isNull() | ~action.isin(*ACTIONS), "unknown action"), (~F.coalesce(data.startswith("object"), F.lit(False)), "data must be an object"), *fields,
    )


def rating_problem(body: Column) -> Column:
    """What is wrong with a rating, null if nothing is."""
    v = F.try_parse_json(body)
    rating, shared, zip_ = F.try_variant_get(v, "$.rating", "double"), _kind(body, "$.pack_shared"), _text(body, "$.pack_zip")
    is_shared = F.try_variant_get(v, "$.pack_shared", "boolean")
    return first_problem(
        (~F.coalesce(_kind(body, "$").startswith("object"), F.lit(False)), "rating must be an object"), *[(_blank(body, f"$.{f}"), f"{f} is required") for f in ("response_id", "session_id", "turn_id")],
        (rating.isNull() | (rating != F.floor(rating)), "rating must be an integer"), (~rating.between(LEAST_RATING, MOST_RATING), "rating is out of range"), (F.length(_text(body, "$.comment")) > MAX_COMMENT, "comment is too long"),
        (F.coalesce(shared, F.lit("")) != "boolean", "pack_shared must be a boolean"), (~is_shared & zip_.isNotNull(), "pack_zip needs pack_shared"), (is_shared & F.coalesce(zip_ == "", F.lit(True)), "pack_zip is required"),
    )


def validated(requests: DataFrame, body: str, problem=request_problem) -> DataFrame:
    return requests.withColumn("detail", problem(F.col(body))).withColumn("is_valid", F.col("detail").isNull())


def authorised(requests: DataFrame, contributors: DataFrame, key: str = "api_key") -> DataFrame:
    """Requests with a known key that was not revoked, known by its SHA-256 alone; the key itself is dropped."""
    live = contributors.where("revoked_at IS NULL").select(F.col("api_key_hash").alias("_k"), F.col("id").alias("author_id"))
    return requests.withColumn("_k", F.sha2(key, 256)).join(live, "_k").drop("_k", key)


def near_questions(questions: DataFrame, known: DataFrame, least: float = SAME_QUESTION) -> DataFrame:
    """id, known_id, similarity: the known question most like each new one, if it is over `least`.

    Only pairs that share one of the new question's rarest trigrams are compared: Jaccard over s needs a shared gram
    among any (1 - s) of the grams in a common order.
    """
    from corpusforge.functions.vectors import trigrams

    def grams(df, key):
        return df.select(F.col("id").alias(key), "question", trigrams("question").alias("g"))

    new, old = grams(questions, "id"), grams(known, "known_id")
    order = old.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df, key):
        each = df.select(key, F.size("g").alias("size"), F.explode("g").alias("gram")).join(order, "gram", "left")
        ranked = each.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("all"))
        keep = (F.floor(F.col("size") * (1 - least)) + 1).cast("int")
        return ranked.select(key, F.explode(F.slice("all.gram", F.lit(1), keep)).alias("gram"))

    pairs = prefix(new, "id").join(prefix(old, "known_id"), "gram").select("id", "known_id").distinct()
    both = pairs.join(new.select("id", F.col("question").alias("q")), "id").join(old.select("known_id", "question"), "known_id")
    scored = both.select("id", "known_id", trigram_similarity("q", "question").alias("similarity")).where(F.col("similarity") > least)
    best = scored.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("known_id")).alias("k"))).alias("b"))
    return best.select("id", (-F.col("b.k")).alias("known_id"), F.col("b.similarity").alias("similarity"))


def accept_distillations(new: DataFrame, known: DataFrame) -> DataFrame:
    """New questions that aren't asked yet and whose supersedes_id, if given, exists; they wait as pending."""
    fresh = new.join(near_questions(new, known).select("id"), "id", "left_anti")
    held = known.select(F.col("id").alias("supersedes_id")).distinct()
    linked = fresh.where("supersedes_id IS NOT NULL").join(held, "supersedes_id", "left_semi")
    return fresh.where("supersedes_id IS NULL").unionByName(linked).withColumn("status", F.lit("pending"))


def accept_resources(new: DataFrame, known: DataFrame) -> DataFrame:
    return append_new(known, new, ["source", "external_id"])


def public_view(messages: DataFrame, hidden: tuple = ("api_key_hash", "payload")) -> DataFrame:
    """Rows and columns that anyone may see."""
    shown = messages.drop(*hidden)
    tests = [~F.coalesce(F.col(c), F.lit(False)) for c in ("is_deleted",) if c in shown.columns]
    return shown.where(reduce(lambda a, b: a & b, tests)) if tests else shown


def issue_key(author_id) -> tuple[str, dict]:
    """A new random key for a contributor, to be shown once, and the row to store: the key's hash alone."""
    import hashlib
    import secrets

    key = secrets.token_urlsafe(32)
    return key, {"id": author_id, "api_key_hash": hashlib.sha256(key.encode()).hexdigest(), "revoked_at": None}
