"""Searchable semantics of graph workflows: media, task, families, nodes, models, and how sure one can be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
MARK = "Workflow semantics"
#: Words by which media, tasks and families are told.
MEDIA = {"video": ["video", "animatediff", "frames"], "image": ["image", "photo", "picture"], "audio": ["audio", "music", "speech"]}
TASKS = {"image_to_video": ["i2v", "image to video", "img2vid"], "text_to_video": ["t2v", "text to video"], "text_to_image": ["t2i", "text to image", "txt2img"], "upscale": ["upscale", "upscaler"], "inpaint": ["inpaint"]}
FAMILIES = {"wan": ["wan"], "ltx": ["ltx"], "flux": ["flux"], "sdxl": ["sdxl"], "hunyuan": ["hunyuan"]}


def _found(text: Column, table: dict) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(name)) for name, words in table.items()]), lambda x: x.isNotNull())


def directions(task: Column) -> Column:
    """What goes in and what comes out."""
    parts = F.split(task, "_to_")
    return F.when(task.contains("_to_"), F.array(F.struct(F.get(parts, F.lit(0)).alias("from"), F.get(parts, F.lit(1)).alias("to")))).otherwise(F.array().cast("array<struct<from:string,to:string>>"))


def with_semantics(rows: DataFrame, title: str, body: str, nodes: str, models: str) -> DataFrame:
    """rows with a `semantics` struct, from texts and arrays of node classes and model files."""
    text = F.concat_ws("\n", title, body, F.array_join(nodes, " "), F.array_join(models, " "))
    task = F.coalesce(F.get(_found(text, TASKS), F.lit(0)), F.lit("unknown"))
    media = F.coalesce(F.get(_found(text, MEDIA), F.lit(0)), F.when(task.contains("video"), "video").when(task.contains("image"), "image"), F.lit("unknown"))
    parseable = F.size(nodes) > 0
    sure = F.when(parseable & (task != "unknown"), "high").when(parseable | (task != "unknown") | (media != "unknown"), "medium").otherwise("low")
    families = _found(text, FAMILIES)
    aliases = F.array_distinct(F.concat(families, F.filter(F.array(task, media, F.regexp_replace(task, "_", " ")), lambda x: x != "unknown")))
    return rows.withColumn("semantics", F.struct(media.alias("media_type"), task.alias("task_type"), families.alias("model_families"), directions(task).alias("adapter_directions"), F.array_sort(F.array_distinct(nodes)).alias("node_types"), F.array_distinct(models).alias("models"), aliases.alias("searchable_aliases"), sure.alias("confidence"), parseable.alias("parseable_workflow")))


def projection(semantics: str = "semantics") -> Column:
    """The semantics as lines of text, in a fixed order, without empty ones."""
    s = F.col(semantics)
    lines = [("media", s["media_type"]), ("task", s["task_type"]), ("families", F.array_join(s["model_families"], ", ")), ("aliases", F.array_join(s["searchable_aliases"], ", ")), ("nodes", F.array_join(s["node_types"], ", ")), ("models", F.array_join(s["models"], ", "))]
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), v)) for k, v in lines])


def append_to_body(body: str, semantics: str = "semantics") -> Column:
    """The body with its semantics behind it; a body that has them stays."""
    said = F.concat(F.lit(f"{MARK} (rule-based): "), F.regexp_replace(projection(semantics), "\n", "; "), F.lit("."))
    return F.when(F.col(body).contains(MARK), F.col(body)).otherwise(F.concat_ws("\n\n", F.nullif(F.col(body), F.lit("")), said))


def stale(rows: DataFrame, version: str = "semantics_version") -> DataFrame:
    """Rows whose semantics are missing or of another version."""
    return rows.where(~F.coalesce(F.col(version) == VERSION, F.lit(False)))


def tags_text(metadata: Column) -> Column:
    """Tags and the summary's tags of a JSON text, with blanks between."""
    v = F.try_parse_json(metadata)
    both = [F.coalesce(F.try_variant_get(v, p, "array<string>"), F.array().cast("array<string>")) for p in ("$.tags", "$.summary.tags")]
    return F.array_join(F.array_distinct(F.concat(*both)), " ")


def strip_generated(body: Column) -> Column:
    """A body without the semantics that were put behind it."""
    lines = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n")
    return F.when(lines.rlike(f"(?m)^{MARK}"), F.regexp_replace(F.regexp_replace(lines, rf"(?ms)^{MARK}.*\z", ""), r"\s+\z", "")).otherwise(F.trim(lines))


def strip_title(body: Column, title: Column) -> Column:
    """A body, without generated semantics, that does not begin with its title and an empty line."""
    clean, head = strip_generated(body), F.trim(F.coalesce(title, F.lit("")))
    said = (head != "") & ((clean == head) | clean.startswith(F.concat(head, F.lit("\n\n"))))
    return F.when(said, F.regexp_replace(F.substring(clean, F.length(head) + 1, F.length(clean)), r"\A\s+", "")).otherwise(clean)
