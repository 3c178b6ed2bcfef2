"""Keeping derived vectors current: change decisions, a deduplicated job queue, refresh and cleanup plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKOFF_BASE, BACKOFF_LEAST, BACKOFF_MOST, BACKOFF_STEPS = 5, 5, 300, 6
MAX_ATTEMPTS, MAX_CLAIM = 5, 64


def _jobs(*cases) -> Column:
    """Array of (representation, job_kind, source_op): the case of each representation that applies."""
    made = [F.when(test, F.struct(F.lit(rep).alias("representation"), F.lit(job).alias("job_kind"), F.lit(op).alias("source_op"))) for test, rep, job, op in cases]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _first(op: Column, *cases):
    """Cases of one operation, of which only the first that holds applies."""
    out, before = [], F.lit(False)
    for test, *rest in cases:
        test = F.coalesce(test, F.lit(False))
        out.append((op & test & ~before, *rest))
        before = before | test
    return out


def message_jobs(op: Column, old_deleted: Column, new_deleted: Column, changed: Column) -> Column:
    gone, was = F.coalesce(new_deleted, F.lit(False)), F.coalesce(old_deleted, F.lit(False))
    return _jobs(
        (( op == "insert") & ~gone, "prose", "embed", "insert"),
        *_first(op == "update", (gone & ~was, "prose", "drop", "soft_delete"), (changed, "prose", "reembed", "update")),
        (op == "delete", "prose", "drop", "delete"),
    )


def resource_jobs(op: Column, old_code: Column, new_code: Column, prose_changed: Column, code_changed: Column) -> Column:
    """old_code, new_code: whether the row has code to embed before and after."""
    o, n = F.coalesce(old_code, F.lit(False)), F.coalesce(new_code, F.lit(False))
    return _jobs(
        (op == "insert", "prose", "embed", "insert"), ((op == "insert") & n, "code", "embed", "insert"),
        ((op == "update") & F.coalesce(prose_changed, F.lit(False)), "prose", "reembed", "update"), ((op == "update") & n & F.coalesce(code_changed, F.lit(False)), "code", "reembed", "code_change"), ((op == "update") & o & ~n, "code", "drop", "kind_change"),
        (op == "delete", "prose", "drop", "delete"), ((op == "delete") & o, "code", "drop", "delete"),
    )


def distillation_jobs(op: Column, old_status: Column, new_status: Column, changed: Column) -> Column:
    o, n = (F.coalesce(s.isin("pending", "approved"), F.lit(False)) for s in (old_status, new_status))
    return _jobs(
        ((op == "insert") & n, "prose", "embed", "insert"),
        *_first(op == "update", (o & ~n, "prose", "drop", "status_change"), (n & (F.coalesce(changed, F.lit(False)) | ~o), "prose", "reembed", "update")),
        (op == "delete", "prose", "drop", "delete"),
    )


def pending(jobs: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One pending job per identity: the newest intent wins."""
    newest = F.struct(*order, *[c for c in jobs.columns if c not in [*identity, *order]])
    return jobs.groupBy(*identity).agg(F.max(newest).alias("_j"), F.count(F.lit(1)).alias("merged")).select(*identity, "_j.*", "merged")


def backoff(attempts) -> Column:
    """Seconds until the next attempt."""
    return F.greatest(F.lit(BACKOFF_LEAST), F.least(F.lit(BACKOFF_MOST), F.lit(BACKOFF_BASE) * F.pow(F.lit(2), F.least(F.greatest(attempts, F.lit(1)), F.lit(BACKOFF_STEPS))))).cast("int")


def claim(queue: DataFrame, now: Column, worker: str, n: int, lease_seconds: int = 300) -> DataFrame:
    """The n oldest due jobs, taken by a worker."""
    due = queue.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    taken = due.orderBy("next_attempt_at", "id").limit(max(1, min(MAX_CLAIM, n)))
    return taken.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(worker), "lease_until": now + F.make_dt_interval(secs=F.lit(lease_seconds))})


def fail(jobs: DataFrame, now: Column, retryable: Column) -> DataFrame:
    """Failed jobs wait for another attempt, or are given up."""
    again = retryable & (F.col("attempts") < MAX_ATTEMPTS)
    return jobs.withColumns({"status": F.when(again, "pending").otherwise("failed"), "next_attempt_at": F.when(again, now + F.make_dt_interval(secs=backoff(F.col("attempts")))).otherwise(F.col("next_attempt_at")), "lease_owner": F.lit(None).cast("string")})


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease has run out are pending again."""
    lapsed = (F.col("status") == "processing") & (F.col("lease_until") < now)
    return jobs.withColumn("status", F.when(lapsed, "pending").otherwise(F.col("status"))).withColumn("lease_owner", F.when(lapsed, None).otherwise(F.col("lease_owner")))


def finalize_outcome(status, job_kind, contract_ok, source_hash, expected_hash, valid) -> Column:
    """What becomes of a worked job."""
    return (
        F.when(status != "processing", "not_processing").when(~contract_ok, "contract_mismatch").when(job_kind == "drop", "dropped").when(~source_hash.eqNullSafe(expected_hash), "source_changed").when(~valid, "validation_failed").otherwise("completed")
    )


def refresh_actions(stored: DataFrame, fresh: DataFrame, item: str) -> DataFrame:
    """What each item's stored representation needs: skip, upsert, quarantine, unavailable or drop."""
    s = stored.select(F.col(item).alias("_i"), F.col("hash").alias("_h"), F.col("version").alias("_v"))
    both = fresh.join(s, fresh[item] == s["_i"], "full_outer")
    action = (
        F.when(F.col(item).isNull(), "drop").when(F.col("public_state") == "quarantined", "quarantine").when(F.col("public_state") == "unavailable", "unavailable")
        .when(F.col("hash").eqNullSafe(F.col("_h")) & F.col("version").eqNullSafe(F.col("_v")), "skip").otherwise("upsert")
    )
    return both.select(F.coalesce(item, "_i").alias(item), action.alias("action"))


def ineligible(vectors: DataFrame, live: dict[str, DataFrame]) -> DataFrame:
    """Vectors whose item is not in the live items of its entity type (each: item_id)."""
    parts = [vectors.where(F.col("entity_type") == k).join(ids.select("item_id").distinct(), "item_id", "left_anti") for k, ids in live.items()]
    return reduce(DataFrame.unionByName, parts)


def backfill_plan(source: DataFrame, current: DataFrame, key: str, max_items: int = 64, max_tokens: int = 8000) -> DataFrame:
    """Batches of the items (key, hash, tokens) that are not current, in key order within hashed lanes.

    A batch closes at max_items items or, by running total, max_tokens tokens; no order spans all rows.
    """
    todo = source.join(current.select(key, F.col("hash").alias("_h")), key, "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")
    todo = todo.withColumn("lane", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 64)
    w = Window.partitionBy("lane").orderBy(key)
    run = F.sum("tokens").over(w) - F.col("tokens")
    return todo.withColumn("batch", F.greatest(F.floor((F.row_number().over(w) - 1) / max_items), F.floor(run / max_tokens)))


def switch_allowed(vectors: DataFrame, old: int, new: int) -> bool:
    """Whether the new contract covers at least as many identities as the old."""
    n = {r["contract_id"]: r["n"] for r in vectors.where(F.col("contract_id").isin(old, new)).groupBy("contract_id").agg(F.countDistinct("entity_type", "item_id").alias("n")).collect()}
    return n.get(new, 0) >= n.get(old, 0)


def superseded_beyond(contracts: DataFrame, keep: int) -> DataFrame:
    """Superseded contracts but for the newest `keep`; an active one is never among them."""
    old = contracts.where("status = 'superseded'")
    newest = old.orderBy(F.desc("created_at"), "id").limit(keep).select("id")
    return old.join(F.broadcast(newest), "id", "left_anti")


def backfill_counters(actions: DataFrame, source: str = "source", reason: str = "action") -> DataFrame:
    """How many items of each source had each outcome, with the share in the source."""
    n = actions.groupBy(source, reason).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(source).agg(F.sum("n").alias("_all"))
    return n.join(whole, source).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def finalize(stored: DataFrame, worked: DataFrame, chunks: DataFrame, identity: list[str]) -> DataFrame:
    """Stored chunks after jobs were worked: worked has identity and outcome (`finalize_outcome`), chunks what they made.

    All chunks of an identity are replaced together where its job completed, and go where it was dropped; any other
    outcome leaves what is stored. Identities without a job stay as they are.
    """
    ended = worked.where(F.col("outcome").isin("completed", "dropped")).select(*identity).distinct()
    made = chunks.join(worked.where("outcome = 'completed'").select(*identity).distinct(), identity, "left_semi")
    return stored.join(ended, identity, "left_anti").unionByName(made)


def remediation(rows: DataFrame, code, body) -> DataFrame:
    """Safe or quarantined by the authoritative code, prose rebuilt without it, and one hash over both."""
    from corpusforge.functions.text import hash_form, public_state
    from corpusforge.operators.representations import strip_code

    prose = strip_code(body)
    return rows.withColumns({"state": public_state(code), "prose": prose, "combined_hash": F.sha2(hash_form(F.concat(prose, F.lit("\n\n# python representation\n\n"), F.coalesce(code, F.lit("")))), 256)})


def advance(cursors: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors after updates (source, expected_version, cursor, done): compare and swap on the version.

    An update that expects another version changes nothing, and a cursor never goes back. `applied` tells which held.
    """
    u = updates.select("source", "expected_version", F.col("cursor").alias("_to"), F.col("done").alias("_done"))
    both = cursors.join(u, "source", "left")
    ok = F.coalesce(F.col("expected_version") == F.col("version"), F.lit(False))
    return both.select(
        "source", F.when(ok, F.greatest("cursor", "_to")).otherwise(F.col("cursor")).alias("cursor"), (F.col("version") + ok.cast("int")).alias("version"),
        (F.col("done") + F.when(ok, F.coalesce("_done", F.lit(0))).otherwise(0)).alias("done"), ok.alias("applied"),
    )


def freshness(manifest: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """What a payload computed now may be used for: ready, unavailable (gone, unsafe or changed since the manifest)."""
    c = current.select(F.col(key).alias("_k"), F.col("hash").alias("_h"), F.col("public_state").alias("_s"))
    both = manifest.join(c, manifest[key] == c["_k"], "left")
    ready = F.coalesce((F.col("hash") == F.col("_h")) & (F.col("_s") == "safe"), F.lit(False))
    return both.select(key, F.when(ready, "ready").otherwise("unavailable").alias("payload"))
