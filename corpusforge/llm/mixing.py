"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in a fixed pseudo-random order, form blocks. Block i of a source with weight w is released at
floor(i / w) and due at ceil((i + 1) / w); each slot of the schedule goes to the released block that is due first.
Then no source is ever a whole block away from its share of the slots so far. Weights are integers w of a total W, so
the schedule repeats every W slots: one period (at most RESOLUTION slots or 16 a source) is scheduled on the driver
and broadcast, and the slot of any block follows by arithmetic.

Sources shorter than their share start over, each pass an epoch, until every block of every source was scheduled
once: no document is dropped. Default weights are sizes to the power TEMPERATURE, which lifts small sources.

Nulls and the rest: null source is a source of its own; null texts and ids are hashed like others. Repeated rows are
scheduled one after the other, each by itself. A source that has no weight in a given map raises. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import small_table, unused

BLOCK = 64
TEMPERATURE = 0.7
RESOLUTION = 10_000
#: Most slots of a period that are broadcast, some 60 bytes each; beyond, the schedule is joined by a shuffle.
BROADCAST_SLOTS = 500_000
#: Rows of a source that one task orders at a time.
BUCKET = 20_000


def whole_weights(target: dict, resolution: int = RESOLUTION) -> dict:
    """Integer weights in proportion to target, one at least, that add up to resolution or 16 times the sources."""
    target = {k: v for k, v in target.items() if v > 0}
    total, most = sum(target.values()), max(resolution, 16 * len(target))
    out = {k: max(1, int(v * most / total)) for k, v in target.items()}
    for k in sorted(out, key=lambda k: (out[k] - target[k] * most / total, str(k))):  # the most short-changed first
        if sum(out.values()) >= most:
            break
        out[k] += 1
    return out


def period(weights: dict) -> list:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    waiting = [(0, str(k), k, 0) for k in weights]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[k]), name, k, i))
        _, name, k, i = heapq.heappop(ready)
        out.append(k)
        if i + 1 < weights[k]:
            heapq.heappush(waiting, ((i + 1) * total // weights[k], name, k, i + 1))
    return out


def _key():
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def ranked(docs: DataFrame, key: str, rank: str) -> DataFrame:
    """docs with `key` (source, null apart) and `rank` (from 0 in its source).

    Order in a source: a hash of the row. Buckets of the hash are counted first, then ordered each by itself, so a hot
    source is spread over many tasks.
    """
    h, b, row, c, ahead = unused([*docs.columns, key, rank], "_h", "_b", "_row", "_c", "_before")
    rows = docs.withColumn(key, _key()).withColumn(h, F.xxhash64(F.lit("mix"), "doc_id", "text"))
    buckets = max(64, -(-docs.count() // BUCKET))
    rows = rows.withColumn(b, F.pmod(h, F.lit(buckets)))
    sizes = rows.groupBy(key, b).agg(F.count(F.lit(1)).alias(c))
    before = sizes.select(key, b, (F.sum(c).over(Window.partitionBy(key).orderBy(b)) - F.col(c)).alias(ahead))
    rows = rows.withColumn(row, F.row_number().over(Window.partitionBy(key, b).orderBy(h, "doc_id")))
    return rows.join(before, [key, b]).withColumn(rank, F.col(ahead) + F.col(row) - 1).drop(b, h, ahead, row)


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, names: tuple = ("slot", "epoch", "block_no", "place")) -> DataFrame:
    """docs, once for each time it is scheduled, with its slot, epoch, block_no and place (its row in the block).

    weights: by source (None for null source); sizes to the power TEMPERATURE if not given. names: of the four columns;
    columns of docs that are called so are replaced.
    """
    spark = docs.sparkSession
    slot, epoch, block_no, place = names
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {n.lower() for n in names}])
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = {k: n**TEMPERATURE for k, n in sizes.items()}
    if missing := [k for k in sizes if not weights.get(k)]:
        raise ValueError(f"no weight for source {missing[0]!r}")
    share = whole_weights({k: weights[k] for k in sizes}) if sizes else {}
    total = sum(share.values())
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    # The least horizon at which every block was scheduled: block b - 1 of each source is due by ceil(b / w).
    horizon = max((-(-blocks[k] * total // share[k]) for k in sizes), default=0)
    seen: dict = {k: 0 for k in share}
    rows = []
    for at, k in enumerate(period(share) if share else []):
        rows.append(("n" if k is None else f"s{k}", seen[k], at, share[k], blocks[k]))
        seen[k] += 1
    key, rank, i, s, w, n, turn = unused([*docs.columns, *names], "_key", "_rank", "_i", "_slot", "_w", "_n", "_turn")
    table = small_table(spark, {name: ([r[at] for r in rows], pa.int64() if at else pa.string()) for at, name in enumerate((key, i, s, w, n))})
    few = len(rows) <= BROADCAST_SLOTS
    per = table.groupBy(key).agg(F.first(w).alias(w), F.first(n).alias(n))
    out = ranked(docs, key, rank).join(F.broadcast(per) if few else per, key)
    out = out.withColumn(block_no, F.floor(F.col(rank) / block)).withColumn(place, F.col(rank) % block)
    # Turns of the block: block_no, block_no + blocks, ... as long as its source gets that many slots by the horizon.
    most = F.floor(F.lit(horizon) * F.col(w) / F.lit(max(total, 1))) + 1
    out = out.withColumn(turn, F.explode(F.sequence(F.col(block_no), F.greatest(most, F.col(block_no)), F.col(n))))
    slots = table.select(key, i, s)
    out = out.withColumn(i, F.col(turn) % F.col(w)).join(F.broadcast(slots) if few else slots, [key, i])
    out = out.withColumn(slot, F.floor(F.col(turn) / F.col(w)) * total + F.col(s)).withColumn(epoch, F.floor(F.col(turn) / F.col(n)))
    return out.where((F.col(slot) < horizon) | (F.col(epoch) == 0)).select(*docs.columns, *names)


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """The mixture, a row for each time that a document is scheduled; columns of docs."""
    names = tuple(unused(docs.columns, "slot", "epoch", "block_no", "place"))
    return schedule(docs, weights, block, names).select(*docs.columns)
