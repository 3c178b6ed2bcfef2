"""SimHash near-duplicate groups found with BK-trees.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of three words (repeats count), XXH64 with seed
42 of each; a bit is set if it is set in over half of the shingles. No word: fingerprint zero, linked like any.

Links: fingerprints at most `radius` bits apart. Distinct fingerprints are dealt to shards by the bits they must
share: of `blocks` bit blocks, at least blocks - radius are untouched between two linked fingerprints, so each choice
of that many blocks is a shard key. A shard's BK-tree keys children by their integer Hamming distance to the parent;
a search follows only edges within the radius. The trees of all shards grow with the corpus, so none is broadcast
to all tasks: a shard's tree meets its own fingerprints in the task that holds the shard. A shard gives a star for
each of its groups, never all pairs, and the stars of all shards are joined by `components`.

Nulls and repeated rows: null text counts as empty; a null doc_id takes part in links but never names a component
unless all its members are null. Repeated rows each get a row. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_rows, components, lean, stored, without

RADIUS = 3
SEED = 42
#: A shard of more fingerprints than this is dealt again, by the bits that its key leaves open.
LARGE = 2048
_STEP = 1 << 16


def shingle_hashes(text: str | None, words: int = 3):
    """XXH64 of a text's shingles, repeats included, some _STEP at a time; none for a text without a word."""
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if w and len(w) < words:
        yield np.array([h(b" ".join(w), SEED)], np.uint64)
    for at in range(0, len(w) - words + 1, _STEP):
        part = w[at : at + _STEP + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - words + 1
        yield np.fromiter([h(line[s:e], SEED) for s, e in zip(starts[:m].tolist(), ends[words - 1 :].tolist())], np.uint64, m)


def folded(hashes) -> int:
    """The SimHash of hashes, given in arrays: a bit is set if it is set in over half of them; zero for none."""
    ones, n = np.zeros(64, np.int64), 0
    for got in hashes:
        bits = np.unpackbits(got.view(np.uint8).reshape(len(got), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(got)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    arrow_rows(docs.sparkSession)

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(each), f"doc_id {kind}, fp long")


class BKTree:
    """A metric tree over 64-bit values; children are keyed by their distance to the parent."""

    def __init__(self):
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        """Insert x; its index."""
        new = len(self.value)
        if new:
            at = 0
            while (nxt := self.child[at].get(d := (x ^ self.value[at]).bit_count())) is not None:
                at = nxt
            self.child[at][d] = new
        self.value.append(x)
        self.child.append({})
        return new

    def near(self, x: int, radius: int) -> list[int]:
        """Indexes of the values at most radius away; only edges within the radius are followed."""
        found, todo = [], [0] if self.value else []
        value, child = self.value, self.child
        while todo:
            at = todo.pop()
            d = (x ^ value[at]).bit_count()
            if d <= radius:
                found.append(at)
            if child[at]:
                todo += [c for e, c in child[at].items() if d - radius <= e <= d + radius]
        return found


def _stars(values: list[int], radius: int, known: int = 0, large: int = LARGE) -> dict[int, int]:
    """value -> another of its group, for the groups among distinct values. known: mask of bits they all share."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(a: int, b: int) -> None:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)

    free = [i for i in range(64) if not known >> i & 1]
    if len(values) > large and len(free) > 4 * (radius + 1):
        for k in range(radius + 1):  # the open bits in radius + 1 blocks, one of which is untouched
            bits = free[k :: radius + 1]
            mask = sum(1 << i for i in bits)
            part: dict[int, list[int]] = {}
            for v in values:
                part.setdefault(v & mask, []).append(v)
            for group in part.values():
                if len(group) > 1:
                    for a, b in _stars(group, radius, known | mask, large).items():
                        link(a, b)
    else:
        tree = BKTree()
        for v in values:
            for i in tree.near(v, radius):
                link(v, tree.value[i])
            tree.add(v)
    return {x: top(x) for x in list(up) if top(x) != x}


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks whose values deal n fingerprints to shards: finer ones for more fingerprints, exact at any n."""
    blocks = radius + 1 if n <= 1 << 20 else radius + 2 if n <= 1 << 27 else radius + 3
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << i for i in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    return [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that join all of the distinct values (column fp) at most radius bits apart."""
    masks = shard_masks(values.count(), radius)
    keyed = values.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("k.shard", "k.bits", "fp")
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches):
        held, key = [], None

        def flush():
            got = _stars([x & (1 << 64) - 1 for x in held], radius, masks[key[0]]) if len(held) > 1 else {}
            return [(_signed(a), _signed(b)) for a, b in got.items()]

        for b in batches:
            out = []
            for s, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != (s, k):
                    out += flush() if held else []
                    held, key = [], (s, k)
                held.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])
        if held and (out := flush()):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    arrow_rows(values.sparkSession)
    return keyed.repartition(n, "shard", "bits").sortWithinPartitions("shard", "bits", "fp").mapInArrow(lean(search), "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable over links)."""
    rows = stored(fingerprints(docs), "simhash")
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-values")
    found = components(links(values, radius))
    named = values.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "simhash-roots")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = stored(named.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id; all columns of docs."""
    return without(docs, simhash_groups(docs, radius).where("NOT doc_id <=> component_id").select("doc_id"))
