"""Language-model scores by context-tree weighting, beside a unigram base.

A text is its words (A-Z lower-cased), each with a closing blank, and one end mark. Its bytes are coded one after the
other, each as eight binary decisions from the top bit down. A decision sees the DEPTH bytes before it, across the
bounds of words; DEPTH start marks stand before a text. For every decision the contexts of all depths form a tree: each
node has a Krichevsky-Trofimov estimate of its own counts, and weighting mixes, bottom up, the node's estimate with the
product of its children. A context that was never seen is coded by the deepest one seen.

Counts of all contexts come from every training document and all are kept. A task hands on the distinct contexts of its
texts, sorted and packed by bucket; a bucket holds whole subtrees (a hash of the TOP nearest bytes of the context), so
one task merges and weighs it. Only the depths above TOP, whose size the alphabet bounds, come to the driver and go to
all tasks. The cost of a byte is computed once for each distinct context and byte of the corpus. Those with the HEAD
highest counts are looked up where the text lies; all others meet their cost in a join, and so do rare words for the
base. What is gathered grows with the corpus; the heads only decide where something is looked up, not its value.

Nulls and the rest: null text is empty (the end alone). Null doc_id or held_out is not held out. Repeated rows count
each. With no training document every decision costs one bit and no token is known. Long texts are coded a piece at a
time. Only doc_id, text and held_out are read; other columns, whatever their names, are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, arrow_rows, lean, stored

#: Bytes of context; seven at most, as a context and its byte are one 64-bit number.
DEPTH = 6
#: Contexts of this depth and deeper are dealt to buckets.
TOP = 3
#: Most contexts and bytes, and words, that are looked up without a join.
HEAD, WORD_HEAD = 1 << 21, 1 << 18
#: Bytes of text that are coded at a time, and distinct contexts that a task holds before it merges them.
_PIECE, _HELD = 1 << 20, 1 << 22
#: Contexts that are counted before they are merged with those that a task holds, and handed on at a time.
_FRESH, _SENT = 1 << 20, 1 << 18
_EMPTY = np.uint64((1 << 64) - 1)  # no context: 255 is not a byte of UTF-8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LN2 = float(np.log(2))


def line_of(text: bytes | None) -> bytes:
    """The bytes that are coded, behind the start marks."""
    words = (text or b"").lower().split()
    return b"\n" * DEPTH + b" ".join(words) + (b" \t" if words else b"\t")


def _mask(depth: int) -> np.uint64:
    """Keeps the byte and `depth` bytes of its context."""
    return np.uint64((((1 << 8 * depth) - 1) << (64 - 8 * depth)) | 255)


def keys_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte of the lines: its context, the nearest byte on top, with the byte itself below; its line."""
    lens = np.array([len(x) for x in lines], np.int64)
    a = np.frombuffer(b"".join(lines), np.uint8)
    key = a.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        key[k:] |= a[: len(a) - k].astype(np.uint64) << np.uint64(64 - 8 * k)
    coded = np.ones(len(a), bool)
    starts = np.cumsum(lens) - lens
    coded[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[coded], np.repeat(np.arange(len(lines)), lens - DEPTH)


def _pieces(texts: list) -> list:
    """(index, line) of texts, some _PIECE bytes at a time."""
    held, size = [], 0
    for i, t in enumerate(texts):
        line = line_of(t)
        # A long line goes in pieces that overlap by their context.
        for at in range(0, max(1, len(line) - DEPTH), _PIECE):
            part = line[at : at + _PIECE + DEPTH]
            held.append((i, part))
            size += len(part)
            if size >= _PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series at x + 6."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    z = x + 6
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


#: log Gamma of n + 1/2 and of n + 1 for small n.
_SMALL = 4096
_HALF, _WHOLE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _lg(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = _lgamma(n[large] + plus)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability of a sequence with n0 zeros and n1 ones under the KT estimator."""
    return _lg(n0, _HALF, 0.5) + _lg(n1, _HALF, 0.5) - np.log(np.pi) - _lg(n0 + n1, _WHOLE, 1.0)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple:
    """The distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, *counts
    by = np.argsort(keys, kind="stable")  # runs that are sorted already
    keys = keys[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(c[by], first) for c in counts)


def _levels(keys: np.ndarray, n: np.ndarray, deep: int, last: int) -> list[tuple]:
    """For depths `deep` down to `last`: contexts and bytes, their counts, and where each of the level before went."""
    out = [(keys, n.astype(float), None)]
    for d in range(deep - 1, last - 1, -1):
        some, inverse = np.unique(out[-1][0] & _mask(d), return_inverse=True)
        out.append((some, np.bincount(inverse, out[-1][1], len(some)), inverse))
    return out


def _nodes(u: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes at bit b: first row of each, the node of each row, and the name of each."""
    upper = u >> np.uint64(8 - b)
    new = np.concatenate((np.ones(min(1, len(u)), bool), upper[1:] != upper[:-1]))
    first = np.flatnonzero(new)
    name = (u[first] & ~np.uint64(255)) | np.uint64(1 << b) | ((u[first] & np.uint64(255)) >> np.uint64(8 - b))
    return first, np.cumsum(new) - 1, name


def _weigh(levels: list[tuple], b: int, below: tuple | None = None) -> tuple[list[tuple], tuple]:
    """For each level at bit b: node of each row, weight of a node's own estimate, its estimates of a zero and a one, whether
    it was seen, its name; and names and weighted log-probabilities of the last level's nodes.

    below: names (of nodes of the first level) and summed log-probabilities of what lies deeper.
    """
    out, held = [], None
    for u, n, inverse in levels:
        first, node, name = _nodes(u, b)
        bit = ((u >> np.uint64(7 - b)) & np.uint64(1)).astype(float)
        n1, total = np.add.reduceat(n * bit, first), np.add.reduceat(n, first)
        own = _log_kt(total - n1, n1)
        if held is not None:
            inner = np.bincount(node[inverse[held[0]]], held[1], len(first))
        elif below is not None:
            inner = below[1][np.searchsorted(below[0], name)]
        if held is None and below is None:
            logs, weight = own, np.ones(len(first))
        else:
            logs = np.logaddexp(own, inner) - _LN2
            weight = np.exp(own - _LN2 - logs)
        both = np.empty(2 * len(first))
        both[0::2], both[1::2] = (total - n1 + 0.5) / (total + 1), (n1 + 0.5) / (total + 1)
        out.append((node, weight, both, total > 0, name))
        held = (first, logs)
    return out, (out[-1][4], held[1])


def subtrees(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the nodes of depth TOP - 1 above whole subtrees, and the sums of the log-probabilities of their children."""
    levels = _levels(keys, n, DEPTH, TOP)
    names, logs = [], []
    for b in range(8):
        name, log = _weigh(levels, b)[1]
        names.append(name & _mask(TOP - 1))
        logs.append(log)
    return _summed(np.concatenate(names), np.concatenate(logs))


def top_tables(keys: np.ndarray, n: np.ndarray, names: np.ndarray, logs: np.ndarray) -> list[tuple]:
    """For depths TOP - 1 down to 0: names of the nodes, weights, estimates and whether seen. keys: contexts of depth TOP - 1.

    names, logs: sorted nodes of that depth and what `subtrees` gave them in all.
    """
    levels = _levels(keys, n, TOP - 1, 0)
    parts: list[list] = [[] for _ in levels]
    for b in range(8):
        for i, (_, weight, both, seen, name) in enumerate(_weigh(levels, b, (names, logs))[0]):
            parts[i].append((name, weight, both.reshape(-1, 2), seen))
    out = []
    for p in parts:
        name, weight, both, seen = (np.concatenate(x) for x in zip(*p))
        by = np.argsort(name)
        out.append((name[by], weight[by], both[by], seen[by]))
    return out


def costs(keys: np.ndarray, n: np.ndarray, top: list[tuple]) -> np.ndarray:
    """log10 of the model's probability of each context's byte; keys are whole subtrees, sorted, with their counts."""
    levels = _levels(keys, n, DEPTH, 0)
    deep = DEPTH - TOP + 1
    rows = [np.arange(len(keys))]
    for _, _, inverse in levels[1:]:
        rows.append(inverse[rows[-1]])
    total = np.zeros(len(keys))
    for b in range(8):
        tables = [t[:4] for t in _weigh(levels[:deep], b)[0]]
        for (u, _, _), (name, weight, both, seen) in zip(levels[deep:], top):
            _, node, mine = _nodes(u, b)
            at = np.searchsorted(name, mine)
            tables.append((node, weight[at], both[at].ravel(), seen[at]))
        bit = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64)
        p, left, last = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        for (node, weight, both, seen), row in zip(reversed(tables), reversed(rows)):
            at = node[row]
            there, q = seen[at], both[2 * at + bit]
            w = np.where(there, weight[at], 0)
            p += left * w * q
            left *= 1 - w
            last = np.where(there, q, last)
        total += np.log10(p + left * last)
    return total


class Lookup:
    """A table from contexts to costs with open addressing, filled and asked many at a time."""

    PROBES = 12

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits)
        todo = np.arange(len(keys))
        for k in range(self.PROBES):  # what finds no place is met in the join instead
            slot = self._slot(keys[todo], k)
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[todo[free]]
            placed = self.keys[slot] == keys[todo]
            self.values[slot[placed]] = values[todo[placed]]
            todo = todo[~placed]

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * _MIX >> np.uint64(64 - self.bits)).astype(np.int64) + k) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 if it isn't here; and the places of those that aren't."""
        slot = self._slot(keys, 0)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        out[miss] = 0
        lost = []
        for k in range(1, self.PROBES):
            if not len(miss):
                break
            at = self._slot(keys[miss], k)
            found = self.keys[at] == keys[miss]
            out[miss[found]] = self.values[at[found]]
            end = self.keys[at] == _EMPTY
            lost.append(miss[end])
            miss = miss[~found & ~end]
        lost.append(miss)
        return out, np.sort(np.concatenate(lost))


def _bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _context_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket and packed: sorted contexts and bytes, how often each comes in training documents, and how often in all."""

    def count(batches):
        held, fresh = [], 0

        def merged():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()  # the parts would stay in memory beside the whole
            keys, *counts = _summed(*columns)
            return keys, *(c.astype("<u4") for c in counts)

        for b in batches:
            texts, out = _bytes(b.column(0)), b.column(1).to_pylist()
            for kind in (False, True):
                for piece in _pieces([t for t, o in zip(texts, out) if o is kind]):
                    keys, n = np.unique(keys_of([x for _, x in piece])[0], return_counts=True)
                    n = n.astype("<u4")
                    held.append((keys, n * np.uint32(not kind), n))
                    fresh += len(keys)
                    if fresh > _FRESH:
                        held, fresh = [merged()], 0
                        if len(held[0][0]) > _HELD // 2:
                            yield from packed(*held.pop())
        if held:
            held = [merged()]
            yield from packed(*held.pop())

    def packed(keys, n, m):
        bucket = ((keys >> np.uint64(64 - 8 * TOP)) * _MIX >> np.uint64(20)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        bucket, ends = bucket[first].astype(np.int32), np.append(first[1:], len(by))
        for some in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first // _SENT)) + 1):
            columns = [pa.array([c[by[first[i] : ends[i]]].tobytes() for i in some], pa.binary()) for c in (keys, n, m)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[some]), *columns], names=["bucket", "keys", "n", "m"])

    return docs.select("text", "held_out").mapInArrow(lean(count), "bucket int, keys binary, n binary, m binary")


def _bucketed(batches, form: str):
    """keys, n and m of one bucket after the other, merged."""
    bucket, held, size = None, [], 0
    for b in batches:
        for k, *packed in zip(*(c.to_pylist() for c in b.columns[:4])):
            if k != bucket:
                if held:
                    yield bucket, *_summed(*(np.concatenate(x) for x in zip(*held)))
                bucket, held, size = k, [], 0
            held.append([np.frombuffer(x, t).astype(t[:2] + "8") for x, t in zip(packed, ("<u8", form, form))])
            size += len(held[-1][0])
            if size > _HELD:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                size = -(1 << 62) if len(held[0][0]) > _HELD else len(held[0][0])  # a large bucket is merged at its end
    if held:
        yield bucket, *_summed(*(np.concatenate(x) for x in zip(*held)))


def context_costs(docs: DataFrame) -> DataFrame:
    """key, cost and m (occurrences in all documents) of every context and byte of docs (text, held_out)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _context_counts(docs, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket")

    def grow(batches):
        for bucket, keys, n, m in _bucketed(batches, "<u4"):
            names, logs = subtrees(keys, n)
            short, counts = _summed(keys & _mask(TOP - 1), n)
            values = [[bucket], [keys.tobytes()], [n.tobytes()], [m.tobytes()], [names.view(np.int64)], [logs], [short.view(np.int64)], [counts.astype(np.int64)]]
            kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.list_(t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["bucket", "keys", "n", "m", "names", "logs", "short", "counts"])

    form = "bucket int, keys binary, n binary, m binary, names array<long>, logs array<double>, short array<long>, counts array<long>"
    leaves = Stored(counted.mapInArrow(lean(grow), form), "ctw-leaves")

    def summed(key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = leaves.df.select(F.explode(F.arrays_zip(key, value)).alias("x")).groupBy(f"x.{key}").agg(F.sum(f"x.{value}").alias("v")).toArrow()
        k, v = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        return _summed(k, v.astype(float))

    names, logs = summed("names", "logs")
    short, counts = summed("short", "counts")
    shared = spark.sparkContext.broadcast(top_tables(short, counts, names, logs) if len(short) else [])

    def cost(batches):
        for _, keys, n, m in _bucketed(batches, "<i8"):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(costs(keys, n, shared.value)), pa.array(m)], names=["key", "cost", "m"])

    out = stored(leaves.df.select("bucket", "keys", "n", "m").mapInArrow(lean(cost), "key long, cost double, m long"), "ctw-costs")
    leaves.drop()
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """word and n of the words of docs (text)."""

    def count(batches):
        held, size = [], 0

        def merged():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            got = pc.value_counts(_split(b.column(0))[0])
            held.append(pa.table({"word": got.field(0), "n": got.field(1)}))
            size += len(got)
            if size > 1 << 18:
                held = [merged()]
                size = held[0].num_rows
                if size > 1 << 17:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    rows = docs.select("text").mapInArrow(lean(count), "word string, n long").where("word != ''")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _split(texts) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, some of them empty, and the text that each is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))


def _head(rows: DataFrame, n: str, most: int) -> int:
    """The least count such that at most `most` rows reach it; counts over 2^16 are told apart by four digits."""
    coarse = F.col(n) - F.col(n) % F.pow(F.lit(10), F.floor(F.log10(n)) - 3).cast("long")
    bins = rows.groupBy(F.when(F.col(n) < 1 << 16, F.col(n)).otherwise(coarse).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    have, least = 0, 1 << 62
    for r in bins.orderBy(F.desc("c")).collect():  # below 2^16 rows and 9,000 for each power of ten
        have += r["k"]
        if have > most:
            break
        least = r["c"]
    return least


_held: dict = {}


def _lookup(shared) -> Lookup:
    """The worker's table of a broadcast; that of the one before goes."""
    if _held.get("of") is not shared:
        _held.clear()
        _held.update(of=shared, table=Lookup(*shared.value[:2]))
    return _held["table"]


def score_documents(docs: DataFrame, head: int = HEAD, word_head: int = WORD_HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; docs has a held_out column."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    learnt = docs.where("NOT held_out")
    words = stored(_word_counts(learnt), "lm-words")
    each = context_costs(docs)

    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learnt.count()  # the end of a text is a token too
    total = size["n"] + ends
    floor = float(total + 0.5 * (size["v"] + (ends > 0) + 1))

    def base(n):
        return np.log10((n + 0.5) / floor)

    least, word_least = _head(each, "m", head), _head(words, "n", word_head)
    top = each.where(F.col("m") >= least).select("key", "cost").toArrow()
    common = words.where(F.col("n") >= word_least).select("word", "n").toArrow()
    place = dict(zip(_bytes(common.column(0)), range(common.num_rows)))
    shared = spark.sparkContext.broadcast((top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy(), place, base(common.column(1).to_numpy())))
    end = float(base(ends))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look_up(batches):
        find, (_, _, place, bases) = _lookup(shared), shared.value
        for b in batches:
            rows, m = b.column(0).to_numpy(), b.num_rows
            # The model: a cost for each byte.
            score, lost_row, lost_key = np.zeros(m), [], []
            for piece in _pieces(_bytes(b.column(1))):
                keys, line = keys_of([x for _, x in piece])
                text = np.array([i for i, _ in piece])[line]
                cost, lost = find(keys)
                score += np.bincount(text, cost, m)
                lost_row.append(rows[text[lost]])
                lost_key.append(keys[lost])
            # The base: a cost for each word.
            flat, text = _split(b.column(1))
            coded = flat.dictionary_encode()
            kinds = _bytes(coded.dictionary)
            at = np.array([place.get(w, -1) if w else -2 for w in kinds], np.int64)
            code = coded.indices.to_numpy()
            of = at[code]
            known, rare, there = of >= 0, of == -1, of != -2
            sums = np.bincount(text[known], bases[of[known]], m) + end
            tokens = np.bincount(text[there], minlength=m) + 1
            pair, k = np.unique(text[rare] * max(1, len(kinds)) + code[rare], return_counts=True)
            odd_row, odd = rows[pair // max(1, len(kinds))], coded.dictionary.take(pa.array(pair % max(1, len(kinds))))
            lost_row, lost_key = (np.concatenate([np.empty(0, x), *y]) for x, y in ((np.int64, lost_row), (np.uint64, lost_key)))
            yield batch(m, rows, b.column(2), b.column(3), tokens, np.bincount(text[known], minlength=m) + (ends > 0), sums, score)
            if len(lost_row):
                yield batch(len(lost_row), lost_row, key=pa.array(lost_key.view(np.int64)))
            if len(odd_row):
                yield batch(len(odd_row), odd_row, word=odd, k=pa.array(k))

    fields = {"row": "long", "doc_id": kind, "held_out": "boolean", "n_tokens": "long", "known": "long", "base": "double", "score": "double", "key": "long", "word": "string", "k": "long"}
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def batch(n, *columns, **more):
        given = dict(zip(fields, columns)) | more
        arrays = [(x if isinstance(x, pa.Array) else pa.array(x)) if (x := given.get(f)) is not None else pa.nulls(n, ids if f == "doc_id" else kinds[t]) for f, t in fields.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(fields))

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id", "held_out")
    parts = stored(rows.mapInArrow(lean(look_up), ", ".join(f"{f} {t}" for f, t in fields.items())), "lm-parts")
    bytes_ = parts.where("key IS NOT NULL").select("row", "key").join(each.select("key", "cost"), "key").groupBy("row").agg(F.sum("cost").alias("more"))
    n = F.coalesce("n", F.lit(0))
    odd = parts.where("word IS NOT NULL").select("row", "word", "k").join(words, "word", "left").groupBy("row")
    odd = odd.agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((n + 0.5) / floor)).alias("more_base"))
    whole = parts.where("n_tokens IS NOT NULL").drop("key", "word", "k").join(bytes_, "row", "left").join(odd, "row", "left")
    plus = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("known", "more_known"), ("base", "more_base"), ("score", "more"))}
    return whole.select(
        "doc_id", "held_out", "n_tokens", plus["known"].cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus["base"].alias("base_score"), plus["score"].alias("score"),
    )
