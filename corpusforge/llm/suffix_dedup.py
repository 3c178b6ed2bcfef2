"""Removal of repeated passages with suffix arrays made by two-stage sorting.

A byte goes if it lies in a string of LENGTH bytes that starts anywhere else too. Suffix arrays of the whole corpus
don't fit anywhere, so passages that can match are brought together first: each window of LENGTH bytes picks an anchor,
its GRAM-byte piece with the least hash, so equal windows pick equal anchors at the same place. Around an anchor lies
its region: all windows that could have picked it. Then

* an anchor seen once proves that no window around it repeats;
* regions that are equal byte for byte (64-bit hashes of them, under one anchor hash) repeat as a whole;
* of what remains, one copy of each region goes, by anchor, to a task that sorts its suffixes: those smaller than
  their successor directly, all others induced by a scan over the buckets of first bytes; neighbours in suffix
  order with a common prefix of LENGTH or more are repeats.

Nulls and the rest: null text is empty. Matches never cross documents; rows that repeat a doc_id are documents of
their own, so equal rows remove each other's text. A row is known by a 64-bit hash of its doc_id and text, which is the
same whenever the input is read again. Null doc_ids are kept as they are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_rows, lean, stored

LENGTH = 200
GRAM = 64
#: Bytes of regions that are sorted at a time; a larger group of one anchor is sorted whole.
BUFFER = 1 << 19
#: Strings that are compared byte by byte at a time.
_ROWS = 1 << 15
#: An anchor with more regions than this is hot: its regions are dealt anew by SPLIT longer pieces, of which every
#: window around the anchor holds one.
HOT = 1000
SPLIT = 4


def _encode(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


_VALUES, _BASE = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse modulo 2^64."""
    global _POWERS
    have = _POWERS
    if len(have[0]) < n:
        both = []
        for x in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        have = tuple(both)
        if n <= 1 << 22:
            _POWERS = have
    return have[0][:n], have[1][:n]


def _gram_hashes(a: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on; the last size - 1 are of no use.

    Polynomials of the bytes' values modulo 2^64, as differences of running sums; `size` is far below the length of
    strings (1,024) that such polynomials are known to confuse.
    """
    if len(a) < size:
        return np.ones(len(a), np.uint64)
    up, down = _powers(len(a))
    sums = np.cumsum(_VALUES[a] * up)
    h = sums.copy()
    h[: len(a) - size + 1] = sums[size - 1 :]
    h[1 : len(a) - size + 1] -= sums[: len(a) - size]
    h *= down
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) | np.uint64(1)  # never 0


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of the `width` values from each place on."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(x) - step] = best(out[: len(x) - step], out[step:].copy())
        have += step
    return out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor: pieces that are least in some window of their text."""
    lens = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    if len(a) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.repeat(np.cumsum(lens), lens)
    h = _gram_hashes(a, gram)
    span = length - gram + 1
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # equal ones are all anchors
    low = _sliding(short, span, np.minimum)
    low[np.arange(len(a)) + length > ends] = 0  # no window starts there
    high = _sliding(np.concatenate((np.zeros(span - 1, np.uint32), low)), span, np.maximum)[: len(a)]
    at = np.flatnonzero(high == short)
    at = at[at + gram <= ends[at]]
    text = np.searchsorted(np.cumsum(lens), at, side="right")
    return text, at - (np.cumsum(lens) - lens)[text], h[at]


def suffix_order(text: np.ndarray, ends: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places up to `last` of each part of a text in the order of their suffixes, compared over `length` bytes.

    ends: the end of the part that each place is in; parts don't see each other. last: whether a suffix there is wanted.
    """
    n = len(text)
    t = np.concatenate((text.astype(np.int16) + np.int16(1), np.zeros(1, np.int16)))
    place = np.arange(n, dtype=np.int32)
    stop = place + 1 == ends
    # A suffix is smaller than its successor if the next different byte is larger; at a part's end it is larger.
    diff = np.where(stop, np.int16(-1), t[1:] - t[:-1])
    nxt = np.where(diff != 0, place, np.int32(n - 1))
    small = diff[np.minimum.accumulate(nxt[::-1])[::-1]] > 0
    del diff, nxt, place
    # Wanted suffixes and those from which they are induced: on to the next small one.
    use = last.copy()
    while True:
        lead = np.flatnonzero(use & ~small & ~stop)
        lead = lead[~use[lead + 1]] + 1
        if not len(lead):
            break
        use[lead] = True
    direct = _sorted(text, ends, np.flatnonzero(use & small), length)
    by_first = _split(direct, t[direct])
    large = use & ~small
    made: list[list[np.ndarray]] = [[] for _ in range(258)]
    # The ends of parts, empty suffixes, come first of all.
    feed = np.flatnonzero(large & stop)
    for c, part in enumerate(_split(feed, t[feed])):
        if len(part):
            made[c].append(part)
    order = []
    for c in range(1, 257):
        got = np.concatenate(made[c]) if made[c] else np.empty(0, np.int64)
        rounds = [got]
        while len(got):  # runs of one byte
            before = got[(got > 0)] - 1
            got = before[large[before] & ~stop[before] & (t[before] == c)]
            rounds.append(got)
        whole = np.concatenate([*rounds, by_first[c]])
        if not len(whole):
            continue
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[large[before] & ~stop[before] & (t[before] > c)]
        if len(before):
            for k, part in enumerate(_split(before, t[before])):
                if len(part):
                    made[k].append(part)
    return np.concatenate(order) if order else np.empty(0, np.int64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts as they do; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def _sorted(text: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of the strings of up to `length` bytes there, compared directly.

    Equal whole strings are compared once (they are told by a hash, and neighbours are compared byte by byte later). The
    rest goes by first words, and only where those tie by all bytes, a bounded number of rows at a time.
    """
    if not len(at):
        return at
    h = _gram_hashes(text, 128)
    h = np.concatenate((h, np.zeros(length, np.uint64)))
    full = at + length <= ends[at]
    name = np.where(full & (length >= 128), h[at] * np.uint64(0x9E3779B97F4A7C15) ^ h[at + max(0, length - 128)], at.astype(np.uint64) << np.uint64(1))
    del h
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    kinds = at[first]
    # First words; beyond the end of a part there are zeros.
    word = _words(text)[kinds]
    have = np.minimum(ends[kinds] - kinds, 8).astype(np.uint64)
    word &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * have) if len(word) else word
    by = np.argsort(word, kind="stable")
    word = word[by]
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
    ties = [(lo, hi) for lo, hi in zip(new[:-1].tolist(), new[1:].tolist()) if hi - lo > 1]
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(length, np.uint8))), length)
    i = 0
    while i < len(ties):  # ties that follow one another are sorted together
        j, rows = i + 1, ties[i][1] - ties[i][0]
        while j < len(ties) and rows + ties[j][1] - ties[j][0] <= _ROWS:
            rows += ties[j][1] - ties[j][0]
            j += 1
        spots = np.concatenate([np.arange(lo, hi) for lo, hi in ties[i:j]])
        some = kinds[by[spots]]
        block = padded[some]
        block[np.arange(length) >= (ends[some] - some)[:, None]] = 0
        by[spots] = by[spots][np.argsort(block.view(f"S{length}").ravel(), kind="stable")]
        i = j
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    return at[np.argsort(rank[same], kind="stable")]


def _split(x: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """x by key 0 to 256, each in the order of x."""
    by = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[by], np.arange(258))
    return [x[by[cuts[c] : cuts[c + 1]]] for c in range(257)]


def repeated_starts(parts: list[bytes], names: list[tuple], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the places where `length` bytes start that start elsewhere as well.

    names: what document a part is from and where in it; two parts may hold the same place, which is no repeat.
    """
    lens = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lens) - lens
    text = np.frombuffer(b"".join(parts), np.uint8)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), lens)
    ends = (starts + lens).astype(np.int32)[part]
    wanted = np.arange(length, len(text) + length, dtype=np.int32) <= ends
    order = suffix_order(text, ends, wanted, length)
    order = order[wanted[order]]
    if len(order) < 2:
        return [np.empty(0, np.int64) for _ in parts]
    # Common prefixes of neighbours, eight bytes at a time, as far as `length`.
    words = _words(text)
    same = np.ones(len(order) - 1, bool)
    live = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        equal = words[order[live] + k] == words[order[live + 1] + k]
        same[live[~equal]] = False
        live = live[equal]
    # Runs of equal windows repeat if they come from two places at least.
    run = np.concatenate(([0], np.cumsum(~same)))
    doc = {d: i for i, d in enumerate(dict.fromkeys(d for d, _ in names))}
    base = np.array([(doc[d] << 40) + at for d, at in names], np.int64)
    where = base[part[order]] + order - starts[part[order]]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    many = np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)
    hit = order[many[run]]
    return _by_part(hit, part, starts, len(parts))


def _promising(parts: list[bytes], names: list[tuple], length: int = LENGTH) -> list[int]:
    """Numbers of the parts with a string of `length` bytes whose hash comes from two places: no other can have a repeat."""
    lens = np.array([len(p) for p in parts], np.int64)
    if lens.sum() < length:
        return []
    a = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum(lens) - lens
    part = np.repeat(np.arange(len(parts), dtype=np.int32), lens)
    whole = np.flatnonzero(np.arange(len(a)) + length <= (starts + lens)[part])
    h = _gram_hashes(a, length)[whole]
    by = np.argsort(h)
    h, whole = h[by], whole[by]
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    if len(first) == len(h):
        return []
    doc = {d: i for i, d in enumerate(dict.fromkeys(d for d, _ in names))}
    where = np.array([(doc[d] << 40) + at for d, at in names], np.int64)[part[whole]] + whole - starts[part[whole]]
    many = np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)
    return np.unique(part[whole[many[np.cumsum(new) - 1]]]).tolist()


def _by_part(hit, part, starts, n):
    owner = part[hit]
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(n + 1))
    return [hit[by[cuts[i] : cuts[i + 1]]] - starts[i] for i in range(n)]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of consecutive numbers."""
    x = np.unique(x)
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.concatenate(([0], cut + 1))].tolist(), x[np.concatenate((cut, [len(x) - 1]))].tolist()))


def _find_anchors(rows: DataFrame) -> DataFrame:
    """row, at, a (anchor hash) and r (region hash) of all anchors; those of a batch that agree in a and r are one row.

    n: how many they are; more: row and at of all but the first, null if there is one. So a passage that stands in a
    large share of all documents comes to the task that counts it with few rows.
    """
    form = pa.struct([("row", pa.int64()), ("at", pa.int32())])

    def find(batches):
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            texts = _encode(b.column(1).to_pylist())
            ids = b.column(0).to_numpy()
            text, at, h = anchors(texts)
            r = np.array([digest(texts[i][max(0, p - LENGTH + GRAM) : p + LENGTH]) ^ (p < LENGTH - GRAM) * p for i, p in zip(text.tolist(), at.tolist())], np.uint64)
            by = np.lexsort((r, h))
            h, r, row, at = h[by], r[by], ids[text[by]], at[by].astype(np.int32)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
            n = np.diff(np.append(first, len(h)))
            rest = np.ones(len(h), bool)
            rest[first] = False
            values = pa.StructArray.from_arrays([pa.array(row[rest]), pa.array(at[rest])], fields=list(form))
            more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n - 1))).astype(np.int32)), values, mask=pa.array(n == 1))
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(at[first]), pa.array(h[first].view(np.int64)), pa.array(r[first].view(np.int64)), pa.array(n), more], names=["row", "at", "a", "r", "n", "more"])

    return rows.select("row", "text").mapInArrow(lean(find), "row long, at int, a long, r long, n long, more array<struct<row: long, at: int>>")


def _regions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, row, start and bytes of the region of each wanted anchor (row, at, a, hot).

    The key is the anchor's. A hot anchor's region is cut in SPLIT overlapping parts instead: part j has the windows that
    hold the piece from j / SPLIT of the slack before the anchor on, and its key is the hash of that piece.
    """

    def cut(batches):
        from xxhash import xxh3_64_intdigest as digest

        slack = LENGTH - GRAM
        for b in batches:
            out: list[list] = [[], [], [], []]
            for row, text, list_ in zip(b.column(0).to_pylist(), _encode(b.column(1).to_pylist()), b.column(2).to_pylist()):
                for w in list_:
                    spans = [(w["a"], max(0, w["at"] - slack), w["at"] + LENGTH)]
                    if w["hot"]:
                        spans = []
                        for j in range(SPLIT):  # windows that start slack * j / SPLIT to slack * (j + 1) / SPLIT before the anchor
                            near, far = slack * j // SPLIT, slack * (j + 1) // SPLIT
                            lo, hi = w["at"] - near, w["at"] - far + LENGTH
                            if lo >= 0 and hi <= len(text):
                                spans.append((digest(text[lo:hi], seed=j) - (1 << 63), max(0, w["at"] - far), min(len(text), w["at"] - near + LENGTH)))
                    for a, lo, hi in spans:
                        for x, y in zip(out, (a, row, lo, text[lo:hi])):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["a", "row", "start", "part"])

    per_row = wanted.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("at", "a", "hot")).alias("w"))
    return rows.join(per_row, F.col("row") == F.col("_row")).select("row", "text", "w").mapInArrow(lean(cut), "a long, row long, start int, part binary")


def _sort_regions(regions: DataFrame) -> DataFrame:
    """row, low, high: runs of window starts that repeat, found by suffix arrays of regions with like anchors."""

    def work(batches):
        parts, names, held, key, mine = [], [], 0, None, 0

        def alone():  # a region whose key no other has
            nonlocal held
            if mine == 1:
                held -= len(parts.pop())
                names.pop()

        def flush():
            some = _promising(parts, names)
            few = [names[i] for i in some]
            out = [(row, start + lo, start + hi) for (row, start), hit in zip(few, repeated_starts([parts[i] for i in some], few) if few else []) for lo, hi in _runs(hit)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int32(), pa.int32()))], names=["row", "low", "high"])

        for b in batches:
            for a, row, start, part in zip(*(b.column(i).to_pylist() for i in range(4))):
                if a != key:
                    alone()
                    if held > BUFFER:
                        yield flush()
                        parts, names, held = [], [], 0
                    key, mine = a, 0
                mine += 1
                parts.append(part)
                names.append((row, start))
                held += len(part)
        alone()
        if parts:
            yield flush()

    return regions.repartition("a").sortWithinPartitions("a", "row", "start").mapInArrow(lean(work), "row long, low int, high int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    anchor, region = Window.partitionBy("a"), Window.partitionBy("a", "r")
    found = _find_anchors(rows).withColumn("n_r", F.sum("n").over(region)).withColumn("first", F.row_number().over(region.orderBy("row", "at")) == 1)
    found = found.withColumn("mixed", F.min("r").over(anchor) != F.max("r").over(anchor)).where("n_r > 1 OR mixed")
    found = found.withColumn("hot", F.sum(F.col("first").cast("int")).over(anchor) > HOT)
    found = stored(found.select("row", "at", "a", "hot", (F.col("n_r") > 1).alias("whole"), (F.col("mixed") & F.col("first")).alias("sort"), "more"), "repeat-anchors")
    whole = found.where("whole").select("row", "at").unionByName(found.where("whole").select(F.inline("more")))
    whole = whole.select("row", F.greatest(F.col("at") - (LENGTH - GRAM), F.lit(0)).alias("low"), F.col("at").alias("high"))
    arrow_rows(spark, 2000)
    runs = stored(_sort_regions(_regions(rows, found.where("sort").select("row", "at", "a", "hot"))), "repeat-runs")
    arrow_rows(spark)
    lists = whole.unionByName(runs).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("low", "high")).alias("runs"))

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, runs_ in zip(_encode(b.column(1).to_pylist()), b.column(2).to_pylist()):
                kept, last, removed, spans = [], 0, 0, 0
                most = len(text) - LENGTH
                for lo, hi in sorted((r["low"], r["high"]) for r in runs_ or []):
                    hi = min(hi, most)
                    if hi < lo:
                        continue
                    if lo > last or not spans:
                        kept.append(text[last:lo])
                        spans += 1
                        removed += hi + LENGTH - lo
                        last = hi + LENGTH
                    elif hi + LENGTH > last:
                        removed += hi + LENGTH - last
                        last = hi + LENGTH
                kept = b"".join([*kept, text[last:]])
                for x, y in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    x.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole_rows = rows.join(lists, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "runs")
    return whole_rows.mapInArrow(lean(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
