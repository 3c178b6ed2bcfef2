"""Token-id files of directly addressable codes.

Each id is split into chunks of eight bits, the lowest first. Level 0 has the lowest chunk of every id; a bitmap says
which ids go on, and level 1 has the next chunk of just those, and so forth. A rank directory beside each bitmap counts
the set bits before every 512th, so the place of an id's next chunk is found without decoding any block: any token
of any document can be read by itself.

Layout of a segment (little-endian), a run of whole documents in ascending doc_id:
  "DAC1", u32 documents, u64 ids, u32 levels
  i64 doc_id of each document, u8 1 if it is not null, u64 first id of each document and the end
  per level: u64 n, n chunk bytes, then but for the last level ceil(n / 8) bitmap bytes and u32 ranks[ceil(n / 512)]
Segments are rows of a Parquet table (part, seq, part_start, n_docs, n_tokens, data), which Spark writes to whatever
store the cluster uses; a segment is closed at SEGMENT ids, a longer document has one to itself.

Nulls and the rest: null text is empty and gives the end id alone. Null doc_ids come first. Rows that repeat a doc_id
follow one another in order of their text. An empty table gives no segment.
"""

from __future__ import annotations

import itertools
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, arrow_rows, lean, small_table

SEGMENT = 1 << 17
END_ID = 2
STRIDE = 512
#: Bytes of words and their ids that a task remembers, some 40 a word, and bytes of text that it encodes together.
CACHE = 24 << 20
TOGETHER = 1 << 20
#: Words that pass the library together: some of its work goes with memory that long lines drop out of a core's cache.
LINE = 1024
_TOKENS = 1 << 20
_HEAD = "<4sIQI"
#: What models put behind the last token of a word.
_WORD_END = "</w>"
#: Marks that are taken off the end of a word.
MARKS = ".,;:!?"
#: Words whose lower-casing is by character, and which are composed: letters up to U+024F but for the dotted capital I.
_NAMED = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[{MARKS}]*$"


def pack_levels(ids: np.ndarray) -> bytes:
    """The levels of ids, as in the layout above, after the u32 number of levels."""
    levels = []
    now = ids.astype(np.uint32)
    while True:
        levels.append(now)
        more = now > 255
        if not more.any():
            break
        now = now[more] >> np.uint32(8)
    out = []
    for k, x in enumerate(levels):
        out += [struct.pack("<Q", len(x)), (x & np.uint32(255)).astype(np.uint8).tobytes()]
        if k + 1 < len(levels):
            more = x > 255
            ahead = np.concatenate(([0], np.cumsum(more)))
            out += [np.packbits(more, bitorder="little").tobytes(), ahead[: len(x) : STRIDE].astype("<u4").tobytes()]
    return struct.pack("<I", len(levels)) + b"".join(out)


def pack_segment(doc_ids: list, parts: list[np.ndarray]) -> bytes:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("<u8")
    levels = pack_levels(np.concatenate(parts) if parts else np.empty(0, np.uint32))
    return b"".join((
        struct.pack("<4sIQ", b"DAC1", len(doc_ids), int(starts[-1])), levels[:4],
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), starts.tobytes(), levels[4:],
    ))


class Segment:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_tokens, levels = struct.unpack_from(_HEAD, data)
        if magic != b"DAC1":
            raise ValueError("not a token segment")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        ids, there = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, there)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            chunk = take("u1", n)
            self.levels.append((chunk, take("u1", -(-n // 8)), take("<u4", -(-n // STRIDE))) if k + 1 < levels else (chunk, None, None))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before i."""
        _, bits, ahead = self.levels[level]
        if i >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0])
        block = i // STRIDE
        return int(ahead[block]) + int(np.unpackbits(bits[block * STRIDE // 8 : i // 8 + 1], bitorder="little")[: i - block * STRIDE].sum())

    def token(self, i: int) -> int:
        """Id number i of the segment."""
        value = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * level
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids start to end of the segment."""
        chunk, bits, _ = self.levels[level]
        out = chunk[start:end].astype(np.uint32)
        if bits is not None and end > start:
            more = np.flatnonzero(np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start])
            if len(more):
                first = self._rank(level, start)
                out[more] |= self.tokens(first, first + len(more), level + 1) << np.uint32(8)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def _gathered(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pieces of ids numbered `at`, one behind the other."""
    n = lens[at]
    end = np.cumsum(n)
    return ids[np.repeat(starts[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class WordEncoder:
    """A tokenizers-library encoder that remembers words between blanks.

    Right only for tokenizers that drop white space and never join across it (checked on a probe). Words of plain
    letters are lower-cased and composed here and pass the library without its normaliser, which gives the same ids
    much sooner; all others pass the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare, self.letters = (Tokenizer(self.whole.model) for _ in range(2))  # one vocabulary for all three
        self.bare.pre_tokenizer = self.whole.pre_tokenizer
        # A word of letters alone is never split further, so blanks suffice to cut a line of them.
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if any(" " in a.content or "\n" in a.content for a in self.whole.get_added_tokens_decoder().values()):
            raise ValueError("this tokenizer has added tokens with blanks")
        # Tokens that end a word, where the model marks them so.
        self.last = np.zeros(max(self.whole.get_vocab().values()) + 1, bool)
        self.last[[i for w, i in self.whole.get_vocab().items() if w.endswith(_WORD_END)]] = True
        self.forget()
        probe = "It's a Test, ünder\n10 x1."
        if self._library([probe])[0] != b"".join(self._library(probe.replace("\n", " ").split(" "))):
            raise ValueError("this tokenizer looks across white space")

    def forget(self) -> None:
        """Empty the memory: the known words, and where the ids of each are and how many."""
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    @staticmethod
    def _encode(words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        ids, lens = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), LINE):
            part = words[at : at + LINE]
            e = encode(part)
            ids.append(np.array(e.ids, np.uint32))
            lens.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(lens)

    def _encode_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, lower-cased and composed: lines of them, without the library's places of tokens."""
        ids, lens = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        ends = [*range(0, len(words), LINE), len(words)]
        for line, n in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " "), np.diff(ends)):
            (e,) = self.letters.encode_batch_fast([line.as_py()], add_special_tokens=False)
            got = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.last[got])
            if len(last) == n and last[-1] == len(got) - 1:
                ids.append(got)
                lens.append(np.diff(last, prepend=-1))
            else:  # a model without such marks
                for kept, more in zip((ids, lens), self._encode(line.as_py().split(" "), lambda part: self.letters.encode(" ".join(part), add_special_tokens=False))):
                    kept.append(more)
        return np.concatenate(ids), np.concatenate(lens)

    def _apart(self, part: list[str]):
        return self.bare.encode([w.lower() for w in part], is_pretokenized=True, add_special_tokens=False)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember distinct new words; the number of each."""
        named = pc.match_substring_regex(new, _NAMED).to_numpy(zero_copy_only=False)
        # Words of letters and the marks behind them are always apart: each is encoded once.
        fast, slow = new.filter(pa.array(named)), new.filter(pa.array(~named))
        bare = pc.utf8_rtrim(fast, MARKS)
        cores = pc.utf8_lower(bare).dictionary_encode()
        marked = pc.not_equal(pc.binary_length(fast), pc.binary_length(bare))
        marks = pc.replace_with_mask(pa.repeat("", len(fast)), marked, pc.replace_substring_regex(fast.filter(marked), f"^[^{MARKS}]+", "")).dictionary_encode()
        core_ids, core_lens = self._encode_letters(cores.dictionary)
        mark_ids, mark_lens = self._encode(marks.dictionary.to_pylist(), self._apart)
        n = len(fast)
        at = np.stack((cores.indices.to_numpy(), marks.indices.to_numpy() + len(core_lens)), axis=1).ravel()
        lens = np.concatenate((core_lens, mark_lens))
        ids = [_gathered(np.concatenate((core_ids, mark_ids)), np.cumsum(lens) - lens, lens, at)]
        lens = [lens[at].reshape(n, 2).sum(axis=1)]
        # The others: plain ones pass without the normaliser, the rest through all of the library.
        words = slow.to_pylist()
        plain = np.array([w.isprintable() and "<" not in w and (w.isascii() or (max(w) < "ɐ" and unicodedata.is_normalized("NFC", w))) for w in words], bool)
        bare_ids, bare_lens = self._encode([w for w, p in zip(words, plain) if p], self._apart)
        odd = self._library([w for w, p in zip(words, plain) if not p])
        ids += [bare_ids, np.frombuffer(b"".join(odd), "<u4")]
        lens += [bare_lens, np.fromiter(map(len, odd), np.int64, len(odd)) // 4]
        first, number = len(self.known), np.empty(len(new), np.int64)
        order = np.concatenate((np.flatnonzero(named), np.flatnonzero(~named)[plain], np.flatnonzero(~named)[~plain]))
        number[order] = first + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        lens = np.concatenate(lens)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lens) - lens))
        lens = lens.astype(np.int32)
        self.lens, self.ids = np.concatenate((self.lens, lens)), np.concatenate((self.ids, *ids))
        return number

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text (an Arrow array of strings, null is empty). The words of all are learnt together."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if self.known.nbytes + self.ids.nbytes + self.starts.nbytes + self.lens.nbytes > CACHE:
            self.forget()
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null()
        number = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            number[new.to_numpy(zero_copy_only=False)] = self._learn(words.filter(new))
        code, ends = coded.indices.to_numpy(), [np.zeros(1, np.int64)]
        out = []
        for lo in range(0, len(code), _TOKENS):  # bounds the memory for long texts
            at = number[code[lo : lo + _TOKENS]]
            out.append(_gathered(self.ids, self.starts, self.lens, at))
            ends.append(np.cumsum(self.lens[at]) + ends[-1][-1])
        ids = np.concatenate(out) if out else np.empty(0, np.uint32)
        cut = np.concatenate(ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.split(ids, cut[1:-1]) if len(texts) else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, knowing no words: the library does not give back all memory of one that goes, so tasks share it."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].forget()
    return _encoders[path]


def _joined(batches, size: int):
    """Batches of `size` bytes or little more."""
    held, have = [], 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        have += b.nbytes
        if have >= size:
            yield from whole()
            held, have = [], 0
    if held:
        yield from whole()


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT, name: str = "token-segments") -> Stored:
    """Encode all texts and write the segments, in ascending doc_id over parts and in them."""
    arrow_rows(docs.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        ids, parts, held = [], [], 0

        def flush():
            data = pack_segment(ids, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([done], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "seq", "part_start", "n_docs", "n_tokens", "data"],
            )

        for b in _joined(batches, TOGETHER):
            for d, coded in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1))):
                x = np.concatenate((coded, end))
                if held and held + len(x) > segment:
                    yield flush()
                    seq, done, ids, parts, held = seq + 1, done + held, [], [], 0
                ids.append(d)
                parts.append(x)
                held += len(x)
        if ids:
            yield flush()
        enc.forget()  # the words go with the task

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return Stored(rows.mapInArrow(lean(pack), "part int, seq int, part_start long, n_docs int, n_tokens long, data binary"), name)


def read_documents(segments: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read by rank."""
    spark = segments.sparkSession
    arrow_rows(spark)
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per write task
    bases = [0, *itertools.accumulate(r["n"] for r in sums)][: len(sums)]

    def read(batches):
        for b in batches:
            for part, first, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = Segment(data)
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(s.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * s.n_docs, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + first), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "part_start", "data").mapInArrow(lean(read), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    base = small_table(spark, {"part": ([r["part"] for r in sums], pa.int32()), "base": (bases, pa.int64())})
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the token file of docs and read it back, a row per document."""
    return read_documents(write_segments(docs, tokenizer, **how).df)
