"""Text and code representations: code blocks, chunks with overlap, coverage. Arrow-batched; code is parsed, never run."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP, PER_TOKEN = 512, 50, 4
CHUNKS = "chunk_index int, chunk_text string, method string, start int"


def normal(text: str) -> str:
    import unicodedata

    lines = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(line.rstrip(" \t\f\v") for line in lines).strip()


def _pieces(text: str, cut: str) -> Iterator[tuple[int, int]]:
    """Spans between matches of cut, without empty ones."""
    at = 0
    for m in re.finditer(cut, text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _spans(text: str, target: int) -> tuple[list[tuple[int, int]], str]:
    """Spans of paragraphs; of sentences or fixed windows where a paragraph is over 1.5 times the target."""
    room, out, how = target * PER_TOKEN, [], "paragraph"
    for a, b in _pieces(text, r"\n{2,}"):
        if b - a <= 1.5 * room:
            out.append((a, b))
            continue
        how = "sentence"
        for c, d in _pieces(text[a:b], r"(?<=[.!?])\s+"):
            if d - c <= 1.5 * room:
                out.append((a + c, a + d))
            else:
                out += [(x, min(x + room, a + d)) for x in range(a + c, a + d, room)]
    return out, how


def chunk_prose(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, str, int]]:
    """(text, method, start) of each chunk: whole paragraphs up to the target, each after the tail of the one before."""
    text = normal(text or "")
    if not text:
        return []
    spans, how = _spans(text, target)
    packs: list[list[int]] = []
    for a, b in spans:
        if packs and b - packs[-1][0] <= target * PER_TOKEN:
            packs[-1][1] = b
        else:
            packs.append([a, b])
    tail = overlap * PER_TOKEN
    return [(text[max(a - tail, packs[i - 1][0]) if i else a : b].strip(), how, a) for i, (a, b) in enumerate(packs)]


def chunk_code(text: str | None, target: int = TARGET, lines: int = 60) -> list[tuple[str, str, int]]:
    """(text, method, first line) of each chunk: whole top-level statements of Python, else windows of lines."""
    rows = normal(text or "").split("\n")
    if rows == [""]:
        return []
    try:
        starts = sorted({min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in ast.parse("\n".join(rows)).body} | {0})
        how = "ast"
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        starts, how = list(range(0, len(rows), lines)), "lines"
    packs: list[list[int]] = []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        if packs and sum(len(x) + 1 for x in rows[packs[-1][0] : b]) <= target * PER_TOKEN:
            packs[-1][1] = b
        else:
            packs.append([a, b])
    return [("\n".join(rows[a:b]), how, a + 1) for a, b in packs]


def chunk_lines(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, str, int]]:
    """(text, method, first line) of each chunk: whole lines up to the target, after as many of the last as the overlap holds."""
    text = normal(text or "")
    if len(text) <= target * PER_TOKEN:
        return [(text, "single", 1)] if text else []
    rows, out, first, begin = text.split("\n"), [], 0, 0
    size = -1
    for i, row in enumerate(rows):
        if i > begin and size + len(row) + 1 >= target * PER_TOKEN:
            out.append((first, i))
            first, room = i, overlap * PER_TOKEN
            while first > begin and len(rows[first - 1]) + 1 <= room:
                first, room = first - 1, room - len(rows[first - 1]) - 1
            begin, size = i, sum(len(x) + 1 for x in rows[first:i]) - 1
        size += len(row) + 1
    out.append((first, len(rows)))
    made = [("\n".join(rows[a:b]).strip(), "window", a + 1) for a, b in out]
    return [c for c in made if c[0]]


def coverage_ok(text: str, chunks: list[str]) -> bool:
    """No character kind of the text is missing from its chunks, and they are together as long."""
    whole = "".join(normal(text).split())
    joined = "".join("".join(chunks).split())
    return set(whole) <= set(joined) and len(joined) >= len(whole)


def chunked(docs: DataFrame, text: str, keys: list[str], code: bool = False, lines: bool = False, **how) -> DataFrame:
    """One row per chunk, with its hash; keys carry over."""
    rows = docs.select(*keys, F.col(text).alias("_t"))
    names = [*keys, "chunk_index", "chunk_text", "method", "start"]
    cut = chunk_code if code else chunk_lines if lines else chunk_prose

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                out += [(*row[:-1], i, *c) for i, c in enumerate(cut(row[-1], **how))]
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", " + CHUNKS
    return rows.mapInPandas(run, schema).withColumn("chunk_hash", F.sha2("chunk_text", 256))


FENCE = r"(?s)```(\w*)\n(.*?)```"


def code_blocks(c):
    """The fenced code blocks of a text."""
    return F.regexp_extract_all(c, F.lit(FENCE), F.lit(2))


def strip_code(c):
    return F.trim(F.regexp_replace(c, FENCE, ""))


def cohort(payload, body):
    """Where a row's authoritative code comes from."""
    return F.when(F.coalesce(F.trim(payload), F.lit("")) != "", "payload").when(F.size(code_blocks(body)) > 0, "body").otherwise("none")


def equivalence(old: DataFrame, new: DataFrame, item: list[str]) -> DataFrame:
    """Chunk by chunk comparison of two chunkings: counts of equal, changed, added and removed chunks."""
    key = [*item, "chunk_index"]
    both = old.select(*key, F.col("chunk_hash").alias("o")).join(new.select(*key, F.col("chunk_hash").alias("n")), key, "full_outer")
    return both.agg(F.count_if(F.col("o") == F.col("n")).alias("equal"), F.count_if(F.col("o") != F.col("n")).alias("changed"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"))


def find_secrets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per finding: key, reason, start, length; the secret itself is never stored."""
    from corpusforge.functions.text import SECRET_SHAPES

    def run(frames):
        shapes = {k: re.compile(v) for k, v in SECRET_SHAPES.items()}
        for pdf in frames:
            out = [(k, r, m.start(), len(m[0])) for k, t in zip(pdf[key], pdf[text]) for r, s in shapes.items() for m in s.finditer(t or "")]
            yield pd.DataFrame(out, columns=[key, "reason", "start", "length"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, reason string, start int, length int")
