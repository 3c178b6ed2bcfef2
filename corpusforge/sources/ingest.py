"""Readers of raw formats: HTML pages, WebVTT captions, node graphs in JSON."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "blockquote", "pre"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.titles, self.depth, self.og = [], [], 0, ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.depth += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and dict(attrs).get("property") == "og:title":
            self.og = dict(attrs).get("content") or ""
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.depth = max(0, self.depth - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.titles.append(data)
        elif not self.depth:
            self.out.append(data)


def read_html(html: str | None) -> tuple[str | None, str]:
    """Title (og:title first) and text with one line per block."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = [" ".join(x.split()) for x in "".join(page.out).split("\n")]
    title = " ".join(page.og.split()) or " ".join("".join(page.titles).split()) or None
    return title, "\n".join(x for x in lines if x)


def extract_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    def run(frames):
        for pdf in frames:
            got = [read_html(x) for x in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "title": [g[0] for g in got], "body": [g[1] for g in got]})

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, body string")


_TIMING = re.compile(r"\d+:\d\d(?::\d\d)?[.,]\d+\s+-->")


def caption_lines(vtt: str) -> list[str]:
    """Spoken lines of a WebVTT file: no header, notes, ids, timings or inline tags."""
    out, skip, rows = [], False, vtt.replace("\r\n", "\n").split("\n")
    for i, row in enumerate(rows):
        row = row.strip()
        if row.startswith(("WEBVTT", "NOTE", "STYLE", "REGION")):
            skip = True
        elif not row:
            skip = False
        elif _TIMING.match(row):
            skip = False
        elif not skip and not (i + 1 < len(rows) and _TIMING.match(rows[i + 1].strip())):
            if text := " ".join(re.sub(r"<[^>]*>", "", row).split()):
                out.append(text)
    return out


def roll_up(lines: list[str]) -> list[str]:
    """Rolling captions repeat and grow: a line that extends the last replaces it, an overlap is said once."""
    out: list[str] = []
    last = ""  # as it was shown, with what it had in common with the one before
    for line in lines:
        if last and (line == last or last.startswith(line)):
            continue
        if last and line.startswith(last):
            out[-1] += line[len(last) :]
            last = line
            continue
        words, before = line.split(), last.split()
        n = next((k for k in range(min(len(words), len(before)), 0, -1) if before[-k:] == words[:k]), 0)
        if rest := words[n:]:
            out.append(" ".join(rest))
            last = line
    return out


def extract_captions(files: DataFrame, key: str, vtt: str) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "body": ["\n".join(roll_up(caption_lines(x or ""))) for x in pdf[vtt]]})

    return files.select(key, vtt).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, body string")


def graph_nodes(text: str | None) -> list[tuple[str, str]]:
    """(class, widget values as JSON) of the nodes of a graph, in either of its two forms; links are left out."""
    try:
        graph = json.loads(text or "")
    except ValueError:
        return []
    if isinstance(graph, dict) and isinstance(graph.get("nodes"), list):
        return [(n["type"], json.dumps(n.get("widgets_values") or [])) for n in graph["nodes"] if isinstance(n, dict) and isinstance(n.get("type"), str)]
    if not isinstance(graph, dict):
        return []
    nodes = [n for n in graph.values() if isinstance(n, dict) and isinstance(n.get("class_type"), str)]
    return [(n["class_type"], json.dumps([v for v in (n.get("inputs") or {}).values() if not isinstance(v, list)])) for n in nodes]


def extract_nodes(graphs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per node."""

    def run(frames):
        for pdf in frames:
            rows = [(k, i, *n) for k, t in zip(pdf[key], pdf[text]) for i, n in enumerate(graph_nodes(t))]
            yield pd.DataFrame(rows, columns=[key, "node", "class_type", "widgets"])

    return graphs.select(key, text).mapInPandas(run, f"{key} {graphs.schema[key].dataType.simpleString()}, node int, class_type string, widgets string")


def node_counts(nodes: DataFrame, key: str) -> DataFrame:
    """How often each class stands in a graph, as a map."""
    n = nodes.groupBy(key, "class_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_type", "n")))).alias("counts"))


def models(nodes: DataFrame, key: str) -> DataFrame:
    """File names of models among the widget values."""
    found = F.regexp_extract_all("widgets", F.lit(r'"([^"]+\.(?:safetensors|ckpt|gguf|pth?|bin))"'), F.lit(1))
    return nodes.select(key, F.explode(found).alias("model")).distinct()


def leaves(text: str | None) -> list[str]:
    """Scalar leaves of a JSON text, in order."""
    out: list[str] = []

    def walk(x):
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            walk(y)
        if isinstance(x, str | int | float) and not isinstance(x, bool) and str(x).strip():
            out.append(str(x).strip())

    try:
        walk(json.loads(text or "null"))
    except (ValueError, RecursionError):
        return []
    return out


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "leaves": [leaves(x) for x in pdf[text]]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, leaves array<string>")
