"""Chat formatting by event-sourced reconstruction.

A log holds one event a row: conv_id, seq (order in the conversation), message (which message it is about), kind, role
and text. Logs are dealt by conversation, sorted by sequence and folded:

  message      a whole message (role, text)
  delta        text streamed to the end of the message, which it opens if need be
  edit         the message's text is now this
  regenerate   the message's text is dropped and streams anew; what came after it in the conversation goes
  delete       the message goes

Final messages, in the order in which they first appeared, are then rendered, one piece a turn:
  <|im_start|>ROLE newline TEXT<|im_end|> newline
In role and text a backslash is doubled and a control string gets a backslash behind its first character, so no text
can forge a turn and every text can be read back; a newline in a role is a backslash and an n. The loss mask of a piece is the span of an assistant's text.

Nulls and the rest: null text and role are empty, null seq comes first, null conv_id is a conversation of its own; equal
seq are ordered by message, kind, role and text. Repeated rows are repeated events. Other columns are ignored. A
conversation is folded in one task as a stream of its events, with only its own messages in memory. An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import arrow_rows, lean

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat tokenizers take for control tokens.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate", "delete")
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
PIECES = "conv_id long, turn long, piece string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(escaped: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], escaped)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn and its loss span (empty unless the role is assistant)."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    start = len(head)
    return f"{head}{body}{END}\n", start, start + len(body) if role == "assistant" else start


def parse(piece: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    out, at = [], 0
    while at < len(piece):
        m = _TURN.match(piece, at)
        if not m:
            raise ValueError("not a formatted text")
        out.append((_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Fold:
    """The state of one conversation."""

    def __init__(self):
        self.messages: dict = {}

    def apply(self, message, kind: str, role: str, text: str) -> None:
        if kind == "message":
            self.messages[(message, len(self.messages)) if message in self.messages else message] = [role, [text]]
        elif kind == "delta":
            held = self.messages.setdefault(message, [role, []])
            held[0] = role or held[0]
            held[1].append(text)
        elif kind == "edit":
            held = self.messages.setdefault(message, [role, []])
            held[1] = [text]
        elif kind == "regenerate":
            if message in self.messages:
                keys = list(self.messages)
                for k in keys[keys.index(message) + 1 :]:
                    del self.messages[k]
                self.messages[message][1] = [text] if text else []
        elif kind == "delete":
            self.messages.pop(message, None)
        else:
            raise ValueError(f"unknown event {kind!r}")

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def format_chat(events: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, piece (formatted text), loss_start and loss_end (code points in the piece).

    The rows of a conversation lie together and in order, and joined in order they are its formatted text.
    """
    spark = events.sparkSession
    arrow_rows(spark, 1000)

    def fold(batches):
        conv, state = None, None

        def out():
            rows = [render(role, text) for role, text in state.final()]
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv[0]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["conv_id", "turn", "piece", "loss_start", "loss_end"],
            )

        for b in batches:
            for c, m, k, r, t in zip(*(b.column(i).to_pylist() for i in range(5))):
                if conv != (c,):
                    if state:
                        yield out()
                    conv, state = (c,), Fold()
                state.apply(m, k, r or "", t or "")
        if state:
            yield out()

    rows = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text")
    return rows.select("conv_id", "message", "kind", "role", "text").mapInArrow(lean(fold), PIECES)


def read_back(pieces: DataFrame, in_order: bool = False) -> DataFrame:
    """A row per conversation, read from its pieces: turns and loss text as digests, and lengths in code points.

    in_order: the rows of a conversation lie together and in order, as format_chat gives them; else they are dealt anew.
    """
    arrow_rows(pieces.sparkSession, 1000)
    if not in_order:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def read(batches):
        conv, n, turns, loss, loss_n, total = None, 0, None, None, 0, 0

        def row():
            return (conv[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), total)

        for b in batches:
            rows = []
            for c, piece, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                if conv != (c,):
                    if conv:
                        rows.append(row())
                    conv, n, turns, loss, loss_n, total = (c,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text in parse(piece):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                masked = unescape(piece[start:end])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                loss_n += len(masked)
                total += len(piece)
            if rows:
                yield batch(rows)
        if conv:
            yield batch([row()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(lean(read), schema)


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of whole messages."""
    # Rows that share a turn are messages of their own, told apart in the fold.
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit("message").alias("kind"), "role", "text")
