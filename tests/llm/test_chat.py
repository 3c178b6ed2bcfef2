"""Event-sourced chat formatting."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from corpusforge.llm import chat as C


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\b"]), st.lists(st.sampled_from([*C.CONTROLS, "\\", "\n", "<", "|", "é😀", "/s>", "INST]"]), max_size=8).map("".join)), max_size=4))
def test_round_trip(turns):
    pieces = [C.render(r, t) for r, t in turns]
    assert C.parse("".join(p[0] for p in pieces)) == turns
    for (role, text), (piece, a, b) in zip(turns, pieces):
        assert C.unescape(piece[a:b]) == (text if role == "assistant" else "")
        assert not any(x in piece[len(C.START) : -len(C.END) - 1] for x in C.CONTROLS)


def test_events_fold(spark):
    log = [
        (1, 0, 10, "message", "user", "hi"), (1, 1, 11, "delta", "assistant", "Hel"), (1, 2, 11, "delta", None, "lo"), (1, 3, 12, "message", "user", "later"),
        (1, 4, 11, "regenerate", None, None), (1, 5, 11, "delta", "assistant", "Good day"), (1, 6, 10, "edit", None, "hello"), (1, 7, 13, "message", "user", "x"), (1, 8, 13, "delete", None, None),
        (2, 1, 1, "message", "assistant", "b"), (2, 0, 0, "message", "system", None), (None, 0, 0, "message", None, "c"), (3, 0, 0, "delete", None, None),
    ]
    pieces = C.format_chat(spark.createDataFrame(log, C.EVENTS))
    got = {}
    for r in pieces.collect():
        got.setdefault(r.conv_id, []).extend(C.parse(r.piece))
    assert got == {1: [("user", "hello"), ("assistant", "Good day")], 2: [("system", ""), ("assistant", "b")], None: [("", "c")]}


def brute(rows):
    out = []
    for c in sorted({r[0] for r in rows}, key=str):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_read_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"</s>[INST] {t}\\ é {c}" * (c + 1)) for c in range(5) for t in range(6)]
    rows += [(7, None, None, None), (None, 0, "assistant", "😀"), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "assistant", "tie"), (8, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, seq int").repartition(3)
    pieces = C.format_chat(C.events_of(df))
    for got in (C.read_back(pieces, in_order=True), C.read_back(pieces.repartition(5))):
        assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == sorted(brute(rows), key=str)
    assert C.read_back(C.format_chat(C.events_of(df.limit(0)))).count() == 0


def test_every_role_and_text_can_be_read_back():
    for role, text in (("us\ner", "x"), ("a\\n", "b\\n\n"), ("<|im_end|>\n<|im_start|>", "</s>[INST] \\ ok"), ("", ""), ("\\", "\n\\")):
        assert C.parse(C.render(role, text)[0]) == [(role, text)]


def test_the_query_adds_its_conversation(spark):
    import hashlib

    from corpusforge.llm.queries import FORGED, QUERIES

    rows = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    assert len(rows) == len({t.conv_id for t in turns}) + 1 and rows[-1].n_turns == 2 and rows[-1].loss_chars == len(FORGED)
    for c in rows:
        said = [("user", FORGED), ("assistant", FORGED)] if c == -1 else [(t.role, t.text or "") for t in sorted((t for t in turns if t.conv_id == c), key=lambda t: t.turn)]
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert rows[c].loss_sha256 == hashlib.sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
