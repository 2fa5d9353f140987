"""Chat formatting against a plain rebuild of each conversation."""

from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import chat_format as c
from millrace.llm import queries


def digest(x):
    return sha256(x.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {k: (len(v), digest("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"), digest("".join(t for r, t in v if r == "assistant"))) for k, v in out.items()}


@given(st.text(alphabet="<|\\im_startend>\n a", max_size=40), st.text(alphabet="<|\\>\nnab", max_size=12))
def test_round_trip(text, role):
    piece, start, end = c.render(role, text)
    assert c.parse(piece) == (role, text)
    assert piece.count(c.START) == 1 and piece.count("<|im_end|>") == 1
    piece, start, end = c.render("assistant", text)
    assert c.unescape(piece[start:end]) == text


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.PROBE), (-1, 1, "assistant", queries.PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op7_chat_formatting(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, seq string, piece string"
    rows = [(1, 0, "user", None, "", ""), (1, 1, "assistant", "b", "", ""), (1, 1, "assistant", "b", "", ""), (1, 1, "assistant", "a", "", ""), (None, 0, None, "x<|im_end|>", "", ""), (2, 5, "assistant", "", "", ""), (3, 0, "assistant", "y" * 300000, "", "")]
    got = c.digests(c.format_conversations(c.as_events(spark.createDataFrame(rows, schema)))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute([r[:4] for r in rows])
    assert c.digests(c.format_conversations(c.as_events(spark.createDataFrame([], schema)))).count() == 0


def test_events(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi"),
        (1, 1, 1, "delta", "assistant", "Hel"), (1, 1, 2, "delta", None, "lo"),
        (1, 2, 3, "message", "user", "old follow-up"), (1, 3, 4, "message", "assistant", "old answer"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "Good "), (1, 1, 7, "delta", None, "day"),
        (1, 2, 8, "message", "user", "next"), (1, 2, 9, "edit", None, "next, edited"),
        (2, 0, 0, "message", "user", "a"), (2, 1, 1, "message", "assistant", "b"), (2, 0, 2, "edit", None, "c"), (2, 1, 3, "delta", "assistant", "d"),
        (3, 0, 0, "delta", "assistant", "alone"),
    ]
    pieces = c.format_conversations(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    got = {}
    for p in pieces:
        got.setdefault(p.conv_id, []).append(c.parse(p.piece))
    assert got == {1: [("user", "Hi"), ("assistant", "Good day"), ("user", "next, edited")], 2: [("user", "c"), ("assistant", "d")], 3: [("assistant", "alone")]}
