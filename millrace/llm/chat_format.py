"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by turn and sequence. One pass folds streamed deltas, edits and
regenerations into final messages and renders each as a piece of the formatted conversation; only the message being built
is held, so a conversation of any length streams through its task.

Events have ``conv_id``, ``turn`` (the message they concern), ``seq`` (order in the log), ``kind``, ``role``, ``text``:

- ``message`` starts a message with the text; ``delta`` appends to the turn's message (and starts one if there is none);
- ``edit`` replaces the turn's text; ``regenerate`` does so too, deltas then follow. Both void whatever later turns held
  up to that sequence number.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every ``<``, backslashes, ``|`` gets one backslash
more, so no control string can arise and unescaping is exact; roles also escape backslash and newline.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers

START, END = "<|im_start|>", "<|im_end|>\n"
EVENTS = ["conv_id", "turn", "seq", "kind", "role", "text"]
PIECES = "conv_id long, piece string, loss_start long, loss_end long"
#: Pieces that are sent on together.
_ROWS, _CHARS = 5000, 8 << 20


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one message, and where its loss mask begins and ends, in code points (0, 0: none)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return head + body + END, *((len(head), len(head) + len(body)) if role == "assistant" else (0, 0))


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a piece."""
    if not (piece.startswith(START) and piece.endswith(END)):
        raise ValueError("not a rendered message")
    role, _, body = piece[len(START) : -len(END)].partition("\n")
    return unescape_role(role), unescape(body)


def fold(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """Final messages (conversation, role, text) of events sorted by conversation, turn and sequence."""
    conv: object = rows  # no conversation equals it
    turn = role = None
    text: list[str] | None = None
    void = here = None  # sequence up to which later turns are void, and the same with this turn's events
    for c, t, seq, kind, r, x in rows:
        if c != conv or t != turn:
            if text is not None:
                yield conv, role, "".join(text)
            text, turn = None, t
            void = None if c != conv else here
            here, conv = void, c
        if void is not None and seq is not None and seq <= void:
            continue
        if kind == "message":
            if text is not None:
                yield conv, role, "".join(text)
            role, text = r or "", [x or ""]
        elif kind == "delta":
            role, text = (role, text) if text is not None else (r or "", [])
            text.append(x or "")
        elif kind in ("edit", "regenerate"):
            role, text = (role if text is not None and r is None else r or ""), [x or ""]
            if seq is not None:
                here = seq if here is None else max(here, seq)
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if text is not None:
        yield conv, role, "".join(text)


def format_conversations(events: DataFrame) -> DataFrame:
    """Rows (conv_id, piece, loss_start, loss_end): a conversation's pieces in order, all in one partition.

    Joined, the pieces are the formatted conversation; the loss mask of a piece is a span of code points. Null texts and
    roles are empty; null conversations form one; null turns and sequence numbers come first and are never void; events
    that are equal in turn and sequence are taken by role, then text, and repeated message events repeat the message. An empty
    log gives no rows; further columns are ignored.
    """
    python_workers(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for conv, role, text in fold(rows):
            out.append((conv, *render(role, text)))
            held += len(out[-1][1])
            if len(out) >= _ROWS or held >= _CHARS:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return events.select(*EVENTS).repartition("conv_id").sortWithinPartitions(*EVENTS[:3], "role", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "piece", "loss_start", "loss_end"])


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation what its pieces say when read back: turns and the text under the loss mask, with digests.

    ``pieces`` comes straight from ``format_conversations``: it streams on in the same tasks, without a shuffle.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = batches
        state: list = []
        out: list[list] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done() -> None:
            if state:
                out.append([conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]])

        for batch in batches:
            for c, piece, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    done()
                    conv, state = c, [0, sha256(), 0, sha256(), 0]
                role, text = parse(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(piece[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(piece)
            if len(out) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return pieces.mapInArrow(run, schema)


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log with one message event a row."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("role").cast("string"), F.col("text").cast("string")
    )


def as_edited_events(conversations: DataFrame) -> DataFrame:
    """Conversations as the log of a chat in which answers stream and things are changed.

    A user's message comes whole, and is edited at once where conv_id is divisible by 5. An assistant's begins as a draft of
    one delta, is regenerated, and streams in two deltas. Where conv_id is divisible by 7, the first message is edited after all
    others, which voids them.
    """
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = "cast(length(text) div 2 as int)"

    def event(at: int, kind: str, text: str, when: str = "true") -> str:
        return f"if({when}, struct(turn * 10 + {at} as seq, '{kind}' as kind, {text} as text), null)"

    assistant = [event(0, "delta", "'A draft'"), event(1, "regenerate", "''"), event(2, "delta", f"left(text, {half})"), event(3, "delta", f"substring(text, {half} + 1)")]
    other = [event(0, "message", "text"), event(1, "edit", "concat(text, ' (edited)')", "conv_id % 5 = 0")]
    events = c.select("conv_id", "turn", "role", F.explode(F.expr(f"filter(if(role = 'assistant', array({', '.join(assistant)}), array({', '.join(other)})), e -> e is not null)")).alias("e"))
    events = events.select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")
    ends = c.where("conv_id % 7 = 0").groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("f"), F.max("turn").alias("last"))
    late = ends.select("conv_id", "f.turn", (F.col("last") * 10 + 9).alias("seq"), F.lit("edit").alias("kind"), "f.role", F.concat(F.lit("Again: "), "f.text").alias("text"))
    return events.unionByName(late)


def edited_sql() -> str:
    """The digests of ``as_edited_events``, folded."""
    final = """with d as (select conv_id, turn, role, coalesce(text, '') as text, min(turn) over (partition by conv_id) as first from conversations),
e as (select conv_id, turn, coalesce(role, '') as role, case when conv_id % 7 = 0 then 'Again: ' || text when conv_id % 5 = 0 and role is distinct from 'assistant' then text || ' (edited)' else text end as text from d where conv_id % 7 <> 0 or turn = first)"""
    plain = sql("")
    return final + ", c as (select conv_id, turn, role, text from e)" + plain[plain.index("\nselect conv_id, count(*)"):]


def sql(probe: str) -> str:
    """The digests of the query: all conversations and a further one, -1, of a user and an assistant who both say ``probe``."""
    escaped = "regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    role = escaped.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '{probe}' union all select -1, 1, 'assistant', '{probe}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum({len(START) + len(END) + 1} + length({role}) + length({escaped.format("text")}))::bigint as formatted_chars from c group by conv_id"""
