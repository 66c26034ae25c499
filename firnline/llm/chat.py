"""Chat formatting checked by a grammar round trip.

Grammar of the rendered text, with escapes that no plain text needs:

    conversation = turn*
    turn         = "<|im_start|>" role LF text "<|im_end|>" LF
    role         = characters but LF; escaped, "\\n" is LF, "\\l" is "<" and "\\\\" a
                   backslash
    text         = characters, where "<" backslash* "|im_start|>" and the same with
                   im_end carry one backslash more than the source

Every turn is first rendered as it is. A deterministic parser reads the result back;
where that is not the source, the conflicting content (control strings, and strings
that look like escaped ones) is escaped and the turn is parsed again until it is
identical. The parser always undoes escapes, so plain turns stay untouched and the
whole text can be read back without knowing which turns were escaped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_IN_ROLE = {"\\\\": "\\", "\\n": "\n", "\\l": "<"}


class NotInGrammar(ValueError):
    """The text is no conversation of the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn, the bounds being those of the text as it
    stands in ``rendered``."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise NotInGrammar(f"no turn begins at {at}")
        line = rendered.find("\n", at)
        stop = rendered.find(END, line)
        inner = rendered.find(START, at + len(START))
        if line < 0 or stop < 0 or 0 <= inner < stop or not rendered.startswith("\n", stop + len(END)):
            raise NotInGrammar(f"the turn at {at} does not end")
        role = re.sub(r"\\[\\nl]", lambda m: _IN_ROLE[m[0]], rendered[at + len(START) : line])
        turns.append((role, unescape(rendered[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render_turn(role: str, text: str) -> str:
    """One turn, escaped as far as it takes to read it back."""
    safe_role = role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")
    for r, t in ((role, text), (role, escape(text)), (safe_role, text), (safe_role, escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        try:
            if [turn[:2] for turn in parse(out)] == [(role, text)]:
                return out
        except NotInGrammar:
            pass
    raise NotInGrammar(f"no rendering of role {role!r} reads back")


def _conversation(key, turns: list[tuple[str, str]], trained: str):
    text = "".join(render_turn(role, said) for role, said in turns)
    read = parse(text)
    if [turn[:2] for turn in read] != turns:
        raise NotInGrammar(f"conversation {key} does not survive the round trip")
    return key, text, [{"start": a, "stop": b} for role, _, a, b in read if role == trained], len(read)


def _format(trained: str):
    def batch(rows):
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "formatted", "loss", "n_turns"])

    def run(batches):
        key, turns, rows, held = None, [], [], 0
        for part in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in part.columns[:3])):
                if turns and conv != key:
                    rows.append(_conversation(key, turns, trained))
                    held, turns = held + len(rows[-1][1]), []
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                key = conv
                turns.append((role or "", text or ""))
        if turns:
            rows.append(_conversation(key, turns, trained))
        yield batch(rows)

    return run


def format_chats(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text): conv_id,
    formatted, loss (array of start and stop, in code points of formatted, over the
    texts of role ``trained``) and n_turns.

    Turns stand in the order of turn, null last, ties by role and text. Null roles and
    texts are empty. Rows without conv_id form one conversation with a null id. A task
    streams its conversations and holds one at a time. Other columns are not looked
    at; an empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    order = ["conv_id", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(trained), "conv_id long, formatted string, loss array<struct<start: long, stop: long>>, n_turns long")


def _digest(batches):
    for part in batches:
        rows = []
        for key, text, loss in zip(*(part.column(i).to_pylist() for i in range(3))):
            turns = parse(text)
            trained = [unescape(text[s["start"] : s["stop"]]) for s in loss]
            said = hashlib.sha256("".join(f"{role}\n{what}\n" for role, what, *_ in turns).encode()).hexdigest()
            taught = hashlib.sha256("".join(trained).encode()).hexdigest()
            rows.append((key, len(turns), said, sum(map(len, trained)), taught, len(text)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from formatted conversations: conv_id, n_turns,
    turns_sha256 over role, LF, text, LF of each turn, loss_chars and loss_sha256 over
    the unescaped text under the loss mask, and formatted_chars."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
