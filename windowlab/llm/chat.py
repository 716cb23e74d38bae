"""Chat formatting by a grammar that is read back.

A conversation becomes one text of turns; control strings mark where a turn begins and ends:

    <s>[INST role 0] text [/INST]</s>

The text of a turn is first written as it is (level 0).  The rendered conversation is parsed by a deterministic parser;
a turn that does not come back as it was conflicts with the grammar, and is written again with every control character
of its text escaped (level 1), until source and parse are identical.  The level stands in the turn's mark, so reading back
needs nothing else.  Roles other than plain words are always escaped.

Both steps stream: rows of a conversation arrive in order of turn and are never gathered, so a conversation may have any
number of turns.  Results: null text is empty, a null role is the empty role; rows with equal turn come in order of
role and text; repeated rows are repeated turns; rows without a conversation id are one conversation; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windowlab.llm.store import extend, partitions

OPEN, SHUT = re.compile(r"<s>\[INST ((?:\\.|[^\\\]\[<> ])*) ([01])\] ", re.S), " [/INST]</s>"
CONTROL = re.compile(r"[\\<>\[\]/ ]")
ESCAPED = re.compile(r"\\(.)", re.S)
TRAINED = ("assistant",)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str, level: int) -> str:
    return f"<s>[INST {escape(role)} {level}] {escape(text) if level else text}{SHUT}"


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, begin and end of the text) of a rendered text; None if it is not of the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        m = OPEN.match(rendered, at)
        end = rendered.find(SHUT, m.end()) if m else -1
        if end < 0:
            return None
        body = rendered[m.end() : end]
        turns.append((unescape(m[1]), unescape(body) if m[2] == "1" else body, m.end(), end))
        at = end + len(SHUT)
    return turns


def settle(role: str, text: str) -> str:
    """The lowest level at which the parser gives the turn back.

    Turns are independent: the parser is at the start of its grammar after each, so a turn that comes back alone
    comes back in every conversation.
    """
    for level in (0, 1):
        out = render(role, text, level)
        if (got := parse(out)) and [t[:2] for t in got] == [(role, text)]:
            return out
    raise ValueError("a turn cannot be rendered")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "conv")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, rank, rendered): the piece of every turn; ``rank`` orders the pieces of a conversation."""
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rank = object(), 0
        for batch in batches:
            ranks, out = [], []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                conv, rank = c, rank + 1 if c == conv else 0
                ranks.append(rank)
                out.append(settle(role, text))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), pa.array(ranks, pa.int64()), pa.array(out, pa.string())], ["conv", "turn", "rank", "rendered"])

    return ordered(rows).sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, extend(rows.select("conv", "turn"), "rank bigint, rendered string"))


def read_back(pieces: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv, turns, sha, loss_chars, loss_sha, chars): what parsing the rendered conversations gives.

    ``loss``: texts of the trained roles, as the parser finds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state, done = none, None, []
        for batch in batches:
            for c, rendered in zip(batch.column("conv").to_pylist(), batch.column("rendered").to_pylist()):
                if c != conv:
                    if conv is not none:
                        done.append((conv, *(x.hexdigest() if hasattr(x, "hexdigest") else x for x in state)))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(rendered)
                if turns is None:
                    raise ValueError(f"conversation {c} cannot be read back")
                for role, text, _, _ in turns:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role in trained:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(rendered)
            if len(done) >= 5000:
                yield out(done)
                done = []
        if conv is not none:
            done.append((conv, *(x.hexdigest() if hasattr(x, "hexdigest") else x for x in state)))
        if done:
            yield out(done)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv", "turns", "sha", "loss_chars", "loss_sha", "chars"]
    conv_type = pieces.schema["conv"].dataType.simpleString()
    conv_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[conv_type]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [conv_arrow, *kinds])], names)

    return ordered(pieces).sortWithinPartitions("conv", "rank").select("conv", "rendered").mapInArrow(run, extend(pieces.select("conv"), "turns bigint, sha string, loss_chars bigint, loss_sha string, chars bigint"))
