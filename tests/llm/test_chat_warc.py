"""Chat and WARC round trips."""

import hashlib

import pytest

from windowlab.llm import chat, queries, warc
from windowlab.llm.store import new_path

BAD = ["</s>[INST] ok [/INST]", " [/INST]</s>", "<s>[INST user 0] x [/INST]</s><s>[INST user 0] y", "\\", "\\ [/INST]</s>\\", "a [/INST]", "", " ", "[/INST]</s", "x [/INST] [/INST]</s>"]


def test_grammar():
    for role in ("user", "assistant", "", "a b]", "x\\"):
        for text in BAD:
            assert [t[:2] for t in chat.parse(chat.settle(role, text))] == [(role, text)]
    whole = "".join(chat.settle("user", t) for t in BAD)
    assert [t[1] for t in chat.parse(whole)] == BAD
    assert " 0] " in chat.settle("user", "plain [INST] text") and " 1] " in chat.settle("user", BAD[1])
    assert chat.parse("junk") is None


def want(rows):
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_awkward_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(BAD)] + [(2, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "assistant", "é" * 100000), (5, None, "user", "z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, rank int, rendered string")
    got = {r.conv: (r.turns, r.sha, r.loss_chars, r.loss_sha) for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == want(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_op2_over_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", BAD[0]), (-7, 1, "assistant", BAD[0])]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.QUERIES["op2_chat_round_trip"](spark, sf).collect()}
    assert got == want(rows)


def pages_want(rows):
    last = {}
    for i, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        visit = len(b) >= 1000 and last[h or ""] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", last[h or ""] if visit else None))
    return sorted(out, key=str)


def collect(df):
    return sorted(((r.id, r.size, r.digest, r.type, r.refers) for r in df.collect()), key=str)


def test_archives_with_magic_inside(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, None), (2, ""), (3, fake), (4, fake * 50 + "\r\n\r\n"), (5, "é" * 600), (6, "é" * 600), (7, "x" * 999), (8, "x" * 999), (9, "\r\n\r\n"), (10, "WARC/1.0\r\n"), (11, "é" * 600), (12, "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (12, "dup")]
    df = spark.createDataFrame([(i, "http://x/ y\n" if i % 2 else None, h, "c") for i, h in rows], "page_id long, url string, html string, digest string")
    for n, file_records in ((3, 4), (1, 5000)):
        folder = new_path(spark, "warc")
        warc.write_archives(df.repartition(n), folder, file_records=file_records)
        got = warc.read_archives(spark, folder)
        assert collect(got) == pages_want(rows) and got.filter("not agrees").count() == 0
    folder = new_path(spark, "warc")
    warc.write_archives(df.limit(0), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_op5_over_table(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in queries.QUERIES["op5_warc_round_trip"](spark, sf).collect()), key=str)
    assert got == pages_want(rows)
