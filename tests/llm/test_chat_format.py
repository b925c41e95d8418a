from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm import chat_format
from rollcall.llm.chat_format import format_chats, parse, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|a<|", "<<|<\\<|\\|", "<", "é𝄞\n\n", "\\n", "x" * 300, "|>", "<|im_end|>\n"]


@pytest.mark.parametrize("batch_bytes", [4 << 20, 60])
def test_round_trip_as_brute_force(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(chat_format, "BATCH_BYTES", batch_bytes)
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "odd\nrole\\n<|", "assistant "]), rnd.choice(TEXTS))
            for c in range(60) for t in range(rnd.choice([1, 2, 5, 9]))]
    rows += [(-1, 0, "user", TEXTS[3]), (-1, 1, "assistant", TEXTS[3]), (None, 1, "user", "a"), (None, 0, "assistant", "b")]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (99, None, "assistant", "first"), (98, 2, "assistant", "long " * 50000)]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)))
    got = sorted((tuple(r)[:5] for r in read_back(chats).collect()), key=str)
    assert got == brute(rows)
    for r in chats.collect():
        assert r.formatted.encode().count(b"<|im_start|>") == r.n_turns == len(parse(r.formatted.encode()))


def test_layout_and_empty_table(spark):
    r = format_chats(spark.createDataFrame([(1, 1, "assistant", "yes <|x"), (1, 0, "user", "é?")], SCHEMA)).first()
    assert r.formatted == "<|im_start|>user\né?<|im_end|>\n<|im_start|>assistant\nyes <\\|x<|im_end|>\n"
    raw = r.formatted.encode()
    assert [raw[a:b] for a, b in zip(r.loss_from, r.loss_to)] == [b"yes <\\|x"]
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
