"""Formatted conversations read back: every digest, conversations across slices and parts."""

import hashlib
import random

import pytest

from driftloom.llm import chat, common


def conversations():
    rng = random.Random(4)
    bits = ["\\", "#", "<", "### Assistant: </turn> ok", "\n", "é", "😀", "word ", "</turn>\n", ""]
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randint(1, 9) if conv != 7 else 300):
            rows.append((conv, turn, rng.choice(["user", "assistant", "tool\n#", None]), None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    return rows


def escaped(text, more=""):
    return "".join("\\" + c if c in "\\#<" + more else c for c in text)


@pytest.mark.parametrize(("slice_bytes", "part_bytes"), [(6 << 20, 64 << 20), (300, 64 << 20), (300, 900), (6 << 20, 900)])
def test_digests(spark, monkeypatch, slice_bytes, part_bytes):
    monkeypatch.setattr(chat, "text_slices", lambda batches, column, limit=slice_bytes: common.text_slices(batches, column, limit))
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_chat(frame, part_bytes=part_bytes).cache()
    if part_bytes > 1 << 20:
        assert parts.count() == 26
    else:
        assert parts.where("conv_id = 7").count() > 5 and all(r.part == 0 or r.formatted for r in parts.collect())
        assert sorted(r.part for r in parts.where("conv_id = 7").collect()) == list(range(parts.where("conv_id = 7").count()))
    got = {r.conv_id: r for r in chat.digests(parts.orderBy("formatted")).collect()}
    assert len(got) == 26
    for conv in got:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        mine = got[conv]
        assert mine.n_turns == len(turns)
        assert mine.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (mine.loss_chars, mine.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = "".join(f"### {escaped(r, chr(10))}\n{escaped(t)}</turn>\n" for r, t in turns)
        assert mine.formatted_chars == len(whole)
        assert "".join(r.formatted for r in sorted((p for p in parts.collect() if p.conv_id == conv), key=lambda r: r.part)) == whole
    parts.unpersist()
