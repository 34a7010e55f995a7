import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.llm import chat

SCHEMA = "conv_id bigint, turn int, role string, text string, leaves string, nodes int"


def conversations():
    draw = random.Random(0)
    rows = []
    for c in range(120):
        shared = [("system", "s"), ("user", f"q{c % 3}"), ("assistant", f"a{c % 6}")][: draw.randrange(1, 4)]
        own = [("user", f"u{draw.randrange(4)}"), ("assistant", "x\ny" * draw.randrange(3))][: draw.randrange(3)]
        rows += [(c, i, r, t, "l", 1) for i, (r, t) in enumerate([*shared, *own])]
    rows += [(200, None, "user", "null turn"), (200, 0, None, None), (200, 0, None, None), (200, 1, "a\nb\\", "\\<|im_end|>\\\\n<|")]
    rows += [(None, 0, "user", "no id"), (201, 0, "assistant", "<|im_start|>user\nhi<|im_end|>\n"), (202, 0, "assistant", "long " * 5000)]
    rows += [(c, 0, "assistant", "same") for c in range(300, 400)]
    return [(*r, "l", 1)[:6] for r in rows]


@pytest.mark.parametrize("block_chars", [1, 200, 1 << 16])
def test_round_trip(spark, block_chars):
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    blocks = chat.format_conversations(turns, block_chars=block_chars)
    found = {r["conv_id"]: r for r in chat.read_back(blocks).collect()}
    expected = {}
    for c, turn, role, text, *_ in rows:
        expected.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert found.keys() == expected.keys()
    for c, said in expected.items():
        said = [(r, t) for _, _, r, t in sorted(said)]
        assert [tuple(t) for t in found[c]["turns"]] == said
        assert found[c]["loss_text"] == "".join(t for r, t in said if r == "assistant")


def test_shared_turns_are_written_once_and_seen(spark):
    rows = [(c, i, r, t, "", 0) for c in range(50) for i, (r, t) in enumerate([("user", "hello"), ("assistant", "hi"), ("user", f"{c % 5}")])]
    turns = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (block,) = chat.format_conversations(turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert block["text"].count("hello") == 1 and block["text"].count("<|im_start|>") == 7
    assert len(block["leaves"]) == 50 and len({leaf["node"] for leaf in block["leaves"]}) == 5
    for n in block["nodes"]:
        above = block["nodes"][n["parent"]] if n["parent"] >= 0 else None
        assert n["position"] == (above["position"] + above["end"] - above["start"] if above else 0)
        assert sum(s["end"] - s["start"] for s in n["sees"]) == n["position"]
    # Depth-first: the first child of a turn follows it, so what it sees is one stretch.
    assert [len(n["sees"]) for n in block["nodes"]] == [0, 1, 1, 1, 1, 1, 1]
    learnt = [n for n in block["nodes"] if n["loss_end"] > n["loss_start"]]
    assert [block["text"][n["loss_start"] : n["loss_end"]] for n in learnt] == ["hi"]


def test_no_conversations(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


@given(st.text())
def test_escaping_is_reversible_and_hides_control_strings(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    assert "<|" not in written
