"""Chat formatting over a prefix tree (operator 2).

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``, and a line end in a role gets a ``\\`` too, so no control
string can arise there and all of it can be undone.

Conversations that share initial turns share the nodes of a tree. They are dealt out and
sorted by their path, the hashes of their turns in order, which puts a tree's leaves in
depth-first order over the whole table; conversations of one tree, or many copies of one
conversation, may lie in any number of tasks. Each task writes blocks of about ``block_chars``
characters, or ``BLOCK_LEAVES`` conversations if they are alike: a turn that the conversation before it in the block has too is not written again.
A block stands by itself:

* ``text``: its turns once each, depth-first
* ``nodes``: parent (-1: none), start and end in ``text``, position of its first character in
  its conversation, whether it is learnt from (loss_start, loss_end; equal if not), and
  ``sees``: the stretches of its ancestors, adjoining ones joined, which it may attend to
* ``leaves``: each conversation's id and last node

Units are the characters of ``text`` (Python's and Spark's code points). Position ids follow from
``position``: start + k has position + k.

Defined cases: turns are ordered by turn, then role and text, nulls first, and rows that
repeat a turn are turns of their own; a null role or text is empty; a null conv_id is one
conversation; a conversation is never split, so a longer one is a block by itself; an empty
table gives no block. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
BLOCK_CHARS = 1 << 16
BLOCK_LEAVES = 1024
NODE = (
    "parent int, start int, end int, position int, loss_start int, loss_end int, "
    "sees array<struct<start int, end int>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _conversations(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns, path): a conversation per row, its turns in order and their hashes as sort key."""
    rows = turns.select(
        named(conv_id).alias("conv_id"),
        F.struct(
            named(turn).alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"), F.coalesce(named(text), F.lit("")).alias("text")
        ).alias("row"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def key(row: Column) -> Column:
        return F.substring(F.md5(F.to_json(F.struct(row["role"].alias("r"), row["text"].alias("t")))), 1, 16)

    return gathered.withColumn("path", F.array_join(F.transform("turns", key), ""))


class _Block:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[tuple] = []
        self.leaves: list[tuple] = []
        self.last: list[tuple[str, str, int]] = []

    def add(self, conv_id, turns: list) -> None:
        """Write what the last conversation does not share with this one."""
        said = [(t["role"], t["text"]) for t in turns]
        shared = 0
        while shared < min(len(said), len(self.last)) and said[shared] == self.last[shared][:2]:
            shared += 1
        path = self.last[:shared]
        for role, text in said[shared:]:
            parent = path[-1][2] if path else -1
            before = self.nodes[parent] if path else None
            head, body = START + escape(role).replace("\n", "\\\n") + "\n", escape(text)
            start, loss = self.size, self.size + len(head)
            end = loss + len(body) + len(END) + 1
            self.parts.append(f"{head}{body}{END}\n")
            self.size = end
            sees: list[tuple[int, int]] = []
            if before:
                sees = list(before[6])
                if sees and sees[-1][1] == before[1]:
                    sees[-1] = (sees[-1][0], before[2])
                else:
                    sees.append((before[1], before[2]))
            position = before[3] + before[2] - before[1] if before else 0
            self.nodes.append(
                (parent, start, end, position, loss, loss + len(body) if role == LEARNT_ROLE else loss, sees)
            )
            path.append((role, text, len(self.nodes) - 1))
        self.last = path
        self.leaves.append((conv_id, path[-1][2]))

    def row(self) -> tuple:
        return "".join(self.parts), self.nodes, self.leaves


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Blocks (text, nodes, leaves) of all conversations."""
    id_type = turns.schema[conv_id].dataType.simpleString()
    schema = f"text string, nodes array<struct<{NODE}>>, leaves array<struct<conv_id {id_type}, node int>>"
    number = pa.int32()
    node = pa.struct(
        [*[(n, number) for n in ("parent", "start", "end", "position", "loss_start", "loss_end")],
         ("sees", pa.list_(pa.struct([("start", number), ("end", number)])))]
    )

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaf = _Block(), None

        def written() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in zip(block.row(), (pa.string(), pa.list_(node), pa.list_(leaf)))]
            return pa.RecordBatch.from_arrays(columns, ["text", "nodes", "leaves"])

        for batch in batches:
            leaf = pa.struct([("conv_id", batch.schema.field(0).type), ("node", number)])
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(conv, said.as_py())
                if block.size >= block_chars or len(block.leaves) >= BLOCK_LEAVES:
                    yield written()
                    block = _Block()
        if block.leaves:
            yield written()

    ordered = _conversations(turns, conv_id, turn, role, text).repartitionByRange("path", "conv_id")
    return ordered.sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(blocks, schema)


def read_back(blocks: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) of every conversation, from blocks alone.

    ``turns`` holds (role, text) unescaped, ``loss_text`` all text under the loss mask.
    """
    id_type = blocks.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, turns array<struct<role string, text string>>, loss_text string, formatted_chars bigint"
    turn = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + "\n", re.S)
    said_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def conversation(text: str, nodes: list[dict], leaf: int) -> tuple[list[dict], str, int]:
        own, path, at = nodes[leaf], [], leaf
        while at >= 0:
            path.append(nodes[at])
            at = nodes[at]["parent"]
        path.reverse()
        said = "".join(text[s["start"] : s["end"]] for s in [*own["sees"], own])
        turns, place = [], 0
        for node in path:
            if node["position"] != place:
                raise ValueError("positions of a conversation do not follow each other")
            written = said[place : place + node["end"] - node["start"]]
            turns.append(dict(zip(("role", "text"), map(unescape, turn.fullmatch(written).groups()))))
            place += len(written)
        if place != len(said):
            raise ValueError("a conversation sees more or less than its turns")
        return turns, "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in path), place

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.schema.field("leaves").type.value_type.field("conv_id").type
            for row in range(batch.num_rows):
                text, nodes, leaves = (batch.column(n)[row].as_py() for n in ("text", "nodes", "leaves"))
                for first in range(0, len(leaves), 64):
                    part = leaves[first : first + 64]
                    said, loss, chars = zip(*(conversation(text, nodes, leaf["node"]) for leaf in part))
                    columns = [
                        pa.array([leaf["conv_id"] for leaf in part], id_kind), pa.array(said, said_type),
                        pa.array(loss, pa.string()), pa.array(chars, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turns", "loss_text", "formatted_chars"])

    return blocks.mapInArrow(read, schema)
