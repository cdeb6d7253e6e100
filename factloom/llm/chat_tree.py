"""Chat formatting as prefix trees: turns that conversations share from their start on are written once.

A turn is written as <|im_start|>role, a line end, the text, <|im_end|>, a line
end. The two marks are ids of their own behind the vocabulary. So that no text can
pass for a mark, each "<" followed by backslashes and "|" gets one more backslash;
taking one away gives the text back. In roles, backslashes are doubled and line
ends written as \\n before that.

Conversations are rows (id, turns). They are dealt and sorted by the hashes of their
turns, so that those with a common start stand together, and a task reads them as
one stream: it keeps the turns of the conversation before, finds how many of them
the next one shares, by their texts, and adds the rest to the tree. The order in
which turns are added is the tree's depth-first order. A block ends after about
BLOCK characters of new turns or LEAVES conversations; the next one starts with
the whole path again, so a start shared by any number of conversations is written
once a block and no task holds more than a block. A block is a row:

  input_ids, loss_mask   tokens, each shared one once; the mask covers the texts of assistants
  position_ids           place of the token in its own conversation
  nodes                  one for each turn: parent, begin and end of its tokens, and
                         attends, the intervals of its ancestors; its token t may attend to these and to [begin, t]
  leaves                 conversations and the node that each ends in

Defined cases: a null text or role is empty; turns with equal numbers are ordered by
role and text, a null number comes first; rows with a null id are one conversation;
repeated conversations are leaves of one node; no rows give no blocks; other columns
are not read. One conversation, like one text, has to fit into a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.bpe import vocabulary, vocabulary_file
from factloom.llm.pretokens import Encoder
from factloom.llm.shared import arrow_batches, read, stored
from factloom.llm.textnp import column

START, END, LINE, SPEAKER = "<|im_start|>", "<|im_end|>", "\n", "assistant"
#: Characters of new turns and conversations in one block.
BLOCK, LEAVES = 1 << 18, 2000
#: Blocks that a reader of the stored table holds at once.
HELD = 8

_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_INTERVAL = "array<struct<begin:int,end:int>>"
_NODES = f"array<struct<parent:int,begin:int,end:int,attends:{_INTERVAL}>>"


def escaped(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def written_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def read_role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(written))


class Tree:
    """The turns of one block in depth-first order."""

    def __init__(self):
        self.turns: list[tuple[str, str]] = []
        self.parents: list[int] = []
        self.leaves: list[tuple] = []
        self.path: list[int] = []  # nodes of the conversation added last
        self.size = 0

    def add(self, key, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.turns[self.path[shared]] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            self.parents.append(self.path[-1] if self.path else -1)
            self.path.append(len(self.turns))
            self.turns.append(turn)
            self.size += len(turn[0]) + len(turn[1])
        self.leaves.append((key, self.path[-1]))

    def row(self, encoder: Encoder, marks: tuple[int, int], line: list[int]) -> tuple[list[np.ndarray], list[dict], list[dict]]:
        """input_ids, loss_mask and position_ids; nodes; leaves."""
        parts = [x for role, text in self.turns for x in (written_role(role) + LINE, escaped(text))]
        coded: list[np.ndarray] = []
        for a, b, tokens, rows in encoder(pa.array(parts, pa.string())):
            coded += [tokens[rows[k] : rows[k + 1]] for k in range(b - a)]
        ids, mask, places, nodes, depth = [], [], [], [], []
        end = 0
        for k, (parent, (role, _)) in enumerate(zip(self.parents, self.turns, strict=True)):
            head, text = coded[2 * k], coded[2 * k + 1]
            token = np.concatenate([[marks[0]], head, text, [marks[1]], line])
            loss = np.zeros(len(token), bool)
            if role == SPEAKER:
                loss[1 + len(head) : 1 + len(head) + len(text)] = True
            begin, end = end, end + len(token)
            seen, at = [], 0
            if parent >= 0:
                above = nodes[parent]
                seen, at = [*above["attends"], {"begin": above["begin"], "end": above["end"]}], depth[parent]
                if len(seen) > 1 and seen[-2]["end"] == seen[-1]["begin"]:
                    seen[-2:] = [{"begin": seen[-2]["begin"], "end": seen[-1]["end"]}]
            ids.append(token)
            mask.append(loss)
            places.append(at + np.arange(len(token)))
            depth.append(at + len(token))
            nodes.append({"parent": parent, "begin": begin, "end": end, "attends": seen})
        return [np.concatenate(x) for x in (ids, mask, places)], nodes, [{"id": key, "node": node} for key, node in self.leaves]


def _packing(file, schema: pa.Schema, block: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file.value)
        encoder = Encoder(v.encode_pieces, v.added)
        marks, line = (len(v.tokens), len(v.tokens) + 1), v.encode_piece(LINE)
        tree = Tree()

        def ready() -> pa.RecordBatch:
            tokens, nodes, leaves = tree.row(encoder, marks, line)
            flat = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(f.type.value_type)) for x, f in zip(tokens, schema, strict=False)]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*flat, pa.array([nodes], schema.field("nodes").type), pa.array([leaves], schema.field("leaves").type)], schema, strict=True)], schema=schema)

        for batch in batches:
            for key, turns in zip(column(batch, "id").to_pylist(), column(batch, "turns").to_pylist(), strict=True):
                tree.add(key, [(t["role"], t["text"]) for t in turns])
                if tree.size >= block or len(tree.leaves) >= most:
                    yield ready()
                    tree = Tree()
        if tree.leaves:
            yield ready()

    return run


def packed(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None, block: int = BLOCK, leaves: int = LEAVES) -> DataFrame:
    """The blocks of all conversations: input_ids, loss_mask, position_ids, nodes, leaves."""
    spark = rows.sparkSession
    arrow_batches(spark)
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), some(role_col).alias("role"), some(text_col).alias("text")).alias("t"))
    talks = turns.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    talks = talks.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    keyed = talks.withColumn("start", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    dealt = keyed.repartitionByRange("start", "id").sortWithinPartitions("start", "id").select("id", "turns")
    kind = talks.schema["id"].dataType
    interval = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    node = pa.struct([("parent", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("attends", interval)])
    leaf = pa.struct([("id", to_arrow_type(kind)), ("node", pa.int32())])
    schema = pa.schema([("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("position_ids", pa.list_(pa.int32())), ("nodes", pa.list_(node)), ("leaves", pa.list_(leaf))])
    made = f"input_ids array<int>, loss_mask array<boolean>, position_ids array<int>, nodes {_NODES}, leaves array<struct<id:{kind.simpleString()},node:int>>"
    return dealt.mapInArrow(_packing(vocabulary_file(spark, path), schema, block, leaves), made)


def _unpacking(file, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [*vocabulary(file.value).tokens, START.encode(), END.encode()]
        told = lambda ids: b"".join(map(tokens.__getitem__, ids.tolist())).decode(errors="replace")
        for batch in batches:
            for k in range(batch.num_rows):
                ids, mask = (column(batch, c)[k].values.to_numpy(zero_copy_only=False) for c in ("input_ids", "loss_mask"))
                nodes, out, size = column(batch, "nodes")[k].as_py(), [], 0
                for leaf in column(batch, "leaves")[k].as_py():
                    node = nodes[leaf["node"]]
                    at = np.concatenate([np.arange(s["begin"], s["end"]) for s in (*node["attends"], node)])
                    formatted, learned = told(ids[at]), mask[at]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], learned, [False]]).astype(np.int8)))
                    loss = [unescaped(told(ids[at[a:b]])) for a, b in edges.reshape(-1, 2).tolist()]
                    turns = [{"role": read_role(m[1]), "text": unescaped(m[2])} for m in _TURN.finditer(formatted)]
                    out.append({"id": leaf["id"], "turns": turns, "loss": loss, "formatted": formatted})
                    size += len(formatted)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def unpacked(blocks: DataFrame, *, id_col: str = "conv_id", path: str | None = None) -> DataFrame:
    """Every conversation from the tokens that its last turn attends to: id, turns, loss (the texts under the mask), formatted."""
    spark = blocks.sparkSession
    arrow_batches(spark)
    kind = blocks.schema["leaves"].dataType.elementType["id"].dataType
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("id", to_arrow_type(kind)), ("turns", pa.list_(turn)), ("loss", pa.list_(pa.string())), ("formatted", pa.string())])
    run = _unpacking(vocabulary_file(spark, path), schema)
    rows = blocks.select("input_ids", "loss_mask", "nodes", "leaves")
    return rows.mapInArrow(run, f"id {kind.simpleString()}, turns array<struct<role:string,text:string>>, loss array<string>, formatted string").withColumnRenamed("id", id_col)


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold the marks themselves."""
    text = f"{END}{START}{SPEAKER} ok"
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, SPEAKER, text)], "conv_id long, turn long, role string, text string")
    back = unpacked(stored(packed(rows.unionByName(more)), "chat", HELD))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
