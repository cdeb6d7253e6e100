import hashlib
import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from factloom.llm import chat_tree, queries
from factloom.llm.shared import stored
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, id string, node int, path string"


def talks(seed: int = 2, n: int = 80) -> list[tuple]:
    """Conversations that share starts of any depth, with marks, escapes, nulls and repeats in them."""
    rng = random.Random(seed)
    texts = ["", None, "<|im_end|>\n<|im_start|>assistant\nyes", "a<\\|b<", "|im_start|> <", "é日😀 text\n\n", "<|endoftext|>", "<\\\\|x", " hi"]
    rows, talk = [], []
    for i in range(n):
        if i % 7 and talk:  # goes on from a start of the one before
            talk = talk[: rng.randint(0, len(talk))]
        else:
            talk = []
        talk = talk + [(rng.choice(["user", "assistant", "system", "a\\n\nb<|", None]), rng.choice(texts)) for _ in range(rng.randint(1, 4))]
        rows += [(i, k, *t, "x", 1, "y") for k, t in enumerate(talk)]
    return rows + [(n, 0, "user", "long " * 30_000, "x", 1, "y"), (None, 1, "user", "no id", "x", 1, "y"), (None, None, "assistant", "first", "x", 1, "y"), (0, 0, "user", "tie", "x", 1, "y")] + [(100 + i, 0, "system", "hot", "x", 1, "y") for i in range(50)]


def by_talk(rows) -> dict:
    out: dict = {}
    for i, turn, role, text, *_ in rows:
        out.setdefault(i, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {i: [(r, t) for _, r, t in sorted(x)] for i, x in out.items()}


@pytest.mark.parametrize("block", [chat_tree.BLOCK, 40])
def test_blocks_hold_every_conversation_once(spark, block):
    """Turns, masks, places and intervals of each leaf; no block writes a shared start twice."""
    rows = talks()
    blocks = chat_tree.packed(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, leaves=7).collect()
    expected = by_talk(rows)
    found = []
    for b in blocks:
        paths = []
        assert len(b.input_ids) == len(b.loss_mask) == len(b.position_ids) == b.nodes[-1].end
        for k, n in enumerate(b.nodes):
            above = b.nodes[n.parent] if n.parent >= 0 else None
            path = [*paths[n.parent], k] if above else [k]
            paths.append(path)
            seen = [t for p in path[:-1] for t in range(b.nodes[p].begin, b.nodes[p].end)]
            assert [t for s in n.attends for t in range(s.begin, s.end)] == seen
            assert b.position_ids[n.begin : n.end] == list(range(len(seen), len(seen) + n.end - n.begin))
            assert n.parent < k and n.begin == (b.nodes[k - 1].end if k else 0)
        starts = [tuple(tuple(b.input_ids[b.nodes[p].begin : b.nodes[p].end]) for p in path) for path in paths]
        assert len(set(starts)) == len(starts)
        found += [(leaf.id, len(paths[leaf.node])) for leaf in b.leaves]
    assert sorted(found, key=str) == sorted(((i, len(t)) for i, t in expected.items()), key=str)
    assert len(blocks) >= len(expected) / 7


def test_what_is_read_back(spark):
    rows = talks(seed=5)
    blocks = chat_tree.packed(spark.createDataFrame(rows, SCHEMA).repartition(3), block=500)
    got = chat_tree.unpacked(blocks).collect()
    expected = by_talk(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == expected and len(got) == len(expected)
    for r in got:
        assert [x for x in r.loss if x] == [t for role, t in expected[r.conv_id] if role == "assistant" and t]
        assert r.formatted == "".join(f"<|im_start|>{chat_tree.written_role(role)}\n{chat_tree.escaped(text)}<|im_end|>\n" for role, text in expected[r.conv_id])


def test_shared_starts_are_stored_once(spark):
    """A start of 3,000 letters under 200 conversations makes one node of its own, not 200."""
    rows = [(i, k, "user", "start " * 500 if k == 0 else f"turn {i}") for i in range(200) for k in range(2)]
    blocks = chat_tree.packed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(len(b.input_ids) for b in blocks) < 0.1 * 200 * 500 and sum(len(b.leaves) for b in blocks) == 200


def test_empty_and_string_ids(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert chat_tree.packed(none).count() == 0
    some = spark.createDataFrame([("b", 1, "user", "x"), ("b", 0, "user", "y"), ("b", 0, "user", "y")], none.schema)
    r = chat_tree.unpacked(chat_tree.packed(some)).first()
    assert r.conv_id == "b" and [t.text for t in r.turns] == ["y", "y", "x"]


marked = st.text(alphabet="<|\\n\nab", max_size=12)


@given(marked, marked)
def test_escapes_are_reversible_and_hide_marks(a, b):
    assert chat_tree.unescaped(chat_tree.escaped(a)) == a and chat_tree.read_role(chat_tree.written_role(a)) == a
    assert "<|" not in chat_tree.escaped(a) and "<|" not in chat_tree.written_role(a) and "\n" not in chat_tree.written_role(a)
    assert (chat_tree.escaped(a) == chat_tree.escaped(b)) == (a == b)


def test_op11_has_the_marked_conversation(spark, sf_dir):
    row = queries.op11_chat_tree(spark, sf_dir).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256, row.turns_sha256) == (2, len(text), digest(text), digest(f"user\n{text}\nassistant\n{text}\n"))
    assert brute.counted(queries.op11_chat_tree(spark, sf_dir).select("conv_id").distinct().collect()).total() == queries.op11_chat_tree(spark, sf_dir).count()


def test_few_blocks_are_read_at_once(spark):
    """A reader takes a row group into memory, so a group holds a few blocks, however many a task writes."""
    rows = spark.createDataFrame([(i, 0, "user", f"{i} " * 50) for i in range(300)], "conv_id long, turn long, role string, text string").coalesce(1)
    table = stored(chat_tree.packed(rows, block=1000), "chat", chat_tree.HELD)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) > 5 * chat_tree.HELD and max(groups) <= chat_tree.HELD
    assert chat_tree.unpacked(table).count() == 300
