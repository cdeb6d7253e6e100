"""Every opN_ query, all columns, on the small tables and on a table of odd rows, against SQL, the tokenizers library or plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import language, queries, repeats, rlz_dedup, secrets, suffix_dedup
from tests import oracle
from tests.llm import brute
from tests.llm.test_models import base_of, stats_of

TABLES = ("documents", "benchmark", "labels", "conversations")


def thue_morse(letters: str, n: int = 1024) -> str:
    """Sums that wrap at 2**64 take these words and their complements for equal, whatever base and letters they use."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def odd_documents() -> list[tuple]:
    rng = random.Random(12)
    ab, ba, words = thue_morse("ab"), thue_morse("ba"), [f"w{k}" for k in range(70)]
    passage = " ".join(words[:60])
    texts = [
        ab, ba, f"{ab} {passage}", f"{ba} {passage}", f"{ab}  {' '.join(words[:12])}", f"{ba} {' '.join(words[:12])}", " ".join(thue_morse("xy")), " ".join(thue_morse("yx")),
        "x" * 1000 + ab * 2 + "y" * 500, "z" * 1000 + ab * 2 + "t" * 500, "z" * 1000 + ba * 2, passage.upper(), passage + " " + " ".join(words), "é日 ß " * 150, "😀" * 120, "ü" * 201, "<|endoftext|> a<|endoftext|>b",
        "password = hunter2hunter\nAKIA" + "A1" * 9 + " " + "0f" * 14, "a#b|c\n\na#b|c\n a#b|c\nline\nline\n", "one two three", "one  two\tthree", "\x0b\x0c", "a\x00b \x1f", "123 !?", " ".join(rng.choice(words) for _ in range(30_000)),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n\t ")]
    return rows + [(200 + i, t) for i, (_, t) in enumerate(brute.corpus(seed=21, n=40)) if t is None or len(t) < 50_000]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The small tables, and odd ones with columns whose names clash with those inside the operators."""
    odd = tmp_path_factory.mktemp("odd")
    rows = odd_documents()
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])
    docs["lang"] = [None if i % 5 == 0 else ("en", "fr")[i % 2] for i, _ in rows]
    docs["source"], docs["n_chars"] = "s", docs.text.str.len().fillna(0).astype("int64")
    for c in ("id", "key", "node", "spans", "kept", "n_words", "words"):
        docs[c] = 1
    docs.to_parquet(odd / "documents.parquet", row_group_size=7)
    item = " ".join(f"w{k}" for k in range(12))
    items = [(1, f"{thue_morse('ba')} {item}"), (2, None), (3, "--"), (4, "one two"), (10, "one TWO three"), (11, " ".join(f"w{k}" for k in range(40)))]
    pd.DataFrame(items, columns=["item_id", "text"]).assign(id=1, spans=2).to_parquet(odd / "benchmark.parquet")
    labels = [(i, int(i % 3 > 0)) for i, _ in rows if i % 4] + [(3, 0), (9999, 1)]
    pd.DataFrame(labels, columns=["doc_id", "quality"]).assign(label=7).to_parquet(odd / "labels.parquet")
    talks = [(i // 3, i % 3, ("user", "assistant", "a\\\nb<|")[i % 3], t) for i, (_, t) in enumerate(rows) if t is None or len(t) < 50_000]
    talks += [(50, 0, "assistant", None), (50, 0, None, "<\\\\|<|x"), (51, 7, "system", ""), (52, 1, "assistant", "<\\"), (52, 2, "assistant", "|x")]
    pd.DataFrame(talks, columns=["conv_id", "turn", "role", "text"]).assign(id=1, node=2, path="p").to_parquet(odd / "conversations.parquet")
    return {"small": "/root/testdata/sf0.001", "odd": str(odd)}


@pytest.fixture(scope="module", params=["small", "odd"])
def folder(request, folders):
    return folders[request.param]


def texts_of(folder: str) -> list[tuple]:
    t = pd.read_parquet(f"{folder}/documents.parquet")
    return [(int(i), None if x is None or x != x else x) for i, x in zip(t.doc_id, t.text, strict=True)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_of_the_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    oracle.same(queries.QUERIES[name](spark, folder), con, queries.ORACLE_SQL[name])


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_op6_is_the_library(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    expected = []
    for i, t in texts_of(folder):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert brute.counted(map(tuple, queries.op6_bpe(spark, folder).collect())) == brute.counted(expected)


def test_op9_is_the_library(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for i, t in sorted(texts_of(folder), key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert brute.counted(map(tuple, queries.op9_token_files(spark, folder).collect())) == brute.counted(expected)


def test_op7_base_columns(spark, folder):
    got = {r.doc_id: r for r in queries.op7_secrets(spark, folder).collect()}
    rows = texts_of(folder)
    assert len(got) == len(rows)
    for i, t in rows:
        base, r = base_of(t), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(",".join(base))
        assert [x for x in r.spans.split(",") if x and not x.startswith("crf")] == base


def test_op8_and_its_verdict(spark, folder):
    got = {r.doc_id: r for r in queries.op8_quality(spark, folder).collect()}
    rows = texts_of(folder)
    assert len(got) == len(rows)
    for i, t in rows:
        if len(t or "") < 20_000:
            assert tuple(got[i])[1:6] == stats_of(t)
        assert got[i].base_failed == (got[i].n_words < 20 or 100 * got[i].n_repeat_words > 30 * got[i].n_words)
        assert not (got[i].base_failed and got[i].kept)


def test_op4_held_out(spark, folders):
    """Accuracy on rows that were not learned from, and the flag by plain crc32."""
    truth = pd.read_parquet(f"{folders['small']}/documents.parquet").set_index("doc_id").lang
    got = queries.op4_language(spark, folders["small"]).collect()
    assert {r.doc_id: r.held_out for r in got} == {int(i): zlib.crc32(str(i).encode()) % 3 == 1 for i in truth.index}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98
    odd = {r.doc_id: r for r in queries.op4_language(spark, folders["odd"]).collect()}
    assert {i for i, r in odd.items() if r.lang_pred == "und"} >= {100, 101, 102, 23, 14} and all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in odd.values()} <= {"und", "en", "fr"} and len(odd) == len(texts_of(folders["odd"]))


@pytest.mark.parametrize("group", [2000, 2])
def test_repeats_are_decided_by_the_sorter_and_the_parser(spark, folders, monkeypatch, group):
    """With these made to find nothing, nothing is removed: no count of hashes decides beside them."""
    nothing = lambda *a, **k: tuple(np.zeros(0, np.int64) for _ in range(4))
    monkeypatch.setitem(repeats.Repeats.__init__.__kwdefaults__, "group", group)
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet").where("doc_id < 20").select("doc_id", "text")
    for module, name, remove in ((suffix_dedup, "compare", suffix_dedup.remove_repeats), (rlz_dedup, "parse", rlz_dedup.remove_copied)):
        assert remove(docs).where(F.size("spans") > 0).count() > 0
        with monkeypatch.context() as m:
            m.setattr(repeats, "Compare", None)
            find = repeats.Repeats.__init__

            def without(self, *, compare, find=find, **rest):
                find(self, compare=nothing, **rest)

            m.setattr(repeats.Repeats, "__init__", without)
            m.setattr(module, name, nothing)
            assert remove(docs).where(F.size("spans") > 0).count() == 0


def planted(seed: int, texts: list[str], per_shape: int = 20):
    """Secrets in shapes that no fixed pattern and no generated line has, put between words of documents."""
    rng = random.Random(seed)
    alnum, digits, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789", "0123456789abcdef"
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    shapes = {
        "push": lambda: ("remote ", "ghp_" + pick(alnum, 36), " set"), "pay": lambda: ("charge with ", "sk_live_" + pick(alnum, 24), " today"), "chat": lambda: ("hook ", f"xoxb-{pick(digits, 11)}-{pick(alnum, 24)}", " on"),
        "web": lambda: ("cookie ", f"eyJ{pick(alnum, 30)}.eyJ{pick(alnum, 40)}.{pick(alnum + '-_', 43)}", " sent"), "maps": lambda: ("maps ", "AIza" + pick(alnum + "-_", 35), " used"), "store": lambda: ("DB_PASS='", pick(alnum, 14), "' there"),
        "cloud": lambda: ("aws credential ", pick(alnum + "/+", 40), " end"), "uuid": lambda: ("x-auth: ", "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), " end"), "login": lambda: ("login bob pwd ", pick(alnum, 10), " ok"),
    }
    rows, spans = [], {}
    for make in shapes.values():
        for _ in range(per_shape):
            words = rng.choice(texts).split(" ")
            k = rng.randrange(len(words))
            before, secret, after = make()
            start = len(" ".join(words[:k])) + 1 + len(before)
            spans[len(rows)] = (start, start + len(secret))
            rows.append((len(rows), f"{' '.join(words[:k])} {before}{secret}{after} {' '.join(words[k:])}"))
    return rows, spans


def test_op7_finds_planted_secrets_of_unseen_shapes(spark, folders):
    docs = spark.read.parquet(f"{folders['small']}/documents.parquet")
    rows, spans = planted(5, [t for _, t in texts_of(folders["small"]) if t and 50 < len(t) < 4000])
    field = secrets.train(docs, id_col="doc_id")
    found = [(r.doc_id, s.start, s.end) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), field).collect() for s in r.spans if s.kind == "crf"]
    right = [(i, x, y) for i, x, y in found if (x, y) == spans[i]]
    assert len(set(right)) >= 0.9 * len(rows) and len(right) >= 0.95 * len(found)


def test_string_ids_of_models(spark):
    """Operators that carry an id along take any kind of it."""
    docs = spark.createDataFrame([("a", "the house"), ("a", "the house"), (None, None)], "doc_id string, text string")
    assert secrets.scan(docs, secrets.Field()).count() == 3
    assert {r.doc_id for r in language.predict(docs, language.Model([], {})).collect()} == {"a", None}
