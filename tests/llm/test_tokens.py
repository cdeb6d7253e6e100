import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import bpe, token_files
from factloom.llm.shared import fresh_path
from tests.llm import brute


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n=400, seed=4):
    rng = random.Random(seed)
    parts = ["'s", "'t", "'ll", "'", " ", "  ", "\n", "\t", "　", "\xa0", "the", "Ba", "é", "1", "²", "!", "<|endoftext|>", "<|", "日本", "\x1c", "\x85", "😀", "=-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)] + ["a" * 3000, " " * 500, "=" * 777]


def test_bpe_is_that_of_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + brute.corpus(n=16)
    found = bpe.decode(bpe.encode(brute.frame(spark, rows))).collect()
    expected = brute.counted((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert brute.counted((r.doc_id, r.ids, r.decoded) for r in found) == expected


def test_decode_odd_ids(spark, library):
    rows = [(1, [220, 50256, 0]), (2, []), (3, None), (4, [161, 98]), (5, [999_999, 0])]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got[1] == library.decode([220, 50256, 0], skip_special_tokens=False)
    assert (got[2], got[3], got[5]) == ("", "", "!")
    assert got[4] == library.decode([161, 98], skip_special_tokens=False)
    assert bpe.encode(brute.frame(spark, [])).count() == 0


def test_round_trip_takes_one_python_worker_a_task(spark, library, tmp_path):
    """Each Python step of one stage is a worker of its own in every task, with a vocabulary of its own."""
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + brute.corpus(n=16)
    found = bpe.round_trip(brute.frame(spark, rows)).collect()
    expected = brute.counted((i, ids := library.encode(t or "", add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, t in rows)
    assert brute.counted((r.doc_id, r.ids, r.decoded) for r in found) == expected
    docs = brute.frame(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for df in (corpus_pipeline.tokenize(spark, docs, ""), bpe.op6_bpe(spark, str(tmp_path))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_token_files_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    rows = brute.corpus(n=40)
    manifest = token_files.write_sequences(brute.frame(spark, rows), fresh_path(spark, "tokens"), length=64)
    assert manifest.count() > 3
    found = token_files.read_documents(manifest).collect()
    start, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    first = manifest.orderBy("range", "part").first()
    with pa.memory_map(first.path.removeprefix("file:").replace("//", "/", 1)) as source:
        table = pa.ipc.open_stream(source).read_all()
    assert table.schema.field("input_ids").type == pa.list_(pa.uint16(), 64)
    assert pc.sum(pc.list_flatten(table["mask"]).cast(pa.int64())).as_py() == first.n_tokens


def test_token_files_of_nothing(spark):
    manifest = token_files.write_sequences(brute.frame(spark, []), fresh_path(spark, "tokens"))
    assert token_files.read_documents(manifest).count() == 0


def test_pieces_are_encoded_once_in_a_worker(library, monkeypatch):
    """What one task encoded is there for the next of its run; past the bound all is encoded anew. Ids are the library's throughout."""
    monkeypatch.setattr(token_files, "KEPT_PIECES", 2000)
    file = library.to_str()
    rng = random.Random(9)
    texts = odd_texts() + [" ".join("".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 6))) for _ in range(12)) for _ in range(400)]

    def ids(encoder, some):
        return [tokens[a:b].tolist() for _, _, tokens, rows in encoder(pa.array(some)) for a, b in zip(rows[:-1], rows[1:], strict=True)]

    assert ids(token_files.library_encoder(file, "run"), texts[:500]) == [library.encode(t, add_special_tokens=False).ids for t in texts[:500]]
    encoder, asked = token_files.library_encoder(file, "run"), []
    encode = encoder.encode
    encoder.encode = lambda pieces: asked.extend(pieces) or encode(pieces)
    ids(encoder, texts[:500])
    assert not asked
    assert ids(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    held = len(encoder.keys)
    assert held > 2000 and asked
    asked.clear()
    assert ids(encoder, texts[:500]) == [library.encode(t, add_special_tokens=False).ids for t in texts[:500]]
    assert asked and len(encoder.keys) < held
    assert token_files.library_encoder(file, "other run") is not encoder
