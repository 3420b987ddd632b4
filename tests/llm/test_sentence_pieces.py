"""Encoding by chunks against the library on whole texts."""

import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from gridlode.llm import sentence_pieces as pieces

MODEL = SentencePieceProcessor(model_file=pieces.public_model())


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "Hello", "world", " ", "  ", "    ", "\n", "\n\n", "\t", "é", "中文", "\U0001f600", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x0A>", " ", "́", "12", "3.5", "#", "def ", "\x00", "ing", "﻿", "…"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 9, 50]))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 5, 1 << 20])
def test_chunks_give_the_ids_of_whole_texts(limit):
    table = pieces.ChunkTable(MODEL)
    assert table.apart
    all_texts = [*texts(1, 1500), " ", "▁", "  ", "x ", " x", "▁ x▁ "]
    for text, ids in zip(all_texts, table.encode(all_texts, limit), strict=True):
        assert ids.tolist() == MODEL.encode(text), repr(text)
    assert table.encode([]) == []


def test_a_full_table_begins_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHARS", 40)
    table = pieces.ChunkTable(MODEL)
    for text in texts(2, 300):
        assert table.encode([text])[0].tolist() == MODEL.encode(text)
        assert table.chars <= 40 + len(text) + 1


def test_each_chunk_is_segmented_once():
    table, asked = pieces.ChunkTable(MODEL), []

    class Counting:
        normalize = staticmethod(MODEL.normalize)

        @staticmethod
        def encode(texts, **kw):
            asked.extend(texts)
            return MODEL.encode(texts, **kw)

    table.model = Counting
    for _ in range(3):
        table.encode(["the cat and the dog", "the cat and the dog and the bird"])
    assert sorted(asked) == sorted("." + w for w in ("▁the", "▁cat", "▁and", "▁dog", "▁bird"))


def test_where_pieces_cross_markers_whole_texts_are_encoded(monkeypatch):
    monkeypatch.setattr(pieces, "crosses_markers", lambda model: True)
    table = pieces.ChunkTable(MODEL)
    for text in texts(4, 50):
        assert table.encode([text])[0].tolist() == MODEL.encode(text)


def test_round_trip_in_spark(spark, tmp_path):
    rows = [*enumerate(texts(3, 300)), (None, "no id"), (7, None), (8, "same"), (8, "same"), (9, "z" * 20_000), (10, "many words here " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.decode(pieces.encode(docs)).collect()
    want = {t: MODEL.encode(t or "") for _, t in rows}
    assert len(got) == len(rows)
    assert all(r.ids == want[r.text] and r.decoded == MODEL.decode(want[r.text]) for r in got)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = sorted(((i, len(want[t]), sha(",".join(map(str, want[t]))), sha(MODEL.decode(want[t]))) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in pieces.op12_sentence_pieces(spark, str(tmp_path)).collect()), key=str) == expected


def test_null_ids_decode_to_nothing(spark):
    out = pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, MODEL.encode("some words"))], "k long, ids array<int>"))
    assert {r.k: r.decoded for r in out.collect()} == {1: "", 2: "", 3: "some words"}
