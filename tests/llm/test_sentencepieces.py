import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm.helpers import frame, odd_texts

from qaloom.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABC0123.,;:-_()'\"\n\t  ") + ["the", "ing", "   ", "▁", "中", "é", "🙂", "\x00", "    return"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k for k in range(70)] + [" " * k + "end" for k in range(40)] + ["a" * 2000, "中" * 300, "\n" * 9]
    encoder = sentencepieces.Encoder(PATH)
    flat, counts = encoder.encode(texts)
    assert counts.tolist() == [len(x) for x in library.encode(texts)]
    assert flat.tolist() == [i for x in library.encode(texts) for i in x]
    assert encoder.decode(flat, counts) == [library.decode(x) for x in library.encode(texts)]


def test_memory_of_units_may_be_dropped(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 5)
    monkeypatch.setattr(sentencepieces, "INDEXED", 20)
    encoder = sentencepieces.Encoder(PATH)
    for text in ("one two three four five six seven", "eight nine ten", "one two"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_documents_come_back(spark):
    docs = frame(spark, odd_texts())
    got = sentencepieces.encode_documents(docs, PATH)
    assert [c for c in got.columns if c != "ids"][: len(docs.columns) - 1] == [c for c in docs.columns if c != "ids"]
    found = {r.doc_id: r for r in got.collect()}
    assert all(r.round_trip for r in found.values())
    assert found[0].ids == [] and found[1].ids == [] and found[5].ids == found[6].ids
    back = sentencepieces.decode_documents(got.drop("text"), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(odd_texts())}
    assert sentencepieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_a_text_with_the_word_mark_is_told(spark):
    assert [r.round_trip for r in sentencepieces.encode_documents(frame(spark, ["a▁b"]), PATH).collect()] == [False]


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["x" * 25], ["ab", None, "中" * 9, "", "c" * 30, "d", "e" * 9, "f"]])
def test_batches_are_cut_by_bytes_and_keep_all_rows(monkeypatch, texts):
    monkeypatch.setattr(sentencepieces, "TOGETHER", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
    parts = [p.to_pydict() for p in sentencepieces.slices(batch, 1)]
    assert [t for p in parts for t in p["t"]] == texts and [i for p in parts for i in p["i"]] == list(range(len(texts)))
    assert all(sum(len((t or "").encode()) for t in p["t"][:-1]) < 20 for p in parts)
