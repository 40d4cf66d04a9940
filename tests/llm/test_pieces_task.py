"""Pieces are found in the task that reads a text, over all of its words together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_words_together_are_as_words_alone(vocab):
    rng = random.Random(5)
    words = ["".join(rng.choice(f"ab é中x{pieces.MARK}\U0001f600zthe\t".replace(" ", "")) for _ in range(rng.randint(1, 40))) for _ in range(800)] + ["internationalization", "x"]
    trie, lookup = pieces.Trie(vocab), vocab.lookup()
    read = lambda ids: [np.frombuffer(i, "<i4").tolist() for i in ids]
    assert read(trie.ids_of(words)) == [pieces.all_merges(w, lookup, vocab.bytes_at) for w in words]
    trie.merges = False
    assert read(trie.ids_of(words)) == [pieces.best_path(w, lookup, vocab.longest, vocab.unknown, vocab.bytes_at) for w in words]


def test_texts_are_encoded_where_they_are_read(spark, vocab, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "CHARS", 50)
    monkeypatch.setattr(pieces, "MOST_WORDS", 20)
    monkeypatch.setattr(pieces, "MOST_IDS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-3, "中" * 3000)], "doc_id long, text string"))
    found = pieces.encode(docs, path)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.ids == library.encode(r.text or "") for r in rows)


def test_query(spark):
    found = pieces.op7_sentencepiece(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and found.where(~F.col("round_trip")).count() == 0
