"""Workers that pack remember no more chunks than they are asked to; rows stay the same."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from heapspark.llm import common, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_forgets():
    texts = [" ".join(f"w{i}x{j}." for i in range(40)) for j in range(30)]
    enc = tokens.ChunkEncoder(PATH, False)
    want = enc.encode(texts)
    assert len(enc.known) > 1000
    tokens._encoders[PATH, False] = enc
    small = tokens.encoder(PATH, memory=100)
    assert small is enc and len(small.known) <= 100
    for text, ids in zip(texts, want):
        assert small.encode([text]) == [ids]
        assert len(small.known) <= 100 + 2 * 40 + 1  # one text's words and their marks more
    assert tokens.encoder(PATH).memory == tokens.MEMORY


def test_pack_with_little_memory(spark):
    common.ship(spark)
    docs = spark.createDataFrame([(k, " ".join(f"w{k * i % 97}y{k}," for i in range(150))) for k in range(60)], "doc_id long, text string")
    rows = lambda **more: sorted(map(tuple, packing.pack(docs, PATH, **more).collect()))
    assert rows(memory=50) == rows()


def test_pipeline_asks_for_less():
    assert corpus_pipeline.CHUNKS < tokens.MEMORY
