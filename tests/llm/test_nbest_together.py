"""New parts of a group of texts are searched in few batches, with the rows of one text at a time."""

from __future__ import annotations

import pytest

from heapspark.llm import nbest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_new_parts_are_searched_in_one_batch():
    model = public_tokenizers.path("piece_bpe_32k.model")
    lat, calls = nbest.Lattice(model, 4), []
    best = lat.trie.best
    lat.trie.best = lambda texts, unknown: calls.append(len(texts)) or best(texts, unknown)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(k, k + 100)) for k in range(0, 6000, 100)]
    found = list(lat.encode_all(["", *texts]))
    assert len(calls) == 1 and calls[0] > 4096
    assert found == [lat.encode(t) for t in ["", *texts]] and found[0] == [(0.0, b"")]
