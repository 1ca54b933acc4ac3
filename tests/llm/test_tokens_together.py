"""New words of several texts are asked for together, with the library's own ids."""

from __future__ import annotations

import pytest

from heapspark.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["Abc abc, ABC. été Été ña", "İstanbul ΣΑΣ Σ K", "it's IT'S don'T ab12cd ﬁx", "\x0bab cd", "A<|b <|endoftext|>", "", " ", "Hello,World! ok?! x</w>", "ab​c \x1fd"]


def test_words_of_many_texts_are_asked_for_in_one_text_each_once():
    enc = tokens.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), True)
    asked, plain = [], enc._ask
    enc._ask = lambda texts: asked.extend(texts) or plain(texts)
    texts = [f"Word{chr(97 + i % 26)}{chr(97 + i // 26)} word{chr(97 + i % 26)}{chr(97 + i // 26)}, é{chr(97 + i % 26)}" for i in range(600)]
    found = enc.encode(texts)
    assert set(asked) <= {","}  # no call for a word of its own
    assert found == plain(texts)


@pytest.mark.parametrize("file, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("memory", [tokens.MEMORY, 3])
def test_odd_texts_have_the_librarys_ids(file, words, memory):
    enc = tokens.ChunkEncoder(public_tokenizers.path(file), words)
    enc.memory = memory
    assert enc.encode(TEXTS * 2) == enc._ask(TEXTS * 2)
