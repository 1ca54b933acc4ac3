"""Token ids of whole texts by the tokenizers library, with a per-worker memory of chunks.

A byte-level or word-level BPE never merges across its pre-tokens, so the ids of a text are the
ids of its chunks one after another.  A worker asks the library once for each new chunk and
keeps the answer; texts with a special token's string or with white space that Python and the
library class differently go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import partial
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a worker remembers, about 170 bytes each, unless it is asked for fewer.  Where they are more, the half that came
#: last is forgotten: what is frequent comes early.
MEMORY = 1_000_000

#: Runs of non-space with their leading space, and white space as the byte-level pattern cuts it.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|<\|").search
_CONTROLS = tuple("\x0b\x0c\x1c\x1d\x1e\x1f") + ("<|",)

#: Marks that end many chunks: after a letter or digit they are a pre-token of their own.
_TAIL = ".,;:!?|%*&$#@+=/-)]}>\"'"

_encoders: dict[tuple[str, bool], "ChunkEncoder"] = {}


#: Characters of texts whose new words are asked for together, and words in one such text.
GROUP_CHARS, JOINED = 1 << 18, 1024


def _odd(text: str) -> bool:
    """What _ODD finds; ASCII texts are searched for each of its ASCII strings, which is faster."""
    if not text.isascii():
        return _ODD(text) is not None
    for x in _CONTROLS:
        if x in text:
            return True
    return False


class ChunkEncoder:
    """Little-endian 32-bit ids of texts under the tokenizer in file path.

    words: the tokenizer drops white space, so that words are its chunks, and new ones of several texts are asked for together;
    where it also lower-cases, words of letters many in one text, ASCII ones in lower case.
    """

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = str.split if words else _CHUNKS
        self.known: dict[str, bytes] = {}
        self.memory = MEMORY
        self.together = GROUP_CHARS if words else 0
        # what a normalizer does to lower-case ASCII letters is nothing, so they needn't pass one that lower-cases
        self.plain = Tokenizer.from_file(path) if words and "lowercase" in str(self._normalizers()).lower() else None
        if self.plain is not None:
            self.plain.normalizer = None

    def _normalizers(self) -> list[str]:
        """Types of the normalizers, where they are known to leave lower-case ASCII letters and single spaces alone; else none."""
        kind = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        kinds = kind.get("normalizers", [kind])
        harmless = all(k.get("type") in ("NFC", "Lowercase") or k.get("type") == "Replace" and k.get("pattern") == {"Regex": r"\s+"} and k.get("content") == " " for k in kinds)
        return [k["type"] for k in kinds] if harmless else []

    def _forget(self) -> None:
        """Where more than `memory` chunks are known, the half that came last goes."""
        if len(self.known) > self.memory:
            self.known = dict(islice(self.known.items(), self.memory // 2))

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _ask_words(self, tokenizer, words: list[str]) -> list[bytes]:
        """_ask() of words of letters, many in one text; one by one where the tokenizer does not take each as one word."""
        out = []
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            found = tokenizer.encode(" ".join(some), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64), prepend=-1, append=-1)) * 4
            if len(cuts) != len(some) + 1:
                out += self._ask(some)
                continue
            raw, at = np.array(found.ids, dtype="<u4").tobytes(), cuts.tolist()
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Ids of new chunks.  Trailing marks are parted from their word, so that the library sees fewer different strings."""
        known, parted, lower, ask, words, plain = self.known, [], [], set(), set(), set()
        for chunk in chunks:
            body = chunk.rstrip(_TAIL)
            if body != chunk and body[-1:].isalnum():
                tail = chunk[len(body) :]
                parted.append((chunk, body, tail))
                if tail not in known:
                    ask.add(tail)
            else:
                body = chunk
            if body in known:
                continue
            if self.plain is None or not body.isalpha():
                ask.add(body)
            elif not body.isascii():
                words.add(body)
            else:
                low = body.lower()
                if low != body:
                    lower.append((body, low))
                if low not in known:
                    plain.add(low)
        for some, how in ((plain, partial(self._ask_words, self.plain)), (words, partial(self._ask_words, self.tokenizer)), (ask, self._ask)):
            if some:
                asked = list(some)
                known.update(zip(asked, how(asked)))
        for body, low in lower:
            known[body] = known[low]
        for chunk, body, tail in parted:
            known[chunk] = known[body] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; texts of some `together` characters share what they ask for."""
        out, at = [], 0
        while at < len(texts):
            upto, size = at + 1, len(texts[at])
            while upto < len(texts) and size + len(texts[upto]) <= self.together:
                size += len(texts[upto])
                upto += 1
            out += self._encode(texts[at:upto])
            at = upto
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        self._forget()
        known, out, open_, new = self.known, [], [], set()
        for text in texts:
            if _odd(text):
                out.append(self._ask([text])[0])
                continue
            chunks = self.chunks(text)
            ids = list(map(known.get, chunks))
            if None in ids:
                new.update([c for c, x in zip(chunks, ids) if x is None])
                open_.append((len(out), ids, chunks))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            self._learn(new)
            for at, ids, chunks in open_:
                out[at] = b"".join([known[c] if x is None else x for c, x in zip(chunks, ids)])
        return out


def encoder(path: str, words: bool = False, memory: int = MEMORY) -> ChunkEncoder:
    """The worker's encoder for path, which remembers about `memory` chunks at most."""
    if (path, words) not in _encoders:
        _encoders[path, words] = ChunkEncoder(path, words)
    found = _encoders[path, words]
    found.memory = memory
    found._forget()
    return found
