"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, their roots extended into runs.

A run is a longest stretch of words that repeats with its smallest period at least twice.  Every run has a
Lyndon root that is the longest Lyndon word at its place, under one of two opposite orders of the words
(Bannai et al., The "Runs" Theorem).  Baier's suffix sorter groups suffixes by their longest Lyndon word in its
first phase, which therefore yields the Lyndon array; two passes, one an order, give all candidates, and longest
common extensions make runs of them.

Words that no six words, repeated within reach, cover belong to no run of twelve words or more, since a run's words
are all covered by six words that occur again one period away.  They are cut away first, so the grouping only
reads stretches that may hold runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_of

#: Least words of a run.
LEAST = 12
#: Rounds in which stretches are narrowed; any number gives the same runs.
ROUNDS = 8

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def lyndon_array(symbols: np.ndarray, falling: bool = False) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; symbols over 0 in rising or falling order.

    0 separates and is least under both orders; the first and last symbol must be 0, and what stands at 0s means
    nothing.  Groups of suffixes that share their longest known Lyndon word go from the greatest to the least; a
    group's word follows that of the nearest place before it which is still in a lesser group, as often as the
    group stands there, and places that grow alike make a group of their own just above the one that they leave.
    """
    order = np.argsort(symbols, kind="stable")
    order = order[np.searchsorted(symbols[order], 1) :]
    firsts = np.flatnonzero(np.diff(symbols[order], prepend=0))
    members = [x.tolist() for x in np.split(order, firsts[1:])] if len(order) else []
    if not falling:
        members.reverse()
    end = len(members)
    group = np.full(len(symbols), -1)
    for k, own in enumerate(members):
        group[own] = k
    group = group.tolist()
    members.append([])  # below the least group
    above, below = list(range(-1, end)), list(range(1, end + 2))
    length, open_at = [1] * len(symbols), list(range(len(symbols)))  # open_at: towards the nearest place, to the left, of a lesser group
    now = 0
    while now != end:
        own = [i for i in members[now] if group[i] == now]
        members[now] = ()
        if own:
            size = length[own[0]]
            for i in own:
                open_at[i] = i - 1
            times: dict[int, int] = {}
            for i in own:
                j = i - 1
                while (k := open_at[j]) != j:
                    open_at[j] = open_at[k]
                    j = k
                if group[j] >= 0:
                    times[j] = times.get(j, 0) + 1
            grown = times.items() if len(times) == len(own) else sorted(times.items(), key=lambda x: -x[1])
            made: dict[tuple[int, int], int] = {}
            for j, k in grown:
                old = group[j]
                new = made.get((k, old))
                if new is None:
                    new = made[k, old] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    below[up] = above[old] = new
                members[new].append(j)
                group[j] = new
                length[j] += k * size
        now = below[now]
    return np.array(length)


def _ranks(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... symbols: equal blocks, and only those, have equal names."""
    out, span = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * span <= longest:
        r = out[-1]
        out.append(np.unique(r[:-span] * (r.max() + 1) + r[span:], return_inverse=True)[1].astype(np.int64))
        span *= 2
    return out


def _extend(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from i on equal those from j on (back: how many before i equal those before j), i < j."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(ranks))):
        r, span = ranks[k], 1 << k
        a, b = (i - got - span, j - got - span) if back else (i + got, j + got)
        fits = (a >= 0) & (b < len(r))
        got += span * (fits & (r[np.where(fits, a, 0)] == r[np.where(fits, b, 0)]))
    return got


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs again."""
    bits = max(4, len(h).bit_length() + 2)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    may = np.bincount(slot, minlength=1 << bits)[slot] > 1
    _, where, n = np.unique(h[may], return_inverse=True, return_counts=True)
    out = np.zeros(len(h), bool)
    out[may] = n[where] > 1
    return out


def _stretches(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, stretch) of the words that may lie in runs; words of a stretch are neighbours of one part."""
    six = LEAST // 2
    at = np.arange(len(words))
    for _ in range(ROUNDS):
        if len(at) < LEAST:
            break
        w = words[at].astype(np.uint64)
        whole = part[: len(part) - six + 1] == part[six - 1 :]
        h = part[: len(whole)].astype(np.uint64) * _ODD[six]
        for k in range(six):
            h = h + (w[k : len(w) - six + 1 + k] + np.uint64(1)) * _ODD[k]
        h = (h ^ (h >> np.uint64(31))) * _ODD[0]
        first = np.flatnonzero(whole)
        first = first[_repeated(h[first])]
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + six, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        old, at = len(at), at[kept]
        part = np.cumsum((np.diff(kept, prepend=-2) != 1) | (np.diff(part[kept], prepend=-1) != 0))
        if len(at):
            long = np.bincount(part)[part] >= LEAST
            at, part = at[long], part[long]
        if len(at) == old:
            break
    return at, part


def runs_of(words: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least LEAST words, by start, then period.

    words: numbers that stand for words; part: rising numbers of the texts that they belong to.  No run leaves its part.
    """
    at, stretch = _stretches(words, part)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    begins = np.flatnonzero(np.diff(stretch, prepend=-1))
    sizes = np.diff(begins, append=len(at))
    # 0, first stretch, 0, second stretch, 0, ...
    moved = np.arange(len(at)) + np.repeat(np.arange(len(begins)), sizes) + 1
    line = np.zeros(len(at) + len(begins) + 1, np.int64)
    line[moved] = np.unique(words[at], return_inverse=True)[1] + 1
    end = np.repeat(begins + sizes, sizes) + np.repeat(np.arange(len(begins)), sizes) + 1  # of each word's stretch, in line
    found = []
    for falling in (False, True):
        root = lyndon_array(line, falling)[moved]
        two = moved + root < end
        found.append(np.stack([moved[two], root[two]]))
    i, p = np.unique(np.concatenate(found, axis=1), axis=1)
    apart = line.copy()
    apart[line == 0] = -1 - np.arange(len(begins) + 1)
    ranks = _ranks(apart, int(sizes.max()))
    before = _extend(ranks, i, i + p, back=True)
    length = before + p + _extend(ranks, i, i + p)
    keep = length >= np.maximum(LEAST, 2 * p)
    start, length, p = (i - before)[keep], length[keep], p[keep]
    place = np.zeros(len(line), np.int64)
    place[moved] = at
    start, p, length = np.unique(np.stack([place[start], p, length]), axis=1)
    return start, length, p


class Words:
    """The words of several texts (bytes of UTF-8) as numbers, without an object a word."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.inside = ~_SPACES[self.raw]
        edge = np.diff(self.inside.astype(np.int8), prepend=0)
        self.begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.begin, self.bounds)  # first[k] to first[k + 1]: words of text k
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        offsets = np.concatenate([[0], np.cumsum(end - self.begin)]).astype(np.int64)
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[self.inside])])
        self.number = held.dictionary_encode().indices.to_numpy().astype(np.int64)

    def without(self, dropped: np.ndarray) -> list[bytes]:
        """Each text's words but the dropped ones, joined by one space."""
        after = np.zeros(len(self.raw), bool)
        after[1:] = ~self.inside[1:] & self.inside[:-1]
        keep = self.inside | after
        if dropped.any():
            word = np.cumsum(np.diff(self.inside.astype(np.int8), prepend=0) == 1) - 1
            keep &= ~dropped[word] | (word < 0)
        ends = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
        joined = np.where(after, 0x20, self.raw)[keep].astype(np.uint8).tobytes()
        return [joined[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def repeats(length: int, words: Words, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of `length` words lies in a run after that run's first period."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _each(docs: DataFrame, emit: Callable, names: list[str], kinds: list[pa.DataType], schema: str, change: Callable[[bytes, int | None], bytes] | None = None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            if change:
                texts = [change(t, i) for t, i in zip(texts, ids)]
            words = Words(texts)
            start, size, period = runs_of(words.number, words.text)
            kept = words.without(repeats(len(words.number), words, start, size, period))
            cut = np.searchsorted(start, words.first)
            rows = [r for k, i in enumerate(ids) for r in emit(i, kept[k], (start[cut[k] : cut[k + 1]] - words.first[k]).tolist(), size[cut[k] : cut[k + 1]].tolist(), period[cut[k] : cut[k + 1]].tolist())]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return text_of(docs).mapInArrow(work, schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of at least LEAST words; words are numbered from 0.

    Every text by itself, whole; null text: no words.  No shuffle.  Rows that repeat an id give their runs each.
    """
    kinds = [pa.int64()] * 4
    return _each(docs, lambda i, kept, s, n, p: zip([i] * len(s), s, n, p), ["doc_id", "start", "length", "period"], kinds, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_runs): texts whose runs keep their first period only, words joined by one space."""
    kinds = [pa.int64(), pa.string(), pa.int64()]
    return _each(docs, lambda i, kept, s, n, p: [(i, kept.decode("utf-8", "replace"), len(s))], ["doc_id", "text", "n_runs"], kinds, "doc_id long, text string, n_runs long")


def planted(text: bytes, doc_id: int | None) -> bytes:
    """For one in ten ids (by crc32 of the id as text; a null id counts as the empty text), the text with a periodic tail."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    words = text.split() if h % 10 == 0 else []  # bytes split at the same six characters
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a])


def _digest(doc_id, kept: bytes, start: list[int], size: list[int], period: list[int]):
    best = min(zip([-n for n in size], start, period), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start, size, period))
    return [(doc_id, len(start), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())]


def digest(docs: DataFrame) -> DataFrame:
    """A row a document, after `planted`: its number of runs, its longest run (ties: least start, then period), digests of all runs and of the collapsed text.

    Null or empty text: no words, no runs, digests of nothing.  Empty table: no rows.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return _each(docs, _digest, names, kinds, ", ".join(f"{n} {'string' if n.endswith('256') else 'long'}" for n in names), change=planted)
