"""SentencePiece encoding and decoding with the n best segmentations of whole texts.

The lattice of a text has an edge for every piece of the model that occurs in it; a path's score
is the sum of its pieces' scores: log-probabilities that are counted in the documents as the library
encodes them (piece_scores), since a model of merges has only ranks, or the model's own.  A forward Viterbi pass gives the best score of every prefix,
and those scores are exact heuristics for an A-star search from the end of the text, so that
complete paths leave the queue in order of score.

Where no piece spans two neighbouring characters, every path has a node between them.  The lattice
is cut there, each part is searched on its own and remembered by the worker, and the n best
paths of the text are found by the same best-first search over the parts' alternatives.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, nsmallest
from itertools import chain, islice
from math import inf
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of

SPACE = "▁"
#: Parts that a worker remembers before it starts anew, and those with alternatives: bounds on its memory.
MEMORY, ALTERNATIVES = 600_000, 50_000
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Scores below this only mark pieces as a last resort; such pieces count as the worst other piece.
_LAST_RESORT = -1e8

#: Longer parts are searched one by one; the others of a group of texts together.
TOGETHER = 48
#: Code points of a group of texts whose new parts are searched together.
GROUP_CHARS = 1 << 20

# A part: (best score, ids of the best path as bytes, loss of the second best path).
Part = tuple[float, bytes, float]


class PieceTrie:
    """The pieces as arrays: what follows each beginning of a piece, for many texts in step."""

    def __init__(self, begun: dict[str, tuple[float, int] | None]):
        node = {"": 0} | {p: i for i, p in enumerate(begun, 1)}
        #: Score and id of the piece that a node is; id -1 where it only begins one.
        self.score = np.array([0.0, *[k[0] if k else -inf for k in begun.values()]])
        self.piece = np.array([-1, *[k[1] if k else -1 for k in begun.values()]], np.int64)
        steps = np.array([(node[p[:-1]] << 21) | ord(p[-1]) for p in begun], np.int64)
        order = np.argsort(steps)
        self.keys, self.nodes = steps[order], np.arange(1, len(node))[order]
        # where a node's steps begin among the sorted keys; most nodes have few, so the search there is short
        self.first = np.searchsorted(self.keys, np.arange(len(node) + 1, dtype=np.int64) << 21)
        self.rounds = int(np.diff(self.first)[1:].max(initial=1)).bit_length()
        self.roots = np.zeros(0x110001, np.int32)
        self.roots[self.keys[: self.first[1]]] = self.nodes[: self.first[1]]

    def step(self, at: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each node and character, -1 where no piece goes on like that."""
        low, high, key = self.first[at], self.first[at + 1], (at << 21) | char
        for _ in range(self.rounds):
            middle = (low + high) >> 1
            less = (low < high) & (self.keys[np.minimum(middle, len(self.keys) - 1)] < key)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        low = np.minimum(low, len(self.keys) - 1)
        return np.where(self.keys[low] == key, self.nodes[low], -1)

    def best(self, texts: list[str], unknown: float) -> list[Part | None]:
        """Each text's part as Lattice.part() has it; None where the best path has a character without a piece."""
        n, sizes = len(texts), np.array([len(t) for t in texts])
        width = int(sizes.max())
        chars = np.full((n, width), 0x110000, np.int64)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        row, start = np.nonzero(chars < 0x110000)
        at = self.roots[chars[row, start]].astype(np.int64)
        single = self.piece[at]
        edges = [(row, start, np.ones(len(row), np.int64), single, np.where(single >= 0, self.score[at], unknown))]
        length = 1
        going = at > 0
        row, start, at = row[going], start[going], at[going]
        while len(row):
            length += 1
            inside = start + length <= sizes[row]
            row, start, at = row[inside], start[inside], at[inside]
            at = self.step(at, chars[row, start + length - 1])
            going = at > 0
            row, start, at = row[going], start[going], at[going]
            own = self.piece[at] >= 0
            edges.append((row[own], start[own], np.full(int(own.sum()), length), self.piece[at[own]], self.score[at[own]]))
        row, start, span, piece, score = (np.concatenate(x) for x in zip(*edges))
        when = start * (length + 1) + span
        order = np.argsort(when, kind="stable")
        cuts = np.flatnonzero(np.diff(when[order], prepend=-1, append=-1))
        top, second = np.full((n, width + 1), -inf), np.full((n, width + 1), -inf)
        top[:, 0] = 0.0
        taken = np.zeros((n, width + 1), np.int64)
        for a, b in zip(cuts, cuts[1:]):  # edges with one start and length: one a text
            e = order[a:b]
            r, end = row[e], int(start[e[0]] + span[e[0]])
            value, had = top[r, int(start[e[0]])] + score[e], top[r, end]
            better = value > had
            second[r, end] = np.maximum(second[r, end], np.where(better, had, value))
            top[r, end] = np.where(better, value, had)
            taken[r, end] = np.where(better, e, taken[r, end])
        rows = np.arange(n)
        loss, back, end = np.full(n, inf), [], sizes.copy()
        while (on := end > 0).any():
            loss = np.where(on, np.minimum(loss, top[rows, end] - second[rows, end]), loss)
            e = taken[rows, end]
            back.append(np.where(on, piece[e], -2))
            end = np.where(on, start[e], 0)
        path = np.array(back[::-1]).T
        plain, used = (path != -1).all(axis=1), path != -2
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]) * 4
        ids = path[used].astype("<u4").tobytes()
        scores, losses = top[rows, sizes].tolist(), loss.tolist()
        return [(scores[i], ids[ends[i] : ends[i + 1]], losses[i]) if ok else None for i, ok in enumerate(plain.tolist())]


class Lattice:
    """The pieces of one model, and the n best paths of texts over them."""

    def __init__(self, model: str, n: int, given: np.ndarray | None = None):
        """given: a score for each id, in place of the model's own."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = n
        self.piece_ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.output = [b""] * sp.get_piece_size()
        scores = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.output[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece_ids[piece] = i
                self.output[i] = piece.replace(SPACE, " ").encode()
                scores.append(sp.get_score(i) if given is None else float(given[i]))
        self.unknown_id = sp.unk_id()
        usable = [s for s in scores if s > _LAST_RESORT]
        worst = min(usable, default=0.0)
        self.unknown = worst - UNKNOWN_PENALTY
        self.scores = {p: max(s, worst) for p, s in zip(self.piece_ids, scores)}
        #: Every beginning of a piece: its (score, id) where it is a piece itself, else None.
        self.begun: dict[str, tuple[float, int] | None] = {p[:i]: None for p in self.scores for i in range(1, len(p))}
        self.begun.update({p: (s, self.piece_ids[p]) for p, s in self.scores.items()})
        self.trie = PieceTrie(self.begun)
        self.chunks = self._cutter()
        self.known: dict[str, Part] = {}
        self.others: dict[str, list[tuple[float, bytes]]] = {}

    def _cutter(self):
        """The function that cuts a text into parts that no piece crosses: words, and the marks behind them."""
        joined = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scores):
            return lambda text: [text]
        marks = "".join(m for m in ".,;:!?|%*&$#" if not any(j[1] == m and j[0].isalnum() for j in joined))
        inner, word_end = f"[^{SPACE}\n{re.escape(marks)}]", f"[^\\W_{SPACE}\n]"
        word = f"{SPACE}*{inner}*{word_end}(?=[{SPACE}\n{re.escape(marks)}]|$)|" if marks else ""
        return re.compile(f"{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def forward(self, text: str) -> tuple[list[float], list, list[list[tuple[int, float, int]]]]:
        """Viterbi pass: each prefix's best score, its last edge (start, score, piece), and all edges by their end."""
        begun, size, unknown = self.begun, len(text), self.unknown
        best, last = [-inf] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            so_far, end = best[start], start + 1
            known = begun.get(text[start:end], 0)
            if not known:  # no piece of its own
                edge = (start, unknown, -1)
                edges[end].append(edge)
                if so_far + unknown > best[end]:
                    best[end], last[end] = so_far + unknown, edge
            while known != 0:
                if known is not None:
                    score, piece = known
                    edge = (start, score, piece)
                    edges[end].append(edge)
                    if so_far + score > best[end]:
                        best[end], last[end] = so_far + score, edge
                end += 1
                if end > size:
                    break
                known = begun.get(text[start:end], 0)
        return best, last, edges

    def search(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a text in descending order of score; ties in the order of search."""
        size = len(text)
        best, _, edges = self.forward(text)
        found: list[tuple[float, list[int]]] = []
        # Waiting paths, best first.  A waiting path's bound is the score of a real path, and no path
        # waits twice, so no more of them need to wait than paths are still to be found.
        queue: list[tuple] = [(-best[size], 0, size, 0.0, None)]
        tick, room = 0, n
        while queue and room:
            _, _, at, done, path = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    piece, end, path = path
                    ids += (piece,) if piece >= 0 else self.fallback(text[at])
                    at = end
                found.append((done, ids))
                room -= 1
                continue
            for start, score, piece in edges[at]:
                bound = -(done + score) - best[start]
                if len(queue) < room or bound < queue[-1][0]:
                    tick += 1
                    insort(queue, (bound, tick, start, done + score, (piece, at, path)))
                    if len(queue) > room:
                        queue.pop()
        return found

    def fallback(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown_id]

    def part(self, text: str) -> Part:
        """The best path, and the search's first steps back along it: what the best path beside it loses."""
        if text not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            best, last, edges = self.forward(text)
            at, loss, ids = len(text), inf, []
            while at:
                taken = last[at]
                for edge in edges[at]:
                    if edge is not taken:
                        loss = min(loss, best[at] - (best[edge[0]] + edge[1]))
                at, _, piece = taken
                ids += (piece,) if piece >= 0 else reversed(self.fallback(text[at]))
            ids.reverse()
            self.known[text] = (best[-1], pack(f"<{len(ids)}I", *ids), loss)
        return self.known[text]

    def parts_of(self, text: str) -> list[str]:
        return self.chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, chunks: Iterable[list[str]]) -> None:
        """Searches all new short parts of a group of texts together and remembers them."""
        new = set().union(*chunks).difference(self.known)
        if len(self.known) + len(new) > MEMORY:  # what is frequent came early
            self.known = dict(islice(self.known.items(), MEMORY // 2))
            new = set().union(*chunks).difference(self.known)
        short = sorted((c for c in new if len(c) <= TOGETHER), key=len)
        for i in range(0, len(short), 8192):
            some = short[i : i + 8192]
            self.known.update((c, p) for c, p in zip(some, self.trie.best(some, self.unknown)) if p)

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """encode() of each text, in groups that share the search of their new parts."""
        group, size = [], 0
        for text in texts:
            group.append(self.parts_of(text))
            size += len(text)
            if size >= GROUP_CHARS:
                self.learn(group)
                yield from map(self.best_paths, group)
                group, size = [], 0
        self.learn(group)
        yield from map(self.best_paths, group)

    def alternatives(self, text: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of a part's paths beside the best one."""
        if text not in self.others:
            if len(self.others) >= ALTERNATIVES:
                self.others.clear()
            top, own, _ = self.part(text)
            found = [(max(0.0, top - score), pack(f"<{len(ids)}I", *ids)) for score, ids in self.search(text, self.n)]
            self.others[text] = [x for x in found if x[1] != own][: self.n - 1]
        return self.others[text]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids) of the n best segmentations; an empty text has one, of no pieces."""
        return self.best_paths(self.parts_of(text))

    def best_paths(self, chunks: list[str]) -> list[tuple[float, bytes]]:
        """encode() of a text's parts.

        A path that leaves the best one in several parts is no better than each path that leaves
        it in only one of them, so the n - 1 least losses are all that can take part.
        """
        if not chunks:
            return [(0.0, b"")]
        known = self.known
        try:
            parts = list(map(known.__getitem__, chunks))
        except KeyError:
            parts = [self.part(c) for c in chunks]
        scores, ids, losses = zip(*parts)
        top, losses, best = sum(scores), list(losses), b"".join(ids)
        found = [(top, best)]
        some = []
        for _ in range(self.n - 1):
            least = min(losses)
            if least == inf:
                break
            i = losses.index(least)
            losses[i] = inf
            some += [(loss, i, x) for loss, x in self.alternatives(chunks[i])]
        some = nsmallest(self.n - 1, some)
        if not some:
            return found
        start = {i: sum(map(len, ids[:i])) for _, i, _ in some}
        queue = [(some[0][0], (0,))]
        while queue and len(found) < self.n:
            loss, chosen = heappop(queue)
            swaps = sorted((start[some[j][1]], len(ids[some[j][1]]), some[j][2]) for j in chosen)
            if len({at for at, _, _ in swaps}) == len(chosen):
                at, out = 0, []
                for first, size, x in swaps:
                    out += [best[at:first], x]
                    at = first + size
                found.append((min(found[-1][0], top - loss), b"".join([*out, best[at:]])))
            last = chosen[-1]
            if last + 1 < len(some):
                step = some[last + 1][0]
                heappush(queue, (loss + step, (*chosen, last + 1)))
                heappush(queue, (loss - some[last][0] + step, (*chosen[:-1], last + 1)))
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_lattices: dict[tuple[str, int, int], Lattice] = {}


def lattice(model: str, n: int, scores: np.ndarray | None = None) -> Lattice:
    """The worker's lattice of a model file and scores; another one takes the place of that before it."""
    key = (model, n, 0 if scores is None else zlib.crc32(scores.tobytes()))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(model, n, scores)
    return _lattices[key]


class PieceCounter:
    """How often the library's own encoding uses each piece."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunks = Lattice(model, 1).chunks
        self.before = len(self.sp.encode("\n"))

    def count(self, texts: Iterable[str]) -> np.ndarray:
        """How often the texts use each id.  No piece crosses a cut, so each different chunk is encoded once and counts as often as it occurs."""
        total, times = np.zeros(self.sp.get_piece_size(), np.int64), Counter()
        for text in texts:
            if text:
                times.update(self.chunks(SPACE + text.replace(" ", SPACE)))
                if len(times) > MEMORY // 2:
                    self._add(total, times)
                    times.clear()
        self._add(total, times)
        return total

    def _add(self, total: np.ndarray, times: Counter[str]) -> None:
        chunks, n = list(times), np.fromiter(times.values(), np.int64, len(times))
        for i in range(0, len(chunks), 8192):
            # a line break first, so that the library's own leading space does not touch the chunk
            found = self.sp.encode(["\n" + c for c in chunks[i : i + 8192]], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= self.before
            np.add.at(total, ids[inside], np.repeat(n[i : i + 8192], sizes)[inside])


_counters: dict[str, PieceCounter] = {}


def piece_scores(docs: DataFrame, model: str, smoothing: float = 0.1) -> np.ndarray:
    """Log-probability of each id: its share of the pieces of all documents, as the library encodes them.

    Every id counts `smoothing` times more than it occurs, so that pieces the library never used have a score.
    One count for each id and partition is shuffled, one for each id comes to the driver.
    """
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters.clear()
            _counters[model] = PieceCounter(model)
        total = _counters[model].count(text for batch in slices(batches) for text in batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    counted = text_of(docs).select("text").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    n = np.full(size, smoothing)
    for r in counted.collect():
        n[r["piece"]] += r["n"]
    return np.log(n / n.sum())


def encode(docs: DataFrame, model: str, n: int = 4, scores: np.ndarray | None = None) -> DataFrame:
    """(doc_id, nbest: array of (score, ids as little-endian 32-bit integers)) of whole texts.

    scores: one for each id of the model, such as piece_scores(docs, model); else the model's own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # one number for each id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, kind = lattice(model, n, shared.value), pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))
        for batch in slices(batches):
            found = [[{"score": s, "ids": x} for s, x in best] for best in lat.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "nbest"])

    return text_of(docs).mapInArrow(run, "doc_id long, nbest array<struct<score: double, ids: binary>>")


def digest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """(doc_id, n_pieces, best_score, nbest_scores, nbest_crc32, decoded) of whole texts.

    Pieces are scored by piece_scores over all documents; best_score is the best path's log-probability
    as a sequence of independent pieces, where each character without a piece costs UNKNOWN_PENALTY more
    than the worst piece.  A piece has one score in all texts of a call, so scores depend on the other documents.  nbest_crc32: unsigned crc32 of each segmentation's ids as little-endian 32-bit integers.
    decoded: whether the best segmentation decodes to the text itself (false for texts that hold
    the space mark of the model, which decodes to a space).  Null or empty text: one
    segmentation without pieces.  Equal scores are ordered by which part comes first.  Rows are
    encoded one by one; texts are read twice, and only counts of pieces are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(docs, model))  # one number for each id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, n, shared.value)
        for batch in slices(batches):
            rows, texts = [], batch.column("text").to_pylist()
            for text, found in zip(texts, lat.encode_all(texts)):
                ok = lat.decode(found[0][1]) == text
                rows.append((len(found[0][1]) // 4, found[0][0], [s for s, _ in found], [zlib.crc32(x) for _, x in found], ok))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_pieces", "best_score", "nbest_scores", "nbest_crc32", "decoded"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_pieces long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded boolean")
