"""Toxicity by compression distance: which of two trained dictionaries suits a text's windows better.

zstandard trains one dictionary on toxic text and one on ordinary text.  Toxic texts are mostly ordinary
words, so the toxic one is trained on their distinctive stretches (frequent there and rare in ordinary
text), and both sides end with the ordinary dictionary, the toxic one having its own before it and
the other as many neutral bytes: equal offsets cost equally, and a window's two compressed lengths
differ only by what the toxic dictionary explains.  A logistic model, fitted on documents that
neither dictionary was made from, calibrates the differences to a probability.

Two dictionaries of equal size, of whole toxic and whole ordinary windows (`trained_pair`), measure far
worse; the README has both variants' figures.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import fold, hash_below, slices, text_of

WINDOW, STEP = 256, 240
LEVEL = 6
#: Bytes of the grams whose frequencies decide; they run across words, so short words and phrases count.
GRAMS = (4, 6, 8)
#: Toxic texts that a gram must be in.  Each is tried, none (1) too; the calibration rows choose.
LEASTS = (1, 2, 3, 4, 6, 9, 14, 20, 30, 45, 70, 100, 150, 220, 330, 500)
#: How many times as frequent in toxic texts as in ordinary ones a gram must be.
LIFT = 8.0
#: Bytes of the toxic dictionary.
SEGMENT_BYTES = 4_096
#: Bytes of the common base.
BASE_BYTES = 49_152
_BITS = 24
_M = np.uint64(0x9E3779B97F4A7C15)


def windows(raw: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, max(1, len(raw) - (size - step)), step)]


def _line(text: str) -> bytes:
    """The whole text, each run of white space as one blank."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").split()) + b" "


def _slots(raw: bytes, k: int) -> np.ndarray:
    """Slot of the count table for each gram of k bytes."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    n = max(0, len(a) - k + 1)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h ^ a[i : i + n]) * _M
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _counts(lines: list[bytes], grams: Sequence[int]) -> np.ndarray:
    """Texts with a gram, by slot; grams are not kept as text."""
    table = np.zeros(1 << _BITS, np.int32)
    for x in lines:
        table[np.unique(np.concatenate([_slots(x, k) for k in grams]))] += 1
    return table


def lexicons(toxic: list[str], ordinary: list[str], leasts: Sequence[int] = LEASTS, grams: Sequence[int] = GRAMS, lift: float = LIFT, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """For each of leasts: a dictionary of toxic stretches, whose grams occur in so many toxic texts and `lift` times as often as in ordinary ones.

    Trained by zstandard; where the stretches are too few for its trainer, they are the dictionary, those of more texts first.
    """
    lines = [_line(t) for t in toxic]
    seen, other = _counts(lines, grams), _counts([_line(t) for t in ordinary], grams)
    rare = seen * float(max(1, len(ordinary))) >= lift * len(toxic) * np.maximum(1, other)
    if not rare.any():  # too few ordinary texts for that lift: all that they lack
        rare = (seen > 0) & (other == 0)
    for least in leasts:
        keep, found, each = rare & (seen >= least), Counter(), []
        for x in lines:
            edge = np.zeros(len(x) + 1, np.int32)
            for k in grams:
                at = np.flatnonzero(keep[_slots(x, k)])
                edge[at] += 1
                edge[at + k] -= 1
            ends = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0]).astype(np.int8)))
            own = [x[i:j] for i, j in zip(ends[::2], ends[1::2])]
            found.update(set(own))
            each += [s for s in own if len(s) >= 8]
        if out := _train(each, size, 24):
            yield out
            continue
        out = b""
        for segment, _ in sorted(found.items(), key=lambda f: (-f[1], -len(f[0]), f[0])):
            if len(out) + len(segment) <= size:
                out += segment
        yield out


def _train(samples: list[bytes], size: int, k: int) -> bytes:
    """A zstandard dictionary of the samples; none of too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def trained(texts: list[str], size: int) -> bytes:
    """A zstandard dictionary of the texts' windows; of too little text, the text itself."""
    samples = [w for t in texts for w in windows(t.encode("utf-8", "surrogatepass"), 128, 128)]
    return _train(samples, size, 32) or b"".join(samples)[:size]


def _compressor(content: bytes, kind: int = zstandard.DICT_TYPE_RAWCONTENT) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    toxic: bytes  # dictionary contents
    ordinary: bytes
    weights: np.ndarray  # of features() and a constant
    kind: int = zstandard.DICT_TYPE_RAWCONTENT
    least: int = 0  # toxic texts that a gram of the toxic dictionary's stretches is in
    _pair: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def features(self, text: str) -> np.ndarray:
        """Mean and summed gain of the toxic dictionary over the windows of a text, its greatest gain, its mean loss."""
        if self._pair is None:
            self._pair = (_compressor(self.toxic, self.kind), _compressor(self.ordinary, self.kind))
        toxic, ordinary = self._pair
        d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text.encode("utf-8", "surrogatepass"))], float)
        gain = np.clip(d, 0, None)
        return np.array([gain.mean(), np.log1p(gain.sum()), min(gain.max(), 20.0) / 4, (d - gain).mean(), d.sum() / np.sqrt(len(d)), 1.0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method with a small ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrate(model: Model, rest: list[tuple[str, int, float]]) -> float:
    """Set the weights from rows that the dictionaries did not see; the mean loss there."""
    x = np.stack([model.features(t) for t, _, _ in rest])
    y, weight = np.array([y for _, y, _ in rest], float), np.array([w for _, _, w in rest])
    model.weights = logistic(x, y, weight)
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
    return float(-(weight * np.where(y == 1, np.log(p), np.log1p(-p))).sum() / weight.sum())


def learn(rows: list[tuple[str, int, float]], leasts: Sequence[int] = LEASTS, grams: Sequence[int] = GRAMS, lift: float = LIFT, segment_bytes: int = SEGMENT_BYTES, base_bytes: int = BASE_BYTES, trained_pair: bool = False) -> Model | None:
    """From (text, toxic, weight) rows in random order: two thirds make the dictionaries, the rest calibrates.

    Of the toxic dictionaries of `leasts`, the one with the least loss on the rest is taken.  trained_pair: one
    zstandard dictionary of base_bytes of toxic windows and one of ordinary windows, nothing more.
    """
    train, rest = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    toxic, ordinary = [t for t, y, _ in train if y], [t for t, y, _ in train if not y]
    if not toxic or not ordinary:
        return None
    base = trained(ordinary, base_bytes)
    if trained_pair:
        model = Model(trained(toxic, base_bytes), base, np.zeros(6), zstandard.DICT_TYPE_AUTO)
        _calibrate(model, rest)
        return model
    best, loss, before = None, float("inf"), None
    for least, segments in zip(leasts, lexicons(toxic, ordinary, leasts, grams, lift, segment_bytes)):
        if segments == before or not segments and best is not None:
            continue
        before = segments
        model = Model(segments + base, bytes(len(segments)) + base, np.zeros(6), least=least)
        now = _calibrate(model, rest)
        if now < loss:
            best, loss = model, now
    return best


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, folds: int = 4, held: int = 2) -> Model | None:
    """Learn from labelled rows outside the held-out fold.

    Of each class about rows_per_class labels are used, by a hash of the id (all, where there are
    fewer), weighted back to the share of their class.  Their ids are few, so they are broadcast.
    """
    usable = labels.where((fold("doc_id", folds) != held) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, rows_per_class / n) for k, n in sizes.items()}
    below = F.lit(False)
    for k, n in sizes.items():
        below = F.when(F.col("toxic") == k, hash_below(F.xxhash64("doc_id", F.lit("toxicity")), rows_per_class, n)).otherwise(below)
    chosen = F.broadcast(usable.where(below))  # about 2 * rows_per_class rows
    rows = text_of(docs).join(chosen, "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("at")).collect()
    return learn([(r["text"], r["toxic"], 1 / share[r["toxic"]]) for r in sorted(rows, key=lambda r: (r["at"], r["toxic"]))])


def predict(docs: DataFrame, model: Model | None, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; score 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            score = [m.score(t) if m is not None else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = text_of(docs).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500) -> DataFrame:
    """Fit outside the held-out fold and score every whole text.

    Null and empty texts are scored as one empty window.  Repeated rows get equal scores;
    repeated equal labels count once.  Without toxic or without ordinary labels every score is 0.
    An empty table gives no rows.  Other columns are ignored.
    """
    return predict(docs, fit(docs, labels, rows_per_class))
