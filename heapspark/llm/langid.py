"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, hash_below, slices

#: Hashed features; a prime, so that codes spread.
FEATURES = 8191
_NOT_LETTERS = re.compile(r"[\W\d_]+").sub


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the 1- to 3-grams of a text's letters; both empty without letters."""
    letters = _NOT_LETTERS(" ", text.lower()).strip()
    if not letters.replace(" ", "").isalpha():  # digits and numerals that are word characters, such as superscripts
        letters = " ".join("".join(c if c.isalpha() else " " for c in letters).split())
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = c[:-1] * 7919 + c[1:]
    three = two[:-1] * 7919 + c[2:]
    grams = np.concatenate([c[1:-1], two + 104_729, three + 1_299_709]) % FEATURES
    n = np.bincount(grams, minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [feature, language]
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray | None:
        """Probability of each language, or None without letters."""
        at, n = counts(text)
        if not len(at):
            return None
        return softmax((tf_idf(at, n, self.idf) @ self.weights[at] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by follow-the-regularised-leader with elastic-net penalties.

    rows: (features, values, class) in the order of learning.
    """
    z, g2 = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def leader(z: np.ndarray, g2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = leader(z[at], g2[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None]
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / alpha * w
            g2[at] = new
    w = leader(z, g2)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a geometric grid that makes held-back labels likeliest."""
    grid = np.geomspace(0.05, 5, 60)
    return float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()))


def _with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, features, counts): as little-endian 32-bit integers, which keeps a collected sample small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [counts(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, "features", "counts"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", features binary, counts binary")


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that have each feature, over all rows, and at the end the number of rows with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total[counts(text)[0]] += 1
                total[FEATURES] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for r in found:  # at most FEATURES + 1 rows
        out[r["feature"]] = r["n"]
    return out


def cross_fitted(data: list[tuple[np.ndarray, np.ndarray, int]], k: int, parts: int = 3) -> float:
    """The temperature that suits the scores of rows by models that have not seen them: of each part, by weights of the others."""
    logits, y = [], []
    for p in range(min(parts, len(data))):
        weights, bias = ftrl([x for i, x in enumerate(data) if i % parts != p], k)
        logits += [x @ weights[at] + bias for at, x, _ in data[p::parts]]
        y += [label for _, _, label in data[p::parts]]
    return temperature(np.stack(logits), np.array(y)) if y else 1.0


def fit(docs: DataFrame, rows_per_language: int = 1500, folds: int = 5, held: int = 0, most_rows: int = 30_000) -> Model | None:
    """Learn from documents with text and lang outside the held-out fold.

    Document frequencies are those of all such documents.  The weights are fitted on a sample:
    of each language about rows_per_language different texts (all, where there are fewer), by a hash
    of the text, and about most_rows in all languages together.  A text that repeats within its
    language is one row of the sample, however often it occurs; only features come to the driver.  The
    temperature is cross-fitted on the whole sample.  None if nothing is labelled.
    """
    labelled = docs.where((fold("doc_id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("at"))
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).collect()}
    if not per:
        return None
    langs = sorted(per)
    wanted = max(1, min(rows_per_language, most_rows // len(langs)))
    df = document_frequencies(labelled)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    below = F.lit(False)
    for lang, n in per.items():
        below = F.when(F.col("lang") == lang, hash_below(F.xxhash64("at", F.lit("language")), wanted, n)).otherwise(below)
    sample = _with_counts(labelled.where(below), "at", "lang").dropDuplicates(["at", "lang"]).withColumn("at", F.xxhash64("at", F.lit("order")))
    rows = sorted(sample.collect(), key=lambda r: (r["at"], r["lang"]))
    data = []
    for r in rows:
        at, n = np.frombuffer(r["features"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(np.float64)
        if len(at):
            data.append((at, tf_idf(at, n, idf), langs.index(r["lang"])))
    weights, bias = ftrl(data, len(langs))
    return Model(langs, idf, weights, bias, cross_fitted(data, len(langs)))


def predict(docs: DataFrame, model: Model | None, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; `und` and 0 without letters or model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES * languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                p = m.scores(text) if m is not None and text else None
                best = None if p is None else int(p.argmax())
                lang.append("und" if p is None else m.langs[best])
                score.append(0.0 if p is None else float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows_per_language: int = 1500) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and predict every document.

    Ties go to the language that sorts first.  Null and empty texts, and texts without a letter:
    `und`, score 0.  Repeated rows get equal results.  An empty table gives no rows.  Columns
    other than doc_id, text and lang are ignored.
    """
    return predict(docs, fit(docs, rows_per_language))
