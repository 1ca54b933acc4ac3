"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import order_splits, slices, text_of

#: Code points of a shingle; a shorter text is one shingle.
WIDTH = 8
#: The share of the hash range that is kept.  A text of n code points keeps none with odds of (1 - FRACTION) ** max(1, n - WIDTH + 1).
FRACTION = 1 / 4

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the text's shingles; width is a power of two and is reached by doubling."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return points
    h = (points + np.uint64(1)) * _M1
    span = 1
    while span < width and len(h) > span:
        h = h[:-span] * _M1 + (h[span:] ^ (h[span:] >> np.uint64(29)))
        span *= 2
    if span < width:  # shorter than a shingle: the whole text is one
        h = h[:1] * np.uint64(len(points)) + np.bitwise_xor.reduce(points * _M1)
    return _mix(h)


def sketch(text: str, fraction: float = FRACTION, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes below fraction of the range.  Union of sketches = sketch of the union."""
    h = shingle_hashes(text, width)
    return np.unique(h[h < np.uint64(int(fraction * 2**64))])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def to_text(s: np.ndarray) -> str:
    """Base64 of the upper 48 bits of each hash, big-endian, in ascending order."""
    return base64.b64encode(np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()).decode()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; it does not depend on how much longer b is."""
    if not len(a):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    """Containment of a in b; equal texts count 1 even where no hash was kept."""
    return 1.0 if equal else containment(a, b)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the first as many code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, rows_per_part: int = 2048, most_parts: int = 65_536) -> DataFrame:
    """Fingerprint each text and its edited text, which continues with the next document's start.

    The next document is the one that follows in descending doc_id; after the last comes the
    first.  Documents are dealt by ranges of doc_id, whose bounds are ids that occur; the first
    document of each range is also sent to the range before it (the very first to the last), so
    each task finds every successor among its own sorted rows.  One shuffle of the texts, no
    window over all rows.  There are at most most_parts ranges (their bounds are all that the driver
    holds); beyond most_parts * rows_per_part documents a range has more rows, in sorted order.

    Null text: empty.  An empty text's fingerprint is empty.  Rows with one id follow each other
    by text.  Null ids come last.  A lone document follows itself.  An empty table gives no rows.
    """
    splits = np.array(order_splits(docs, rows_per_part, most_parts)[::-1], dtype=np.int64)  # ascending
    k = max(1, len(splits))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:  # 0 holds the greatest ids
        at = np.minimum(np.searchsorted(splits, doc_id.to_numpy(), side="left"), k - 1)
        return pd.Series((k - 1 - at).astype("int32"))

    base = text_of(docs).withColumn("part", part_of(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))))
    heads = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": splits}), "doc_id long")  # at most most_parts rows
    before = F.when(F.col("part") == 0, k - 1).otherwise(F.col("part") - 1)
    ahead = base.join(F.broadcast(heads), "doc_id", "left_semi").groupBy("doc_id", before.alias("part")).agg(F.min("text").alias("text"))
    both = base.withColumn("ahead", F.lit(0)).unionByName(ahead.withColumn("ahead", F.lit(1)))
    dealt = both.repartitionById(k, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, doc_id, text, sketch of the row that awaits its successor

        def finish(row: tuple, following: tuple) -> tuple:
            _, doc, text, own = row
            other = edited(text, following[2])
            new = own if other == text else sketch(other)
            return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(new), likeness(own, new, other == text), likeness(own, following[3], text == following[2]))

        for batch in slices(batches):
            out: list[tuple] = []
            for part, doc, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "ahead"))):
                row = (part, doc, text, sketch(text))
                if held is not None and held[0] == part:
                    out.append(finish(held, row))
                held = None if ahead else row
            cols = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.select("part", "doc_id", "text", "ahead").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
