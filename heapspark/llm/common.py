"""What the training-data operators share: inputs, the shared work folder, fold rules."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.store import discard, free_name, join_counted, materialize, work_dir

__all__ = ["discard", "documents", "fold", "free_name", "hash_below", "join_counted", "materialize", "order_splits", "ship", "slices", "text_hash", "text_of", "work_dir"]

#: Bytes of text that a worker turns into Python strings at once.
SLICE_BYTES = 4 << 20

#: Arrow batches of whole texts are bounded in bytes; Spark's own default is 64 MB.
_BATCH_CONF, _BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster, install it or pass --py-files), and keep Arrow batches small.

    The session's batch bound is lowered only where nobody has set it.
    """
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with null text as the empty text; other columns are dropped."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_hash() -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none has more than `most` bytes of text, but for single longer texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def hash_below(h: Column, wanted: int, n: int) -> Column:
    """True for about `wanted` of n rows, by their 64-bit hash: a threshold as fine as the hash, so it holds at any n."""
    return F.lit(True) if wanted >= n else h < F.lit(-(2**63) + (2**64 * wanted) // n)


def order_splits(docs: DataFrame, rows_per_part: int, most: int) -> list[int]:
    """Ids that cut doc_id, descending, into parts of about rows_per_part rows, `most` parts at most; the greatest id first.

    Every split is an id that occurs.  One pass over the id column; the list has one entry per part.
    """
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    if not n:
        return []
    parts = min(most, max(1, -(-n // rows_per_part)))
    if parts == 1:
        return [top]
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * parts))).first()[0]
    return sorted({top, *found}, reverse=True)
