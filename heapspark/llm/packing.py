"""Packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of
from .tokens import MEMORY, encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the first bin with room.

    A tournament tree holds at each node the greatest room below it, so the first bin with
    room is found from the root in log2(bins) steps.  Ties keep their input order.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    size = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, memory: int = MEMORY) -> DataFrame:
    """Ids of every document and its end id, cut each capacity ids; one row per piece.  memory: chunks that a worker remembers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, memory=memory), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, most=1 << 20):
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for doc, raw in zip(ids, enc.encode(texts.to_pylist())):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    out.append((doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return text_of(docs).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 2048, seed: int = 17, memory: int = MEMORY) -> DataFrame:
    """Pack every document into sequences of at most capacity ids, with first-fit decreasing.

    Documents are cut each capacity ids; pieces then meet in randomised groups (a seeded hash
    of id, start and the piece's checksum) of about group_docs documents' pieces, and each group is
    packed on its own.  So a group is small however large the corpus, one source or one id is, and
    groups run in parallel.  sequence_id = group * 2^32 + bin; offsets in a sequence have no gaps.

    Null or empty text: only the end id.  Repeated rows are documents of their own.  Null ids
    are kept.  An empty table gives no rows.  Other columns of docs are ignored.  Only rows that repeat
    both id and text share a group.
    memory: chunks that a worker remembers; it changes time and space, not rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.lit(seed)), F.lit(groups)).alias("g")

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        out = part.drop(columns="g")
        out["sequence_id"] = (int(key[0]) << 32) + bins
        out["offset"] = offsets
        return out

    cut = pieces(docs, tokenizer, capacity, end_id, memory)
    return cut.select("*", group).groupBy("g").applyInPandas(fill, _PACKED)
