"""Sums, maxima and numbers along a total order of all rows, without one task that sees them all.

Rows are dealt by ranges of the order; each task runs through its own sorted rows, and what the ranges before it
add up to (one row a range) is carried over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .store import materialize

#: Less than all values whose maximum is asked for.
LEAST = -(2**63)


def running(df: DataFrame, by: Sequence[str], value: str, out: str, kind: str = "sum", within: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """df with `out`: the sum or max of value over the rows before each one in the order of `by` (inclusive: and itself).

    within: whole-number columns without nulls; only rows that share them count.  A null value counts as nothing.
    The order must not tie; a sum before the first row is 0, a max LEAST.  One shuffle by ranges, so neither a large
    group nor the whole table meets in one task; the result is a written table.
    """
    names = [f"{x}__run" for x in ("part", "at", "first", "far")]
    part, at, first, far = names
    zero = 0 if kind == "sum" else LEAST
    within, columns = list(within), df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, row, same, last, carried = TaskContext.get().partitionId(), 0, True, None, zero
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in within], axis=1) if within else np.zeros((n, 0), np.int64)
            values = batch.column(value).fill_null(zero).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = np.ones(n, bool)
            fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            fresh[0] = last is not None and tuple(keys[0]) != last
            segment = np.cumsum(fresh)  # 0: goes on from the batch before
            by_segment = pd.Series(values).groupby(segment)
            upto = (by_segment.cumsum() if kind == "sum" else by_segment.cummax()).to_numpy()
            goes_on = segment == 0
            upto = np.where(goes_on, upto + carried if kind == "sum" else np.maximum(upto, carried), upto)
            if inclusive:
                result = upto
            elif kind == "sum":
                result = upto - values
            else:
                result = np.concatenate([[carried if goes_on[0] else zero], np.where(fresh[1:], zero, upto[:-1])])
            own = (segment == 0) & same
            same, last, carried = bool(own[-1]), tuple(keys[-1]), int(upto[-1])
            extra = [pa.array(np.full(n, me, np.int64)), pa.array(np.arange(row, row + n)), pa.array(own), pa.array(upto), pa.array(result)]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *names, out])

    schema = StructType([*df.schema.fields])
    for c in (part, at):
        schema = schema.add(c, LongType())
    schema = schema.add(first, "boolean").add(far, LongType()).add(out, LongType())
    order = [F.col(c) for c in (*within, *by)]
    ran = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, schema), "running")
    ends = ran.groupBy(part).agg(F.max_by(F.struct(F.col(far).alias("far"), F.col(first).alias("lone"), F.array(*[F.col(c).cast("long") for c in within]).alias("key")), at).alias("end"),
                                 F.min_by(F.array(*[F.col(c).cast("long") for c in within]), at).alias("start"))
    carry, before, key = [], zero, None
    for r in sorted(ends.collect(), key=lambda r: r[part]):  # one row a range
        taken = before if key == r.start else zero
        carry.append((r[part], taken))
        lone = r.end.lone  # one group fills the range
        before = (taken + r.end.far if kind == "sum" else max(taken, r.end.far)) if lone else r.end.far
        key = r.end.key
    if all(c == zero for _, c in carry):
        return _named(ran, ran.drop(*names))
    carried = F.broadcast(df.sparkSession.createDataFrame(carry, f"{part} long, more__run long"))
    add = F.when(F.col(first), F.col(out) + F.col("more__run") if kind == "sum" else F.greatest(out, "more__run")).otherwise(F.col(out))
    return _named(ran, ran.join(carried, part).withColumn(out, add).drop(*names, "more__run"))


def _named(written: DataFrame, df: DataFrame) -> DataFrame:
    df._written_at = written._written_at  # discard(df) removes the table that it reads
    return df


def numbered(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the order of `by`, which must not tie."""
    ran = running(df.withColumn("one__run", F.lit(1)), by, "one__run", out)
    return _named(ran, ran.drop("one__run"))
