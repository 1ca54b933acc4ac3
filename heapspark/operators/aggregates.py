"""Aggregate functions of a user's own: bounded partial states beside the data, merged by key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..plans.store import importable

#: Groups whose states a task holds before it hands them on.
HELD = 65_536


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of numbers.

    partial: the state of some values (a float array without nulls) as a list of numbers of one length.
    merge: the state of a table of states, a row each.  finish: the result, or None.
    """

    partial: Callable[[np.ndarray], Sequence[float]]
    merge: Callable[[np.ndarray], Sequence[float]]
    finish: Callable[[Sequence[float]], float | None]


AGGREGATES: dict[str, Aggregate] = {}


def register(name: str, aggregate: Aggregate) -> Aggregate:
    if name in AGGREGATES:
        raise ValueError(f"{name} is taken")
    AGGREGATES[name] = aggregate
    return aggregate


def aggregate(df: DataFrame, keys: Sequence[str], value: str, name: str, out: str) -> DataFrame:
    """(keys, out): a registered aggregate of value by keys; nulls don't count, groups of nulls alone have null.

    Tasks keep a state for each group that they meet and merge as they go (at most HELD at once), so what is shuffled
    is states, not rows: a group of any size sends one for each task and flush.
    """
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}; known: {', '.join(sorted(AGGREGATES))}")
    importable(df.sparkSession)
    how, keys = AGGREGATES[name], list(keys)
    kinds = StructType([df.schema[k] for k in keys])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[float] | None] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*keys, "state"])
            held.clear()
            return batch

        types = None
        for batch in batches:
            types = types or [batch.schema.field(k).type for k in keys]
            codes = pa.StructArray.from_arrays([batch.column(k) for k in keys], names=keys) if keys else None
            frame = pd.DataFrame({"v": batch.column(value).to_numpy(zero_copy_only=False).astype(float)})
            rows = [tuple(r.values()) for r in codes.to_pylist()] if keys else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            frame["g"] = [number.setdefault(r, len(number)) for r in rows]
            names = list(number)
            for g, part in frame.groupby("g")["v"]:
                known = part.to_numpy()[~np.isnan(part.to_numpy())] if batch.column(value).null_count else part.to_numpy()
                key, new = names[g], [float(x) for x in how.partial(known)] if len(known) else None
                old = held.get(key)
                held[key] = new if old is None else old if new is None else [float(x) for x in how.merge(np.array([old, new]))]
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        known = [s for s in frame["state"] if s is not None]
        result = how.finish(known[0] if len(known) == 1 else list(how.merge(np.array(known)))) if known else None
        return pd.DataFrame({**{k: frame[k].iloc[:1] for k in keys}, out: [result]})

    partial = df.select(*keys, F.col(value).cast("double").alias(value)).mapInArrow(states, StructType([*kinds.fields]).add("state", ArrayType(DoubleType())))
    return partial.groupBy(*keys).applyInPandas(finish, StructType([*kinds.fields]).add(out, DoubleType()))


def _moments(x: np.ndarray) -> list[float]:
    return [len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())]


def _merged_moments(s: np.ndarray) -> list[float]:
    n = s[:, 0].sum()
    mean = (s[:, 0] * s[:, 1]).sum() / n
    return [n, mean, float((s[:, 2] + s[:, 0] * (s[:, 1] - mean) ** 2).sum())]


register("DEVIATION", Aggregate(_moments, _merged_moments, lambda s: math.sqrt(s[2] / s[0])))
register("GEOMETRIC_MEAN", Aggregate(lambda x: [len(x), float(np.log(x).sum())], lambda s: s.sum(axis=0), lambda s: math.exp(s[1] / s[0])))
register("MIDRANGE", Aggregate(lambda x: [x.min(), x.max()], lambda s: [s[:, 0].min(), s[:, 1].max()], lambda s: (s[0] + s[1]) / 2))
