"""Which rows of two results are about the same object, and trees compared level by level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.order import running
from ..plans.store import counted, discard, materialize
from . import compare

#: Primitive arrays of at least so many bytes are told apart by their size.  A fixed value.
ARRAY_BYTES = 400
#: Kinds of objects that have no text of their own.
NAMELESS = ("obj_array", "prim_array")


def ranked(df: DataFrame, keys: Sequence[Column], order: Sequence[str], out: str = "nth") -> DataFrame:
    """df with `out`: 1, 2, ... among the rows with equal keys, in an order.

    Keys are told apart by 128 bits of hashes.  Rows are dealt by ranges, so a key of any number of rows is counted
    by many tasks.
    """
    hashed = df.withColumn("h1__rank", F.xxhash64(*keys)).withColumn("h2__rank", F.xxhash64(F.lit("second"), *keys)).withColumn("one__rank", F.lit(1))
    ran = running(hashed, order, "one__rank", out, within=["h1__rank", "h2__rank"], inclusive=True)
    done = ran.drop("h1__rank", "h2__rank", "one__rank")
    done._written_at = ran._written_at
    return done


def _passes(same_snapshot: bool) -> list[list[Column]]:
    """What rows must share, pass by pass; rows where a part is null match nothing."""
    if same_snapshot:
        return [[F.col("object_id")]]
    text = F.when(~F.col("kind").isin(*NAMELESS), F.col("own_name"))
    nameless = text.isNull()
    return [
        [F.col("class_name"), F.col("address")],
        [F.col("class_name"), text],
        [F.col("class_name"), F.when(nameless & (F.col("retained") > F.col("shallow")), F.col("retained"))],
        [F.col("class_name"), F.when((F.col("kind") == "prim_array") & (F.col("shallow") >= ARRAY_BYTES), F.col("shallow"))],
    ]


def paired(first: DataFrame, second: DataFrame, key: str, same_snapshot: bool = False) -> DataFrame:
    """(key, matched, object_0, object_1): rows of two results by their key, which may repeat.

    Sides have key, object_id, class_name, kind, address, own_name, shallow and retained.  Rows of a key are paired in
    passes, each among what the ones before left: the same id in one snapshot; else one class and the same address,
    the same own text, the same retained size if it exceeds the shallow one (rows without own text), the same size of
    large primitive arrays.  Several that match alike pair up by id.  What is left is put side by side by id, and
    what has no counterpart stands alone; matched: the pass from 0 on, null for those.
    """
    left, right = (materialize(t.select(key, "object_id", "class_name", "kind", "address", "own_name", "shallow", "retained"), "side") for t in (first, second))
    done: list[DataFrame] = []
    for n, on in enumerate(_passes(same_snapshot)):
        sides = []
        for side, t in enumerate((left, right)):
            fit = t.where(reduce(Column.__and__, [c.isNotNull() for c in on])).select(key, "object_id", *[c.cast("string").alias(f"on_{i}") for i, c in enumerate(on)])
            sides.append(ranked(fit, [F.col(key), *[F.col(f"on_{i}") for i in range(len(on))]], ["object_id"]).withColumnRenamed("object_id", f"object_{side}"))
        met = sides[0].join(sides[1], [key, *[f"on_{i}" for i in range(len(on))], "nth"]).select(key, F.lit(n).alias("matched"), "object_0", "object_1")
        met = materialize(met, "paired")
        discard(*sides)
        done.append(met)
        gone = [met.select(key, F.col(f"object_{i}").alias("object_id")) for i in (0, 1)]
        left, right = (materialize(t.join(g, [key, "object_id"], "left_anti"), "side", instead_of=t) for t, g in zip((left, right), gone))
    rest = [ranked(t.select(key, F.col("object_id").alias(f"object_{i}")), [F.col(key)], [f"object_{i}"]) for i, t in enumerate((left, right))]
    done.append(rest[0].join(rest[1], [key, "nth"], "full").select(key, F.lit(None).cast("int").alias("matched"), "object_0", "object_1"))
    return reduce(DataFrame.unionByName, done)


def compare_trees(trees: Sequence[DataFrame], key: str, values: Sequence[str], mode: str = "ABSOLUTE") -> DataFrame:
    """(level, path, nth, value_i...): trees of (node_id, parent_id, key, values) merged from the top.

    On each level rows with equal keys meet (repeated ones by the order of their values), but only below parents that
    have met; a node without counterpart goes on alone.  path: the keys from the top, nth the place among equal ones.
    """
    k = len(trees)
    level, number, out = [t.where("parent_id is null").select("node_id", key, *values, F.lit(None).cast("string").alias("above")) for t in trees], 0, []
    while True:
        flat = [t.withColumn("met__key", F.to_json(F.struct("above", key))) for t in level]
        ranks = [ranked(t, [F.col("met__key")], [*values, "node_id"]) for t in flat]
        stacked = reduce(DataFrame.unionByName, [t.withColumn("table", F.lit(i)) for i, t in enumerate(ranks)])
        cells = [F.max(F.when(F.col("table") == i, F.col(v))).alias(f"{v}_{i}") for i in range(k) for v in ("node_id", *values)]
        met, seen = counted(stacked.groupBy("met__key", "nth").agg(F.first(key).alias(key), F.first("above").alias("above"), *cells), "tree-level")
        discard(*ranks)
        if not seen["rows"]:
            return reduce(DataFrame.unionByName, out)
        step = F.when(F.col("nth") > 1, F.concat(F.col(key), F.lit("#"), F.col("nth"))).otherwise(F.col(key))
        path = F.concat_ws("/", "above", step)
        shown = compare.cells(F.col, values, k, dict(trees[0].dtypes), mode)
        out.append(met.select(F.lit(number).alias("level"), path.alias("path"), "nth", *shown))
        level = []
        for i, t in enumerate(trees):
            parents = met.where(F.col(f"node_id_{i}").isNotNull()).select(F.col(f"node_id_{i}").alias("parent_id"), path.alias("above"))
            level.append(t.join(parents, "parent_id").select("node_id", key, *values, "above"))
        number += 1
