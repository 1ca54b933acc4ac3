"""Forests as tables of (object_id, parent_id): ancestors at powers of two, sums along and under, intervals.

Everything here takes a number of rounds that grows with the logarithm of the depth, and tables of one row an object.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.order import running
from ..plans.store import counted, discard, materialize

#: Stands for the parent of trees' roots where a number is needed.
NONE = -(2**63)
#: Joins that a plan may hold before it is written.
JOINS = 6


class Forest:
    """parents: (object_id, parent_id), a row an object, null for roots; a written table."""

    def __init__(self, parents: DataFrame, depth: DataFrame | None = None):
        self.parents = parents.select("object_id", "parent_id")
        self._depth = depth

    @cached_property
    def levels(self) -> list[DataFrame]:
        """levels[k]: (object_id, up) of all objects that have an ancestor 2^k above them."""
        out = [self.parents.where("parent_id is not null").select("object_id", F.col("parent_id").alias("up"))]
        while True:
            far = out[-1].select(F.col("object_id").alias("up"), F.col("up").alias("further"))
            level, seen = counted(out[-1].join(far, "up").select("object_id", F.col("further").alias("up")), "level")
            if not seen["rows"]:
                discard(level)
                return out
            out.append(level)

    def drop(self) -> None:
        """Remove the written levels."""
        discard(*self.__dict__.get("levels", []))

    def _weighted(self, weights: Mapping[str, Column]) -> DataFrame:
        return self.parents.select("object_id", *[w.cast("long").alias(n) for n, w in weights.items()])

    def path_sums(self, base: DataFrame, names: list[str]) -> DataFrame:
        """base (object_id, *names), a row an object, with each name summed over an object and all its ancestors."""
        sums = base
        for level in self.levels:
            above = sums.select(F.col("object_id").alias("up"), *[F.col(n).alias(f"{n}__up") for n in names])
            step = level.join(above, "up").drop("up")
            sums = materialize(sums.join(step, "object_id", "left").select("object_id", *[(F.col(n) + F.coalesce(f"{n}__up", F.lit(0))).alias(n) for n in names]), "sums", instead_of=sums if sums is not base else None)
        return sums

    def subtree_sums(self, base: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
        """(object_id, *keys, name): name of base summed over an object and all below it, by keys.

        base: (object_id, *keys, name); objects of which nothing lies in base or below have no row.
        """
        own = ["object_id", *keys]
        sums = base.groupBy(*own).agg(F.sum(name).alias(name))
        for k, level in enumerate(self.levels):
            below = level.join(sums, "object_id").select(F.col("up").alias("object_id"), *keys, name)
            sums = materialize(sums.unionByName(below).groupBy(*own).agg(F.sum(name).alias(name)), "sums", instead_of=sums if k else None)
        return sums

    def ancestors(self, ids: DataFrame) -> DataFrame:
        """(object_id, at, distance): for each of ids, itself and all above it.  For reports on few objects: a row for each step."""
        out = ids.select("object_id").distinct().join(self.parents.select("object_id"), "object_id", "left_semi").select("object_id", F.col("object_id").alias("at"), F.lit(0).cast("long").alias("distance"))
        for k, level in enumerate(self.levels):
            more = out.join(level.withColumnRenamed("object_id", "at"), "at").select("object_id", F.col("up").alias("at"), (F.col("distance") + (1 << k)).alias("distance"))
            out = materialize(out.unionByName(more), "ancestors", instead_of=out if k else None)
        return out

    @cached_property
    def depth(self) -> DataFrame:
        """(object_id, depth): ancestors above an object."""
        if self._depth is not None:
            return self._depth
        return self.path_sums(self._weighted({"depth": F.when(F.col("parent_id").isNull(), 0).otherwise(1)}), ["depth"])

    def nearest_common(self, pairs: DataFrame) -> DataFrame:
        """(a, b, top, depth) for different pairs (a, b): the nearest object on or above both, null in different trees."""
        depth = self.depth.select("object_id", F.col("depth").cast("long").alias("depth"))
        of = lambda c, d: depth.select(F.col("object_id").alias(c), F.col("depth").alias(d))
        rows = pairs.select("a", "b").join(of("a", "da"), "a").join(of("b", "db"), "b")
        deeper = F.col("da") >= F.col("db")
        rows = rows.select("a", "b", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("da") - F.col("db")).alias("gap"), F.least("da", "db").alias("least"))
        joins, held = 2, None

        def kept(rows: DataFrame, more: int) -> DataFrame:
            nonlocal joins, held
            joins += more
            if joins < JOINS:
                return rows
            joins, held = 0, materialize(rows, "common", instead_of=held)
            return held

        for k in reversed(range(len(self.levels))):
            up = self.levels[k].select(F.col("object_id").alias("from"), "up")
            rows = rows.withColumn("from", F.when(F.col("gap") >= (1 << k), F.col("x"))).join(up, "from", "left")
            rows = kept(rows.select("a", "b", F.coalesce("up", "x").alias("x"), "y", F.when(F.col("up").isNull(), F.col("gap")).otherwise(F.col("gap") - (1 << k)).alias("gap"), "least"), 1)
        rows = rows.select("a", "b", "x", "y", F.col("least").alias("d"))
        for k in reversed(range(len(self.levels))):
            ux, uy = (self.levels[k].select(F.col("object_id").alias(c), F.col("up").alias(f"u{c}")) for c in "xy")
            # equal places need no step
            far = rows.withColumn("same", F.col("x") == F.col("y")).join(ux, "x", "left").join(uy, "y", "left")
            go = ~F.col("same") & (F.col("ux") != F.col("uy"))
            rows = kept(far.select("a", "b", F.when(go, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("uy")).otherwise(F.col("y")).alias("y"), F.when(go, F.col("d") - (1 << k)).otherwise(F.col("d")).alias("d")), 2)
        up = self.levels[0].select(F.col("object_id").alias("x"), F.col("up"))
        same = F.col("x") == F.col("y")
        rows = rows.join(up, "x", "left").select("a", "b", F.when(same, F.col("x")).otherwise(F.col("up")).alias("top"), F.when(same, F.col("d")).otherwise(F.col("d") - 1).alias("depth"))
        return materialize(rows, "common", instead_of=held)

    def numbered(self) -> DataFrame:
        """(object_id, parent_id, depth, enter, leave), written in the order of enter: b lies under a, or is a, where a.enter <= b.enter < a.leave.

        enter counts from 0 without gaps; siblings follow each other by id; depth counts from 0.
        """
        size = self.subtree_sums(self._weighted({"size": F.lit(1)}), "size")
        siblings = self.parents.select("object_id", F.coalesce("parent_id", F.lit(NONE)).alias("parent")).join(size, "object_id")
        before = running(siblings, ["object_id"], "size", "before", within=["parent"])
        root = F.col("parent") == NONE
        steps = materialize(before.select("object_id", (F.col("before") + F.when(root, 0).otherwise(1)).alias("enter"), F.when(root, 0).otherwise(1).cast("long").alias("depth")), "steps", instead_of=before)
        at = self.path_sums(steps, ["enter", "depth"])
        rows = self.parents.join(at, "object_id").join(size, "object_id").select("object_id", "parent_id", "depth", "enter", (F.col("enter") + F.col("size")).alias("leave"))
        out = materialize(rows.repartitionByRange("enter").sortWithinPartitions("enter"), "numbered")
        discard(steps, size, at if at is not steps else None)
        return out
