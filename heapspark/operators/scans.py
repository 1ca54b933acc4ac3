"""What a query reads: extents of classes, ids, addresses; paths through references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import smart_fix, whole
from ..plans.snapshot import Snapshot, class_ancestors
from . import graph


#: Classes up to this number become a filter, which reaches the scans; more are joined.
LISTED = 1000


def _of(snap: Snapshot, ids: DataFrame) -> DataFrame:
    """Objects of some classes.  A filter on a list folds away the tables and files of other classes."""
    listed = [r[0] for r in ids.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        return snap.objects.where(F.col("class_id").isin(listed))
    return snap.objects.join(F.broadcast(ids), "class_id", "left_semi")  # one row for each class


def extent(snap: Snapshot, name: str) -> DataFrame:
    """Objects of exactly this class, of every loader that has one."""
    return _of(snap, snap.classes.where(F.col("name") == name).select("class_id"))


def extent_with_subclasses(snap: Snapshot, name: str) -> DataFrame:
    of = snap.classes.where(F.col("name") == name).select(F.col("class_id").alias("ancestor_id"))
    return _of(snap, class_ancestors(snap.classes).join(of, "ancestor_id").select("class_id").distinct())


def extent_like(snap: Snapshot, pattern: str) -> DataFrame:
    """Objects of the classes whose whole name matches."""
    return _of(snap, snap.classes.where(F.col("name").rlike(whole(smart_fix(pattern)))).select("class_id"))


def extent_of(snap: Snapshot, classes: DataFrame) -> DataFrame:
    """Objects of the classes that a sub-select returns (column class_id)."""
    return _of(snap, classes.select("class_id").where("class_id is not null").distinct())


def implements(snap: Snapshot, objects: DataFrame, name: str, column: str = "implements") -> DataFrame:
    """objects with a boolean column: whether their class is of this name or descends from one that is."""
    of = snap.classes.where(F.col("name") == name).select(F.col("class_id").alias("ancestor_id"))
    under = class_ancestors(snap.classes).join(of, "ancestor_id").select("class_id", F.lit(True).alias(column)).distinct()
    return objects.join(F.broadcast(under), "class_id", "left").withColumn(column, F.coalesce(column, F.lit(False)))  # one row for each class


def object_set(
    snap: Snapshot, classes: DataFrame, ids: DataFrame | None = None, include_subclasses: bool = False, include_loaded_instances: bool = False,
    retained: bool = False, edges: DataFrame | None = None, tree: DataFrame | None = None,
) -> DataFrame:
    """(object_id): the objects that an inspection's argument names.

    Objects of classes (column class_id) and, as asked, of their subclasses and of all classes of their
    loaders; with ids besides; with all that roots reach only through the set.  edges and tree: those of
    the snapshot's index, where they are known.
    """
    of = classes.select("class_id").distinct()
    if include_loaded_instances:
        loaders = snap.classes.join(of, "class_id", "left_semi").select("loader_id").distinct()
        of = of.union(snap.classes.join(loaders, "loader_id", "left_semi").select("class_id")).distinct()
    if include_subclasses:
        of = class_ancestors(snap.classes).join(of.withColumnRenamed("class_id", "ancestor_id"), "ancestor_id", "left_semi").select("class_id").distinct()
    out = _of(snap, of).select("object_id")
    if ids is not None:
        out = out.union(ids.select("object_id")).distinct()
    return graph.retained_set(snap.objects, snap.refs if edges is None else edges, snap.roots, out, tree) if retained else out


def extent_of_ids(snap: Snapshot, ids: Sequence[int]) -> DataFrame:
    """Objects of the classes with these ids; an id that is no class is an error."""
    wanted = sorted(set(ids))
    known = {r[0] for r in snap.classes.where(F.col("class_id").isin(wanted)).select("class_id").distinct().collect()}
    if missing := [i for i in wanted if i not in known]:
        raise ValueError(f"not classes: {missing}")
    return snap.objects.where(F.col("class_id").isin(wanted))


def static_field(classes: DataFrame, statics: DataFrame, name: str) -> DataFrame:
    """(class_id, value): a static field of each class, its own or that of the nearest superclass that has it, else null.

    statics: (class_id, name, value).
    """
    given = statics.where(F.col("name") == name).select(F.col("class_id").alias("ancestor_id"), "value")
    nearest = class_ancestors(classes).join(given, "ancestor_id").groupBy("class_id").agg(F.min_by("value", "distance").alias("value"))
    return classes.select("class_id").join(nearest, "class_id", "left")


def objects_of(df: DataFrame, column: str, ids: DataFrame | None = None) -> DataFrame:
    """(object_id): what a column of selected objects holds, in a row each: ids as they are, lists of ids one by one; nulls go.

    ids: (object_id, address); the column then holds addresses, of which 0 is null.  Other types are an error.
    """
    kind = dict(df.dtypes)[column]
    if kind not in ("int", "bigint", "array<int>", "array<bigint>"):
        raise ValueError(f"{kind} is no object")
    found = F.explode(column) if kind.startswith("array") else F.col(column)
    rows = df.select(found.alias("object_id")).select(F.col("object_id").cast("long").alias("object_id")).where("object_id is not null")
    if ids is None:
        return rows
    return rows.where("object_id <> 0").withColumnRenamed("object_id", "address").join(ids, "address").select("object_id")


def class_objects(snap: Snapshot, pattern: str) -> DataFrame:
    """The classes themselves."""
    return snap.classes.where(F.col("name").rlike(whole(smart_fix(pattern))))


def by_id(snap: Snapshot, ids: Sequence[int]) -> DataFrame:
    """Objects of a list of ids, in its order (column at); repeated ids are repeated rows; unknown ids keep nulls."""
    listed = snap.objects.sparkSession.createDataFrame(list(enumerate(ids)), "at int, object_id long")
    return listed.join(snap.objects, "object_id", "left")


def reference(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """df with target's columns where df.column = target.key: null where the reference is null or dangling."""
    return df.join(target.withColumnRenamed(key, column) if key != column else target, column, "left")


def flatten(df: DataFrame, keep: Sequence[str], *arrays: str) -> DataFrame:
    """Array cells side by side as rows: shorter ones end in nulls, empty or null ones give one row of nulls."""
    return df.select(*keep, F.explode_outer(F.arrays_zip(*[F.coalesce(F.col(a), F.array()).alias(a) for a in arrays])).alias("z")).select(*keep, *[F.col(f"z.{a}").alias(a) for a in arrays])


def distinct_referents(df: DataFrame, column: str) -> DataFrame:
    """Different non-null targets of a reference."""
    return df.select(F.col(column).alias("object_id")).where("object_id is not null").distinct()


def member_of(df: DataFrame, column: str, other: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """IN and NOT IN a sub-select; a null is in neither, and nulls of the sub-select match nothing."""
    listed = other.select(F.col(key).alias(column)).where(F.col(column).isNotNull())
    rows = df.where(F.col(column).isNotNull())
    return rows.join(listed, column, "left_anti" if negate else "left_semi")


def union(*branches: DataFrame) -> DataFrame:
    """Concatenation by position, duplicates kept; columns of different types become text."""
    first = branches[0]
    mixed = [i for i in range(len(first.columns)) if len({b.dtypes[i][1] for b in branches}) > 1]

    def aligned(b: DataFrame) -> DataFrame:
        cols: list[Column] = [F.col(c).cast("string") if i in mixed else F.col(c) for i, c in enumerate(b.columns)]
        return b.select(*[c.alias(n) for c, n in zip(cols, first.columns)])

    out = aligned(first)
    for b in branches[1:]:
        out = out.unionAll(aligned(b))
    return out
