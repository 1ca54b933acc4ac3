"""Inspections put together from others: growth between snapshots, paths of one object, component and thread reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.snapshot import Snapshot
from ..plans.store import materialize
from . import compare, graph, inspections, quantize
from .forest import Forest
from .inspections import command

#: Texts of objects by class: functions from a row's columns to its text.  Later registrations win.
RESOLVERS: dict[str, Callable[[DataFrame], Column]] = {}


def name_resolver(class_name: str):
    def register(f: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
        RESOLVERS[class_name] = f
        return f

    return register


def resolved_name(df: DataFrame, class_name: str = "name") -> Column:
    """The text of each row by its class's resolver; empty where there is none."""
    out = F.lit("")
    for cls, f in RESOLVERS.items():
        out = F.when(F.col(class_name) == cls, F.coalesce(f(df).cast("string"), F.lit(""))).otherwise(out)
    return out


@command
def list_objects(snap: Snapshot, ids: DataFrame, inbound: bool = False) -> DataFrame:
    """(object_id, name, neighbour): the objects next to each of ids, with the referring field."""
    near, far = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
    edges = snap.refs.join(ids.select(F.col("object_id").alias(near)), near, "left_semi")
    return edges.select(F.col(near).alias("object_id"), "name", F.col(far).alias("neighbour"))


@command
def path2gc(snap: Snapshot, target: int, paths: int = 30, excluded: Column | None = None) -> DataFrame:
    """(path, length): shortest paths from roots to one object, one after another, shortest first, least ids first; at most `paths`.

    A search goes back from the object and enters each other object once, from the one nearest to the target
    (ties: the least id), but no root.  Each root that refers to an object found so ends a path, so a root can end
    several.  excluded: a condition on references; an edge made of such alone is not followed.  The object's own
    path, where it is a root.  Paths are put together for the `paths` chosen ends only.
    """
    spark = snap.objects.sparkSession
    edges = snap.refs.select("src_id", "dst_id").distinct() if excluded is None else graph.without_excluded(snap.refs, excluded)
    roots = snap.roots.select("object_id").distinct()
    start = spark.range(target, target + 1).select(F.col("id").alias("object_id"))
    if not start.join(roots, "object_id", "left_semi").isEmpty():
        return start.select(F.array("object_id").alias("path"), F.lit(1).alias("length"))
    found = graph.breadth_first(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")), start, blocked=roots)
    ends = edges.join(roots.withColumnRenamed("object_id", "src_id"), "src_id", "left_semi").join(found.select(F.col("object_id").alias("dst_id"), "depth"), "dst_id")
    ends = materialize(ends.select(F.col("src_id").alias("root"), F.col("dst_id").alias("object_id"), "depth").orderBy("depth", "root", "object_id").limit(paths), "ends")
    forest = Forest(found.select("object_id", "parent_id"), found.select("object_id", "depth"))
    walked = forest.ancestors(ends)
    steps = ends.join(walked, "object_id").groupBy("root", "object_id", "depth").agg(F.sort_array(F.collect_list(F.struct("distance", "at"))).alias("steps"))  # one path
    out = materialize(steps.select(F.concat(F.array("root"), F.transform("steps", lambda s: s["at"])).alias("path"), (F.col("depth") + 2).alias("length")), "paths")
    forest.drop()
    return out.orderBy("length", "path")


@command
def show_dominator_tree(snap: Snapshot, dom: graph.Dominance, ids: DataFrame) -> DataFrame:
    """The set's members that no other member dominates, with their retained sizes."""
    return dom.top_ancestors(ids).join(dom.retained(snap.objects), "object_id")


@command
def collection_fill_ratio(df: DataFrame, size: Column, capacity: Column, segments: int = 5) -> DataFrame:
    """Collections by size / capacity, up to 5: counts and unused slots."""
    ratio = F.when(capacity > 0, size / F.when(capacity > 0, capacity)).otherwise(1.0)
    rows = df.select(F.round(quantize.linear_double(ratio, 0.0, 5.0, 5.0 / segments), 6).alias("fill"), (capacity - size).alias("unused"))
    return rows.groupBy("fill").agg(quantize.count().alias("collections"), F.sum("unused").cast("long").alias("unused"))


@command
def simplecomparison(query: Callable[[Snapshot], DataFrame], baseline: Snapshot, now: Snapshot, key: str, values: Sequence[str], mode: str = "DIFF_RATIO_TO_FIRST") -> DataFrame:
    """One query on two snapshots, compared by key."""
    return compare.compare([query(baseline), query(now)], key, values, mode)


@command
def find_leaks2(baseline: Snapshot, now: Snapshot, before: graph.Dominance, after: graph.Dominance, threshold_percent: float = 2.0) -> DataFrame:
    """Top-level dominators, and classes of them, that grew by more than a share of the baseline's heap."""
    sides = [inspections._named(s, inspections.dominator_tree(s, d)).select("name", "object_id", "retained") for s, d in ((baseline, before), (now, after))]
    met = sides[1].withColumnRenamed("retained", "new").join(sides[0].select("object_id", F.col("retained").alias("old")), "object_id", "left")
    heap = baseline.objects.agg(F.sum("shallow").alias("heap"))
    grown = met.withColumn("growth", F.col("new") - F.coalesce("old", F.lit(0))).crossJoin(F.broadcast(heap))  # one row
    limit = F.col("heap") * threshold_percent / 100
    single = grown.where(F.col("growth") > limit).select(F.lit("object").alias("kind"), "name", "object_id", "growth")
    rest = grown.where(F.col("growth") <= limit).groupBy("name").agg(F.sum("growth").cast("long").alias("growth"), F.max("heap").alias("heap")).where(F.col("growth") > limit)
    return single.union(rest.select(F.lit("class").alias("kind"), "name", F.lit(None).cast("long").alias("object_id"), "growth"))


@command
def component_report(snap: Snapshot, ids: DataFrame, excluded: Column) -> dict[str, DataFrame]:
    """Reports on what a component retains, references in `excluded` left out: its histogram, packages, duplicate labels."""
    own = materialize(graph.retained_excluding(snap.refs, snap.roots, ids, excluded), "component")
    part = snap.objects.join(own, "object_id", "left_semi")
    inner = Snapshot(part, snap.classes, snap.refs, snap.roots)
    labels = inspections.group_by_value(part.where("label is not null"), "label", F.col("shallow")).where("objects >= 10")
    return {"histogram": inspections.histogram(inner), "packages": inspections.histogram(inner, group_by="BY_PACKAGE"), "duplicate labels": labels}


@command
def component_report_top(snap: Snapshot, dom: graph.Dominance, percent: float = 1.0) -> DataFrame:
    """Loaders whose top-level dominators retain at least a share of the heap."""
    heap = snap.objects.agg(F.sum("shallow").alias("heap"))
    by = inspections.dominator_tree(snap, dom, "BY_CLASSLOADER").crossJoin(F.broadcast(heap))  # one row
    return by.where(F.col("retained") >= F.col("heap") * percent / 100).drop("heap")


@command
def reference_leak(snap: Snapshot, references: DataFrame, field: str = "referent") -> DataFrame:
    """(reference, referent) where the reference also reaches its referent by other fields: it can never be cleared.

    Each different referent is searched back from once, over what leads to it; that is a row for each referent and
    object above it, so ask for the references of a report.
    """
    pairs = snap.refs.where(F.col("name") == field).join(references.select(F.col("object_id").alias("src_id")), "src_id", "left_semi").select(F.col("src_id").alias("reference"), F.col("dst_id").alias("referent"))
    strong = snap.refs.where(F.col("name") != field).select("src_id", "dst_id").distinct()
    # what leads to a referent, searched back from it: only references that it meets matter
    back = strong.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    above = graph.grown(back, pairs.select(F.col("referent").alias("group_id"), F.col("referent").alias("object_id")))
    return pairs.join(above.select(F.col("group_id").alias("referent"), F.col("object_id").alias("reference")), ["reference", "referent"], "left_semi")


@command
def thread_overview(snap: Snapshot, threads: DataFrame, frames: DataFrame, dom: graph.Dominance) -> DataFrame:
    """(object_id, shallow, retained, frames, locals) of thread objects; frames: (thread_id, depth, text, locals)."""
    ids = threads.select("object_id").distinct()
    low, high = ids.agg(F.min("object_id"), F.max("object_id")).first()  # objects outside these needn't meet any
    within = F.col("object_id").between(low, high)
    stacks = frames.groupBy(F.col("thread_id").alias("object_id")).agg(quantize.count().alias("frames"), F.sum(F.size("locals")).cast("long").alias("locals"))
    rows = ids.join(snap.objects.where(within).select("object_id", "shallow"), "object_id").join(dom.retained(snap.objects).where(within), "object_id", "left")
    return rows.join(stacks, "object_id", "left").select("object_id", "shallow", "retained", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("locals", F.lit(0)).alias("locals"))


@command
def thread_stack(frames: DataFrame, thread_id: int) -> DataFrame:
    return frames.where(F.col("thread_id") == thread_id).select("depth", "text", "locals").orderBy("depth")


@command
def thread_details(snap: Snapshot, threads: DataFrame, frames: DataFrame, dom: graph.Dominance) -> DataFrame:
    """(object_id, depth, text, local, name, retained): a row for each local object of each frame of the threads.

    A frame without locals, or a thread without frames, keeps one row with nulls.
    """
    of = threads.select("object_id").distinct().join(frames.withColumnRenamed("thread_id", "object_id"), "object_id", "left")
    rows = of.select("object_id", "depth", "text", F.explode_outer("locals").alias("local"))
    sized = inspections._named(snap, snap.objects).select(F.col("object_id").alias("local"), "name").join(dom.retained(snap.objects).withColumnRenamed("object_id", "local"), "local", "left")
    return rows.join(sized, "local", "left").select("object_id", "depth", "text", "local", "name", "retained")


@command
def linked_queue(snap: Snapshot, heads: DataFrame, following: str = "next", referent: str = "referent") -> DataFrame:
    """(object_id, at, referent) of linked lists walked from their heads until null or a link to itself.

    Chains advance by doubling: after k rounds each entry knows the one 2^k steps on, so a list of n takes log n rounds.
    """
    links = snap.refs.where((F.col("name") == following) & (F.col("src_id") != F.col("dst_id"))).groupBy("src_id").agg(F.min("dst_id").alias("dst_id"))
    jump = materialize(links, "jump")
    reached = materialize(heads.select("object_id", F.lit(0).cast("long").alias("at")), "queue")
    span = 1
    while not jump.isEmpty():
        step = reached.join(jump, F.col("object_id") == F.col("src_id")).select(F.col("dst_id").alias("object_id"), (F.col("at") + span).alias("at"))
        new = step.join(reached.select("object_id"), "object_id", "left_anti")
        if new.isEmpty() and span > 1:
            break
        reached = materialize(reached.union(new).groupBy("object_id").agg(F.min("at").alias("at")), "queue")
        far = jump.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("end"))
        jump = materialize(jump.join(far, "dst_id").where("src_id <> end").select("src_id", F.col("end").alias("dst_id")), "jump")
        span *= 2
    refs = snap.refs.where(F.col("name") == referent).select(F.col("src_id").alias("object_id"), F.col("dst_id").alias("referent"))
    return reached.join(refs, "object_id", "left")


@command
def comparison_report(pairs: Mapping[str, tuple[DataFrame, DataFrame]], keys: Sequence[str], values: Sequence[str]) -> dict[str, DataFrame]:
    """Histogram differences of several queries."""
    return {name: compare.histogram_difference(now, before, keys, values) for name, (before, now) in pairs.items()}
