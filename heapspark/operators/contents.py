"""Contents of collections, read from the object graph by rules that hold along the class hierarchy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.snapshot import Snapshot, class_ancestors
from ..plans.store import materialize
from . import graph
from .forest import Forest
from .inspections import command


@dataclass(frozen=True)
class Rule:
    """How a class and its subclasses hold their contents.

    array: the object at `entry` has elements [0], [1], ...  chain: entries from `entry` on follow each other by
    `following`.  map: the object at `entry` has buckets [0], [1], ..., each a chain of entries.  tree: entries below
    the one at `entry`, the lesser to the `left` and the greater to the `following`.  Entries have `key` and `value`.
    entry may go over several fields, as in map.table.
    """

    class_name: str
    kind: str
    entry: str
    following: str = "next"
    left: str = "left"
    key: str = ""
    value: str = ""


# Public field names of the Java collections.
RULES = (
    Rule("java.util.ArrayList", "array", "elementData"), Rule("java.util.Vector", "array", "elementData"), Rule("java.util.PriorityQueue", "array", "queue"),
    Rule("java.util.concurrent.CopyOnWriteArrayList", "array", "array"), Rule("java.util.Arrays$ArrayList", "array", "a"),
    Rule("java.util.LinkedList", "chain", "first", value="item"), Rule("java.util.concurrent.LinkedBlockingDeque", "chain", "first", value="item"),
    Rule("java.util.concurrent.LinkedBlockingQueue", "chain", "head.next", value="item"), Rule("java.util.concurrent.ConcurrentLinkedQueue", "chain", "head", value="item"),
    Rule("java.util.HashMap", "map", "table", key="key", value="value"), Rule("java.util.Hashtable", "map", "table", key="key", value="value"),
    Rule("java.util.HashSet", "map", "map.table", key="key"), Rule("java.util.concurrent.ConcurrentHashMap", "map", "table", key="key", value="val"),
    Rule("java.util.TreeMap", "tree", "root", following="right", key="key", value="value"), Rule("java.util.TreeSet", "tree", "m.root", following="right", key="key"),
)


def rules_of(snap: Snapshot, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(class_id, rule): the number of the rule of the nearest class at or above each one that has any."""
    names = F.broadcast(snap.classes.sparkSession.createDataFrame([(i, r.class_name) for i, r in enumerate(rules)], "rule int, name string"))
    ruled = snap.classes.join(names, "name").select(F.col("class_id").alias("ancestor_id"), "rule")
    return class_ancestors(snap.classes).join(ruled, "ancestor_id").groupBy("class_id").agg(F.min_by("rule", "distance").alias("rule"))


def _field(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("name") == name).select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"))


def _elements(refs: DataFrame) -> DataFrame:
    """(at, place, to) of array elements: references named [i]."""
    place = F.regexp_extract("name", r"^\[(\d+)\]$", 1)
    return refs.select(F.col("src_id").alias("at"), F.when(place != "", place.cast("long")).alias("place"), F.col("dst_id").alias("to")).where("place is not null")


def _chained(refs: DataFrame, heads: DataFrame, rule: Rule) -> DataFrame:
    """(head, place, entry) of chains; doubling, so a chain of n takes log n rounds, and circles end where they close."""
    edges = refs.where(F.col("name") == rule.following).select("src_id", "dst_id")
    tree = graph.breadth_first(edges, heads)
    forest = Forest(tree.select("object_id", "parent_id"), tree.select("object_id", "depth"))
    rows = tree.select("object_id", F.col("object_id").alias("head"), F.col("depth").cast("long").alias("place"))
    for level in reversed(forest.levels):
        up = level.select(F.col("object_id").alias("head"), "up")
        rows = rows.join(up, "head", "left").select("object_id", F.coalesce("up", "head").alias("head"), "place")
    out = materialize(rows.select("head", "place", F.col("object_id").alias("entry")), "chain")
    forest.drop()
    return out


def _in_order(refs: DataFrame, heads: DataFrame, rule: Rule) -> DataFrame:
    """(head, place, entry) of binary trees, by in-order: what lies to the left of an entry and of each turn right above it."""
    sides = refs.where(F.col("name").isin(rule.left, rule.following)).select("src_id", "dst_id", (F.col("name") == rule.left).alias("lesser"))
    tree = graph.breadth_first(sides.select("src_id", "dst_id"), heads)
    forest = Forest(tree.select("object_id", "parent_id"), tree.select("object_id", "depth"))
    size = forest.subtree_sums(tree.select("object_id", F.lit(1).cast("long").alias("size")), "size")
    side = sides.select(F.col("src_id").alias("parent_id"), F.col("dst_id").alias("object_id"), "lesser").join(tree.select("object_id", "parent_id"), ["object_id", "parent_id"])
    left = side.where("lesser").join(size, "object_id").groupBy("parent_id").agg(F.max("size").alias("before"))
    own = tree.select("object_id").join(left.withColumnRenamed("parent_id", "object_id"), "object_id", "left").select("object_id", F.coalesce("before", F.lit(0)).alias("before"))
    turn = side.where("not lesser").join(own.withColumnRenamed("object_id", "parent_id"), "parent_id").select("object_id", (F.col("before") + 1).alias("turn"))
    base = materialize(own.join(turn, "object_id", "left").select("object_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn")), "turns")
    turns = forest.path_sums(base, ["turn"])
    rows = turns.join(own, "object_id").select("object_id", F.col("object_id").alias("head"), (F.col("turn") + F.col("before")).alias("place"))
    for level in reversed(forest.levels):
        up = level.select(F.col("object_id").alias("head"), "up")
        rows = rows.join(up, "head", "left").select("object_id", F.coalesce("up", "head").alias("head"), "place")
    out = materialize(rows.select("head", "place", F.col("object_id").alias("entry")), "in-order")
    forest.drop()
    return out


@command
def collection_contents(snap: Snapshot, ids: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(object_id, kind, bucket, place, key, value): a row for each entry of the collections that a rule covers.

    place counts from 0: the index in an array, the place in a chain (bucket: which), the in-order place in a tree.
    key and value are objects; null where the field is.  Objects without contents have no row.
    """
    objects = snap.objects if ids is None else snap.objects.join(ids.select("object_id").distinct(), "object_id", "left_semi")
    ruled = materialize(objects.select("object_id", "class_id").join(F.broadcast(rules_of(snap, rules)), "class_id").select("object_id", "rule"), "ruled")  # one row a class
    used = {r.rule for r in ruled.select("rule").distinct().collect()}  # one of the rules each
    refs, out = snap.refs, []
    none = F.lit(None).cast("long")
    for number in sorted(used):
        rule = rules[number]
        held = ruled.where(F.col("rule") == number).select("object_id", F.col("object_id").alias("at"))
        for name in rule.entry.split("."):
            held = held.join(_field(refs, name), "at").select("object_id", F.col("to").alias("at"))
        if rule.kind == "array":
            rows = held.join(_elements(refs), "at").select("object_id", none.alias("bucket"), "place", none.alias("key"), F.col("to").alias("value"))
        else:
            if rule.kind == "map":
                heads = held.join(_elements(refs), "at").select("object_id", F.col("place").alias("bucket"), F.col("to").alias("head"))
            else:
                heads = held.select("object_id", none.alias("bucket"), F.col("at").alias("head"))
            heads = materialize(heads, "heads")
            follow = _in_order if rule.kind == "tree" else _chained
            entries = heads.join(follow(refs, heads.select(F.col("head").alias("object_id")), rule), "head")
            for column, name in (("key", rule.key), ("value", rule.value)):
                to = _field(refs, name).select(F.col("at").alias("entry"), F.col("to").alias(column)) if name else None
                entries = entries.join(to, "entry", "left") if to is not None else entries.withColumn(column, none)
            rows = entries.select("object_id", "bucket", "place", "key", "value")
        out.append(rows.withColumn("kind", F.lit(rule.kind)))
    if not out:
        return snap.objects.sparkSession.createDataFrame([], "object_id long, kind string, bucket long, place long, key long, value long")
    return reduce(DataFrame.unionByName, out).select("object_id", "kind", "bucket", "place", "key", "value")
