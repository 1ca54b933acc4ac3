"""References by class as a tree: what a set refers to, by class, what those refer to, and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.snapshot import Snapshot
from ..plans.store import counted, materialize
from .inspections import command


@command
def class_reference_tree(snap: Snapshot, ids: DataFrame, levels: int = 2, inbound: bool = False) -> DataFrame:
    """(level, path, name, objects, shallow, type): ids by class, and below each class its neighbours by class.

    Each node is a set of different objects.  type: OLD where all of them lie in nodes of their class further up the
    branch, MIXED where some do, NEW else.  A level is one join of (branch, object) rows with the references.
    """
    near, far = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
    refs = snap.refs.select(F.col(near).alias("object_id"), F.col(far).alias("to")).distinct()
    of = snap.objects.select("object_id", "class_id", "shallow")
    start = ids.select("object_id").distinct().join(of, "object_id")
    named = F.broadcast(snap.classes.select("class_id", "name"))
    # anc_i: the branch's node on level i
    now = materialize(start.select(F.xxhash64("class_id").alias("anc_0"), "class_id", "object_id", "shallow", F.lit(False).alias("seen")), "class-level")
    tables, texts, out = [now], None, []
    for level in range(levels + 1):
        branch = f"anc_{level}"
        groups = now.groupBy(branch, "class_id", *([f"anc_{level - 1}"] if level else [])).agg(F.count(F.lit(1)).alias("objects"), F.sum("shallow").cast("long").alias("shallow"), F.count_if("seen").alias("known")).join(named, "class_id")
        if texts is not None:
            groups = groups.join(texts, f"anc_{level - 1}")
        path = F.concat("head", F.lit(">"), "name") if texts is not None else F.col("name")
        kind = F.when(F.lit(level > 0) & (F.col("known") == F.col("objects")), "OLD").when(F.col("known") > 0, "MIXED").otherwise("NEW")
        shown = materialize(groups.select(branch, path.alias("head"), "name", "objects", "shallow", kind.alias("type")), "class-groups")
        texts = shown.select(branch, "head")
        out.append(shown.select(F.lit(level).alias("level"), F.col("head").alias("path"), "name", "objects", "shallow", "type"))
        if level == levels:
            break
        above = [f"anc_{i}" for i in range(level + 1)]
        step = now.join(refs, "object_id").select(*above, F.col("to").alias("object_id")).distinct().join(of, "object_id")
        step = step.withColumn(f"anc_{level + 1}", F.xxhash64(branch, "class_id"))
        met = [table.select(f"anc_{i}", "object_id", "class_id", F.lit(True).alias(f"met_{i}")) for i, table in enumerate(tables)]
        for i, t in enumerate(met):
            step = step.join(t, [f"anc_{i}", "object_id", "class_id"], "left")
        seen = reduce(lambda a, b: a | b, [F.coalesce(f"met_{i}", F.lit(False)) for i in range(len(met))])
        now, got = counted(step.select(*above, f"anc_{level + 1}", "class_id", "object_id", "shallow", seen.alias("seen")), "class-level")
        tables.append(now)
        if not got["rows"]:
            break
    return reduce(DataFrame.unionByName, out)
