"""What the index holds with its dominators, so that queries on it neither join nor write whole tables; rows as from plain tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from heapspark.operators import graph, inspections
from heapspark.plans import snapshot as snap
from heapspark.plans.snapshot import Snapshot
from heapspark.sources import snapshots

CLASSES = [(k, f"p{k % 2}.C{k}", None, k % 3, 8) for k in range(4)]


def random_snapshot(spark, seed, n, back):
    """Objects in falling layers, some edges leading back, one target that is no object, a class without a size."""
    random.seed(seed)
    refs = {(random.randrange(b), b) for b in range(3, n) for _ in range(random.choice([1, 1, 2, 3]))} | {(b, random.randrange(b)) for b in random.sample(range(3, n), back)} | {(1, n + 5)}
    objects = spark.createDataFrame([(k, random.randrange(4), f"l{k}", None if k % 7 == 3 else random.randrange(1, 50)) for k in range(n + 3)], "object_id long, class_id int, label string, shallow long")
    classes = spark.createDataFrame(CLASSES, "class_id int, name string, super_id int, loader_id int, instance_size long")
    edges = spark.createDataFrame([(a, b, "f") for a, b in refs], "src_id long, dst_id long, name string")
    return Snapshot(objects, classes, edges, spark.createDataFrame([(k, 2) for k in range(3)], "object_id long, type int"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_circle_above_layers(spark):
    """0 leads to the circle 1, 2, 3 and to 4; leaves hang below; 7 and 9 have two sources each."""
    refs = [(0, 1), (1, 2), (2, 3), (3, 1), (2, 5), (3, 6), (5, 7), (2, 9), (4, 9), (0, 4), (3, 7)]
    objects = spark.createDataFrame([(k, k % 3, k + 1) for k in range(12)], "object_id long, class_id int, shallow long")
    edges, roots = spark.createDataFrame(refs, "src_id long, dst_id long"), spark.createDataFrame([(0,)], "object_id long")
    dom = graph.dominators_of(graph.solved(edges, roots, objects), objects)
    assert rows(dom.retained(objects)) == [(0, 46), (1, 30), (2, 28), (3, 11), (4, 5), (5, 6), (6, 7), (7, 8), (9, 10)]
    assert rows(dom.class_sizes(objects, objects.select("class_id").distinct())) == [(0, 46), (1, 35), (2, 28)]
    members = dom.rows.where("object_id in (3, 6, 7, 9)").select("object_id", "parent_id", "layer", F.lit("x").alias("name"))
    assert rows(dom.passing(members)) == [(0, "x", 4, 0), (1, "x", 3, 1), (2, "x", 3, 2), (3, "x", 2, 3), (4, "x", 1, 1)]


def test_queries_on_the_index_write_no_sizes(spark, monkeypatch):
    shop = random_snapshot(spark, 4, 20, 0)
    dom = graph.dominators_of(graph.solved(shop.refs, shop.roots, shop.objects), shop.objects)
    names, materialize = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name, *a, **k: names.append(name) or materialize(df, name, *a, **k))
    inspections.leakhunter(shop, dom, None, 6.0).collect()
    inspections.retained_by_class(shop, dom).collect()
    assert "sized" not in names and "members" not in names and "level" not in names
    again = len(names)
    dom.retained(shop.objects).collect()
    assert len(names) == again  # the table stays


def test_index_of_the_shop_writes_lines_once(spark, sf, monkeypatch):
    names, materialize = [], snapshots.materialize
    monkeypatch.setattr(snapshots, "materialize", lambda df, name, *a, **k: names.append(name) or materialize(df, name, *a, **k))
    at = snapshots.Indexed(spark, lambda *written: snap.shop(spark, sf, *written), names_parts=True)
    plain = snap.shop(spark, sf)
    count = lambda x: (x.objects.agg(F.count("*"), F.bit_xor("object_id"), F.sum("shallow"), F.count("label")).first(), x.refs.agg(F.count("*"), F.bit_xor("src_id"), F.bit_xor("dst_id")).first())
    assert count(at.snap) == count(plain) and names == ["lines"]
    assert "Aggregate" not in at.snap.refs._jdf.queryExecution().optimizedPlan().toString()
    at.drop()


def test_lines_of_an_order_stay_together_and_those_without_are_dealt(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    lone = rows.withColumn("l_orderkey", F.lit(None).cast(rows.schema["l_orderkey"].dataType))
    rows.unionByName(rows.limit(100)).unionByName(lone).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = snap.lines(spark, str(tmp_path))
        at = lines.withColumn("at", F.spark_partition_id())
        parts = {r[0]: r[1] for r in at.groupBy("l_orderkey").agg(F.countDistinct("at")).collect()}
        files = at.agg(F.countDistinct("at")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files > 1 and parts.pop(None) == files and set(parts.values()) == {1}
    assert lines.columns == ["object_id", "l_orderkey", "l_suppkey", "l_returnflag"]
    assert lines.count() == rows.distinct().count() + lone.distinct().count() == lines.select("object_id").distinct().count()
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
