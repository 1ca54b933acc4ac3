"""Pairing, trees, bounded sizes, dense ids, own aggregates, contents of collections and class trees against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heapspark.operators import aggregates, bounds, class_tree, contents, pairing
from heapspark.plans.snapshot import Snapshot
from heapspark.sources import snapshots

SIDE = "key string, object_id long, class_name string, kind string, address long, own_name string, shallow long, retained long"


def side(spark, rows):
    return spark.createDataFrame(rows, SIDE)


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_duplicates_pair_in_passes(spark):
    first = side(spark, [
        ("k", 1, "C", "instance", 100, "a", 8, 8), ("k", 2, "C", "instance", 200, "b", 8, 8), ("k", 3, "C", "instance", 300, None, 8, 50), ("k", 4, "B[]", "prim_array", 400, None, 900, 900),
        ("k", 5, "C", "instance", 500, None, 8, 8), ("k", 6, "C", "instance", 600, "same", 8, 8), ("k", 7, "C", "instance", 700, "same", 8, 8), ("other", 8, "C", "instance", 800, "z", 8, 8),
    ])
    second = side(spark, [
        ("k", 12, "C", "instance", 1200, "b", 8, 8), ("k", 11, "C", "instance", 1100, "zz", 8, 8), ("k", 1, "C", "instance", 200, "x", 8, 8), ("k", 13, "C", "instance", 1300, None, 8, 50),
        ("k", 14, "B[]", "prim_array", 1400, None, 900, 900), ("k", 16, "C", "instance", 1600, "same", 8, 8), ("k", 17, "D", "instance", 100, "a", 8, 8), (None, 18, "C", "instance", 800, "z", 8, 8),
    ])
    # 2 and 1 share an address; 12, whose name is b, comes too late; 6 and 16 a text; 3 and 13 a retained size; 4 and 14 a large array's
    want = [("k", 0, 2, 1), ("k", 1, 6, 16), ("k", 2, 3, 13), ("k", 3, 4, 14), ("k", None, 1, 11), ("k", None, 5, 12), ("k", None, 7, 17), ("other", None, 8, None), (None, None, None, 18)]
    got = pairs(pairing.paired(first, second, "key"))
    assert got == sorted(want, key=str)
    same = pairs(pairing.paired(first, second, "key", same_snapshot=True))
    assert ("k", 0, 1, 1) in same and sum(r[1] == 0 for r in same) == 1
    assert pairs(pairing.paired(first.where("key = 'none'"), second.where("key = 'none'"), "key")) == []


def test_ranks_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.lit(3000) - F.col("id")).alias("v")).repartition(7)
    got = pairing.ranked(df, [F.col("k")], ["v"]).collect()
    hot = sorted((r.v, r.nth) for r in got if r.k == "hot")
    assert [n for _, n in hot] == list(range(1, 2001)) and {r.nth for r in got if r.k != "hot"} == {1}


def test_trees_meet_below_matched_parents_only(spark):
    schema = "node_id long, parent_id long, key string, n long"
    a = spark.createDataFrame([(1, None, "a", 5), (2, 1, "x", 1), (3, 1, "x", 2), (4, 3, "deep", 7), (5, None, "b", 1), (6, 5, "y", 3)], schema)
    b = spark.createDataFrame([(1, None, "a", 6), (2, 1, "x", 4), (3, 2, "deep", 9), (4, None, "c", 1), (5, 4, "y", 8)], schema)
    got = {(r.level, r.path): (r.n_0, r.n_1) for r in pairing.compare_trees([a, b], "key", ["n"], "DIFF_TO_FIRST").collect()}
    assert got == {
        (0, "a"): (5, 1), (0, "b"): (1, None), (0, "c"): (None, 1), (1, "a/x"): (1, 3), (1, "a/x#2"): (2, None), (1, "b/y"): (3, None), (1, "c/y"): (None, 8),
        (2, "a/x/deep"): (None, 9), (2, "a/x#2/deep"): (7, None),
    }


def test_bounded_sizes(spark):
    rng = random.Random(2)
    marks = [bounds.EXACT, bounds.AT_LEAST, bounds.AT_MOST, bounds.ABOUT]
    rows = [(i, rng.randrange(100), rng.choice(marks), rng.randrange(100), rng.choice(marks)) for i in range(64)]
    df = spark.createDataFrame(rows, "id int, a long, ma string, b long, mb string").withColumns({"x": bounds.bounded(F.col("a"), F.col("ma")), "y": bounds.bounded(F.col("b"), F.col("mb"))})
    span = lambda v, m: {"=": (v, v), ">=": (v, math.inf), "<=": (-math.inf, v), "~": (-math.inf, math.inf)}[m]
    name = lambda lo, hi, v: "=" if lo == hi else ">=" if (lo, hi) == (v, math.inf) else "<=" if (lo, hi) == (-math.inf, v) else "~"
    for r in df.select("a", "ma", "b", "mb", bounds.minus(F.col("x"), F.col("y")).alias("d"), bounds.plus(F.col("x"), F.col("y")).alias("s"), bounds.surely(F.col("x"), ">", 50).alias("above"), bounds.surely(F.col("x"), "<=", 50).alias("below")).collect():
        (al, ah), (bl, bh) = span(r.a, r.ma), span(r.b, r.mb)
        assert tuple(r.d) == (r.a - r.b, name(al - bh, ah - bl, r.a - r.b)) and tuple(r.s) == (r.a + r.b, name(al + bl, ah + bh, r.a + r.b))
        assert r.above == (al > 50) and r.below == (ah <= 50)
    for chosen in (["="], ["=", ">="], ["<=", "="], [">=", "<="], ["~", "="]):
        part = [r for r in rows if r[2] in chosen]
        total = df.where(F.col("ma").isin(chosen)).agg(bounds.total(F.col("x")).alias("t")).first().t
        lo, hi = (sum(span(r[1], r[2])[i] for r in part) for i in (0, 1))
        assert tuple(total) == (sum(r[1] for r in part), name(lo, hi, sum(r[1] for r in part)))
    empty = df.where("id < 0").agg(bounds.total(F.col("x")).alias("t")).first().t
    assert tuple(empty) == (0, "=") and df.limit(1).select(bounds.text(bounds.bounded(F.lit(None).cast("long"))), bounds.text(bounds.bounded(F.lit(3), ">=")), bounds.text(bounds.bounded(F.lit(3)))).first()[:] == (None, ">= 3", "3")


def test_ids_and_addresses_round_trip(spark):
    rng = random.Random(4)
    at = rng.sample(range(10**15), 900)
    snap = Snapshot(
        spark.createDataFrame([(a, 1, 8) for a in at], "object_id long, class_id int, shallow long").repartition(5), None,
        spark.createDataFrame([(rng.choice(at), rng.choice(at), "f") for _ in range(500)] + [(at[0], 5, "gone")], "src_id long, dst_id long, name string"), spark.createDataFrame([(at[1], 2)], "object_id long, type int"),
    )
    dense, ids = snapshots.renumbered(snap)
    want = {a: i for i, a in enumerate(sorted(at))}
    assert {r.address: r.object_id for r in ids.collect()} == want
    back = snapshots.to_addresses(snapshots.to_ids(snap.objects.select(F.col("object_id").alias("address")), ids).select("object_id", F.col("address").alias("own")), ids)
    assert back.where("address = own").count() == 900
    assert sorted(tuple(r) for r in dense.refs.collect()) == sorted((want[r.src_id], want[r.dst_id], r.name) for r in snap.refs.collect() if r.name == "f")
    assert {r.object_id for r in dense.objects.collect()} == set(range(900)) and [tuple(r) for r in dense.roots.collect()] == [(want[at[1]], 2)]
    listed = spark.createDataFrame([(0, at[3]), (1, 7), (2, at[3]), (3, None)], "nth int, address long")
    assert [r.object_id for r in snapshots.to_ids(listed, ids).orderBy("nth").collect()] == [want[at[3]], None, want[at[3]], None]


def test_own_aggregates(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.uniform(1, 9)])) for _ in range(3000)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(6)
    groups = defaultdict(list)
    for k, j, v in rows:
        groups[k, j] += [v] if v is not None else []
    for held in (aggregates.HELD, 1):
        monkeypatch.setattr(aggregates, "HELD", held)
        got = {(r.k, r.j): r.x for r in aggregates.aggregate(df, ["k", "j"], "v", "DEVIATION", "x").collect()}
        assert set(got) == set(groups) and got["none", 1] is None
        assert all(math.isclose(got[g], float(np.std(v)), rel_tol=1e-9) for g, v in groups.items() if v)
    if "TEST_SPAN" not in aggregates.AGGREGATES:
        aggregates.register("TEST_SPAN", aggregates.Aggregate(lambda x: [x.min(), x.max()], lambda s: [s[:, 0].min(), s[:, 1].max()], lambda s: s[1] - s[0]))
    got = {(r.k, r.j): r.x for r in aggregates.aggregate(df, ["k", "j"], "v", "TEST_SPAN", "x").collect()}
    assert all(math.isclose(got[g], max(v) - min(v)) for g, v in groups.items() if v)
    assert aggregates.aggregate(df.where("j = 9"), ["k"], "v", "MIDRANGE", "x").collect() == []
    plan = aggregates.aggregate(df, ["k"], "v", "MIDRANGE", "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # states are shuffled, not rows
    with pytest.raises(ValueError):
        aggregates.aggregate(df, ["k"], "v", "NONE", "x")
    with pytest.raises(ValueError):
        aggregates.register("DEVIATION", aggregates.AGGREGATES["MIDRANGE"])


def collections_snap(spark, refs, objects):
    classes = [(1, "java.lang.Object", None), (2, "java.util.LinkedList", 1), (3, "my.Tasks", 2), (4, "java.util.HashMap", 1), (5, "java.util.LinkedHashMap", 4), (6, "java.util.TreeMap", 1), (7, "java.util.ArrayList", 1), (8, "java.util.HashSet", 1), (9, "my.Other", 1)]
    return Snapshot(
        spark.createDataFrame(objects, "object_id long, class_id int, shallow long"), spark.createDataFrame(classes, "class_id int, name string, super_id int").withColumns({"loader_id": F.lit(0), "instance_size": F.lit(8)}),
        spark.createDataFrame(refs, "src_id long, dst_id long, name string"), None,
    )


def test_contents_of_collections(spark):
    rng = random.Random(7)
    refs, objects, want, fresh = [], [], [], iter(range(1000, 10**6))
    for _ in range(6):  # lists, one of a subclass, one circular, one empty
        n, owner = rng.choice([0, 1, 2, 9, 40]), next(fresh)
        nodes = [next(fresh) for _ in range(n)]
        objects.append((owner, rng.choice([2, 3]), 8))
        refs += [(owner, nodes[0], "first")] if n else []
        refs += [(a, b, "next") for a, b in zip(nodes, nodes[1:] + nodes[:1]) if a != b]
        for i, x in enumerate(nodes):
            item = rng.choice([None, next(fresh)])
            refs += [(x, item, "item")] if item else []
            want.append((owner, "chain", None, i, None, item))
    for cls in (4, 5, 8):
        owner, inner, array = next(fresh), next(fresh), next(fresh)
        objects.append((owner, cls, 8))
        refs += [(owner, inner, "map"), (inner, array, "table")] if cls == 8 else [(owner, array, "table")]
        for b in (0, 3, 12):
            last = None
            for place in range(rng.choice([1, 2, 5])):
                entry, key, value = next(fresh), next(fresh), next(fresh)
                refs += [(array, entry, f"[{b}]") if last is None else (last, entry, "next"), (entry, key, "key"), (entry, value, "value")]
                want.append((owner, "map", b, place, key, None if cls == 8 else value))
                last = entry
    for n in (1, 25):  # random search trees
        owner, keys = next(fresh), rng.sample(range(10**7, 10**8), n)
        objects.append((owner, 6, 8))
        entry = {k: next(fresh) for k in keys}
        root = keys[0]
        refs += [(owner, entry[root], "root")] + [(entry[k], k, "key") for k in keys]
        kids = {}
        for k in keys[1:]:
            x = root
            while True:
                name = "left" if k < x else "right"
                if (x, name) not in kids:
                    kids[x, name] = k
                    refs.append((entry[x], entry[k], name))
                    refs.append((entry[k], entry[x], "parent"))
                    break
                x = kids[x, name]
        want += [(owner, "tree", None, i, k, None) for i, k in enumerate(sorted(keys))]
    owner, array = next(fresh), next(fresh)
    objects += [(owner, 7, 8), (next(fresh), 9, 8)]
    refs += [(owner, array, "elementData"), (array, 77, "[0]"), (array, 78, "[10]"), (array, 5, "<class>")]
    want += [(owner, "array", None, 0, None, 77), (owner, "array", None, 10, None, 78)]
    snap = collections_snap(spark, refs, objects)
    assert pairs(contents.collection_contents(snap).select("object_id", "kind", "bucket", "place", "key", "value")) == sorted(want, key=str)
    one = objects[0][0]
    assert pairs(contents.collection_contents(snap, spark.createDataFrame([(one,)], "object_id long"))) == sorted((w for w in want if w[0] == one), key=str)
    assert contents.collection_contents(snap, spark.createDataFrame([(objects[-1][0],)], "object_id long")).collect() == []


def brute_class_tree(refs, cls, ids, levels):
    out, todo = {}, [((), sorted(set(ids)), ())]
    for level in range(levels + 1):
        new = []
        for path, near, above in todo:
            by = defaultdict(set)
            for i in near:
                by[cls[i]].add(i)
            for c, objs in by.items():
                seen = {i for i in objs if any(k == c and i in s for k, s in above)}
                kind = "NEW" if not level or not seen else "OLD" if seen == objs else "MIXED"
                out[level, ">".join([*path, c])] = (len(objs), kind)
                new.append(((*path, c), {b for a, b, _ in refs if a in objs}, (*above, (c, objs))))
        todo = new
    return out


def test_class_trees(spark):
    rng = random.Random(12)
    n = 30
    refs = [(rng.randrange(n), rng.randrange(n), rng.choice("fg")) for _ in range(70)]
    cls = {i: f"c.C{1 + i % 3}" for i in range(n)}
    snap = Snapshot(
        spark.createDataFrame([(i, 1 + i % 3, 8) for i in range(n)], "object_id long, class_id int, shallow long"), spark.createDataFrame([(k, f"c.C{k}") for k in (1, 2, 3)], "class_id int, name string"),
        spark.createDataFrame(refs, "src_id long, dst_id long, name string"), None,
    )
    for inbound in (False, True):
        df = class_tree.class_reference_tree(snap, spark.createDataFrame([(1,), (4,), (5,)], "object_id long"), 3, inbound)
        got = {(r.level, r.path): (r.objects, r.type) for r in df.collect()}
        assert got == brute_class_tree([(b, a, f) for a, b, f in refs] if inbound else refs, cls, [1, 4, 5], 3)


def test_a_later_session_reads_the_index(spark, tmp_path, monkeypatch):
    """Parts stay under the folder that is named; what was built once is read, not built again, until the source changes."""
    def build(s, folder):
        n = s.read.parquet(f"{folder}/n.parquet").first()[0]
        refs = spark.range(1, n).selectExpr("id - 1 as src_id", "id as dst_id", "'f' as name")
        return Snapshot(spark.range(n).selectExpr("id as object_id", "1 as class_id", "8L as shallow"), None, refs, spark.createDataFrame([(0, 2)], "object_id long, type int"))

    spark.createDataFrame([(5,)], "n long").write.parquet(f"{tmp_path}/in/n.parquet")
    keep = f"file://{tmp_path}/keep"
    first = snapshots.indexed(spark, f"{tmp_path}/in", build, keep)
    assert first.retained.where("object_id = 1").first()["retained"] == 32
    snapshots._INDEXED.clear()  # as in another session
    with monkeypatch.context() as m:
        m.setattr(snapshots.graph, "dominance", None)
        m.setattr(snapshots, "breadth_first", None)
        again = snapshots.indexed(spark, f"{tmp_path}/in", build, keep)
        assert again is not first and again.retained.count() == 5 and again.tree.count() == 5 and again.dominance.nodes.count() == 5 and again.edges.count() == 4
    spark.createDataFrame([(7,)], "n long").write.mode("overwrite").parquet(f"{tmp_path}/in/n.parquet")
    assert snapshots.indexed(spark, f"{tmp_path}/in", build, keep).tree.count() == 7
    assert not (tmp_path / "keep" / "gone").exists() and len(list((tmp_path / "keep").iterdir())) == 1  # the old one is removed


def test_scans_of_ids_fields_and_objects(spark):
    from heapspark.operators import scans

    classes = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "D", None)], "class_id int, name string, super_id int")
    statics = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (1, "y", 5), (4, "x", None)], "class_id int, name string, value long")
    assert {r.class_id: r.value for r in scans.static_field(classes, statics, "x").collect()} == {1: 10, 2: 20, 3: 20, 4: None}
    snap = Snapshot(spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "object_id long, class_id int"), classes, None, None)
    assert sorted(r.object_id for r in scans.extent_of_ids(snap, [2, 4, 2]).collect()) == [11, 12]
    with pytest.raises(ValueError):
        scans.extent_of_ids(snap, [2, 99])
    df = spark.createDataFrame([([1, None, 2], 3, "t"), ([], None, "t"), (None, 0, "t")], "xs array<long>, x long, s string")
    assert sorted(r.object_id for r in scans.objects_of(df, "xs").collect()) == [1, 2] and sorted(r.object_id for r in scans.objects_of(df, "x").collect()) == [0, 3]
    ids = spark.createDataFrame([(70, 1), (71, 3), (72, 0)], "object_id long, address long")
    assert [r.object_id for r in scans.objects_of(df, "xs", ids).collect()] == [70] and [r.object_id for r in scans.objects_of(df, "x", ids).collect()] == [71]
    with pytest.raises(ValueError):
        scans.objects_of(df, "s")


def test_waste_needs_texts_only(spark):
    from heapspark.operators import inspections

    rows = [
        (1, 100, True, 0, 10), (2, 100, True, 0, 10), (2, 100, False, None, None), (3, 100, True, 0, 80), (3, 100, True, 0, 10), (4, 40, True, 0, 1), (5, 100, True, None, None),
        (6, 100, True, 0, 30), (6, 100, True, 20, 30), (6, 100, True, 60, 5), (7, 100, True, 0, 30), (7, 100, True, 10, 15), (8, 100, True, 0, 50), (9, 100, None, 0, 5),
    ]
    df = spark.createDataFrame(rows, "array_id long, length long, is_text boolean, first long, size long")
    assert {r.array_id: (r.used, r.waste) for r in inspections.waste_by_referrers(df, 50).collect()} == {1: (10, 90), 7: (30, 70), 8: (50, 50)}
