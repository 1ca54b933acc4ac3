"""Inspections put together from others, on small graphs."""

import pytest
from pyspark.sql import functions as F

from heapspark.operators import graph, inspections, reports, scans
from heapspark.plans.snapshot import Snapshot


@pytest.fixture(scope="module")
def snap(spark):
    objects = spark.createDataFrame([(i, 1 + i % 2, f"o{i % 2}", 8) for i in range(12)], "object_id long, class_id int, label string, shallow long")
    classes = spark.createDataFrame([(1, "a.A", None, 0, 8), (2, "a.B", 1, 1, 8)], "class_id int, name string, super_id int, loader_id int, instance_size long")
    edges = [(0, 1, "f"), (0, 2, "f"), (1, 3, "f"), (2, 3, "f"), (3, 4, "next"), (4, 5, "next"), (5, 6, "next"), (6, 7, "next"), (7, 7, "next"), (4, 8, "referent"), (4, 9, "own"), (9, 8, "f"), (0, 10, "f"), (10, 11, "referent")]
    refs = spark.createDataFrame(edges, "src_id long, dst_id long, name string")
    return Snapshot(objects, classes, refs, spark.createDataFrame([(0, 2)], "object_id long, type int"))


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "object_id long")


def test_paths(spark, snap):
    got = [(r["path"], r["length"]) for r in reports.path2gc(snap, 4).collect()]
    assert got == [([0, 1, 3, 4], 4), ([0, 2, 3, 4], 4)]
    assert reports.path2gc(snap, 4, paths=1).count() == 1


def test_paths_past_many_referrers(spark, snap):
    """Only the greatest of 400 referrers is reached from a root; the others lead nowhere."""
    edges = [(i, 1, "f") for i in range(100, 500)] + [(i + 1000, i, "f") for i in range(100, 499)] + [(0, 499, "f")]
    wide = Snapshot(snap.objects, snap.classes, spark.createDataFrame(edges, "src_id long, dst_id long, name string"), snap.roots)
    assert [r["path"] for r in reports.path2gc(wide, 1).collect()] == [[0, 499, 1]]


def test_linked_queue(spark, snap):
    got = sorted((r["object_id"], r["at"], r["referent"]) for r in reports.linked_queue(snap, ids(spark, 3)).collect())
    assert got == [(3, 0, None), (4, 1, 8), (5, 2, None), (6, 3, None), (7, 4, None)]


def test_reference_leak(spark, snap):
    got = {(r["reference"], r["referent"]) for r in reports.reference_leak(snap, ids(spark, 4, 10)).collect()}
    assert got == {(4, 8)}


def test_growth_and_threads(spark, snap):
    dom = graph.dominance(snap.refs, snap.roots)
    bigger = Snapshot(snap.objects.withColumn("shallow", F.col("shallow") * 3), snap.classes, snap.refs, snap.roots)
    got = [(r["kind"], r["object_id"], r["growth"]) for r in reports.find_leaks2(snap, bigger, dom, dom).collect()]
    assert got == [("object", 0, 12 * 16)]
    frames = spark.createDataFrame([(3, 0, "run", [4, 5]), (3, 1, "main", [])], "thread_id long, depth int, text string, locals array<long>")
    row = reports.thread_overview(snap, ids(spark, 3), frames, dom).first()
    assert (row["retained"], row["frames"], row["locals"]) == (7 * 8, 2, 2)
    assert [r["text"] for r in reports.thread_stack(frames, 3).collect()] == ["run", "main"]
    assert reports.component_report_top(snap, dom).count() == 1
    assert reports.show_dominator_tree(snap, dom, ids(spark, 3, 5, 10)).count() == 2


def test_lists_and_components(spark, snap):
    assert {(r["name"], r["neighbour"]) for r in reports.list_objects(snap, ids(spark, 4)).collect()} == {("next", 5), ("referent", 8), ("own", 9)}
    assert {r["neighbour"] for r in reports.list_objects(snap, ids(spark, 3), inbound=True).collect()} == {1, 2}
    parts = reports.component_report(snap, ids(spark, 4), F.col("name") == "referent")
    assert sum(r["objects"] for r in parts["histogram"].collect()) == 6
    cmp = reports.simplecomparison(inspections.histogram, snap, snap, "name", ["objects"], "DIFF_TO_FIRST").collect()
    assert {r["objects_1"] for r in cmp} == {0}
    diff = reports.comparison_report({"h": (inspections.histogram(snap), inspections.histogram(snap))}, ["name"], ["objects"])
    assert {r["objects"] for r in diff["h"].collect()} == {0}
    fill = reports.collection_fill_ratio(spark.createDataFrame([(1, 4), (4, 4), (0, 0)], "n long, cap long"), F.col("n"), F.col("cap"))
    assert sum(r["collections"] for r in fill.collect()) == 3


def test_names(spark, snap):
    reports.name_resolver("a.A")(lambda df: F.concat(F.lit("#"), F.col("label")))
    named = snap.objects.join(snap.classes, "class_id")
    assert {r[0] for r in named.select(reports.resolved_name(named)).collect()} == {"#o0", ""}


def test_path_trees(spark, snap):
    """Paths of 4 and 8 (least parents: 0-1-3-4, 0-1-3-4-8) and of 6; classes alternate with ids, 3 and 1 are of one class."""
    tree = graph.breadth_first(snap.refs, snap.roots)
    wanted = ids(spark, 4, 4, 8, 99)

    def got(group_by):
        return {(r["level"], r["path"], r["on_path"], r["referenced"]) for r in inspections.grouped_paths(snap, tree, wanted, group_by).collect()}

    assert got("FROM_GC_ROOTS") == {(0, "0", 1, 2), (1, "1", 1, 2), (2, "3", 1, 2), (3, "4", 1, 2), (4, "8", 1, 1)}
    a, b = "a.A", "a.B"
    assert got("FROM_GC_ROOTS_BY_CLASS") == {(0, a, 1, 2), (1, f"{a}>{b}", 1, 2), (2, f"{a}>{b}>{b}", 1, 2), (3, f"{a}>{b}>{b}>{a}", 1, 2), (4, f"{a}>{b}>{b}>{a}>{a}", 1, 1)}
    assert (0, a, 2, 2) in got("FROM_OBJECTS_BY_CLASS") and (1, f"{a}>{b}", 1, 1) in got("FROM_OBJECTS_BY_CLASS") and (1, f"{a}>{a}", 1, 1) in got("FROM_OBJECTS_BY_CLASS")
    with pytest.raises(ValueError):
        got("BY_NOTHING")


def test_object_sets(spark, snap):
    def got(**kwargs):
        return {r["object_id"] for r in scans.object_set(snap, snap.classes.where("name = 'a.A'"), **kwargs).collect()}

    even = set(range(0, 12, 2))
    assert got() == even and got(include_subclasses=True) == set(range(12)) and got(include_loaded_instances=True) == even
    assert got(ids=ids(spark, 3, 4)) == even | {3}
    assert scans.object_set(snap, snap.classes.where("name = 'none'"), ids=ids(spark, 4), retained=True).select("object_id").distinct().count() == 6
    rows = scans.implements(snap, snap.objects, "a.A").collect()
    assert all(r["implements"] for r in rows) and len(rows) == 12
    assert {r["object_id"] for r in scans.implements(snap, snap.objects, "a.B").collect() if r["implements"]} == set(range(1, 12, 2))
    assert scans.extent_of(snap, spark.createDataFrame([(2,), (None,), (2,)], "class_id int")).count() == 6


def test_dominated_threads_and_suspects(spark, snap):
    dom = graph.dominance(snap.refs, snap.roots)
    assert {(r["object_id"], r["retained"]) for r in inspections.immediate_dominated(snap, dom, ids(spark, 0, 0)).collect()} == {(1, 8), (2, 8), (3, 56), (10, 16)}
    frames = spark.createDataFrame([(3, 0, "run", [4, 5]), (3, 1, "main", [])], "thread_id long, depth int, text string, locals array<long>")
    got = {tuple(r) for r in reports.thread_details(snap, ids(spark, 3, 7), frames, dom).collect()}
    assert got == {(3, 0, "run", 4, "a.A", 48), (3, 0, "run", 5, "a.B", 24), (3, 1, "main", None, None, None), (7, None, None, None, None, None)}
    row = inspections.leakhunter(snap, dom, graph.breadth_first(snap.refs, snap.roots), 20.0, ratio=0.5).collect()
    # 0 keeps 96, then 3 56, 4 48, 5 24, 6 16 and 7 8: each half or more of the one before
    assert [(r["kind"], r["object_id"], r["point"], r["point_name"]) for r in row] == [("object", 0, 7, "a.B")]


def test_group_suspects_meet_at_an_object(spark, snap):
    """Roots 0 and 1 both hold 2 to 11, and 2 lies on the least shortest paths of most of them."""
    edges = [(r, x, "f") for r in (0, 1) for x in (2, 3)] + [(2, x, "f") for x in range(4, 12)] + [(3, x, "f") for x in range(4, 12)]
    shared = Snapshot(snap.objects, snap.classes, spark.createDataFrame(edges, "src_id long, dst_id long, name string"), ids(spark, 0, 1).withColumn("type", F.lit(2)))
    dom, tree = graph.dominance(shared.refs, shared.roots), graph.breadth_first(shared.refs, shared.roots)
    got = {r["name"]: (r["objects"], r["point"]) for r in inspections.leakhunter(shared, dom, tree, 20.0, common=0.6).collect()}
    assert got == {"a.A": (6, 2), "a.B": (6, 2)}


@pytest.mark.parametrize("sizes", [[1] * 20, [1, 1, 1, 200] + [1] * 16, [500] + [1] * 19, [1] * 10 + [90] * 10])
def test_descents_of_a_chain(spark, snap, sizes):
    """A chain of 20 with a leaf beside each link: descents by doubling end where a walk step by step ends."""
    n = len(sizes)
    nodes = [(i, i - 1 if i else None, i + 1, 2 * i, 2 * n) for i in range(n)] + [(100 + i, i, i + 2, 2 * i + 1, 2 * i + 2) for i in range(n)]
    dom = graph.Dominance(spark.createDataFrame(nodes, "object_id long, dominator_id long, depth long, enter long, leave long"))
    objects = spark.createDataFrame([*enumerate(sizes), *[(100 + i, 2) for i in range(n)]], "object_id long, shallow long")
    chain = Snapshot(objects, snap.classes, snap.refs, snap.roots)
    kept = [sum(sizes[i:]) + 2 * (n - i) for i in range(n)]

    def walk(i, most):
        for _ in range(most):
            if i >= 100:
                return i
            below = max((kept[i + 1], -i - 1), (2, -100 - i)) if i + 1 < n else (2, -100 - i)
            if below[0] < 0.7 * kept[i]:
                return i
            i = -below[1]
        return None

    for most in (1000, 8, 3, 1):
        got = {r["object_id"]: r["point"] for r in inspections.accumulation_point(chain, dom, ids(spark, *range(n), 105, 999), max_depth=most).collect()}
        assert got == {i: walk(i, most) for i in [*range(n), 105]}
