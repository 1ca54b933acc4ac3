"""Forests, dominators, sources, groups' retained sets and paths against brute force; chains and ladders."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from heapspark.operators import graph, inspections, reports
from heapspark.operators.forest import Forest
from heapspark.plans.order import LEAST, numbered, running
from heapspark.plans.snapshot import Snapshot
from heapspark.plans.store import materialize
from heapspark.sources import snapshots


def edges_df(spark, edges):
    return spark.createDataFrame([(a, b, f) for a, b, f in edges] or [(0, 0, "f")], "src_id long, dst_id long, name string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "object_id long")


def heap(spark, n, edges, roots, sizes=None):
    objects = spark.createDataFrame([(i, 1 + i % 3, (sizes or [10] * n)[i]) for i in range(n)], "object_id long, class_id int, shallow long")
    classes = spark.createDataFrame([(k, f"c.C{k}", None, 1, 8) for k in (1, 2, 3)], "class_id int, name string, super_id int, loader_id int, instance_size long")
    return Snapshot(objects, classes, edges_df(spark, edges), spark.createDataFrame([(r, 2) for r in roots], "object_id long, type int"))


def reach(edges, roots, blocked=()):
    out = defaultdict(list)
    for a, b, *_ in edges:
        out[a].append(b)
    seen, todo = set(), [r for r in roots if r not in blocked]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for b in out[x] if b not in blocked]
    return seen


# --- along an order


@pytest.mark.parametrize("kind", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, kind, inclusive):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([None, rng.randrange(-50, 50)])) for g in range(4) for i in range(rng.choice([1, 3, 400]))]
    rng.shuffle(rows)
    for within in ([], ["g"]):
        df = spark.createDataFrame([(g * 1000 + i, g, v) for g, i, v in rows], "at long, g int, v long").repartition(6)
        got = {r["at"]: r["x"] for r in running(df, ["at"], "v", "x", kind, within, inclusive).collect()}
        zero = 0 if kind == "sum" else LEAST
        state, want = {}, {}
        for g, i, v in sorted(rows):
            key = g if within else 0
            old = state.get(key, zero)
            new = (old + (v or 0)) if kind == "sum" else max(old, LEAST if v is None else v)
            want[g * 1000 + i], state[key] = new if inclusive else old, new
        assert got == want


def test_numbers_are_dense(spark):
    df = spark.range(0, 5000, 3).select(F.col("id").alias("object_id"), F.lit("x").alias("other")).repartition(7)
    rows = numbered(df, ["object_id"], "id").collect()
    assert {r.object_id: r.id for r in rows} == {x: i for i, x in enumerate(range(0, 5000, 3))} and numbered(df.where("object_id < 0"), ["object_id"], "id").collect() == []


# --- forests


def test_forest(spark):
    rng = random.Random(8)
    parent = {i: (rng.randrange(max(0, i - 4), i) if i > 2 else None) for i in range(60)}
    above = {i: [i] for i in parent}
    for i, p in parent.items():
        above[i] += above[p] if p is not None else []
    forest = Forest(materialize(spark.createDataFrame(list(parent.items()), "object_id long, parent_id long"), "test"))
    assert {r.object_id: r.depth for r in forest.depth.collect()} == {i: len(a) - 1 for i, a in above.items()}
    rows = forest.numbered().collect()
    assert sorted(r.enter for r in rows) == list(range(60))
    at = {r.object_id: r for r in rows}
    assert all((at[a].enter <= at[b].enter < at[a].leave) == (a in above[b]) for a in parent for b in parent)
    pairs = spark.createDataFrame(list(itertools.product(range(60), range(0, 60, 7))), "a long, b long")
    for r in forest.nearest_common(pairs).collect():
        assert r.top == next((x for x in above[r.a] if x in above[r.b]), None) and (r.top is None or r.depth == len(above[r.top]) - 1)
    sums = forest.subtree_sums(spark.createDataFrame([(i, i % 2, 1) for i in range(20, 60)], "object_id long, kind int, n long"), "n", ["kind"])
    want = defaultdict(int)
    for i in range(20, 60):
        for a in above[i]:
            want[a, i % 2] += 1
    assert {(r.object_id, r.kind): r.n for r in sums.collect()} == want
    walked = forest.ancestors(ids_df(spark, [7, 59, 59])).collect()
    assert sorted((r.object_id, r.distance, r["at"]) for r in walked) == sorted((i, d, a) for i in (7, 59) for d, a in enumerate(above[i]))


def test_a_chain_of_many_links(spark):
    """Rounds by the logarithm of the depth: shortest paths, dominators and sizes of a list of 100,000 objects."""
    n = 100_000
    refs = spark.range(n - 1).select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("dst_id"))
    roots = ids_df(spark, [0])
    tree = graph.breadth_first(refs, roots)
    assert tree.agg(F.count("*"), F.sum("depth"), F.count_if(F.col("depth") == F.col("object_id"))).first()[:] == (n, n * (n - 1) // 2, n)
    dom = graph.dominance(refs, roots, tree)
    sizes = dom.retained(spark.range(n).select(F.col("id").alias("object_id"), F.lit(2).alias("shallow")))
    assert sizes.where(F.col("retained") != 2 * (n - F.col("object_id"))).count() == 0 and sizes.count() == n


def brute_dominators(n, edges, roots):
    everything = reach(edges, roots)
    return {(b, a) for a in everything for b in everything - reach(edges, roots, {a})}


@pytest.mark.parametrize("kind", ["random", "ladder"])
def test_dominators(spark, kind):
    rng = random.Random(11)
    if kind == "random":
        n = 120
        edges = [(rng.randrange(n), rng.randrange(n), "f") for _ in range(190)] + [(i, i + 1, "f") for i in range(60, 119)]
        roots = [0, 1, 60]
    else:  # two chains that cross at each rung: nothing but the root dominates
        n, roots = 13, [0]
        edges = [(0, 1, "f"), (0, 2, "f")] + [(a, b, "f") for i in range(1, 11, 2) for a in (i, i + 1) for b in (i + 2, i + 3)]
    snap = heap(spark, n, edges, roots)
    dom = graph.dominance(snap.refs, snap.roots)
    rows = [tuple(r) for r in dom.nodes.select("object_id", "enter", "leave").collect()]
    pairs = {(b, a) for a, enter, leave in rows for b, at, _ in rows if enter <= at < leave}
    assert pairs == brute_dominators(n, edges, roots)
    if kind == "random":
        chosen = rng.sample(sorted(reach(edges, roots)), 25)
        groups = [(i % 3, i) for i in chosen]
        got = {tuple(r) for r in dom.outermost(spark.createDataFrame(groups, "group_id long, object_id long")).collect()}
        assert got == {(g, x) for g, x in groups if not any(h == g and y != x and (x, y) in pairs for h, y in groups)}
        assert {r.object_id for r in dom.dominated_set(ids_df(spark, chosen)).collect()} == {b for b, a in pairs if a in chosen}
        labels = spark.createDataFrame([(i, "skip" if i % 3 else "keep") for i in range(n)], "object_id long, label string")
        chain = {b: sorted((a for x, a in pairs if x == b and a != b), key=lambda a: -sum(1 for x, _ in pairs if x == a)) for b in {p[0] for p in pairs}}
        assert {r.object_id: r.dominator_id for r in dom.nearest(ids_df(spark, chosen), labels, "skip").collect()} == {i: next((a for a in chain[i] if a % 3 == 0), None) for i in chosen}


def test_shortest_paths_of_random_graphs(spark):
    rng = random.Random(5)
    n = 150
    edges = [(rng.randrange(n), rng.randrange(n), "f") for _ in range(170)] + [(i, i + 1, "f") for i in range(100, 140)] + [(140, 100, "f")]
    blocked = {7, 8, 110}
    got = {r.object_id: (r.parent_id, r.depth) for r in graph.breadth_first(edges_df(spark, edges), ids_df(spark, [0, 1, 101]), ids_df(spark, blocked)).collect()}
    want, level, d = {r: (None, 0) for r in (0, 1, 101)}, {0, 1, 101}, 0
    while level:
        d += 1
        new = {}
        for a, b, _ in edges:
            if a in level and b not in want and b not in blocked:
                new[b] = (min(a, new.get(b, (a,))[0]), d)
        want |= new
        level = set(new)
    assert got == want


# --- what roots don't reach


def components(n, edges):
    above = [reach(edges, [i]) for i in range(n)]
    return {i: min(j for j in range(n) if j in above[i] and i in above[j]) for i in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_lost_objects_get_least_roots(spark, seed):
    rng = random.Random(seed)
    n = 70
    edges = [(rng.randrange(n), rng.randrange(n), "f") for _ in range(60)] + [(i, i + 1, "f") for i in range(50, 60)] + [(60, 50, "f"), (61, 62, "f"), (62, 61, "f"), (62, 63, "f")]
    snap = heap(spark, n, edges, [0, 1])
    lost = set(range(n)) - reach(edges, [0, 1])
    inner = [e for e in edges if e[0] in lost and e[1] in lost]
    part = components(n, inner)
    want = {min(i for i in lost if part[i] == c) for c in {part[i] for i in lost}} - {part[b] for a, b, _ in inner if part[a] != part[b]}
    kept = snapshots.keep_unreachable(snap)
    assert {r.object_id for r in kept.roots.where("type = 2048").collect()} == want
    assert reach(edges, [0, 1, *want]) == set(range(n))


def test_a_lost_chain_has_one_root(spark):
    kept = snapshots.keep_unreachable(heap(spark, 5, [(0, 1, "f"), (2, 3, "f"), (3, 4, "f")], [0]))
    assert sorted(tuple(r) for r in kept.roots.collect()) == [(0, 2), (2, 2048)]
    sizes = {r.object_id: r.retained for r in graph.dominance(kept.refs, kept.roots).retained(kept.objects).collect()}
    assert sizes == {0: 20, 1: 10, 2: 30, 3: 20, 4: 10}


# --- groups


def test_groups_are_searched_in_their_regions(spark):
    rng = random.Random(3)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), "f") for _ in range(110)]
    roots = [0, 1, 2]
    snap = heap(spark, n, edges, roots)
    groups = [(g, rng.randrange(1, n)) for g in range(5) for _ in range(4)]
    held = graph.retained_by_groups(snap.refs, snap.roots, spark.createDataFrame(groups, "group_id long, object_id long"), graph.breadth_first(snap.refs, snap.roots))
    got = {tuple(r) for r in held.collect()}
    everything = reach(edges, roots)
    assert got == {(g, x) for g in range(5) for x in everything - reach(edges, roots, {o for h, o in groups if h == g})}
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


# --- paths


def brute_paths(edges, roots, target, k):
    if target in roots:
        return [[target]]
    into = defaultdict(set)
    for a, b in edges:
        into[b].add(a)
    nxt, todo, out, depth = {target: None}, [target], [], {target: 0}
    while todo:
        new = {}
        for x in todo:
            out += [(depth[x], r, x) for r in into[x] if r in roots]
            for a in into[x]:
                if a not in roots and a not in nxt:
                    new[a] = min(x, new.get(a, x))
        for a, x in new.items():
            nxt[a], depth[a] = x, depth[x] + 1
        todo = sorted(new)
    paths = []
    for d, r, x in sorted(out)[:k]:
        path = [r]
        while x is not None:
            path.append(x)
            x = nxt[x]
        paths.append(path)
    return sorted(paths, key=lambda p: (len(p), p))


def test_paths_of_random_graphs(spark):
    rng = random.Random(9)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice("fg")) for _ in range(120)]
    snap = heap(spark, n, edges, [0, 1, 2])
    for target, k in ((35, 30), (20, 4), (1, 30)):
        assert [r.path for r in reports.path2gc(snap, target, k).collect()] == brute_paths({(a, b) for a, b, _ in edges}, {0, 1, 2}, target, k)
    kept = {(a, b) for a, b, f in edges if f == "f"}
    assert [r.path for r in reports.path2gc(snap, 35, 30, F.col("name") == "g").collect()] == brute_paths(kept, {0, 1, 2}, 35, 30)


def test_paths_through_forty_diamonds(spark):
    """2^40 walks, but each object is entered once."""
    edges = [e for i in range(40) for e in ((3 * i, 3 * i + 1, "f"), (3 * i, 3 * i + 2, "f"), (3 * i + 1, 3 * i + 3, "f"), (3 * i + 2, 3 * i + 3, "f"))]
    rows = reports.path2gc(heap(spark, 121, edges, [0]), 120).collect()
    assert [r.path for r in rows] == brute_paths({e[:2] for e in edges}, {0}, 120, 30) and [r.length for r in rows] == [81, 81]


def test_path_trees(spark):
    """Counts up the tree equal those of each path's every step."""
    rng = random.Random(6)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), "f") for _ in range(110)]
    snap = heap(spark, n, edges, [0, 1])
    tree = graph.breadth_first(snap.refs, snap.roots)
    up = {r.object_id: r.parent_id for r in tree.collect()}
    chosen = [i for i in range(5, n, 2)] + [7, 7]
    walks = []
    for i in chosen:
        if i in up:
            walk = [i]
            while up[walk[-1]] is not None:
                walk.append(up[walk[-1]])
            walks.append(walk[::-1])
    name = lambda i: f"c.C{1 + i % 3}"
    forest = Forest(tree.select("object_id", "parent_id"), tree.select("object_id", "depth"))
    ids = ids_df(spark, chosen)
    want = defaultdict(list)
    for w in walks:
        for d, x in enumerate(w):
            want[d, name(x)].append(x)
    got = {(r.depth, r.name): (r.on_path, r.referenced) for r in ((row) for row in inspections.merge_shortest_paths(snap, tree, ids, forest).withColumnRenamed("name", "name").collect())}
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}
    for group_by, turn in (("FROM_GC_ROOTS_BY_CLASS", 1), ("FROM_OBJECTS_BY_CLASS", -1)):
        want = defaultdict(list)
        for w in set(map(tuple, walks)):
            for d in range(len(w)):
                part = w[::turn][: d + 1]
                want[d, ">".join(map(name, part))].append(part[-1])
        got = {(r["level"], r["path"]): (r["on_path"], r["referenced"]) for r in inspections.grouped_paths(snap, tree, ids, group_by, forest).collect()}
        assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_layers_below_a_core(spark):
    """Layers without a way back hang below a circle of crossing paths: paths, dominators, sizes and outermost objects against plain Python."""
    rng = random.Random(31)
    core, n = 8, 96
    edges = [(i, (i + 1) % core) for i in range(core)] + [(rng.randrange(core), rng.randrange(core)) for _ in range(4)]
    edges += [(rng.randrange(low), v) for low, end in ((8, 16), (16, 32), (32, n)) for v in range(low, end) for _ in range(rng.randrange(1, 4))]
    edges = [(a, b) for a, b in edges if a != b]
    roots = [0, 5, 30]
    refs = spark.createDataFrame(edges + edges[::5], "src_id long, dst_id long")  # some are parallel
    top = ids_df(spark, roots)
    kept = graph.edges_of(refs)
    layers = graph.layers_of(kept)
    assert len(layers) > 2 and kept._core_rows > 0
    depth = {r: 0 for r in roots}
    level = roots
    while level:
        level = sorted({b for a, b in edges if a in level and b not in depth})
        depth.update({b: max(depth.values()) + 1 for b in level})
    tree = {r.object_id: (r.parent_id, r.depth) for r in graph.breadth_first(refs, top).collect()}
    assert tree == {v: (min((a for a, b in edges if b == v and depth.get(a) == d - 1), default=None) if d else None, d) for v, d in depth.items()}
    dom = graph.dominance(refs, top)
    assert dom.rows.where("layer = 0 and dominator_id is not null").count() > 0
    chain, above = {}, {r.object_id: r.dominator_id for r in dom.rows.collect()}
    for v in above:
        at, chain[v] = v, []
        while (at := above[at]) is not None:
            chain[v].append(at)
    assert {(v, a) for v in chain for a in [v, *chain[v]]} == brute_dominators(n, [(a, b, 'f') for a, b in edges], roots)
    assert {r.object_id: r.level for r in dom.rows.collect()} == {v: len(c) + 1 for v, c in chain.items()}
    sizes = {r.object_id: r.retained for r in dom.retained(spark.range(n).selectExpr("id as object_id", "id + 1 as shallow")).collect()}
    assert sizes == {v: v + 1 + sum(w + 1 for w in chain if v in chain[w]) for v in chain}
    groups = {(g, rng.randrange(n)) for g in range(5) for _ in range(20)}
    got = {tuple(r) for r in dom.outermost(spark.createDataFrame(sorted(groups), "group_id long, object_id long")).collect()}
    assert got == {(g, v) for g, v in groups if v in chain and not any((g, a) in groups for a in chain[v])}
    held = {tuple(r) for r in graph.retained_by_groups(refs, top, spark.createDataFrame(sorted(groups), "group_id long, object_id long"), graph.breadth_first(refs, top)).collect()}
    for g in range(5):
        inside = {v for h, v in groups if h == g}
        reached = level = {r for r in roots if r not in inside}
        while level:
            level = {b for a, b in edges if a in level} - reached - inside
            reached = reached | level
        assert {v for h, v in held if h == g} == set(depth) - reached
