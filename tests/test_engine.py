"""The engine: every query against its SQL, graph operators against brute force, value semantics."""

import itertools
import math
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from heapspark import queries
from heapspark.functions import filters, values as v
from heapspark.operators import compare, graph, inspections, quantize, scans
from heapspark.plans.snapshot import Snapshot, class_ancestors, shop
from heapspark.sources import results, snapshots
from heapspark.streaming import histogram

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(x):
    return ("nan" if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        at = [df.columns.index(c) for c in want.columns]
        assert sorted((tuple(norm(r[i]) for i in at) for r in rows), key=str) == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=str)
    else:
        assert rows


# --- graphs

SAMPLE = "A>D B>A B>D B>E C>F C>G D>L E>H F>I G>I G>J H>E H>K I>K J>I K>I K>R L>H R>A R>B R>C".split()
IDS = {c: i for i, c in enumerate("RABCDEFGHIJKL")}


def edges_df(spark, edges):
    return spark.createDataFrame([(a, b, f) for a, b, f in edges], "src_id long, dst_id long, name string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "object_id long")


def reach(edges, roots, blocked=()):
    seen, todo = set(), [r for r in roots if r not in blocked]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b, _ in edges if a == x and b not in blocked]
    return seen


def ids(df):
    return {r["object_id"] for r in df.collect()}


def dominators(edges, roots):
    everything = reach(edges, roots)
    return {(n, d) for d in everything for n in everything - reach(edges, roots, {d})}


def dominated_pairs(dom):
    """(object, dominator) of intervals."""
    rows = [tuple(r) for r in dom.nodes.select("object_id", "enter", "leave").collect()]
    assert sorted(r[1] for r in rows) == list(range(len(rows)))
    return {(b, a) for a, enter, leave in rows for b, at, _ in rows if enter <= at < leave}


def test_sample_dominators(spark):
    edges = [(IDS[e[0]], IDS[e[2]], "f") for e in SAMPLE]
    dom = graph.dominance(edges_df(spark, edges), ids_df(spark, [0]))
    tree = {r["object_id"]: r["dominator_id"] for r in dom.tree().collect()}
    want = {**dict.fromkeys("ABCDEHIK", "R"), "F": "C", "G": "C", "L": "D", "J": "G"}
    assert tree == {0: None, **{IDS[k]: IDS[p] for k, p in want.items()}}
    objects = spark.createDataFrame([(i, 1) for i in IDS.values()], "object_id long, shallow long")
    sizes = {r["object_id"]: r["retained"] for r in dom.retained(objects).collect()}
    assert sizes == {IDS[c]: {"R": 13, "C": 4, "D": 2, "G": 2}.get(c, 1) for c in IDS}
    refs, roots = edges_df(spark, edges), ids_df(spark, [0])
    named = lambda cs: {IDS[c] for c in cs}
    assert ids(graph.retained_set(objects, refs, roots, ids_df(spark, named("CD")))) == named("CDFGJL")
    assert ids(graph.retained_set(objects, refs, roots, ids_df(spark, named("HI")))) == named("HIK")
    assert ids(dom.dominated_set(ids_df(spark, named("HI")))) == named("HI")
    assert ids(graph.retained_set(objects, refs, roots, ids_df(spark, named("ABC")))) == named("ABCDEFGHIJKL")
    bfs = {r["object_id"]: r["parent_id"] for r in graph.breadth_first(refs, roots).collect()}
    assert bfs == {0: None, **{IDS[k]: IDS[p] for k, p in zip("ABCDEFGHIJKL", "RRRABCCEFGHD")}}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice("fgh")) for _ in range(30)]
    roots = rng.sample(range(n), 2)
    refs, top = edges_df(spark, edges), ids_df(spark, roots)
    objects = spark.createDataFrame([(i, i + 1) for i in range(n)], "object_id long, shallow long")
    dom = graph.dominance(refs, top)
    assert dominated_pairs(dom) == dominators(edges, roots)
    some = set(rng.sample(range(n), 3))
    everything = reach(edges, roots)
    assert ids(graph.retained_set(objects, refs, top, ids_df(spark, some))) == everything - reach(edges, roots, some)
    cut = [e for e in edges if not (e[0] in some and e[2] == "f")]
    assert ids(graph.retained_by_fields(refs, top, ids_df(spark, some), ["f"])) == everything - reach(cut, roots)
    kept = [e for e in edges if e[2] != "g"]
    assert ids(graph.retained_excluding(refs, top, ids_df(spark, some), F.col("name") == "g")) == reach(edges, some) - reach(kept, roots, some)
    pairs = dominators(edges, roots)
    inside = some & everything
    assert ids(dom.top_ancestors(ids_df(spark, inside))) == {x for x in inside if not any((x, y) in pairs for y in inside - {x})}
    assert ids(graph.unreachable(objects, refs, top)) == set(range(n)) - everything


def test_parallel_references(spark):
    refs = edges_df(spark, [(1, 2, "x"), (1, 2, "y"), (1, 3, "x")])
    assert {(r["src_id"], r["dst_id"]) for r in graph.without_excluded(refs, F.col("name") == "x").collect()} == {(1, 2)}


def test_class_closure(spark, sf):
    up = {(r["class_id"], r["ancestor_id"]) for r in class_ancestors(shop(spark, sf).classes).collect()}
    assert {a for c, a in up if c == 15} == {15, 4, 1} and len([1 for c, _ in up if c == 1]) == 1


# --- values

ROWS = [(1, 2, 3.0, "a", True), (2, None, float("nan"), "", False), (3, 2**31 - 1, float("inf"), None, None), (4, 0, 0.0, "x$y", True)]


@pytest.fixture(scope="module")
def vals(spark):
    return spark.createDataFrame(ROWS, "id long, i int, d double, s string, b boolean").coalesce(1)


def col(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_values(vals):
    i, d, s = F.col("i"), F.col("d"), F.col("s")
    nul = F.lit(None)
    assert col(vals, v.eq(i, nul.cast("int"))) == [False, True, False, False]
    assert col(vals, v.eq_double(d, d)) == [True, False, True, True]
    assert col(vals, v.eq(i, F.lit("2"), same_kind=False)) == [False, False, False, False]
    assert col(vals, v.compare(d, ">", F.lit(1.0), floating=True)) == [True, False, True, False]
    assert col(vals, v.compare(i, "<", F.lit(5))) == [True, False, False, True]
    assert col(vals, v.like(s, "x$y")) == [False, False, False, True]
    assert col(vals, v.not_like(s, "a")) == [False, True, False, True]
    assert col(vals, v.not_in_array(i, F.array(F.lit(2)))) == [False, False, True, True]
    assert col(vals, v.truthy(d, "double")) == [True, False, True, False]
    assert col(vals, v.truthy(s, "string")) == [True, False, False, True]
    assert col(vals, v.add(i, F.lit(1))) == [3, None, -(2**31), 1]
    assert col(vals, v.multiply(i, F.lit(2))) == [4, None, -2, 0]
    got = col(vals, v.divide(F.lit(1), i))
    assert got[:2] == [0.5, None] and got[3] == math.inf
    assert math.isnan(col(vals, v.divide(i, F.lit(0)))[3])
    assert col(vals, v.concat(F.lit("v"), i)) == ["v2", "vnull", "v2147483647", "v0"]
    assert col(vals, v.to_hex(F.lit(-1).cast("long")))[0] == "0x" + "f" * 16


@pytest.mark.parametrize("a,b", [(3, 5), (-7, 2**62), (2**63 - 1, 2**63 - 1), (-(2**63), 3), (2**40 + 17, -(2**35))])
def test_long_products_wrap(spark, a, b):
    got = spark.range(1).select(v.multiply(F.lit(a).cast("long"), F.lit(b).cast("long"), "long")).first()[0]
    assert got == (a * b + 2**63) % 2**64 - 2**63


def test_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "id long, a array<int>")
    assert col(df, v.item(F.col("a"), 2)) == [3, None, None] and col(df, v.item(F.col("a"), -1)) == [None] * 3
    assert col(df, v.part(F.col("a"), 1, -1)) == [[2, 3], [], None] and col(df, v.part(F.col("a"), 0, 99)) == [[1, 2, 3], [], None]
    flat = scans.flatten(df.withColumn("c", F.array(F.lit("p"))), ["id"], "a", "c").collect()
    assert sorted((r["id"], r["a"] or 0, r["c"]) for r in flat) == [(1, 1, "p"), (1, 2, None), (1, 3, None), (2, 0, "p"), (3, 0, "p")]


def test_smart_fix():
    assert v.smart_fix("java.util.Map$Entry") == r"java.util.Map\$Entry" and v.smart_fix("int[]") == r"int\[\]" and v.smart_fix("a$") == "a$"
    assert v.smart_fix("Map", anywhere=True) == ".*Map.*" and v.smart_fix("^Map", anywhere=True) == "^Map"


def test_methods(vals):
    assert col(vals, v.call("indexOf", F.col("s"), F.lit("$"))) == [-1, -1, None, 1]
    with pytest.raises(ValueError):
        v.call("exec", F.col("s"))


@pytest.mark.parametrize(
    "text,want",
    [("2..4", "2 3 4"), ("..3", "1 2 3"), ("3..", "3 4 5"), ("!2..4", "1 5 nan"), ("U\\2..4", "1 5"), (">3", "4 5"), (">=3", "3 4 5"), ("<2", "1"), ("<=2", "1 2"), ("<>3", "1 2 4 5 nan"), ("!=3", "1 2 4 5 nan"), ("3", "3"), ("300%", "3")],
)
def test_numeric_filter(spark, text, want):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)] + [(float("nan"),)], "x double")
    got = [r["x"] for r in df.where(filters.numeric(F.col("x"), text, percent="%" in text)).collect()]
    assert [("nan" if math.isnan(x) else f"{x:g}") for x in got] == want.split()


# --- results


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "x long")
    row = df.agg(quantize.count(), quantize.total("x"), quantize.least("x"), quantize.greatest("x", True), quantize.average("x"), quantize.average_long("x"), quantize.average_long("x", True)).first()
    assert tuple(row) == (0, 0, 0, None, 0.0, 0, 1)


def test_linear_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (-5, 0, 1, 10, 11, 20, 21)], "x long")
    assert [r[0] for r in df.select(quantize.linear_long(F.col("x"), 0, 20, 10)).collect()] == [0, 0, 10, 10, 20, 20, 2**63 - 1]


def test_linear_buckets_below_zero(spark):
    """Whole division is towards 0: low + step * ((v - 1) / step + 1)."""
    want = lambda v, low, high, step: low if v <= low else 2**63 - 1 if v > high else low + step * (int((v - 1) / step) + 1)
    df = spark.createDataFrame([(x,) for x in range(-25, 26)], "x long")
    assert [r[0] for r in df.select(quantize.linear_long(F.col("x"), -20, 20, 10)).collect()] == [want(x, -20, 20, 10) for x in range(-25, 26)]
    big = spark.createDataFrame([(2**60 + 3,)], "x long")
    assert big.select(quantize.linear_long(F.col("x"), 0, 2**62, 7)).first()[0] == 7 * ((2**60 + 2) // 7 + 1)


def test_average_of_large_longs(spark):
    for xs in ([2**53 + 1], [2**53 + 1, 2**53 + 2], [-7, -8], [2**61, 2**61 + 3]):
        df = spark.createDataFrame([(x,) for x in xs], "x long")
        whole = abs(sum(xs)) // len(xs)
        assert df.agg(quantize.average_long("x")).first()[0] == (whole if sum(xs) >= 0 else -whole)


def test_matches_are_whole(spark):
    """A pattern does not match a text that goes on with a line break."""
    df = spark.createDataFrame([(0, "abc"), (1, "abc\n"), (2, "\nabc")], "id long, s string")
    s = F.col("s")
    assert col(df, v.like(s, "abc")) == [True, False, False] and col(df, v.not_like(s, "abc")) == [False, True, True]
    assert col(df, v.call("matches", s, "abc")) == [True, False, False] and col(df, filters.text(s, "^abc$")) == [True, False, False]
    assert inspections.find_strings(df, "s", "abc").count() == 1


def test_java_methods(spark):
    df = spark.createDataFrame(list(enumerate(["\t a\u00a0\r\n", "Hello, W\u00f6rld", "a\U0001f642", "", None])), "id long, s string")

    def java(t):
        h = 0
        for i in range(0, len(raw := t.encode("utf-16-le")), 2):
            h = (31 * h + int.from_bytes(raw[i : i + 2], "little") + 2**31) % 2**32 - 2**31
        return h

    texts = [r["s"] for r in df.orderBy("id").collect()]
    assert col(df, v.call("trim", F.col("s")))[0] == "a\u00a0"
    assert col(df, v.call("hashCode", F.col("s"))) == [None if t is None else java(t) for t in texts]
    assert col(df, v.call("compareTo", F.lit(1), F.lit(None).cast("int")))[0] is None
    assert col(df, v.divide(F.lit(1.0), F.lit(-0.0)))[0] == -math.inf and col(df, v.divide(F.lit(-1.0), F.lit(-0.0)))[0] == math.inf


def test_classes_of_two_loaders_stay_apart(spark):
    objects = spark.createDataFrame([(1, 1, 8), (2, 2, 8), (3, 2, 8)], "object_id long, class_id int, shallow long")
    classes = spark.createDataFrame([(1, "a.A", None, 1, 8), (2, "a.A", None, 2, 8), (3, "a", None, 1, 8)], "class_id int, name string, super_id int, loader_id int, instance_size long")
    snap = Snapshot(objects, classes, spark.createDataFrame([(1, 3, "f")], "src_id long, dst_id long, name string"), spark.createDataFrame([(1, 2), (2, 2)], "object_id long, type int"))
    assert sorted(r["objects"] for r in inspections.histogram(snap).collect()) == [1, 2]
    assert sorted(r["objects"] for r in inspections.histogram(snap, group_by="BY_SUPERCLASS").collect()) == [1, 2]
    dom = graph.dominance(snap.refs, snap.roots)
    assert inspections.dominator_tree(snap, dom, "BY_PACKAGE").where("package = 'a'").first()["objects"] == 2
    with pytest.raises(ValueError):
        inspections.dominator_tree(snap, dom, "BY_NOTHING")
    own = spark.createDataFrame([("a", 1), ("a.B", 2)], "name string, n int")
    assert sorted((r["package"], r["n"]) for r in quantize.by_package(own, "name", F.sum("n").alias("n")).collect()) == [("<ROOT>", 1), ("a", 1), ("a", 2), ("a.B", 2)]


def test_big_leaves_are_drops(spark):
    """A leaf below the top level that is larger than the threshold counts; a lone root does not."""
    objects = spark.createDataFrame([(0, 1, 10), (1, 1, 500), (2, 1, 5), (3, 1, 900)], "object_id long, class_id int, shallow long")
    snap = Snapshot(objects, None, spark.createDataFrame([(0, 1, "f"), (0, 2, "f")], "src_id long, dst_id long, name string"), spark.createDataFrame([(0, 2), (3, 2)], "object_id long, type int"))
    dom = graph.dominance(snap.refs, snap.roots)
    got = {r["object_id"]: (r["biggest_child"], r["drop_size"], r["children"]) for r in inspections.big_drops_in_dominator_tree(snap, dom).collect()}
    assert got == {1: (0, 500, 0), 0: (500, 15, 2)}


@pytest.mark.parametrize("seed", range(1))
def test_retained_sets_of_groups_at_once(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), "f") for _ in range(45)]
    groups = [(g, rng.randrange(1, 25)) for g in range(4) for _ in range(3)]
    refs, roots = edges_df(spark, edges), ids_df(spark, [0])
    tree = graph.breadth_first(refs, roots)
    got = {(r["group_id"], r["object_id"]) for r in graph.retained_by_groups(refs, roots, spark.createDataFrame(groups, "group_id long, object_id long"), tree).collect()}
    want = set()
    for g in range(4):
        ids = {o for k, o in groups if k == g}
        want |= {(g, r["object_id"]) for r in graph.retained_set(None, refs, roots, ids_df(spark, sorted(ids))).collect()}
    assert got == want


def test_index_follows_its_source(spark, tmp_path):
    """Built once while the files stay, and again when one changes."""
    def build(s, folder):
        n = s.read.parquet(f"{folder}/n.parquet").first()[0]
        ids = spark.range(n).selectExpr("id as object_id", "1 as class_id", "8L as shallow")
        refs = spark.range(1, n).selectExpr("id - 1 as src_id", "id as dst_id", "'f' as name")
        return Snapshot(ids, None, refs, spark.createDataFrame([(0, 2)], "object_id long, type int"))

    spark.createDataFrame([(5,)], "n long").write.parquet(f"{tmp_path}/n.parquet")
    first = snapshots.indexed(spark, str(tmp_path), build)
    assert snapshots.indexed(spark, str(tmp_path), build) is first and first.tree.count() == 5 and first.retained.where("object_id = 1").first()["retained"] == 32
    spark.createDataFrame([(7,)], "n long").write.mode("overwrite").parquet(f"{tmp_path}/n.parquet")
    again = snapshots.indexed(spark, str(tmp_path), build)
    assert again is not first and again.tree.count() == 7


def test_join_counted_equals_a_join(spark, monkeypatch):
    """Hot keys by broadcast and cold ones by shuffle give the plain join's rows."""
    from heapspark.plans import store

    monkeypatch.setattr(store, "LEAST_HOT", 3)
    monkeypatch.setattr(store, "HOT", 4)
    rows = spark.range(60).selectExpr("case when id % 3 = 0 then 0 else id % 11 end as k", "id as x", "'own' as salt")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 5").withColumn("name", F.concat(F.lit("k"), "k"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, store.join_counted(rows, keyed, ["k"], "n", 60, "x", how).collect()), key=str)
        assert got == sorted(map(tuple, rows.join(keyed, "k", how).select("k", "x", "salt", "n", "name").collect()), key=str)


def test_work_folder_needs_a_shared_place(spark, monkeypatch):
    from heapspark.plans import store

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        store.work_dir(Session, "x")


def test_plans_of_extents_read_one_table(spark, sf):
    plan = queries.QUERIES["extent_exact"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "lineitem" not in plan


def test_compare_modes(spark):
    t = [spark.createDataFrame(r, "k string, n long") for r in ([("a", 10), ("b", 0), ("d", 1), ("d", 2)], [("a", 15), ("c", 3), ("b", 0), ("d", 5)])]
    got = {(r["k"], r["nth"]): (r["n_0"], r["n_1"], r["n_1_ratio"]) for r in compare.compare(t, "k", ["n"], "DIFF_RATIO_TO_FIRST").collect()}
    assert got == {("a", 1): (10, 5, 0.5), ("b", 1): (0, 0, 0.0), ("c", 1): (None, 3, None), ("d", 1): (1, 4, 4.0), ("d", 2): (2, None, None)}
    assert spark.range(1).select(compare.mask_key(F.lit("x @ 0xff"), compare.MASKS[0])).first()[0] == "x"


def test_waste_intervals(spark):
    rng = random.Random(1)
    rows = [(a, 100, rng.randrange(80), rng.randrange(1, 20)) for a in range(20) for _ in range(5)]
    df = spark.createDataFrame(rows, "array_id long, length long, first long, size long")
    want = {a: len(set(itertools.chain(*[range(f, f + n) for x, _, f, n in rows if x == a]))) for a in range(20)}
    got = {r["array_id"]: r["used"] for r in inspections.waste_in_char_arrays(df, -1).collect()}
    assert got == want


def test_results_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 10), (None, 7)], "name string, n long")
    top = results.refine(df, [F.col("n") > 2], "n=DESC", ["name"], 1)
    assert [r["n"] for r in top.collect()] == [10] and top.columns == ["n"]
    assert results.to_text(df.coalesce(1)).splitlines()[0] == "name |  n"
    assert "<td>19</td>" in results.to_html(df, totals=["n"])
    paths = results.report({"one": df, "two": df}, str(tmp_path / "r"))
    assert len(paths) == 3 and spark.read.option("header", True).csv(paths[1]).count() == 3


def test_snapshot_files(spark, sf, tmp_path):
    snap = shop(spark, sf)
    snapshots.write(snap, str(tmp_path / "s"), files=2)
    again = snapshots.open_snapshot(spark, str(tmp_path / "s"))
    assert again.objects.count() == snap.objects.count() and again.refs.count() == snap.refs.count()
    assert snapshots.keep_unreachable(again).roots.count() == 5 + 200
    part = snapshots.discard(again, 50, r"shop\.trade\.Part", seed=3)
    assert 50 < snap.objects.count() - part.objects.count() < 150
    assert snapshots.rename_classes(again.classes, {"shop.trade.Part": "x.Y"}).where("name = 'x.Y'").count() == 1
    assert spark.range(1).select(snapshots.redact(F.lit("ab c.d"), "FULL")).first()[0] == "** *.*"


def test_reference_statistics(spark):
    refs = edges_df(spark, [(0, 1, "own"), (1, 2, "referent"), (1, 3, "own"), (0, 4, "own"), (4, 5, "referent"), (0, 5, "own")])
    objects = spark.createDataFrame([(i, 1, 8) for i in range(6)], "object_id long, class_id int, shallow long")
    classes = spark.createDataFrame([(1, "C", None, 0, 8)], "class_id int, name string, super_id int, loader_id int, instance_size long")
    snap = Snapshot(objects, classes, refs, spark.createDataFrame([(0, 3)], "object_id long, type int"))
    h1, h2, h3 = inspections.reference_statistics(snap, ids_df(spark, [2, 3, 5]), ids_df(spark, [1, 4]), ["referent"])
    assert [h.first()["objects"] if h.first() else 0 for h in (h1, h2, h3)] == [3, 1, 1]
    assert {r["root_type"] for r in inspections.run("gc_roots", snap).collect()} == {"UNKNOWN", "SYSTEM_CLASS"}
    with pytest.raises(ValueError):
        inspections.run("none")


def test_streaming_histogram(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = histogram.windowed(live, "ts", "event_type", "value", late="1000 days").writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["start", "event_type", "n"]
    want = sorted(map(tuple, histogram.windowed(events, "ts", "event_type", "value").select(key).collect()))
    assert sorted(map(tuple, spark.table("hist").select(key).collect())) == want


def test_every_query_has_sql_or_a_reason():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"retained_size_all", "export_redacted_all"}


def test_export_redacted_all(spark, tmp_path):
    texts = [None, "", "plain 12", "déjà vu — ça?", "Straße 9\nnächste", "日本 テキスト 🙂 ½ Ⅷ", "e\u0301 ’quote’", "٣ ж"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["export_redacted_all"](spark, str(tmp_path)).collect()}
    want = {i: None if t is None else "".join("*" if unicodedata.category(c)[0] in "LN" else c for c in t) for i, t in enumerate(texts)}
    assert got == want


@pytest.mark.parametrize("name", [*[f"setop_{x}" for x in ("intersection", "union", "difference", "reverse_difference", "symmetric_difference")], "subselect_flatten", "constant_arrays"])
def test_no_group_is_gathered(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_retained_size_all(spark, sf, db):
    got = {r["object_id"]: r["retained"] for r in queries.QUERIES["retained_size_all"](spark, sf).select("object_id", "retained").collect()}
    want = dict(db.sql(queries.ORACLE_SQL["retained_size"]).filter("object_id IS NOT NULL").select("object_id", "retained").fetchall())
    lines = {i: n for i, n in got.items() if i >= queries.LINE}
    assert set(lines.values()) == {96}
    assert {i: n for i, n in got.items() if i not in lines} == want
