"""Display names against a recursive version; long chains, cycles, missing parts."""

import random

from heapspark.operators import names
from heapspark.plans.snapshot import Snapshot

TEMPLATES = {"t.Text": "{self}", "t.Box": "{value}", "t.Pair": "{first}/{second}", "t.Mixed": "<{self}> {first}"}
CLASSES = [(1, "t.Object", None), (2, "t.Text", 1), (3, "t.Box", 1), (4, "t.Pair", 1), (5, "t.LongBox", 3), (6, "t.Mixed", 4), (7, "t.Other", 1)]
RULES = {2: "t.Text", 3: "t.Box", 4: "t.Pair", 5: "t.Box", 6: "t.Mixed"}
FIELDS = {"t.Text": [], "t.Box": ["value"], "t.Pair": ["first", "second"], "t.Mixed": ["first"]}


def heap(spark, objects, refs):
    objects = spark.createDataFrame(objects, "object_id long, class_id int, label string")
    classes = spark.createDataFrame([(i, n, up, 1, 8) for i, n, up in CLASSES], "class_id int, name string, super_id int, loader_id int, instance_size long")
    return Snapshot(objects, classes, spark.createDataFrame(refs, "src_id long, dst_id long, name string"), None)


def slow(objects, refs):
    kind, label = {o: RULES.get(c) for o, c, _ in objects}, {o: x for o, _, x in objects}
    to = {}
    for a, b, f in refs:
        to[a, f] = min(b, to.get((a, f), b))
    known = {}

    def passes(o):
        seen = set()
        while o not in seen and kind.get(o) == "t.Box" and (o, "value") in to:
            seen.add(o)
            o = to[o, "value"]
        return None if o in seen else o

    def name(o):
        if kind.get(o) is None:
            return None
        if kind[o] == "t.Box":
            end = passes(o)
            return None if end is None or kind.get(end) == "t.Box" else name(end)
        if o not in known:
            parts = {f: name(to[o, f]) if (o, f) in to else None for f in FIELDS[kind[o]]} | {"self": label[o]}
            used = [parts[f] for f in ("self", *FIELDS[kind[o]]) if "{%s}" % f in TEMPLATES[kind[o]]]
            known[o] = None if all(x is None for x in used) else TEMPLATES[kind[o]].format(**{k: x or "" for k, x in parts.items()})
        return known[o]

    return {o: x for o, _, _ in objects if (x := name(o)) is not None}


def test_names_equal_recursion(spark):
    """Objects refer to greater ids, some passing ones to themselves; fields with two references, to nothing known and to objects without a rule."""
    rng = random.Random(3)
    for n in (40, 90):
        objects = [(i, rng.choice([2, 3, 4, 5, 6, 7]), rng.choice([None, "", "x", f"é{i}"])) for i in range(n)]
        refs = [(o, o if c in (3, 5) and rng.random() < 0.1 else rng.randrange(o + 1, n + 3), f) for o, c, _ in objects for f in ("value", "first", "second") for _ in range(rng.choice([0, 1, 1, 2]))]
        got = names.display_names(heap(spark, objects, refs), TEMPLATES).collect()
        want = slow(objects, refs)
        assert len(got) == len(want) > n / 3 and {r["object_id"]: r["display_name"] for r in got} == want


def test_long_chain_cycles_and_missing_parts(spark):
    n = 3_000
    chain = [(i, 3, None) for i in range(n)] + [(n, 2, "end")]
    refs = [(i, i + 1, "value") for i in range(n)]
    ring = [(10_000 + i, 3, None) for i in range(3)] + [(10_010, 4, None), (10_011, 4, None), (10_012, 6, "m"), (10_013, 4, None), (10_014, 6, None)]
    refs += [(10_000, 10_001, "value"), (10_001, 10_002, "value"), (10_002, 10_000, "value")]
    refs += [(10_010, 10_011, "first"), (10_011, 10_010, "first"), (10_012, 10_000, "first"), (10_013, 0, "first"), (10_013, 77_777, "second")]
    got = {r["object_id"]: r["display_name"] for r in names.display_names(heap(spark, chain + ring, refs), TEMPLATES).collect()}
    assert {got.pop(i) for i in range(n + 1)} == {"end"}
    assert got == {10_012: "<m> ", 10_013: "end/"}


def test_no_objects(spark):
    assert names.display_names(heap(spark, [], []), TEMPLATES).count() == 0
    assert names.display_names(heap(spark, [(1, 2, "a")], [])).count() == 0
