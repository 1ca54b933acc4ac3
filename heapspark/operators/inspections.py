"""Named inspections of a snapshot.  COMMANDS finds them by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import smart_fix, whole
from ..plans.order import running
from ..plans.snapshot import Snapshot
from ..plans.store import materialize
from . import graph, quantize
from .forest import Forest

COMMANDS: dict[str, Callable[..., DataFrame]] = {}

#: Root types, by bit from the lowest.
ROOT_TYPES = (
    "UNKNOWN", "SYSTEM_CLASS", "NATIVE_LOCAL", "NATIVE_STATIC", "THREAD_BLOCK", "BUSY_MONITOR", "JAVA_LOCAL", "NATIVE_STACK",
    "THREAD_OBJ", "FINALIZABLE", "UNFINALIZED", "UNREACHABLE", "JAVA_STACK_FRAME",
)
#: Classes that immediate_dominators looks through.
SKIP = r"java\..*|javax\..*|com\.sun\..*|sun\..*|jdk\..*"


def command(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    COMMANDS[f.__name__] = f
    return f


def _known(given: str, *names: str) -> None:
    if given not in names:
        raise ValueError(f"unknown grouping {given}; known: {', '.join(names)}")


def _named(snap: Snapshot, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(snap.classes.select("class_id", "name", "loader_id")), "class_id")


@command
def histogram(snap: Snapshot, ids: DataFrame | None = None, group_by: str = "BY_CLASS") -> DataFrame:
    """(name, objects, shallow) of the heap or of a set, a row a class: classes of one name from two loaders stay apart.

    Also BY_SUPERCLASS, BY_CLASSLOADER, BY_PACKAGE.
    """
    _known(group_by, "BY_CLASS", "BY_SUPERCLASS", "BY_CLASSLOADER", "BY_PACKAGE")
    objects = snap.objects if ids is None else snap.objects.join(ids.select("object_id").distinct(), "object_id", "left_semi")
    classes = objects.groupBy("class_id").agg(quantize.count().alias("objects"), F.sum("shallow").cast("long").alias("shallow"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("objects", "shallow")]
    if group_by == "BY_SUPERCLASS":
        return quantize.by_superclass(classes, snap.classes, *sums)
    if group_by == "BY_CLASSLOADER":
        return quantize.by_loader(classes, snap.classes, *sums)
    if group_by == "BY_PACKAGE":
        return quantize.by_package(_named(snap, classes), "name", *sums)
    return _named(snap, classes).select("name", "objects", "shallow")


@command
def retained_column(snap: Snapshot, classes: DataFrame, dom: graph.Dominance, tree: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(class_id, objects, shallow, retained): a class table with its retained sizes.

    Approximate without tree and refs: the least retained size, what the objects dominate one by one.
    With them precise: what roots reach only through the objects of the class together.
    """
    rows = snap.objects.join(F.broadcast(classes.select("class_id")), "class_id", "left_semi")
    own = rows.groupBy("class_id").agg(quantize.count().alias("objects"), F.sum("shallow").cast("long").alias("shallow"))
    if tree is None:
        sizes = dom.class_sizes(snap.objects, classes)
    else:
        held = graph.retained_sizes_by_groups(snap.objects, refs if refs is not None else snap.refs, snap.roots, rows.select(F.col("class_id").alias("group_id"), "object_id"), tree)
        sizes = held.withColumnRenamed("group_id", "class_id")
    return own.join(sizes, "class_id", "left")


def _top(snap: Snapshot, dom: graph.Dominance) -> DataFrame:
    """The rows of dom.table() without a dominator, with their share of the heap."""
    heap = snap.objects.agg(F.sum("shallow").alias("heap"))
    rows = dom.table(snap.objects).where("known and dominator_id is null")
    return rows.crossJoin(F.broadcast(heap)).withColumn("share", F.col("retained") / F.col("heap")).drop("heap")  # one row


@command
def dominator_tree(snap: Snapshot, dom: graph.Dominance, group_by: str = "NONE") -> DataFrame:
    """Top level of the tree with retained sizes and their share of the heap; or its rows by class, loader or package."""
    _known(group_by, "NONE", "BY_CLASS", "BY_CLASSLOADER", "BY_PACKAGE")
    rows = _top(snap, dom)
    if group_by == "NONE":
        return rows.select("object_id", "class_id", "shallow", "retained", "share")
    sums = [F.sum(c).cast("long").alias(c) for c in ("objects", "shallow", "retained")]
    per = _named(snap, rows.withColumn("objects", F.lit(1))).groupBy("class_id", "name", "loader_id").agg(*sums)
    if group_by == "BY_PACKAGE":
        return quantize.by_package(per, "name", *sums)
    return per.drop("class_id", "loader_id") if group_by == "BY_CLASS" else per.groupBy("loader_id").agg(*sums)


@command
def retained_by_class(snap: Snapshot, dom: graph.Dominance) -> DataFrame:
    """Least retained size of each class: its top ancestors' retained sizes summed."""
    return _named(snap, dom.class_sizes(snap.objects, snap.classes)).groupBy("name").agg(F.sum("retained").cast("long").alias("retained"))


@command
def immediate_dominators(snap: Snapshot, dom: graph.Dominance, ids: DataFrame, skip: str = SKIP) -> DataFrame:
    """Classes of the nearest dominators of ids: different dominators, objects dominated, net sizes."""
    names = _named(snap, snap.objects).select("object_id", F.col("name").alias("label"))
    near = dom.nearest(ids, names, skip).join(snap.objects.select("object_id", F.col("shallow").alias("below")), "object_id")
    # Each dominator first, so that it counts once.
    each = near.groupBy("dominator_id").agg(quantize.count().alias("n"), F.sum("below").alias("below"))
    own = snap.objects.select(F.col("object_id").alias("dominator_id"), "class_id", "shallow")
    met = each.join(own, "dominator_id", "left").join(F.broadcast(snap.classes.select("class_id", "name")), "class_id", "left")
    return met.groupBy(F.coalesce("name", F.lit("<ROOT>")).alias("name")).agg(
        F.count("dominator_id").alias("dominators"), F.sum("n").cast("long").alias("dominated"),
        F.coalesce(F.sum("shallow"), F.lit(0)).cast("long").alias("dominator_size"), F.sum("below").cast("long").alias("dominated_size"),
    )


@command
def big_drops_in_dominator_tree(snap: Snapshot, dom: graph.Dominance, percent: float = 1.0) -> DataFrame:
    """Objects whose retained size exceeds their greatest child's by more than percent of the heap; so do leaves below the top level."""
    rows = dom.table(snap.objects).select("object_id", "dominator_id", "retained")
    child = rows.where("dominator_id is not null").groupBy(F.col("dominator_id").alias("object_id")).agg(F.max("retained").alias("child"), quantize.count().alias("children"))
    heap = snap.objects.agg(F.sum("shallow").alias("heap"))
    met = rows.join(child, "object_id", "left").where("child is not null or dominator_id is not null")
    met = met.withColumn("child", F.coalesce("child", F.lit(0))).withColumn("children", F.coalesce("children", F.lit(0))).crossJoin(F.broadcast(heap))  # one row
    return met.withColumn("drop_size", F.col("retained") - F.col("child")).where(F.col("drop_size") > percent / 100 * F.col("heap")).select("object_id", "retained", F.col("child").alias("biggest_child"), "drop_size", "children")


@command
def top_consumers(snap: Snapshot, dom: graph.Dominance, percent: float = 1.0) -> DataFrame:
    """Top-level dominators that retain more than percent of the heap."""
    return dominator_tree(snap, dom).where(F.col("share") > percent / 100)


@command
def top_consumers_grouped(snap: Snapshot, dom: graph.Dominance, group_by: str = "BY_CLASS", percent: float = 1.0) -> DataFrame:
    """Classes, loaders or packages whose top-level dominators retain more than percent of the heap."""
    heap = snap.objects.agg(F.sum("shallow").alias("heap"))
    return dominator_tree(snap, dom, group_by).crossJoin(F.broadcast(heap)).where(F.col("retained") > percent / 100 * F.col("heap")).drop("heap")  # one row


@command
def pie_biggest_objects(snap: Snapshot, dom: graph.Dominance) -> DataFrame:
    """The biggest top-level dominators: three at least, up to ten while they hold under a quarter of the heap, none under 1 %."""
    top = dominator_tree(snap, dom).orderBy(F.desc("retained"), "object_id").limit(10)
    w = Window.orderBy(F.desc("retained"), "object_id")  # ten rows
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return ranked.where("(rank <= 3 or before < 0.25) and (rank <= 3 or share >= 0.01)").drop("before")


@command
def find_leaks(snap: Snapshot, dom: graph.Dominance, threshold_percent: float = 20.0) -> DataFrame:
    """Suspects: single top-level dominators over the threshold, and classes whose other ones are together."""
    top = _named(snap, dominator_tree(snap, dom))
    single = top.where(F.col("share") > threshold_percent / 100)
    rest = top.where(F.col("share") <= threshold_percent / 100).groupBy("name").agg(quantize.count().alias("objects"), F.sum("retained").cast("long").alias("retained"), F.sum("share").alias("share"))
    groups = rest.where(F.col("share") > threshold_percent / 100)
    return single.select(F.lit("object").alias("kind"), "name", "object_id", F.lit(1).cast("long").alias("objects"), "retained").union(
        groups.select(F.lit("class").alias("kind"), "name", F.lit(None).cast("long").alias("object_id"), "objects", "retained")
    )


@command
def accumulation_point(snap: Snapshot, dom: graph.Dominance, ids: DataFrame, ratio: float = 0.7, max_depth: int = 1000) -> DataFrame:
    """From each object down to its biggest child while that keeps `ratio` of the size; null past max_depth.

    Whether to go on depends on the object alone, so descents are chains of such links: they advance by doubling,
    and a descent of n takes log n rounds.
    """
    rows = dom.table(snap.objects)
    retained = rows.select("object_id", "retained")
    child = rows.where("dominator_id is not null")
    best = child.groupBy("dominator_id").agg(F.max_by(F.struct("object_id", "retained"), F.struct("retained", -F.col("object_id"))).alias("c"))
    inner = rows.where(dom.above).select(F.col("object_id").alias("dominator_id"), "retained")
    best = best.join(inner, "dominator_id").where(F.col("c.retained") >= ratio * F.col("retained"))
    down = graph.materialize(best.select(F.col("dominator_id").alias("at"), F.col("c.object_id").alias("end"), F.lit(1).cast("long").alias("steps")), "descent")
    span = 1  # steps that a link goes down, unless its descent ends before
    while span < max_depth:
        far = down.select(F.col("at").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        longer = down.join(far, "end", "left")
        if longer.where("further is not null").isEmpty():
            break
        down = graph.materialize(longer.select("at", F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "descent", instead_of=down)
        span *= 2
    met = ids.select("object_id").join(retained.select("object_id"), "object_id").join(down.withColumnRenamed("at", "object_id"), "object_id", "left")
    return met.select("object_id", F.when(F.coalesce("steps", F.lit(0)) < max_depth, F.coalesce("end", "object_id")).alias("point"))


@command
def gc_roots(snap: Snapshot) -> DataFrame:
    """(root_type, name, objects): an object counts under each of its types."""
    bits = F.filter(F.array(*[F.when(F.col("type").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(ROOT_TYPES)]), lambda t: t.isNotNull())
    typed = snap.roots.select("object_id", F.explode(bits).alias("root_type")).distinct()
    return _named(snap, typed.join(snap.objects, "object_id")).groupBy("root_type", "name").agg(quantize.count().alias("objects"))


@command
def class_references(snap: Snapshot, ids: DataFrame, inbound: bool = False) -> DataFrame:
    """Neighbours of a set by class."""
    near = graph.inbound(snap.refs, ids) if inbound else graph.outbound(snap.refs, ids)
    return histogram(snap, near)


def _forest(tree: DataFrame, forest: Forest | None) -> Forest:
    return forest or Forest(tree.select("object_id", "parent_id"), tree.select("object_id", "depth"))


def _passed(snap: Snapshot, tree: DataFrame, ids: DataFrame, forest: Forest | None) -> DataFrame:
    """(object_id, parent_id, depth, name, n): objects on the shortest paths of ids, and how many of these pass them."""
    own = ids.groupBy("object_id").agg(quantize.count().alias("n")).join(tree.select("object_id"), "object_id", "left_semi")
    below = _forest(tree, forest).subtree_sums(own, "n")
    return _named(snap, tree.join(below, "object_id").join(snap.objects.select("object_id", "class_id"), "object_id")).select("object_id", "parent_id", "depth", "name", "n")


@command
def merge_shortest_paths(snap: Snapshot, tree: DataFrame, ids: DataFrame, forest: Forest | None = None) -> DataFrame:
    """Shortest paths of ids from the roots, by class at each depth: (depth, name, objects on paths, ids below them).

    Ids are counted up the tree, so there is one row an object, not one for each step of each path.
    """
    return _passed(snap, tree, ids, forest).groupBy("depth", "name").agg(quantize.count().alias("on_path"), F.sum("n").cast("long").alias("referenced"))


@command
def grouped_paths(snap: Snapshot, tree: DataFrame, ids: DataFrame, group_by: str = "FROM_GC_ROOTS_BY_CLASS", forest: Forest | None = None) -> DataFrame:
    """Shortest paths of ids from the roots as a tree: (level, path, name, on_path, referenced), a row a node.

    FROM_GC_ROOTS merges objects (path: the object's id), FROM_GC_ROOTS_BY_CLASS equal sequences of classes from
    the roots down, FROM_OBJECTS_BY_CLASS those from the objects up.  on_path: different objects at the node;
    referenced: ids whose path passes it; ids that roots don't reach have no path.  By class, a level of the result
    comes from the one before: objects that share their sequence and, on the way up, their place, go on as one
    row, and only the groups hold texts.
    """
    _known(group_by, "FROM_GC_ROOTS", "FROM_GC_ROOTS_BY_CLASS", "FROM_OBJECTS_BY_CLASS")
    ids = ids.select("object_id").distinct()
    passed = graph.materialize(_passed(snap, tree, ids, forest), "passed")
    if group_by == "FROM_GC_ROOTS":
        return passed.select(F.col("depth").alias("level"), F.col("object_id").cast("string").alias("path"), "name", F.lit(1).cast("long").alias("on_path"), F.col("n").alias("referenced"))
    down = group_by == "FROM_GC_ROOTS_BY_CLASS"
    sums = [F.countDistinct("object_id").alias("on_path"), F.sum("n").cast("long").alias("referenced")]
    if down:
        now = passed.where("parent_id is null").select("object_id", "name", "n", F.xxhash64("name").alias("group"))
    else:
        now = passed.join(ids, "object_id", "left_semi").select("object_id", "name", F.lit(1).cast("long").alias("n"), F.xxhash64("name").alias("group"))
    out, texts, level = [], None, 0
    now = graph.materialize(now, "front")
    while True:
        # a group's own row: its class, and the text of the group that it goes on from
        groups = now.groupBy("group", "name", *(["before"] if texts is not None else [])).agg(*sums)
        if texts is None:
            groups = groups.withColumn("path", F.col("name"))
        else:
            groups = groups.join(texts.select(F.col("group").alias("before"), F.col("path").alias("head")), "before").withColumn("path", F.concat("head", F.lit(">"), "name"))
        texts, seen = graph.counted(groups.select("group", "path", "name", "on_path", "referenced"), "groups")
        if not seen["rows"]:
            return reduce(DataFrame.unionByName, out)
        out.append(texts.select(F.lit(level).alias("level"), "path", "name", "on_path", "referenced"))
        if down:
            step = passed.join(now.select(F.col("object_id").alias("parent_id"), F.col("group").alias("before")), "parent_id")
        else:
            up = now.join(passed.select("object_id", "parent_id"), "object_id").where("parent_id is not null").groupBy(F.col("parent_id").alias("object_id"), F.col("group").alias("before")).agg(F.sum("n").alias("n"))
            step = up.join(passed.select("object_id", "name"), "object_id")
        level += 1
        now = graph.materialize(step.select("object_id", "name", "n", "before", F.xxhash64("before", "name").alias("group")), "front", instead_of=now)


@command
def immediate_dominated(snap: Snapshot, dom: graph.Dominance, ids: DataFrame) -> DataFrame:
    """(dominator_id, object_id, class_id, shallow, retained): what each of ids dominates immediately."""
    rows = dom.table(snap.objects).where("known").join(ids.select(F.col("object_id").alias("dominator_id")).distinct(), "dominator_id", "left_semi")
    return rows.select("dominator_id", "object_id", "class_id", "shallow", "retained")


@command
def leakhunter(snap: Snapshot, dom: graph.Dominance, tree: DataFrame, threshold_percent: float = 20.0, ratio: float = 0.7, common: float = 0.8, forest: Forest | None = None) -> DataFrame:
    """Suspects of find_leaks and where they pile up: (kind, name, object_id, objects, retained, point, point_name).

    A single object's point is its accumulation point; a group's is the deepest object, least id first, that the
    shortest paths of at least `common` of its members pass, null where there is none.  Groups are at most
    100 / threshold_percent.  Where dom holds the shortest paths, members are counted along its layers; else along forest.
    """
    found = graph.materialize(find_leaks(snap, dom, threshold_percent), "suspects")
    single = accumulation_point(snap, dom, found.where("kind = 'object'").select("object_id"), ratio)
    groups = F.broadcast(found.where("kind = 'class'").select("name", F.col("objects").alias("members")))
    top = _named(snap, _top(snap, dom)).where(F.col("share") <= threshold_percent / 100).join(groups, "name")
    if "parent_id" in top.columns:
        strict = dom.passing(top).join(groups, "name")
    else:
        members = graph.materialize(top.select("object_id", "name"), "members")
        forest = _forest(tree, forest)
        counts = forest.subtree_sums(members.select("object_id", "name", F.lit(1).cast("long").alias("n")).join(tree.select("object_id"), "object_id", "left_semi"), "n", ["name"])
        # a member's own path does not count for itself
        own = members.select("object_id", "name", F.lit(1).alias("own"))
        strict = counts.join(own, ["object_id", "name"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).join(groups, "name").join(tree.select("object_id", "depth"), "object_id")
    shared = strict.where(F.col("n") >= common * F.col("members")).groupBy("name").agg(F.max_by("object_id", F.struct("depth", -F.col("object_id"))).alias("shared"))
    met = found.join(single, "object_id", "left").join(shared.withColumn("kind", F.lit("class")), ["kind", "name"], "left").withColumn("point", F.coalesce("point", "shared"))
    point = _named(snap, snap.objects.join(F.broadcast(met.select(F.col("point").alias("object_id")).distinct()), "object_id", "left_semi")).select(F.col("object_id").alias("point"), F.col("name").alias("point_name"))
    return met.join(point, "point", "left").select("kind", "name", "object_id", "objects", "retained", "point", "point_name")


@command
def unreachable_objects(snap: Snapshot) -> DataFrame:
    return histogram(snap, graph.unreachable(snap.objects, snap.refs, snap.roots))


def left_over(snap: Snapshot, reached: DataFrame) -> DataFrame:
    """histogram() of the objects that are not among reached (class_id, shallow, known), rows of Dominance: two counts by class, subtracted."""
    counts = lambda df: df.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.count("shallow").alias("sized"), F.coalesce(F.sum("shallow").cast("long"), F.lit(0)).alias("bytes"))
    own = counts(snap.objects).unionByName(counts(reached.where("known")).select("class_id", *[(-F.col(c)).alias(c) for c in ("n", "sized", "bytes")]))
    left = own.groupBy("class_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "sized", "bytes")]).where("n > 0")
    return _named(snap, left).select("name", F.col("n").alias("objects"), F.when(F.col("sized") > 0, F.col("bytes")).alias("shallow"))


@command
def heap_dump_overview(snap: Snapshot) -> DataFrame:
    """(objects, heap, classes, loaders, roots) in one row."""
    o = snap.objects.agg(quantize.count().alias("objects"), F.sum("shallow").cast("long").alias("heap"))
    c = snap.classes.agg(quantize.count().alias("classes"), F.countDistinct("loader_id").alias("loaders"))
    r = snap.roots.agg(F.countDistinct("object_id").alias("roots"))
    return o.crossJoin(c).crossJoin(r)  # one row each


@command
def duplicate_classes(classes: DataFrame, name: str = "name", loader: str = "loader_id") -> DataFrame:
    """Names that several classes share."""
    return classes.groupBy(name).agg(quantize.count().alias("definitions"), F.countDistinct(loader).alias("loaders")).where("definitions > 1")


@command
def classloader_explorer(snap: Snapshot) -> DataFrame:
    """Loaders with their classes and instances."""
    per = snap.objects.groupBy("class_id").agg(quantize.count().alias("instances"))
    return snap.classes.join(per, "class_id", "left").groupBy("loader_id").agg(quantize.count().alias("classes"), quantize.total("instances").alias("instances"))


@command
def group_by_value(df: DataFrame, field: str, shallow: Column) -> DataFrame:
    """(value, objects, shallow, average) of the objects' text or field value."""
    return df.groupBy(F.col(field).alias("value")).agg(quantize.count().alias("objects"), F.sum(shallow).cast("long").alias("shallow"), F.avg(shallow).alias("average"))


@command
def find_strings(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """Objects whose whole text matches."""
    return df.where(F.coalesce(F.col(field).rlike(whole(smart_fix(pattern))), F.lit(False)))


@command
def array_fill_ratio(df: DataFrame, array: str, segments: int = 5) -> DataFrame:
    """Arrays by the share of their elements that are neither null nor 0: counts and wasted elements."""
    used = F.size(F.filter(array, lambda x: x.isNotNull() & (x != 0)))
    n = F.size(array)
    ratio = F.when(n > 0, used / F.when(n > 0, n)).otherwise(1.0)
    rows = df.where(F.col(array).isNotNull()).select(quantize.linear_double(ratio, 0.0, 1.0000000001, 1.0000000001 / segments).alias("fill"), n.alias("n"), used.alias("used"))
    return rows.groupBy(F.round("fill", 6).alias("fill")).agg(quantize.count().alias("arrays"), F.sum("n").cast("long").alias("elements"), F.sum(F.col("n") - F.col("used")).cast("long").alias("wasted"))


@command
def arrays_grouped_by_size(df: DataFrame, array: str, element_bytes: int) -> DataFrame:
    n = F.size(array).cast("long")
    return df.where(F.col(array).isNotNull()).select(n.alias("length")).groupBy("length").agg(quantize.count().alias("arrays"), F.sum(F.col("length") * element_bytes + 16).cast("long").alias("shallow"))


@command
def primitive_arrays_with_a_constant_value(df: DataFrame, array: str) -> DataFrame:
    """(length, value, arrays) of arrays whose elements are all equal."""
    flat = df.where((F.size(array) > 0) & (F.array_min(array) == F.array_max(array)))
    return flat.groupBy(F.size(array).cast("long").alias("length"), F.array_min(array).alias("value")).agg(quantize.count().alias("arrays"))


@command
def hash_entries(df: DataFrame, keep: Sequence[str], entries: Column) -> DataFrame:
    """(keep, key, value): a row for each entry of a map column."""
    return df.select(*keep, F.explode(entries).alias("key", "value"))


@command
def hash_set_values(df: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    """(keep, value): the different values of each set, where a row is a set's entry; null is a value too."""
    return df.select(*keep, F.col(value).alias("value")).distinct()


@command
def extract_list_values(df: DataFrame, keep: Sequence[str], array: str) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias("at", "value"))


@command
def collections_grouped_by_size(df: DataFrame, size: Column) -> DataFrame:
    return df.groupBy(size.cast("long").alias("size")).agg(quantize.count().alias("collections"))


@command
def map_collision_ratio(df: DataFrame, keep: Sequence[str], key: str, buckets: int, segments: int = 5) -> DataFrame:
    """Maps (groups of rows by keep) by the share of their keys that find a bucket taken."""
    own = df.select(*keep, key).distinct().groupBy(*keep).agg(quantize.count().alias("size"), F.countDistinct(F.pmod(F.col(key), F.lit(buckets))).alias("used"))
    ratio = (F.col("size") - F.col("used")) / F.col("size")
    return own.select(F.round(quantize.linear_double(ratio, 0.0, 1.0000000001, 1.0000000001 / segments), 6).alias("ratio"), "size").groupBy("ratio").agg(quantize.count().alias("maps"), F.sum("size").cast("long").alias("entries"))


@command
def waste_in_char_arrays(fragments: DataFrame, minimum: int = 50) -> DataFrame:
    """Arrays with more than `minimum` elements outside the fragments that texts use of them.

    fragments: (array_id, length, first, size).  Fragments are merged as intervals along their order, dealt by
    ranges, so an array that very many texts share is swept by many tasks.
    """
    ends = fragments.select("array_id", "length", "first", "size", (F.col("first") + F.col("size")).alias("end"))
    ran = running(ends, ["first", "size"], "end", "reach", "max", within=["array_id"])
    new = ran.withColumn("adds", F.greatest(F.lit(0), F.col("end") - F.greatest("reach", "first", F.lit(0))))
    return new.groupBy("array_id", "length").agg(F.sum("adds").cast("long").alias("used")).withColumn("waste", F.col("length") - F.col("used")).where(F.col("waste") > minimum)


@command
def waste_by_referrers(referrers: DataFrame, minimum: int = 50) -> DataFrame:
    """(array_id, length, used, waste): arrays whose referrers are all texts, each of which leaves `minimum` elements or more.

    referrers: (array_id, length, is_text, first, size), a row each; null first counts as 0, null size as the rest.
    Shorter arrays, and those that something else refers to or that one text nearly fills, have no waste; an array
    with one text has what that leaves, others what all fragments leave, if it exceeds `minimum`.
    """
    first = F.coalesce("first", F.lit(0))
    rows = referrers.select("array_id", "length", F.coalesce("is_text", F.lit(False)).alias("is_text"), first.cast("long").alias("first"), F.coalesce("size", F.col("length") - first).cast("long").alias("size"))
    fit = F.col("is_text") & (F.col("length") - F.col("size") >= minimum)
    judged = rows.where(F.col("length") >= minimum).groupBy("array_id").agg(F.bool_and(fit).alias("fit"), quantize.count().alias("texts")).where("fit")
    wasted = waste_in_char_arrays(rows.join(judged.select("array_id"), "array_id", "left_semi").select("array_id", "length", "first", "size"), -1)
    return wasted.join(judged, "array_id").where((F.col("texts") == 1) | (F.col("waste") > minimum)).select("array_id", "length", "used", "waste")


@command
def reference_statistics(snap: Snapshot, referents: DataFrame, references: DataFrame, fields: list[str], edges: DataFrame | None = None, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histograms of the referents, of what the references retain by `fields`, and of referents held strongly by them.

    edges, tree: edges_of() the references and breadth_first() from the roots, where they are known.
    """
    edges = graph.edges_of(snap.refs) if edges is None else edges
    tree = graph.breadth_first(edges, snap.roots) if tree is None else tree
    only = materialize(graph.retained_by_fields(snap.refs, snap.roots, references, fields, tree), "retained")
    full = graph.retained_set(snap.objects, edges, snap.roots, references, tree)
    strong = referents.join(full.join(only, "object_id", "left_anti"), "object_id", "left_semi")
    return histogram(snap, referents), histogram(snap, only), histogram(snap, strong)


def run(name: str, *args, **kwargs):
    """A command by its name."""
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name}; known: {', '.join(sorted(COMMANDS))}")
    return COMMANDS[name](*args, **kwargs)
