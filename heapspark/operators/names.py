"""Display names of objects: templates for classes, filled with what an object's fields refer to."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.snapshot import Snapshot, class_ancestors
from ..plans.store import counted, discard, join_counted, materialize
from .inspections import command

#: Class and field names of the Java library.  {self} is the object's own label, {field} the name of what that field refers to.
TEMPLATES: Mapping[str, str] = {
    "java.lang.String": "{self}",
    "java.lang.Number": "{self}",
    "java.lang.Boolean": "{self}",
    "java.lang.Character": "{self}",
    "java.lang.AbstractStringBuilder": "{value}",
    "java.lang.Thread": "{name}",
    "java.lang.ThreadGroup": "{name}",
    "java.lang.Throwable": "{detailMessage}",
    "java.lang.StackTraceElement": "{declaringClass}.{methodName}({fileName})",
    "java.lang.ref.Reference": "{referent}",
    "java.lang.reflect.Field": "{clazz}.{name}",
    "java.lang.reflect.Method": "{clazz}.{name}",
    "java.util.concurrent.atomic.AtomicReference": "{value}",
    "java.util.Locale": "{language}_{country}",
    "java.util.jar.Attributes$Name": "{name}",
    "java.util.logging.Level": "{name}",
    "java.io.File": "{path}",
    "java.net.URI": "{string}",
    "java.net.URL": "{protocol}://{host}{file}",
}


def _pieces(template: str) -> list[tuple[str, str | None]]:
    """(text, the field after it, if any)."""
    return [(text, field) for text, field, _, _ in Formatter().parse(template)]


def _forwards(template: str) -> bool:
    """Whether the name is that of one field's object and nothing else."""
    pieces = _pieces(template)
    return len(pieces) == 1 and pieces[0][0] == "" and pieces[0][1] not in (None, "self")


def rule_of_class(classes: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """(class_id, rule): the nearest class among a class and its superclasses that has a template, by its name."""
    near = class_ancestors(classes).join(classes.select(F.col("class_id").alias("ancestor_id"), F.col("name").alias("rule")), "ancestor_id")
    return near.where(F.col("rule").isin(*templates)).groupBy("class_id").agg(F.min_by("rule", "distance").alias("rule"))


def _meet(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """rows with the columns of keyed, one row for each target; popular targets are dealt over tasks."""
    each = rows.groupBy("target").agg(F.count(F.lit(1)).alias("__times"))
    total = rows.count()
    return join_counted(rows, keyed.join(each, "target"), ["target"], "__times", total, "object_id", "left").drop("__times")


def _ends(steps: DataFrame) -> DataFrame:
    """steps (object_id, rule, field, target) with the end of each chain as target, by doubling; objects on or before a cycle are left out."""
    at, seen = counted(steps, "name-steps", moving=F.count(F.lit(1)))
    for _ in range(seen["rows"].bit_length() + 1):
        ahead = at.select(F.col("object_id").alias("target"), F.col("target").alias("further"))
        moved = _meet(at.select("object_id", "rule", "field", "target"), ahead)
        at, seen = counted(moved.select("object_id", "rule", "field", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), "name-steps", at, moving=F.count_if("moved"))
        if not seen["moving"]:
            break
    return at.where(~F.col("moved")).drop("moved")


def _filled(templates: Mapping[str, str], fields: list[str]) -> Column:
    """The template of `rule` with the columns part_i of fields; a part that is missing reads as nothing, without any part there is no name."""
    out = F.lit(None).cast("string")
    for rule, template in templates.items():
        parts, given = [], []
        for text, field in _pieces(template):
            parts.append(F.lit(text))
            if field is not None:
                value = F.col("label") if field == "self" else F.col(f"part_{fields.index(field)}")
                parts.append(F.coalesce(value, F.lit("")))
                given.append(value)
        text = F.concat(*parts)
        out = F.when(F.col("rule") == rule, F.when(F.coalesce(*given).isNotNull(), text) if given else text).otherwise(out)
    return out


@command
def display_names(snap: Snapshot, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(object_id, display_name) of every object whose class, or nearest superclass with one, has a template that yields a name.

    A field that refers to several objects counts by the least id.  Chains of objects that only pass on the name of
    one field advance by doubling, whatever their length.  Other templates are filled in rounds: an object waits for the
    objects that its fields refer to, so there are as many rounds as such templates nest.  Objects that wait for
    themselves have no name, nor have those without any part; a part without a name reads as nothing.
    A null label is a missing part.  Empty snapshots give no rows.
    """
    fields = sorted({f for t in templates.values() for _, f in _pieces(t) if f not in (None, "self")})
    rules = F.broadcast(rule_of_class(snap.classes, templates))  # one row a class
    objects = materialize(snap.objects.join(rules, "class_id").select("object_id", "rule", F.col("label").cast("string").alias("label")), "name-objects")
    uses = [(r, f) for r, t in templates.items() for _, f in _pieces(t) if f not in (None, "self")]
    pairs = reduce(Column.__or__, [(F.col("rule") == r) & (F.col("name") == f) for r, f in uses], F.lit(False))
    met = snap.refs.select(F.col("src_id").alias("object_id"), "name", F.col("dst_id").alias("target")).join(objects.select("object_id", "rule"), "object_id").where(pairs)
    edges = materialize(met.groupBy("object_id", "rule", F.col("name").alias("field")).agg(F.min("target").alias("target")), "name-edges")
    passing = [r for r, t in templates.items() if _forwards(t)]
    ended = _ends(edges.where(F.col("rule").isin(*passing)))
    edges = materialize(edges.where(~F.col("rule").isin(*passing)).unionByName(ended), "name-edges", edges)
    discard(ended)
    # objects without such fields are named at once, the others wait
    waiting = materialize(objects.join(edges.select("object_id").distinct(), "object_id", "left_semi"), "names-wait")
    cyclic = objects.where(F.col("rule").isin(*passing))  # nothing but the field names them
    plain = objects.join(waiting, "object_id", "left_anti").join(cyclic, "object_id", "left_anti")
    empty = [F.lit(None).cast("string").alias(f"part_{i}") for i in range(len(fields))]
    done = [materialize(plain.select("*", *empty).select("object_id", _filled(templates, fields).alias("display_name")).where("display_name is not null"), "names")]
    while True:
        blocked = edges.join(waiting.select(F.col("object_id").alias("target")), "target", "left_semi").join(waiting, "object_id", "left_semi").select("object_id").distinct()
        ready, seen = counted(waiting.join(blocked, "object_id", "left_anti"), "names-ready")
        if not seen["rows"]:
            discard(ready)
            break
        named = reduce(DataFrame.unionByName, done)
        parts = _meet(edges.select("object_id", "field", "target").join(ready, "object_id", "left_semi"), named.withColumnRenamed("object_id", "target"))
        wide = parts.groupBy("object_id").agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.when(F.col("field") == f, F.col("display_name"))).alias(f"part_{i}") for i, f in enumerate(fields)])
        done.append(materialize(ready.join(wide, "object_id").select("object_id", _filled(templates, fields).alias("display_name")).where("display_name is not null"), "names"))
        waiting = materialize(waiting.join(ready, "object_id", "left_anti"), "names-wait", waiting)
        discard(ready)
    discard(waiting, edges, objects)
    return reduce(DataFrame.unionByName, done)
