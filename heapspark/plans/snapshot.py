"""A snapshot: objects, classes, references and roots, each a DataFrame.

    objects  object_id, class_id, kind, label, shallow, array_len
    classes  class_id, name, super_id, loader_id, instance_size
    refs     src_id, dst_id, name
    roots    object_id, type (bit mask)

The driver's tables are an object graph too: a table is a class, a row an object, a foreign key a
reference, and regions are the roots of the ownership references.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Key offsets: object_id = key + offset, so that ids of different tables differ.  lineitem has no key; see lines().
OFFSET = {"region": 10**12, "nation": 2 * 10**12, "customer": 3 * 10**12, "supplier": 4 * 10**12, "orders": 5 * 10**12, "part": 6 * 10**12}
LINE = 7 * 10**12
KEY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
#: Bytes of an object's header and fixed fields.
SHALLOW = {"region": 24, "nation": 32, "customer": 48, "supplier": 40, "orders": 56, "part": 48, "lineitem": 96}
#: Package-qualified class names, superclasses and loaders of the driver's tables.
CLASSES = (
    (1, "java.lang.Object", None, 0, 16), (2, "shop.place.Place", 1, 1, 16), (3, "shop.party.Party", 1, 1, 16), (4, "shop.trade.Trade", 1, 2, 16),
    (11, "shop.place.Region", 2, 1, 24), (12, "shop.place.Nation", 2, 1, 32), (13, "shop.party.Customer", 3, 1, 48), (14, "shop.party.Supplier", 3, 1, 40),
    (15, "shop.trade.Order", 4, 2, 56), (16, "shop.trade.Part", 1, 2, 48), (17, "shop.trade.LineItem", 4, 2, 96),
)
CLASS_OF = {"region": 11, "nation": 12, "customer": 13, "supplier": 14, "orders": 15, "part": 16, "lineitem": 17}


@dataclass(frozen=True)
class Snapshot:
    objects: DataFrame
    classes: DataFrame
    refs: DataFrame
    roots: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def object_id(name: str, key: str | None = None) -> Column:
    return (F.col(key or KEY[name]).cast("long") + F.lit(OFFSET[name])).cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with object_id: equal rows are one object, identified by a hash of all columns.

    A hash needs no global order; a collision of two different lines has odds of n^2 / 2^62.  Rows that share the hash are
    one object, so the few columns that make objects and references meet, not whole rows.  They meet by order, so that an
    order's lines stay together and its key is compressed in all that is shuffled later; lines without an order are dealt by hash.
    """
    df = table(spark, sf_dir, "lineitem")
    named = df.select((F.lit(LINE) + F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(2**61))).alias("object_id"), "l_orderkey", "l_suppkey", "l_returnflag")
    lone = F.col("l_orderkey").isNull()
    dealt = named.select("object_id", F.when(lone, F.col("object_id")).otherwise(F.col("l_orderkey")).alias("dealt"), lone.alias("lone"), "l_suppkey", "l_returnflag")
    met = dealt.repartition("dealt").distinct().sortWithinPartitions("dealt")
    return met.select("object_id", F.when(~F.col("lone"), F.col("dealt")).alias("l_orderkey"), "l_suppkey", "l_returnflag")


def classes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{name}', {'null' if up is None else up}, {loader}, {size}L)" for i, name, up, loader, size in CLASSES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(class_id, name, super_id, loader_id, instance_size)")  # in the plan, without a job


def shop(spark: SparkSession, sf_dir: str, written: Callable[[str, DataFrame], DataFrame] | None = None) -> Snapshot:
    """The driver's tables as a snapshot.

    written: makes a named part a written table.  Lines are one, since they alone take a shuffle; objects and references are
    read from it and from the tables.
    """
    parts, edges = [], []
    for name in ("region", "nation", "customer", "supplier", "orders", "part"):
        df = table(spark, sf_dir, name)
        label = {"orders": F.col("o_orderpriority")}.get(name, F.col(f"{name[0]}_name") if name != "orders" else None)
        parts.append(df.select(object_id(name).alias("object_id"), F.lit(CLASS_OF[name]).alias("class_id"), label.alias("label"), F.lit(SHALLOW[name]).cast("long").alias("shallow")))
    line = lines(spark, sf_dir)
    if written is not None:
        line = written("lines", line)
    parts.append(line.select("object_id", F.lit(CLASS_OF["lineitem"]).alias("class_id"), F.col("l_returnflag").alias("label"), F.lit(SHALLOW["lineitem"]).cast("long").alias("shallow")))

    def edge(df: DataFrame, src: Column, dst: Column, name: str) -> DataFrame:
        return df.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(name).alias("name"))

    nation, customer, supplier, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    edges.append(edge(nation, object_id("region", "n_regionkey"), object_id("nation"), "nations"))
    edges.append(edge(customer, object_id("nation", "c_nationkey"), object_id("customer"), "customers"))
    edges.append(edge(supplier, object_id("nation", "s_nationkey"), object_id("supplier"), "suppliers"))
    edges.append(edge(orders, object_id("customer", "o_custkey"), object_id("orders"), "orders"))
    edges.append(edge(line, object_id("orders", "l_orderkey"), F.col("object_id"), "lines"))
    edges.append(edge(line, object_id("supplier", "l_suppkey"), F.col("object_id"), "supplied"))
    roots = table(spark, sf_dir, "region").select(object_id("region").alias("object_id"), F.lit(2).alias("type"))
    return Snapshot(reduce(DataFrame.unionByName, parts), classes(spark), reduce(DataFrame.unionByName, edges), roots)


#: An index of it writes only the parts that it names.
shop.names_parts = True


def class_ancestors(classes: DataFrame) -> DataFrame:
    """(class_id, ancestor_id, distance): every class with itself and its superclasses."""
    closure = reached = classes.select("class_id", F.col("class_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    parent = classes.where("super_id is not null").select(F.col("class_id").alias("ancestor_id"), F.col("super_id").alias("up"))
    while not (reached := reached.join(parent, "ancestor_id").select("class_id", F.col("up").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))).isEmpty():
        closure = closure.union(reached)
    return closure
