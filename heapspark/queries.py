"""The engine's operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import filters, values as v
from .operators import aggregates, bounds, class_tree, compare, contents, graph, inspections, names, pairing, quantize, reports, scans
from .plans import snapshot as snap
from .plans.snapshot import LINE, OFFSET, table
from .sources import results, snapshots
from .streaming import histogram as stream_histogram

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- selection, expressions, null and number semantics


@query("SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 AND regexp_full_match(o_orderpriority, '.*HIGH')")
def select_where(s, d):
    o = table(s, d, "orders")
    return o.where(v.where((F.col("o_totalprice") > 100000) & v.like(F.col("o_orderpriority"), ".*HIGH"))).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_type, '[A-M].*')")
def like_regex(s, d):
    return table(s, d, "part").where(v.like(F.col("p_type"), "[A-M].*")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size > 25 THEN p_type END IS NOT NULL AND NOT regexp_full_match(p_type, '[A-M].*')")
def not_like_null(s, d):
    x = F.when(F.col("p_size") > 25, F.col("p_type"))
    return table(s, d, "part").where(v.not_like(x, "[A-M].*")).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, floor(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / l_quantity END)::BIGINT AS unit,
          CASE WHEN l_linenumber - 1 = 0 THEN (CASE WHEN l_quantity = 0 THEN 'NaN' ELSE 'Infinity' END) ELSE 'finite' END AS ratio FROM lineitem""")
def arithmetic_divide(s, d):
    unit = v.divide(F.col("l_extendedprice"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    by_zero = v.divide(F.col("l_quantity"), F.col("l_linenumber") - 1)
    kind = F.when(F.isnan(by_zero), "NaN").when(by_zero == float("inf"), "Infinity").otherwise("finite")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(unit).alias("unit"), kind.alias("ratio"))


@query("""SELECT p_partkey, (((p_size::BIGINT * 100000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS wrapped,
          (p_size + 7)::BIGINT AS plus FROM part""")
def arithmetic_wraps(s, d):
    return table(s, d, "part").select("p_partkey", v.multiply(F.col("p_size"), F.lit(100_000_000), "int").cast("long").alias("wrapped"), v.add(F.col("p_size"), F.lit(7)).cast("long").alias("plus"))


@query("SELECT c_custkey, 'customer ' || coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'null') AS label FROM customer")
def concat_null(s, d):
    return table(s, d, "customer").select("c_custkey", v.concat(F.lit("customer "), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("label"))


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 7 END)")
def equality_null_safe(s, d):
    a, b = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 2 != 0, 7)
    return table(s, d, "customer").where(v.eq(a, b)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR length(c_mktsegment) > 9")
def truthy_or(s, d):
    return table(s, d, "customer").where(v.truthy(F.greatest(F.col("c_acctbal"), F.lit(0.0)), "double") | v.truthy(F.substring("c_mktsegment", 10, 99), "string")).select("c_custkey")


@query("SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def select_distinct(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).dropDuplicates()


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_regionkey::VARCHAR FROM region")
def union_all_mixed(s, d):
    r = table(s, d, "region")
    return scans.union(table(s, d, "nation").select(F.col("n_name").alias("name")), r.select("r_name"), r.select("r_regionkey"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION ALL SELECT DISTINCT s_nationkey FROM supplier")
def union_distinct_branches(s, d):
    return scans.union(table(s, d, "customer").select(F.col("c_nationkey").alias("k")).distinct(), table(s, d, "supplier").select("s_nationkey").distinct())


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def in_list(s, d):
    return table(s, d, "orders").where(v.in_array(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("P")))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_subselect(s, d):
    return scans.member_of(table(s, d, "orders"), "o_custkey", table(s, d, "customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def not_in_subselect(s, d):
    return scans.member_of(table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey", negate=True).select("c_custkey")


@query("""SELECT event_id, length(event_type)::BIGINT AS n, upper(event_type) AS up, substr(event_type, 2, 3) AS part, (instr(event_type, 'c') - 1)::BIGINT AS at,
          regexp_replace(event_type, '[aeiou]', '_', 'g') AS masked, event_type LIKE 'p%' AS starts FROM events""")
def string_methods(s, d):
    e = F.col("event_type")
    return table(s, d, "events").select(
        "event_id", v.call("length", e).cast("long").alias("n"), v.call("toUpperCase", e).alias("up"), v.call("substring", e, 1, 4).alias("part"),
        v.call("indexOf", e, F.lit("c")).cast("long").alias("at"), v.call("replaceAll", e, "[aeiou]", "_").alias("masked"), v.call("startsWith", e, "p").alias("starts"),
    )


@query(f"SELECT c_custkey, '0x' || lower(to_hex(c_custkey + {OFFSET['customer']})) AS address FROM customer")
def to_hex_address(s, d):
    return table(s, d, "customer").select("c_custkey", v.to_hex(snap.object_id("customer")).alias("address"))


# --- paths, arrays, sub-selects


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def path_2hop(s, d):
    o = scans.reference(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey")
    return scans.reference(o, "c_nationkey", table(s, d, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("""SELECT r_name, count(*)::BIGINT AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
          LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def path_4hop(s, d):
    df = table(s, d, "lineitem").select("l_orderkey")
    for column, name, key in (("l_orderkey", "orders", "o_orderkey"), ("o_custkey", "customer", "c_custkey"), ("c_nationkey", "nation", "n_nationkey"), ("n_regionkey", "region", "r_regionkey")):
        df = scans.reference(df, column, table(s, d, name), key)
    return df.groupBy("r_name").agg(quantize.count().alias("n"))


_EXTENT = " UNION ALL ".join(f"SELECT {OFFSET[t]} + {snap.KEY[t]} AS object_id, {snap.CLASS_OF[t]} AS class_id FROM {t}" for t in ("region", "nation", "customer", "supplier", "orders", "part"))
_PARTY = f"SELECT object_id::BIGINT AS object_id, class_id FROM ({_EXTENT}) WHERE class_id IN (%s)"


@query(_PARTY % "13")
def extent_exact(s, d):
    return scans.extent(snap.shop(s, d), "shop.party.Customer").select("object_id", "class_id")


@query(_PARTY % "13, 14")
def extent_instanceof(s, d):
    return scans.extent_with_subclasses(snap.shop(s, d), "shop.party.Party").select("object_id", "class_id")


@query(_PARTY % "11, 12")
def extent_regex(s, d):
    return scans.extent_like(snap.shop(s, d), r"shop\.place\..*").select("object_id", "class_id")


@query("SELECT 'shop.place.Place' AS name, 0::BIGINT AS objects UNION ALL SELECT 'shop.place.Region', count(*) FROM region UNION ALL SELECT 'shop.place.Nation', count(*) FROM nation")
def class_objects(s, d):
    """The classes themselves, with the number of their instances."""
    shop = snap.shop(s, d)
    per = shop.objects.groupBy("class_id").agg(quantize.count().alias("objects"))
    return scans.class_objects(shop, r"shop\.place\..*").join(per, "class_id", "left").select("name", F.coalesce("objects", F.lit(0)).alias("objects"))


@query(f"SELECT i.nr, i.object_id, n_name AS label FROM (VALUES (0, {OFFSET['nation'] + 3}), (1, {OFFSET['nation'] + 1}), (2, {OFFSET['nation'] + 3}), (3, 5)) i(nr, object_id) LEFT JOIN nation ON n_nationkey + {OFFSET['nation']} = i.object_id")
def objects_by_id(s, d):
    base = OFFSET["nation"]
    return scans.by_id(snap.shop(s, d), [base + 3, base + 1, base + 3, 5]).select(F.col("at").alias("nr"), "object_id", "label")


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, NULL::DOUBLE AS beyond, NULL::DOUBLE AS negative FROM embeddings")
def array_index(s, d):
    e = F.col("embedding")
    cells = {"first": v.item(e, 0), "last": v.item(e, 63), "beyond": v.item(e, 64), "negative": v.item(e, -1)}
    return table(s, d, "embeddings").select("vec_id", *[c.cast("double").alias(n) for n, c in cells.items()])


@query("SELECT vec_id, list_sum(embedding[1:4])::DOUBLE AS head, len(embedding[63:64])::BIGINT AS tail FROM embeddings")
def array_slice(s, d):
    head = F.aggregate(v.part(F.col("embedding"), 0, 3), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", head.alias("head"), F.size(v.part(F.col("embedding"), -2, -1)).cast("long").alias("tail"))


@query("""SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS k FROM orders GROUP BY o_custkey
          UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def subselect_flatten(s, d):
    own = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(own, "o_custkey", "left")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def outer_join_emulated(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey").eqNullSafe(F.col("o_custkey")), "full").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def correlated_subselect(s, d):
    per = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("most"))
    return table(s, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("SELECT DISTINCT o_custkey AS object_id FROM orders WHERE o_totalprice > 200000")
def select_objects_by_field(s, d):
    return scans.distinct_referents(table(s, d, "orders").where("o_totalprice > 200000"), "o_custkey")


# --- distributions


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def quantize_value(s, d):
    x = F.col("value")
    return quantize.by_value(table(s, d, "events"), ["event_type"], quantize.count().alias("n"), F.round(quantize.total(x, "double"), 2).alias("total"), quantize.least(x).alias("low"), quantize.greatest(x).alias("high"), F.round(quantize.average(x), 4).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2")
def quantize_multi_key(s, d):
    return quantize.by_value(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], quantize.count().alias("n"), F.round(quantize.total("l_quantity", "double"), 2).alias("quantity"), F.round(quantize.total("l_extendedprice", "double"), 2).alias("price"))


@query("""SELECT bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c_acctbal <= 0 THEN 0.0 WHEN c_acctbal > 8000 THEN 1.7976931348623157e308
          ELSE 8000 - floor((8000 - c_acctbal) / 1000) * 1000 END::DOUBLE AS bucket FROM customer) GROUP BY bucket""")
def quantize_linear_double(s, d):
    return table(s, d, "customer").select(quantize.linear_double(F.col("c_acctbal"), 0.0, 8000.0, 1000.0).alias("bucket")).groupBy("bucket").agg(quantize.count().alias("n"))


@query("""SELECT bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p_size <= 5 THEN 5 WHEN p_size > 45 THEN 9223372036854775807
          ELSE 5 + 10 * ((p_size - 1) // 10 + 1) END::BIGINT AS bucket FROM part) GROUP BY bucket""")
def quantize_linear_long(s, d):
    return table(s, d, "part").select(quantize.linear_long(F.col("p_size"), 5, 45, 10).alias("bucket")).groupBy("bucket").agg(quantize.count().alias("n"))


@query("""SELECT bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN x <= -2000 THEN -2000 WHEN x > 9000 THEN 9223372036854775807 ELSE -2000 + 1000 * (trunc((x - 1) / 1000.0)::BIGINT + 1) END::BIGINT AS bucket
          FROM (SELECT floor(c_acctbal)::BIGINT AS x FROM customer)) GROUP BY bucket""")
def quantize_linear_negative(s, d):
    """Ranges below 0: whole division is towards 0."""
    x = F.floor("c_acctbal")
    return table(s, d, "customer").select(quantize.linear_long(x, -2000, 9000, 1000).alias("bucket")).groupBy("bucket").agg(quantize.count().alias("n"))


@query("SELECT p_brand, (sum(p_size) // count(p_size))::BIGINT AS mean, arg_max(p_name, p_partkey) AS last FROM part GROUP BY p_brand")
def quantize_average_long(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(quantize.average_long("p_size").alias("mean"), quantize.latest("p_name", "p_partkey").alias("last"))


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice, sum(o_custkey)::BIGINT AS o_custkey FROM orders")
def totals_row(s, d):
    return quantize.totals(table(s, d, "orders"), "o_totalprice", "o_custkey").select(F.round("o_totalprice", 2).alias("o_totalprice"), "o_custkey")


_CLASS_OBJECTS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {cid} AS class_id, count(*)::BIGINT AS objects, (count(*) * {size})::BIGINT AS shallow FROM {src}"
    for name, cid, size, src in (
        ("shop.place.Region", 11, 24, "region"), ("shop.place.Nation", 12, 32, "nation"), ("shop.party.Customer", 13, 48, "customer"), ("shop.party.Supplier", 14, 40, "supplier"),
        ("shop.trade.Order", 15, 56, "orders"), ("shop.trade.Part", 16, 48, "part"), ("shop.trade.LineItem", 17, 96, "(SELECT DISTINCT * FROM lineitem)"),
    )
)


@query(f"SELECT name, objects, shallow FROM ({_CLASS_OBJECTS})")
def histogram_by_class(s, d):
    return inspections.histogram(_index(s, d).snap)


@query(f"""WITH h AS ({_CLASS_OBJECTS}), p AS (SELECT unnest(['shop', 'shop.' || split_part(name, '.', 2), name]) AS package, objects, shallow FROM h)
           SELECT package, sum(objects)::BIGINT AS objects, sum(shallow)::BIGINT AS shallow FROM p GROUP BY package""")
def histogram_by_package(s, d):
    return inspections.histogram(_index(s, d).snap, group_by="BY_PACKAGE")


@query(f"""WITH h AS ({_CLASS_OBJECTS}), u AS (SELECT * FROM h UNION ALL SELECT 'java.lang.Object', 1, objects, shallow FROM h
           UNION ALL SELECT 'shop.place.Place', 2, objects, shallow FROM h WHERE class_id IN (11, 12) UNION ALL SELECT 'shop.party.Party', 3, objects, shallow FROM h WHERE class_id IN (13, 14)
           UNION ALL SELECT 'shop.trade.Trade', 4, objects, shallow FROM h WHERE class_id IN (15, 17))
           SELECT name, sum(objects)::BIGINT AS objects, sum(shallow)::BIGINT AS shallow FROM u GROUP BY name""")
def histogram_by_superclass(s, d):
    return inspections.histogram(_index(s, d).snap, group_by="BY_SUPERCLASS")


@query(f"""WITH h AS (SELECT *, CASE WHEN class_id < 15 THEN 1 ELSE 2 END AS loader_id FROM ({_CLASS_OBJECTS}))
           SELECT loader_id, name, sum(objects)::BIGINT AS objects, sum(shallow)::BIGINT AS shallow FROM h GROUP BY GROUPING SETS ((loader_id), (loader_id, name))""")
def histogram_by_loader(s, d):
    return inspections.histogram(_index(s, d).snap, group_by="BY_CLASSLOADER")


@query("""SELECT 'shop.trade.Order' AS name, count(*)::BIGINT AS objects, (count(*) * 56)::BIGINT AS shallow FROM orders WHERE o_totalprice > 150000""")
def histogram_of_set(s, d):
    ids = table(s, d, "orders").where("o_totalprice > 150000").select(snap.object_id("orders").alias("object_id"))
    return inspections.histogram(_index(s, d).snap, ids)


# --- filters, order, limit


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 500")
def filter_numeric_range(s, d):
    return table(s, d, "customer").where(filters.numeric(F.col("c_acctbal"), "100..500")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 100 AND c_custkey % 5 <> 0)")
def filter_not_range_nan(s, d):
    x = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return table(s, d, "customer").where(filters.numeric(x, "!100..")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05")
def filter_percent(s, d):
    return table(s, d, "lineitem").where(filters.numeric(F.col("l_discount"), ">=5%", percent=True)).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1')")
def filter_text(s, d):
    return table(s, d, "part").where(filters.text(F.col("p_name"), "1")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk_sorted(s, d):
    return results.refine(table(s, d, "orders"), sort="o_totalprice=DESC,o_orderkey", limit=25).select("o_orderkey", "o_totalprice")


# --- comparison of tables: orders of years as snapshots


#: A snapshot for each of these years; orders before the first or after the last count with it, so none is left out.
_ALL_YEARS = tuple(range(1995, 2002))


def _years(s: SparkSession, d: str) -> list[DataFrame]:
    """A snapshot for each year of orders: counts and sums by priority."""
    o = table(s, d, "orders").withColumn("year", F.greatest(F.least(F.year("o_orderdate"), F.lit(_ALL_YEARS[-1])), F.lit(_ALL_YEARS[0])))
    per = o.groupBy(F.col("o_orderpriority").alias("key"), "year").agg(quantize.count().alias("n"), F.sum("o_custkey").cast("long").alias("size"))
    return [per.where(F.col("year") == y).select("key", "n", "size") for y in _ALL_YEARS]


def _each(cell: str, first: int = 1) -> str:
    """A list of SQL cells for the years after the first; {i} is the year's place, {p} the place before."""
    return ", ".join(cell.format(i=i, p=i - 1) for i in range(first, len(_ALL_YEARS)))


_CELLS = ", ".join(f"max(n) FILTER (WHERE y = {y}) AS n{i}, max(size) FILTER (WHERE y = {y}) AS s{i}" for i, y in enumerate(_ALL_YEARS))
_YEARS = f"""WITH o AS (SELECT o_orderpriority AS key, greatest(least(year(o_orderdate), {_ALL_YEARS[-1]}), {_ALL_YEARS[0]}) AS y, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS size FROM orders GROUP BY 1, 2),
 m AS (SELECT key, {_CELLS} FROM o GROUP BY key) """
_COMPARED = [f"n_{i}" for i in range(len(_ALL_YEARS))]


@query(_YEARS + f"SELECT key, {_each('n{i} AS n_{i}', 0)}, {_each('s{i} AS size_{i}', 0)} FROM m")
def compare_absolute(s, d):
    return compare.compare(_years(s, d), "key", ["n", "size"]).drop("nth")


@query(_YEARS + f"SELECT key, n0 AS n_0, {_each('n{i} - coalesce(n0, 0) AS n_{i}')} FROM m")
def compare_diff_first(s, d):
    return compare.compare(_years(s, d), "key", ["n"], "DIFF_TO_FIRST").drop("nth")


@query(_YEARS + f"SELECT key, n0 AS n_0, {_each('n{i} - coalesce(n{p}, 0) AS n_{i}')} FROM m")
def compare_diff_previous(s, d):
    return compare.compare(_years(s, d), "key", ["n"], "DIFF_TO_PREVIOUS").drop("nth")


@query(_YEARS + f"SELECT key, n0 AS n_0, {_each('n{i} - coalesce(n0, 0) AS n_{i}')}, {_each('round((n{i} - n0) / n0::DOUBLE, 6) AS r{i}')} FROM m")
def compare_ratio_first(s, d):
    out = compare.compare(_years(s, d), "key", ["n"], "DIFF_RATIO_TO_FIRST")
    return out.select("key", *_COMPARED, *[F.round(f"n_{i}_ratio", 6).alias(f"r{i}") for i in range(1, len(_ALL_YEARS))])


@query(_YEARS + f"SELECT key, {_each('round((n{i} - n{p}) / n{p}::DOUBLE, 6) AS r{i}')} FROM m")
def compare_ratio_previous(s, d):
    out = compare.compare(_years(s, d), "key", ["n"], "DIFF_RATIO_TO_PREVIOUS")
    return out.select("key", *[F.round(f"n_{i}_ratio", 6).alias(f"r{i}") for i in range(1, len(_ALL_YEARS))])


@query("""SELECT p_brand AS key, max(p_type) FILTER (WHERE p_size <= 25) AS kind_0, CASE WHEN max(p_type) FILTER (WHERE p_size > 25) IS DISTINCT FROM max(p_type) FILTER (WHERE p_size <= 25)
          THEN max(p_type) FILTER (WHERE p_size > 25) END AS kind_1 FROM part GROUP BY p_brand""")
def compare_text(s, d):
    """Text columns show their value where it changed."""
    p = table(s, d, "part")
    sides = [p.where(w).groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("kind")) for w in ("p_size <= 25", "p_size > 25")]
    return compare.compare(sides, "key", ["kind"], "DIFF_TO_FIRST").drop("nth")


@query("""WITH a AS (SELECT p_brand AS key, p_size AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS nth FROM part WHERE p_partkey % 2 = 0),
          b AS (SELECT p_brand AS key, p_size AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS nth FROM part WHERE p_partkey % 2 = 1)
          SELECT coalesce(a.key, b.key) AS key, coalesce(a.nth, b.nth)::BIGINT AS nth, a.x::BIGINT AS x_0, b.x::BIGINT AS x_1 FROM a FULL JOIN b ON a.key = b.key AND a.nth = b.nth""")
def compare_duplicate_keys(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").cast("long").alias("x"), "p_partkey")
    halves = [p.where(F.col("p_partkey") % 2 == i).select("key", "x") for i in (0, 1)]
    return compare.compare(halves, "key", ["x"]).withColumn("nth", F.col("nth").cast("long"))


def _set_query(op: str, sql: str):
    sql = f"""WITH a AS (SELECT c_nationkey AS key, list(c_custkey) AS ids FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT c_nationkey AS key, list(c_custkey) AS ids FROM customer WHERE c_mktsegment < 'F' GROUP BY 1),
      m AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.ids, []) AS a, coalesce(b.ids, []) AS b FROM a FULL JOIN b ON a.key = b.key), r AS (SELECT key, {sql} AS ids FROM m)
      SELECT key, len(ids)::BIGINT AS n, coalesce(list_sum(ids), 0)::BIGINT AS total FROM r"""

    def run(s, d):
        c = table(s, d, "customer")
        sides = [c.where(w).select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id")) for w in ("c_acctbal > 0", "c_mktsegment < 'F'")]
        return compare.set_totals(*sides, "key", "id", op)

    run.__name__ = f"setop_{op.lower()}"
    query(sql)(run)


_set_query("INTERSECTION", "list_filter(a, lambda x: list_contains(b, x))")
_set_query("UNION", "list_distinct(list_concat(a, b))")
_set_query("DIFFERENCE", "list_filter(a, lambda x: NOT list_contains(b, x))")
_set_query("REVERSE_DIFFERENCE", "list_filter(b, lambda x: NOT list_contains(a, x))")
_set_query("SYMMETRIC_DIFFERENCE", "list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))")


@query(_YEARS + f"SELECT key, coalesce(n{len(_ALL_YEARS) - 1}, 0) - coalesce(n0, 0) AS n, coalesce(s{len(_ALL_YEARS) - 1}, 0) - coalesce(s0, 0) AS size FROM m")
def delta_histogram(s, d):
    """The last year against the first."""
    before, *_, now = _years(s, d)
    return compare.histogram_difference(now, before, ["key"], ["n", "size"])


@query("""WITH a AS (SELECT c_nationkey AS key, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS size FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1),
          b AS (SELECT c_nationkey AS key, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS size FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1)
          SELECT a.key, a.n, a.size + b.size AS size FROM a JOIN b ON a.key = b.key AND a.n = b.n""")
def histogram_intersection(s, d):
    c = table(s, d, "customer")
    a, b = [c.where(F.col("c_custkey") % 2 == i).groupBy(F.col("c_nationkey").alias("key")).agg(quantize.count().alias("n"), F.sum("c_custkey").cast("long").alias("size")) for i in (0, 1)]
    return compare.histogram_intersection(a, b, ["key"], "n", "size")


# --- graph


def _index(s: SparkSession, d: str) -> snapshots.Indexed:
    """The tables as a written snapshot with its edges, shortest paths and dominators, shared by the session's queries."""
    return snapshots.indexed(s, d, snap.shop)


@query(f"SELECT DISTINCT ({OFFSET['orders']} + o_orderkey)::BIGINT AS object_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def outbounds_set(s, d):
    ids = table(s, d, "customer").where("c_nationkey = 7").select(snap.object_id("customer").alias("object_id"))
    return graph.outbound(_index(s, d).snap.refs, ids)


@query(f"SELECT DISTINCT ({OFFSET['customer']} + o_custkey)::BIGINT AS object_id FROM orders WHERE o_totalprice > 200000")
def inbounds_set(s, d):
    ids = table(s, d, "orders").where("o_totalprice > 200000").select(snap.object_id("orders").alias("object_id"))
    return graph.inbound(_index(s, d).snap.refs, ids)


@query("""WITH l AS (SELECT DISTINCT lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 200000)
          SELECT 'shop.trade.LineItem' AS name, count(*)::BIGINT AS objects, (count(*) * 96)::BIGINT AS shallow FROM l""")
def class_references(s, d):
    ids = table(s, d, "orders").where("o_totalprice > 200000").select(snap.object_id("orders").alias("object_id"))
    return inspections.class_references(_index(s, d).snap, ids)


@query("""WITH l AS (SELECT DISTINCT * FROM lineitem)
          SELECT depth, sum(n)::BIGINT AS n FROM (SELECT 0 AS depth, count(*) AS n FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
          UNION ALL SELECT 3, (SELECT count(*) FROM orders) + (SELECT count(*) FROM l)) GROUP BY depth""")
def reachability_bfs(s, d):
    return _index(s, d).tree.groupBy("depth").agg(quantize.count().alias("n"))


@query("SELECT 'shop.trade.Part' AS name, count(*)::BIGINT AS objects, (count(*) * 48)::BIGINT AS shallow FROM part")
def unreachable_objects(s, d):
    at = _index(s, d)
    return inspections.left_over(at.snap, at.dominance.rows)


_L = """WITH l AS (SELECT DISTINCT * FROM lineitem), j AS (SELECT c.c_nationkey AS cn, s.s_nationkey AS sn, a.n_regionkey AS cr, b.n_regionkey AS sr, l_orderkey, l_suppkey, o_custkey FROM l JOIN orders ON l_orderkey = o_orderkey
 JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey JOIN nation a ON c.c_nationkey = a.n_nationkey JOIN nation b ON s.s_nationkey = b.n_nationkey) """


@query(_L + """SELECT depth, name, count(DISTINCT k)::BIGINT AS on_path, count(*)::BIGINT AS referenced FROM (
  SELECT 0 AS depth, 'shop.place.Region' AS name, sr AS k FROM j UNION ALL SELECT 1, 'shop.place.Nation', sn FROM j UNION ALL SELECT 2, 'shop.party.Supplier', l_suppkey FROM j
  UNION ALL SELECT 3, 'shop.trade.LineItem', row_number() OVER () FROM j) GROUP BY 1, 2""")
def merged_shortest_paths(s, d):
    at = _index(s, d)
    shop = at.snap
    return inspections.merge_shortest_paths(shop, at.tree, shop.objects.where(F.col("class_id") == snap.CLASS_OF["lineitem"]), at.paths)


def _dominance(s: SparkSession, d: str) -> tuple[snap.Snapshot, graph.Dominance]:
    at = _index(s, d)
    return at.snap, at.dominance


@query(_L + f"""SELECT dominator, count(*)::BIGINT AS lines FROM (SELECT (CASE WHEN cn = sn THEN {OFFSET['nation']} + cn WHEN cr = sr THEN {OFFSET['region']} + cr END)::BIGINT AS dominator FROM j) GROUP BY dominator""")
def dominator_of_lineitem(s, d):
    dom = _index(s, d).dominance
    return dom.tree().where(F.col("object_id") >= LINE).groupBy(F.col("dominator_id").alias("dominator")).agg(quantize.count().alias("lines"))


_RETAINED = _L + f""", o AS (SELECT c_nationkey AS n, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 ns AS (SELECT n_nationkey AS k, n_regionkey AS r, 32 + 48 * (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 40 * (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)
  + 56 * coalesce((SELECT n_orders FROM o WHERE o.n = n_nationkey), 0) AS own FROM nation),
 nr AS (SELECT ({OFFSET['nation']} + k)::BIGINT AS object_id, (own + 96 * (SELECT count(*) FROM j WHERE cn = sn AND cn = k))::BIGINT AS retained, r FROM ns),
 rr AS (SELECT ({OFFSET['region']} + r_regionkey)::BIGINT AS object_id, (24 + coalesce((SELECT sum(own) FROM ns WHERE r = r_regionkey), 0) + 96 * (SELECT count(*) FROM j WHERE cr = sr AND cr = r_regionkey))::BIGINT AS retained FROM region) """


@query(_RETAINED + f"""SELECT object_id, retained, 1::BIGINT AS objects FROM (SELECT object_id, retained FROM nr UNION ALL SELECT object_id, retained FROM rr
  UNION ALL SELECT {OFFSET['customer']} + c_custkey, 48 + 56 * count(o_orderkey) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
  UNION ALL SELECT {OFFSET['supplier']} + s_suppkey, 40 FROM supplier UNION ALL SELECT {OFFSET['orders']} + o_orderkey, 56 FROM orders) UNION ALL SELECT NULL, 96, count(*) FROM l HAVING count(*) > 0""")
def retained_size(s, d):
    """Of every reachable object; lines, named by a hash that SQL lacks, are counted by their retained size."""
    named = F.when(F.col("object_id") < LINE, F.col("object_id")).alias("object_id")
    return _index(s, d).retained.groupBy(named, "retained").agg(quantize.count().alias("objects"))


@query()
def retained_size_all(s, d):
    """Of every reachable object.  No SQL: lines are named by a hash that DuckDB lacks; a test compares it with closed forms."""
    return _index(s, d).retained


@query(_RETAINED + f""", h AS (SELECT (SELECT sum(shallow) FROM ({_CLASS_OBJECTS})) AS heap), lone AS (SELECT count(*)::BIGINT AS n FROM j WHERE cr <> sr)
 SELECT 'shop.place.Region' AS name, count(*)::BIGINT AS objects, (count(*) * 24)::BIGINT AS shallow, sum(retained)::BIGINT AS retained FROM rr
 UNION ALL SELECT 'shop.trade.LineItem', n, n * 96, n * 96 FROM lone""")
def dominator_tree_by_class(s, d):
    return inspections.dominator_tree(*_dominance(s, d), group_by="BY_CLASS")


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})) SELECT object_id, retained FROM rr, h WHERE retained > 0.01 * heap""")
def top_consumers(s, d):
    return inspections.top_consumers(*_dominance(s, d), percent=1.0).select("object_id", "retained")


@query(_RETAINED + """SELECT 'shop.place.Region' AS name, sum(retained)::BIGINT AS retained FROM rr UNION ALL SELECT 'shop.place.Nation', sum(retained)::BIGINT FROM nr
 UNION ALL SELECT 'shop.party.Customer', (SELECT count(*) * 48 FROM customer) + (SELECT count(*) * 56 FROM orders) UNION ALL SELECT 'shop.party.Supplier', (SELECT count(*) * 40 FROM supplier)
 UNION ALL SELECT 'shop.trade.Order', (SELECT count(*) * 56 FROM orders) UNION ALL SELECT 'shop.trade.LineItem', (SELECT count(*) * 96 FROM l)""")
def retained_by_class(s, d):
    return inspections.retained_by_class(*_dominance(s, d))


@query(_L + """SELECT name, count(DISTINCT k)::BIGINT AS dominators, count(*)::BIGINT AS dominated, (count(DISTINCT k) * max(size))::BIGINT AS dominator_size, (count(*) * 96)::BIGINT AS dominated_size FROM (
  SELECT CASE WHEN cn = sn THEN 'shop.place.Nation' WHEN cr = sr THEN 'shop.place.Region' ELSE '<ROOT>' END AS name, CASE WHEN cn = sn THEN cn WHEN cr = sr THEN cr END AS k,
  CASE WHEN cn = sn THEN 32 WHEN cr = sr THEN 24 ELSE 0 END AS size FROM j) GROUP BY name""")
def immediate_dominators(s, d):
    shop, dom = _dominance(s, d)
    return inspections.immediate_dominators(shop, dom, shop.objects.where(F.col("class_id") == snap.CLASS_OF["lineitem"]))


@query(_L + f""", c AS (SELECT {OFFSET['customer']} + c_custkey AS object_id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT {OFFSET['supplier']} + s_suppkey FROM supplier WHERE s_nationkey = 7
  UNION ALL SELECT {OFFSET['orders']} + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 UNION ALL SELECT {OFFSET['nation']} + 7)
  SELECT 'other' AS kind, count(*)::BIGINT AS n, sum(object_id)::BIGINT AS total FROM c UNION ALL SELECT 'line', count(*), NULL FROM j WHERE cn = 7 AND sn = 7 HAVING count(*) > 0""")
def retained_set_of_nation(s, d):
    at = _index(s, d)
    shop = at.snap
    ids = s.createDataFrame([(OFFSET["nation"] + 7,)], "object_id long")
    out = graph.retained_set(shop.objects, at.edges, shop.roots, ids, at.tree)
    kind = F.when(F.col("object_id") >= LINE, "line").otherwise("other").alias("kind")
    return out.groupBy(kind).agg(quantize.count().alias("n"), F.sum(F.when(F.col("object_id") < LINE, F.col("object_id"))).alias("total"))


@query(_L + "SELECT 'shop.trade.LineItem' AS name, count(*)::BIGINT AS objects, (count(*) * 96)::BIGINT AS shallow FROM j WHERE cn = 7 AND sn = 7 HAVING count(*) > 0")
def retained_set_of_parties(s, d):
    """Retained by a nation's customers and suppliers together, without themselves and their orders: exact and larger than each one's."""
    at = _index(s, d)
    shop = at.snap
    ids = table(s, d, "customer").where("c_nationkey = 7").select(snap.object_id("customer").alias("object_id")).union(table(s, d, "supplier").where("s_nationkey = 7").select(snap.object_id("supplier")))
    return inspections.histogram(shop, graph.retained_set(shop.objects, at.edges, shop.roots, ids, at.tree).where(F.col("object_id") >= LINE))


@query(_L + "SELECT 'shop.trade.Order' AS name, count(*)::BIGINT AS objects, (count(*) * 56)::BIGINT AS shallow FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def retained_set_by_fields(s, d):
    shop = _index(s, d).snap
    ids = table(s, d, "customer").where("c_nationkey = 7").select(snap.object_id("customer").alias("object_id"))
    return inspections.histogram(shop, graph.retained_by_fields(shop.refs, shop.roots, ids, ["orders"]))


@query(_L + """SELECT 'shop.trade.LineItem' AS name, (SELECT count(*) FROM j WHERE cn = 7)::BIGINT AS objects, (SELECT count(*) * 96 FROM j WHERE cn = 7)::BIGINT AS shallow
 UNION ALL SELECT 'shop.trade.Order', count(*), count(*) * 56 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 UNION ALL SELECT 'shop.party.Customer', count(*), count(*) * 48 FROM customer WHERE c_nationkey = 7""")
def customized_retained_set(s, d):
    """What a nation's customers retain if references from suppliers don't count."""
    shop = _index(s, d).snap
    ids = table(s, d, "customer").where("c_nationkey = 7").select(snap.object_id("customer").alias("object_id"))
    return inspections.histogram(shop, graph.retained_excluding(shop.refs, shop.roots, ids, F.col("name") == "supplied"))


@query(f"SELECT ({OFFSET['nation']} + n_nationkey)::BIGINT AS object_id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {OFFSET['customer']} + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 AND c_acctbal < 0")
def top_ancestors(s, d):
    _, dom = _dominance(s, d)
    ids = table(s, d, "nation").where("n_regionkey = 1").select(snap.object_id("nation").alias("object_id")).union(table(s, d, "customer").where("c_acctbal < 0").select(snap.object_id("customer")))
    return dom.top_ancestors(ids)


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), cs AS (SELECT c_nationkey AS n, 48 + 56 * count(o_orderkey) AS size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey UNION ALL SELECT s_nationkey, 40 FROM supplier
   UNION ALL SELECT cn, 96 FROM j WHERE cn = sn),
 b AS (SELECT object_id, retained, (SELECT max(size) FROM cs WHERE n = object_id - {OFFSET['nation']}) AS child FROM nr UNION ALL
   SELECT object_id, retained, greatest((SELECT max(retained) FROM nr WHERE r = rr.object_id - {OFFSET['region']}), (SELECT max(96) FROM j WHERE cr = sr AND cn <> sn AND cr = rr.object_id - {OFFSET['region']})) FROM rr)
 SELECT object_id, retained, child::BIGINT AS biggest_child, (retained - child)::BIGINT AS drop_size FROM b, h WHERE retained - child > 0.01 * heap
 UNION ALL SELECT x.object_id, x.size, 0::BIGINT, x.size FROM (SELECT {OFFSET['supplier']} + s_suppkey AS object_id, 40::BIGINT AS size FROM supplier UNION ALL SELECT {OFFSET['orders']} + o_orderkey, 56::BIGINT FROM orders
  UNION ALL SELECT {OFFSET['customer']} + c_custkey, (CASE WHEN count(o_orderkey) = 0 THEN 48 ELSE 48 + 56 * (count(o_orderkey) - 1) END)::BIGINT FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) x, h WHERE x.size > 0.01 * heap""")
def big_drops(s, d):
    """Leaves too, where one is larger than the threshold (none at this threshold; a test has some)."""
    return inspections.big_drops_in_dominator_tree(*_dominance(s, d)).select("object_id", "retained", "biggest_child", "drop_size")


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), lone AS (SELECT count(*)::BIGINT AS n FROM j WHERE cr <> sr)
 SELECT 'object' AS kind, 'shop.place.Region' AS name, object_id, 1::BIGINT AS objects, retained FROM rr, h WHERE retained > 0.05 * heap
 UNION ALL SELECT 'class', 'shop.place.Region', NULL, count(*), sum(retained)::BIGINT FROM rr, h WHERE retained <= 0.05 * heap HAVING sum(retained) > 0.05 * max(heap)
 UNION ALL SELECT 'class', 'shop.trade.LineItem', NULL, n, n * 96 FROM lone, h WHERE 96 * n > 0.05 * heap""")
def find_leaks(s, d):
    return inspections.find_leaks(*_dominance(s, d), threshold_percent=5.0)


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), p AS (SELECT object_id, retained, retained / heap::DOUBLE AS share, row_number() OVER (ORDER BY retained DESC, object_id) AS rank FROM rr, h),
 q AS (SELECT *, coalesce(sum(share) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
 SELECT object_id, retained, round(share, 6) AS share, rank::INTEGER AS rank FROM q WHERE rank <= 3 OR (before < 0.25 AND share >= 0.01)""")
def pie_biggest_objects(s, d):
    """Regions come first by size; single lines, which are top-level too, are under 1 %."""
    return inspections.pie_biggest_objects(*_dominance(s, d)).select("object_id", "retained", F.round("share", 6).alias("share"), "rank")


@query(_RETAINED + f""", b AS (SELECT rr.object_id, rr.retained, max_by(nr.object_id, nr.retained) AS nation, max(nr.retained) AS most FROM rr LEFT JOIN nr ON nr.r = rr.object_id - {OFFSET['region']} GROUP BY 1, 2)
 SELECT object_id, CASE WHEN most >= 0.7 * retained THEN nation ELSE object_id END AS point FROM b""")
def accumulation_points(s, d):
    """From regions down: no party holds 70 % of a nation."""
    shop, dom = _dominance(s, d)
    return inspections.accumulation_point(shop, dom, shop.roots.select("object_id"))


@query("""SELECT 'SYSTEM_CLASS' AS root_type, 'shop.place.Region' AS name, count(*)::BIGINT AS objects FROM region WHERE r_regionkey = 0 HAVING count(*) > 0
  UNION ALL SELECT 'UNREACHABLE', 'shop.place.Region', count(*) FROM region WHERE r_regionkey <> 0 HAVING count(*) > 0 UNION ALL SELECT 'UNREACHABLE', 'shop.trade.Part', count(*) FROM part HAVING count(*) > 0""")
def keep_unreachable(s, d):
    """Roots by type where only one region is a root and nations refer back to regions: lost regions are each in a circle with their nations, parts are alone."""
    shop = _index(s, d).snap
    back = shop.refs.where("name = 'nations'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit("region").alias("name"))
    cut = snap.Snapshot(shop.objects, shop.classes, shop.refs.union(back), shop.roots.where(F.col("object_id") == OFFSET["region"]))
    return inspections.gc_roots(snapshots.keep_unreachable(cut))


@query("SELECT 'SYSTEM_CLASS' AS root_type, 'shop.place.Region' AS name, count(*)::BIGINT AS objects FROM region")
def gc_roots(s, d):
    return inspections.gc_roots(_index(s, d).snap)


@query(f"SELECT sum(objects)::BIGINT AS objects, sum(shallow)::BIGINT AS heap, 11::BIGINT AS classes, 3::BIGINT AS loaders, (SELECT count(*) FROM region)::BIGINT AS roots FROM ({_CLASS_OBJECTS})")
def heap_overview(s, d):
    return inspections.heap_dump_overview(_index(s, d).snap)


@query(f"SELECT 0 AS loader_id, 1::BIGINT AS classes, 0::BIGINT AS instances UNION ALL SELECT CASE WHEN class_id < 15 THEN 1 ELSE 2 END, count(*) + CASE WHEN class_id < 15 THEN 2 ELSE 1 END, sum(objects)::BIGINT FROM ({_CLASS_OBJECTS}) GROUP BY class_id < 15, CASE WHEN class_id < 15 THEN 1 ELSE 2 END, CASE WHEN class_id < 15 THEN 2 ELSE 1 END")
def classloader_explorer(s, d):
    return inspections.classloader_explorer(_index(s, d).snap)


# --- inspections of values and collections


@query("SELECT p_name AS name, count(*)::BIGINT AS definitions, count(DISTINCT p_brand)::BIGINT AS loaders FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(s, d):
    return inspections.duplicate_classes(table(s, d, "part").withColumnRenamed("p_name", "name"), "name", "p_brand")


@query("SELECT text AS value, count(*)::BIGINT AS objects, sum(16 + 2 * length(text))::BIGINT AS shallow, avg(16 + 2 * length(text)) AS average FROM documents GROUP BY text")
def group_by_value(s, d):
    return inspections.group_by_value(table(s, d, "documents"), "text", 16 + 2 * F.length("text"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Z]{4,}')")
def find_strings(s, d):
    return inspections.find_strings(table(s, d, "documents"), "text", r"(?s).*[A-Z]{4,}.*").select("doc_id")


@query("SELECT len(embedding)::BIGINT AS length, count(*)::BIGINT AS arrays, sum(len(embedding) * 4 + 16)::BIGINT AS shallow FROM embeddings GROUP BY 1")
def arrays_grouped_by_size(s, d):
    return inspections.arrays_grouped_by_size(table(s, d, "embeddings"), "embedding", 4)


@query("""WITH a AS (SELECT len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS used FROM embeddings), b AS (SELECT *, CASE WHEN used = 0 THEN 0.0 ELSE round(1.0000000001 - floor((1.0000000001 - used / n::DOUBLE) / (1.0000000001 / 5)) * (1.0000000001 / 5), 6) END AS fill FROM a)
          SELECT fill::DOUBLE AS fill, count(*)::BIGINT AS arrays, sum(n)::BIGINT AS elements, sum(n - used)::BIGINT AS wasted FROM b GROUP BY fill""")
def array_fill_ratio(s, d):
    clipped = table(s, d, "embeddings").select(F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float"))).alias("a"))
    return inspections.array_fill_ratio(clipped, "a")


@query("""WITH a AS (SELECT o_custkey, list(l_linenumber) AS xs FROM (SELECT DISTINCT o_custkey, l_linenumber, l_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_custkey)
          SELECT len(xs)::BIGINT AS length, list_min(xs)::BIGINT AS value, count(*)::BIGINT AS arrays FROM a WHERE list_min(xs) = list_max(xs) GROUP BY 1, 2""")
def constant_arrays(s, d):
    lines = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_linenumber").cast("long").alias("x"), "l_orderkey").distinct()
    per = lines.groupBy("o_custkey").agg(F.count("x").alias("length"), F.min("x").alias("value"), F.max("x").alias("most"))
    return per.where(F.col("value") == F.col("most")).groupBy("length", "value").agg(quantize.count().alias("arrays"))


@query("SELECT event_id, 'k' AS key, (props->>'$.k')::BIGINT AS value FROM events")
def hash_entries(s, d):
    entries = F.from_json("props", "map<string, long>")
    return inspections.hash_entries(table(s, d, "events"), ["event_id"], entries)


@query("SELECT vec_id, unnest(range(64))::BIGINT AS at, unnest(embedding)::DOUBLE AS value FROM embeddings")
def extract_list_values(s, d):
    return inspections.extract_list_values(table(s, d, "embeddings"), ["vec_id"], "embedding").select("vec_id", F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("value"))


@query("SELECT n AS size, count(*)::BIGINT AS collections FROM (SELECT count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY n")
def collections_grouped_by_size(s, d):
    per = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return inspections.collections_grouped_by_size(per, F.col("n"))


@query("""WITH m AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS size, count(DISTINCT o_orderkey % 16) AS used FROM orders GROUP BY o_custkey), r AS (SELECT size, (size - used) / size::DOUBLE AS x FROM m)
  SELECT ratio, count(*)::BIGINT AS maps, sum(size)::BIGINT AS entries FROM (SELECT size, (CASE WHEN x <= 0 THEN 0.0 ELSE round(1.0000000001 - floor((1.0000000001 - x) / (1.0000000001 / 5)) * (1.0000000001 / 5), 6) END)::DOUBLE AS ratio FROM r) GROUP BY ratio""")
def map_collision_ratio(s, d):
    return inspections.map_collision_ratio(table(s, d, "orders"), ["o_custkey"], "o_orderkey", 16)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS a, (l_linenumber * 20)::BIGINT AS lo, (l_linenumber * 20 + l_quantity)::BIGINT AS hi FROM lineitem), c AS (SELECT DISTINCT a, unnest(range(lo, hi)) AS x FROM f)
  SELECT f.a AS array_id, 300::BIGINT AS length, coalesce(u.used, 0)::BIGINT AS used, (300 - coalesce(u.used, 0))::BIGINT AS waste FROM (SELECT DISTINCT a FROM f) f LEFT JOIN (SELECT a, count(*) AS used FROM c GROUP BY a) u ON f.a = u.a WHERE 300 - coalesce(u.used, 0) > 150""")
def waste_in_arrays(s, d):
    f = table(s, d, "lineitem").select(F.col("l_orderkey").alias("array_id"), F.lit(300).cast("long").alias("length"), (F.col("l_linenumber") * 20).cast("long").alias("first"), F.col("l_quantity").cast("long").alias("size"))
    return inspections.waste_in_char_arrays(f.distinct(), 150).select("array_id", "length", "used", "waste")


@query(r"SELECT doc_id, regexp_replace(text, '[\p{L}\p{N}]', '*', 'g') AS text FROM documents")
def export_redacted(s, d):
    return table(s, d, "documents").select("doc_id", snapshots.redact(F.col("text"), "BASIC").alias("text"))


@query()
def export_redacted_all(s, d):
    """Every document, null texts too.  No SQL: DuckDB's pattern classes differ; a test compares it with unicodedata."""
    return table(s, d, "documents").select("doc_id", snapshots.redact(F.col("text"), "BASIC").alias("text"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_histogram(s, d):
    out = stream_histogram.windowed(table(s, d, "events"), "ts", "event_type", "value")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


# --- commands over the index


@query(f"""SELECT concat_ws('>', {OFFSET['region']} + n_regionkey, {OFFSET['nation']} + n_nationkey, {OFFSET['customer']} + c_custkey, {OFFSET['orders']} + o_orderkey) AS path, 4 AS length
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def path2gc(s, d):
    """Paths from the roots to the order of the greatest key."""
    target = table(s, d, "orders").agg(F.max("o_orderkey")).first()[0] + OFFSET["orders"]
    at = _index(s, d)
    return reports.path2gc(at.snap, target).select(F.array_join("path", ">").alias("path"), "length")


@query(f"""WITH l AS (SELECT DISTINCT * FROM lineitem), t AS (SELECT min(s_suppkey) AS k FROM supplier), n AS (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey = (SELECT k FROM t))
  SELECT concat_ws('>', {OFFSET['region']} + n_regionkey, {OFFSET['nation']} + n_nationkey, {OFFSET['supplier']} + (SELECT k FROM t)) AS path, 3 AS length FROM nation WHERE n_nationkey = (SELECT k FROM n)
  UNION ALL SELECT concat_ws('>', {OFFSET['region']} + r_regionkey, {OFFSET['supplier']} + (SELECT k FROM t)), 2 FROM region""")
def path2gc_excluding(s, d):
    """Paths to the supplier of the least key where every region also refers to it, and to its nation by a field that is left out."""
    at = _index(s, d)
    key = table(s, d, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_nationkey").first()
    far = at.snap.roots.select(F.col("object_id").alias("src_id"))
    more = far.select("src_id", F.lit(OFFSET["supplier"] + key[0]).alias("dst_id"), F.lit("direct").alias("name")).union(far.select("src_id", F.lit(OFFSET["nation"] + key[1]), F.lit("weak")))
    grown = snap.Snapshot(at.snap.objects, at.snap.classes, at.snap.refs.union(more), at.snap.roots)
    return reports.path2gc(grown, OFFSET["supplier"] + key[0], excluded=F.col("name") == "weak").select(F.array_join("path", ">").alias("path"), "length")


@query(f"""SELECT ({OFFSET['nation']} + c_nationkey)::BIGINT AS object_id, 'customers' AS name, ({OFFSET['customer']} + c_custkey)::BIGINT AS neighbour FROM customer
  UNION ALL SELECT {OFFSET['nation']} + s_nationkey, 'suppliers', {OFFSET['supplier']} + s_suppkey FROM supplier""")
def list_objects(s, d):
    shop = _index(s, d).snap
    return reports.list_objects(shop, shop.objects.where(F.col("class_id") == snap.CLASS_OF["nation"]))


@query(f"""SELECT ({OFFSET['customer']} + o_custkey)::BIGINT AS object_id, 'orders' AS name, ({OFFSET['orders']} + o_orderkey)::BIGINT AS via FROM orders""")
def list_inbound(s, d):
    shop = _index(s, d).snap
    out = reports.list_objects(shop, shop.objects.where(F.col("class_id") == snap.CLASS_OF["orders"]), inbound=True)
    return out.select(F.col("neighbour").alias("object_id"), "name", F.col("object_id").alias("via"))


@query("""WITH m AS (SELECT count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), r AS (SELECT n, n / 16.0::DOUBLE AS x FROM m)
  SELECT fill, count(*)::BIGINT AS collections, sum(16 - n)::BIGINT AS unused FROM (SELECT n, (CASE WHEN x <= 0 THEN 0.0 WHEN x > 5 THEN 1.7976931348623157e308 ELSE round(5 - floor((5 - x) / 1.0) * 1.0, 6) END)::DOUBLE AS fill FROM r) GROUP BY fill""")
def collection_fill_ratio(s, d):
    """Customers as lists of 16 places that hold their orders."""
    per = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return reports.collection_fill_ratio(per, F.col("n"), F.lit(16).cast("long"))


@query("SELECT DISTINCT o_custkey, o_orderpriority AS value FROM orders")
def hash_set_values(s, d):
    return inspections.hash_set_values(table(s, d, "orders"), ["o_custkey"], "o_orderpriority")


def _without_suppliers(s: SparkSession, d: str) -> snap.Snapshot:
    shop = _index(s, d).snap
    return snap.Snapshot(shop.objects.where(F.col("class_id") != snap.CLASS_OF["supplier"]), shop.classes, shop.refs, shop.roots)


@query(f"""SELECT name, CASE WHEN class_id <> 14 THEN objects END AS objects_0, CASE WHEN class_id = 14 THEN objects ELSE 0 END::BIGINT AS objects_1 FROM ({_CLASS_OBJECTS})""")
def simplecomparison(s, d):
    """Histograms of the tables without and with suppliers."""
    return reports.simplecomparison(inspections.histogram, _without_suppliers(s, d), _index(s, d).snap, "name", ["objects"], "DIFF_TO_FIRST").drop("nth")


@query(f"SELECT name, CASE WHEN class_id = 14 THEN objects ELSE 0 END::BIGINT AS objects, CASE WHEN class_id = 14 THEN shallow ELSE 0 END::BIGINT AS shallow FROM ({_CLASS_OBJECTS})")
def comparison_report(s, d):
    sides = [inspections.histogram(x) for x in (_without_suppliers(s, d), _index(s, d).snap)]
    return reports.comparison_report({"histogram": tuple(sides)}, ["name"], ["objects", "shallow"])["histogram"]


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), lone AS (SELECT count(*)::BIGINT AS n FROM j WHERE cr <> sr), g AS (SELECT object_id, 2 * retained AS growth FROM rr)
 SELECT 'object' AS kind, 'shop.place.Region' AS name, object_id, growth FROM g, h WHERE growth > 0.02 * heap
 UNION ALL SELECT 'class', 'shop.place.Region', NULL, sum(growth)::BIGINT FROM g, h WHERE growth <= 0.02 * heap HAVING sum(growth) > 0.02 * max(heap)
 UNION ALL SELECT 'class', 'shop.trade.LineItem', NULL, 192 * n FROM lone, h WHERE 192 * n > 0.02 * heap""")
def find_leaks2(s, d):
    """Growth between the tables and the same ones with all sizes threefold."""
    shop, dom = _dominance(s, d)
    grown = snap.Snapshot(shop.objects.withColumn("shallow", 3 * F.col("shallow")), shop.classes, shop.refs, shop.roots)
    return reports.find_leaks2(shop, grown, dom, dom, threshold_percent=2.0)


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), t AS (SELECT 1 AS loader_id, count(*)::BIGINT AS objects, (24 * count(*))::BIGINT AS shallow, sum(retained)::BIGINT AS retained FROM rr
  UNION ALL SELECT 2, count(*), 96 * count(*), 96 * count(*) FROM j WHERE cr <> sr) SELECT t.* FROM t, h WHERE retained > 0.01 * heap""")
def top_consumers_by_loader(s, d):
    return inspections.top_consumers_grouped(*_dominance(s, d), group_by="BY_CLASSLOADER")


_TOP_CLASSES = _RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), t AS (SELECT 'shop.place.Region' AS name, count(*)::BIGINT AS objects, (24 * count(*))::BIGINT AS shallow, sum(retained)::BIGINT AS retained FROM rr
  UNION ALL SELECT 'shop.trade.LineItem', count(*), 96 * count(*), 96 * count(*) FROM j WHERE cr <> sr HAVING count(*) > 0)"""


@query(_TOP_CLASSES + "SELECT t.* FROM t, h WHERE retained > 0.01 * heap")
def top_consumers_by_class(s, d):
    return inspections.top_consumers_grouped(*_dominance(s, d), group_by="BY_CLASS")


@query(_TOP_CLASSES + """, p AS (SELECT unnest(['shop', 'shop.' || split_part(name, '.', 2), name]) AS package, objects, shallow, retained FROM t)
  SELECT package, sum(objects)::BIGINT AS objects, sum(shallow)::BIGINT AS shallow, sum(retained)::BIGINT AS retained FROM p GROUP BY package""")
def dominator_tree_by_package(s, d):
    return inspections.dominator_tree(*_dominance(s, d), group_by="BY_PACKAGE")


@query(f"""WITH h AS (SELECT 24 * (SELECT count(*) FROM region) AS r, 32 * (SELECT count(*) FROM nation) AS n, 48 * (SELECT count(*) FROM customer) AS c, 40 * (SELECT count(*) FROM supplier) AS s, 56 * (SELECT count(*) FROM orders) AS o,
   96 * (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS l), x AS ({_CLASS_OBJECTS})
  SELECT class_id, objects, shallow, (CASE class_id WHEN 11 THEN r + n + c + s + o + l WHEN 12 THEN n + c + s + o + l WHEN 13 THEN c + o WHEN 14 THEN s WHEN 15 THEN o WHEN 17 THEN l END)::BIGINT AS retained FROM x, h""")
def retained_size_histogram_precise(s, d):
    """A class table with what roots reach only through each class; parts are not reached."""
    at = _index(s, d)
    return inspections.retained_column(at.snap, at.snap.classes, at.dominance, at.tree, at.edges)


@query(_RETAINED + f""", x AS ({_CLASS_OBJECTS})
  SELECT class_id, objects, shallow, (CASE class_id WHEN 11 THEN (SELECT sum(retained) FROM rr) WHEN 12 THEN (SELECT sum(retained) FROM nr) WHEN 13 THEN (SELECT count(*) * 48 FROM customer) + (SELECT count(*) * 56 FROM orders)
   WHEN 14 THEN shallow WHEN 15 THEN shallow WHEN 17 THEN shallow END)::BIGINT AS retained FROM x""")
def retained_size_histogram(s, d):
    """The same by least retained sizes: what the objects dominate one by one."""
    at = _index(s, d)
    return inspections.retained_column(at.snap, at.snap.classes, at.dominance)


@query(f"SELECT name, objects, shallow FROM ({_CLASS_OBJECTS}) WHERE class_id IN (13, 15)")
def component_report(s, d):
    """Histogram of what customers retain where references by lines don't count."""
    shop = _index(s, d).snap
    ids = shop.objects.where(F.col("class_id") == snap.CLASS_OF["customer"]).select("object_id")
    return reports.component_report(shop, ids, F.col("name") == "lines")["histogram"]


_PATHS = f"""WITH l AS (SELECT DISTINCT * FROM lineitem), p AS (
  SELECT {OFFSET['region']} + n_regionkey AS a, {OFFSET['nation']} + n_nationkey AS b, {OFFSET['customer']} + c_custkey AS c, {OFFSET['orders']} + o_orderkey AS e, 'shop.party.Customer' AS cn, 'shop.trade.Order' AS en
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {OFFSET['region']} + n_regionkey, {OFFSET['nation']} + n_nationkey, {OFFSET['supplier']} + s_suppkey, -row_number() OVER (), 'shop.party.Supplier', 'shop.trade.LineItem'
   FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 r AS (SELECT 'shop.place.Region' AS rn, 'shop.place.Nation' AS nn, p.* FROM p) """


def _paths_of_trade(s: SparkSession, d: str, group_by: str) -> DataFrame:
    """Shortest paths of orders and lines: over customers those, over suppliers these."""
    at = _index(s, d)
    ids = at.snap.objects.where(F.col("class_id").isin(snap.CLASS_OF["orders"], snap.CLASS_OF["lineitem"]))
    return inspections.grouped_paths(at.snap, at.tree, ids, group_by, at.paths)


@query(_PATHS + """SELECT level, path, name, count(DISTINCT node)::BIGINT AS on_path, count(*)::BIGINT AS referenced FROM (
  SELECT 0 AS level, rn AS path, rn AS name, a AS node FROM r UNION ALL SELECT 1, rn || '>' || nn, nn, b FROM r UNION ALL SELECT 2, rn || '>' || nn || '>' || cn, cn, c FROM r
  UNION ALL SELECT 3, rn || '>' || nn || '>' || cn || '>' || en, en, e FROM r) GROUP BY 1, 2, 3""")
def paths_from_roots_by_class(s, d):
    return _paths_of_trade(s, d, "FROM_GC_ROOTS_BY_CLASS")


@query(_PATHS + """SELECT level, path, name, count(DISTINCT node)::BIGINT AS on_path, count(*)::BIGINT AS referenced FROM (
  SELECT 0 AS level, en AS path, en AS name, e AS node FROM r UNION ALL SELECT 1, en || '>' || cn, cn, c FROM r UNION ALL SELECT 2, en || '>' || cn || '>' || nn, nn, b FROM r
  UNION ALL SELECT 3, en || '>' || cn || '>' || nn || '>' || rn, rn, a FROM r) GROUP BY 1, 2, 3""")
def paths_from_objects_by_class(s, d):
    return _paths_of_trade(s, d, "FROM_OBJECTS_BY_CLASS")


@query(_PATHS + """SELECT level, path, name, on_path, referenced, count(*)::BIGINT AS nodes FROM (SELECT level, CASE WHEN name <> 'shop.trade.LineItem' THEN node::VARCHAR END AS path, name, 1::BIGINT AS on_path, count(*)::BIGINT AS referenced FROM (
  SELECT 0 AS level, rn AS name, a AS node FROM r UNION ALL SELECT 1, nn, b FROM r UNION ALL SELECT 2, cn, c FROM r UNION ALL SELECT 3, en, e FROM r) GROUP BY level, node, name) GROUP BY ALL""")
def paths_from_roots(s, d):
    """The same by objects; lines, named by a hash that SQL lacks, are counted."""
    out = _paths_of_trade(s, d, "FROM_GC_ROOTS")
    named = F.when(F.col("name") != "shop.trade.LineItem", F.col("path")).alias("path")
    return out.groupBy("level", named, "name", "on_path", "referenced").agg(quantize.count().alias("nodes"))


@query(_RETAINED + f"""SELECT dominator_id::BIGINT AS dominator_id, name, retained::BIGINT AS retained, count(*)::BIGINT AS objects FROM (SELECT {OFFSET['region']} + r AS dominator_id, 'shop.place.Nation' AS name, retained FROM nr
  UNION ALL SELECT {OFFSET['region']} + cr, 'shop.trade.LineItem', 96 FROM j WHERE cr = sr AND cn <> sn) GROUP BY 1, 2, 3""")
def immediate_dominated(s, d):
    """What regions dominate immediately, by class and retained size."""
    shop, dom = _dominance(s, d)
    rows = inspections._named(shop, inspections.immediate_dominated(shop, dom, shop.roots))
    return rows.groupBy("dominator_id", "name", "retained").agg(quantize.count().alias("objects"))


@query(_RETAINED + f""", h AS (SELECT sum(shallow) AS heap FROM ({_CLASS_OBJECTS})), lone AS (SELECT count(*)::BIGINT AS n FROM j WHERE cr <> sr),
 b AS (SELECT rr.object_id, rr.retained, max_by(nr.object_id, nr.retained) AS nation, max(nr.retained) AS most FROM rr LEFT JOIN nr ON nr.r = rr.object_id - {OFFSET['region']} GROUP BY 1, 2),
 c AS (SELECT 0 AS depth, {OFFSET['region']} + sr AS node, 'shop.place.Region' AS name, count(*) AS n FROM j WHERE cr <> sr GROUP BY sr UNION ALL SELECT 1, {OFFSET['nation']} + sn, 'shop.place.Nation', count(*) FROM j WHERE cr <> sr GROUP BY sn
  UNION ALL SELECT 2, {OFFSET['supplier']} + l_suppkey, 'shop.party.Supplier', count(*) FROM j WHERE cr <> sr GROUP BY l_suppkey), best AS (SELECT max_by(node, depth) AS node, max_by(name, depth) AS name FROM c, lone WHERE c.n >= 0.8 * lone.n)
 SELECT 'object' AS kind, 'shop.place.Region' AS name, object_id, 1::BIGINT AS objects, retained, CASE WHEN most >= 0.7 * retained THEN nation ELSE object_id END AS point, CASE WHEN most >= 0.7 * retained THEN 'shop.place.Nation' ELSE 'shop.place.Region' END AS point_name FROM b, h WHERE retained > 0.05 * heap
 UNION ALL SELECT 'class', 'shop.place.Region', NULL, count(*), sum(retained)::BIGINT, NULL, NULL FROM rr, h WHERE retained <= 0.05 * heap HAVING sum(retained) > 0.05 * max(heap)
 UNION ALL SELECT 'class', 'shop.trade.LineItem', NULL, n, n * 96, (SELECT node FROM best), (SELECT name FROM best) FROM lone, h WHERE 96 * n > 0.05 * heap""")
def leakhunter(s, d):
    shop, dom = _dominance(s, d)
    return inspections.leakhunter(shop, dom, _index(s, d).tree, threshold_percent=5.0, forest=_index(s, d).paths)


@query(f"SELECT class_id IN (13, 14) AS implements, sum(objects)::BIGINT AS objects FROM ({_CLASS_OBJECTS}) GROUP BY 1")
def implements_class(s, d):
    shop = _index(s, d).snap
    return scans.implements(shop, shop.objects, "shop.party.Party").groupBy("implements").agg(quantize.count().alias("objects"))


@query(f"SELECT name, objects, shallow FROM ({_CLASS_OBJECTS}) WHERE class_id IN (15, 17)")
def extent_of_subselect(s, d):
    """Objects of the classes that a sub-select finds by their superclass."""
    shop = _index(s, d).snap
    return inspections.histogram(shop, scans.extent_of(shop, shop.classes.where("super_id = 4")))


@query(f"SELECT name, objects, shallow FROM ({_CLASS_OBJECTS}) WHERE class_id IN (13, 14, 15, 17)")
def object_set_retained(s, d):
    """Parties, subclasses included, and all that roots reach only through them: orders and lines."""
    at = _index(s, d)
    party = at.snap.classes.where("name = 'shop.party.Party'")
    return inspections.histogram(at.snap, scans.object_set(at.snap, party, include_subclasses=True, retained=True, edges=at.edges, tree=at.tree))


# --- rows about the same object, trees, bounds


@query("""WITH a AS (SELECT c_nationkey AS nation, c_custkey AS id FROM customer), m AS (
  SELECT nation, CASE WHEN id % 3 <> 0 THEN 0 WHEN id % 5 <> 0 THEN 1 ELSE 2 END AS matched, id AS object_0, id AS object_1 FROM a WHERE id % 7 <> 0),
 l AS (SELECT nation, id, row_number() OVER (PARTITION BY nation ORDER BY id) AS nth FROM a WHERE id % 7 = 0), r AS (SELECT nation, id + 1000000000 AS id, row_number() OVER (PARTITION BY nation ORDER BY id) AS nth FROM a WHERE id % 11 = 0)
 SELECT * FROM m UNION ALL SELECT coalesce(l.nation, r.nation), NULL, l.id, r.id FROM l FULL JOIN r ON l.nation = r.nation AND l.nth = r.nth""")
def compare_duplicates(s, d):
    """Customers of a nation in two heaps: the same address, the same name where it moved, the same retained size where it has no name; some are gone, others new.  Order by value would pair all after the first gap wrongly."""
    c, key = table(s, d, "customer"), F.col("c_custkey")
    first = c.select(
        F.col("c_nationkey").alias("nation"), key.alias("object_id"), F.col("c_mktsegment").alias("class_name"), F.lit("instance").alias("kind"), (key * 16).alias("address"),
        F.when(key % 5 != 0, F.col("c_name")).alias("own_name"), F.lit(48).cast("long").alias("shallow"), (key + 48).alias("retained"),
    )
    moved = first.where("object_id % 7 <> 0").withColumn("address", F.col("address") + F.when(F.col("object_id") % 3 == 0, 8).otherwise(0))
    new = first.where("object_id % 11 = 0").withColumns({"object_id": F.col("object_id") + 10**9, "address": F.col("address") + 10**12, "own_name": F.concat(F.lit("new "), F.col("object_id")), "retained": F.lit(48).cast("long")})
    return pairing.paired(first, moved.unionByName(new), "nation")


_PACKAGES = f"""WITH RECURSIVE h AS ({_CLASS_OBJECTS}), p AS (
  SELECT 0 AS level, string_split(name, '.')[1] AS path, string_split(name, '.') AS parts, class_id, objects, shallow FROM h
  UNION ALL SELECT level + 1, path || '/' || parts[level + 2], parts, class_id, objects, shallow FROM p WHERE len(parts) > level + 1)
 SELECT level, path, sum(CASE WHEN class_id <> 14 THEN objects END)::BIGINT AS objects_0, (CASE WHEN bool_or(class_id <> 14) THEN sum(CASE WHEN class_id = 14 THEN objects ELSE 0 END) ELSE sum(objects) END)::BIGINT AS objects_1 FROM p GROUP BY level, path"""


@query(_PACKAGES)
def compare_package_trees(s, d):
    """Package trees without and with suppliers, merged level by level: what is new below each package."""

    def nodes(hist: DataFrame) -> DataFrame:
        parts = F.split("name", r"\.")
        each = hist.select("objects", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, 1, n))).alias("at"))
        own = each.groupBy("at").agg(F.sum("objects").cast("long").alias("objects"))
        return own.select(F.array_join("at", ".").alias("node_id"), F.when(F.size("at") > 1, F.array_join(F.slice("at", 1, F.size("at") - 1), ".")).alias("parent_id"), F.element_at("at", -1).alias("name"), "objects")

    sides = [nodes(inspections.histogram(x)) for x in (_without_suppliers(s, d), _index(s, d).snap)]
    return pairing.compare_trees(sides, "name", ["objects"], "DIFF_TO_FIRST").select("level", "path", "objects_0", "objects_1")


@query(_RETAINED + f""", h AS (SELECT 24 * (SELECT count(*) FROM region) AS r, 32 * (SELECT count(*) FROM nation) AS n, 48 * (SELECT count(*) FROM customer) AS c, 40 * (SELECT count(*) FROM supplier) AS s, 56 * (SELECT count(*) FROM orders) AS o,
   96 * (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS l), x AS ({_CLASS_OBJECTS}), b AS (SELECT class_id, objects,
   (CASE class_id WHEN 11 THEN (SELECT sum(retained) FROM rr) WHEN 12 THEN (SELECT sum(retained) FROM nr) WHEN 13 THEN c + o WHEN 14 THEN shallow WHEN 15 THEN shallow WHEN 17 THEN shallow END)::BIGINT AS least,
   (CASE class_id WHEN 11 THEN r + n + c + s + o + l WHEN 12 THEN n + c + s + o + l WHEN 13 THEN c + o WHEN 14 THEN s WHEN 15 THEN o WHEN 17 THEN l END)::BIGINT AS exact FROM x, h)
  SELECT class_id, CASE WHEN objects > 1 THEN '>= ' ELSE '' END || least AS before, CASE WHEN objects > 1 THEN '<= ' ELSE '' END || (exact - least) AS growth FROM b
  UNION ALL SELECT NULL, CASE WHEN bool_or(objects > 1 AND least IS NOT NULL) THEN '>= ' ELSE '' END || sum(least)::BIGINT, CASE WHEN bool_or(objects > 1 AND least IS NOT NULL) THEN '<= ' ELSE '' END || sum(exact - least)::BIGINT FROM b""")
def compare_bounds(s, d):
    """Least retained sizes of classes, which are lower bounds, against precise ones; growth is then at most so much.  The last row is the total."""
    at = _index(s, d)
    least = inspections.retained_column(at.snap, at.snap.classes, at.dominance).select("class_id", bounds.bounded(F.col("retained"), F.when(F.col("objects") > 1, bounds.AT_LEAST).otherwise(bounds.EXACT)).alias("size"))
    exact = inspections.retained_column(at.snap, at.snap.classes, at.dominance, at.tree, at.edges).select("class_id", bounds.bounded(F.col("retained")).alias("size"))
    rows = compare.compare([least, exact], "class_id", ["size"], "DIFF_TO_FIRST")
    sums = rows.agg(bounds.total(F.col("size_0")).alias("size_0"), bounds.total(F.col("size_1")).alias("size_1")).select(F.lit(None).cast("int").alias("class_id"), "size_0", "size_1")
    both = rows.select("class_id", "size_0", "size_1").unionByName(sums)
    return both.select("class_id", bounds.text(F.col("size_0")).alias("before"), bounds.text(F.col("size_1")).alias("growth"))


# --- ids and addresses


_ADDRESSES = " UNION ALL ".join(f"SELECT {OFFSET[t]} + {snap.KEY[t]} AS address FROM {t}" for t in OFFSET)
_DENSE = f"WITH a AS ({_ADDRESSES}), i AS (SELECT row_number() OVER (ORDER BY address) - 1 AS object_id, address::BIGINT AS address FROM a) "


@query(_DENSE + "SELECT object_id, address, address AS back FROM i")
def dense_ids(s, d):
    """Dense ids of all objects by address, and back; lines, whose addresses are the greatest, are numbered too but not shown, as SQL lacks their hash."""
    objects = _index(s, d).snap.objects
    ids = snapshots.dense_ids(objects.select(F.col("object_id").alias("address")))
    shown = ids.where(F.col("address") < LINE).select("object_id", "address")
    return snapshots.to_addresses(shown.withColumnRenamed("address", "own"), ids).select("object_id", F.col("own").alias("address"), F.col("address").alias("back"))


@query(_DENSE + f""", w AS (SELECT o_orderkey AS nth, (CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE {OFFSET['orders']} + o_orderkey END)::BIGINT AS address FROM orders)
  SELECT nth, w.address, object_id FROM w LEFT JOIN i ON i.address = w.address""")
def addresses_to_ids(s, d):
    """A list of addresses with unknown ones among them: those keep their row, without an id."""
    ids = snapshots.dense_ids(_index(s, d).snap.objects.select(F.col("object_id").alias("address")))
    key = F.col("o_orderkey")
    wanted = table(s, d, "orders").select(key.alias("nth"), F.when(key % 10 == 0, -1 - key).otherwise(snap.object_id("orders")).alias("address"))
    return snapshots.to_ids(wanted, ids).select("nth", "address", "object_id")


# --- own aggregates, contents of collections, classes by reference


@query("""SELECT o_orderpriority, round(stddev_pop(o_totalprice), 4) AS deviation, round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean, round((min(o_totalprice) + max(o_totalprice)) / 2, 4) AS midrange FROM orders GROUP BY 1""")
def own_aggregates(s, d):
    o, out = table(s, d, "orders"), None
    for name in ("DEVIATION", "GEOMETRIC_MEAN", "MIDRANGE"):
        one = aggregates.aggregate(o, ["o_orderpriority"], "o_totalprice", name, name.lower()).withColumn(name.lower(), F.round(name.lower(), 4))
        out = one if out is None else out.join(one, "o_orderpriority")
    return out


_LIST, _NODE, _MAP, _TABLE, _ENTRY, _TREE, _LEAF = (k * 10**12 for k in range(20, 27))


def _collections(s: SparkSession, d: str) -> snap.Snapshot:
    """The tables as collections: a list of orders for each customer, a chained map of suppliers for each nation, a sorted tree of nations for each region."""
    orders, supplier, nation = (table(s, d, t) for t in ("orders", "supplier", "nation"))

    def chain(rows: DataFrame, group: list[str], key: str) -> DataFrame:
        """rows with their place in the group, the next key and the group's size."""
        w = Window.partitionBy(*group).orderBy(key)
        return rows.withColumns({"place": F.row_number().over(w), "following": F.lead(key).over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*group))})

    def ref(df: DataFrame, src, dst, name) -> DataFrame:
        return df.select(src.cast("long").alias("src_id"), dst.cast("long").alias("dst_id"), (F.lit(name) if isinstance(name, str) else name).alias("name"))

    c = lambda name, offset: F.col(name).cast("long") + offset
    lists = chain(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    maps = chain(supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 4).alias("b")), ["s_nationkey", "b"], "s_suppkey")
    trees = chain(nation.select("n_nationkey", "n_regionkey"), ["n_regionkey"], "n_nationkey")
    other = trees.select("n_regionkey", F.col("place").alias("child"), F.col("n_nationkey").alias("child_key"))
    spine = trees.where("place % 2 = 0 or (place = 1 and n = 1)")
    left = spine.where("place % 2 = 0").join(other, "n_regionkey").where("child = place - 1")
    right = spine.join(other, "n_regionkey").where("place % 2 = 0 and (child = place + 2 or (child = place + 1 and place + 1 = n))")
    refs = [
        ref(lists.where("place = 1"), c("o_custkey", _LIST), c("o_orderkey", _NODE), "first"), ref(lists.where("following is not null"), c("o_orderkey", _NODE), c("following", _NODE), "next"),
        ref(lists, c("o_orderkey", _NODE), c("o_orderkey", OFFSET["orders"]), "item"),
        ref(nation, c("n_nationkey", _MAP), c("n_nationkey", _TABLE), "table"), ref(maps.where("place = 1"), c("s_nationkey", _TABLE), c("s_suppkey", _ENTRY), F.concat(F.lit("["), F.col("b").cast("string"), F.lit("]"))),
        ref(maps.where("following is not null"), c("s_suppkey", _ENTRY), c("following", _ENTRY), "next"), ref(maps, c("s_suppkey", _ENTRY), c("s_suppkey", OFFSET["supplier"]), "key"),
        ref(maps, c("s_suppkey", _ENTRY), c("s_nationkey", OFFSET["nation"]), "value"),
        ref(trees.where("place = least(2, n)"), c("n_regionkey", _TREE), c("n_nationkey", _LEAF), "root"), ref(left, c("n_nationkey", _LEAF), c("child_key", _LEAF), "left"),
        ref(right, c("n_nationkey", _LEAF), c("child_key", _LEAF), "right"), ref(trees, c("n_nationkey", _LEAF), c("n_nationkey", OFFSET["nation"]), "key"),
    ]
    region, customer = table(s, d, "region"), table(s, d, "customer")
    objects = [df.select(c(key, offset).alias("object_id"), F.lit(cls).alias("class_id"), F.lit(24).cast("long").alias("shallow")) for df, key, offset, cls in ((customer, "c_custkey", _LIST, 31), (nation, "n_nationkey", _MAP, 33), (region, "r_regionkey", _TREE, 34))]
    classes = s.createDataFrame([(30, "java.util.LinkedList", 1), (31, "shop.trade.OrderList", 30), (32, "java.util.HashMap", 1), (33, "shop.place.Suppliers", 32), (34, "java.util.TreeMap", 1), (1, "java.lang.Object", None)], "class_id int, name string, super_id int")
    classes = classes.withColumns({"loader_id": F.lit(1), "instance_size": F.lit(24).cast("long")})
    return snap.Snapshot(reduce(DataFrame.unionByName, objects), classes, reduce(DataFrame.unionByName, refs), region.select(c("r_regionkey", _TREE).alias("object_id"), F.lit(2).alias("type")))


@query(f"""SELECT ({_LIST} + o_custkey)::BIGINT AS object_id, 'chain' AS kind, NULL::BIGINT AS bucket, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS place, NULL::BIGINT AS key, ({OFFSET['orders']} + o_orderkey)::BIGINT AS value FROM orders
  UNION ALL SELECT {_MAP} + s_nationkey, 'map', s_suppkey % 4, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 4 ORDER BY s_suppkey) - 1, {OFFSET['supplier']} + s_suppkey, {OFFSET['nation']} + s_nationkey FROM supplier
  UNION ALL SELECT {_TREE} + n_regionkey, 'tree', NULL, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1, {OFFSET['nation']} + n_nationkey, NULL FROM nation""")
def collection_contents(s, d):
    """Lists, chained maps and sorted trees, whose classes have rules or inherit them."""
    return contents.collection_contents(_collections(s, d)).select("object_id", "kind", "bucket", "place", "key", "value")


@query("""WITH g AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey IN (0, 1)), z AS (SELECT k FROM g WHERE r = 0), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM z)), p AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT k FROM z)),
 t AS (SELECT 0 AS level, 'shop.place.Region' AS path, 1 AS n, 24 AS size, 'NEW' AS type UNION ALL SELECT 1, 'shop.place.Region>shop.place.Nation', (SELECT count(*) FROM z), 32, 'NEW'
  UNION ALL SELECT 2, 'shop.place.Region>shop.place.Nation>shop.party.Customer', (SELECT count(*) FROM c), 48, 'NEW' UNION ALL SELECT 2, 'shop.place.Region>shop.place.Nation>shop.party.Supplier', (SELECT count(*) FROM p), 40, 'NEW'
  UNION ALL SELECT 2, 'shop.place.Region>shop.place.Nation>shop.place.Region', 2, 24, 'MIXED'
  UNION ALL SELECT 3, 'shop.place.Region>shop.place.Nation>shop.party.Customer>shop.trade.Order', (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), 56, 'NEW'
  UNION ALL SELECT 3, 'shop.place.Region>shop.place.Nation>shop.party.Supplier>shop.trade.LineItem', (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM p))), 96, 'NEW'
  UNION ALL SELECT 3, 'shop.place.Region>shop.place.Nation>shop.place.Region>shop.place.Nation', (SELECT count(*) FROM g), 32, 'MIXED')
 SELECT level, path, n::BIGINT AS objects, (n * size)::BIGINT AS shallow, type FROM t WHERE n > 0""")
def class_reference_tree(s, d):
    """Three levels from one region, where nations refer back to their region and to the next one."""
    shop = _index(s, d).snap
    own = shop.refs.where("name = 'nations'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit("region").alias("name"))
    following = own.select("src_id", (F.lit(OFFSET["region"]) + (F.col("dst_id") - OFFSET["region"] + 1) % 5).alias("dst_id"), F.lit("following").alias("name"))
    circular = snap.Snapshot(shop.objects, shop.classes, shop.refs.union(own).union(following), shop.roots)
    return class_tree.class_reference_tree(circular, shop.roots.where(F.col("object_id") == OFFSET["region"]), levels=3).select("level", "path", "objects", "shallow", "type")


# --- what is small: rules of referrers, fields, masks, totals, threads, queues, references


@query("""WITH r AS (SELECT l_orderkey AS a, l_linenumber <> 7 AS text, (l_linenumber * 20)::BIGINT AS lo, (CASE WHEN l_linenumber = 6 THEN 200 ELSE l_quantity END)::BIGINT AS size FROM lineitem), g AS (SELECT a, count(*) AS n FROM r GROUP BY a HAVING bool_and(text AND 300 - size >= 150)),
  c AS (SELECT DISTINCT a, unnest(range(lo, lo + size)) AS x FROM r WHERE a IN (SELECT a FROM g)), u AS (SELECT g.a, g.n, count(c.x) AS used FROM g LEFT JOIN c ON c.a = g.a GROUP BY g.a, g.n)
  SELECT a AS array_id, 300::BIGINT AS length, used::BIGINT AS used, (300 - used)::BIGINT AS waste FROM u WHERE n = 1 OR 300 - used > 150""")
def waste_by_referrers(s, d):
    """Orders as arrays of 300, lines as texts that use parts of them; a seventh line is something else, a sixth fills too much."""
    number = F.col("l_linenumber")
    size = F.when(number == 6, F.lit(200)).otherwise(F.col("l_quantity")).cast("long")
    return inspections.waste_by_referrers(table(s, d, "lineitem").select(F.col("l_orderkey").alias("array_id"), F.lit(300).cast("long").alias("length"), (number != 7).alias("is_text"), (number * 20).cast("long").alias("first"), size.alias("size")), 150)


@query(f"""WITH n AS (SELECT 1 AS class_id, (SELECT count(*) FROM region) AS v UNION ALL SELECT 3, (SELECT count(*) FROM customer) UNION ALL SELECT 15, (SELECT count(*) FROM orders))
  SELECT c.class_id, (SELECT v FROM n WHERE n.class_id = c.at)::BIGINT AS value FROM (SELECT unnest([1, 2, 3, 4, 11, 12, 13, 14, 15, 16, 17]) AS class_id, unnest([1, 1, 3, 1, 1, 1, 3, 3, 15, 1, 1]) AS at) c""")
def static_fields(s, d):
    """A static field along the super chain: set by three classes, inherited by the others."""
    statics = [table(s, d, t).agg(F.count(F.lit(1)).alias("value")).select(F.lit(c).alias("class_id"), F.lit("count").alias("name"), "value") for t, c in (("region", 1), ("customer", 3), ("orders", 15))]
    return scans.static_field(_index(s, d).snap.classes, reduce(DataFrame.unionByName, statics), "count")


@query(f"""SELECT ({OFFSET['orders']} + o_orderkey)::BIGINT AS object_id FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT {OFFSET['customer']} + o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey % 3 <> 0""")
def select_objects_lists(s, d):
    """Objects that a list column holds, nulls left out."""
    o = table(s, d, "orders").where("o_totalprice > 200000")
    return scans.objects_of(o.select(F.array(snap.object_id("orders"), F.when(F.col("o_custkey") % 3 != 0, snap.object_id("customer", "o_custkey"))).alias("x")), "x")


@query(f"SELECT name, objects, shallow FROM ({_CLASS_OBJECTS}) WHERE class_id IN (12, 15)")
def extent_of_ids(s, d):
    shop = _index(s, d).snap
    return inspections.histogram(shop, scans.extent_of_ids(shop, [12, 15]))


@query("""SELECT p_name AS key, count(*)::BIGINT AS n_0, 0::BIGINT AS n_1 FROM part GROUP BY p_name""")
def compare_masked(s, d):
    """Keys that hold addresses, which differ between runs: masked, they are the same."""
    p = table(s, d, "part")
    sides = [p.select(F.concat("p_name", F.lit(" @ 0x"), F.lower(F.hex(F.col("p_partkey") + i))).alias("key")) for i in (16, 4096)]
    counted = [t.groupBy(compare.mask_key(F.col("key"), compare.MASKS[0]).alias("key")).agg(quantize.count().alias("n")) for t in sides]
    return compare.compare(counted, "key", ["n"], "DIFF_TO_FIRST").drop("nth")


@query("""SELECT count(*) FILTER (WHERE p_size > 10 AND p_retailprice < 1500)::BIGINT AS shown, count(*) FILTER (WHERE NOT (p_size > 10 AND p_retailprice < 1500))::BIGINT AS filtered FROM part""")
def filtered_out(s, d):
    return results.filtered_out(table(s, d, "part"), [F.col("p_size") > 10, F.col("p_retailprice") < 1500])


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE c_custkey % 2 = 0) - count(*) FILTER (WHERE c_custkey % 2 = 1) AS n FROM customer GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(abs(n)), 0)::BIGINT AS n_moved FROM a""")
def absolute_totals(s, d):
    """Totals of a histogram difference, with and without signs."""
    a, b = [table(s, d, "customer").where(F.col("c_custkey") % 2 == i).groupBy(F.col("c_nationkey").alias("key")).agg(quantize.count().alias("n")) for i in (0, 1)]
    return compare.absolute_totals(compare.histogram_difference(a, b, ["key"], ["n"]), ["n"])


@query(f"""SELECT 'customers' AS package, 0::BIGINT AS objects, 0::BIGINT AS shallow WHERE false UNION ALL
  SELECT package, sum(objects)::BIGINT, sum(shallow)::BIGINT FROM (SELECT unnest(['shop', 'shop.' || split_part(name, '.', 2), name]) AS package, objects, shallow FROM ({_CLASS_OBJECTS}) WHERE class_id IN (13, 15)) GROUP BY package""")
def component_packages(s, d):
    """The package section of the component report on customers."""
    shop = _index(s, d).snap
    ids = shop.objects.where(F.col("class_id") == snap.CLASS_OF["customer"]).select("object_id")
    return reports.component_report(shop, ids, F.col("name") == "lines")["packages"]


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Customers as threads, whose frames are their orders by key and hold them as locals."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(s, d, "orders").select(snap.object_id("customer", "o_custkey").alias("thread_id"), (F.row_number().over(w) - 1).alias("depth"), F.col("o_orderpriority").alias("text"), F.array(snap.object_id("orders")).alias("locals"))


@query(f"""SELECT ({OFFSET['customer']} + c_custkey)::BIGINT AS object_id, 48::BIGINT AS shallow, (48 + 56 * count(o_orderkey))::BIGINT AS retained, count(o_orderkey)::BIGINT AS frames, count(o_orderkey)::BIGINT AS locals FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def thread_overview(s, d):
    shop, dom = _dominance(s, d)
    threads = shop.objects.where(F.col("class_id") == snap.CLASS_OF["customer"]).select("object_id")
    out = reports.thread_overview(shop, threads, _frames(s, d), dom)
    return out.select("object_id", "shallow", "retained", F.col("frames").cast("long").alias("frames"), F.col("locals").cast("long").alias("locals"))


@query(f"""SELECT ({OFFSET['customer']} + c_custkey)::BIGINT AS object_id, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1)::INTEGER AS depth, o_orderpriority AS text, ({OFFSET['orders']} + o_orderkey)::BIGINT AS local,
  'shop.trade.Order' AS name, 56::BIGINT AS retained FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT {OFFSET['customer']} + c_custkey, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def thread_details(s, d):
    shop, dom = _dominance(s, d)
    threads = shop.objects.where(F.col("class_id") == snap.CLASS_OF["customer"]).select("object_id")
    return reports.thread_details(shop, threads, _frames(s, d), dom)


@query(f"""SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS depth, o_orderpriority AS text, ({OFFSET['orders']} + o_orderkey)::BIGINT AS local FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)""")
def thread_stack(s, d):
    """The stack of the thread with the greatest id that has one."""
    frames = _frames(s, d)
    return reports.thread_stack(frames, frames.agg(F.max("thread_id")).first()[0]).select("depth", "text", F.explode("locals").alias("local"))


@query(f"""SELECT ({_NODE} + o_orderkey)::BIGINT AS object_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS at, ({OFFSET['orders']} + o_orderkey)::BIGINT AS referent FROM orders""".replace(" AS at", ' AS "at"'))
def finalizer_queue(s, d):
    """Customers' lists as queues, walked from their first entries to their referents."""
    held = _collections(s, d)
    heads = held.refs.where("name = 'first'").select(F.col("dst_id").alias("object_id"))
    return reports.linked_queue(held, heads, following="next", referent="item")


@query(f"""WITH w AS (SELECT n_nationkey AS n, min(o_orderkey) AS o FROM nation, orders WHERE o_orderkey % 25 = n_nationkey GROUP BY 1)
  SELECT ({OFFSET['nation']} + n)::BIGINT AS reference, ({OFFSET['orders']} + o)::BIGINT AS referent FROM w JOIN orders ON o_orderkey = o JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n""")
def reference_leak(s, d):
    """Each nation refers weakly to an order, which is also its customers' in some."""
    shop = _index(s, d).snap
    first = table(s, d, "orders").groupBy((F.col("o_orderkey") % 25).alias("n")).agg(F.min("o_orderkey").alias("o")).join(table(s, d, "nation"), F.col("n") == F.col("n_nationkey"))
    weak = first.select(snap.object_id("nation").alias("src_id"), snap.object_id("orders", "o").alias("dst_id"), F.lit("referent").alias("name"))
    held = snap.Snapshot(shop.objects, shop.classes, shop.refs.unionByName(weak), shop.roots)
    return reports.reference_leak(held, shop.objects.where(F.col("class_id") == snap.CLASS_OF["nation"]))


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
  SELECT part, 'shop.trade.Order' AS name, n AS objects, 56 * n AS shallow FROM o, (SELECT unnest(['referents', 'only weakly']) AS part) WHERE n > 0""")
def reference_statistics(s, d):
    """A nation's customers as references to their orders: all referents, what they alone retain, and none held strongly."""
    at = _index(s, d)
    shop = at.snap
    ids = table(s, d, "customer").where("c_nationkey = 7").select(snap.object_id("customer").alias("object_id"))
    orders = table(s, d, "orders").select(snap.object_id("customer", "o_custkey").alias("of"), snap.object_id("orders").alias("object_id")).join(ids.withColumnRenamed("object_id", "of"), "of", "left_semi")
    parts = inspections.reference_statistics(shop, orders.select("object_id"), ids, ["orders"], at.edges, at.tree)
    return reduce(DataFrame.unionByName, [h.select(F.lit(n).alias("part"), "name", "objects", "shallow") for n, h in zip(("referents", "only weakly", "strongly"), parts)])


_GROWN = f"""SELECT ({OFFSET['region']} + r_regionkey)::BIGINT AS object_id, (24 + coalesce((SELECT sum(32 + (SELECT 48 * count(*) FROM customer WHERE c_nationkey = n_nationkey) + 56 * (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderkey % {{}} <> 0)) FROM nation WHERE n_regionkey = r_regionkey), 0))::BIGINT AS retained FROM region"""


@query(f"""WITH a AS ({_GROWN.format(3)}), b AS ({_GROWN.format(5)}), h AS (SELECT 24 * (SELECT count(*) FROM region) + 32 * (SELECT count(*) FROM nation) + 48 * (SELECT count(*) FROM customer) + 56 * (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS heap),
  g AS (SELECT object_id, b.retained - a.retained AS growth FROM a JOIN b USING (object_id)) SELECT 'object' AS kind, 'shop.place.Region' AS name, object_id, growth::BIGINT AS growth FROM g, h WHERE growth > 0.02 * heap
  UNION ALL SELECT 'class', 'shop.place.Region', NULL, sum(growth)::BIGINT FROM g, h WHERE growth <= 0.02 * heap HAVING sum(growth) > 0.02 * max(heap)""")
def find_leaks2_changes(s, d):
    """Growth between two heaps where some orders have gone and others come."""
    shop, parts = _index(s, d).snap, []
    kept = snap.CLASS_OF["region"], snap.CLASS_OF["nation"], snap.CLASS_OF["customer"], snap.CLASS_OF["orders"]
    number = lambda c: F.col(c) - OFFSET["orders"]
    for k in (3, 5):
        objects = shop.objects.where(F.col("class_id").isin(*kept) & ((F.col("class_id") != snap.CLASS_OF["orders"]) | (number("object_id") % k != 0)))
        refs = shop.refs.where(F.col("name").isin("nations", "customers") | ((F.col("name") == "orders") & (number("dst_id") % k != 0)))
        parts.append(snap.Snapshot(objects, shop.classes, refs, shop.roots))
    return reports.find_leaks2(*parts, *[graph.dominance(p.refs, p.roots) for p in parts], threshold_percent=2.0)


#: Fields by which each object refers to what owns it.
_OWNER_FIELDS = {"nations": "region", "customers": "nation", "suppliers": "nation", "orders": "customer", "lines": "order", "supplied": "supplier"}
_TEMPLATES = {
    "shop.place.Place": "{self}", "shop.party.Party": "{self} ({nation})", "shop.party.Supplier": "{nation}",
    "shop.trade.Order": "{self} of {customer}", "shop.trade.LineItem": "{self}: {order} from {supplier}",
}


@query("""WITH c AS (SELECT c_custkey AS k, coalesce(c_name, '') || ' (' || coalesce(n_name, '') || ')' AS t FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
  s AS (SELECT s_suppkey AS k, n_name AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  o AS (SELECT o_orderkey AS k, coalesce(o_orderpriority, '') || ' of ' || coalesce(c.t, '') AS t FROM orders LEFT JOIN c ON o_custkey = c.k),
  l AS (SELECT DISTINCT * FROM lineitem),
  a AS (SELECT 'shop.place.Region' AS name, r_name AS display_name FROM region UNION ALL SELECT 'shop.place.Nation', n_name FROM nation
    UNION ALL SELECT 'shop.party.Customer', t FROM c UNION ALL SELECT 'shop.party.Supplier', t FROM s UNION ALL SELECT 'shop.trade.Order', t FROM o
    UNION ALL SELECT 'shop.trade.LineItem', coalesce(l_returnflag, '') || ': ' || coalesce(o.t, '') || ' from ' || coalesce(s.t, '') FROM l LEFT JOIN o ON l_orderkey = o.k LEFT JOIN s ON l_suppkey = s.k)
  SELECT name, display_name, count(*)::BIGINT AS objects FROM a WHERE display_name IS NOT NULL GROUP BY ALL""")
def display_names(s, d):
    """Names by templates of classes, filled along references; suppliers go by their nation's name, other parties by a template of their superclass."""
    shop = _index(s, d).snap
    field = F.element_at(F.create_map(*[F.lit(x) for pair in _OWNER_FIELDS.items() for x in pair]), F.col("name"))
    refs = shop.refs.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), field.alias("name"))
    found = names.display_names(snap.Snapshot(shop.objects, shop.classes, refs, shop.roots), _TEMPLATES)
    named = found.join(shop.objects.select("object_id", "class_id"), "object_id").join(F.broadcast(shop.classes.select("class_id", "name")), "class_id")
    return named.groupBy("name", "display_name").agg(F.count(F.lit(1)).alias("objects"))
