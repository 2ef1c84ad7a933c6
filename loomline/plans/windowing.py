"""Order-dependent queries over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import version_key
from ..operators import windows as wn
from ..registry import query


@query(
    "w1_row_order",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS row_order FROM lineitem",
)
def w1(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    made = wn.sequence_in(rows, "row_order", ["l_orderkey", "l_returnflag"], F.col("l_linenumber"), F.col("l_partkey"), start=1)
    return made.select("l_orderkey", "l_linenumber", "row_order")


@query("w2_event_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def w2(t):
    return wn.sequence_in(t.events, "seq", ["user_id"], F.col("ts"), F.col("event_id")).select("event_id", "seq")


@query(
    "w3_number_allocator",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'A' THEN 1000 + l_suppkey % 20 END AS x FROM lineitem),
       f AS (SELECT *, sum((x IS NULL)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS free FROM e),
       g AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN x - free END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS lead FROM f)
       SELECT l_orderkey, l_linenumber, coalesce(x, greatest(coalesce(lead, 999), 999) + free)::BIGINT AS number FROM g""",
)
def w3(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = t.lineitem.select("l_orderkey", *order, F.when(F.col("l_returnflag") == "A", 1000 + F.col("l_suppkey") % 20).alias("x"))
    return wn.allocate_numbers(rows, ["l_orderkey"], order, "x").select("l_orderkey", "l_linenumber", "number")


@query("w5_latest_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w5(t):
    newest = wn.latest(t.orders, ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())
    return newest.select("o_custkey", "o_orderkey")


@query(
    "w6_w7_o10_latest_version",
    """SELECT p_brand, p_partkey FROM (SELECT *, (p_size % 3) AS a, (p_size % 12) AS b FROM part)
       QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC, p_partkey) = 1""",
)
def w6(t):
    """Versions compare by number, so 1.10 is above 1.9."""
    rows = t.part.withColumn("version", F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 12).cast("string")))
    return wn.latest(rows, ["p_brand"], version_key(F.col("version")).desc(), F.col("p_partkey")).select("p_brand", "p_partkey")


@query("w8_max_version", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)")
def w8(t):
    top = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", top.alias("top")).where("l_linenumber = top").drop("top")


@query(
    "w9_w10_publication_order",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS core_order FROM orders",
)
def w9(t):
    listed = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    return listed.select("o_custkey", F.posexplode("o").alias("core_order", "x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("core_order").cast("long"))


@query(
    "w11_s15_fill_down",
    """WITH s AS (SELECT user_id, event_id, event_type = 'click' AS blank, CASE WHEN event_type = 'view' THEN event_id::VARCHAR END AS page FROM events),
       g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM s)
       SELECT event_id, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page
       FROM g WHERE NOT blank""",
)
def w11(t):
    rows = t.events.select(
        "user_id", "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).otherwise("").alias("page")
    )
    return wn.fill_down(rows, ["user_id"], "event_id", "page", F.col("event_type") == "click").select("event_id", "page")


@query(
    "w13_rank_with_ties",
    """SELECT l_orderkey, min(l_linenumber) AS best, count(*) AS ties FROM (
         SELECT * FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) = 1) GROUP BY 1""",
)
def w13(t):
    """Ties for the best are counted after a maximum per key."""
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("top"))
    met = t.lineitem.join(best, (F.col("l_orderkey") == F.col("k")) & (F.col("l_quantity") == F.col("top")))
    return met.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("best"), F.count("*").alias("ties"))


@query(
    "w15_latest_by_text_version",
    "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size::VARCHAR DESC, p_partkey DESC) = 1",
)
def w15(t):
    """Versions compare as text here, so 9 is above 10."""
    return wn.latest(t.part, ["p_brand"], F.col("p_size").cast("string").desc(), F.col("p_partkey").desc()).select("p_brand", "p_partkey")


@query("w4_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def w4(t):
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("n"))
