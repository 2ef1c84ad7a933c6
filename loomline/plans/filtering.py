"""Filters over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import differs
from ..operators import filters as fl
from ..registry import query


@query(
    "results_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, total_rows > 50 AS has_more FROM (
         SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, count(*) OVER () AS total_rows,
                row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn
         FROM lineitem JOIN part ON l_partkey = p_partkey
         WHERE l_returnflag = 'R' AND (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%')) WHERE rn <= 50""",
)
def results_page(t):
    """F1, F2, O1, O2: a page of the rows in scope that contain a text, in canonical order, and whether there are more. One row
    more than the page is asked for, so the order is a top-k, not a sort of all rows."""
    rows = fl.scope(t.lineitem, l_returnflag="R").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    found = fl.contains_any(rows, ["p_name", "p_brand", "p_type"], "a")
    order = [F.col(c).asc_nulls_last() for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    page = found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_name").orderBy(*order).limit(51)
    numbered = page.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    more = F.max("rn").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 50
    return numbered.withColumn("has_more", more).where("rn <= 50").drop("rn")


@query("f1_scope_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_suppkey = 7")
def f1(t):
    return fl.scope(t.lineitem, l_returnflag="A", l_linestatus="F", l_suppkey=7, l_partkey=None).select("l_orderkey", "l_linenumber")


@query("f2_contains_any", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%9%' OR c_mktsegment ILIKE '%build%'")
def f2(t):
    one = fl.contains_any(t.customer, ["c_name"], "9%").select("c_custkey")
    return one.union(fl.contains_any(t.customer, ["c_mktsegment"], "build;").select("c_custkey")).distinct()


@query("f4_optional_scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def f4(t):
    want = fl.optional_scope(F.col("o_orderstatus"), ["F", "P"]) & fl.optional_scope(F.col("o_custkey"), None)
    return t.orders.where(want & fl.optional_scope(F.col("o_orderpriority"), [])).select("o_orderkey")


@query("f6_scope_cte", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 1000 GROUP BY ALL")
def f6(t):
    picked = t.orders.where(F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") > 1000))
    return picked.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("f7_in_set", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (3, 5, 11)")
def f7(t):
    return t.lineitem.where(fl.in_set(F.col("l_partkey"), [5, 3, 5, 11, 3])).select("l_orderkey", "l_linenumber")


@query(
    "f8_number_range",
    "SELECT 'N' || lpad(p_partkey::VARCHAR, 4, '0') AS number FROM part WHERE p_partkey BETWEEN 98 AND 105",
)
def f8(t):
    numbered = t.part.select(F.format_string("N%04d", "p_partkey").alias("number"))
    return fl.by_number(numbered, "number", "N0098-105")


@query("f9_literal_first", "SELECT p_partkey FROM part WHERE p_partkey = 10")
def f9(t):
    """The text is a number that exists, though it reads as a range too."""
    numbered = t.part.select("p_partkey", F.when(F.col("p_partkey") == 10, "A1-3").otherwise(F.format_string("A%d", "p_partkey")).alias("n"))
    return fl.by_number(numbered, "n", "A1-3").select("p_partkey")


@query(
    "f10_null_safe_difference",
    """SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM nullif(left(o_orderpriority, 1), '3')""",
)
def f10(t):
    a = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return t.orders.where(differs(a, F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("3")))).select("o_orderkey")


@query(
    "f12_rule_violations",
    """SELECT l_orderkey, l_linenumber, rule FROM (
         SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT l_discount <= 0.05 THEN 'discount' END,
                CASE WHEN NOT l_returnflag IN ('A', 'R') THEN 'flag' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)""",
)
def f12(t):
    rules = {"discount": F.col("l_discount") <= 0.05, "flag": F.col("l_returnflag").isin("A", "R")}
    return fl.violations(t.lineitem, ["l_orderkey", "l_linenumber"], rules)


@query("f13_owner_rows", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3)")
def f13(t):
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return fl.visible_to(t.orders, owners, "o_custkey", F.col("c_nationkey") == 3).select("o_orderkey")


@query(
    "f14_latest_either_end",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey = 42 OR l_suppkey = 42)
       QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1""",
)
def f14(t):
    either = t.lineitem.where(F.array_contains(F.array("l_partkey", "l_suppkey"), F.lit(42).cast("long")))
    newest = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return either.withColumn("newest", newest).where("l_linenumber = newest").select("l_orderkey", "l_linenumber")


@query(
    "f15_orientation",
    """SELECT event_id, CASE WHEN trim(coalesce(nullif(event_type, 'click'), '')) = '' THEN 'unknown' ELSE 'source' END AS endpoint_role
       FROM events WHERE user_id % 3 <> 0""",
)
def f15(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("user_id") % 3 == 0, "receiver").otherwise("source").alias("endpoint_role"),
        F.nullif(F.col("event_type"), F.lit("click")).alias("direction_basis"),
    )
    return fl.oriented(rows).select("event_id", "endpoint_role")


@query(
    "f16_start_orientation",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'needs_review' ELSE 'complete' END AS status FROM events WHERE user_id % 5 <> 1",
)
def f16(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("user_id") % 5 == 1, "receiver").alias("endpoint_role"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("start_terminal"),
        F.lit("complete").alias("status"),
    )
    return fl.oriented_from_start(rows).select("event_id", "status")


@query("f17_filter_escapes", "SELECT 0::BIGINT AS escaped, count(*) AS found FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '2%'")
def f17(t):
    """Exact AND filters, and how many rows of the result are outside them."""
    want = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("2")
    found = t.orders.where(want)
    return found.agg(F.count_if(~want).alias("escaped"), F.count("*").alias("found"))


@query(
    "f18_any_column_contains",
    "SELECT s_suppkey FROM supplier WHERE contains(lower(concat_ws(' ', s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR)), '13')",
)
def f18(t):
    return fl.any_column_contains(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "13").select("s_suppkey")


@query("f19_history", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3")
def f19(t):
    return t.lineitem.where(F.col("l_linenumber") < 3).select("l_orderkey", "l_linenumber")


@query(
    "f22_version_guard",
    "SELECT o_orderkey FROM orders WHERE (o_orderkey % 7) IS DISTINCT FROM 3 OR o_orderstatus IS DISTINCT FROM 'O'",
)
def f22(t):
    rows = t.orders.withColumn("version", F.col("o_orderkey") % 7)
    return fl.changed_since(rows, {"version": F.lit(3), "o_orderstatus": F.lit("O")}).select("o_orderkey")


@query(
    "f11_f23_valid_points",
    """SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN 0 AND 1 AND embedding[2] BETWEEN 0 AND 1 AND label >= 1""",
)
def f11(t):
    from ..functions.scalars import valid_point

    return t.embeddings.where(valid_point(F.col("embedding")[0], F.col("embedding")[1], F.col("label"))).select("vec_id")


@query("f24_needs_review", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01'")
def f24(t):
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.to_timestamp(F.lit("1997-01-01")))
    return t.lineitem.where(wanted).select("l_orderkey", "l_linenumber")


@query(
    "f25_json_path",
    "SELECT event_id FROM events WHERE json_extract_string(props, '$.deleted_at') IS NULL AND user_id % 10 = 1",
)
def f25(t):
    return t.events.where(F.get_json_object("props", "$.deleted_at").isNull() & (F.col("user_id") % 10 == 1)).select("event_id")


@query("f3_search_text", r"SELECT page_id, left(regexp_replace(trim('  ' || url || '*%' || left(html, 300)), '[^\p{L}\p{N} :_+\-]', '', 'g'), 100) AS search FROM pages")
def f3(t):
    """What a search keeps of what is typed: no quotes, wildcards or signs, and its first 100 characters."""
    typed = F.concat(F.lit("  "), F.col("url"), F.lit("*%"), F.substring("html", 1, 300))
    return t.pages.select("page_id", fl.searched(typed).alias("search"))
