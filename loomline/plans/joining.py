"""Joins over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as jn
from ..registry import query


@query(
    "j1_read_view",
    """SELECT l_orderkey, l_linenumber, c_name, n_name, r_name, s_name FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN supplier ON coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END, l_partkey) = s_suppkey""",
)
def j1(t):
    """Four inner joins and a left join on the first of two ids."""
    rows = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    either = F.coalesce(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")), F.col("l_partkey"))
    return rows.join(t.supplier, either == F.col("s_suppkey"), "left").select(
        "l_orderkey", "l_linenumber", "c_name", "n_name", "r_name", "s_name"
    )


@query(
    "j2_latest_child",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (
         SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""",
)
def j2(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return jn.latest_child(t.customer.select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query(
    "j3_lateral_unnest",
    "SELECT event_id, key AS k FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key)",
)
def j3(t):
    return lateral_keys(t.events)


def lateral_keys(events):
    return events.select("event_id", F.explode(F.json_object_keys("props")).alias("k"))


@query("j4_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def j4(t):
    big = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query(
    "j5_owner_or_member",
    """SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)
       OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)""",
)
def j5(t):
    from ..operators.filters import visible_to_any

    a = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    b = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return visible_to_any(t.nation, "n_nationkey", a, b).select("n_nationkey")


@query("j6_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j6(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(
    "j7_update_from",
    """SELECT o_orderkey, o_orderstatus AS old_status, CASE WHEN n > 4 THEN 'R' ELSE o_orderstatus END AS new_status
       FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def j7(t):
    """What an update from a joined set writes, with old and new values."""
    picked = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(picked, "o_orderkey").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("old_status"),
        F.when(F.col("n") > 4, "R").otherwise(F.col("o_orderstatus")).alias("new_status"),
    )


@query(
    "j8_first_candidate",
    """SELECT n.n_nationkey, coalesce(a.r_name, b.r_name) AS r_name FROM nation n
       LEFT JOIN region a ON a.r_regionkey = n.n_nationkey LEFT JOIN region b ON b.r_regionkey = n.n_regionkey""",
)
def j8(t):
    """A key, then a fallback key: the first that the lookup has wins."""
    rows = t.nation.select("n_nationkey", "n_regionkey")
    lookup = t.region.select(F.col("r_regionkey").alias("k"), "r_name")
    return jn.first_candidate(rows, lookup, ["n_nationkey", "n_regionkey"], "k", "r_name").select("n_nationkey", "r_name")


@query(
    "j10_unique_lookup",
    """SELECT o_orderkey, CASE WHEN m = 1 THEN k END AS l_suppkey, coalesce(m, 0) AS matches FROM orders
       LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS m, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def j10(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return jn.unique_match(t.orders.select("o_orderkey"), lines, ["o_orderkey"], ["l_suppkey"], ["l_suppkey"])


@query(
    "j11_unique_sheet",
    """SELECT n_nationkey, CASE WHEN m = 1 THEN k END AS s_suppkey, coalesce(m, 0) AS matches FROM nation
       LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS m, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
       ON s_nationkey = n_nationkey""",
)
def j11(t):
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return jn.unique_match(t.nation.select("n_nationkey"), rich, ["n_nationkey"], ["s_suppkey"], ["s_suppkey"])


@query(
    "j12_address_lookup",
    """SELECT l_orderkey, l_linenumber, p_name, p_name IS NULL AS external FROM lineitem
       LEFT JOIN part ON l_partkey = p_partkey AND l_quantity BETWEEN 1 AND 48""",
)
def j12(t):
    """A lookup that counts only for columns 1 to 48; else the reference is external."""
    joined = t.lineitem.join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & F.col("l_quantity").between(1, 48), "left")
    return joined.select("l_orderkey", "l_linenumber", "p_name", F.col("p_name").isNull().alias("external"))


@query("j16_profile_map", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j16(t):
    """A small dimension, left to the optimiser's broadcast threshold."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query(
    "j17_nested_assembly",
    """SELECT r_name, count(DISTINCT n_nationkey) AS nations, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names,
              count(s_suppkey) AS suppliers
       FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name""",
)
def j17(t):
    """A parent with its children assembled: children are counted before they meet their parent."""
    per = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    kids = t.nation.join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    inside = kids.groupBy("n_regionkey").agg(
        F.count("*").alias("nations"), F.array_sort(F.collect_list("n_name")).alias("names"), F.sum(F.coalesce("n", F.lit(0))).alias("suppliers")
    )
    return t.region.join(inside, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "r_name", "nations", F.array_join("names", ",").alias("names"), "suppliers"
    )


@query(
    "j18_union_of_evidence",
    """SELECT k AS o_orderkey, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS target FROM (
         SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderstatus = 'P'
         UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity = 50) GROUP BY k""",
)
def j18(t):
    a = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("v"))
    b = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("v"))
    return a.union(b).groupBy("o_orderkey").agg(F.when(F.min("v") == F.max("v"), F.min("v")).alias("target"))


@query(
    "j19_history_versions",
    """SELECT c.l_orderkey, c.l_linenumber, count(h.l_linenumber) AS earlier, string_agg(h.l_suppkey::VARCHAR, ',' ORDER BY h.l_linenumber, h.l_suppkey) AS targets
       FROM lineitem c JOIN lineitem h ON c.l_orderkey = h.l_orderkey AND c.l_returnflag = h.l_returnflag AND h.l_linenumber < c.l_linenumber
       WHERE c.l_quantity > 40 GROUP BY ALL""",
)
def j19(t):
    """All earlier versions with the same identity, not the nearest one."""
    now = t.lineitem.where("l_quantity > 40").select("l_orderkey", "l_returnflag", "l_linenumber")
    old = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("v"), "l_suppkey")
    met = now.join(old, ["l_orderkey", "l_returnflag"]).where("v < l_linenumber")
    return met.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("earlier"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",").alias("targets"),
    )


@query(
    "j22_unique_pins",
    """SELECT o.k AS pin, o.i AS order_id, s.i AS supplier_id FROM
       (SELECT o_custkey AS k, min(o_orderkey) AS i FROM orders GROUP BY 1 HAVING count(*) = 1) o
       JOIN (SELECT l_partkey AS k, min(l_orderkey) AS i FROM lineitem WHERE l_quantity = 1 GROUP BY 1 HAVING count(*) = 1) s ON o.k = s.k""",
)
def j22(t):
    a = t.orders.select(F.col("o_custkey").alias("pin"), F.col("o_orderkey").alias("order_id"))
    b = t.lineitem.where("l_quantity = 1").select(F.col("l_partkey").alias("pin"), F.col("l_orderkey").alias("supplier_id"))
    return jn.unique_both_sides(a, b, ["pin"], "order_id", "supplier_id")


@query(
    "j23_name_binding",
    """SELECT k AS name, count(*) AS n, CASE count(*) WHEN 1 THEN 'one' ELSE 'many' END AS verdict FROM (
         SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS k FROM part WHERE p_size < 10) GROUP BY k""",
)
def j23(t):
    from ..functions.scalars import name_key

    named = t.part.where("p_size < 10").groupBy(name_key(F.col("p_brand")).alias("name")).agg(F.count("*").alias("n"))
    return named.withColumn("verdict", F.when(F.col("n") == 1, "one").otherwise("many"))


@query(
    "j25_lookup_chain",
    """SELECT l_orderkey, l_linenumber, coalesce(s_nationkey, c_nationkey, -1) AS page FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
)
def j25(t):
    rich_s, rich_c = t.supplier.where("s_acctbal > 0"), t.customer.where("c_acctbal > 0")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(rich_s, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(rich_c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("s_nationkey", "c_nationkey", F.lit(-1)).alias("page"))


_BEFORE_AFTER = """b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0),
       a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s,
                    CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c FROM orders WHERE o_orderkey % 4 <> 0)"""


def before_after(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    after = o.where("k % 4 <> 0").select(
        "k", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")).alias("s"), (F.col("c") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("c")
    )
    return o.where("k % 3 <> 0"), after


@query(
    "j26_full_outer_diff",
    f"""WITH {_BEFORE_AFTER}
       SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'add' WHEN a.k IS NULL THEN 'remove' ELSE 'replace' END AS change,
         CASE WHEN b.k IS NULL OR a.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.c IS DISTINCT FROM b.c THEN 'c' END) END AS fields
       FROM b FULL JOIN a ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.c IS DISTINCT FROM b.c""",
)
def j26(t):
    return jn.full_diff(*before_after(t), "k", ["s", "c"]).withColumn("fields", F.array_join("fields", ","))


@query(
    "j27_scope_validator",
    f"""WITH {_BEFORE_AFTER} SELECT b.k FROM b JOIN a ON a.k = b.k WHERE a.c IS DISTINCT FROM b.c""",
)
def j27(t):
    """Replaced rows that change a field outside the allowed ones (`s`)."""
    changed = jn.full_diff(*before_after(t), "k", ["s", "c"]).where("change = 'replace'")
    return changed.where(F.size(F.array_except("fields", F.array(F.lit("s")))) > 0).select("k")


@query("j29_exact_else_contains", "SELECT n_name FROM nation WHERE contains(lower(n_name), '1')")
def j29(t):
    return jn.exact_else_contains(t.nation, "n_name", "1").select("n_name")


@query(
    "j31_gather_by_priority",
    """SELECT o_orderkey, min(p) AS priority FROM (SELECT o_orderkey, 1 AS p FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, 3 FROM lineitem WHERE l_tax = 0) GROUP BY 1""",
)
def j31(t):
    one = lambda df, k, p: df.select(F.col(k).alias("o_orderkey"), F.lit(p).alias("p"))
    parts = one(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", 1).union(one(t.lineitem.where("l_quantity > 45"), "l_orderkey", 2))
    parts = parts.union(one(t.lineitem.where("l_tax = 0"), "l_orderkey", 3))
    return parts.groupBy("o_orderkey").agg(F.min("p").alias("priority"))


@query(
    "j32_turn_history",
    """SELECT conv_id, count(*) AS turns, max(turn) FILTER (role = 'user') AS last_user_turn FROM conversations GROUP BY 1""",
)
def j32(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"))


@query(
    "j34_case_alignment",
    "SELECT d.doc_id, d.quality AS expected, (s.n_chars > 1000)::INT AS actual FROM labels d JOIN documents s ON d.doc_id = s.doc_id",
)
def j34(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("expected"), (F.col("n_chars") > 1000).cast("int").alias("actual")
    )


@query(
    "j37_any_unreviewed",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 1)",
)
def j37(t):
    hit = t.lineitem.join(t.part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(hit, "o_orderkey", "left_semi").select("o_orderkey")


@query(
    "w12_unique_over",
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) = 1 AS alone FROM lineitem",
)
def w12(t):
    alone = F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag")) == 1
    return t.lineitem.select("l_orderkey", "l_linenumber", alone.alias("alone"))
