"""Aggregations over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import exceeds_ratio
from ..operators import aggregates as ag
from ..registry import query


@query(
    "a1_conditional_counts",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 200000) AS large
       FROM orders GROUP BY 1""",
)
def a1(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large")
    )


@query("a2_next_sequence", "SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) + 1 AS next_seq FROM events GROUP BY 1")
def a2(t):
    return t.events.groupBy("user_id").agg(
        (F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(-1)) + 1).alias("next_seq")
    )


@query(
    "a3_ordered_json",
    """SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines
       FROM lineitem GROUP BY 1""",
)
def a3(t):
    return ordered_json(t.lineitem)


def ordered_json(lines):
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    return lines.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("lines"))


@query("a4_string_agg", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def a4(t):
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("a5_array_agg", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def a5(t):
    listed = ag.ordered_list(F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.col("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(listed, ",").alias("orders"))


@query(
    "a6_object_agg",
    "SELECT n_regionkey, max(n_nationkey) FILTER (n_nationkey % 2 = 0) AS even_key, count(*) AS size FROM nation GROUP BY 1",
)
def a6(t):
    """A map gathered per group; two of its facts are shown."""
    made = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    even = F.array_max(F.filter(F.map_values("m"), lambda x: x % 2 == 0))
    return made.select("n_regionkey", even.alias("even_key"), F.size("m").cast("long").alias("size"))


@query(
    "a7_progress_rollup",
    """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS rendered, count(*) FILTER (event_type = 'purchase') AS completed,
              count(*) FILTER (value > 50) AS needs_review FROM events GROUP BY 1""",
)
def a7(t):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("total"), kind("click").alias("rendered"), kind("purchase").alias("completed"), F.count_if(F.col("value") > 50).alias("needs_review")
    )


@query(
    "a8_stage_coverage",
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS seen, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY 1""",
)
def a8(t):
    """Expected numbers 1 to the largest against those seen, both ways."""
    seen = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("s"))
    want = F.sequence(F.lit(1), F.array_max("s"))
    same = (F.size(F.array_except(want, "s")) == 0) & (F.size(F.array_except("s", want)) == 0)
    return seen.select("l_orderkey", F.size("s").cast("long").alias("seen"), same.alias("complete"))


@query(
    "a9_group_first_appearance",
    "SELECT o_orderpriority, min(o_orderkey) AS first_key, count(*) AS n FROM orders GROUP BY 1",
)
def a9(t):
    return t.orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("first_key"), F.count("*").alias("n"))


@query(
    "a11_unit_merge",
    """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS status, min(o_orderkey) AS first_order,
              string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1""",
)
def a11(t):
    """Records of one identity become one: the first filled value in order wins, page sets are united."""
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    years = F.array_sort(F.collect_set(F.year("o_orderdate").cast("string")))
    return t.orders.groupBy("o_custkey").agg(
        ag.first_filled_by(status, F.col("o_orderkey")).alias("status"), F.min("o_orderkey").alias("first_order"), F.array_join(years, ",").alias("years")
    )


@query(
    "a12_connection_dedup",
    """SELECT l_partkey, l_suppkey, min(l_orderkey) AS kept, count(*) AS merged, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS worst
       FROM lineitem GROUP BY 1, 2""",
)
def a12(t):
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("kept"), F.count("*").alias("merged"), F.max(rank).alias("worst"))


@query(
    "a15_consensus",
    """SELECT l_orderkey, CASE WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'conflicting' ELSE 'unavailable' END AS state, CASE WHEN k = 1 THEN a END AS answer
       FROM (SELECT l_orderkey, count(DISTINCT x) AS k, min(x) AS a FROM (
         SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS x FROM lineitem) GROUP BY 1)""",
)
def a15(t):
    rows = t.lineitem.select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("x"), F.col("l_quantity").alias("c"), F.col("l_linenumber").alias("seq"))
    return ag.consensus(rows, ["l_orderkey"], "x", "c", "seq")


@query("a16_a17_any_flag", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS needs_review, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1")
def a16(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("needs_review"), F.bool_and(F.col("l_linestatus") == "F").alias("complete")
    )


@query(
    "a18_review_overlay",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'pending_review' ELSE o_orderstatus END AS status
       FROM orders""",
)
def a18(t):
    flagged = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    joined = t.orders.join(flagged, F.col("o_orderkey") == F.col("k"), "left")
    return joined.select("o_orderkey", F.when(F.col("k").isNotNull(), "pending_review").otherwise(F.col("o_orderstatus")).alias("status"))


@query(
    "a20_u4_multiset_difference",
    """(SELECT l_suppkey AS k, 'missing' AS side FROM lineitem WHERE l_quantity > 30 EXCEPT ALL SELECT l_suppkey, 'missing' FROM lineitem WHERE l_discount > 0.04)
       UNION ALL (SELECT l_suppkey, 'extra' FROM lineitem WHERE l_discount > 0.04 EXCEPT ALL SELECT l_suppkey, 'extra' FROM lineitem WHERE l_quantity > 30)""",
)
def a20(t):
    k = F.col("l_suppkey").alias("k")
    return ag.multiset_difference(t.lineitem.where("l_quantity > 30").select(k), t.lineitem.where("l_discount > 0.04").select(k))


@query("a21_missing_required", "SELECT count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) AS missing_status, count(*) FILTER (o_totalprice < 1000) AS missing_price FROM orders")
def a21(t):
    return t.orders.agg(
        F.count_if(F.nullif("o_orderstatus", F.lit("P")).isNull()).alias("missing_status"), F.count_if(F.col("o_totalprice") < 1000).alias("missing_price")
    )


@query(
    "a23_precision_recall",
    """SELECT lang, CASE WHEN p = 0 THEN 1.0 ELSE b / p END::DOUBLE AS precision, CASE WHEN e = 0 THEN 1.0 ELSE b / e END::DOUBLE AS recall FROM (
         SELECT lang, count(*) FILTER (toxic = 1 AND n_chars > 1500) AS b, count(*) FILTER (n_chars > 1500) AS p, count(*) FILTER (toxic = 1) AS e
         FROM labels JOIN documents USING (doc_id) GROUP BY 1)""",
)
def a23(t):
    hits = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", (F.col("toxic") == 1).alias("expected"), (F.col("n_chars") > 1500).alias("predicted")
    )
    return ag.precision_recall(hits, "lang")


@query("a24_nearest_rank_p95", "SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def a24(t):
    return ag.nearest_rank(t.events, "value", 0.95, "event_type")


@query("a25_cost", "SELECT user_id % 10 AS g, round(sum(value), 3) AS cost FROM events GROUP BY 1")
def a25(t):
    return t.events.groupBy((F.col("user_id") % 10).alias("g")).agg(F.round(F.sum("value"), 3).alias("cost"))


@query(
    "a26_x35_release_gate",
    """SELECT event_type, concat_ws(',', CASE WHEN hi > lo * 1.2 THEN 'latency' END, CASE WHEN n1 > n0 * 1.2 THEN 'count' END) AS violations FROM (
         SELECT event_type, max(value) FILTER (event_id % 2 = 1) AS hi, max(value) FILTER (event_id % 2 = 0) AS lo,
                count(*) FILTER (event_id % 3 > 0) AS n1, count(*) FILTER (event_id % 3 = 0) AS n0 FROM events GROUP BY 1)""",
)
def a26(t):
    top = lambda c: F.max(F.when(c, F.col("value")))
    e = F.col("event_id")
    sums = t.events.groupBy("event_type").agg(
        top(e % 2 == 1).alias("hi"), top(e % 2 == 0).alias("lo"), F.count_if(e % 3 > 0).alias("n1"), F.count_if(e % 3 == 0).alias("n0")
    )
    broken = F.array_compact(
        F.array(
            F.when(exceeds_ratio(F.col("hi"), F.col("lo")), F.lit("latency")), F.when(exceeds_ratio(F.col("n1"), F.col("n0")), F.lit("count"))
        )
    )
    return sums.select("event_type", F.array_join(broken, ",").alias("violations"))


@query(
    "a27_a30_table_digest",
    """WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
       r AS (SELECT h, count(*) AS n FROM h GROUP BY 1), b AS (SELECT left(h, 3) AS b, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS d FROM r GROUP BY 1)
       SELECT sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM b""",
)
def a27(t):
    """One digest of a table whatever the order of its rows."""
    return ag.table_digest(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(
    "a31_w14_contiguous_prefix",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber - 1 AS a, 1 + l_suppkey % 2 AS n FROM lineitem WHERE l_linenumber <> 3),
       w AS (SELECT *, max(a + n) OVER (PARTITION BY k ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
       g AS (SELECT *, max((a > coalesce(reach, 0))::INT) OVER (PARTITION BY k ORDER BY a, n) AS gap FROM w)
       SELECT k, coalesce(max(a + n) FILTER (gap = 0), 0)::BIGINT AS covered, coalesce(max(a + n) FILTER (gap = 0), 0) >= 5 AS complete FROM g GROUP BY k""",
)
def a31(t):
    pages = t.lineitem.where("l_linenumber <> 3").select(
        F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("a"), (1 + F.col("l_suppkey") % 2).alias("n"), F.lit(5).alias("total")
    )
    return ag.contiguous_prefix(pages, ["k"], "a", "n", "total")


@query(
    "a32_drawing_merge",
    """SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS ids, arg_min(l_returnflag, (l_returnflag = 'N')::INT * 1000000000 + l_orderkey * 10 + l_linenumber) AS role
       FROM lineitem GROUP BY 1""",
)
def a32(t):
    """One per page; ids united; a role that isn't the last resort is preferred, then the earliest."""
    ids = F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",")
    role = F.min_by("l_returnflag", F.struct(F.col("l_returnflag") == "N", F.col("l_orderkey"), F.col("l_linenumber")))
    return t.lineitem.groupBy("l_partkey").agg(ids.alias("ids"), role.alias("role"))


@query(
    "a33_scan_outcome",
    """SELECT o_custkey % 50 AS g, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > count(*) FILTER (o_orderstatus = 'O') THEN 'kept'
         WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'unknown' ELSE 'empty' END AS outcome FROM orders GROUP BY 1""",
)
def a33(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    outcome = F.when(n("F") > n("O"), "kept").when(n("P") > 0, "unknown").otherwise("empty")
    return t.orders.groupBy((F.col("o_custkey") % 50).alias("g")).agg(outcome.alias("outcome"))


@query(
    "a35_audit_receipt",
    "SELECT count(*) AS changed, sum(l_orderkey)::BIGINT AS key_sum FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def a35(t):
    return t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").agg(F.count("*").alias("changed"), F.sum("l_orderkey").alias("key_sum"))


@query(
    "a38_signature_groups",
    """SELECT event_type, user_id % 7 AS sig, count(*) AS n, bool_or(value > 95) AS critical FROM events GROUP BY 1, 2
       HAVING count(*) >= 2 OR bool_or(value > 95)""",
)
def a38(t):
    groups = t.events.groupBy("event_type", (F.col("user_id") % 7).alias("sig")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("value") > 95).alias("critical")
    )
    return groups.where("n >= 2 OR critical")


@query(
    "a39_merge_by_target",
    """SELECT l_partkey, count(*) AS ops, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') > 1 OR count(DISTINCT l_linestatus) FILTER (l_linestatus <> 'O') > 1 AS conflict,
         CASE WHEN count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') <= 1 THEN coalesce(max(l_returnflag) FILTER (l_returnflag <> 'N'), 'N') END AS flag,
         CASE WHEN count(DISTINCT l_linestatus) FILTER (l_linestatus <> 'O') <= 1 THEN coalesce(max(l_linestatus) FILTER (l_linestatus <> 'O'), 'O') END AS status FROM lineitem GROUP BY 1""",
)
def a39(t):
    """Corrections of one target become one: a field takes the value that some correction changes it to; two such values conflict.
    Before them flags are N and states O. A lowest and a highest value are all that has to be kept of a field."""
    merged = t.lineitem.groupBy("l_partkey")
    changed = lambda c, before: F.nullif(F.col(c), F.lit(before))
    fields = {"flag": ("l_returnflag", "N"), "status": ("l_linestatus", "O")}
    ends = [x for name, how in fields.items() for x in (F.min(changed(*how)).alias(f"{name}_low"), F.max(changed(*how)).alias(f"{name}_high"))]
    rows = merged.agg(F.count("*").alias("ops"), *ends)
    differ = lambda name: F.coalesce(F.col(f"{name}_low") != F.col(f"{name}_high"), F.lit(False))
    value = lambda name: F.when(~differ(name), F.coalesce(f"{name}_low", F.lit(fields[name][1])))
    return rows.select("l_partkey", "ops", (differ("flag") | differ("status")).alias("conflict"), *[value(name).alias(name) for name in fields])


@query(
    "a40_best_score_per_key",
    """SELECT s_nationkey, arg_max(s_suppkey, s_acctbal) AS best, max(s_acctbal) AS score FROM supplier
       WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1""",
)
def a40(t):
    """Unknown keys go; the best score wins, the first of equal ones."""
    known = t.supplier.join(t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi")
    return known.groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best"), F.max("s_acctbal").alias("score"))


@query("a10_a36_ordered_distinct", "SELECT c_mktsegment, string_agg(k::VARCHAR, ',' ORDER BY f, k) AS nations FROM (SELECT c_mktsegment, c_nationkey AS k, min(c_custkey) AS f FROM customer GROUP BY 1, 2) GROUP BY 1")
def a36(t):
    """Distinct values in order of first appearance, from per-value minima, so a group's rows never meet."""
    seen = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("f"))
    return seen.groupBy("c_mktsegment").agg(
        F.array_join(ag.ordered_list(F.col("c_nationkey").cast("string"), F.col("f"), F.col("c_nationkey")), ",").alias("nations")
    )
