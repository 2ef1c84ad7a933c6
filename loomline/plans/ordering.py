"""Sorts, limits, set operations and scans over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.windows import first_of_each
from ..registry import query
from ..sources.tables import scan


@query("o2_o3_page_has_more", "SELECT o_orderkey, 3 AS next_offset FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 20")
def o2(t):
    """The second page of 20; a row more is asked for to tell whether a third begins."""
    page = t.orders.select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").offset(20).limit(21)
    numbered = page.withColumn("r", F.row_number().over(Window.orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey")))
    more = F.max("r").over(Window.partitionBy()) > 20
    return numbered.withColumn("next_offset", F.when(more, 3).cast("int")).where("r <= 20").select("o_orderkey", "next_offset")


@query("o5_sentinel_order", "SELECT c_custkey FROM customer ORDER BY coalesce(nullif(c_mktsegment, 'BUILDING'), '~'), coalesce(nullif(c_nationkey, 3), 1000000000), c_custkey LIMIT 25")
def o5(t):
    segment = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("~"))
    nation = F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(10**9))
    return t.customer.orderBy(segment, nation, "c_custkey").limit(25).select("c_custkey")


@query(
    "o6_weighted_top_k",
    """SELECT p_partkey, (CASE WHEN p_brand LIKE '%1%' THEN 3 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS score
       FROM part ORDER BY score DESC, p_partkey LIMIT 10""",
)
def o6(t):
    one = lambda c, w: F.when(c, w).otherwise(0)
    score = one(F.col("p_brand").like("%1%"), 3) + one(F.col("p_size") > 25, 2) + one(F.col("p_retailprice") > 1500, 1)
    return t.part.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


@query("o7_top_confidence", "SELECT s_nationkey, max(s_acctbal) AS best FROM supplier GROUP BY 1")
def o7(t):
    return t.supplier.groupBy("s_nationkey").agg(F.max_by("s_acctbal", "s_acctbal").alias("best"))


@query("o8_scope_cap", "SELECT o_orderstatus, count(*) AS n, count(*) > 1000 AS too_many FROM orders GROUP BY 1")
def o8(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), (F.count("*") > 1000).alias("too_many"))


@query("o9_fixed_caps", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 51")
def o9(t):
    return t.events.orderBy(F.col("ts").desc_nulls_first(), F.col("event_id").desc()).limit(51).select("event_id")


@query(
    "o9_turn_caps",
    """SELECT user_id, event_id, n > 50 AS has_more FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC NULLS FIRST) AS i FROM events) WHERE i <= 50""",
)
def o9_turns(t):
    """The newest 50 of each user, and whether there are more."""
    newest = [F.col("ts").desc_nulls_first(), F.col("event_id").desc_nulls_first()]
    turns = first_of_each(t.events.select("user_id", "event_id", "ts"), ["user_id"], newest, 50)
    return turns.select("user_id", "event_id", (F.col("found") > 50).alias("has_more"))


@query(
    "o9_target_caps",
    """WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS page_count, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY seen, l_partkey) AS i FROM g)
    SELECT l_suppkey, l_partkey, page_count, n > 50 AS has_more, CASE WHEN n > 1 THEN 'selection_required' END AS event FROM r WHERE i <= 50""",
)
def o9_targets(t):
    """The first 50 targets of each search, by first appearance with their pages; more than one asks for a selection."""
    seen = F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen")
    targets = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("page_count"), seen)
    first = first_of_each(targets, ["l_suppkey"], [F.col("seen").asc(), F.col("l_partkey").asc()], 50)
    event = F.when(F.col("found") > 1, "selection_required").alias("event")
    return first.select("l_suppkey", "l_partkey", "page_count", (F.col("found") > 50).alias("has_more"), event)


@query("o11_s18_oldest_eligible", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def o11(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(1).select("o_orderkey")


@query("o12_result_order", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_orderkey LIMIT 30")
def o12(t):
    order = [F.col("l_linenumber").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in ("l_partkey", "l_suppkey", "l_orderkey")]]
    return t.lineitem.orderBy(*order).limit(30).select("l_orderkey", "l_linenumber")


@query(
    "u1_union_replace",
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 4, 'REPLACED'",
)
def u1(t):
    """One element of a catalogue replaced."""
    new = t.nation.where("n_nationkey = 4").select("n_nationkey", F.lit("REPLACED").alias("n_name"))
    return t.nation.where("n_nationkey <> 4").select("n_nationkey", "n_name").unionByName(new)


@query(
    "u2_u3_u5_array_sets",
    """SELECT l_orderkey, len(list_distinct(list_concat(p, s))) AS either, len(list_distinct(list_filter(p, lambda x: NOT list_contains(s, x)))) AS only_parts,
              len(list_filter(p, lambda x: NOT list_contains(s, x))) + len(list_filter(s, lambda x: NOT list_contains(p, x))) = 0 AS same
       FROM (SELECT l_orderkey, list(l_partkey % 5) AS p, list(l_suppkey % 5) AS s FROM lineitem GROUP BY 1)""",
)
def u2(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("p"), F.collect_set(F.col("l_suppkey") % 5).alias("s"))
    return sets.select(
        "l_orderkey",
        F.size(F.array_union("p", "s")).cast("long").alias("either"),
        F.size(F.array_except("p", "s")).cast("long").alias("only_parts"),
        ((F.size(F.array_except("p", "s")) == 0) & (F.size(F.array_except("s", "p")) == 0)).alias("same"),
    )


@query(
    "u6_key_sets",
    """SELECT count(*) AS either, count(*) FILTER (c IS NOT NULL AND s IS NOT NULL) AS both FROM
       (SELECT DISTINCT c_nationkey AS c FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 4000) ON c = s""",
)
def u6(t):
    c = t.customer.select(F.col("c_nationkey").alias("c")).distinct()
    s = t.supplier.where("s_acctbal > 4000").select(F.col("s_nationkey").alias("s")).distinct()
    both = F.col("c").isNotNull() & F.col("s").isNotNull()
    return c.join(s, F.col("c") == F.col("s"), "full_outer").agg(F.count("*").alias("either"), F.count_if(both).alias("both"))


@query("u7_referenced_pages", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1")
def u7(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_suppkey").distinct().orderBy("l_suppkey")


@query(
    "u8_coverage_equality",
    "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) = '1,2,3,4'",
)
def u8(t):
    seen = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))
    return seen.where(F.col("s") == F.sequence(F.lit(1), F.lit(4))).select("l_orderkey")


@query("s7_s9_unnest_positions", "SELECT vec_id, i - 1 AS pos, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, 4)) AS i FROM embeddings)")
def s7(t):
    return t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("pos", "v"))


@query("s8_unnest_object", "SELECT event_id, k FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)")
def s8(t):
    return unnested(t.events)


def unnested(events):
    return events.select("event_id", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("k"))


@query(
    "s10_expected_pages",
    """SELECT l_orderkey, i AS missing FROM (
         SELECT l_orderkey, list(l_linenumber) AS s, unnest(range(1, max(l_linenumber) + 1)) AS i FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
       WHERE NOT list_contains(s, i)""",
)
def s10(t):
    """1 to n as the expected set, and which of it isn't there."""
    seen = t.lineitem.where("l_quantity > 10").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("s"))
    return seen.select("l_orderkey", F.explode(F.array_except(F.sequence(F.lit(1), F.array_max("s")), "s")).alias("missing"))


@query("s11_constant_relation", "SELECT kind, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'P', 'gone', 'O']) AS kind) LEFT JOIN orders ON o_orderstatus = kind GROUP BY 1")
def s11(t):
    """Wanted kinds as a relation, each with its rows, none of them too."""
    kinds = t.spark.createDataFrame([(k,) for k in ("F", "P", "gone", "O")], "kind string")
    return kinds.join(t.orders, F.col("kind") == F.col("o_orderstatus"), "left").groupBy("kind").agg(F.count("o_orderkey").alias("n"))


@query("s4_s6_pushed_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1000 OFFSET 1000")
def s4(t):
    """The second thousand of a filtered scan in order: filter and columns reach the reader, the order is a top-k."""
    rows = scan(t.spark, t.folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], "l_returnflag = 'R' AND l_quantity >= 25")
    return rows.orderBy("l_orderkey", "l_linenumber", "l_partkey").offset(1000).limit(1000).select("l_orderkey", "l_linenumber")


@query("s17_event_tail", "SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def s17(t):
    return t.events.where("event_id > 500").orderBy("event_id").limit(100).select("event_id")


@query("s22_seeded_sample", "SELECT page_id FROM pages ORDER BY md5('42:' || page_id), page_id LIMIT 2")
def s22(t):
    """Two pages drawn with a seed, then in order: a top-k by a hash, which needs no sort of all pages."""
    drawn = t.pages.select("page_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("page_id").cast("string"))), "page_id").limit(2)
    return drawn.orderBy("page_id")


@query(
    "s23_draft_store",
    """SELECT 'draft' AS kind, o_custkey AS of_, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'F' QUALIFY place <= 100
       UNION ALL SELECT 'proposal', user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events WHERE event_type = 'view' QUALIFY p <= 30
       UNION ALL SELECT 'turn', user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8)""",
)
def s23(t):
    """Drafts of each owner that aren't deleted, newest first, at most 100; proposals of each draft, newest first, at most 30; the last 8
    turns of each, oldest first. The limits reach the rows before the shuffle."""
    newest = lambda df, of, item, n: df.select(F.col(of).alias("of_"), F.col(item).alias("item")).withColumn("place", F.row_number().over(Window.partitionBy("of_").orderBy(F.desc("item")))).where(f"place <= {n}")
    drafts, proposals = newest(t.orders.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey", 100), newest(t.events.where("event_type = 'view'"), "user_id", "event_id", 30)
    turns = newest(t.events, "user_id", "event_id", 8).withColumn("place", F.row_number().over(Window.partitionBy("of_").orderBy("item")))
    named = [df.select(F.lit(kind).alias("kind"), "of_", "item", F.col("place").cast("long")) for kind, df in (("draft", drafts), ("proposal", proposals), ("turn", turns))]
    return named[0].unionByName(named[1]).unionByName(named[2])
