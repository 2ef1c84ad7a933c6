"""The core dataflow over nested units made from the fixture tables: flatten, resolve across pages, agree, de-duplicate, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uuid5
from ..operators import aggregates as ag
from ..registry import query

# An order is a unit on page o_custkey % 20; its lines are connections; the supplier's number, modulo 25, is the page that a line refers to,
# pages 20 and above are outside the atlas.


def units(t) -> DataFrame:
    """(unit, source_page, connections): nested, as an extraction returns them."""
    line = F.struct(
        F.col("l_linenumber").alias("no"),
        F.col("l_partkey").alias("number"),
        F.col("l_quantity").cast("int").cast("string").alias("terminal"),
        F.array(F.struct((F.col("l_suppkey") % 25).cast("int").alias("page"), F.concat(F.lit("/"), F.col("l_suppkey").cast("string")).alias("raw"))).alias("references"),
    )
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.array_sort(F.collect_list(line)).alias("connections"))
    return t.orders.select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 20).cast("int").alias("source_page")).join(lines, "unit")


def flatten(nested: DataFrame) -> DataFrame:
    """A row per connection, in order."""
    return nested.select("unit", "source_page", F.posexplode("connections").alias("at", "c")).select("unit", "source_page", "at", "c.*")


def cross_page_tasks(flat: DataFrame, pages: DataFrame) -> DataFrame:
    """(unit, at, target_page, refs): references exploded, those to their own page or outside the atlas dropped, and grouped by the
    page they lead to."""
    refs = flat.select("unit", "source_page", "at", F.explode("references").alias("r")).select("unit", "source_page", "at", "r.page", "r.raw")
    known = refs.join(pages, "page").where("page <> source_page")
    return known.groupBy("unit", "at", F.col("page").alias("target_page")).agg(F.array_sort(F.collect_set("raw")).alias("refs"))


def atlas(t) -> DataFrame:
    """The pages there are: 20, a constant."""
    return t.spark.range(20).select(F.col("id").cast("int").alias("page"))


@query("p5_s7_flatten_units", "SELECT l_orderkey AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::INT::VARCHAR) - 1 AS at_, l_partkey AS number FROM lineitem")
def p5(t):
    return flatten(units(t)).select("unit", F.col("at").alias("at_"), "number")


@query(
    "j13_cross_page_tasks",
    """SELECT l_orderkey AS unit, (l_suppkey % 25)::INT AS target_page, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE l_suppkey % 25 < 20 AND l_suppkey % 25 <> o_custkey % 20 GROUP BY 1, 2""",
)
def j13(t):
    tasks = cross_page_tasks(flatten(units(t)), atlas(t))
    return tasks.groupBy("unit", "target_page").agg(F.count("*").alias("n"))


def results(t) -> DataFrame:
    """What the completion of a task found: the terminal, with a confidence; some find none."""
    tasks = cross_page_tasks(flatten(units(t)), atlas(t))
    found = F.when(F.col("target_page") % 4 != 0, F.concat(F.lit("X"), (F.col("target_page") % 3).cast("string")))
    return tasks.select("unit", "target_page", "at", found.alias("end"), (F.col("target_page") / 20).alias("confidence"))


@query(
    "j14_a15_unit_consensus",
    """SELECT unit, CASE WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'conflicting' ELSE 'unavailable' END AS state, CASE WHEN k = 1 THEN a END AS answer FROM (
         SELECT l_orderkey AS unit, count(DISTINCT e) AS k, min(e) AS a FROM (
           SELECT l_orderkey, CASE WHEN l_suppkey % 25 % 4 <> 0 THEN 'X' || (l_suppkey % 25 % 3) END AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey
           WHERE l_suppkey % 25 < 20 AND l_suppkey % 25 <> o_custkey % 20) GROUP BY 1)""",
)
def j14(t):
    return ag.consensus(results(t), ["unit"], "end", "confidence", "at")


@query(
    "a13_a14_connection_identity",
    """SELECT unit, count(*) AS connections, sum(n - 1)::BIGINT AS merged FROM (SELECT l_orderkey AS unit, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""",
)
def a13(t):
    """Connections of one identity, a digest of its fields, become one; blanks are filled from later ones."""
    identity = F.sha2(F.to_json(F.struct("l_returnflag", "l_linestatus"), {"ignoreNullFields": "false"}), 256)
    rows = t.lineitem.select(F.col("l_orderkey").alias("unit"), identity.alias("identity"), "l_linenumber", "l_returnflag")
    one = rows.groupBy("unit", "identity").agg(F.count("*").alias("n"), ag.first_filled_by(F.col("l_returnflag"), F.col("l_linenumber")).alias("flag"))
    return one.groupBy("unit").agg(F.count("*").alias("connections"), F.sum(F.col("n") - 1).alias("merged"))


@query(
    "p6_j15_published_rows",
    """SELECT l_orderkey AS unit, l_linenumber AS no, CASE WHEN l_suppkey % 25 < 20 THEN (l_suppkey % 25)::INT END AS target_page,
              CASE WHEN l_suppkey % 25 >= 20 THEN 'external' WHEN l_suppkey % 25 = o_custkey % 20 THEN 'same_page' ELSE 'cross_page' END AS state
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def p6(t):
    refs = flatten(units(t)).select("unit", "source_page", "no", F.col("references")[0]["page"].alias("ref"))
    met = refs.join(atlas(t), F.col("ref") == F.col("page"), "left")
    state = F.when(F.col("page").isNull(), "external").when(F.col("page") == F.col("source_page"), "same_page").otherwise("cross_page")
    return met.select("unit", "no", F.col("page").alias("target_page"), state.alias("state"))


@query(
    "x22_published_ids",
    """SELECT unit, no, lower(left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id
       FROM (SELECT l_orderkey AS unit, l_linenumber AS no, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(l_orderkey || ':' || l_linenumber)) AS h FROM lineitem)""",
)
def x22(t):
    """Deterministic row ids: a name-based UUID of what identifies the row."""
    flat = flatten(units(t))
    return flat.select("unit", "no", uuid5(F.concat_ws(":", F.col("unit").cast("string"), F.col("no").cast("string"))).alias("id"))


@query(
    "p15_task_context",
    """SELECT l_orderkey AS unit, count(*) AS tasks, min(l_suppkey % 25)::INT AS first_target FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE l_suppkey % 25 < 20 AND l_suppkey % 25 <> o_custkey % 20 GROUP BY 1""",
)
def p15(t):
    """What a completion is told of a unit: its tasks as structs with their pages."""
    task = F.struct("target_page", "refs", "at")
    per = cross_page_tasks(flatten(units(t)), atlas(t)).groupBy("unit").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    return per.select("unit", F.size("tasks").cast("long").alias("tasks"), F.col("tasks")[0]["target_page"].alias("first_target"))


@query(
    "p8_catalog_model",
    "SELECT (o_custkey % 20)::INT AS page, min(o_orderkey) AS first_unit, count(*) AS units FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1",
)
def p8(t):
    return units(t).groupBy(F.col("source_page").alias("page")).agg(F.min("unit").alias("first_unit"), F.count("*").alias("units")).orderBy("page")


@query(
    "a34_operation_groups",
    """SELECT o_custkey AS ws, o_orderpriority AS k, count(*) AS ops, string_agg(CASE WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END || ' ' || o_orderkey, ',' ORDER BY o_orderkey) AS operations
       FROM orders GROUP BY 1, 2""",
)
def a34(t):
    """Operations of one workspace and logical key are a unit, in order."""
    what = F.concat(F.when(F.col("o_orderstatus") == "F", "remove ").otherwise("add "), F.col("o_orderkey").cast("string"))
    units_ = t.orders.groupBy(F.col("o_custkey").alias("ws"), F.col("o_orderpriority").alias("k"))
    return units_.agg(F.count("*").alias("ops"), F.array_join(ag.ordered_list(what, F.col("o_orderkey")), ",").alias("operations"))


@query(
    "a28_a29_a37_canonical_receipts",
    """WITH e AS (SELECT o_orderpriority, o_orderkey::VARCHAR AS k, (o_totalprice * 100)::DECIMAL(30, 6) AS v, substr(md5(o_orderkey::VARCHAR), 1, 3) AS b FROM orders),
       p AS (SELECT o_orderpriority, b, count(*) AS n, sha256('{' || string_agg('"' || k || '":' || trunc(v)::BIGINT, ',' ORDER BY k) || '}') AS d FROM e GROUP BY 1, 2)
       SELECT o_orderpriority, sha256(string_agg(d, ',' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM p GROUP BY 1""",
)
def a37(t):
    """A map of ids to versions per group, as canonical JSON: keys sorted, numbers without trailing zeros. Its digest is taken in two
    levels: of each bucket of ids, then of the buckets' digests in order, so no row holds a group."""
    key = F.col("o_orderkey").cast("string")
    entry = F.struct(key.alias("key"), (F.col("o_totalprice") * 100).cast("decimal(30,6)").cast("long").alias("value"))
    rows = t.orders.select("o_orderpriority", entry.alias("entry"), F.substring(F.md5(key), 1, 3).alias("b"))
    per = rows.groupBy("o_orderpriority", "b").agg(F.array_sort(F.collect_list("entry")).alias("e"))
    parts = per.select("o_orderpriority", "b", F.sha2(F.to_json(F.map_from_entries("e")), 256).alias("d"), F.size("e").alias("n"))
    digest = F.sha2(F.array_join(ag.ordered_list(F.col("d"), F.col("b")), ","), 256)
    return parts.groupBy("o_orderpriority").agg(digest.alias("digest"), F.sum("n").alias("n"))
