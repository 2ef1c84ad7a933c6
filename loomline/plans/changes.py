"""Merges, replacements and conflicts over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..registry import query


def _target(t):
    o = t.orders.where("o_orderkey % 3 <> 0")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 4 + 1).alias("version"))


def _source(t):
    s = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), s.alias("s"))


_TABLES = """t AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey % 4 + 1 AS version FROM orders WHERE o_orderkey % 3 <> 0),
  s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0)"""


@query(
    "k6_merge_rows",
    f"""WITH {_TABLES} SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.s ELSE t.s END AS s,
        CASE WHEN t.k IS NULL THEN 1 WHEN s.k IS NOT NULL AND s.s IS DISTINCT FROM t.s THEN version + 1 ELSE version END AS version,
        CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NOT NULL AND s.s IS DISTINCT FROM t.s THEN 'update' ELSE 'keep' END AS action
        FROM t FULL JOIN s ON t.k = s.k""",
)
def k6(t):
    return ch.merged(_target(t), ch.marked(_source(t)), ["k"], ["s"])


@query("k7_delete_absent", f"WITH {_TABLES} SELECT k FROM t WHERE NOT (s = 'F' AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = t.k))")
def k7(t):
    return ch.pruned(_target(t), _source(t), ["k"], F.col("s") == "F").select("k")


@query(
    "k9_t5_idempotent_steps",
    f"WITH {_TABLES} SELECT s.k, 'new' AS verdict FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k) UNION ALL SELECT s.k, 'mismatch' FROM s JOIN t ON t.k = s.k WHERE t.s IS DISTINCT FROM s.s",
)
def k9(t):
    new, wrong = ch.new_steps(_target(t), _source(t), "k", "s")
    return new.select("k", F.lit("new").alias("verdict")).unionByName(wrong.select("k", F.lit("mismatch").alias("verdict")))


@query(
    "k11_sealed_manifest",
    """WITH e AS (SELECT o_orderstatus, o_orderkey::VARCHAR AS k, o_totalprice >= 1000 AS done, substr(md5(o_orderkey::VARCHAR), 1, 3) AS b FROM orders),
       p AS (SELECT o_orderstatus, b, count(*) AS n, count(*) FILTER (done) AS c, sha256(string_agg(k, ',' ORDER BY k)) AS d FROM e GROUP BY 1, 2)
       SELECT o_orderstatus, sum(n)::BIGINT AS expected, sum(c)::BIGINT AS completed, sum(n - c)::BIGINT AS skipped, sha256(string_agg(d, ',' ORDER BY b)) AS ids_digest FROM p GROUP BY 1""",
)
def k11(t):
    """Per stage what was expected, done and skipped, and a digest of the ids, in two levels so that no row holds a stage."""
    key = F.col("o_orderkey").cast("string")
    rows = t.orders.select("o_orderstatus", key.alias("k"), (F.col("o_totalprice") >= 1000).alias("done"), F.substring(F.md5(key), 1, 3).alias("b"))
    parts = rows.groupBy("o_orderstatus", "b").agg(
        F.count("*").alias("n"), F.count_if("done").alias("c"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("d")
    )
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256)
    return parts.groupBy("o_orderstatus").agg(
        F.sum("n").alias("expected"), F.sum("c").alias("completed"), F.sum(F.col("n") - F.col("c")).alias("skipped"), digest.alias("ids_digest")
    )


@query(
    "k11_changed_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 501 = 3 THEN 'gone' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 501 = 3 OR o_orderkey % 97 = 7
       UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 703 = 9""",
)
def k11_changed(t):
    """What a table changed since its digests were taken, by descending two digest trees."""
    from ..operators.ranges import changed_rows

    k = F.col("o_orderkey")
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = old.where(k % 501 != 3).withColumn("o_totalprice", F.when(k % 97 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = kept.unionByName(old.where(k % 703 == 9).withColumn("o_orderkey", -k))
    return changed_rows(old, new, "o_orderkey")


@query(
    "k12_versioned_commit",
    """SELECT 'unit' AS kind, l_orderkey AS unit, NULL::INT AS no, NULL::BIGINT AS evidence FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'connection', l_orderkey, l_linenumber, NULL FROM lineitem
       UNION ALL SELECT 'evidence', l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) FROM lineitem""",
)
def k12(t):
    """One nested result fanned out into the rows of three tables."""
    from .dataflow import flatten

    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(F.struct("l_linenumber", F.array("l_partkey", "l_suppkey").alias("references"))).alias("connections"))
    flat = flatten(lines.withColumn("source_page", F.lit(0)))
    no, none = F.col("l_linenumber").alias("no"), lambda kind, name: F.lit(None).cast(kind).alias(name)
    units = lines.select(F.lit("unit").alias("kind"), "unit", none("int", "no"), none("long", "evidence"))
    connections = flat.select(F.lit("connection").alias("kind"), "unit", no, none("long", "evidence"))
    return units.unionByName(connections).unionByName(flat.select(F.lit("evidence").alias("kind"), "unit", no, F.explode("references").alias("evidence")))


@query(
    "k14_add_remove",
    "SELECT l_orderkey, count(*) FILTER (NOT (l_linenumber = 1)) + 1 AS n, bool_or(l_returnflag = 'R' AND l_linenumber <> 1) AS needs_review FROM lineitem GROUP BY 1",
)
def k14(t):
    """A connection removed and one added, and the result's status taken anew."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    added = t.lineitem.select("l_orderkey").distinct().select("l_orderkey", F.lit(99).alias("l_linenumber"), F.lit("N").alias("l_returnflag"))
    state = rows.where("l_linenumber <> 1").unionByName(added)
    return state.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("needs_review"))


@query(
    "t10_conflict_rows",
    "SELECT o_orderkey AS k, o_custkey % 4 + 1 AS version, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey + o_orderkey % 2) % 4 + 1 END AS found FROM orders WHERE o_orderkey % 3 = 0 OR (o_custkey + o_orderkey % 2) % 4 <> o_custkey % 4",
)
def t10(t):
    expected = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4 + 1).alias("version"))
    now = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 4 + 1).alias("version"))
    return ch.conflicts(now, expected, ["k"])


@query(
    "t12_failed_scans",
    """SELECT event_id AS page, CASE WHEN event_id % 9 = 4 THEN 'failed' ELSE 'scanned' END AS state, CASE WHEN event_id % 9 <> 4 THEN json_extract_string(props, 'k')::BIGINT END AS found, CASE WHEN event_id % 9 = 4 THEN 'not JSON' END AS error FROM events""",
)
def t12_scans(t):
    """Pages whose scan can't be read fail with what was wrong, as rows, and the others go on."""
    from ..functions import json_text as jt

    page = F.col("event_id")
    said = F.when(page % 9 == 4, F.substring("props", 1, 3)).otherwise(F.col("props"))
    read = t.events.select(page.alias("page"), jt.canonical_json(said).alias("scan"))
    return read.select(
        "page", F.when(F.col("scan.error").isNull(), "scanned").otherwise("failed").alias("state"), F.get_json_object("scan.text", "$.k").cast("long").alias("found"),
        F.substring_index("scan.error", ":", 1).alias("error"),
    )


@query(
    "k3_unit_files",
    "SELECT l_suppkey AS unit_id, l_orderkey, l_linenumber, l_partkey AS part, l_returnflag || l_linestatus AS flags FROM lineitem",
)
def k3(t):
    """Units written as JSON, a folder each, and read back."""
    from ..sources.shared import shared_folder
    from ..sources.units import read_units, write_units

    line = F.struct(F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("unit_id"), "l_orderkey", "l_linenumber", line.alias("line"))
    folder = shared_folder(t.spark)
    write_units(rows, folder)
    return read_units(t.spark, folder, rows.schema).select("unit_id", "l_orderkey", "l_linenumber", "line.part", F.array_join("line.flags", "").alias("flags"))


@query(
    "t12_failed_pages",
    """SELECT event_id, CASE WHEN value > 90 THEN 'scan_failed' ELSE 'scan' END AS stage, CASE WHEN value > 90 THEN 'failed' ELSE 'scanned' END AS page_state, CASE WHEN value > 90 THEN 'PAGE_SCAN_FAILED' END AS code,
              CASE WHEN value > 90 THEN 'PDF第' || event_id || '页初扫失败，已记录；继续处理后续页面。' END AS message FROM events""",
)
def t12(t):
    """A page whose scan fails is a step with its error, and the others go on."""
    failed, page = F.col("value") > 90, F.col("event_id")
    return t.events.select(
        page,
        F.when(failed, "scan_failed").otherwise("scan").alias("stage"),
        F.when(failed, "failed").otherwise("scanned").alias("page_state"),
        F.when(failed, "PAGE_SCAN_FAILED").alias("code"),
        F.when(failed, F.concat(F.lit("PDF第"), page.cast("string"), F.lit("页初扫失败，已记录；继续处理后续页面。"))).alias("message"),
    )


@query("t13_unexpired", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 24 HOUR >= TIMESTAMP '1998-01-01'")
def t13(t):
    return t.orders.where(F.col("o_orderdate") + F.expr("interval 24 hours") >= F.to_timestamp(F.lit("1998-01-01"))).select("o_orderkey")


@query(
    "t15_replace_scope",
    f"WITH {_TABLES} SELECT k, s FROM t WHERE NOT k % 7 = 0 UNION ALL SELECT k + 10000000, s FROM s WHERE k % 7 = 0",
)
def t15(t):
    """Exactly the frozen baseline is deleted, and all new rows come in."""
    target = _target(t).select("k", "s")
    new = _source(t).where("k % 7 = 0").select((F.col("k") + 10_000_000).alias("k"), "s")
    return ch.replaced(target, target.where("k % 7 = 0"), new, ["k"])


@query(
    "t16_patch_commit",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS c FROM orders",
)
def t16(t):
    table = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    mask = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("s"), F.lit("c"))).otherwise(F.array(F.lit("s")))
    changes = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("P").alias("s"), F.lit(None).cast("long").alias("c"), mask.alias("mask"))
    return ch.patched(table, changes, "k", ["s", "c"])


@query("t7_resume_pages", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def t7(t):
    """Pages done before are restored, not done again."""
    return t.orders.select("o_orderkey").join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")


@query("k1_export_columns", "SELECT l_orderkey::VARCHAR AS page, l_linenumber::VARCHAR AS no, l_returnflag AS flag FROM lineitem")
def k1(t):
    """Cells of an export, all text; what a cell can't hold is an error of its own query."""
    return exported(t.lineitem)


def exported(lines):
    from ..sources.tables import export_cells

    return export_cells(lines, {"page": "l_orderkey", "no": "l_linenumber", "flag": "l_returnflag"})


#: The columns of an export by what a row calls them.
EXPORT = {
    "页码": "page", "原理号": "no", "电压等级": "voltage", "端子排": "strip", "起点代号": "start_code", "起点描述": "start_text", "起点端子": "start", "终点代号": "end_code",
    "终点描述": "end_text", "终点端子": "end", "电流": "current", "备注": "remark", "色标": "color",
}


def export_rows(lines):
    """Lines as the 13 text columns of an export; `id` stands in the remark."""
    q = lambda e: F.expr(e)
    return lines.select(
        q("string(l_orderkey)").alias("page"), q("string(l_partkey)").alias("no"), q("CASE WHEN l_suppkey % 2 = 0 THEN 'AC<220>' END").alias("voltage"), q("'X' || l_linenumber").alias("strip"),
        q("CASE WHEN l_partkey % 3 > 0 THEN '-K' || l_suppkey END").alias("start_code"), q("' & ' || l_returnflag || ' '").alias("start_text"), q("'X1:' || l_linenumber").alias("start"),
        q("''").alias("end_code"), q("'\"é\" 终'").alias("end_text"), q("string(l_suppkey)").alias("end"), q("string(int(l_quantity))").alias("current"),
        q("l_orderkey || '\n' || l_linenumber").alias("remark"), q("l_linestatus").alias("color"),
    )


@query(
    "k1_workbook",
    """SELECT l_orderkey::VARCHAR AS page, l_partkey::VARCHAR AS no, CASE WHEN l_suppkey % 2 = 0 THEN 'AC<220>' ELSE '' END AS voltage, 'X' || l_linenumber AS strip, CASE WHEN l_partkey % 3 > 0 THEN '-K' || l_suppkey ELSE '' END AS start_code,
       ' & ' || l_returnflag || ' ' AS start_text, 'X1:' || l_linenumber AS start, '' AS end_code, '"é" 终' AS end_text, l_suppkey::VARCHAR AS end, l_quantity::INT::VARCHAR AS current, l_orderkey || chr(10) || l_linenumber AS remark, l_linestatus AS color FROM lineitem""",
)
def k1_workbook(t):
    """All rows written as workbooks, a text cell each, and read back from them below their headers."""
    from ..sources.workbooks import export_workbooks, read_workbooks, table_of
    from ..sources.shared import shared_folder

    folder = shared_folder(t.spark)
    export_workbooks(export_rows(t.lineitem), folder, EXPORT)
    rows = table_of(read_workbooks(t.spark, folder))
    return rows.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(EXPORT.values())])


@query("k1_illegal_cells", "SELECT doc_id FROM documents WHERE length(text) > 32767 OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')")
def k1b(t):
    from ..sources.tables import illegal_cells

    return illegal_cells(t.documents, "doc_id", ["text"]).select("doc_id")


@query("k2_snapshot_changed", "SELECT count(*) FILTER (o_orderkey % 1000 = 0) AS changed FROM orders")
def k2(t):
    """Rows whose version isn't what it was when an export began."""
    before = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("version"))
    now = before.withColumn("version", F.when(F.col("k") % 1000 == 0, 2).otherwise(1))
    return ch.conflicts(now, before, ["k"]).agg(F.count("*").alias("changed"))
