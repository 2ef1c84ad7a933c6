"""Rule engines over records made from the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as ru
from ..registry import query


def records(t):
    """Connection records: terminals, devices, boards and states taken from line items."""
    q, p, s, n = (F.col(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(p % 11 == 0, F.lit(None)).when(p % 11 == 1, "I1.2").when(p % 11 == 2, "A_L1").otherwise(q.cast("int").cast("string")).alias("start_terminal"),
        F.when(s % 4 == 0, F.lit(None)).when(s % 4 == 1, "X4:7").otherwise(n.cast("string")).alias("end_terminal"),
        F.when(p % 3 == 0, "-K1").alias("device"),
        F.when(s % 3 == 0, "XD3").alias("board"),
        F.when(n == 1, "SPARE").when(n == 2, "PE").when(n == 3, "").otherwise(p.cast("string")).alias("number"),
        F.when(s % 5 == 0, "unknown").otherwise("source").alias("role"),
        (s % 2 == 0).alias("has_reference"),
        F.when(s % 7 == 0, "conflicting").when(s % 7 == 1, "failed").otherwise("resolved").alias("completion"),
    )


_RECORDS = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'I1.2' WHEN 2 THEN 'A_L1' ELSE l_quantity::INT::VARCHAR END AS st,
   CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'X4:7' ELSE l_linenumber::VARCHAR END AS et, CASE WHEN l_partkey % 3 = 0 THEN '-K1' END AS device,
   CASE WHEN l_suppkey % 3 = 0 THEN 'XD3' END AS board, CASE l_linenumber WHEN 1 THEN 'SPARE' WHEN 2 THEN 'PE' WHEN 3 THEN '' ELSE l_partkey::VARCHAR END AS number,
   CASE WHEN l_suppkey % 5 = 0 THEN 'unknown' ELSE 'source' END AS role, l_suppkey % 2 = 0 AS ref,
   CASE l_suppkey % 7 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'failed' ELSE 'resolved' END AS completion FROM lineitem)"""


@query(
    "x6_terminal_completion",
    f"WITH {_RECORDS} SELECT l_orderkey, l_linenumber, CASE WHEN st IS NULL THEN NULL WHEN board IS NOT NULL THEN board || ':' || st ELSE st END AS terminal FROM r",
)
def x6(t):
    return records(t).select("l_orderkey", "l_linenumber", ru.complete_terminal(F.col("start_terminal"), F.col("board")).alias("terminal"))


@query(
    "x7_x8_terminal_strips",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, CASE WHEN board = 'XD3' THEN 'X3' ELSE 'X' || (l_linenumber % 2 + 3) END AS strip,
        CASE l_suppkey % 5 WHEN 0 THEN 'X0' WHEN 1 THEN 'X21/X23' WHEN 2 THEN 'X61' WHEN 3 THEN 'X5' END AS own FROM r""",
)
def x7(t):
    """The board's class first, then the strip that is named; and names by a mapping of one's own, which aliases precede."""
    rows = records(t)
    named = F.concat(F.lit("-x"), (F.col("l_linenumber") % 2 + 3).cast("string"))
    s = F.col("l_suppkey") % 5
    odd = F.when(s == 0, "-XD0").when(s == 1, "xd21/xd23").when(s == 2, "x61").when(s == 3, " own ").otherwise("XD3")
    own = ru.terminal_strip(odd, {"XD0": "X3", "OWN": "-x5", "XD3": "Y9"})
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(ru.terminal_strip(F.col("board")), ru.terminal_strip(named)).alias("strip"), own.alias("own"))


@query(
    "x9_x13_special_rows",
    f"""WITH {_RECORDS}, q AS (SELECT *, CASE WHEN number = 'PE' AND l_suppkey % 5 = 0 THEN 'X1:pe' WHEN number = 'PE' AND l_suppkey % 5 = 1 THEN 'PE-BAR' WHEN number = 'SPARE' AND l_suppkey % 5 < 3 THEN '*' ELSE st END AS s2,
        CASE WHEN number IN ('PE', 'SPARE') AND l_suppkey % 5 < 2 THEN NULL ELSE et END AS e2 FROM r),
        w AS (SELECT l_orderkey, l_linenumber, CASE WHEN number = 'SPARE' AND ((s2 IS NOT NULL AND s2 <> '*') OR e2 IS NOT NULL) THEN 'SPARE record has a non-* terminal'
          WHEN number NOT IN ('SPARE', 'PE') AND device IS NOT NULL AND s2 IS NULL THEN 'page ' || l_linenumber || ' has a start device but no start terminal' ELSE '' END AS other,
        number = 'PE' AS pe, s2 IS NOT NULL AND s2 <> 'X1:pe' AS odd, s2 = 'PE-BAR' AS bar, e2 IS NOT NULL AS e FROM q)
        SELECT l_orderkey, l_linenumber, CASE WHEN pe AND (odd OR e) THEN 'PE record has a non-PE terminal' ELSE other END AS warnings,
        CASE WHEN pe AND ((odd AND NOT bar) OR e) THEN 'PE record has a non-PE terminal' ELSE other END AS strict_warnings FROM w""",
)
def x13(t):
    """PE-BAR passes only where endpoints must have an identity."""
    number, s = F.col("number"), F.col("l_suppkey") % 5
    start = F.when((number == "PE") & (s == 0), "X1:pe").when((number == "PE") & (s == 1), "PE-BAR").when((number == "SPARE") & (s < 3), "*").otherwise(F.col("start_terminal"))
    end = F.when(number.isin("PE", "SPARE") & (s < 2), F.lit(None)).otherwise(F.col("end_terminal"))
    source = F.concat(F.lit("page "), F.col("l_linenumber").cast("string"))
    w = lambda strict: F.array_join(ru.consistency_warnings(number, start, end, F.col("device"), strict, source), "|")
    return records(t).select("l_orderkey", "l_linenumber", w(False).alias("warnings"), w(True).alias("strict_warnings"))


@query(
    "x10_breaker_current",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 AND l_suppkey % 2 = 0 THEN l_quantity::INT || CASE l_linenumber % 2 WHEN 0 THEN 'mA' ELSE 'A' END END AS current FROM lineitem""",
)
def x10(t):
    n = F.col("l_linenumber")
    value = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(n % 2 == 0, " MA").otherwise(" a"))
    basis = F.when(n % 3 == 0, "I-X").otherwise("i r")
    evidence = F.when(F.col("l_suppkey") % 2 == 0, "setting Ir = 63").otherwise("no basis")
    return t.lineitem.select("l_orderkey", "l_linenumber", ru.breaker_current(value, basis, evidence).alias("current"))


@query("x11_sheet_current", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT::VARCHAR END AS current FROM lineitem")
def x11(t):
    evidence = F.when(F.col("l_linenumber") % 2 == 0, "In 16A").otherwise("10-16 or 230 V")
    return t.lineitem.select("l_orderkey", "l_linenumber", ru.sheet_current(F.col("l_quantity").cast("int").cast("string"), evidence).alias("current"))


@query(
    "x12_endpoint_warnings",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN st IS NULL THEN 'missing physical terminal' END,
        CASE WHEN st = 'I1.2' THEN 'PLC address is not a physical terminal' END, CASE WHEN st = 'A_L1' THEN 'potential label is not a physical terminal' END,
        CASE WHEN device IS NULL AND board IS NULL THEN 'missing device or terminal board identity' END) AS warnings FROM r""",
)
def x12(t):
    w = ru.endpoint_warnings(F.col("start_terminal"), F.col("device"), F.col("board"))
    return records(t).select("l_orderkey", "l_linenumber", F.array_join(w, "|").alias("warnings"))


@query(
    "x14_sheet_warnings",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN number = '' THEN 'no principle number' END, CASE WHEN st IS NULL THEN 'no start terminal' END,
        CASE WHEN ref AND et IS NULL THEN 'still needs cross-page review' END) AS warnings FROM r""",
)
def x14(t):
    state = ru.cross_page_state(F.col("has_reference"), F.col("end_terminal"), F.lit(None).cast("string"))
    w = ru.sheet_warnings(F.col("number"), F.col("start_terminal"), F.col("end_terminal"), state)
    return records(t).select("l_orderkey", "l_linenumber", F.array_join(w, "|").alias("warnings"))


def _review(t, phase, strict):
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    reason = F.when(q % 3 == 0, "outside the atlas").when(q % 3 == 1, "")
    seen = F.array(F.struct(F.lit("end").alias("field"), F.lit("blurred").alias("detail")), F.struct(F.lit("start").alias("field"), F.lit("").alias("detail")))
    r = {k: F.col(k) for k in ("line_number", "start_terminal", "end_terminal", "start_device", "end_device", "start_terminal_board", "end_terminal_board", "completion_state")}
    rows = records(t).withColumnsRenamed({"number": "line_number", "device": "start_device", "board": "end_terminal_board", "completion": "completion_state"})
    rows = rows.withColumns({"end_device": F.lit(None).cast("string"), "start_terminal_board": F.when(p % 4 == 0, "X3")})
    r |= {
        "endpoint_role": F.col("role"),
        "direction_basis": F.when(p % 17 != 0, "arrow"),
        "has_evidence": p % 2 == 0,
        "references": F.when(F.col("has_reference"), F.array(F.struct(reason.alias("reason")))),
        "uncertainties": F.when(p % 13 == 0, seen),
        "warnings": F.when(F.col("l_linenumber") == 7, F.array(F.lit("odd"), F.lit("odd"))),
    }
    status = ru.processing_status(F.col("end_terminal"), F.col("has_reference"), phase)
    # a column of its own, used twice: it stays in a projection below, where it is compiled
    found = rows.select("l_orderkey", "l_linenumber", ru.review_reasons(r, phase, strict).alias("found"), status.alias("status"))
    said = F.transform("found", lambda x: F.concat_ws(":", x["code"], F.coalesce(x["field"], F.lit("-")), x["message"]))
    some = F.size("found") > 0
    return found.select("l_orderkey", "l_linenumber", F.when(some, F.array_join(said, "|")).otherwise("").alias("reasons"), some.alias("needs_review"), "status")


def _review_sql(final: bool) -> str:
    """The rule for all of final and strict, or neither."""
    on = "TRUE" if final else "FALSE"
    return f"""WITH {_RECORDS}, c AS (SELECT *, {"FALSE" if final else "et IS NULL AND ref"} AS pending FROM r),
      d AS (SELECT l_orderkey, l_linenumber, pending, concat_ws('|',
        CASE WHEN role = 'unknown' OR ({on} AND l_partkey % 17 = 0) THEN 'direction_unconfirmed:direction:起终点方向缺少可确认的图纸依据' END,
        CASE WHEN st IS NULL THEN 'missing_start_terminal:start_terminal:起点端子未确认' END,
        CASE WHEN {on} AND number <> 'SPARE' AND st IN ('I1.2', 'A_L1') THEN 'non_physical_terminal:start_terminal:PLC地址或电位名称不能作为实际端子' END,
        CASE WHEN {on} AND number <> 'SPARE' AND st IS NOT NULL AND device IS NULL AND l_partkey % 4 <> 0 THEN 'endpoint_identity_incomplete:start:缺少所属元件或端子排身份' END,
        CASE WHEN et IS NULL AND NOT pending THEN 'missing_end_terminal:end_terminal:终点端子未确认' END,
        CASE WHEN {on} AND number <> 'SPARE' AND et IS NOT NULL AND et <> 'X4:7' AND board IS NULL THEN 'endpoint_identity_incomplete:end:缺少所属元件或端子排身份' END,
        CASE WHEN {on} THEN CASE completion WHEN 'conflicting' THEN 'target_conflict:end:多个目标返回不同终点' WHEN 'failed' THEN 'completion_failed:end:补全未能产生可确认的结果'
             ELSE CASE WHEN l_partkey % 2 <> 0 THEN 'completion_evidence_missing:end:补全结果缺少目标路径依据' END END END,
        CASE WHEN {on} AND et IS NULL AND ref AND l_suppkey % 3 = 0 THEN 'reference_unresolved:references:outside the atlas' END,
        CASE WHEN l_partkey % 13 = 0 AND NOT pending THEN 'visual_uncertainty:end:blurred' END,
        CASE WHEN l_partkey % 13 = 0 THEN 'visual_uncertainty:start:图像信息不明确' END,
        CASE WHEN l_linenumber = 7 THEN 'profile_validation:-:odd' END) AS reasons FROM c)
      SELECT l_orderkey, l_linenumber, reasons, reasons <> '' AS needs_review, CASE WHEN pending THEN 'pending_completion' ELSE '{"completed" if final else "scanned"}' END AS status FROM d"""


@query("x15_review_final", _review_sql(True))
def x15(t):
    return _review(t, "final", True)


@query("x15_review_scan", _review_sql(False))
def x15b(t):
    return _review(t, "scan", False)


def _row():
    return {
        **{k: F.col(k) for k in ("start_terminal", "end_terminal", "start_coordinates", "end_coordinates")},
        "needs_review": F.lit(False),
    }


def _placed(t):
    point = lambda c: F.concat(F.lit("at "), c.cast("string"))
    return records(t).withColumn("start_coordinates", point(F.col("l_linenumber"))).withColumn("end_coordinates", point(F.col("l_orderkey")))


@query(
    "x17_v4_swap_terminals",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, et AS start_terminal, st AS end_terminal,
        CASE WHEN st IS DISTINCT FROM et THEN NULL ELSE 'at ' || l_linenumber END AS start_coordinates,
        st IS DISTINCT FROM et AND (st IS NULL OR et IS NULL) AS needs_review FROM r""",
)
def x17(t):
    done = ru.edit(_row(), "swap_terminals")
    return _placed(t).select("l_orderkey", "l_linenumber", *[done[k].alias(k) for k in ("start_terminal", "end_terminal", "start_coordinates", "needs_review")])


@query(
    "x17_remove_prefix",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, CASE WHEN et = 'X4:7' THEN '7' ELSE et END AS end_terminal, CASE WHEN et = 'X4:7' THEN NULL ELSE 'at ' || l_orderkey END AS end_coordinates FROM r""",
)
def x17b(t):
    done = ru.edit(_row(), "remove_prefix", endpoint="end", prefix="X4:")
    return _placed(t).select("l_orderkey", "l_linenumber", done["end_terminal"].alias("end_terminal"), done["end_coordinates"].alias("end_coordinates"))


@query(
    "x17_x18_set_fields_preview",
    f"""WITH {_RECORDS} SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN st IS DISTINCT FROM '5' THEN 'start_coordinates' END, CASE WHEN st IS DISTINCT FROM '5' AND et IS NULL THEN 'needs_review' END,
        CASE WHEN st IS DISTINCT FROM '5' THEN 'start_terminal' END) AS changed FROM r""",
)
def x17c(t):
    """Only what changes is in the preview; a new terminal clears its coordinates."""
    row = _row()
    done = ru.edit(row, "set_fields", changes={"start_terminal": F.lit("5")})
    names = F.map_keys(ru.changed_only(row, done))
    order = F.filter(F.array(*[F.lit(x) for x in ("start_coordinates", "needs_review", "start_terminal")]), lambda x: F.array_contains(names, x))
    return _placed(t).select("l_orderkey", "l_linenumber", F.array_join(order, ",").alias("changed"))


@query(
    "x19_v6_version_bump",
    "SELECT o_orderkey, (o_orderkey % 5) + CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS version FROM orders",
)
def x19(t):
    """A row that changes gets the next version."""
    from ..functions.scalars import differs

    new = F.lit("F")
    return t.orders.select("o_orderkey", (F.col("o_orderkey") % 5 + F.when(differs(F.col("o_orderstatus"), new), 1).otherwise(0)).alias("version"))


@query(
    "x16_principle_number",
    f"""WITH {_RECORDS}, m AS (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN '12' WHEN l_partkey % 4 = 1 THEN '' END AS sm, CASE WHEN l_suppkey % 3 = 1 THEN '7' END AS em, l_partkey % 5 = 0 AS unread,
        CASE l_partkey % 6 WHEN 0 THEN '-X4:7' WHEN 1 THEN 'pe' WHEN 2 THEN '' ELSE ' 5' END AS t, nullif(l_linenumber - 1, 0) AS sheet FROM r),
      n AS (SELECT *, coalesce(nullif(sm, ''), em) AS marked, CASE WHEN l_partkey % 6 = 0 THEN 'X4:7' WHEN l_partkey % 6 IN (1, 2) THEN NULL WHEN board IS NOT NULL THEN board || ':5' WHEN device IS NOT NULL THEN 'K1:5' END AS ft FROM m),
      s AS (SELECT *, CASE WHEN marked IS NULL AND NOT unread THEN ft ELSE marked END AS sel FROM n)
      SELECT l_orderkey, l_linenumber, sel || sheet AS number, CASE WHEN marked IS NULL AND NOT unread THEN 'actual_terminal' WHEN sm <> '' THEN 'start_marker' ELSE 'end_marker' END AS rule,
        CASE WHEN sheet IS NULL THEN 'page' WHEN sel IS NULL THEN 'connection' END AS field,
        CASE WHEN sheet IS NULL THEN '来源Sheet无法确认，原理号留空' WHEN sel IS NOT NULL THEN NULL WHEN unread THEN '标记数字可见但无法辨认，原理号留空' ELSE '本段无可确认标记编号或完整实际端子，原理号留空' END AS detail FROM s""",
)
def x16(t):
    p = F.col("l_partkey")
    marks = F.when(p % 4 == 0, "12").when(p % 4 == 1, ""), F.when(F.col("l_suppkey") % 3 == 1, "7")
    pin = F.when(p % 6 == 0, "-X4:7").when(p % 6 == 1, "pe").when(p % 6 == 2, "").otherwise(" 5")
    start = ru.full_terminal(pin, F.col("board"), F.col("device"))
    made = ru.principle_number(*marks, p % 5 == 0, start, F.lit(None).cast("string"), F.col("l_linenumber") - 1)
    return records(t).select("l_orderkey", "l_linenumber", made.alias("m")).select("l_orderkey", "l_linenumber", "m.*")


@query(
    "x36_correction_route",
    """WITH f AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'SOURCE_INSUFFICIENT' WHEN 1 THEN 'DIRECT_VALUE_CHANGE' WHEN 2 THEN 'FORMAT_OR_ORDER' WHEN 3 THEN 'PAGE_CLASSIFICATION_ERROR' WHEN 4 THEN 'RECOGNITION_ERROR' ELSE 'MISSING_START' END AS issue,
        CASE event_id % 3 WHEN 0 THEN 'same_page' WHEN 1 THEN 'cross_page' ELSE 'unknown' END AS state FROM events)
      SELECT event_id, CASE issue WHEN 'SOURCE_INSUFFICIENT' THEN 'NO_ACTION' WHEN 'DIRECT_VALUE_CHANGE' THEN 'DIRECT_PATCH' WHEN 'FORMAT_OR_ORDER' THEN 'DETERMINISTIC_ONLY' WHEN 'PAGE_CLASSIFICATION_ERROR' THEN 'RERUN_STAGE_1' ELSE 'RERUN_STAGE_2' END AS action,
        CASE issue WHEN 'SOURCE_INSUFFICIENT' THEN '' WHEN 'DIRECT_VALUE_CHANGE' THEN 'VALIDATION,PROPOSAL' WHEN 'FORMAT_OR_ORDER' THEN 'VALIDATION,PROPOSAL'
          WHEN 'PAGE_CLASSIFICATION_ERROR' THEN 'PAGE_CLASSIFICATION,PAGE_SCAN,VALIDATION,PROPOSAL' ELSE 'PAGE_SCAN,VALIDATION,PROPOSAL' END AS stages,
        (CASE WHEN issue IN ('SOURCE_INSUFFICIENT', 'DIRECT_VALUE_CHANGE', 'FORMAT_OR_ORDER') THEN 0 WHEN state = 'same_page' THEN 1 ELSE 2 END)::INT AS calls FROM f""",
)
def x36(t):
    names = ("SOURCE_INSUFFICIENT", "DIRECT_VALUE_CHANGE", "FORMAT_OR_ORDER", "PAGE_CLASSIFICATION_ERROR", "RECOGNITION_ERROR", "MISSING_START")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    route = ru.correction_route(pick(names, F.col("user_id")), pick(("same_page", "cross_page", "unknown"), F.col("event_id")))
    made = t.events.select("event_id", route.alias("r"))
    return made.select("event_id", "r.action", F.array_join("r.stages", ",").alias("stages"), "r.calls")


@query(
    "x37_start_identity",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AS q, l_suppkey % 2 = 0 AS b, l_partkey % 3 AS d FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN d = 0 THEN '+ES1' END AS location, CASE WHEN d = 1 THEN 'K1' END AS device, CASE WHEN q THEN 'A:XD3' WHEN b THEN 'XD4' END AS board, '7' AS terminal,
        q AND b AS conflict, CASE WHEN NOT (q AND b) THEN (q OR b OR d = 1) AND d <> 0 END AS same_without_place FROM f""",
)
def x37(t):
    """Identities, and whether a scan that leaves out the place still is the same start."""
    p = F.col("l_partkey") % 3
    r = {
        "start_terminal": F.when(F.col("l_linenumber") % 3 == 0, " -a:xd3 : 7").otherwise("7"),
        "start_terminal_board": F.when(F.col("l_suppkey") % 2 == 0, "-xd 4"),
        "start_code": F.when(p == 0, "+es1").when(p == 1, "-k 1"),
    }
    rows = ru.start_identities(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"i": r, "bare": r | {"start_code": F.when(p == 1, "K1")}})
    rows = rows.withColumn("same_without_place", ru.same_start(F.col("i"), F.col("bare")))
    return rows.select("l_orderkey", "l_linenumber", "i.*", "same_without_place")


@query(
    "x38_auto_selection",
    """WITH f AS (SELECT event_id, event_type <> 'view' AS rec, CASE user_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'abb' WHEN 2 THEN 'other' END AS k, value / 100 AS c FROM events),
      g AS (SELECT *, CASE k WHEN 'zh' THEN 'active' WHEN 'abb' THEN 'experimental' END AS s FROM f), h AS (SELECT *, rec AND s IS NOT NULL AS known FROM g)
      SELECT event_id, CASE WHEN known AND c >= 0.85 AND s = 'active' THEN 'PROFILE_SELECTED' ELSE 'WAITING_INPUT' END AS status, CASE WHEN known THEN k END AS detected,
        CASE WHEN known AND c >= 0.85 AND s = 'active' THEN k END AS assigned,
        CASE WHEN known AND c >= 0.85 AND s = 'active' THEN 'model' WHEN known AND s = 'experimental' THEN 'experimental' WHEN known AND c < 0.85 THEN 'low_confidence' WHEN k = 'other' THEN 'unregistered' ELSE 'model' END AS reason FROM h""",
)
def x38(t):
    u = F.col("user_id") % 4
    key = F.when(u == 0, "zh").when(u == 1, "abb").when(u == 2, "other")
    status = F.when(u == 0, "active").when(u == 1, "experimental")
    d = ru.auto_select(F.col("event_type") != "view", key, status, F.col("value") / 100)
    return t.events.select("event_id", d.alias("d")).select("event_id", "d.*")


@query(
    "j20_rescan_score",
    """WITH b AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS id, l_partkey AS no, l_suppkey % 6 AS st, l_linenumber % 4 AS en, l_partkey % 3 AS sc, l_suppkey % 2 AS ec, l_quantity / 50 AS x, l_discount AS y FROM lineitem),
      w AS (SELECT *, lead(id) OVER o AS id2, lead(no) OVER o AS no2, lead(st) OVER o AS st2, lead(en) OVER o AS en2, lead(sc) OVER o AS sc2, lead(ec) OVER o AS ec2, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM b WINDOW o AS (PARTITION BY page ORDER BY id, no, st, en, x)),
      p AS (SELECT id, id2, no = no2 AS same_no, (id % 5 = 0 AND id = id2) AS kept,
        CASE WHEN st > 0 THEN 'X:' || st END AS a1, CASE WHEN en > 0 THEN 'X:' || en END AS a2, CASE WHEN st2 > 0 THEN 'X:' || st2 END AS b1, CASE WHEN en2 > 0 THEN 'X:' || en2 END AS b2,
        CASE WHEN sc > 0 THEN 'K' || sc END AS c1, CASE WHEN ec > 0 THEN 'K' || ec END AS c2, CASE WHEN sc2 > 0 THEN 'K' || sc2 END AS d1, CASE WHEN ec2 > 0 THEN 'K' || ec2 END AS d2, x, y, x2, y2 FROM w WHERE id2 IS NOT NULL),
      s AS (SELECT *, CASE WHEN a1 = b1 AND coalesce(c1 = d1, TRUE) THEN CASE WHEN c1 = d1 THEN 80 ELSE 64 END ELSE 0 END AS k11 FROM p)
      SELECT id, id2, (CASE WHEN same_no THEN 4 ELSE 0 END + CASE WHEN a1 = b1 THEN 2 ELSE 0 END + CASE WHEN a2 = b2 THEN 2 ELSE 0 END + k11
        + CASE WHEN sqrt((x - x2) ** 2 + (y - y2) ** 2) < 0.025 THEN 5 ELSE 0 END)::INT AS score FROM s""",
)
def j20_score(t):
    """A line against the next of its order: points of starts lie on the page, those of ends on another."""
    order = Window.partitionBy("page").orderBy("id", "no", "st", "en", "x")
    base = t.lineitem.select(
        F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("no"), (F.col("l_suppkey") % 6).alias("st"),
        (F.col("l_linenumber") % 4).alias("en"), (F.col("l_partkey") % 3).alias("sc"), (F.col("l_suppkey") % 2).alias("ec"), (F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"),
    )
    names = ("id", "no", "st", "en", "sc", "ec", "x", "y")
    pairs = base.select("*", *[F.lead(c).over(order).alias(f"{c}2") for c in names]).where("id2 is not null")

    def side(n: str) -> dict:
        col = lambda c: F.col(c + n)
        named = lambda c, before: F.when(col(c) > 0, F.concat(F.lit(before), col(c).cast("string")))
        at = lambda page: F.struct(col("x").alias("x"), col("y").alias("y"), page.alias("page"))
        return {
            "id": F.lit(None).cast("long"), "page": F.col("page"), "no": col("no"), "start_terminal": named("st", "X:"), "end_terminal": named("en", "X:"),
            "start_code": named("sc", "K"), "end_code": named("ec", "K"), "start_point": at(F.col("page")), "end_point": at(-F.col("page") - 1),
        }

    return pairs.select("id", "id2", ru.rescan_score(side(""), side("2")).alias("score"))


@query("x39_cross_page_state", f"WITH {_RECORDS} SELECT l_orderkey, l_linenumber, CASE WHEN ref THEN 'cross_page' WHEN et IS NOT NULL THEN 'same_page' ELSE 'unknown' END AS state FROM r")
def x39(t):
    state = ru.cross_page_state(F.col("has_reference"), F.col("end_terminal"), F.lit("odd"))
    return records(t).select("l_orderkey", "l_linenumber", state.alias("state"))
