"""Texts and artifacts: canonical JSON, facts without verdicts, request fingerprints with their cache, the raw sheet, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_text as jt
from ..functions.scalars import exceeds_ratio
from ..operators import filters as fl
from ..registry import query


def texts_of(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    "v5_canonical_json",
    """SELECT event_id, c AS canonical, 'sha256:' || sha256(c) AS digest, error FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"e":100,"key":' || event_id || '.5,"list":[true,null,{"a":"é\\n","z":0}],"status":"' || event_type || '"}'
         WHEN 1 THEN '{"deep":{"props":{"k":' || json_extract_string(props, 'k') || '},"text":"[' || user_id || ']"},"deep2":[[],{},[[' || event_id || ']]]}'
         WHEN 2 THEN '{"k":' || json_extract_string(props, 'k') || '}' WHEN 3 THEN NULL WHEN 4 THEN '{"a":"last","n":-0.00012}' ELSE NULL END AS c, CASE WHEN event_id % 6 = 5 THEN 'not JSON' END AS error FROM events)""",
)
def v5(t):
    """Key order, blanks, exponents, trailing zeros and a negative zero make no difference; of equal keys the last counts; a text that is no
    JSON is a row with its error."""
    i, props = F.col("event_id"), F.col("props")
    text = (
        F.when(i % 6 == 0, texts_of('{"status": "', F.col("event_type"), '", "key": ', i, '.500, "list": [true, null, {"z": -0.0, "a": "é\\n"}], "e": 1e2}'))
        .when(i % 6 == 1, texts_of('{"deep2": [[], {}, [[', i, ']]], "deep": {"text": "[', F.col("user_id"), ']", "props": ', props, "}}"))
        .when(i % 6 == 2, props)
        .when(i % 6 == 4, '{"n": -1.2e-4, "a": 1, "a": "last"}')
        .when(i % 12 == 5, F.substring(props, 1, 4))
        .when(i % 12 == 11, '{"x": NaN}')
    )
    made = t.events.select("event_id", jt.canonical_json(text).alias("j"))
    return made.select("event_id", F.col("j.text").alias("canonical"), jt.json_digest(F.col("j.text")).alias("digest"), F.substring_index("j.error", ":", 1).alias("error"))


@query(
    "p13_facts_only",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"units":[{"number":' || user_id || ',"ends":[{"pin":"é"},7]}],"required":["pin"]}' WHEN 1 THEN '{"k":' || json_extract_string(props, 'k') || '}'
         WHEN 2 THEN '{"required":{"k":1},"list":[[{"a":' || event_id || '}]]}' END AS facts, CASE WHEN event_id % 4 = 3 THEN 'not JSON' END AS error FROM events""",
)
def p13(t):
    """What a model said, less the verdicts that are not its own, at any depth; what is no JSON has an error."""
    i = F.col("event_id")
    said = (
        F.when(
            i % 4 == 0,
            texts_of(
                '{"status": "', F.col("event_type"), '", "units": [{"number": ', F.col("user_id"),
                ', "needs_review": true, "ends": [{"pin": "é", "review_reasons": [1]}, 7]}], "required": ["pin", "status", "completion_state"]}',
            ),
        )
        .when(i % 4 == 1, F.col("props"))
        .when(i % 4 == 2, texts_of('{"required": {"status": 0, "k": 1}, "list": [[{"a": ', i, ', "processing_status": {}}]], "scan_diagnostics": []}'))
        .otherwise(texts_of('{"units": [', i))
    )
    made = t.events.select("event_id", jt.facts_only(said).alias("j"))
    return made.select("event_id", F.col("j.text").alias("facts"), F.substring_index("j.error", ":", 1).alias("error"))


@query(
    "x34_s20_t8_model_cache",
    """WITH q AS (SELECT event_id, user_id, sha256('{"json_mode": true, "max_tokens": ' || CASE WHEN user_id % 2 = 0 THEN '512' ELSE 'null' END || ', "messages": [{"content": "say \\"' || event_type || '\\"", "role": "user"}], "model": "m' || user_id % 3
           || '", "temperature": 0.0, "thinking": null}') AS f FROM events),
       c AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'other' ELSE f END AS f, CASE WHEN user_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS workflow FROM q WHERE user_id % 3 <> 0)
       SELECT q.event_id, q.f AS fingerprint, CASE WHEN c.f IS NULL THEN 'miss' WHEN c.workflow <> 'v2' THEN 'stale' ELSE 'hit' END AS state FROM q LEFT JOIN c ON c.event_id = q.event_id AND c.f = q.f""",
)
def x34(t):
    """Requests against the results kept for them: of the same item and fingerprint, and of this workflow, else they are asked again."""
    u = F.col("user_id")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit('say "'), F.col("event_type"), F.lit('"')).alias("content")))
    tokens = F.when(u % 2 == 0, 512)
    model = F.concat(F.lit("m"), (u % 3).cast("string"))
    asked = jt.request_fingerprint(model, messages, F.lit(0.0), tokens, F.lit(True), F.lit(None).cast("string"))
    requests = t.events.select("event_id", "user_id", asked.alias("fingerprint"))
    kept = requests.where("user_id % 3 <> 0").select(
        F.col("event_id").alias("item"), F.when(u % 7 == 0, "other").otherwise(F.col("fingerprint")).alias("f"), F.when(u % 5 == 0, "v1").otherwise("v2").alias("workflow")
    )
    met = requests.join(kept, (F.col("event_id") == F.col("item")) & (F.col("fingerprint") == F.col("f")), "left")
    state = F.when(F.col("f").isNull(), "miss").when(F.col("workflow") != "v2", "stale").otherwise("hit")
    return met.select("event_id", "fingerprint", state.alias("state"))


# The columns of the raw sheet, in order.
RAW_HEADERS = (
    "source_image", "wire_number", "attribute", "model", "spec", "length", "current", "current_basis", "current_source_text", "line_number", "core_number", "color", "terminal_strip",
    "start_part", "start_location", "start_device", "start_name", "start_terminal", "end_part", "end_location", "end_device", "end_name", "end_terminal", "remark", "confidence",
    "source_note", "source_pages", "source_type", "external_source_required", "unit_id", "connection_id", "drawing_source_pages", "status", "start_terminal_strip",
    "end_terminal_strip", "intermediate_points", "references", "unit_identity_confidence", "raw_json", "start_terminal_coordinates", "end_terminal_coordinates",
)


def raw_sheet(records: DataFrame) -> DataFrame:
    """Records as the 41 text columns of the raw sheet: a field that is nested as its JSON, nulls in it left out, `raw_json` the whole record as it came, a
    truth value as TRUE or FALSE, text trimmed and null where nothing is left. Fields that the sheet doesn't name stand in `raw_json` only, and those that a
    record hasn't are null."""
    kinds = {f.name: f.dataType for f in records.schema.fields}

    def cell(name: str):
        if name == "raw_json":
            return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(records.columns)]))
        if name not in kinds:
            return F.lit(None).cast("string")
        c = F.col(f"`{name}`")
        if isinstance(kinds[name], (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        return F.upper(c.cast("string")) if isinstance(kinds[name], T.BooleanType) else F.nullif(F.trim(c.cast("string")), F.lit(""))

    return records.select(*[cell(h).alias(h) for h in RAW_HEADERS])


def raw_records(lines: DataFrame) -> DataFrame:
    """Lines as extracted records, with nested references, points and pages."""
    e = F.expr
    return lines.select(
        e("'page-' || l_orderkey || '.png'").alias("source_image"), e("string(l_partkey)").alias("wire_number"), e("CASE WHEN l_partkey % 2 = 0 THEN ' power ' ELSE ' ' END").alias("attribute"),
        e("l_quantity").cast("int").alias("current"), e("string(l_linenumber)").alias("line_number"), e("l_returnflag").alias("color"), e("'X' || l_linenumber").alias("terminal_strip"),
        e("CASE WHEN l_suppkey % 3 > 0 THEN '-K' || l_suppkey END").alias("start_device"), e("string(l_suppkey)").alias("start_terminal"), e("'X4:' || l_partkey").alias("end_terminal"),
        e("'a \"remark\"'").alias("remark"), e("array(l_orderkey, l_linenumber)").alias("source_pages"), e("l_partkey % 2 = 0").alias("external_source_required"), e("string(l_orderkey)").alias("unit_id"),
        e("l_orderkey || '-' || l_linenumber").alias("connection_id"), e("l_linestatus").alias("status"), e("array()").cast("array<string>").alias("intermediate_points"),
        e("array(named_struct('raw', '=/' || l_partkey, 'page', l_suppkey, 'target', CASE WHEN l_suppkey % 2 = 0 THEN 'T' END))").alias("references"),
        e("CASE WHEN l_partkey % 5 > 0 THEN named_struct('x', l_linenumber, 'y', 0, 'pdf_page_number', l_orderkey) END").alias("start_terminal_coordinates"), e("l_suppkey % 4").alias("unlisted"),
    )


#: The same records in SQL: field, its JSON or null, and its cell where that isn't the same text.
_RAW = {
    "attribute": ("CASE WHEN l_partkey % 2 = 0 THEN '\" power \"' ELSE '\" \"' END", "CASE WHEN l_partkey % 2 = 0 THEN 'power' END"),
    "color": ("'\"' || l_returnflag || '\"'", "l_returnflag"), "connection_id": ("'\"' || l_orderkey || '-' || l_linenumber || '\"'", "l_orderkey || '-' || l_linenumber"),
    "current": ("l_quantity::INT::VARCHAR", "l_quantity::INT::VARCHAR"), "end_terminal": ("'\"X4:' || l_partkey || '\"'", "'X4:' || l_partkey"),
    "external_source_required": ("CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END", "CASE WHEN l_partkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END"), "intermediate_points": ("'[]'", "'[]'"),
    "line_number": ("'\"' || l_linenumber || '\"'", "l_linenumber::VARCHAR"),
    "references": ("'[{\"raw\":\"=/' || l_partkey || '\",\"page\":' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN ',\"target\":\"T\"' ELSE '' END || '}]'", None),
    "remark": ("'\"a \\\"remark\\\"\"'", "'a \"remark\"'"), "source_image": ("'\"page-' || l_orderkey || '.png\"'", "'page-' || l_orderkey || '.png'"),
    "source_pages": ("'[' || l_orderkey || ',' || l_linenumber || ']'", None), "start_device": ("CASE WHEN l_suppkey % 3 > 0 THEN '\"-K' || l_suppkey || '\"' END", "CASE WHEN l_suppkey % 3 > 0 THEN '-K' || l_suppkey END"),
    "start_terminal": ("'\"' || l_suppkey || '\"'", "l_suppkey::VARCHAR"),
    "start_terminal_coordinates": ("CASE WHEN l_partkey % 5 > 0 THEN '{\"x\":' || l_linenumber || ',\"y\":0,\"pdf_page_number\":' || l_orderkey || '}' END", None),
    "status": ("'\"' || l_linestatus || '\"'", "l_linestatus"), "terminal_strip": ("'\"X' || l_linenumber || '\"'", "'X' || l_linenumber"), "unit_id": ("'\"' || l_orderkey || '\"'", "l_orderkey::VARCHAR"),
    "unlisted": ("(l_suppkey % 4)::VARCHAR", None), "wire_number": ("'\"' || l_partkey || '\"'", "l_partkey::VARCHAR"),
}
_RAW_JSON = "'{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || ({v[0]})" for k, v in sorted(_RAW.items())) + ") || '}'"
_RAW_CELLS = [f'{_RAW_JSON} AS "{h}"' if h == "raw_json" else f'{_RAW[h][1] or _RAW[h][0]} AS "{h}"' if h in _RAW else f'NULL::VARCHAR AS "{h}"' for h in RAW_HEADERS]


@query("k4_raw_sheet", f"SELECT {', '.join(_RAW_CELLS)} FROM lineitem")
def k4(t):
    return raw_sheet(raw_records(t.lineitem))


@query("f5_scope_and_pages", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 20 IN (3, 5)")
def f5(t):
    """A scope with a list of pages; an empty list is all pages."""
    page = F.col("o_custkey") % 20
    want = fl.optional_scope(F.col("o_orderstatus"), "F") & fl.optional_scope(F.col("o_orderpriority"), None)
    return t.orders.where(want & fl.optional_scope(page, [3, 5]) & fl.optional_scope(page, [])).select("o_orderkey")


#: What a case of evaluation is, by its number.
CASE_KINDS = ("target", "protected", "negative", "edge", "shadow")


def metrics(cases, group: str):
    """A row per group of `cases` (group, kind, valid, failed, cost, duration, right, predicted, expected: leaves that agree, are
    said and are asked): counts, rates and costs; a rate of nothing is 1."""
    passed = F.col("valid") & ~F.col("failed") & (F.col("right") == F.col("predicted")) & (F.col("right") == F.col("expected"))
    of = lambda kind: F.col("kind") == kind
    rate = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return cases.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(passed).alias("passed"),
        rate(F.count_if(of("target") & passed), F.count_if(of("target"))).alias("target_pass_rate"),
        F.count_if(of("protected") & ~passed).alias("protected_regressions"),
        F.count_if(of("negative") & (F.col("predicted") > 0) & (F.col("expected") == 0)).alias("negative_hallucinations"),
        (F.count_if("valid") / F.count("*")).alias("schema_valid_rate"),
        rate(F.sum("right"), F.sum("predicted")).alias("field_precision"),
        rate(F.sum("right"), F.sum("expected")).alias("field_recall"),
        F.sum("cost").alias("cost"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration)").alias("p95"),
    )


def evaluated(t, wrong: int):
    """Orders as cases and their lines as leaves, of which every `wrong`-th answer differs; negative cases ask for nothing."""
    leaf = (F.col("l_partkey") % wrong != 0).alias("same")
    leaves = t.lineitem.select("l_orderkey", leaf).groupBy("l_orderkey").agg(F.count_if("same").alias("same"), F.count("*").alias("n"))
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in CASE_KINDS]), (k % 5 + 1).cast("int"))
    negative = F.col("kind") == "negative"
    joined = t.orders.join(leaves, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("kind", kind)
    return joined.select(
        F.col("o_orderpriority").alias("g"), "kind", (k % 40 != 0).alias("valid"), (k % 90 == 0).alias("failed"), (k % 7 + F.lit(wrong)).alias("cost"), (k % 100 * F.lit(wrong)).alias("duration"),
        F.when(negative, 0).otherwise(F.col("same")).alias("right"), F.when(negative, F.col("n") - F.col("same")).otherwise(F.col("n")).alias("predicted"), F.when(negative, 0).otherwise(F.col("n")).alias("expected"),
    )


def _metrics_sql(wrong: int) -> str:
    return f"""SELECT g, count(*) AS total, count(*) FILTER (ok) AS passed, CASE WHEN count(*) FILTER (kind = 0) = 0 THEN 1.0 ELSE count(*) FILTER (kind = 0 AND ok) / count(*) FILTER (kind = 0) END::DOUBLE AS target_pass_rate,
        count(*) FILTER (kind = 1 AND NOT ok) AS protected_regressions, count(*) FILTER (kind = 2 AND p > 0 AND e = 0) AS negative_hallucinations, count(*) FILTER (valid) / count(*) AS schema_valid_rate,
        CASE WHEN sum(p) = 0 THEN 1.0 ELSE sum(r) / sum(p) END::DOUBLE AS field_precision, CASE WHEN sum(e) = 0 THEN 1.0 ELSE sum(r) / sum(e) END::DOUBLE AS field_recall, sum(cost)::BIGINT AS cost, quantile_disc(duration, 0.95)::DOUBLE AS p95
      FROM (SELECT *, valid AND NOT failed AND r = p AND r = e AS ok FROM (SELECT o_orderpriority AS g, o_orderkey % 5 AS kind, o_orderkey % 40 <> 0 AS valid, o_orderkey % 90 = 0 AS failed, o_orderkey % 7 + {wrong} AS cost, o_orderkey % 100 * {wrong} AS duration,
        CASE WHEN o_orderkey % 5 = 2 THEN 0 ELSE s END AS r, CASE WHEN o_orderkey % 5 = 2 THEN n - s ELSE n END AS p, CASE WHEN o_orderkey % 5 = 2 THEN 0 ELSE n END AS e
        FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_partkey % {wrong} <> 0) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)) GROUP BY 1"""


@query("a23_evaluation_metrics", _metrics_sql(9))
def a23_all(t):
    return metrics(evaluated(t, 9), "g").withColumn("p95", F.col("p95").cast("double"))


# What a release gate says, in order.
GATE = (
    "evaluation report is empty", "target cases did not all pass", "protected cases regressed", "negative cases introduced hallucinations", "schema valid rate is below 100%",
    "field precision decreased", "field recall decreased", "cost exceeds configured threshold", "P95 latency exceeds configured threshold",
)


def gate_reasons(new: str, base: str, ratio: float = 1.2):
    """Why a candidate's metrics (a struct) keep it from release, against the baseline's."""
    n, b = (lambda c: F.coalesce(F.col(f"{new}.{c}"), F.lit(0))), (lambda c: F.coalesce(F.col(f"{base}.{c}"), F.lit(0)))
    found = (
        (n("total") == 0) | (b("total") == 0), n("target_pass_rate") < 1, n("protected_regressions") > 0, n("negative_hallucinations") > 0, n("schema_valid_rate") < 1,
        n("field_precision") < b("field_precision"), n("field_recall") < b("field_recall"), exceeds_ratio(n("cost"), b("cost"), ratio), exceeds_ratio(n("p95"), b("p95"), ratio),
    )
    return F.array_compact(F.array(*[F.when(hit, F.lit(said)) for hit, said in zip(found, GATE, strict=True)]))


@query(
    "a26_release_gate",
    f"""WITH b AS ({_metrics_sql(9)}), n AS ({_metrics_sql(11)})
      SELECT b.g, concat_ws('|', CASE WHEN n.target_pass_rate < 1 THEN 'target cases did not all pass' END, CASE WHEN n.protected_regressions > 0 THEN 'protected cases regressed' END,
        CASE WHEN n.negative_hallucinations > 0 THEN 'negative cases introduced hallucinations' END, CASE WHEN n.schema_valid_rate < 1 THEN 'schema valid rate is below 100%' END,
        CASE WHEN n.field_precision < b.field_precision THEN 'field precision decreased' END, CASE WHEN n.field_recall < b.field_recall THEN 'field recall decreased' END,
        CASE WHEN n.cost > b.cost * 1.2 THEN 'cost exceeds configured threshold' END, CASE WHEN n.p95 > b.p95 * 1.2 THEN 'P95 latency exceeds configured threshold' END) AS reasons
      FROM b JOIN n USING (g)""",
)
def a26_all(t):
    """A candidate against its baseline, by group; no reason is a release."""
    side = lambda wrong, name: metrics(evaluated(t, wrong), "g").select("g", F.struct("*").alias(name))
    both = side(11, "new").join(side(9, "base"), "g", "full")
    return both.select("g", F.array_join(gate_reasons("new", "base"), "|").alias("reasons"))
