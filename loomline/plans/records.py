"""Records by their full rules: canonical fields, read models, stored payloads, answers of models, answer books, references, page groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import windows as wn
from ..operators.texts import first_related
from ..registry import query

SPACE = " \t\n\r\x0b\x0c"


def or_else(*columns: Column) -> Column:
    """The first that isn't null or empty, else the last as it is; blanks count as filled."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def text_of(*columns: Column) -> Column:
    """The first that isn't null or empty, trimmed; null where only blanks are left."""
    return F.nullif(F.btrim(or_else(*columns), F.lit(SPACE)), F.lit(""))


def canonical_fields(r: dict[str, Column]) -> list[Column]:
    """The 14 fields of the table and of what is published, in order."""
    filled = (r["drawing_function"] != "") & r["drawing_page_number"].isNotNull()
    fields = {
        "source_drawing_page": F.when(filled, sc.page_label(r["drawing_function"], r["drawing_page_number"])),
        "principle_number": r["line_number"],
        "terminal_strip": r["terminal_strip"],
        "start_code": or_else(r["start_device"], r["start_location"]),
        "start_description": r["start_name"],
        "start_terminal": r["start_terminal"],
        "end_code": or_else(r["end_device"], r["end_location"]),
        "end_description": r["end_name"],
        "end_terminal": r["end_terminal"],
        "current_value": r["current"],
        "color_mark": F.lit(None).cast("string"),
        "remark": r["remark"],
        "start_terminal_coordinates": r["start_terminal_coordinates"],
        "end_terminal_coordinates": r["end_terminal_coordinates"],
    }
    return [c.alias(name) for name, c in fields.items()]


@query(
    "p1_canonical_projection",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_size <> 7 THEN lpad((p_partkey % 200)::VARCHAR, 3, '0') || chr(65 + (p_partkey % 26)::INT) || printf('%02d', p_size * 3) END AS source_drawing_page,
              p_partkey::VARCHAR AS principle_number, p_brand AS terminal_strip, CASE WHEN p_size % 3 = 2 THEN p_brand ELSE p_type END AS start_code, p_name AS start_description, p_size::VARCHAR AS start_terminal,
              CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN NULL ELSE '' END AS end_code, p_type AS end_description, NULL::VARCHAR AS end_terminal, '63A' AS current_value, NULL::VARCHAR AS color_mark,
              p_name AS remark, '{"x":0.5}' AS start_terminal_coordinates, NULL::VARCHAR AS end_terminal_coordinates FROM part""",
)
def p1(t):
    k, size, none = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    function = F.concat(F.lpad((k % 200).cast("string"), 3, "0"), F.lit("."), F.chr((k % 26 + 65).cast("int")))
    record = {
        "drawing_function": F.when(k % 11 == 0, F.when(k % 2 == 0, "")).otherwise(function),
        "drawing_page_number": F.when(size != 7, size * 3),
        "line_number": k.cast("string"), "terminal_strip": F.col("p_brand"), "current": F.lit("63A"), "remark": F.col("p_name"),
        "start_device": F.when(size % 3 == 0, "").when(size % 3 == 2, F.col("p_brand")), "start_location": F.col("p_type"),
        "start_name": F.col("p_name"), "start_terminal": size.cast("string"), "start_terminal_coordinates": F.lit('{"x":0.5}'),
        "end_device": F.when(size % 2 == 0, F.col("p_name")), "end_location": F.when(k % 5 != 0, ""),
        "end_name": F.col("p_type"), "end_terminal": none, "end_terminal_coordinates": none,
    }
    return t.part.select("p_partkey", *canonical_fields(record))


def read_model(rows: DataFrame) -> DataFrame:
    """Connections as they are read: ids derived from project, workspace and page; defaults; what their evidence (JSON) says. A status
    that the evidence gives as null stays null, one that it lacks is `completed`."""
    code, page = F.coalesce("workspace_code", F.lit("")), F.col("page")
    name_of = lambda kind, x: F.concat(F.lit(f"extraction-{kind}:"), "project", F.lit(":"), x)
    says = lambda key: F.coalesce(F.array_contains(F.json_object_keys("evidence"), key), F.lit(False))
    of = lambda key: F.get_json_object("evidence", f"$.{key}")
    return rows.select(
        F.col("id").alias("connection_id"),
        sc.uuid5(name_of("workspace", code)).alias("workspace_id"),
        F.coalesce(F.nullif(code, F.lit("")), F.lit("未分类")).alias("workspace_name"),
        sc.uuid5(name_of("drawing", page.cast("string"))).alias("drawing_id"),
        page.alias("pdf_page_number"),
        of("voltage_level").alias("voltage_level"),
        F.when(says("processing_status"), of("processing_status")).otherwise("completed").alias("processing_status"),
        F.when(says("review_reasons"), of("review_reasons")).otherwise("[]").alias("review_reasons"),
    )


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{sc.NAMESPACE_URL}') || encode({name}))"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1)::INT % 4 + 1, 1)"
    return f"(left({h}, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


@query(
    "p3_read_model",
    f"""SELECT doc_id AS connection_id, {_uuid_sql("'extraction-workspace:' || source || ':' || coalesce(nullif(lang, 'en'), '')")} AS workspace_id, coalesce(nullif(lang, 'en'), '未分类') AS workspace_name,
        {_uuid_sql("'extraction-drawing:' || source || ':' || n_chars % 50")} AS drawing_id, n_chars % 50 AS pdf_page_number, CASE WHEN doc_id % 4 = 2 THEN '110kV' END AS voltage_level,
        CASE WHEN doc_id % 4 = 3 THEN 'running' WHEN doc_id % 4 <> 2 THEN 'completed' END AS processing_status, CASE WHEN doc_id % 4 = 3 THEN '["a","b"]' ELSE '[]' END AS review_reasons FROM documents""",
)
def p3(t):
    k = F.col("doc_id") % 4
    evidence = F.when(k == 1, "{}").when(k == 2, '{"processing_status": null, "voltage_level": "110kV"}').when(k == 3, '{"processing_status": "running", "review_reasons": ["a", "b"]}')
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("project"), F.nullif("lang", F.lit("en")).alias("workspace_code"), (F.col("n_chars") % 50).alias("page"), evidence.alias("evidence")
    )
    return read_model(rows)


def stored_end(side: str) -> list[Column]:
    """Code, description and terminal of an end of `r`, from the names that layouts have used for them, the nested end last."""
    flat, nested = (lambda f: F.col(f"r.{side}_{f}")), (lambda f: F.col(f"r.{side}.{f}"))
    return [
        text_of(flat("code"), flat("location"), flat("device"), nested("location"), nested("device")).alias(f"{side}_code"),
        text_of(flat("description"), flat("name"), flat("part"), nested("name"), nested("part")).alias(f"{side}_description"),
        text_of(flat("terminal"), nested("terminal")).alias(f"{side}_terminal"),
    ]


_END = "code string, {0}_location string, {0}_device string, {0}_description string, {0}_name string, {0}_part string, {0}_terminal string, {0} struct<location: string, device: string, name: string, part: string, terminal: string>"
PROPOSED = (
    "principle_number string, line_number string, current_value string, current string, color_mark string, color string, remark string, is_cross_page string, confidence string, status string, "
    "needs_review boolean, external_source_required boolean, " + ", ".join(f"{s}_" + _END.format(s) for s in ("start", "end"))
)


def stored_payload(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Proposed records (JSON) as rows to be stored."""
    r = lambda f: F.col(f"r.{f}")
    review = (F.lower(r("status")) == "needs_review").eqNullSafe(True) | F.coalesce(r("needs_review"), F.lit(False)) | F.coalesce(r("external_source_required"), F.lit(False))
    return rows.select(key, F.from_json(json, PROPOSED).alias("r")).select(
        key,
        text_of(r("principle_number"), r("line_number")).alias("principle_number"),
        *stored_end("start"),
        *stored_end("end"),
        text_of(r("current_value"), r("current")).alias("current_value"),
        text_of(r("remark")).alias("remark"),
        text_of(r("color_mark"), r("color")).alias("color_mark"),
        F.coalesce(F.nullif(r("is_cross_page"), F.lit("")), F.lit("unknown")).alias("is_cross_page"),
        sc.clamp01(F.nullif(r("confidence"), F.lit(""))).alias("confidence"),
        F.when(review, "needs_review").otherwise("extracted").alias("status"),
        review.alias("needs_review"),
    )


@query(
    "p9_fallback_chain",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE o_orderkey::VARCHAR END AS principle_number,
        CASE o_orderkey % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'L' WHEN 3 THEN 'D' WHEN 4 THEN 'SL' WHEN 5 THEN 'SD' END AS start_code, CASE o_orderkey % 6 WHEN 0 THEN 'N' WHEN 4 THEN 'SP' END AS start_description,
        CASE o_orderkey % 6 WHEN 4 THEN '7' END AS start_terminal, 'E' AS end_code, NULL::VARCHAR AS end_description, '1:2' AS end_terminal, '63A' AS current_value, NULL::VARCHAR AS remark, 'red' AS color_mark,
        CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'yes' END AS is_cross_page, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.25 END::DOUBLE AS confidence,
        CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 THEN 'needs_review' ELSE 'extracted' END AS status, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 AS needs_review FROM orders""",
)
def p9(t):
    k = F.col("o_orderkey")
    nth = lambda n, *texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (k % n + 1).cast("int"))
    start = nth(
        6, '"start_code": "C", "start_name": "N", "start_part": "x"', '"start_code": "", "start_location": "  L "', '"start_location": "   ", "start_device": "D"', '"start_device": "D", "start": {}',
        '"start": {"location": "SL", "device": "x", "part": "SP", "terminal": 7}', '"start_device": "", "start": {"location": null, "device": "SD"}',
    )
    said = F.concat(
        F.lit("{"), start, F.lit(', "line_number": "'), k.cast("string"), nth(2, '", "principle_number": " P "', '", "principle_number": ""'),
        nth(4, ', "confidence": 1.7', ', "confidence": "x"', ', "confidence": ""', ', "confidence": "0.25"'), nth(3, ', "is_cross_page": null', ', "is_cross_page": "yes"', ', "is_cross_page": "yes"'),
        F.when(k % 5 == 0, ', "status": "Needs_Review"').otherwise(""), F.when(k % 7 == 0, ', "needs_review": true').otherwise(""), F.when(k % 9 == 0, ', "external_source_required": true').otherwise(""),
        F.lit(', "end_device": "E", "end": {"device": "x", "terminal": "1:2"}, "current": "63A", "color": "red", "remark": "  "}'),
    )
    return stored_payload(t.orders.select("o_orderkey", said.alias("j")), "o_orderkey", "j")


def completion(rows: DataFrame, key: str, json: str, task: Column) -> DataFrame:
    """A model's answers to tasks: the reason why an answer is none, or its terminal and whether it lacks evidence. None is lost."""
    inner = F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("{}")) for k in ("completion", "result")], F.col(json))
    said = rows.withColumn("j", inner).withColumn("k", F.json_object_keys("j"))
    of = lambda path: F.get_json_object("j", f"$.{path}")
    ends = F.array_contains("k", "end") | F.exists("k", lambda x: x.startswith("end_"))
    unsure = F.exists(F.from_json(of("uncertainties"), "array<struct<detail: string>>"), lambda x: F.btrim(x["detail"], F.lit(SPACE)) != "")
    note = text_of(of("source_note")).isNotNull()
    reason = (
        F.when(F.col("k").isNull(), "not an object")
        .when(of("task_id") != task, "other task")
        .when(~ends, "no end")
        .when(~note & ~F.coalesce(unsure, F.lit(False)), "no grounds")
    )
    terminal = F.nullif(F.when(of("end").isNotNull(), of("end.terminal")).otherwise(of("end_terminal")), F.lit(""))
    made = said.select(key, reason.alias("reason"), terminal.alias("terminal"), (terminal.isNull() | ~note).alias("review"))
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return made.select(key, "reason", kept("terminal").alias("terminal"), kept("review").alias("needs_review"))


@query(
    "p20_completion_answers",
    """SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'other task' WHEN 2 THEN 'no end' WHEN 3 THEN 'no grounds' WHEN 5 THEN 'not an object' END AS reason,
        CASE event_id % 7 WHEN 0 THEN 'X1:2' WHEN 4 THEN 'K1:3' END AS terminal, CASE event_id % 7 WHEN 0 THEN false WHEN 4 THEN true WHEN 6 THEN true END AS needs_review FROM events""",
)
def p20(t):
    e = F.col("event_id")
    answers = [
        '{"completion": {"task_id": "#", "end": {"terminal": "X1:2"}, "source_note": "seen"}}', '{"task_id": "other", "end": null, "source_note": "s"}', '{"source_note": "s", "terminal": "1"}',
        '{"result": {"end": null, "source_note": " "}}', '{"end_terminal": "K1:3", "end_name": "", "uncertainties": [{"detail": "blurred"}]}', "[1]", '{"completion": {}, "end": {"terminal": ""}, "source_note": "x"}',
    ]
    said = F.element_at(F.array(*[F.lit(a) for a in answers]), (e % 7 + 1).cast("int"))
    return completion(t.events.select("event_id", F.replace(said, F.lit("#"), e.cast("string")).alias("said")), "event_id", "said", e.cast("string"))


@query(
    "p21_page_class",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '082.R' WHEN 1 THEN '083.A' WHEN 2 THEN '084.B' END AS plant_function, CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 4 WHEN 2 THEN 0 END AS drawing_page_number FROM events""",
)
def p21(t):
    """What a page is: the function under any of three names, the page under either of two; an empty one or page 0 falls through to the next."""
    answers = [
        '{"result": {"plant_function": "082.R", "function": "x", "drawing_page_number": 12, "page_number": 1}}', '{"plant_function": "", "drawing_function": "083.A", "drawing_page_number": 0, "page_number": 4}',
        '{"drawing_function": null, "function": "084.B", "page_number": 0}', '{"blank": true}',
    ]
    said = F.element_at(F.array(*[F.lit(a) for a in answers]), (F.col("event_id") % 4 + 1).cast("int"))
    of = lambda path: F.get_json_object("j", f"$.{path}")
    inner = F.coalesce(F.get_json_object(said, "$.result"), said)
    page = F.coalesce(F.nullif(of("drawing_page_number").cast("int"), F.lit(0)), of("page_number").cast("int"))
    return t.events.select("event_id", inner.alias("j")).select(
        "event_id", or_else(of("plant_function"), of("drawing_function"), of("function")).alias("plant_function"), page.alias("drawing_page_number")
    )


# Header texts of answer books and the fields they name.
ALIASES = {
    "页码": "page", "图纸页码": "page", "原理号": "lineNumber", "电压等级": "voltageLevel", "端子排": "terminalStrip", "起点元件": "startCode", "起点代号": "startCode", "起点描述": "startDescription",
    "起点名称": "startDescription", "起点端子": "startTerminal", "终点元件": "endCode", "终点代号": "endCode", "终点描述": "endDescription", "终点名称": "endDescription", "终点端子": "endTerminal",
    "电流": "current", "备注": "remark", "色标": "colorMark",
}
ANSWER_FIELDS = tuple(dict.fromkeys(ALIASES.values()))


def answer_rows(rows: DataFrame) -> DataFrame:
    """Answers of sheets (sheet, row, cells): the first row that names page and both terminals is the sheet's header, sheets without
    one give nothing; a page holds for the rows below it until a blank row or a repeated header; rows without number and terminals go.
    `error` says what a reader must refuse: a field named twice, a row without a page."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    cells = F.transform("cells", lambda c: F.coalesce(F.btrim(c, F.lit(SPACE)), F.lit("")))
    rows = rows.select("sheet", "row", cells.alias("cells"))
    named = rows.select("sheet", "row", F.transform("cells", lambda c: F.try_element_at(names, c)).alias("fields"))
    is_header = F.array_contains("fields", "page") & F.array_contains("fields", "startTerminal") & F.array_contains("fields", "endTerminal")
    heads = named.where(is_header).groupBy("sheet").agg(F.min_by("fields", "row").alias("fields"), F.min("row").alias("head"))
    known = F.array_compact("fields")
    value = lambda f: F.coalesce(F.get("cells", F.array_position("fields", F.lit(f)).cast("int") - 1), F.lit("")).alias(f)
    data = rows.join(heads, "sheet").where("row > head").select(
        "sheet", "row", (~F.exists("cells", lambda c: c != "")).alias("blank"), (F.size(known) > F.size(F.array_distinct(known))).alias("twice"), *[value(f) for f in ANSWER_FIELDS]
    )
    reset = F.col("blank") | (F.col("page") == "页码") | (F.col("startTerminal") == "起点端子")
    kept = wn.fill_down(data, ["sheet"], "row", "page", reset).where("lineNumber <> '' OR startTerminal <> '' OR endTerminal <> ''")
    error = F.when(F.col("twice"), "field named twice").when(F.col("page").isNull(), "no page")
    return kept.withColumn("error", error).withColumn("page", F.upper("page")).drop("blank", "twice")


@query(
    "s15_answer_book",
    """WITH s AS (SELECT user_id, event_id, event_type, event_type = 'click' OR event_id % 5 = 0 OR user_id % 3 = 0 AND event_id % 7 = 0 AND event_type <> 'view' AS reset, CASE WHEN event_type = 'view' THEN 'p' || event_id END AS page FROM events WHERE user_id % 3 <> 2),
        g AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM s),
        f AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM g WHERE NOT reset)
        SELECT user_id AS sheet, event_id AS row, upper(p) AS page, 'n' || event_id AS number, 's' AS start, 'e' AS end_, CASE WHEN p IS NULL THEN 'no page' END AS error FROM f WHERE event_id % 7 <> 0""",
)
def s15(t):
    return answers_of(answer_sheets(t)).select("sheet", "row", "page", "number", "start", "end_", "error")


def answers_of(sheets: DataFrame) -> DataFrame:
    return answer_rows(sheets).select("*", F.col("lineNumber").alias("number"), F.col("startTerminal").alias("start"), F.col("endTerminal").alias("end_"))


def answer_sheets(t) -> DataFrame:
    """Users as sheets and their events as rows, below a header of either of two layouts, or of none. In the first layout an event whose
    number is divisible by 7 and that brings no page has no filled cell, so it is a blank row; in the second one cell is always filled."""
    u, e = F.col("user_id"), F.col("event_id")
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    head = F.when(u % 3 == 0, row("图纸页码", "原理号", "起点端子", " 终点端子 ")).when(u % 3 == 1, row("终点端子", "页码", "其他", "原理号", "起点端子")).otherwise(row("页码", "备注"))
    full = e % 7 != 0
    page, number, start, end = F.when(F.col("event_type") == "view", F.concat(F.lit(" p"), e.cast("string"))), F.when(full, F.concat(F.lit("n"), e.cast("string"))), F.when(full, "s"), F.when(full, "e ")
    body = F.when(u % 3 == 0, row(page, number, start, end)).otherwise(row(end, page, "x", number, start))
    cells = F.when(F.col("event_type") == "click", row("", " ", F.lit(None).cast("string"))).when(e % 5 == 0, head).otherwise(body)
    sheets = t.events.select(u.alias("sheet"), e.alias("row"), cells.alias("cells"))
    heads = t.events.select("user_id").distinct().select(u.alias("sheet"), F.lit(-1).cast("long").alias("row"), head.alias("cells"))
    return heads.unionByName(sheets)


@query(
    "s15_answer_workbooks",
    """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS row, event_type = 'click' OR event_id % 5 = 0 OR user_id % 3 = 0 AND event_id % 7 = 0 AND event_type <> 'view' AS reset, CASE WHEN event_type = 'view' THEN 'p' || event_id END AS page FROM events WHERE user_id % 3 <> 2),
        g AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM s),
        f AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM g WHERE NOT reset)
        SELECT user_id::VARCHAR AS sheet, row, upper(p) AS page, 'n' || event_id AS number, 's' AS start, 'e' AS end_, CASE WHEN p IS NULL THEN 'no page' END AS error FROM f WHERE event_id % 7 <> 0""",
)
def s15_workbooks(t):
    """The answer book's sheets written as workbooks of many sheets, read by sheet, and their answers: `row` is that of the sheet."""
    from ..sources.workbooks import read_workbooks, write_workbooks
    from ..sources.shared import shared_folder

    folder = shared_folder(t.spark)
    sheets = answer_sheets(t).withColumn("sheet", F.col("sheet").cast("string"))
    write_workbooks(sheets.repartition("sheet").sortWithinPartitions("sheet", "row"), folder)
    return answers_of(read_workbooks(t.spark, folder)).select("sheet", "row", "page", "number", "start", "end_", "error")


def literal_reference(asked: DataFrame, index: DataFrame) -> DataFrame:
    """`asked` (page, raw) with `at`, the first in order (`place`) of the index's references of that page whose text equals, contains or is
    contained in `raw`; null without one. Texts are met once per page, however often either side repeats them."""
    known = index.groupBy("page", F.coalesce("raw", F.lit("")).alias("text")).agg(F.min("place").alias("at"))
    wanted = asked.where("raw <> ''").select("page", F.col("raw").alias("text")).distinct()
    return asked.join(first_related(wanted, known).withColumnRenamed("text", "raw"), ["page", "raw"], "left")


@query(
    "j9_literal_reference",
    """WITH q AS (SELECT p_partkey, p_size AS page, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN left(p_type, 4) WHEN 2 THEN p_type || '/' || p_brand ELSE '' END AS raw FROM part),
        i AS (SELECT p_partkey AS place, p_size AS page, CASE WHEN p_partkey % 40 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '/' || p_brand END AS known FROM part)
        SELECT p_partkey, min(place) AS at_ FROM q LEFT JOIN i ON q.page = i.page AND raw <> '' AND (contains(raw, known) OR contains(known, raw)) GROUP BY 1""",
)
def j9(t):
    k, kind, long = F.col("p_partkey"), F.col("p_type"), F.concat_ws("/", "p_type", "p_brand")
    raw = F.when(k % 4 == 0, kind).when(k % 4 == 1, F.substring(kind, 1, 4)).when(k % 4 == 2, long).otherwise("")
    known = F.when(k % 40 != 0, F.when(k % 2 == 0, kind).otherwise(long))
    asked = t.part.select("p_partkey", F.col("p_size").alias("page"), raw.alias("raw"))
    return literal_reference(asked, t.part.select(k.alias("place"), F.col("p_size").alias("page"), known.alias("raw"))).select("p_partkey", F.col("at").alias("at_"))


@query(
    "a10_function_pages",
    """WITH p AS (SELECT c_nationkey AS page, arg_min(nullif(c_custkey % 7, 3), c_custkey) FILTER (c_custkey % 7 <> 3) AS inside FROM customer GROUP BY 1),
        d AS (SELECT DISTINCT c_mktsegment AS function, c_nationkey AS page FROM customer)
        SELECT function, string_agg(page::VARCHAR, ',' ORDER BY coalesce(inside, 1000000000), page) AS pages FROM d JOIN p USING (page) GROUP BY 1""",
)
def a10(t):
    """Pages of each function, each once, in order of the first internal number that a page is given anywhere, those without one last."""
    rows = t.customer.select(F.col("c_mktsegment").alias("function"), F.col("c_nationkey").alias("page"), "c_custkey", F.nullif(F.col("c_custkey") % 7, F.lit(3)).alias("inside"))
    numbered = rows.where("inside IS NOT NULL").groupBy("page").agg(F.min_by("inside", "c_custkey").alias("inside"))
    seen = rows.select("function", "page").distinct().join(numbered, "page", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("inside", F.lit(10**9)).alias("at"), "page")))
    return seen.groupBy("function").agg(F.array_join(F.transform(order, lambda x: x["page"].cast("string")), ",").alias("pages"))


@query(
    "t6_publication_order",
    """SELECT 'scan' AS stage, event_id % 20 AS page, min(event_id) AS at_, count(*) AS n FROM events GROUP BY ALL
        UNION ALL SELECT 'completion', event_id % 20, event_id, n FROM (SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL)""",
)
def t6(t):
    """When rows are published: a page's at its scan; a connection's completion as soon as the last of its tasks is done, on that
    task's page."""
    tasks = t.events.select("event_id", (F.col("event_id") % 20).alias("page"), "user_id", "event_type")
    scans = tasks.groupBy("page").agg(F.min("event_id").alias("at_"), F.count("*").alias("n")).select(F.lit("scan").alias("stage"), "page", "at_", "n")
    done = tasks.groupBy("user_id", "event_type").agg(F.max_by("page", "event_id").alias("page"), F.max("event_id").alias("at_"), F.count("*").alias("n"))
    return scans.unionByName(done.select(F.lit("completion").alias("stage"), "page", "at_", "n"))
