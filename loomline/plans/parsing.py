"""Text dialects over addresses made from the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialects as dl
from ..operators.joins import unique_match
from ..registry import query

_RAW = "'=' || lpad((l_partkey % 900)::VARCHAR, 3, '0') || '.' || chr((65 + l_suppkey % 26)::INT) || '+S' || l_linenumber || '/' || (l_partkey % 50) || '.' || l_quantity::INT"


def addressed(t):
    letter = F.chr((F.col("l_suppkey") % 26 + 65).cast("int"))
    raw = F.concat(
        F.lit("="), F.lpad((F.col("l_partkey") % 900).cast("string"), 3, "0"), F.lit("."), letter, F.lit("+S"), F.col("l_linenumber").cast("string"),
        F.lit("/"), (F.col("l_partkey") % 50).cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", raw.alias("raw"))


@query(
    "x3_s12_wire_addresses",
    f"""SELECT l_orderkey, l_linenumber, substr(regexp_extract(r, '^=([0-9]{{3}}\\.[A-Z])'), 2) AS function, regexp_extract(r, '/([0-9]{{1,3}})\\.', 1)::INT AS page,
              regexp_extract(r, '\\.([0-9]{{1,2}})$', 1)::INT AS col, regexp_extract(r, '(\\+[^/]+)/', 1) AS object FROM (SELECT *, {_RAW} AS r FROM lineitem)""",
)
def x3(t):
    parsed = dl.parsed_addresses(addressed(t), F.col("raw"), F.lit("082.R"), "a")
    return parsed.select("l_orderkey", "l_linenumber", "a.function", "a.page", F.col("a.column").alias("col"), "a.object")


@query("x3_ambiguous_addresses", "SELECT l_orderkey, l_linenumber, l_partkey % 2 = 1 AS named FROM lineitem")
def x3b(t):
    """Two addresses in one reference name nothing, one does."""
    raw = F.when(F.col("l_partkey") % 2 == 0, F.concat_ws(" ", "raw", "raw")).otherwise(F.col("raw"))
    parsed = dl.parsed_addresses(addressed(t), raw, F.lit("082.R"), "a")
    return parsed.select("l_orderkey", "l_linenumber", F.col("a").isNotNull().alias("named"))


@query(
    "x3_inherited_functions",
    "SELECT l_orderkey, l_linenumber, '082.' || chr((65 + l_suppkey % 26)::INT) AS function FROM lineitem",
)
def x3c(t):
    raw = F.concat(F.lit("."), F.chr((F.col("l_suppkey") % 26 + 65).cast("int")), F.lit("/5.1"))
    parsed = dl.parsed_addresses(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), raw, F.lit("082.R"), "a")
    return parsed.select("l_orderkey", "l_linenumber", "a.function")


@query(
    "x4_s13_sheet_references",
    "SELECT l_orderkey, l_linenumber, (l_partkey % 50)::INT AS sheet, l_quantity::INT AS col FROM lineitem",
)
def x4(t):
    d = dl.DIALECTS["sheet"]
    raw = F.concat(F.lit("see /"), (F.col("l_partkey") % 50).cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.lit("B and on"))
    found = t.lineitem.select("l_orderkey", "l_linenumber", F.explode(dl.references(raw, d)).alias("r"))
    part = lambda g: dl.group(F.col("r"), d.reference, g).cast("int")
    return found.select("l_orderkey", "l_linenumber", part(d.page).alias("sheet"), part(d.column).alias("col"))


@query(
    "s14_grid_addresses",
    "SELECT l_orderkey, l_linenumber, 'GCR.' || (l_partkey % 99 + 1) AS function, (l_suppkey % 26 + 1)::INT AS number, l_quantity <= 48 AS valid FROM lineitem",
)
def s14(t):
    d = dl.DIALECTS["grid"]
    raw = F.concat((F.col("l_partkey") % 99 + 1).cast("string"), F.chr((F.col("l_suppkey") % 26 + 65).cast("int")), F.format_string("%02d", F.col("l_quantity").cast("int")), F.lit("H"))
    # columns of their own, so that each pattern is searched once a row
    keys = ("l_orderkey", "l_linenumber")
    found = t.lineitem.select(*keys, raw.alias("raw")).select(*keys, F.regexp_extract("raw", d.reference, d.page).alias("page"), F.regexp_extract("raw", d.reference, d.column).alias("column"))
    column = F.nullif("column", F.lit("")).cast("int")
    sheets = found.select(*keys, F.upper(F.trim(F.nullif("page", F.lit("")))).alias("page"), column.alias("column"))
    encoded = sheets.select(*keys, dl.encode_sheet(F.col("page")).alias("s"), F.col("column").between(*dl.GRID_COLUMNS).alias("valid"))
    return encoded.select(*keys, "s.function", "s.number", "valid")


@query("s14_duplicate_sheets", "SELECT p_size, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def s14b(t):
    """Keys of an index that more than one page has: they would be errors."""
    return t.part.groupBy("p_size").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "s13_title_blocks",
    "SELECT s_suppkey, 'AB' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') AS function, s_suppkey::INT AS sheet, '+K' || s_nationkey AS object FROM supplier",
)
def s13(t):
    text = F.format_string("Plant Function: =AB%02d Object Loc. +K%d\nSheet %d", (F.col("s_suppkey") % 100).cast("int"), F.col("s_nationkey"), F.col("s_suppkey").cast("int"))
    # sheets are numbered by supplier, up to any INT
    return t.supplier.select("s_suppkey", dl.title_block(text, digits=10).alias("b")).select("s_suppkey", "b.function", "b.sheet", "b.object")


@query(
    "s2_s12_page_references",
    """SELECT page_id, count(*) AS n, min(u) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u FROM pages) GROUP BY 1""",
)
def s12(t):
    """Text of pages, parsed into references: what each page points to."""
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("u"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.min("u").alias("first"))


@query("f21_non_wiring_titles", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'steel') OR p_partkey % 10 = 0")
def f21(t):
    function = F.when(F.col("p_partkey") % 10 == 0, "000.A").otherwise("082.R")
    return t.part.where(dl.non_wiring(F.col("p_type"), function, ["steel"])).select("p_partkey")


@query(
    "p19_p22_scan_json",
    """SELECT event_id, 'u' || user_id AS wire, nullif(event_id % 4, 0)::INT AS page, CASE WHEN event_id % 2 = 0 THEN 'cross_page' ELSE 'same_page' END AS state FROM events""",
)
def p19(t):
    """JSON in either of two layouts to one: aliases by priority, fields outside the schema dropped, page 0 unknown, references
    given as text made structs, and the cross-page state taken from them."""
    e = F.col("event_id")
    new = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("wire_number"), (e % 4).alias("page"), F.array(F.lit("/3.1")).alias("references"), F.lit(1).alias("other")))
    old = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("line"), (e % 4).alias("page_number"), F.struct(F.lit("X1:2").alias("terminal")).alias("end")))
    raw = t.events.select("event_id", F.when(e % 2 == 0, new).otherwise(old).alias("j"))
    schema = "wire_number string, line string, page int, page_number int, references array<string>, end struct<terminal: string>"
    s = raw.select("event_id", F.from_json("j", schema).alias("s"))
    refs = F.transform(F.coalesce("s.references", F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw")))
    from ..functions.rules import cross_page_state

    return s.select(
        "event_id",
        F.coalesce("s.wire_number", "s.line").alias("wire"),
        F.nullif(F.coalesce("s.page", "s.page_number"), F.lit(0)).alias("page"),
        cross_page_state(F.size(refs) > 0, F.col("s.end.terminal"), F.lit(None).cast("string")).alias("state"),
    )


@query(
    "p20_p21_completion_json",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'kept' END AS verdict FROM events",
)
def p20(t):
    """Answers that lack their evidence go to the rejected ones with a reason, none is lost."""
    j = F.to_json(F.struct(F.col("event_id").cast("string").alias("task_id"), F.when(F.col("event_id") % 3 != 0, "seen").alias("evidence")))
    s = t.events.select("event_id", F.from_json(j, "task_id string, evidence string").alias("s"))
    good = (F.col("s.task_id") == F.col("event_id").cast("string")) & F.col("s.evidence").isNotNull()
    return s.select("event_id", F.when(good, "kept").otherwise("rejected").alias("verdict"))


@query(
    "j24_j38_reference_to_page",
    """SELECT o_orderkey, CASE WHEN m = 1 THEN k END AS l_partkey, coalesce(m, 0) AS matches FROM orders
       LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS m, min(l_partkey) AS k FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 49 GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def j24(t):
    found = t.lineitem.where("l_linenumber = 1 OR l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return unique_match(t.orders.select("o_orderkey"), found, ["o_orderkey"], ["l_partkey"], ["l_partkey"])


@query("x21_project_identity", "SELECT s_suppkey, upper(regexp_extract(s_name, '^([A-Za-z0-9]+)', 1)) AS project FROM supplier")
def x21(t):
    return t.supplier.select("s_suppkey", F.regexp_extract(F.concat(F.upper("s_name"), F.lit("-")), r"^([A-Z0-9]+)", 1).alias("project"))
