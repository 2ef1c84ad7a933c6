"""The named SQL functions through SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.named import register
from ..registry import query


def said(spark: SparkSession, text: str, table: DataFrame) -> DataFrame:
    """SQL text over `table`, which it calls @rows; its braces are those of JSON."""
    register(spark)
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("@rows", "{rows}"), rows=table)


_SCOPE = '{"workspace_code": "1-URGENT", "drawing_page": null, "principle_numbers": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "connection_ids": []}'


@query(
    "v3_explain_edit_matches",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)",
)
def edit_matches(t):
    """Rows in a scope of one workspace and some numbers; an absent, null or empty part of it doesn't restrict."""
    return said(t.spark, f"SELECT o_orderkey FROM @rows WHERE explain_edit_matches(o_orderpriority, o_orderstatus, string(o_custkey), string(o_orderkey), '{_SCOPE}')", t.orders)


@query(
    "v3_rescan_matches",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_partkey % 3 <> 0 OR l_returnflag = 'R') AND (l_partkey % 3 <> 1 OR l_linestatus = 'F') AND (l_partkey % 5 <> 0 OR l_suppkey IN (1, 3))
       AND (l_partkey % 7 <> 0 OR l_linenumber IN (2, 4)) GROUP BY 1, 2""",
)
def rescan_matches(t):
    """Rows each held against a scope of its own."""
    part = lambda n, rest, then: f"CASE WHEN l_partkey % {n} = {rest} THEN '{then}' ELSE '' END"
    scope = " || ".join(
        [
            "'{\"none\": 0'", part(3, 0, ', "workspace_code": "R"'), part(3, 1, ', "drawing_page": "F", "connection_ids": null'),
            part(5, 0, ', "principle_numbers": ["1", 3]'), part(7, 0, ', "pdf_page_numbers": [2, 4]'), "'}'",
        ]
    )
    return said(
        t.spark,
        f"""SELECT l_orderkey, l_linenumber, count(*) AS n FROM @rows
            WHERE rescan_matches(l_returnflag, l_linestatus, string(l_suppkey), string(l_orderkey), string(l_linenumber), {scope}) GROUP BY 1, 2""",
        t.lineitem,
    )


@query(
    "v3_valid_coordinates",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN value BETWEEN 0 AND 1 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE WHEN 4 THEN NULL WHEN 5 THEN FALSE WHEN 6 THEN FALSE ELSE user_id > 0 END AS valid FROM events""",
)
def valid_coordinates(t):
    """Points as JSON: of exactly three numbers, x and y from 0 to 1 and a page that counts; text, bad JSON and other keys aren't valid."""
    given = """CASE event_id % 8 WHEN 0 THEN '{"x": ' || value || ', "y": 1, "pdf_page_number": 7}' WHEN 1 THEN '{"pdf_page_number": 2, "y": 0.0, "x": 0.25}' WHEN 2 THEN '{"x": 0.5, "y": 0.5}'
        WHEN 3 THEN '{"x": "0.5", "y": 0.5, "pdf_page_number": 1}' WHEN 5 THEN '{"x": 0.5, "y"' WHEN 6 THEN '[' || value || ']' WHEN 7 THEN '{"x": 0.5, "y": 0.5, "pdf_page_number": ' || user_id || '}' END"""
    return said(t.spark, f"SELECT event_id, is_extraction_terminal_coordinates({given}) AS valid FROM @rows", t.events)
