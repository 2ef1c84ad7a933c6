"""Predicates as named SQL functions, for `spark.sql`: their bodies are SQL, so the optimiser sees through them, folds a scope that is a literal and
pushes the equalities that are left to the scan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A scope is a JSON object; a key that is absent, null or an empty list doesn't restrict.
_TEXT = "get_json_object(scope, '$.{key}')"
_LIST = "coalesce(from_json(get_json_object(scope, '$.{key}'), 'array<string>'), array())"


def _equals(column: str, key: str) -> str:
    return f"({_TEXT.format(key=key)} IS NULL OR {column} = {_TEXT.format(key=key)})"


def _listed(column: str, key: str) -> str:
    return f"(size({_LIST.format(key=key)}) = 0 OR array_contains({_LIST.format(key=key)}, {column}))"


_NUMBER = "schema_of_variant(try_variant_get(try_parse_json(value), '$.{key}', 'variant')) RLIKE '^(BIGINT|DOUBLE|DECIMAL)'"
_AS = "try_variant_get(try_parse_json(value), '$.{key}', 'double')"

FUNCTIONS = {
    "explain_edit_matches": (
        "workspace_code STRING, drawing_page STRING, principle_number STRING, id STRING, scope STRING",
        " AND ".join([_equals("workspace_code", "workspace_code"), _equals("drawing_page", "drawing_page"), _listed("principle_number", "principle_numbers"), _listed("id", "connection_ids")]),
    ),
    "rescan_matches": (
        "workspace_code STRING, drawing_page STRING, principle_number STRING, id STRING, pdf_page STRING, scope STRING",
        "explain_edit_matches(workspace_code, drawing_page, principle_number, id, scope) AND " + _listed("pdf_page", "pdf_page_numbers"),
    ),
    "is_extraction_terminal_coordinates": (
        "value STRING",
        "CASE WHEN value IS NULL THEN NULL ELSE coalesce(array_sort(json_object_keys(value)) = array('pdf_page_number', 'x', 'y') AND "
        + " AND ".join(_NUMBER.format(key=k) for k in ("x", "y", "pdf_page_number"))
        + f" AND {_AS.format(key='x')} BETWEEN 0 AND 1 AND {_AS.format(key='y')} BETWEEN 0 AND 1"
        + f" AND {_AS.format(key='pdf_page_number')} >= 1 AND {_AS.format(key='pdf_page_number')} = floor({_AS.format(key='pdf_page_number')}), FALSE) END",
    ),
}


def register(spark: SparkSession) -> None:
    """Define the functions in the session. Defining them again changes nothing."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS BOOLEAN RETURN {body}")
