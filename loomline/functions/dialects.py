"""Text dialects of drawings: addresses, sheets, title blocks. A dialect is a table of patterns; Spark extracts with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns by which the three dialects mark references and title blocks.
WIRE_ADDRESS = r"(?i)(?<![A-Za-z0-9_])(=?(?:\d{3}\.[A-Z]|\.[A-Z]|[A-Z]))?(\+[A-Za-z0-9][A-Za-z0-9_.-]*)?/(\d{1,3})\.(\d{1,2})(?!\d)"
LOCAL_ADDRESS = r"^\s*(\d{1,3})\.(\d{1,2})(?=\s*(?:/|$))"
SHEET_REFERENCE = r"(?i)/(\d{1,4})[.](\d{1,2})([A-Z])\b"
GRID_ADDRESS = r"(?<![A-Z0-9])(\d{1,2}[A-Z])(\d{2})([A-HJ-NP-V])(?![A-Z0-9])"
TITLE_FUNCTION = r"(?i)(?:Plant\s+Function|Function)\s*:?[ \t]*(=?[A-Z]{2}\d{2})"
TITLE_SHEET = r"(?i)\bSheet\s*:?[ \t]*(\d{1,4})\b"
TITLE_OBJECT = r"(?i)(?:Object\s+Loc\.?|Location)\s*:?[ \t]*(\+[A-Z0-9_.-]+)"
GRID_COLUMNS = (1, 48)
PROJECT_IDENTITY = r"^([A-Z0-9]+)[-_ ]"


@dataclass(frozen=True)
class Dialect:
    """A reference pattern and which of its groups hold what; 0: it has none."""

    reference: str
    function: int = 0
    object: int = 0
    page: int = 0
    column: int = 0


DIALECTS = {
    "wire": Dialect(WIRE_ADDRESS, 1, 2, 3, 4),
    "sheet": Dialect(SHEET_REFERENCE, 0, 0, 1, 2),
    "grid": Dialect(GRID_ADDRESS, 0, 0, 1, 2),
}


def group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def references(text: Column, dialect: Dialect) -> Column:
    """Every reference in a text, as it stands there."""
    return F.regexp_extract_all(text, F.lit(dialect.reference), F.lit(0))


def inherited_function(named: Column, source: Column) -> Column:
    """A function code in a reference: none is the source's own; a letter alone, with or without a dot, continues the source's
    number; three digits and a letter get their dot."""
    return continued_function(F.ltrim(F.upper(F.trim(named)), F.lit("=")), source)


def continued_function(code: Column, source: Column) -> Column:
    """As `inherited_function`, of a code that is trimmed, upper case and without leading `=`."""
    stem = F.substring_index(source, ".", 1)
    return (
        F.when(code.isNull() | (code == ""), source)
        .when(code.rlike(r"^\.?[A-Z]$"), F.concat(stem, F.lit("."), F.regexp_replace(code, r"^\.", "")))
        .when(code.rlike(r"^\d{3}[A-Z]$"), F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 1)))
        .otherwise(code)
    )


def parse_address(raw: Column, source: Column) -> Column:
    """Struct (function, page, column, object) of the one address in a reference; null if there is none or more than one."""
    d = DIALECTS["wire"]
    found = F.regexp_count(raw, F.lit(d.reference)) + F.when(raw.rlike(LOCAL_ADDRESS), 1).otherwise(0)
    local = raw.rlike(LOCAL_ADDRESS)
    at = lambda own, other: F.when(local, group(raw, LOCAL_ADDRESS, other)).otherwise(group(raw, d.reference, own)).cast("int")
    function = F.when(local, source).otherwise(inherited_function(group(raw, d.reference, d.function), source))
    return F.when(
        found == 1,
        F.struct(
            function.alias("function"),
            at(d.page, 1).alias("page"),
            at(d.column, 2).alias("column"),
            F.when(~local, group(raw, d.reference, d.object)).alias("object"),
        ),
    )


def parsed_addresses(df: DataFrame, raw: Column, source: Column, name: str) -> DataFrame:
    """`df` with `parse_address` as a column. Each step's columns are read by name by the next, so that each pattern is searched once a row:
    put into one another they would be searched wherever a part is used."""
    d = DIALECTS["wire"]
    kept, local = df.columns, F.col("__local")
    part = lambda i: F.regexp_extract("__raw", d.reference, i)
    df = df.withColumns({"__raw": raw, "__source": source})
    df = df.withColumns(
        {
            "__n": F.regexp_count("__raw", F.lit(d.reference)), "__local": F.col("__raw").rlike(LOCAL_ADDRESS), "__function": part(d.function),
            "__page": part(d.page), "__column": part(d.column), "__object": part(d.object),
        }
    )
    df = df.withColumns({"__code": F.ltrim(F.upper(F.trim("__function")), F.lit("="))})
    at = lambda own, other: F.nullif(F.when(local, F.regexp_extract("__raw", LOCAL_ADDRESS, other)).otherwise(F.col(own)), F.lit("")).cast("int")
    address = F.struct(
        F.when(local, F.col("__source")).otherwise(continued_function(F.col("__code"), F.col("__source"))).alias("function"),
        at("__page", 1).alias("page"),
        at("__column", 2).alias("column"),
        F.when(~local, F.nullif("__object", F.lit(""))).alias("object"),
    )
    return df.select(*kept, F.when(F.col("__n") + F.when(local, 1).otherwise(0) == 1, address).alias(name))


def encode_sheet(raw: Column) -> Column:
    """`3C` as (GCR.3, 3), the letter as its place; `TD 12.b` as (GCR.TD, 1202); else null."""
    text = F.upper(F.trim(raw))
    sheet, report = r"^(\d{1,2})([A-Z])$", r"^TD[ :]*(\d{1,2})(?:\.([A-Z]))?$"
    place = lambda p: F.ascii(F.regexp_extract(text, p, 2)) - 64
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    pair = lambda f, n: F.struct(f.alias("function"), n.cast("int").alias("number"))
    return F.when(
        text.rlike(sheet), pair(F.concat(F.lit("GCR."), number(sheet).cast("string")), place(sheet))
    ).when(
        text.rlike(report) & number(report).between(1, 99),
        pair(F.lit("GCR.TD"), F.when(F.regexp_extract(text, report, 2) == "", number(report)).otherwise(number(report) * 100 + place(report))),
    )


def decode_sheet(function: Column, number: Column) -> Column:
    """The inverse of `encode_sheet`."""
    letter = lambda n: F.chr(n.cast("int"))
    report = F.when(
        number >= 100, F.concat(F.lit("TD:"), F.floor(number / 100).cast("string"), F.lit("."), F.lower(letter(64 + number % 100)))
    ).otherwise(F.concat(F.lit("TD:"), number.cast("string")))
    sheet = F.when(number.between(1, 26), F.concat(F.substring_index(function, ".", -1), letter(64 + number)))
    return F.when(function == "GCR.TD", report).when(function.rlike(r"^GCR\.\d+$"), sheet)


def title_block(text: Column, digits: int = 4) -> Column:
    """Struct (function, sheet, object) of a page's title block. A sheet has four digits at most in the dialect's drawings, a longer number is
    none; `digits` is for a plant that numbers more."""
    return F.struct(
        F.regexp_replace(F.upper(group(text, TITLE_FUNCTION, 1)), "^=", "").alias("function"),
        group(text, TITLE_SHEET.replace("{1,4}", f"{{1,{digits}}}"), 1).cast("int").alias("sheet"),
        group(text, TITLE_OBJECT, 1).alias("object"),
    )


def non_wiring(title: Column, function: Column, keywords: list[str]) -> Column:
    """A title that names no wiring, or a page of function 000."""
    named = F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(keywords))
    return named | F.coalesce(function.startswith("000"), F.lit(False))
