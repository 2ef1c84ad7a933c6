"""Column builders: one small deterministic rule each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the URL namespace of RFC 4122


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def function_code(c: Column) -> Column:
    """Trimmed, upper case, without one leading `=`."""
    return F.regexp_replace(F.upper(F.trim(c)), "^=", "")


def plant_function(c: Column) -> Column:
    """As `function_code`, without any leading `=`."""
    return F.regexp_replace(F.upper(F.trim(c)), "^=+", "")


def folder_slug(c: Column, instead: str = "unknown") -> Column:
    """Safe as a folder name: other characters than letters, digits, dot, underscore and hyphen become one hyphen."""
    slug = F.regexp_replace(F.regexp_replace(plant_function(c), r"[^A-Z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(instead))


def file_name(c: Column) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\x00-\x1f]+', "_")


def name_key(c: Column) -> Column:
    """For comparing names: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def page_label(function: Column, page: Column) -> Column:
    """Function without dots and the page with two digits at least."""
    return F.concat(F.replace(function, F.lit("."), F.lit("")), F.format_string("%02d", page.cast("int")))


def drawing_label(function: Column, page: Column) -> Column:
    return F.when(page.isNull(), function).otherwise(F.concat_ws("/", function, page.cast("string")))


def clamp01(c: Column) -> Column:
    """A confidence in [0, 1]; what is no number is null."""
    value = c.try_cast("double")  # least and greatest skip nulls
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def version_key(c: Column) -> Column:
    """`1.10.0` as [1, 10, 0]; what isn't numeric is [0]."""
    numeric = F.coalesce(c, F.lit("")).rlike(r"^[0-9]+(\.[0-9]+)*$")
    return F.when(numeric, F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))).otherwise(F.array(F.lit(0)))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def exceeds_ratio(value: Column, base: Column, ratio: float = 1.2) -> Column:
    """More than `ratio` times the base; above zero, where the base is zero."""
    return F.when(base <= 0, value > 0).otherwise(value > base * ratio)


def crop_to_page(at: Column, origin: Column, extent: Column) -> Column:
    """A coordinate in a crop, as one of the page."""
    return origin + at * extent


def page_to_crop(at: Column, origin: Column, extent: Column) -> Column:
    return (at - origin) / extent


def valid_point(x: Column, y: Column, page: Column) -> Column:
    """A coordinate document that may be stored: both in [0, 1], a whole page from 1."""
    inside = lambda c: c.isNotNull() & (c >= 0) & (c <= 1)
    return inside(x) & inside(y) & page.isNotNull() & (page >= 1) & (page == F.floor(page))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def row_digest(*columns: Column) -> Column:
    """sha256 of the columns as JSON with nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ."""
    return F.filter(F.array(*[F.when(differs(a, b), F.lit(k)) for k, (a, b) in pairs.items()]), lambda x: x.isNotNull())


def reasons(cases: list[tuple[Column, str]]) -> Column:
    """The texts of the conditions that hold, in order, each once; a null condition doesn't hold."""
    # arrays put together are compiled, a filter by a lambda is interpreted with all below it
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(c, F.array(F.lit(t))).otherwise(none) for c, t in cases]))
