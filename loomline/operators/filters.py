"""Row filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import differs

LONGEST_SEARCH = 100
LARGEST_RANGE = 200
# The signs that may stand between the ends of a range, and the form of a number.
RANGE_SIGN = re.compile(r"\s*(?:[-~～—–]|至)\s*")
NUMBERED = re.compile(r"(.*?)([0-9]{1,12})", re.DOTALL)


def scope(df: DataFrame, **equals) -> DataFrame:
    """Equality on each given column; a null value asks nothing."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def optional_scope(column: Column, wanted) -> Column:
    """As a predicate: null or an empty list match all, a list its members, any other value itself."""
    if wanted is None or (isinstance(wanted, list | tuple) and not wanted):
        return F.lit(True)
    return column.isin(*wanted) if isinstance(wanted, list | tuple) else column == wanted


def search_text(text: str) -> str:
    """What a search keeps of its input: letters, digits and ` :_-+`, at most 100 characters. `_` stays a wildcard."""
    return "".join(c for c in text.strip() if c.isalnum() or c in " :_-+")[:LONGEST_SEARCH]


def searched(text: Column) -> Column:
    """`search_text` of a column."""
    return F.substring(F.regexp_replace(F.btrim(text), r"[^\p{L}\p{N} :_+\-]", ""), 1, LONGEST_SEARCH)


def contains_any(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Case-insensitive containment in any of the columns."""
    wanted = search_text(text)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{wanted}%"), F.lit(False))
    return df.where(found) if wanted else df


def any_column_contains(df: DataFrame, text: str) -> DataFrame:
    """Containment in the joined text of all columns."""
    return df.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).contains(text.lower()))


def in_set(column: Column, values: list) -> Column:
    return column.isin(*dict.fromkeys(values))


def expand_numbers(text: str) -> list[str] | None:
    """`A001-005` as A001 to A005; null if it is no range of one prefix, or has more than 200 numbers."""
    ends = RANGE_SIGN.split(text.strip())
    low = NUMBERED.fullmatch(ends[0]) if len(ends) == 2 else None
    high = NUMBERED.fullmatch(ends[1]) if low else None
    if not high or high[1] not in ("", low[1]):
        return None
    width = len(low[2])
    last = high[2] if high[1] or len(high[2]) >= width else low[2][: width - len(high[2])] + high[2]
    numbers = range(int(low[2]), int(last) + 1)
    return [f"{low[1]}{n:0{width}d}" for n in numbers] if 0 < len(numbers) <= LARGEST_RANGE else None


def by_number(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose number is `text`; only if there are none at all, those of the range that `text` spells."""
    exact = df.where(F.col(column) == text)
    numbers = expand_numbers(text)
    if not numbers:
        return exact
    none = exact.limit(1).agg((F.count("*") == 0).alias("__none"))
    ranged = df.where(F.col(column).isin(*numbers)).crossJoin(F.broadcast(none)).where("__none").drop("__none")
    return exact.unionByName(ranged)


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every row that breaks a rule; null breaks it too."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def visible_to(df: DataFrame, owners: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose parent belongs to the user."""
    return df.join(owners.where(owner).select(key), key, "left_semi")


def visible_to_any(df: DataFrame, key: str, *grants: DataFrame) -> DataFrame:
    """Rows whose key any of the grants names; the grants are made distinct together, so no row comes twice."""
    allowed = grants[0].select(key)
    for g in grants[1:]:
        allowed = allowed.union(g.select(key))
    return df.join(allowed.distinct(), key, "left_semi")


def changed_since(df: DataFrame, expected: dict[str, Column]) -> DataFrame:
    """Rows that no longer are what was expected of them."""
    stale = F.lit(False)
    for name, value in expected.items():
        stale = stale | differs(F.col(name), value)
    return df.where(stale)


def oriented(df: DataFrame, role: str = "endpoint_role", basis: str = "direction_basis") -> DataFrame:
    """Receivers go; a row without a basis has an unknown role."""
    blank = F.trim(F.coalesce(F.col(basis), F.lit(""))) == ""
    return df.where(~F.col(role).eqNullSafe("receiver")).withColumn(role, F.when(blank, F.lit("unknown")).otherwise(F.col(role)))


def oriented_from_start(df: DataFrame, role: str = "endpoint_role", terminal: str = "start_terminal", status: str = "status") -> DataFrame:
    """Receivers go; a row without a start terminal needs review."""
    blank = F.coalesce(F.col(terminal), F.lit("")) == ""
    return df.where(~F.col(role).eqNullSafe("receiver")).withColumn(status, F.when(blank, F.lit("needs_review")).otherwise(F.col(status)))
