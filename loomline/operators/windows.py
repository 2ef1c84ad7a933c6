"""Order-dependent operators, each partitioned by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order: a maximum per key before the shuffle would lose no row, but the whole row is
    asked for, so it is a window that Spark limits per key and task before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def sequence_in(df: DataFrame, name: str, keys: list[str], *order: Column, start: int = 0) -> DataFrame:
    """A gap-free number per key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def fill_down(df: DataFrame, keys: list[str], order: str, value: str, blank: Column) -> DataFrame:
    """The last filled value above, within a key, until a blank row resets it; blank rows go."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.withColumn("__g", F.sum(blank.cast("int")).over(w)).where(~blank)
    inside = Window.partitionBy(*keys, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(F.nullif(F.trim(value), F.lit("")), ignorenulls=True).over(inside)
    return grouped.withColumn(value, filled).drop("__g")


def allocate_numbers(df: DataFrame, keys: list[str], order: list[str], explicit: str, start: int = 1000) -> DataFrame:
    """Rows in order get the counter's next number; an explicit one pushes the counter to itself. In closed form: between two
    explicit numbers that raise the counter the free rows count on from the higher."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nulls = F.sum(F.col(explicit).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.withColumn("__free", nulls)
    lead = F.max(F.when(F.col(explicit).isNotNull(), F.greatest(F.col(explicit), F.lit(start - 1)) - F.col("__free"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    base = F.greatest(F.coalesce(lead, F.lit(start - 1)), F.lit(start - 1))
    return numbered.withColumn("number", F.coalesce(F.col(explicit), base + F.col("__free"))).drop("__free")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], cap: int, found: str = "found") -> DataFrame:
    """The first `cap` rows of each key, with how many there are in `found`, counted to cap + 1: more than `cap` says that there are more.
    The bound is applied before the shuffle too, so that a key brings at most cap + 1 rows from each task. `order` should leave no ties;
    null keys are a key, an empty table gives no rows, and a column named `found` is refused."""
    if found in df.columns:
        raise ValueError(f"there is a column {found}")
    # a filter right on the row number is what lets it go below the shuffle; the count is over what that leaves
    some = df.withColumn(found, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(found) <= cap + 1)
    whole = Window.partitionBy(*keys)
    counted = some.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(F.col(found).alias("place"), F.max(found).over(whole).alias("all")).alias(found))
    return counted.where(F.col(found)["place"] <= cap).withColumn(found, F.col(found)["all"])
