"""Next states of a table as pure functions: merge, replace, patch, with what conflicts as rows of their own. Parquet has no locks or
transactions; a caller writes the state these return to a new place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(target: DataFrame, source: DataFrame, key: list[str], fields: list[str], version: str = "version") -> DataFrame:
    """Source rows update the target's row of their key, if any field differs, else are inserted; with `action`."""
    both = target.alias("t").join(source.alias("s"), key, "full_outer")
    in_t, in_s = F.col(f"t.{version}").isNotNull(), F.col("s.__in")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"t.{f}").eqNullSafe(F.col(f"s.{f}"))
    action = F.when(~in_t, "insert").when(in_s & changed, "update").otherwise("keep")
    return both.select(
        *key,
        *[F.when(F.coalesce(in_s, F.lit(False)), F.col(f"s.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in fields],
        F.when(~in_t, F.lit(1)).when(in_s & changed, F.col(f"t.{version}") + 1).otherwise(F.col(f"t.{version}")).alias(version),
        action.alias("action"),
    )


def marked(source: DataFrame) -> DataFrame:
    """`source`, so that `merged` can tell its rows."""
    return source.withColumn("__in", F.lit(True))


def pruned(target: DataFrame, source: DataFrame, key: list[str], scope: Column) -> DataFrame:
    """The target without rows in scope that the source doesn't have."""
    return target.where(~scope).unionByName(target.where(scope).join(source.select(*key), key, "left_semi"))


def replaced(table: DataFrame, baseline: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with exactly the baseline's rows deleted and the new ones in."""
    return table.join(baseline.select(*key), key, "left_anti").unionByName(new)


def conflicts(table: DataFrame, expected: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """Expected rows that are gone or have another version: late changes, which reject a commit."""
    now = table.select(*key, F.col(version).alias("__now"))
    return expected.join(now, key, "left").where(~F.col("__now").eqNullSafe(F.col(version))).select(*key, version, F.col("__now").alias("found"))


def patched(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each change has `mask`, the names of the fields it sets; others stay."""
    joined = table.alias("t").join(changes.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "left")
    masked = lambda f: F.coalesce(F.array_contains("c.mask", f), F.lit(False))
    return joined.select(F.col(f"t.{key}").alias(key), *[F.when(masked(f), F.col(f"c.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in fields])


def new_steps(done: DataFrame, steps: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(steps not done yet, steps done before with another payload): the first are to be written, the second are errors."""
    before = done.select(F.col(key), F.col(payload).alias("__before"))
    return steps.join(before, key, "left_anti"), steps.join(before, key).where(~F.col(payload).eqNullSafe(F.col("__before"))).drop("__before")
