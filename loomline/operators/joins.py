"""Joins with rules about how many matches count, and which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, on: list[str], identity: list[str], values: list[str]) -> DataFrame:
    """`left` with `values` of the right rows that share `on`, if these have exactly one identity; else nulls. `matches` says how
    many identities there are. The right side is reduced before the join, so a key that many rows share costs one row."""
    kinds = right.groupBy(*on).agg(
        F.count_distinct(F.struct(*identity)).alias("matches"), F.min(F.struct(*identity, *[v for v in values if v not in identity])).alias("__m")
    )
    joined = left.join(kinds, on, "left")
    picked = [F.when(F.col("matches") == 1, F.col(f"__m.{v}")).alias(v) for v in values]
    return joined.select(*left.columns, *picked, F.coalesce("matches", F.lit(0)).alias("matches"))


def first_candidate(left: DataFrame, lookup: DataFrame, candidates: list[str], key: str, value: str) -> DataFrame:
    """`left` with `value` of the first of its candidate keys that the lookup has. One join on the candidates, which are few per row,
    and the earliest by position; the lookup's keys are unique."""
    rows = left.withColumn("__id", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    tried = rows.select("__id", F.posexplode(F.array(*candidates)).alias("__at", key))
    best = tried.join(lookup.select(key, value), key).groupBy("__id").agg(F.min_by(value, "__at").alias(value))
    return rows.select("__id").join(best, "__id", "left").select("__id.*", value)


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each parent with `values` of its newest child, by `order`, or nulls: a maximum taken before the join."""
    newest = children.groupBy(key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("__new"))
    return parents.join(newest, key, "left").select(*parents.columns, *[F.col(f"__new.{v}").alias(v) for v in values])


def full_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): rows added, removed or replaced, the last with the names of what changed."""
    both = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    return (
        both.select(
            F.coalesce(f"b.{key}", f"a.{key}").alias(key),
            F.when(F.col(f"b.{key}").isNull(), "add").when(F.col(f"a.{key}").isNull(), "remove").otherwise("replace").alias("change"),
            changed.alias("fields"),
        )
        .where((F.col("change") != "replace") | (F.size("fields") > 0))
        .withColumn("fields", F.when(F.col("change") == "replace", F.col("fields")).otherwise(F.array().cast("array<string>")))
    )


def unique_both_sides(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(on, left_id, right_id) of the keys that one row has on either side."""
    one = lambda df, i: df.groupBy(*on).agg(F.count("*").alias("n"), F.min(i).alias(i)).where("n = 1").drop("n")
    return one(left, left_id).join(one(right, right_id), on)


def exact_else_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose name is the text; if there are none, those that contain it."""
    exact = df.where(F.lower(column) == text.lower())
    none = exact.limit(1).agg((F.count("*") == 0).alias("__none"))
    loose = df.where(F.lower(column).contains(text.lower())).crossJoin(F.broadcast(none)).where("__none").drop("__none")
    return exact.unionByName(loose)


def ranked_matches(pairs: DataFrame, left_id: str, right_id: str, score: str, least: float) -> DataFrame:
    """One-to-one matches out of scored pairs: each left row takes its best right row if the score is at least `least` and no
    other has the same; a right row taken twice, or that ties for best, is uncertain and matches nothing."""
    best = pairs.groupBy(left_id).agg(F.max(score).alias("__best"))
    top = pairs.join(best, left_id).where((F.col(score) == F.col("__best")) & (F.col("__best") >= least))
    chosen = top.groupBy(left_id).agg(F.count("*").alias("ties"), F.collect_set(right_id).alias("options"), F.max(score).alias(score))
    tied = chosen.where("ties > 1").select(F.explode("options").alias(right_id))
    single = chosen.where("ties = 1").select(left_id, F.col("options")[0].alias(right_id), score)
    repeated = single.groupBy(right_id).count().where("count > 1").select(right_id)
    return single.join(tied.union(repeated).distinct(), right_id, "left_anti").select(left_id, right_id, score)


def count_over(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))
