"""Aggregations: roll-ups, first-non-blank merges, consensus, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_list(value: Column, *order: Column) -> Column:
    """`value` gathered in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v")))), lambda x: x["v"])


def first_filled_by(value: Column, order: Column) -> Column:
    """The first value, in order, that isn't null or blank."""
    filled = F.nullif(F.trim(value), F.lit(""))
    return F.min_by(filled, F.when(filled.isNotNull(), order))


def consensus(results: DataFrame, key: list[str], answer: str, confidence: str, seq: str) -> DataFrame:
    """(key, state, answer): one distinct answer is resolved, by its most confident result, the first on ties; several are
    conflicting; none is unavailable."""
    best = F.max_by(answer, F.when(F.col(answer).isNotNull(), F.struct(F.col(confidence), -F.col(seq))))
    kinds = results.groupBy(*key).agg(F.count_distinct(answer).alias("kinds"), best.alias("best"))
    state = F.when(F.col("kinds") == 1, "resolved").when(F.col("kinds") > 1, "conflicting").otherwise("unavailable")
    return kinds.select(*key, state.alias("state"), F.when(F.col("kinds") == 1, F.col("best")).alias("answer"))


def multiset_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows with `side`: missing (expected, not there) or extra."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).union(
        actual.exceptAll(expected).withColumn("side", F.lit("extra"))
    )


def nearest_rank(df: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """The ceil(n * share)-th smallest value."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias(value))


def precision_recall(hits: DataFrame, *keys: str) -> DataFrame:
    """From rows (expected, predicted) of booleans; nothing predicted or expected counts as 1."""
    both = F.count_if(F.col("expected") & F.col("predicted"))
    rate = lambda n, d: F.when(d == 0, F.lit(1.0)).otherwise(n / d)
    predicted, expected = F.count_if("predicted"), F.count_if("expected")
    return hits.groupBy(*keys).agg(rate(both, predicted).alias("precision"), rate(both, expected).alias("recall"))


def table_digest(df: DataFrame, digits: int = 3) -> DataFrame:
    """One digest of all rows whatever their order: rows are hashed, digests of buckets, by the first `digits` of the hash, are taken in
    parallel of their sorted hashes, and the digest of the buckets' digests is the table's. No task and no row holds the table."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    rows = df.select(h.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    line = F.concat_ws(":", "h", F.col("n").cast("string"))
    per = rows.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(ordered_list(F.col("d"), F.col("b")), ","), 256).alias("digest"))


def contiguous_prefix(pages: DataFrame, keys: list[str], start: str, size: str, total: str) -> DataFrame:
    """(keys, covered, complete): how far pages [start, start + size) reach from 0 without a gap."""
    order = Window.partitionBy(*keys).orderBy(start, size)
    reach = F.max(F.col(start) + F.col(size)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.max((F.col(start) > F.coalesce(reach, F.lit(0))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    covered = pages.withColumn("__gap", gap).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__gap") == 0, F.col(start) + F.col(size))), F.lit(0)).alias("covered"), F.max(total).alias("__total")
    )
    return covered.select(*keys, "covered", (F.col("covered") >= F.col("__total")).alias("complete"))
