"""Places in an order, and digests of ranges, at any size and however keys are spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Rows that a bucket of a digest tree holds on average, and how many bits of a bucket's number a level of it takes.
BUCKET_ROWS, LEVEL_BITS = 1000, 4
HASH_BITS = 60


def in_order(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """`df` with each row's place in this order, from 0. Ranges are cut at quantiles of a sample, so a key far from all others is no matter; each is
    sorted apart, and the sizes of earlier ranges, a row a range, are added."""
    part, row = f"_part_{name}", f"_row_{name}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = checkpointed(numbered)
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, before.alias("_before"))
    return placed.join(offsets, part).select(*df.columns, (F.col("_before") + F.col(row)).alias(name))


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """How many bits number the buckets of a table of so many rows."""
    return min(HASH_BITS - LEVEL_BITS, max(0, math.ceil(math.log2(max(1, rows) / bucket_rows))))


def _bucket(key: Column, bits: int) -> Column:
    whole = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.shiftright(whole, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def hashed_rows(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(key, row_digest, bucket): the digest of a row's columns by name, nulls included."""
    said = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.col(key), F.sha2(said, 256).alias("row_digest"), _bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), bits).alias("bucket"))


def digest_tree(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(level, bucket, digest, n): a digest of each bucket of keys, level 0, and of the buckets that agree but in their last LEVEL_BITS bits, up to one.
    The depth follows the bits, and so the rows: a bucket stays as small at any size."""
    joined = lambda c: F.sha2(F.array_join(c, ","), 256).alias("digest")
    level = hashed_rows(df, key, bits).groupBy("bucket").agg(joined(F.array_sort(F.collect_list("row_digest"))), F.count("*").alias("n"))
    tree = level.select(F.lit(0).alias("level"), "bucket", "digest", "n")
    for up in range(1, math.ceil(bits / LEVEL_BITS) + 1):
        entry = F.struct("bucket", "digest")
        level = level.groupBy(F.shiftright("bucket", LEVEL_BITS).alias("parent")).agg(
            joined(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["digest"]))), F.sum("n").alias("n")
        ).withColumnRenamed("parent", "bucket")
        tree = tree.unionByName(level.select(F.lit(up).alias("level"), "bucket", "digest", "n"))
    return tree


def changed_buckets(old: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """(bucket): the buckets in which two trees of the same bits differ, found from the root down: of a level only those are compared that stand below
    a difference."""
    below = None
    for level in range(math.ceil(bits / LEVEL_BITS), -1, -1):
        side = lambda tree, name: tree.where(F.col("level") == level).select("bucket", F.col("digest").alias(name))  # noqa: B023, E731
        both = side(old, "a").join(side(new, "b"), "bucket", "full_outer")
        if below is not None:
            both = both.join(below, F.shiftright("bucket", LEVEL_BITS) == F.col("parent"), "left_semi")
        differ = both.where(~F.col("a").eqNullSafe(F.col("b")))
        below = differ.select(F.col("bucket").alias("parent"))
    return below.select(F.col("parent").alias("bucket"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, change): keys that are `new`, `gone` or `changed` between two tables of the same columns and unique keys. Rows are only compared in buckets whose
    digests differ."""
    bits = bucket_bits(max(old.count(), new.count()), bucket_rows)
    found = changed_buckets(digest_tree(old, key, bits), digest_tree(new, key, bits), bits)
    rows = lambda df, name: hashed_rows(df, key, bits).join(found, "bucket", "left_semi").select(key, F.col("row_digest").alias(name))
    met = rows(old, "a").join(rows(new, "b"), key, "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return met.select(key, change.alias("change")).where("change is not null")
