"""Places and digests of tables whose keys are spread badly."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators.ranges import bucket_bits, changed_buckets, changed_rows, digest_tree, in_order


def test_places_with_a_key_far_away(spark):
    keys = [*range(1, 3000), 10**15, -(10**17), *[7] * 50]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(4)
    placed = in_order(df, ["k", "i"])
    got = [(r.k, r.i) for r in placed.orderBy("place").collect()]
    assert got == sorted((k, i) for i, k in enumerate(keys))
    assert sorted(r.place for r in placed.select("place").collect()) == list(range(len(keys)))
    assert in_order(df.where("k = 0"), ["k"]).count() == 0


def test_ranges_are_even(spark):
    """100,000 keys and one of 10**15: the largest range holds a few times its share."""
    df = spark.range(100_000).union(spark.range(10**15, 10**15 + 1))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r.n for r in df.repartitionByRange(16, "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(sizes) == 100_001 and max(sizes) < 3 * 100_001 / 16


@pytest.mark.parametrize("bucket_rows", [1, 7, 1000])
def test_changes_are_found(spark, bucket_rows):
    r = random.Random(bucket_rows)
    old = {i: (r.choice("abc"), r.choice([None, 1.5])) for i in range(400)}
    new = {i: v for i, v in old.items() if i % 90 != 1} | {5: ("z", None), 77: ("a", 9.0), 1000: ("n", None)}
    table = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k long, s string, x double").repartition(3)
    want = {(k, "gone") for k in old.keys() - new.keys()} | {(k, "new") for k in new.keys() - old.keys()} | {(k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    assert {tuple(x) for x in changed_rows(table(old), table(new), "k", bucket_rows).collect()} == want
    assert changed_rows(table(old), table(old), "k", bucket_rows).count() == 0
    bits = bucket_bits(len(old), bucket_rows)
    a, b = digest_tree(table(old), "k", bits), digest_tree(table(new), "k", bits)
    assert a.where("level = 0").agg(F.sum("n")).first()[0] == len(old)
    (root,) = a.orderBy(F.desc("level")).limit(1).collect()
    assert root.n == len(old) and root.bucket == 0
    found = changed_buckets(a, b, bits).count()
    assert 0 < found <= max(1, len(want))


def test_depth_follows_the_rows():
    assert [bucket_bits(n) for n in (0, 1, 1000, 1001, 64_000, 10**12)] == [0, 0, 0, 1, 6, 30]
