"""Queries do the whole job: what they leave out would be seen here."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomline import catalog
from loomline.plans.projecting import leaf_paths


def test_every_order_is_in_a_receipt(spark, sf_dir, tmp_path):
    run = catalog.QUERIES["a28_a29_a37_canonical_receipts"]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    before = {r.o_orderpriority: (r.digest, r.n) for r in run(spark, sf_dir).collect()}
    assert sum(n for _, n in before.values()) == orders.count()
    one = orders.where("o_orderkey % 10 = 3").orderBy("o_orderkey").first()
    price = F.when(F.col("o_orderkey") == one.o_orderkey, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    orders.withColumn("o_totalprice", price).write.parquet(str(tmp_path / "orders.parquet"))
    after = {r.o_orderpriority: (r.digest, r.n) for r in run(spark, str(tmp_path)).collect()}
    assert [k for k in before if before[k] != after[k]] == [one.o_orderpriority]


def test_all_groups_are_flattened(spark, sf_dir):
    got = catalog.QUERIES["p23_flatten_groups"](spark, sf_dir).orderBy("place").collect()
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").orderBy("l_orderkey").collect()
    assert [(r.l_orderkey, r.place) for r in got] == [(r.l_orderkey, i) for i, r in enumerate(keys)]
    plan = catalog.QUERIES["p23_flatten_groups"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_all_rows_are_exported(spark, sf_dir):
    got = catalog.QUERIES["k1_export_columns"](spark, sf_dir)
    assert {c for _, c in got.dtypes} == {"string"}
    assert got.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_rescan_matches_all_pages(spark, sf_dir):
    got = catalog.QUERIES["j20_rescan_match"](spark, sf_dir).selectExpr("id div 10 % 5 AS r").distinct().collect()
    assert sorted(r.r for r in got) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name, table, key", [
    ("x25_file_names", "events", "event_id"), ("p12_p14_leaf_paths", "lineitem", "l_orderkey"), ("a3_ordered_json", "lineitem", "l_orderkey"),
    ("s8_unnest_object", "events", "event_id"), ("j3_lateral_unnest", "events", "event_id"), ("x29_full_matches", "part", "p_partkey"),
])
def test_no_key_is_left_out(spark, sf_dir, name, table, key):
    got = catalog.QUERIES[name](spark, sf_dir).select(key).distinct()
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct()
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_every_published_row_has_its_id(spark, sf_dir):
    got = catalog.QUERIES["x22_published_ids"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.unit}:{r.no}")) for r in got)


def test_ignored_keys_have_no_paths(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    last = lambda df: {r.k for r in df.selectExpr("substring_index(path, '.', -1) AS k").distinct().collect()}
    assert last(leaf_paths(lines, ())) == {"line", "part", "supp"}
    assert last(leaf_paths(lines)) == {"part", "supp"}
    assert last(leaf_paths(lines, ("line", "supp"))) == {"part"}
