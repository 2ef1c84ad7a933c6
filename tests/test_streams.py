"""Streams over files, and what of a scan reaches the reader."""

from datetime import datetime, timedelta

from loomline.sources import tables
from loomline.streaming import events as ev

START = datetime(2026, 1, 1, 10)


def sent(spark, tmp_path):
    """Events of four hours in one file, each of them twice."""
    rows = [(i, START + timedelta(minutes=10 * i), "ab"[i % 2]) for i in range(24)]
    df = spark.createDataFrame([*rows, *rows], "event_id long, ts timestamp, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    return ev.event_stream(spark, str(tmp_path / "events"), df.schema)


def test_each_event_once(spark, tmp_path):
    got = ev.run_to_end(ev.unique_events(sent(spark, tmp_path)).select("event_id"), f"file://{tmp_path}/run")
    assert sorted(r.event_id for r in got.collect()) == list(range(24))


def test_closed_windows(spark, tmp_path):
    """A window is written once the watermark has passed its end: the last of the four is still open."""
    got = ev.run_to_end(ev.windowed_counts(sent(spark, tmp_path)), f"file://{tmp_path}/run")
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == [(START + timedelta(hours=h), t, 6) for h in range(3) for t in "ab"]


def test_scan_pushes_down(spark, sf_dir):
    df = tables.scan(spark, sf_dir, "orders", ["o_orderkey"], "o_orderstatus = 'F'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["o_orderkey"] and "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    assert df.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").count()
