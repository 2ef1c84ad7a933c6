"""Units as JSON, a folder each."""

import datetime
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.sources.units import LISTING_TASKS, read_units, runs, write_units


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_a_unit_is_one_file_and_many_are_listed_in_few_tasks(spark, tmp_path):
    """Both would have failed before: Hadoop made two files a unit and a process for each, and its listing had a task a folder."""
    df = spark.range(3000).select((F.col("id") % 150).alias("unit_id"), F.col("id").alias("n"))
    folder = str(tmp_path / "u")
    context = spark.sparkContext
    write_units(df, folder)
    assert len(files(folder)) == 151 and {f.split("/")[0] for f in files(folder)} == {f"unit_id={i}" for i in range(150)} | {"_SUCCESS"}
    context.setJobGroup("listing units", "")
    try:
        got = read_units(spark, folder, df.schema)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup("listing units") for s in told.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= LISTING_TASKS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_names_and_lines_are_those_of_spark(spark, tmp_path):
    units = [None, "", "a", "A", " b ", "a/b", "..", "é终", "a" * 60, "%41+b c", "=", "a=b", *[f"x{chr(i)}y" for i in range(1, 128)]]
    said = [None, "", 'q"\\\n\r\t', "终 😀"]
    rows = [(u, said[i % 4], {"k": i} if i % 3 else None, [1.5, None], datetime.datetime(2020, 1, 2, 3, 4, 5, i * 1000), i) for i, u in enumerate(units * 2)]
    df = spark.createDataFrame(rows, "`u=.n` string, `a.b` string, m map<string, int>, `x``y` array<double>, t timestamp, i int")
    write_units(df, str(tmp_path / "ours"), "u=.n")
    df.repartition("`u=.n`").write.partitionBy("u=.n").json(str(tmp_path / "theirs"))

    def held(folder):
        out = {}
        for f in files(folder):
            if f.endswith(".json"):
                with open(f"{folder}/{f}", encoding="utf-8", newline="\n") as x:
                    out.setdefault(os.path.dirname(f), []).extend(x.read().split("\n"))
        return {k: sorted(filter(None, v)) for k, v in out.items()}

    assert held(tmp_path / "ours") == held(tmp_path / "theirs")
    want = sorted(map(repr, df.withColumn("u=.n", F.nullif(F.col("`u=.n`"), F.lit(""))).collect()))
    assert sorted(map(repr, read_units(spark, str(tmp_path / "ours"), df.schema, "u=.n").collect())) == want


def test_reading_takes_no_unit_against_all(spark, tmp_path):
    """Spark's inference of partitions grows with the square of their number: at 360,000 units it took most of 256 s."""
    df = spark.range(40).select((F.col("id") % 9 - 4).alias("unit_id"), "id")
    write_units(df, str(tmp_path / "u"))
    got = read_units(spark, str(tmp_path / "u"), df.schema)
    scans = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and not any("unit_id#" in line for line in scans) and got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_units_beside_others_empty_tables_and_failures(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "unit_id int, t string")
    write_units(df, f"file://{tmp_path}/a")
    with pytest.raises(FileExistsError):
        write_units(df, str(tmp_path / "a"))
    assert sorted(map(tuple, read_units(spark, str(tmp_path / "a"), df.schema).collect())) == [(1, "x"), (2, None)]
    write_units(df.where("unit_id > 5"), str(tmp_path / "b"))
    write_units(df.where("t = rpad('x', 5, 'x')").repartition(3), str(tmp_path / "c"))
    assert read_units(spark, str(tmp_path / "b"), df.schema).count() == read_units(spark, str(tmp_path / "c"), df.schema).count() == 0
    assert files(tmp_path / "b") == files(tmp_path / "c") == ["_SUCCESS"]
    with pytest.raises(Exception, match="no such unit"):
        write_units(df.withColumn("t", F.when(F.col("unit_id") == 2, F.raise_error(F.lit("no such unit"))).otherwise(F.col("t"))), str(tmp_path / "d"))
    assert files(tmp_path / "d") == []
    many = spark.range(25_000).select(F.lit("one").alias("unit_id"), "id")  # more than one batch
    write_units(many, str(tmp_path / "e"))
    assert len(files(tmp_path / "e")) == 2 and read_units(spark, str(tmp_path / "e"), many.schema).distinct().count() == 25_000


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_runs_of_slices(kind):
    units, lines = pa.array(["z", "a", "a", None, None, "b"]), pa.array(["0\n", "1\n", "22\n", "3\n", "", "é\n"], kind)
    got = [(u, x.to_pybytes().decode()) for u, x in runs(units.slice(1), lines.slice(1))]
    assert got == [("a", "1\n22\n"), (None, "3\n"), ("b", "é\n")]
    assert list(runs(units[:0], lines[:0])) == []
