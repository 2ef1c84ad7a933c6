"""The first rows of each key, with whether there are more."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from loomline.operators.windows import first_of_each


def test_first_of_each(spark):
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(3)] + [(None, i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, place int")
    got = first_of_each(df, ["k"], [F.col("place").desc()], 3)
    assert got.columns == ["k", "place", "found"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", 6, 4), ("a", 5, 4), ("a", 4, 4), ("b", 2, 3), ("b", 1, 3), ("b", 0, 3), (None, 3, 4), (None, 2, 4), (None, 1, 4)], key=str
    )
    assert first_of_each(df.where("false"), ["k"], [F.col("place").desc()], 3).count() == 0
    with pytest.raises(ValueError):
        first_of_each(df.withColumn("found", F.lit(1)), ["k"], [F.col("place").desc()], 3)


def test_the_bound_goes_below_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        first_of_each(df, ["k"], [F.col("id").asc()], 5).explain()
    assert "WindowGroupLimit" in out.getvalue() and "Partial" in out.getvalue()
