"""Keys that the smallest tables don't reach."""

from pyspark.sql import functions as F

from loomline import catalog
from loomline.functions import dialects as dl


def test_title_blocks_of_many_sheets(spark, tmp_path):
    spark.createDataFrame([(9999, 1), (10000, 2), (59999, 3), (2147483647, 4)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["s13_title_blocks"](spark, str(tmp_path))
    assert sorted((r.s_suppkey, r.function, r.sheet) for r in got.collect()) == [
        (9999, "AB99", 9999), (10000, "AB00", 10000), (59999, "AB99", 59999), (2147483647, "AB47", 2147483647)
    ]
    # the dialect's own drawings keep their four digits
    assert spark.range(1).select(dl.title_block(F.lit("Sheet 12345"))["sheet"]).first()[0] is None
