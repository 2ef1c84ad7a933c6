"""Reading tables and page texts, and writing exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .units import write_units  # noqa: F401

LONGEST_CELL = 32767
ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def scan(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table's rows; filter and columns reach the Parquet scan."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def page_texts(spark: SparkSession, path: str, separator: str = "\f") -> DataFrame:
    """(path, page, text) of text files, a page between form feeds, numbered from 1, trimmed."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", separator).alias("p"))
    return files.select("path", F.posexplode("p").alias("i", "t")).select("path", (F.col("i") + 1).alias("page"), F.trim("t").alias("text"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema: other fields are dropped; lines that are no JSON come as a row whose `_bad` is the line."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def export_cells(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, in order, as text."""
    return df.select(*[F.col(c).cast("string").alias(name) for name, c in columns.items()])


def illegal_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns) of rows that an export must refuse: cells too long or with characters that no sheet may hold."""
    bad = lambda c: (F.char_length(c) > LONGEST_CELL) | F.col(c).rlike(ILLEGAL)
    named = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]))
    return df.select(key, named.alias("columns")).where(F.size("columns") > 0)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, in the table's order."""
    df.write.mode("errorifexists").option("header", True).csv(path)
