"""Texts that contain others, found without comparing all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of this length and longer are found by one of their grams, shorter ones by windows of their own length.
GRAM = 4


def windows(text: Column, size: Column | int) -> Column:
    """The distinct substrings of a length."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def short_windows(text: Column, below: int) -> Column:
    """The distinct substrings of every length from 1 up to `below`, without it."""
    return F.concat(*[windows(text, n) for n in range(1, below)]) if below > 1 else F.array().cast("array<string>")


def containments(short: DataFrame, long: DataFrame, gram: int = GRAM) -> DataFrame:
    """(page, short, long): texts of `short` (page, text), of `gram` characters at least, inside texts of `long` (page, text).

    A short text is looked for by the one of its grams that the fewest long texts of its page have, and not at all if they have one of its
    grams nowhere; what shares that gram is compared. So the work follows the matches, not the product of a page's texts.
    """
    have = long.select("page", F.col("text").alias("long"), F.explode(windows(F.col("text"), gram)).alias("gram"))
    common = have.groupBy("page", "gram").agg(F.count("*").alias("n"))
    asked = short.where(F.char_length("text") >= gram).select("page", F.col("text").alias("short"), F.explode(windows(F.col("text"), gram)).alias("gram"))
    rarest = (
        asked.join(common, ["page", "gram"], "left")
        .groupBy("page", "short")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all"))
        .where("all")
    )
    return rarest.join(have, ["page", "gram"]).where(F.contains("long", "short")).select("page", "short", "long")


def first_related(asked: DataFrame, known: DataFrame, gram: int = GRAM) -> DataFrame:
    """(page, text, at): for each text of `asked` (page, text), none of them empty, the least `at` of the `known` ones (page, text, at) of its page that
    equal, contain or are contained in it. Both sides hold a text once a page. An empty known text is in every other."""
    a, k = asked.select("page", "text"), known.select("page", "text", "at")
    of = lambda df, text: df.select("page", F.col(text).alias("text"), "at")
    place = k.withColumnRenamed("text", "known")
    inside = containments(k, a, gram).withColumnRenamed("short", "known").join(place, ["page", "known"])
    around = containments(a, k, gram).withColumnRenamed("long", "known").join(place, ["page", "known"])
    # shorter than a gram: known ones among the windows of what is asked; asked ones among the windows of what is known, the least of each
    pieces = a.select("page", "text", F.explode(short_windows(F.col("text"), gram)).alias("known"))
    small = pieces.join(place, ["page", "known"])
    held = k.select("page", "at", F.explode(short_windows(F.col("text"), gram)).alias("text")).groupBy("page", "text").agg(F.min("at").alias("at"))
    little = a.where(F.char_length("text") < gram).join(held, ["page", "text"])
    empty = a.join(k.where("text = ''").select("page", "at"), "page")
    found = of(inside, "long").unionByName(of(around, "short")).unionByName(of(small, "text")).unionByName(of(little, "text")).unionByName(of(empty, "text"))
    return found.groupBy("page", "text").agg(F.min("at").alias("at"))
