"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the mix has as many words as the corpus. Shares go by weight, a source is clamped at `max_epochs`
times its own words, and what it can't take is shared again among the others by weight until none is above its clamp. Each
document is then taken a whole number of times, and a seeded choice of documents once more, the last of them in part, so that a
source's words meet its target to the word.

No step needs the rows of a source together: the seeded order of a source is cut into hash ranges, sums per (source, range)
are taken before the shuffle, and only rows of one range are sorted, so a source that holds a third of all rows is spread over
as many tasks as it has ranges.

Defined results: null text has no words; a null source is a source of its own, sorted last; documents without words are
taken 0 times their size; an empty table gives an empty mix; rows that repeat an id are separate documents, placed by their texts too;
rows that repeat id and text are alike, lie in one range, and any of them may be the one taken in part. Sources are
ranked and filled in one task, a narrow row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_name, pin

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 500
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of md5(seed:id:md5(text)), so that rows that repeat an id are spread; the same in any SQL engine that has md5."""
    named = F.coalesce(doc_id.cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """`sources`: (source, source_size), a row per source. Adds weight and target.

    Sorted by the level at which each source reaches its clamp, the sources clamped are a prefix: those whose share of what
    the sources before them leave is above their clamp. The frames below run over one narrow row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select(
        "source",
        "source_size",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
        ).alias("weight"),
        (F.col("source_size") * max_epochs).alias("clamp"),
    )
    by_level = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("clamp").over(before), F.lit(0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
    ).withColumn("open_level", F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.col("level")))
    first_open = F.first("open_level", ignorenulls=True).over(everything)
    return filled.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("clamp").cast("double"), F.coalesce(first_open, F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    carry: list[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(1, 2, 3),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """A row per document: (doc_id, source, size, source_size, target, repeats, extra, taken) and, as a struct `kept_row`,
    the columns named in `carry`. `repeats` whole copies and `extra` words of one more are taken."""
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        seeded_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("u"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("kept_row")] if carry else []),
    )
    narrow = pin(base.select("doc_id", "source", "size", "u"), "sized")
    base = base if carry else narrow
    rows = narrow.count()
    bits = min(24, max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_RANGE))))
    span = F.shiftright(F.col("u"), HASH_BITS - bits) if bits else F.lit(0).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))

    ranges = narrow.groupBy("source", span.alias("span")).agg(F.sum("size").alias("range_size"))
    targets = water_fill(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    plan = ranged.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(
        name.alias("p_name"), F.col("span").alias("p_span"), "range_start", "source_size", "target"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    within = Window.partitionBy("name", "span").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        base.withColumn("name", name)
        .withColumn("span", span)
        .join(plan, (F.col("name") == F.col("p_name")) & (F.col("span") == F.col("p_span")))
        .withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("repeats", whole)
        .withColumn("quota", F.round("target").cast("long") - F.col("repeats") * F.col("source_size"))
        .withColumn(
            "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("start"))).cast("long")
        )
    )
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "repeats",
        "extra",
        (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken"),
        *(["kept_row"] if carry else []),
    )


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from `mix(..., carry=...)`: a row per copy taken, `copy` counting from 1, with its `words` (`copy_` and
    `words_` beside columns so named); the text of a partial copy ends after its last word taken. Documents of which nothing is
    taken go."""
    times = F.col("repeats") + (F.col("extra") > 0).cast("long")
    pieces = F.regexp_extract_all(F.col(f"kept_row.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("extra").cast("int")), "")
    held = mixed.select("kept_row.*")
    partial = F.col("copy") > F.col("repeats")
    return (
        mixed.where((times > 0) & (F.col("size") > 0))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
        .select(
            *[
                (F.when(partial, head).otherwise(F.col(f"kept_row.`{f}`")) if f == text_col else F.col(f"kept_row.`{f}`")).alias(f)
                for f in held.columns
            ],
            F.col("copy").alias(free_name(held, "copy")),
            F.when(partial, F.col("extra")).otherwise(F.col("size")).alias(free_name(held, "words")),
        )
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix plan of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('42:' || doc_id::VARCHAR || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 3 AS clamp,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM src),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least(clamp::DOUBLE,
           (SELECT min(level) FROM (SELECT level FROM filled WHERE level * weight <= clamp ORDER BY clamp / weight, source NULLS LAST LIMIT 1)) * weight) AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS repeats,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (repeats * size + greatest(0, least(size, round(target)::BIGINT - repeats * source_size - start)))::BIGINT AS taken
FROM placed
"""
