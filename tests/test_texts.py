"""Texts inside others against all pairs, and a page of very many of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators.texts import containments, first_related
from loomline.plans.records import literal_reference


def test_first_related_is_that_of_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 9, 14])))
    asked = sorted({(p, w) for p in (1, 2) for w in (word() for _ in range(80)) if w})
    known = sorted({(p, w) for p in (1, 3) for w in (word() for _ in range(60))})
    known = [(p, w, i) for i, (p, w) in enumerate(r.sample(known, len(known)))]
    for rows in (known, [k for k in known if k[1]]):
        want = {}
        for p, a in asked:
            at = [i for q, k, i in rows if p == q and (a in k or k in a)]
            if at:
                want[p, a] = min(at)
        got = first_related(spark.createDataFrame(asked, "page long, text string"), spark.createDataFrame(rows, "page long, text string, at long")).collect()
        assert {(x.page, x.text): x["at"] for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("gram", [2, 4])
def test_containments_of_all_pairs(spark, gram):
    r = random.Random(gram)
    short = sorted({"".join(r.choice("ab") for _ in range(r.randrange(gram, 8))) for _ in range(40)})
    long = sorted({"".join(r.choice("ab") for _ in range(r.randrange(0, 20))) for _ in range(60)})
    df = lambda xs: spark.createDataFrame([(1, x) for x in xs], "page long, text string")
    got = sorted((x.short, x.long) for x in containments(df(short), df(long), gram).collect())
    assert got == sorted((s, t) for s in short for t in long if s in t)


def test_a_page_of_very_many_texts(spark):
    """100,000 texts asked and 100,000 known on one page: 1e10 pairs, of which each text has one or none."""
    n = spark.range(100_000).withColumnRenamed("id", "i")
    named = F.lpad(F.conv(F.hex(F.col("i") * 7919 + 1_000_003), 16, 36), 6, "0")
    known = n.select(F.col("i").alias("place"), F.lit(1).alias("page"), F.concat(F.lit("see sheet "), named).alias("raw"))
    asked = n.select("i", F.lit(1).alias("page"), F.when(F.col("i") % 2 == 0, F.concat(F.lit("please see sheet "), named, F.lit(" below"))).otherwise(F.concat(F.lit("not "), F.reverse(named))).alias("raw"))
    began = time.time()
    got = literal_reference(asked, known).agg(F.count("*").alias("n"), F.count("at").alias("found"), F.sum((F.col("at") != F.col("i")).cast("int")).alias("wrong")).first()
    assert (got.n, got.found, got.wrong) == (100_000, 50_000, 0) and time.time() - began < 120


def test_blank_and_repeated_references(spark):
    asked = spark.createDataFrame([(1, 1, "ab"), (2, 1, "ab"), (3, 1, ""), (4, 1, None), (5, 2, "zzzzz"), (6, None, "ab")], "i long, page long, raw string")
    known = spark.createDataFrame([(9, 1, "xxabxx"), (7, 1, None), (8, 1, "ab"), (1, 2, "y")], "place long, page long, raw string")
    got = {r.i: r["at"] for r in literal_reference(asked, known).collect()}
    assert got == {1: 7, 2: 7, 3: None, 4: None, 5: None, 6: None}
