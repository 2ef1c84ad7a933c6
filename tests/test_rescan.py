"""Matching by the full score and contradicting positions, against plain versions that look at all pairs."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomline.operators.rescan import far_groups, hull, rescan_matches, review_positions, widest

POINT = "struct<x:double,y:double,page:long>"
SIDE = f"no string, start_terminal string, end_terminal string, start_code string, end_code string, start_point {POINT}, end_point {POINT}"
OLD, NEW = f"id string, page long, {SIDE}", f"nid long, id string, page long, {SIDE}"


def near(a, b):
    return bool(a and b and a[2] == b[2] and math.hypot(a[0] - b[0], a[1] - b[1]) < 0.025)


def score(o, n):
    if o["page"] != n["page"]:
        return 0
    if o["id"] and o["id"] == n["id"]:
        return 10000
    points = 4 * bool(o["no"] and o["no"] == n["no"])
    points += sum(2 for e in ("start", "end") if o[f"{e}_terminal"] and o[f"{e}_terminal"] == n[f"{e}_terminal"])
    pins = lambda r: [(r[f"{e}_terminal"], r[f"{e}_code"]) for e in ("start", "end") if r[f"{e}_terminal"] and r[f"{e}_point"] and r[f"{e}_point"][2] == r["page"]]
    points += max((64 + 16 * bool(d and d == e) for t, d in pins(o) for u, e in pins(n) if t == u and not (d and e and d != e)), default=0)
    return points + 5 * any(near(o[f"{a}_point"], n[f"{b}_point"]) for a in ("start", "end") for b in ("start", "end"))


def brute(old, new):
    have, got = Counter(o["no"] for o in old), Counter(n["no"] for n in new)
    choices, uncertain = {}, set()
    for o in old:
        own = [(score(o, n) + 4 * bool(o["no"] and have[o["no"]] == got[o["no"]] == 1 and o["page"] == n["page"] and o["no"] == n["no"]), n["nid"]) for n in new]
        best = max(own, default=(0, 0))[0]
        tops = [i for s, i in own if s == best]
        if best >= 4:
            if len(tops) > 1:
                uncertain.update(tops)
            else:
                choices[o["id"]] = (tops[0], best)
    uncertain |= {i for i, k in Counter(i for i, _ in choices.values()).items() if k > 1}
    return sorted((k, i, s) for k, (i, s) in choices.items() if i not in uncertain)


def side(r, wide):
    pick = lambda *xs: r.choice(xs)
    point = lambda: pick(None, (r.randrange(wide) / 100, r.randrange(3) / 100, r.randrange(2)), (r.randrange(wide) / 100, 0.5, r.randrange(2)))
    return [pick(None, "", "1", "2", "3", str(r.randrange(40))), pick(None, "", "X:1", "X:2", "Y:1", f"X:{r.randrange(30)}"), pick(None, "X:1", "X:2", "Y:1", f"X:{r.randrange(30)}"), pick(None, "", "K1", "K2"), pick(None, "K1", "K2"), point(), point()]


def test_matches_are_those_of_all_pairs(spark):
    r, seen = random.Random(7), Counter()
    for n, wide in ((12, 8), (30, 30), (60, 100), (140, 100)):
        old = [(f"o{i}", r.randrange(2), *side(r, wide)) for i in range(n)]
        new = [(i * 3, r.choice([None, "", f"o{r.randrange(n)}"] + [None] * 9), r.randrange(2), *side(r, wide)) for i in range(n)]
        new += [(row[0] + 1, *row[1:]) for row in new[:3]]
        names = lambda ddl: [c.split()[0] for c in ddl.replace("struct<x:double,y:double,page:long>", "p").split(", ")]
        got = rescan_matches(spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)).collect()
        want = brute([dict(zip(names(OLD), x)) for x in old], [dict(zip(names(NEW), x)) for x in new])
        assert sorted(map(tuple, got)) == want
        seen.update(s for _, _, s in want)
    assert len(seen) > 8  # of many kinds


def test_matches_are_the_same_however_pages_are_met(spark):
    r = random.Random(5)
    old = [(f"o{i}", 0 if i % 3 else i % 9, *side(r, 30)) for i in range(90)]
    new = [(i, r.choice([None, f"o{r.randrange(90)}", None]), 0 if i % 4 else i % 6, *side(r, 30)) for i in range(90)]
    old.append(("none", None, "n", *[None] * 6))
    new.append((900, None, None, "n", *[None] * 6))
    sides = spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)
    got = [sorted(map(tuple, rescan_matches(*sides, crowd=crowd).collect())) for crowd in (0, 10, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 5


def test_rows_of_small_pages_are_dealt_once(spark):
    none = F.lit(None).cast(POINT)
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("id"), F.floor(F.col("id") / 10).alias("page"), F.lit("1").alias("no"), F.concat(F.lit("X:"), F.col("id").cast("string")).alias("start_terminal"),
        F.lit("Y").alias("end_terminal"), F.lit("K").alias("start_code"), F.lit("M").alias("end_code"), none.alias("start_point"), none.alias("end_point"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = rescan_matches(rows, rows.withColumn("nid", F.col("id").cast("long")).withColumn("id", F.lit(None).cast("string")))
        assert got.count() == 400
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], OLD), spark.createDataFrame([], NEW)
    one = spark.createDataFrame([("a", 1, "5", None, None, None, None, None, None)], OLD)
    assert rescan_matches(*none).collect() == [] and rescan_matches(one, none[1]).collect() == []
    blank = spark.createDataFrame([(1, None, 1, None, None, None, None, None, None, None)], NEW)
    assert rescan_matches(one, blank).collect() == []


def test_a_crowd_makes_no_pairs(spark):
    """60,000 old and new rows of one page, number and pin: 3.6e9 pairs, all tied; one old row has its own match by its end."""
    at = F.lit(None).cast(POINT)
    end = lambda sign: F.concat(F.lit(sign), F.col("i").cast("string"))
    on = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(1).cast("long").alias("page"))
    many = spark.range(10, 60010).withColumnRenamed("id", "i")
    both = lambda sign: [F.lit(1).cast("long").alias("page"), F.lit("5").alias("no"), F.lit("X:1").alias("start_terminal"), end(sign).alias("end_terminal"), F.lit("K").alias("start_code"), F.lit(None).cast("string").alias("end_code")]
    old = many.select(F.col("i").cast("string").alias("id"), *both("o"), F.when(F.col("i") < 0, on).alias("start_point"), at.alias("end_point"))
    new = many.select(F.col("i").alias("nid"), F.lit(None).cast("string").alias("id"), *both("n"), at.alias("start_point"), at.alias("end_point"))
    old = old.union(spark.createDataFrame([("own", 1, "6", None, "Z", None, None, None, (0.5, 0.5, 1))], OLD))
    new = new.union(spark.createDataFrame([(1, None, 1, "7", None, "Z", None, None, None, (0.9, 0.5, 1))], NEW))
    assert [tuple(r) for r in rescan_matches(old, new).collect()] == [("own", 1, 66)]


def test_hull_keeps_the_farthest():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 50, 2000):
        for x, y in ((r.random(n), r.random(n)), (np.zeros(n), r.random(n)), (np.round(r.random(n), 1), np.round(r.random(n), 1)), (np.full(n, 0.5), np.full(n, 0.5))):
            at = hull(x, y)
            assert np.isclose(widest(x[at], y[at]), widest(x, y))


def test_far_groups_are_those_of_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for g in range(40):
        size = r.choice([0.01, 0.017, 0.019, 0.02, 0.03])
        rows += [(None if g == 5 else f"g{g}", g % 2, 0.3 + r.random() * size, 0.3 + r.random() * size) for _ in range(r.choice([1, 2, 5, 60]))]
    rows += [("diagonal", 1, 0.0, 0.0), ("diagonal", 1, 0.02, 0.02)]  # neither axis is wide
    by = {}
    for g, p, x, y in rows:
        by.setdefault((g, p), []).append((x, y))
    want = {k for k, v in by.items() if any(math.hypot(a[0] - b[0], a[1] - b[1]) > 0.025 for a in v for b in v)}
    df = spark.createDataFrame(rows, "g string, p long, x double, y double")
    for chunk in (10_000, 7):
        got = [tuple(x) for x in far_groups(df, ["g", "p"], chunk=chunk).collect()]
        assert set(got) == want and len(got) == len(want)
    assert ("diagonal", 1) in want and 0 < len(want) < len(by)


def test_positions_are_cleared(spark):
    rows = [
        (1, "K", "X:1", (0.1, 0.1, 3)), (2, "K", "X:1", (0.12, 0.12, 3)),  # (0.02, 0.02) apart
        (3, "K", "X:1", (0.1, 0.1, 4)), (4, "L", "X:1", (0.9, 0.1, 3)),  # another page, another device
        (5, "K", "X:pe", (0.1, 0.1, 3)), (6, "K", "X:pe", (0.9, 0.1, 3)), (7, "K", "X:*", (0.1, 0.1, 3)), (8, "K", "X:*", (0.9, 0.1, 3)),
        (9, None, "Y:2", (0.1, 0.1, 3)), (10, None, "Y:2", (0.2, 0.1, 3)), (11, None, "Y:2", None), (12, "K", "plain", (0.1, 0.1, 3)), (13, "K", "plain", (0.9, 0.1, 3)),
    ]
    df = spark.createDataFrame([(*x, None if x[0] % 2 else False) for x in rows], f"id long, end_code string, end_terminal string, end_point {POINT}, needs_review boolean")
    got = {r.id: r for r in review_positions(df).collect()}
    assert {i for i, r in got.items() if r.reason} == {1, 2, 9, 10} == {i for i, r in got.items() if r.needs_review}
    assert all((r.end_point is None) == (i in (1, 2, 9, 10, 11)) for i, r in got.items()) and len(got) == 13
