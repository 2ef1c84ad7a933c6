"""Matching the rows of a new scan with those of an old one, and positions that contradict each other.

A row has id, page, no, and for start and end *_terminal, *_code and *_point (x, y, page). New rows have `nid`, which is unique among them, and an
id only where they kept one; ids of old rows are unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.shared import checkpointed

#: Points nearer than this are one place.
NEAR = 0.025
#: The least score of a match, the points of a kept id, and those of a number that no other row of its side has.
LEAST, KEPT, SINGULAR = 4, 10000, 4
#: A page with more rows than this on either side is met by keys; the result is the same for any.
CROWD = 64
#: Pages and numbers up to so many are broadcast.
FEW = 100_000
#: What rows may have in common beside their page: number, start and end, alone and together.
PARTS = [("n", "s", "e"), ("n", "s"), ("n", "e"), ("s", "e"), ("n",), ("s",), ("e",)]
KEY = ["level", "page", "k_id", "k_no", "k_start", "k_end"]


def _given(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    """Columns as text with '' as null; `*_on`: the end lies on its row's page; `*_at`: its point if it can be near another."""
    ends = []
    for e in ("start", "end"):
        ends += [_given(f"{e}_terminal").alias(e), _given(f"{e}_code").alias(f"{e}_code"), F.coalesce(F.col(f"{e}_point.page") == F.col("page"), F.lit(False)).alias(f"{e}_on")]
    return df.select(*keep, _given("id").alias("own_id"), "page", _given("no").alias("no"), *ends, *[F.col(f"{e}_point").alias(f"{e}_point") for e in ("start", "end")])


def _keyed(df: DataFrame, keep: list, made: list[Column]) -> DataFrame:
    rows = df.select(*keep, F.explode(F.array_distinct(F.array_compact(F.array(*made)))).alias("key")).select(*keep, "key.*")
    return rows.withColumn("h", F.xxhash64(*KEY))


def _key(level: str, id_: Column | None, no: Column | None, start: Column | None, end: Column | None, when: Column | None = None) -> Column:
    """A key of a level, null where a part that it asks for isn't given."""
    asked = [c for c in (id_, no, start, end) if c is not None]
    there = F.lit(True) if when is None else when
    for c in asked:
        there = there & c.isNotNull()
    none = F.lit(None).cast("string")
    parts = {"k_id": id_, "k_no": no, "k_start": start, "k_end": end}
    return F.when(there, F.struct(F.lit(level).alias("level"), "page", *[(none if c is None else c).alias(k) for k, c in parts.items()]))


def _groups(new: DataFrame) -> DataFrame:
    """New rows by key, a row per key that each can be met by: `g` names the rows that have all in common that the key's score asks for."""
    col = F.col
    made = [_key("id", col("own_id"), None, None, None), _key("idn", col("own_id"), col("no"), None, None)]
    for parts in PARTS:
        alone = {("s",): col("start_on"), ("e",): col("end_on")}.get(parts)  # an end alone is worth enough on its page only
        made.append(_key("".join(parts), None, col("no") if "n" in parts else None, col("start") if "s" in parts else None, col("end") if "e" in parts else None, alone))
    traits = ["start_on", "start_code", "end_on", "end_code"]
    rows = _keyed(new, ["nid", *traits], made)
    asks = lambda c, k: F.when(F.col(k).isNotNull(), F.col(c)).alias(c)
    rows = rows.select("nid", *KEY, "h", asks("start_on", "k_start"), asks("start_code", "k_start"), asks("end_on", "k_end"), asks("end_code", "k_end"))
    return rows.withColumn("g", F.xxhash64("h", *traits))


def _probes(old: DataFrame) -> DataFrame:
    """Old rows by each key that could give them points: an end of theirs in its own role, or in the other one if it lies on the page."""
    col = F.col
    starts = [col("start"), F.when(col("end_on"), col("end"))]
    ends = [col("end"), F.when(col("start_on"), col("start"))]
    here_s, here_e = [F.when(col("start_on"), col("start")), starts[1]], [F.when(col("end_on"), col("end")), ends[1]]
    made = [_key("id", col("own_id"), None, None, None), _key("idn", col("own_id"), F.when(col("once"), col("no")), None, None)]
    for parts in PARTS:
        for s in (here_s if parts == ("s",) else starts) if "s" in parts else [None]:
            for e in (here_e if parts == ("e",) else ends) if "e" in parts else [None]:
                made.append(_key("".join(parts), None, col("no") if "n" in parts else None, s, e))
    return _keyed(old, ["id", "once", *[f"{e}{x}" for e in ("start", "end") for x in ("", "_on", "_code")]], made)


def _hit_score() -> Column:
    """The points that a probe's parts are worth, with `n_` before the columns of the new rows."""
    col, zero = F.col, F.lit(0)
    points = F.when(col("k_no").isNotNull(), F.when(col("once"), 4 + SINGULAR).otherwise(4)).otherwise(zero)
    anchors = []
    for mine, own in (("start", "k_start"), ("end", "k_end")):
        points = points + F.when(col(mine) == col(own), 2).otherwise(zero)
        for theirs, key in (("start", "k_start"), ("end", "k_end")):
            x, y = col(f"{mine}_code"), col(f"n_{theirs}_code")
            met = (col(mine) == col(key)) & col(f"{mine}_on") & col(f"n_{theirs}_on") & (x.isNull() | y.isNull() | (x == y))
            anchors.append(F.when(met, F.when(x == y, 80).otherwise(64)).otherwise(zero))
    kept = F.when(col("level") == "id", KEPT).when(col("level") == "idn", KEPT + SINGULAR)
    return F.coalesce(kept, points + F.greatest(*anchors))


def near_pairs(old: DataFrame, new: DataFrame, near: float = NEAR) -> DataFrame:
    """(id, nid) of rows of a page of which some points lie nearer than `near`. Points meet in cells twice as wide; an old one is in each cell that
    the square around it touches, two or three as a rule."""
    cell = 2 * near

    def at(df: DataFrame, key: str) -> DataFrame:
        points = df.select(key, "page", F.explode(F.array_compact(F.array("start_point", "end_point"))).alias("p"))
        return points.select(key, "page", F.col("p.page").alias("p_page"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).where("p_page is not null and x is not null and y is not null")

    touched = lambda c: F.sequence(F.floor((F.col(c) - near) / cell), F.floor((F.col(c) + near) / cell))
    spread = at(old, "id").withColumn("cx", F.explode(touched("x"))).withColumn("cy", F.explode(touched("y"))).withColumnsRenamed({"x": "ox", "y": "oy"})
    there = at(new, "nid").withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    met = spread.join(there, ["page", "p_page", "cx", "cy"]).where(F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) < near)
    return met.select("id", "nid").distinct()


def _full_score(of_old: dict[str, Column], of_new: dict[str, Column], once: Column) -> Column:
    """`rules.rescan_score`, and the points of a number that no other row has."""
    singular = F.when(once & (of_old["no"] == of_new["no"]), SINGULAR).otherwise(0)
    return (rules.rescan_score(of_old, of_new) + singular).cast("long")


#: The fields that the score asks for, by their names in `_flat`.
FIELDS = {"id": "own_id", "page": "page", "no": "no"} | {f"{e}_{c}": f"{e}_{c}" for e in ("start", "end") for c in ("code", "point")} | {f"{e}_terminal": e for e in ("start", "end")}


def rescan_matches(old: DataFrame, new: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(id, nid, score): each old row with the one new row of its page that scores highest by `rules.rescan_score`, and 4 more where both have a
    number that is the only one on either side; 4 at least. An old row with several best ones matches none of them, and they match nothing; nor does
    a new row that is the best of several.

    A row meets all rows of its page where these are `crowd` at most on either side: both sides are dealt by page, once, and the rest is done where
    they are. Pages with more rows are met by keys, so that no pair of their rows is made but of those whose points are near.
    """
    o, n = _flat(old, "id"), _flat(new, "nid")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in ("no", "page")])).alias("k")
    seen = lambda df, mine, theirs: df.select(kinds, F.lit(mine).alias("o"), F.lit(theirs).alias("n")).select("k.*", "o", "n")
    counts = seen(o, 1, 0).union(seen(n, 0, 1)).groupBy("kind", "key").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    alone = (F.col("kind") == "no") & F.col("key").isNotNull() & (F.col("o") == 1) & (F.col("n") == 1)
    full = (F.col("kind") == "page") & (F.least("o", "n") > 0) & (F.col("key").isNull() | (F.greatest("o", "n") > crowd))
    marks = checkpointed(counts.where(alone | full).select("kind", "key"))
    found = {r.kind: r["count"] for r in marks.groupBy("kind").count().collect()}
    of = lambda kind, name: (lambda df: F.broadcast(df) if found.get(kind, 0) <= FEW else df)(marks.where(F.col("kind") == kind).select(F.col("key").alias(name)))
    if "no" in found:
        o = o.join(of("no", "once_no"), F.col("no") == F.col("once_no"), "left").withColumn("once", F.col("once_no").isNotNull()).drop("once_no")
    else:
        o = o.withColumn("once", F.lit(False))
    if "page" not in found:
        return _met_in_pages(o, n)
    crowded = of("page", "crowded")
    part = lambda df, how: df.join(crowded, F.col("page").cast("string").eqNullSafe(F.col("crowded")), how)
    return _met_in_pages(part(o, "left_anti"), part(n, "left_anti")).unionByName(_met_by_keys(part(o, "left_semi"), part(n, "left_semi")))


def _traits(df: DataFrame, before: str, *keep: str) -> DataFrame:
    """What a pair's score asks of a row of `_flat`: ends on their page as `*_pin`, points as numbers."""
    col, own = F.col, ["own_id", "page", "no", "start", "end", "start_code", "end_code"]
    pins = [F.when(col(f"{e}_on"), col(e)).alias(f"{before}{e}_pin") for e in ("start", "end")]
    points = [col(f"{e}_point.{c}").alias(f"{before}{e}_{c if c != 'page' else 'at'}") for e in ("start", "end") for c in ("page", "x", "y")]
    return df.select(*keep, *[col(c).alias(before + c) for c in own], *pins, *points)


def _pair_score() -> Column:
    """`_full_score` of `_traits` of an old row and a new one (`n_`). It is compiled with the join, and a method that is too long isn't, so it asks
    for little: what a row alone decides is decided before."""
    col, ends = F.col, ("start", "end")
    score = F.when(col("no") == col("n_no"), F.when(col("once"), 4 + SINGULAR).otherwise(4)).otherwise(0)
    anchors, near = [], F.lit(False)
    for a in ends:
        score = score + F.when(col(a) == col(f"n_{a}"), 2).otherwise(0)
        for b in ends:
            devices = F.coalesce(F.when(col(f"{a}_code") == col(f"n_{b}_code"), 80).otherwise(F.when(col(f"{a}_code").isNull() | col(f"n_{b}_code").isNull(), 64)), F.lit(0))
            anchors.append(F.when(col(f"{a}_pin") == col(f"n_{b}_pin"), devices).otherwise(0))
            x, y = col(f"{a}_x") - col(f"n_{b}_x"), col(f"{a}_y") - col(f"n_{b}_y")
            near = near | F.coalesce((col(f"{a}_at") == col(f"n_{b}_at")) & (F.abs(x) < NEAR) & (F.hypot(x, y) < NEAR), F.lit(False))
    kept = F.when(col("once") & (col("no") == col("n_no")), KEPT + SINGULAR).otherwise(KEPT)
    score = score + F.greatest(*anchors) + F.when(near, 5).otherwise(0)
    return F.when(col("own_id") == col("n_own_id"), kept).otherwise(score).cast("long")


def _met_in_pages(o: DataFrame, n: DataFrame) -> DataFrame:
    """Matches of rows that meet all of their page."""
    met = _traits(o, "", "id", "once").join(_traits(n, "n_", "nid"), F.col("page") == F.col("n_page"))
    met = met.select("page", "id", "nid", _pair_score().alias("score")).where(F.col("score") >= LEAST)
    of_id, of_nid = Window.partitionBy("page", "id"), Window.partitionBy("page", "nid")
    tops = met.withColumn("most", F.max("score").over(of_id)).where("score = most").withColumn("tied", F.count("*").over(of_id))
    return tops.withColumn("chosen", F.count("*").over(of_nid)).where("tied = 1 and chosen = 1").select("id", "nid", "score")


def _met_by_keys(o: DataFrame, n: DataFrame) -> DataFrame:
    """Matches without pairs of rows but of those whose points are near. New rows are grouped by each set of parts that they can have in common with
    an old one; the score of the parts that a group shares is the least that its rows score, and the highest of these is reached by the
    parts that count. A group tells its first and last row, so the best of an old row is one row if its best groups' first and last are one. Near rows
    score 5 more; they are scored in full and compared with that."""
    o, n = checkpointed(o), checkpointed(n)  # both sides, and the best of each row, are read several times: computed once
    groups = _groups(n)
    traits = ["start_on", "start_code", "end_on", "end_code"]
    met = groups.groupBy("g", "h", *KEY, *traits).agg(F.min("nid").alias("first"), F.max("nid").alias("last"))
    met = met.select("g", "first", "last", F.col("h").alias("n_h"), *[F.col(c).alias(f"n_{c}") for c in [*KEY, *traits]])
    same = F.col("h") == F.col("n_h")
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    hits = _probes(o).join(met, same).select("id", _hit_score().cast("long").alias("score"), "first", "last", "g", "page")

    side = lambda df, key: df.select(key, F.struct(*[c for c in df.columns if c not in ("id", "nid")]).alias(f"{key}_row"))
    closer = near_pairs(o, n).join(side(o, "id"), "id").join(side(n, "nid"), "nid")
    of = lambda key: {k: F.col(f"{key}_row.{c}") for k, c in FIELDS.items()}
    close = closer.select("id", _full_score(of("id"), of("nid"), F.col("id_row.once")).alias("score"), F.col("nid").alias("first"), F.col("nid").alias("last"), F.lit(None).cast("long").alias("g"), F.col("id_row.page").alias("page"))

    of_id = Window.partitionBy("id")
    best = hits.where(F.col("score") >= LEAST).unionByName(close).withColumn("most", F.max("score").over(of_id)).where("score = most")
    best = checkpointed(best.withColumn("low", F.min("first").over(of_id)).withColumn("high", F.max("last").over(of_id)))
    single = best.where("low = high").select("id", F.col("low").alias("nid"), "score").distinct()
    tied = best.where("low < high")
    shared = groups.join(tied.where("g is not null").select("g", "page").distinct(), ["g", "page"], "left_semi").select("nid")
    uncertain = shared.union(tied.where("g is null").select("first")).union(single.groupBy("nid").count().where("count > 1").select("nid"))
    return single.join(uncertain, "nid", "left_anti").select("id", "nid", "score")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points: what is inside can't be one of the two farthest apart."""
    order = np.lexsort((y, x))
    out: list[int] = []
    for turn in (order, order[::-1]):
        base = len(out)
        for i in turn.tolist():
            while len(out) >= base + 2 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) <= (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]):
                out.pop()
            out.append(i)
        if len(out) > 1:
            out.pop()
    return np.unique(out)


def widest(x: np.ndarray, y: np.ndarray, rows: int = 512) -> float:
    """The largest distance of two corners, some rows at a time."""
    return max((float(np.hypot(x[i : i + rows, None] - x, y[i : i + rows, None] - y).max()) for i in range(0, len(x), rows)), default=0.0)


def far_groups(points: DataFrame, group: list[str], far: float = NEAR, chunk: int = 10_000) -> DataFrame:
    """The groups of `points` (group, x, y) in which two points lie farther apart than `far`.

    Widths along the axes decide most groups. The rest are within a square of `far`: the convex hulls of parts of about `chunk` points are
    taken first, and the hull of those hulls' corners per group, so that no task holds a group but its corners.
    """
    sizes = points.groupBy(*group).agg(*[f(c).alias(f"_{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("_n"))
    wide = {c: F.col(f"_high_{c}") - F.col(f"_low_{c}") for c in ("x", "y")}
    sure = (wide["x"] > far) | (wide["y"] > far)
    open_ = sizes.where(~sure & (F.hypot(wide["x"], wide["y"]) > far)).select(*group, "_n")
    named = {c: f"g{i}" for i, c in enumerate(group)}
    same = F.lit(True)
    for c, k in named.items():
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    left = points.select(*group, "x", "y").distinct().join(open_.select(*[F.col(c).alias(f"_{k}") for c, k in named.items()], "_n"), same)
    left = left.select(*group, "x", "y", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / chunk)).alias("part"))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "x", "y"])

    def corners(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[hull(part["x"].to_numpy(), part["y"].to_numpy())][[*group, "x", "y"]]

    def decided(part: pd.DataFrame) -> pd.DataFrame:
        at = part.iloc[hull(part["x"].to_numpy(), part["y"].to_numpy())]
        return part[group].iloc[: int(widest(at["x"].to_numpy(), at["y"].to_numpy()) > far)]

    parts = left.groupBy(*group, "part").applyInPandas(corners, schema)
    found = parts.groupBy(*group).applyInPandas(decided, ", ".join(f"`{c}` {kinds[c]}" for c in group))
    return sizes.where(sure).select(*group).unionByName(found)


def review_positions(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with `end_point` cleared, `needs_review` set and a `reason` where their end, a pin of a board other than PE, N and *, was found at
    places farther apart than NEAR: the same device, terminal and page of the point. Other rows are as they were, their reason null."""
    pin = F.upper(F.substring_index("end_terminal", ":", -1))
    counts = F.coalesce(F.col("end_terminal").contains(":") & ~pin.isin("PE", "N", "*") & F.col("end_point").isNotNull(), F.lit(False))
    group = ["end_code", "end_terminal", "p_page"]
    at = rows.where(counts).select("end_code", "end_terminal", F.col("end_point.page").alias("p_page"), F.col("end_point.x").alias("x"), F.col("end_point.y").alias("y"))
    far = far_groups(at, group).select(F.col("end_code").alias("f_code"), F.col("end_terminal").alias("f_terminal"), F.col("p_page").alias("f_page"))
    same = counts & F.col("end_code").eqNullSafe(F.col("f_code")) & (F.col("end_terminal") == F.col("f_terminal")) & F.col("end_point.page").eqNullSafe(F.col("f_page"))
    met = rows.join(far, same, "left")
    clash = F.col("f_terminal").isNotNull()
    return met.withColumn("reason", F.when(clash, "rescan_endpoint_position_conflict")).withColumn("end_point", F.when(~clash, F.col("end_point"))).withColumn(
        "needs_review", F.coalesce(F.col("needs_review"), F.lit(False)) | clash
    ).drop("f_code", "f_terminal", "f_page")
