"""Matching of two sets of rows: answers against actuals, baselines against scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import distance
from ..operators.rescan import NEAR, rescan_matches, review_positions
from ..registry import query


def reconcile(answers: DataFrame, actuals: DataFrame, scope: list[str], number: str, identity: list[str], fields: list[str], ends: list[str]) -> DataFrame:
    """(status, answer_id, actual_id, differences): a sequence of passes, each over what the one before left.

    1. Equal in all fields: the n-th of equal answers goes with the n-th of equal actuals.
    2. Equal identity, both ends filled, one row of it on either side.
    3. Equal number, one row of it on either side.
    The rest is ambiguous if the other side still has its number, else missing or extra.

    Ids are unique on their side. Both sides go through as one narrow table. Where the number is part of the identity and that of the fields, as
    a rule, every pass works inside a scope's number: rows are dealt by that once, and all windows and the pairs stay where they are.
    """
    columns = list(dict.fromkeys([*scope, number, *identity, *fields, *ends]))
    kinds = [{f.name: f.dataType for f in df.schema.fields} for df in (answers, actuals)]

    def said(c: str) -> Column:
        """A column by which rows are compared, as text with null as '' unless it is a whole number or a date on either side."""
        exact = all(isinstance(k[c], (T.IntegralType, T.DateType)) for k in kinds) and kinds[0][c] == kinds[1][c]
        return F.col(c) if exact else F.coalesce(F.col(c).cast("string"), F.lit(""))

    named = {c: f"c{i}" for i, c in enumerate(columns)}
    of_all = lambda cols: [named[c] for c in dict.fromkeys([*scope, *cols])]
    given = lambda c: F.coalesce(F.col(named[c]).cast("string"), F.lit("")) != ""
    side = lambda df, mark: df.select(F.lit(mark).alias("answer"), "id", *[said(c).alias(k) for c, k in named.items()])
    rows = side(answers, True).unionByName(side(actuals, False))
    nested = number in identity and set(identity) <= set(fields)
    if nested:
        rows = rows.repartition(*[F.col(c) for c in of_all([number])])

    answer, free = F.col("answer"), F.col("by").isNull()
    filled = F.lit(True)
    for c in ends:
        filled = filled & given(c)
    # in this order of columns a sort by all serves the windows over the first ones
    first = [c for c in columns if c in {*scope, *fields}] if nested else [*scope, *fields]
    equal = Window.partitionBy(*of_all(first))
    rows = (
        rows.withColumn("nth", F.row_number().over(Window.partitionBy(*of_all(first), "answer").orderBy("id")))
        .withColumn("both", F.least(F.count_if(answer).over(equal), F.count_if(~answer).over(equal)))
        .withColumn("by", F.when(F.col("nth") <= F.col("both"), F.lit("fields")))
    )
    # a row without both ends has no identity, a row without a number can't be met by it
    for by, cols, counts in (("identity", [c for c in columns if c in {*scope, *identity}], filled), ("number", [*scope, number], given(number))):
        group = Window.partitionBy(*of_all(cols))
        left = lambda mark: F.count_if(mark & free & counts).over(group)  # noqa: B023, E731
        rows = rows.withColumn("by", F.when(free & counts & (left(answer) == 1) & (left(~answer) == 1), F.lit(by)).otherwise(F.col("by")))
    group = Window.partitionBy(*of_all([number]))
    there = (F.count_if(answer & free).over(group) > 0) & (F.count_if(~answer & free).over(group) > 0)
    rows = rows.withColumn("there", there)

    # two rows of a pair have in common what their pass compared; a row that met none is alone by its side and id
    met = {"fields": fields, "identity": identity, "number": [number]}
    parts = [*of_all([number] if nested else [])]
    for c, k in named.items():
        if k not in parts:
            rows = rows.withColumn(f"by_{k}", F.when(F.col("by").isin([by for by, cols in met.items() if c in cols or c in scope]), F.col(k)))
            parts.append(f"by_{k}")
    rows = rows.withColumn("by_nth", F.when(F.col("by") == "fields", F.col("nth"))).withColumn("alone", F.when(free, F.struct("answer", "id")))
    of = lambda mark, c: F.max(F.when(mark, F.col(c)))
    values = F.struct(*[F.col(named[c]).alias(c) for c in fields]).alias("row")
    groups = rows.select("answer", "id", "by", "by_nth", "alone", "there", *parts, values).groupBy(*parts, "by", "by_nth", "alone").agg(
        of(answer, "id").alias("answer_id"), of(~answer, "id").alias("actual_id"), of(answer, "row").alias("x"), of(~answer, "row").alias("y"), F.max("there").alias("there")
    )
    same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    differences = F.array_join(F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in fields])), ",")
    paired = F.col("answer_id").isNotNull() & F.col("actual_id").isNotNull()
    status = (
        F.when(paired & (differences == ""), "same").when(paired, "different").when(F.col("there"), "ambiguous")
        .when(F.col("answer_id").isNotNull(), "missing").otherwise("extra")
    )
    return groups.select(status.alias("status"), "answer_id", "actual_id", F.when(paired, differences).otherwise("").alias("differences"))


def answers_and_actuals(t):
    """Lines as answers, and the same lines with some changed or gone as actuals. Lines that repeat a number of their order are one,
    as ids are unique."""
    base = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("no"), F.min("l_suppkey").alias("start"), F.min("l_quantity").cast("int").alias("end"), F.min("l_returnflag").alias("color")
    )
    base = base.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 50).alias("page"), "no", "start", "end", "color")
    i = F.col("id")
    actual = base.where(i % 11 != 0).select(
        "id", "page", F.when(i % 5 == 0, F.col("no") + 100000).otherwise(F.col("no")).alias("no"), "start",
        F.when(i % 7 == 0, F.col("end") + 1).otherwise(F.col("end")).alias("end"), F.when(i % 3 == 0, "Z").otherwise(F.col("color")).alias("color"),
    )
    return base, actual


@query(
    "j28_answer_reconcile",
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 50 AS page, min(l_partkey) AS no, min(l_suppkey) AS st, min(l_quantity)::INT AS en, min(l_returnflag) AS color FROM lineitem GROUP BY l_orderkey, l_linenumber),
    b AS (SELECT id, page, CASE WHEN id % 5 = 0 THEN no + 100000 ELSE no END AS no, st, CASE WHEN id % 7 = 0 THEN en + 1 ELSE en END AS en, CASE WHEN id % 3 = 0 THEN 'Z' ELSE color END AS color FROM a WHERE id % 11 <> 0),
    na AS (SELECT *, row_number() OVER (PARTITION BY page, no, st, en, color ORDER BY id) AS nth FROM a), nb AS (SELECT *, row_number() OVER (PARTITION BY page, no, st, en, color ORDER BY id) AS nth FROM b),
    p1 AS (SELECT na.id AS x, nb.id AS y FROM na JOIN nb USING (page, no, st, en, color, nth)),
    a1 AS (SELECT * FROM a WHERE id NOT IN (SELECT x FROM p1)), b1 AS (SELECT * FROM b WHERE id NOT IN (SELECT y FROM p1)),
    p2 AS (SELECT x, y FROM (SELECT page, no, st, en, min(id) AS x FROM a1 GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT page, no, st, en, min(id) AS y FROM b1 GROUP BY ALL HAVING count(*) = 1) USING (page, no, st, en)),
    a2 AS (SELECT * FROM a1 WHERE id NOT IN (SELECT x FROM p2)), b2 AS (SELECT * FROM b1 WHERE id NOT IN (SELECT y FROM p2)),
    p3 AS (SELECT x, y FROM (SELECT page, no, min(id) AS x FROM a2 GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT page, no, min(id) AS y FROM b2 GROUP BY ALL HAVING count(*) = 1) USING (page, no)),
    a3 AS (SELECT * FROM a2 WHERE id NOT IN (SELECT x FROM p3)), b3 AS (SELECT * FROM b2 WHERE id NOT IN (SELECT y FROM p3)),
    m AS (SELECT x, y FROM p1 UNION ALL SELECT x, y FROM p2 UNION ALL SELECT x, y FROM p3),
    d AS (SELECT x AS answer_id, y AS actual_id, concat_ws(',', CASE WHEN a.no <> b.no THEN 'no' END, CASE WHEN a.st <> b.st THEN 'start' END, CASE WHEN a.en <> b.en THEN 'end' END, CASE WHEN a.color <> b.color THEN 'color' END) AS differences
          FROM m JOIN a ON a.id = x JOIN b ON b.id = y)
    SELECT CASE WHEN differences = '' THEN 'same' ELSE 'different' END AS status, answer_id, actual_id, differences FROM d
    UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM b3 WHERE b3.page = a3.page AND b3.no = a3.no) THEN 'ambiguous' ELSE 'missing' END, id, NULL, '' FROM a3
    UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM a3 WHERE a3.page = b3.page AND a3.no = b3.no) THEN 'ambiguous' ELSE 'extra' END, NULL, id, '' FROM b3""",
)
def j28(t):
    answers, actuals = answers_and_actuals(t)
    return reconcile(answers, actuals, ["page"], "no", ["no", "start", "end"], ["no", "start", "end", "color"], ["start", "end"])


def rescan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old rows, about sixteen a page, and new ones made from them: some gone, some twice, some with other numbers, ends in the other order,
    unread devices or points that moved."""
    col, text = F.col, lambda before, c: F.concat(F.lit(before), c.cast("string"))
    base = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_extendedprice").alias("price"), F.min("l_discount").alias("d")
    )
    page = F.floor(col("l_orderkey") / 4)
    point = lambda x, page: F.struct(x.alias("x"), (col("d") * 9).alias("y"), page.alias("page"))
    x = (col("price") % 100) / 100
    old = base.select(
        (col("l_orderkey") * 10 + col("l_linenumber")).alias("id"),
        page.alias("page"),
        F.when(col("p") % 7 > 0, (col("p") % 300).cast("string")).alias("no"),
        F.when(col("p") % 13 > 0, F.concat(text("X", col("s") % 3), text(":", col("l_linenumber")))).alias("start_terminal"),
        F.when(col("s") % 6 > 0, text("Y:", col("p") % 5)).alias("end_terminal"),
        F.when(col("s") % 3 > 0, text("K", col("s") % 2)).alias("start_code"),
        F.when(col("p") % 3 > 0, text("M", col("p") % 3)).alias("end_code"),
        F.when(col("p") % 17 > 0, point(x, F.when(col("p") % 4 > 0, page).otherwise(page + 1))).alias("start_point"),
        point(1 - x, F.when(col("s") % 2 > 0, page).otherwise(page + 1)).alias("end_point"),
    )
    i = col("id")
    swaps = lambda a, b: F.when(i % 4 == 0, b).otherwise(a)
    moved = lambda c: F.when(c.isNotNull(), F.struct((c["x"] + i % 7 * 0.006).alias("x"), c["y"].alias("y"), c["page"].alias("page")))
    new = old.where(i % 9 != 0).select(
        F.when(i % 50 == 0, i).alias("id"),
        "page",
        F.when(i % 3 == 0, F.concat("no", F.lit("a"))).otherwise(col("no")).alias("no"),
        swaps(col("start_terminal"), col("end_terminal")).alias("start_terminal"),
        swaps(col("end_terminal"), col("start_terminal")).alias("end_terminal"),
        F.when(i % 5 > 0, swaps(col("start_code"), col("end_code"))).alias("start_code"),
        swaps(col("end_code"), col("start_code")).alias("end_code"),
        moved(swaps(col("start_point"), col("end_point"))).alias("start_point"),
        moved(swaps(col("end_point"), col("start_point"))).alias("end_point"),
        F.explode(F.when(i % 25 == 0, F.array(i * 2, i * 2 + 1)).otherwise(F.array(i * 2))).alias("nid"),
    )
    return old, new


_RESCAN = """b AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_extendedprice) AS price, min(l_discount) AS d FROM lineitem GROUP BY 1, 2),
    o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey // 4 AS page, CASE WHEN p % 7 > 0 THEN (p % 300)::VARCHAR END AS no,
        CASE WHEN p % 13 > 0 THEN 'X' || (s % 3) || ':' || l_linenumber END AS st, CASE WHEN s % 6 > 0 THEN 'Y:' || (p % 5) END AS en,
        CASE WHEN s % 3 > 0 THEN 'K' || (s % 2) END AS sc, CASE WHEN p % 3 > 0 THEN 'M' || (p % 3) END AS ec, d * 9 AS y,
        CASE WHEN p % 17 > 0 THEN (price % 100) / 100 END AS sx, CASE WHEN p % 17 > 0 THEN CASE WHEN p % 4 > 0 THEN l_orderkey // 4 ELSE l_orderkey // 4 + 1 END END AS sp,
        1 - (price % 100) / 100 AS ex, CASE WHEN s % 2 > 0 THEN l_orderkey // 4 ELSE l_orderkey // 4 + 1 END AS ep FROM b),
    m AS (SELECT *, id % 4 = 0 AS w, (id % 7) * 0.006::DOUBLE AS j FROM o WHERE id % 9 <> 0),
    n AS (SELECT unnest(CASE WHEN id % 25 = 0 THEN [id * 2, id * 2 + 1] ELSE [id * 2] END) AS nid, CASE WHEN id % 50 = 0 THEN id END AS kept, page, CASE WHEN id % 3 = 0 THEN no || 'a' ELSE no END AS no2,
        CASE WHEN w THEN en ELSE st END AS st2, CASE WHEN w THEN st ELSE en END AS en2, CASE WHEN id % 5 > 0 THEN CASE WHEN w THEN ec ELSE sc END END AS sc2, CASE WHEN w THEN sc ELSE ec END AS ec2, y AS y2,
        j + CASE WHEN w THEN ex ELSE sx END AS sx2, CASE WHEN w THEN ep ELSE sp END AS sp2, j + CASE WHEN w THEN sx ELSE ex END AS ex2, CASE WHEN w THEN sp ELSE ep END AS ep2 FROM m)"""

#: One pair of ends: whether they are the same pin of the page, without a contradiction between their devices.
_ANCHOR = "CASE WHEN {a} = {b} AND {ap} = page AND {bp} = page AND coalesce({ac} = {bc}, TRUE) THEN CASE WHEN {ac} = {bc} THEN 80 ELSE 64 END ELSE 0 END"
_ENDS = [(dict(a=a, ac=ac, ap=ap, ax=ax), dict(b=b, bc=bc, bp=bp, bx=bx)) for a, ac, ap, ax in (("st", "sc", "sp", "sx"), ("en", "ec", "ep", "ex")) for b, bc, bp, bx in (("st2", "sc2", "sp2", "sx2"), ("en2", "ec2", "ep2", "ex2"))]


@query(
    "j20_rescan_match",
    f"""WITH {_RESCAN},
    uo AS (SELECT no FROM o WHERE no IS NOT NULL GROUP BY 1 HAVING count(*) = 1), un AS (SELECT no2 FROM n WHERE no2 IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
    s AS (SELECT o.id, n.nid, CASE WHEN id = kept THEN 10000 ELSE CASE WHEN no = no2 THEN 4 ELSE 0 END + CASE WHEN st = st2 THEN 2 ELSE 0 END + CASE WHEN en = en2 THEN 2 ELSE 0 END
        + greatest({", ".join(_ANCHOR.format(**x, **y) for x, y in _ENDS)})
        + CASE WHEN {" OR ".join(f"coalesce({x['ap']} = {y['bp']} AND sqrt(({x['ax']} - {y['bx']}) ** 2 + (o.y - y2) ** 2) < 0.025, FALSE)" for x, y in _ENDS)} THEN 5 ELSE 0 END END
        + CASE WHEN no = no2 AND no IN (FROM uo) AND no2 IN (FROM un) THEN 4 ELSE 0 END AS score FROM o JOIN n USING (page)),
    t AS (SELECT * FROM s QUALIFY score = max(score) OVER (PARTITION BY id) AND score >= 4),
    c AS (SELECT id, count(*) AS k, min(nid) AS nid, max(score) AS score FROM t GROUP BY id),
    bad AS (SELECT nid FROM t WHERE id IN (SELECT id FROM c WHERE k > 1) UNION SELECT nid FROM c WHERE k = 1 GROUP BY nid HAVING count(*) > 1)
    SELECT id, nid, score::BIGINT AS score FROM c WHERE k = 1 AND nid NOT IN (SELECT nid FROM bad)""",
)
def j20(t):
    return rescan_matches(*rescan(t.lineitem))


_POINTS = "p AS (SELECT vec_id, label, vec_id % 40 AS page, (embedding[1] + 1)::DOUBLE / 2 AS x, (embedding[2] + 1)::DOUBLE / 2 AS y FROM embeddings)"


def points(t):
    at = lambda i: (F.col("embedding")[i] + F.lit(1).cast("float")).cast("double") / 2
    return t.embeddings.select("vec_id", "label", (F.col("vec_id") % 40).alias("page"), at(0).alias("x"), at(1).alias("y"))


@query(
    "j21_near_points",
    f"WITH {_POINTS} SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.page = b.page AND a.vec_id < b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.025",
)
def j21(t):
    """Points of one page nearer than 0.025. Pages are cut into cells of that width; a point meets the points of its own and the
    eight cells around, so work follows the number of near pairs, not a page's square."""
    p = points(t).withColumn("cx", F.floor(F.col("x") / NEAR)).withColumn("cy", F.floor(F.col("y") / NEAR))
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = p.select("vec_id", "page", "x", "y", "cx", "cy", F.inline(around)).select(
        F.col("vec_id").alias("a"), "page", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("x").alias("ax"), F.col("y").alias("ay")
    )
    met = spread.join(p.withColumnRenamed("vec_id", "b"), ["page", "cx", "cy"])
    return met.where((F.col("a") < F.col("b")) & (distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) < NEAR)).select("a", "b")


@query(
    "a19_position_conflicts",
    """WITH p AS (SELECT vec_id AS id, CASE vec_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'plain' ELSE 'X' || (label % 3) || ':' || CASE vec_id % 8 WHEN 0 THEN 'pe' WHEN 1 THEN '*' WHEN 2 THEN 'N' ELSE (vec_id % 3)::VARCHAR END END AS terminal,
        CASE WHEN vec_id % 5 > 0 THEN 'K' || (vec_id % 5) END AS code, (vec_id // 40) % 50 AS page, 0.5 + embedding[1]::DOUBLE / 8 AS x, 0.5 + embedding[2]::DOUBLE / 8 AS y, vec_id % 6 = 0 AS had FROM embeddings),
      k AS (SELECT *, coalesce(contains(terminal, ':') AND upper(list_last(string_split(terminal, ':'))) NOT IN ('PE', 'N', '*'), FALSE) AS counts FROM p),
      f AS (SELECT DISTINCT a.terminal, a.code, a.page FROM k a JOIN k b ON a.counts AND b.counts AND a.terminal = b.terminal AND a.code IS NOT DISTINCT FROM b.code AND a.page = b.page AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0.025)
      SELECT id, CASE WHEN f.page IS NULL THEN k.x END AS x, CASE WHEN f.page IS NULL THEN k.y END AS y, had OR f.page IS NOT NULL AS needs_review,
        CASE WHEN f.page IS NOT NULL THEN 'rescan_endpoint_position_conflict' END AS reason
      FROM k LEFT JOIN f ON counts AND k.terminal = f.terminal AND k.code IS NOT DISTINCT FROM f.code AND k.page = f.page""",
)
def a19(t):
    """Ends of vectors' places: a pin that was found at two places keeps neither."""
    i, e = F.col("vec_id"), F.col("embedding")
    last = F.when(i % 8 == 0, "pe").when(i % 8 == 1, "*").when(i % 8 == 2, "N").otherwise((i % 3).cast("string"))
    at = lambda k: (F.lit(0.5) + e[k].cast("double") / 8).alias("xy"[k])
    rows = t.embeddings.select(
        i.alias("id"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 11 == 1, "plain").otherwise(F.concat(F.lit("X"), (F.col("label") % 3).cast("string"), F.lit(":"), last)).alias("end_terminal"),
        F.when(i % 5 > 0, F.concat(F.lit("K"), (i % 5).cast("string"))).alias("end_code"),
        F.struct(at(0), at(1), (F.floor(i / 40) % 50).alias("page")).alias("end_point"),
        (i % 6 == 0).alias("needs_review"),
    )
    return review_positions(rows).select("id", "end_point.x", "end_point.y", "needs_review", "reason")


@query(
    "j36_start_identity_match",
    """SELECT o_orderkey, CASE WHEN k = 1 THEN 'unique' WHEN k > 1 THEN 'ambiguous' ELSE 'none' END AS verdict FROM orders LEFT JOIN (
         SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_linenumber = 2 AND (l_suppkey % 3 = 0 OR l_partkey % 2 = 0) GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def j36(t):
    """The terminal must match, no known part may conflict, and the device or the board must agree; unknown parts are tolerated."""
    have = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("terminal"),
        F.when(F.col("l_suppkey") % 3 == 0, "K1").alias("device"), F.when(F.col("l_partkey") % 2 == 0, "X4").alias("board"),
    )
    want = t.orders.select("o_orderkey", F.lit(2).alias("terminal"), F.lit("K1").alias("w_device"), F.lit("X4").alias("w_board"))
    agrees = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    clash = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    ok = (agrees("device", "w_device") | agrees("board", "w_board")) & ~clash("device", "w_device") & ~clash("board", "w_board")
    n = want.join(have, ["o_orderkey", "terminal"]).where(ok).groupBy("o_orderkey").agg(F.count("*").alias("k"))
    joined = t.orders.select("o_orderkey").join(n, "o_orderkey", "left")
    return joined.select("o_orderkey", F.when(F.col("k") == 1, "unique").when(F.col("k") > 1, "ambiguous").otherwise("none").alias("verdict"))


@query(
    "j30_j33_scope_narrowing",
    "SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS only_order, count(*) > 1 AS ambiguous FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
)
def j30(t):
    """A scope narrowed to one row, or said to be ambiguous."""
    g = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey")
    return g.agg(F.when(F.count("*") == 1, F.min("o_orderkey")).alias("only_order"), (F.count("*") > 1).alias("ambiguous"))


@query("j35_claim_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def j35(t):
    return t.events.where("event_type = 'purchase'").join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")
