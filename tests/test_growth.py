"""How work and shuffles grow with the tables."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from loomline import catalog
from loomline.plans.reconciling import reconcile


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_reconcile_deals_rows_once(spark):
    rows = spark.range(40).select(
        "id", (F.col("id") % 2).alias("page"), F.when(F.col("id") % 5 > 0, F.col("id") % 4).alias("no"), F.when(F.col("id") % 3 > 0, "s").alias("start"), F.lit("e").alias("end"), F.lit(None).cast("string").alias("color")
    )
    got = reconcile(rows, rows.withColumn("color", F.lit("")), ["page"], "no", ["no", "start", "end"], ["no", "start", "end", "color"], ["start", "end"])
    assert plan_of(got).count("Exchange") == 1
    assert {(r.status, r.answer_id == r.actual_id) for r in got.collect()} == {("same", True)} and got.count() == 40
    # a number outside of the identity is dealt by each pass, with the same rules
    apart = reconcile(rows, rows.where("id < 39").withColumn("no", F.col("no") + 1), ["page"], "no", ["id"], ["id", "no", "start"], ["id"])
    assert {(r.status, r.differences, r.answer_id == r.actual_id) for r in apart.where("answer_id < 39").collect()} == {("same", "", True), ("different", "no", True)}


def test_a_crowd_is_not_met_pair_by_pair(spark, monkeypatch):
    """Near copies that the stars left apart are brought together before all of their pairs are asked for."""
    from loomline.llm import neardup

    n, words = 240, [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[: i % 200], f"own{i}", *words[i % 200 + 1 :]])) for i in range(n)]
    asked, compare, likely = [], neardup.confirmed, neardup.promising

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(neardup, "confirmed", counted)
    monkeypatch.setattr(neardup, "promising", lambda *a: likely(*a).where("a < 0"))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert {(r.n_shingles, r.component_id) for r in got.collect()} <= {(s, 0) for s in (196, 197, 198)} and got.count() == n
    assert sum(asked) < 20 * n


@pytest.mark.parametrize("name, most", [("x37_start_identity", 12), ("x3_s12_wire_addresses", 14), ("x3_ambiguous_addresses", 14), ("x3_inherited_functions", 14), ("s14_grid_addresses", 14)])
def test_patterns_are_searched_once_a_row(spark, sf_dir, name, most):
    """A pattern put into another where its result is used would be searched once for every use."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp") + plan.count("RLIKE") <= most
