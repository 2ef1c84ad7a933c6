"""Records by their full rules, on rows of our own."""

import pytest
from pyspark.sql import functions as F

from loomline.plans import records as re


@pytest.mark.parametrize(("a", "b", "either", "text"), [
    ("x", "y", "x", "x"), ("", "y", "y", "y"), (None, "", "", None), ("  ", "y", "  ", None), (None, " y\n", " y\n", "y"), (None, None, None, None),
])
def test_first_filled_names(spark, a, b, either, text):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(re.or_else(F.col("a"), F.col("b")), re.text_of(F.col("a"), F.col("b"))).first()) == (either, text)


def test_read_model_defaults(spark):
    rows = [(1, "p", None, 3, None), (2, "p", "", 3, '{"processing_status": null}'), (3, "p", "W", 4, '{"review_reasons": ["x"]}')]
    got = re.read_model(spark.createDataFrame(rows, "id int, project string, workspace_code string, page int, evidence string")).orderBy("connection_id").collect()
    assert [(r.workspace_name, r.processing_status, r.review_reasons) for r in got] == [("未分类", "completed", "[]"), ("未分类", None, "[]"), ("W", "completed", '["x"]')]
    assert got[0].workspace_id == got[1].workspace_id != got[2].workspace_id and got[0].drawing_id == got[1].drawing_id != got[2].drawing_id


@pytest.mark.parametrize(("said", "want"), [
    ('{"end": {"terminal": "1:2"}, "source_note": "n"}', (None, "1:2", False)), ('{"end": {"terminal": "1:2"}}', ("no grounds", None, None)), ("no json", ("not an object", None, None)),
    ('{"task_id": "9", "end": {}, "source_note": "n"}', ("other task", None, None)), ('{"end_name": "x", "source_note": "n"}', (None, None, True)), (None, ("not an object", None, None)),
    ('{"end": null, "uncertainties": [{"detail": " "}]}', ("no grounds", None, None)), ('{"end": {"terminal": "K"}, "uncertainties": [{"detail": "d"}]}', (None, "K", True)),
])
def test_completion(spark, said, want):
    got = re.completion(spark.createDataFrame([(1, said)], "k int, j string"), "k", "j", F.lit("7")).first()
    assert (got.reason, got.terminal, got.needs_review) == want


def test_answer_rows(spark):
    head = ["页码", "起点端子", "终点端子", "原理号"]
    rows = [
        ("a", 0, ["title"]), ("a", 1, head), ("a", 2, ["p1", "1", "2", ""]), ("a", 3, [" ", "3", None, ""]), ("a", 4, ["", "", "", ""]), ("a", 5, ["", "4", "", ""]), ("a", 6, ["p2", "", "", ""]),
        ("a", 7, ["", "", "", "n"]), ("a", 8, head), ("a", 9, ["p3"]), ("a", 10, ["", "", "5"]),
        ("b", 0, ["页码", "备注"]), ("b", 1, ["p", "x"]), ("c", 0, [*head, "图纸页码"]), ("c", 1, ["p", "1", "", "", "q"]), ("d", 0, None),
    ]
    got = re.answer_rows(spark.createDataFrame(rows, "sheet string, row int, cells array<string>")).orderBy("sheet", "row").collect()
    assert [(r.sheet, r.row, r.page, r.startTerminal, r.error) for r in got] == [
        ("a", 2, "P1", "1", None), ("a", 3, "P1", "3", None), ("a", 5, None, "4", "no page"), ("a", 7, "P2", "", None), ("a", 10, "P3", "", None), ("c", 1, "P", "1", "field named twice"),
    ]


def test_literal_reference(spark):
    index = spark.createDataFrame([(1, 5, "/3.1 end"), (1, 4, "/3"), (1, 9, "x"), (2, 1, None)], "page int, place int, raw string")
    asked = [(1, "/3.1"), (1, "x"), (1, ""), (1, None), (2, "any"), (3, "x"), (1, "/3.1")]
    got = re.literal_reference(spark.createDataFrame(asked, "page int, raw string"), index).collect()
    assert sorted((r.page, r.raw or "", r.at or 0) for r in got) == [(1, "", 0), (1, "", 0), (1, "/3.1", 4), (1, "/3.1", 4), (1, "x", 9), (2, "any", 1), (3, "x", 0)]
