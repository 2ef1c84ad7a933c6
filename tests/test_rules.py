"""Rules and operators on hand-built rows."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomline.functions import dialects as dl
from loomline.functions import json_text as jt
from loomline.functions import rules as ru
from loomline.functions import scalars as sc
from loomline.operators import aggregates as ag
from loomline.operators import changes as ch
from loomline.operators import filters as fl
from loomline.operators import joins as jn
from loomline.operators import windows as wn
from loomline.plans import artifacts as ar
from loomline.plans.reconciling import reconcile
from loomline.sources import tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A001-003", ["A001", "A002", "A003"]), ("A098-A101", ["A098", "A099", "A100", "A101"]), ("N12~5", ["N12", "N13", "N14", "N15"]), ("N15~2", None), ("7至9", ["7", "8", "9"]),
        ("A1-B2", None), ("A001-300", None), ("abc", None), ("A108-12", ["A108", "A109", "A110", "A111", "A112"]),
    ],
)
def test_number_ranges(text, want):
    assert fl.expand_numbers(text) == want


def test_search_text():
    assert fl.search_text(" X1:2; drop_%") == "X1:2 drop_"
    assert len(fl.search_text("a" * 300)) == 100


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("=082.R+ES1/12.3", ("082.R", 12, 3, "+ES1")), ("/5.1", ("107.A", 5, 1, None)), (".B/7.2", ("107.B", 7, 2, None)),
        ("B/7.2", ("107.B", 7, 2, None)), ("/5.1 /6.2", None), ("12.3", ("107.A", 12, 3, None)), ("nothing", None), ("/5.123", None),
    ],
)
def test_addresses(spark, raw, want):
    got = one(spark, dl.parse_address(F.col("r"), F.lit("107.A")), r=raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("raw", "want", "back"), [("3C", ("GCR.3", 3), "3C"), ("td 12.b", ("GCR.TD", 1202), "TD:12.b"), ("TD 7", ("GCR.TD", 7), "TD:7"), ("xx", None, None)])
def test_sheets(spark, raw, want, back):
    got = one(spark, dl.encode_sheet(F.col("r")), r=raw)
    assert (tuple(got) if got else None) == want
    if want:
        f = spark.createDataFrame([want], "f string, n int")
        assert f.select(dl.decode_sheet(F.col("f"), F.col("n"))).first()[0] == back


def test_scalars(spark):
    assert one(spark, sc.page_label(F.lit("082.R"), F.col("p")), p=123) == "082R123"
    assert one(spark, sc.page_label(F.lit("082.R"), F.col("p")), p=7) == "082R07"
    assert one(spark, sc.uuid5(F.col("n")), n="a b") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a b"))
    assert one(spark, sc.version_key(F.col("v")), v="1.10.0") == [1, 10, 0]
    assert one(spark, sc.version_key(F.col("v")), v="bad") == [0]
    assert one(spark, sc.blank_to_null(F.col("v")), v="  ") is None
    assert one(spark, sc.clamp01(F.col("v")), v="x") is None
    assert one(spark, sc.name_key(F.col("v")), v="A b_C-1") == "abc1"


def test_terminals(spark):
    assert one(spark, ru.complete_terminal(F.col("t"), F.lit("-XD3")), t="7") == "XD3:7"
    assert one(spark, ru.complete_terminal(F.col("t"), F.lit("-XD3")), t="K1：7") == "K1:7"
    assert one(spark, ru.complete_terminal(F.col("t"), F.lit("-XD3")), t="XD4") is None
    assert one(spark, ru.terminal_strip(F.col("d")), d="-xd5") == "X3"
    assert one(spark, ru.terminal_strip(F.col("d")), d="Q9") is None
    assert one(spark, ru.breaker_current(F.col("v"), F.lit("Ir"), F.lit("Ir: 63")), v="63 ka") == "63kA"
    assert one(spark, ru.breaker_current(F.col("v"), F.lit("Ir"), F.lit("In = 63")), v="63 A") is None


def test_merge_replace_conflicts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, None, 1)], "k int, s string, version int")
    s = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, s string")
    got = {r.k: (r.s, r.version, r.action) for r in ch.merged(t, ch.marked(s), ["k"], ["s"]).collect()}
    assert got == {1: ("a", 1, "keep"), 2: ("c", 4, "update"), 3: (None, 1, "keep"), 4: ("d", 1, "insert")}
    assert [r.k for r in ch.conflicts(t, t.withColumn("version", F.lit(1)), ["k"]).collect()] == [2]
    assert ch.replaced(t.select("k", "s"), t.where("k < 3"), s.where("k = 4"), ["k"]).count() == 2


def test_matches(spark):
    pairs = spark.createDataFrame([(1, 10, 9), (1, 11, 5), (2, 12, 6), (2, 13, 6), (3, 14, 3), (4, 15, 8), (5, 15, 8), (6, 16, 4)], "o long, n long, s long")
    assert sorted(tuple(r) for r in jn.ranked_matches(pairs, "o", "n", "s", 4).collect()) == [(1, 10, 9), (6, 16, 4)]
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert {r.k: (r.v, r.matches) for r in jn.unique_match(left, right, ["k"], ["v"], ["v"]).collect()} == {1: ("a", 1), 2: (None, 2), 3: (None, 0)}


def test_reconcile(spark):
    cols = "id long, page string, no string, start string, end string, color string"
    answers = spark.createDataFrame([(1, "p", "5", "a", "b", "r"), (2, "p", "5", "a", "b", "r"), (3, "p", "6", "c", "d", "r"), (4, "p", "7", "e", None, "r"), (5, "p", "8", "x", "y", "r"), (6, "p", "8", "z", "w", "r")], cols)
    actuals = spark.createDataFrame([(11, "p", "5", "a", "b", "r"), (13, "p", "6", "c", "d", "q"), (14, "p", "7", "e", "f", "r"), (15, "p", "8", "q", "q", "r"), (16, "p", "9", "q", "q", "r")], cols)
    got = reconcile(answers, actuals, ["page"], "no", ["no", "start", "end"], ["no", "start", "end", "color"], ["start", "end"]).collect()
    assert sorted((r.status, r.answer_id or 0, r.actual_id or 0, r.differences) for r in got) == [
        ("ambiguous", 0, 15, ""), ("ambiguous", 5, 0, ""), ("ambiguous", 6, 0, ""), ("different", 3, 13, "color"), ("different", 4, 14, "end"),
        ("extra", 0, 16, ""), ("missing", 2, 0, ""), ("same", 1, 11, ""),
    ]


def test_windows(spark):
    rows = spark.createDataFrame([("s", 1, "p1"), ("s", 2, ""), ("s", 3, None), ("s", 4, ""), ("s", 5, "p2")], "sheet string, row int, page string")
    blank = F.col("page").isNull()
    assert [(r.row, r.page) for r in wn.fill_down(rows, ["sheet"], "row", "page", blank).orderBy("row").collect()] == [(1, "p1"), (2, "p1"), (4, None), (5, "p2")]
    n = spark.createDataFrame([("v", 1, None), ("v", 2, 1005), ("v", 3, None), ("v", 4, 990), ("v", 5, None)], "k string, o int, x int")
    assert [r.number for r in wn.allocate_numbers(n, ["k"], ["o"], "x").orderBy("o").collect()] == [1000, 1005, 1006, 990, 1007]
    cov = spark.createDataFrame([("a", 0, 10, 30), ("a", 8, 12, 30), ("a", 25, 5, 30), ("b", 3, 5, 8)], "k string, s int, n int, t int")
    assert {r.k: (r.covered, r.complete) for r in ag.contiguous_prefix(cov, ["k"], "s", "n", "t").collect()} == {"a": (20, False), "b": (0, False)}


def test_digest_has_no_order(spark):
    a = spark.range(50).withColumn("v", F.col("id") % 3)
    assert ag.table_digest(a).first() == ag.table_digest(a.orderBy(F.desc("id")).repartition(5)).first()
    assert ag.table_digest(a).first() != ag.table_digest(a.union(a.limit(1))).first()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \ftwo")
    got = tables.page_texts(spark, str(tmp_path / "a.txt")).orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "one"), (2, "two")]
    (tmp_path / "r.json").write_text('{"a": 1, "z": 2}\nnope\n')
    got = tables.json_records(spark, str(tmp_path / "r.json"), "a int").collect()
    assert sorted((r.a or 0, r._bad or "") for r in got) == [(0, "nope"), (1, "")]
    df = spark.createDataFrame([(1, "x"), (2, "y" * 40000), (3, "\x01")], "k int, t string")
    assert sorted(r.k for r in tables.illegal_cells(df, "k", ["t"]).collect()) == [2, 3]
    tables.write_units(df.where("k = 1").withColumnRenamed("k", "unit_id"), str(tmp_path / "u"))
    tables.write_sheet(df.where("k = 1"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first()["t"] == "x"


def review(spark, phase="final", strict=True, **given):
    record = {"endpoint_role": "source", "direction_basis": "arrow", "line_number": "1", "start_terminal": "X1:1", "end_terminal": "X2:1", "completion_state": None} | given
    names = ("endpoint_role direction_basis line_number start_terminal end_terminal start_device end_device start_terminal_board end_terminal_board completion_state").split()
    row = {n: F.lit(record.get(n)).cast("string") for n in names}
    row["has_evidence"] = F.lit(record.get("evidence", True))
    lists = {"references": ("reason", "array<struct<reason: string>>"), "uncertainties": ("field,detail", "array<struct<field: string, detail: string>>"), "warnings": (None, "array<string>")}
    for name, (_, kind) in lists.items():
        row[name] = F.from_json(F.lit(json.dumps(record.get(name))), kind) if record.get(name) is not None else F.lit(None).cast(kind)
    return [(r.code, r.field) for r in spark.range(1).select(ru.review_reasons(row, phase, strict).alias("r")).first().r]


def test_review_reasons(spark):
    assert review(spark) == []
    waiting = {"end_terminal": None, "references": [{"reason": None}], "uncertainties": [{"field": "end", "detail": "x"}, {"field": "start", "detail": ""}]}
    assert review(spark, "scan", False, **waiting) == [("visual_uncertainty", "start")]
    assert review(spark, **waiting) == [("missing_end_terminal", "end_terminal"), ("visual_uncertainty", "end"), ("visual_uncertainty", "start")]
    assert review(spark, completion_state="conflicting") == [("target_conflict", "end")]
    assert review(spark, completion_state="resolved", evidence=False) == [("completion_evidence_missing", "end")]
    assert review(spark, strict=False, completion_state="resolved", evidence=False) == []
    assert review(spark, end_terminal=" ", references=[{"reason": "external"}, {"reason": ""}]) == [("missing_end_terminal", "end_terminal")]
    assert review(spark, end_terminal=None, references=[{"reason": "external"}, {"reason": "external"}]) == [("missing_end_terminal", "end_terminal"), ("reference_unresolved", "references")]
    assert review(spark, direction_basis=" ", warnings=["w", "w"]) == [("direction_unconfirmed", "direction"), ("profile_validation", None)]
    assert review(spark, start_terminal="I1.2", end_terminal="7") == [
        ("non_physical_terminal", "start_terminal"), ("endpoint_identity_incomplete", "start"), ("endpoint_identity_incomplete", "end")
    ]
    assert review(spark, start_terminal="*", end_terminal="*", line_number="spare") == []
    assert review(spark, end_terminal="7", end_device="-K1") == [] and review(spark, end_terminal="pe-bar") == []


@pytest.mark.parametrize(
    ("issue", "state", "want"),
    [
        ("DIRECT_VALUE_CHANGE", "same_page", ("DIRECT_PATCH", 2, 0)), ("FORMAT_OR_ORDER", "same_page", ("DETERMINISTIC_ONLY", 2, 0)), ("SOURCE_INSUFFICIENT", "cross_page", ("NO_ACTION", 0, 0)),
        ("RECOGNITION_ERROR", "same_page", ("RERUN_STAGE_2", 3, 1)), ("RECOGNITION_ERROR", "cross_page", ("RERUN_STAGE_2", 3, 2)), ("MISSING_START", "unknown", ("RERUN_STAGE_2", 3, 2)),
        ("PAGE_CLASSIFICATION_ERROR", "same_page", ("RERUN_STAGE_1", 4, 1)), ("PAGE_CLASSIFICATION_ERROR", "unknown", ("RERUN_STAGE_1", 4, 2)),
    ],
)
def test_correction_routes(spark, issue, state, want):
    got = one(spark, ru.correction_route(F.col("i"), F.col("s")), i=issue, s=state)
    assert (got.action, len(got.stages), got.calls) == want


def test_start_identities(spark):
    def identity(**r):
        return ru.start_identity({k: F.lit(v).cast("string") for k, v in r.items()})

    def same(a, b):
        return spark.range(1).select(ru.same_start(identity(**a), identity(**b)).alias("x")).first().x

    plain = spark.range(1).select(identity(start_code="+es 1", device="-k1", start_terminal="- xd 3:4:7").alias("i")).first().i
    assert tuple(plain) == ("+ES1", "K1", "XD3:4", "7", False)
    assert spark.range(1).select(identity(start_terminal="XD3:7", start_terminal_board="XD4").alias("i")).first().i.conflict
    whole = {"start_location": "+A", "start_device": "-K1", "start_terminal": "7"}
    assert same(whole, whole | {"start_device": "k1"}) and not same(whole, whole | {"start_device": "K2"}) and not same(whole, whole | {"start_location": "+B"})
    assert not same(whole, {"start_device": "K1", "start_terminal": "7"})  # a known place is not left out
    assert same({"start_device": "K1", "start_terminal": "7"}, whole)
    assert same({"start_terminal": "XD3:0"}, {"start_terminal_board": "-XD3", "start_terminal": "0"})
    assert not same({"start_terminal": "7"}, {"start_terminal": "7"}) and same({"start_terminal": "X1:7", "start_terminal_board": "X2"}, whole) is None


def test_principle_numbers(spark):
    def number(start_mark, end_mark, unreadable, terminal, board, sheet):
        full = ru.full_terminal(F.lit(terminal).cast("string"), F.lit(board).cast("string"), F.lit(None).cast("string"))
        got = ru.principle_number(F.lit(start_mark).cast("string"), F.lit(end_mark).cast("string"), F.lit(unreadable), full, F.lit(None).cast("string"), F.lit(sheet).cast("int"))
        return tuple(spark.range(1).select(got.alias("x")).first().x)[:3]

    assert number("12", "7", False, None, None, 5) == ("125", "start_marker", None)
    assert number(None, "7", False, "9", "X1", 5) == ("75", "end_marker", None)
    assert number(None, None, False, "-9", "-X1", 5) == ("X1:95", "actual_terminal", None)
    assert number(None, None, True, "9", "X1", 5) == (None, "end_marker", "connection")
    assert number(None, None, False, "L1", "X1", 5) == (None, "actual_terminal", "connection")
    assert number("12", None, False, None, None, None) == (None, "start_marker", "page")


def test_rescan_scores(spark):
    point = lambda x, page: F.struct(F.lit(x).alias("x"), F.lit(0.5).alias("y"), F.lit(page).alias("page"))

    def row(id=None, page=1, no=None, a=None, b=None, ac=None, bc=None, ax=0.1, bx=0.9, ap=1, bp=1):
        text = lambda v: F.lit(v).cast("string")
        return {"id": text(id), "page": F.lit(page), "no": text(no), "start_terminal": text(a), "end_terminal": text(b), "start_code": text(ac), "end_code": text(bc), "start_point": point(ax, ap), "end_point": point(bx, bp)}

    def score(old, new):
        return spark.range(1).select(ru.rescan_score(old, new).alias("x")).first().x

    assert score(row(id="r", no="1"), row(id="r", no="2")) == 10000 and score(row(id="r"), row(id="r", page=2)) == 0
    assert score(row(no="1", ax=0.1, bx=0.9), row(no="1", ax=0.3, bx=0.6)) == 4
    assert score(row(a="X1:1", ac="K1"), row(b="X1:1", bc="K1", ax=0.3, bx=0.6)) == 80  # the same pin in the other role
    assert score(row(a="X1:1", ac="K1"), row(b="X1:1", bc="K2", ax=0.3, bx=0.6)) == 0
    assert score(row(a="X1:1"), row(a="X1:1", ax=0.3, bx=0.6, ap=2)) == 2  # not on its page: no anchor
    assert score(row(ax=0.1, bx=0.9), row(ax=0.5, bx=0.124)) == 5 and score(row(ax=0.1, bx=0.9), row(ax=0.5, bx=0.126)) == 0


def test_json_texts():
    assert jt.canonical('{"b": 1.50, "a": [-0.0, 1e3, "\\u00e9\\n", null], "b": 2}') == '{"a":[0,1000,"é\\n",null],"b":2}'
    assert jt.without_fields('{"status": 1, "x": [{"needs_review": true, "y": {}}], "required": ["status", "y"]}') == '{"x":[{"y":{}}],"required":["y"]}'
    assert jt.canonical(None) is None and jt.without_fields(None) is None


def test_bad_json_is_a_row(spark):
    texts = ['{"a": 1.0}', None, "", "{", '{"a": NaN}', "[Infinity]", "[" * 100_000, "7", '"\\ud800"', "1e400000000000000000000"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    for made in (jt.canonical_json, jt.facts_only):
        got = {r.i: r.j for r in df.select("i", made("t").alias("j")).collect()}
        assert len(got) == len(texts) and got[1] == (None, None) and got[7] == ("7", None) and got[0].error is None
        assert all(got[i].text is None and got[i].error for i in (2, 3, 4, 5, 6))


def test_fingerprints(spark):
    said = 'a "b" \\ / é\n\t'
    made = jt.request_fingerprint(F.lit("m"), F.array(F.struct(F.lit("user").alias("role"), F.lit(said).alias("content"))), F.lit(0.5), F.lit(None), F.lit(False), F.lit(True))
    request = {"model": "m", "messages": [{"role": "user", "content": said}], "temperature": 0.5, "max_tokens": None, "json_mode": False, "thinking": True}
    want = hashlib.sha256(json.dumps(request, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert spark.range(1).select(made.alias("x")).first().x == want


def test_evaluation_metrics(spark):
    cases = "g string, kind string, valid boolean, failed boolean, cost long, duration long, right long, predicted long, expected long"
    rows = [("a", "target", True, False, 1, 5, 2, 2, 2), ("a", "target", True, False, 1, 6, 1, 2, 2), ("a", "negative", True, False, 1, 7, 0, 3, 0), ("a", "protected", False, False, 1, 8, 1, 1, 1), ("b", "negative", True, False, 0, 1, 0, 0, 0)]
    got = {r.g: r for r in ar.metrics(spark.createDataFrame(rows, cases), "g").collect()}
    a, b = got["a"], got["b"]
    assert (a.total, a.passed, a.target_pass_rate, a.protected_regressions, a.negative_hallucinations, a.schema_valid_rate) == (4, 1, 0.5, 1, 1, 0.75)
    assert (a.field_precision, a.field_recall, a.cost, a.p95) == (0.5, 0.8, 4, 8) and (b.passed, b.target_pass_rate, b.field_precision, b.field_recall) == (1, 1, 1, 1)
