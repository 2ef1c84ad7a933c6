"""Workbooks written and read again, those of other programs, and what no workbook can hold."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.sources import workbooks as wb
from loomline.sources.tables import LONGEST_CELL

CELLS = ["", "plain", "=1+1", "<a & \"b\">", " spaced ", "line\nend\r\ttab", "终点端子", "\U0001f600", "0012", "x" * LONGEST_CELL]


def test_round_trip(spark, tmp_path):
    rows = [(s, i, [*CELLS[i % 4 :], str(i)]) for s in ("A", "终点", "c&<d>") for i in range(50)]
    df = spark.createDataFrame(rows, "sheet string, i long, cells array<string>").repartition(5, "sheet").sortWithinPartitions("sheet", "i")
    wb.write_workbooks(df, f"file://{tmp_path}/out")
    got = wb.read_workbooks(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r.sheet, r.row, r.cells) for r in got) == sorted((s, i + 1, c) for s, i, c in rows)
    assert all(n.endswith(".xlsx") for n in os.listdir(tmp_path / "out"))
    wb.write_workbooks(df.where("sheet = 'A'"), f"{tmp_path}/plain")  # a plain path, one file read by its name
    (name,) = os.listdir(tmp_path / "plain")
    one = wb.read_workbooks(spark, f"{tmp_path}/plain/{name}")
    assert one.count() == 50 and one.rdd.getNumPartitions() == 1


def test_headers_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 1 else f"t{i}") for i in range(6)], "id long, t string")
    wb.export_workbooks(df.coalesce(1), str(tmp_path / "out"), {"号": "id", "text": "t"})
    rows = wb.read_workbooks(spark, str(tmp_path / "out")).orderBy("row").collect()
    assert rows[0].cells == ["号", "text"] and [r.cells for r in rows[1:]] == [[str(i), "" if i == 1 else f"t{i}"] for i in range(6)]
    wb.export_workbooks(df.where("id < 0"), str(tmp_path / "none"), {"id": "id"})
    assert wb.read_workbooks(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("cell", ["x" * (LONGEST_CELL + 1), "a\x00b", "a\x1fb", "a￿b"])
def test_refused_cells_leave_nothing(spark, tmp_path, cell):
    df = spark.range(20).select(F.lit("S").alias("sheet"), F.array(F.when(F.col("id") == 13, F.lit(cell)).otherwise("fine")).alias("cells")).repartition(3)
    with pytest.raises(Exception, match="no workbook can hold"):
        wb.write_workbooks(df, str(tmp_path / "out"))
    # a task that was still running when the job was given up may write to the hidden folder once more
    assert not os.path.exists(tmp_path / "out") or [n for n in os.listdir(tmp_path / "out") if not n.startswith("_writing-")] == []


def test_sheet_names(spark, tmp_path):
    for name in ("a/b", "x" * 32):
        with pytest.raises(Exception, match="no sheet can have"):
            wb.write_workbooks(spark.createDataFrame([(name, ["c"])], "sheet string, cells array<string>"), str(tmp_path / "out"))


def test_other_programs_workbooks(spark, tmp_path):
    """Shared strings with runs and readings, numbers, truth values, formulas, missing cells and rows, absolute targets, two sheets."""
    parts = {
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{wb.RELS}"><Relationship Id="a" Type="t" Target="/xl/worksheets/one.xml"/><Relationship Id="b" Type="t" Target="worksheets/two.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{wb.MAIN}" xmlns:r="{wb.DOC_RELS}"><sheets><sheet name="First" sheetId="1" r:id="a"/><sheet name="Second" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{wb.MAIN}"><si><t>page</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="1"><t>spoken</t></rPh></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{wb.MAIN}"><cols/><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c></row><row r="5"><c r="B5"><v>1.5</v></c><c r="C5" t="b"><v>1</v></c><c r="AA5" t="str"><f>A1</f><v>last</v></c></row></sheetData></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet xmlns="{wb.MAIN}"><sheetData/></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    got = {r.row: r.cells for r in wb.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()}
    assert got == {1: [], 2: ["page", "", "", "two runs"], 3: [], 4: [], 5: ["", "1.5", "TRUE", *[""] * 23, "last"]}


def test_a_books_rows_are_counted():
    held = io.BytesIO()
    book = wb._Book(held)
    for name in ("A", "B"):
        book.begin_sheet(name)
        for i in range(3):
            book.add([str(i), None])
        assert book.rows == 3
        book.end_sheet()
    book.stream = io.BytesIO()  # `held` is to be read
    book.close()
    with zipfile.ZipFile(held) as z:
        assert z.testzip() is None and "xl/worksheets/sheet2.xml" in z.namelist()


def test_small_sheets_share_a_task(spark, tmp_path):
    rows = spark.range(900).select(F.concat(F.lit("s"), (F.col("id") % 300).cast("string")).alias("sheet"), F.array(F.col("id").cast("string")).alias("cells"))
    wb.write_workbooks(rows.repartition(2, "sheet").sortWithinPartitions("sheet"), str(tmp_path / "out"))
    got = wb.read_workbooks(spark, str(tmp_path / "out"))
    assert got.rdd.getNumPartitions() == 1  # one a sheet before
    assert {(r.sheet, int(r.cells[0])) for r in got.collect()} == {(f"s{i % 300}", i) for i in range(900)}


def test_rows_are_plain_as_far_as_they_are(tmp_path):
    """Rows as this module writes them, then whatever XML allows: each comes once, as the parser says it."""
    cell = lambda t: wb.OPEN + t + wb.SHUT
    plain = [f'<row r="{i}">{cell("a&amp;lt;" + str(i))}{cell("")}</row>' for i in range(1, 60_001)]
    for odd, want in (
        (f'<row r="60001">{cell("&#65;")}</row>', ["A"]), (f'<row r="60001">{cell("<!-- no -->b")}</row>', ["b"]), (f'<row r="60001">{cell("l" + chr(13) + "m")}</row>', ["l\nm"]),
        (f'<row  r="60001">{cell("c")}</row >', ["c"]), ('<row r="60001"><c t="b"><v>1</v></c></row>', ["TRUE"]), (f'<row r="60003">{cell("d")}</row>', ["d"]), ('<row r="60001"></row>', []),
    ):
        with zipfile.ZipFile(tmp_path / "b.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("s.xml", wb.SHEET + "".join(plain) + odd + "</sheetData></worksheet>")
        reader = wb.XlsxReader({"path": str(tmp_path / "b.xlsx")})
        rows = [r for b in reader.read(wb.Sheets([wb.Sheet(str(tmp_path / "b.xlsx"), "s.xml", "S")])) for r in b.to_pylist()]
        assert [r["row"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == (60_003 if want == ["d"] else 60_001)
        assert rows[-1]["cells"] == want and all(r["cells"] == [f"a&lt;{r['row']}", ""] for r in rows[:60_000])
