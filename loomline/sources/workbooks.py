"""Workbooks as a Spark data source: `format("xlsx")` reads and writes (sheet, row, cells), a row per row of a sheet.

Reading: a partition is one sheet of one file, or as many small ones as make TASK_BYTES. Their XML is streamed: rows of plain inline text, as this
module writes them, are cut out a block at a time; whatever else a sheet has goes through an XML parser a row at a time, beside the file's table of shared strings.
Cells are text: numbers as they are written, formulas by their last value, rows and cells that a sheet leaves out empty. Writing: a task
writes its rows, sheet by sheet in the order they come, to workbooks of its own below a hidden folder, and the driver moves them into place once all tasks
are done; of a task that fails or is repeated a reader sees nothing. All cells are inline strings, so nothing is a formula.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import located
from .tables import LONGEST_CELL

# Limits and names of the file format.
MOST_ROWS, MOST_SHEET_NAME = 1_048_576, 31
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
DOC_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
REFUSED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
REFUSED_BYTES = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"  # texts in Arrow have no surrogates
HEAD = '<?xml version="1.0" encoding="UTF-8"?>'

#: A row of one cell, but for its text, and what lies between two cells.
OPEN, SHUT = '<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
NEXT = SHUT + OPEN
SHEET = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'
#: What XML readers don't take as it stands: control characters, and line ends that they change.
UNPLAIN = bytes(set(range(32)) - {9, 10})
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#13;": "\r", "&amp;": "&"}
#: Bytes of XML that a task reads, by whole sheets; bytes of it held at once; rows of a batch.
TASK_BYTES, BLOCK, BATCH = 32 << 20, 1 << 20, 5_000

SCHEMA = "path string, sheet string, row long, cells array<string>"
ARROW_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])


@dataclass
class Sheet:
    path: str
    member: str
    name: str


@dataclass
class Sheets(InputPartition):
    sheets: list[Sheet]


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(item) -> str:
    """The text of a string item, its runs together, without how it is spoken."""
    spoken = {t for x in item.iter(_tag("rPh")) for t in x.iter(_tag("t"))}
    return "".join(t.text or "" for t in item.iter(_tag("t")) if t not in spoken)


def plain_rows(x) -> Iterator[tuple]:
    """(numbers, cells) of a sheet's rows, a block at a time, as long as they are rows of inline text that follow one another; (None, None) where
    something else comes, which is then all there is."""
    if x.read(len(SHEET.encode())) != SHEET.encode():
        yield None, None
        return
    rest, last = b"", 0
    while True:
        more = x.read(BLOCK)
        block, end, rest = (rest + more).rpartition(b"</row>")
        block += end
        if block:
            if len(block.translate(None, UNPLAIN)) < len(block) or b"\xef\xbf\xbe" in block or b"\xef\xbf\xbf" in block:
                break
            try:
                rows = block.decode().split("</row>")[:-1]
            except UnicodeDecodeError:
                break
            heads = [f'<row r="{i}">' for i in range(last + 1, last + 1 + len(rows))]
            if not all(map(str.startswith, rows, heads)):
                break
            inner = [r[len(h) :] for r, h in zip(rows, heads, strict=True)]
            said = pa.array([r[len(OPEN) : -len(SHUT)] if r else None for r in inner], pa.string())
            cells = pc.split_pattern(said, NEXT)
            # markup is but what was taken off and split at
            if not all(r.startswith(OPEN) and r.endswith(SHUT) and len(r) >= len(NEXT) for r in inner if r) or pc.any(pc.match_substring(cells.values, "<")).as_py():
                break
            if b"&" in block:
                if block.count(b"&") != sum(block.count(e.encode()) for e in ENTITIES):
                    break
                values = cells.values
                for entity, c in ENTITIES.items():  # `&amp;` last
                    values = pc.replace_substring(values, entity, c)
                cells = pa.ListArray.from_arrays(cells.offsets, values)
            elif said.null_count:
                cells = pa.ListArray.from_arrays(cells.offsets, cells.values)  # no row is null, some have no cell
            yield list(range(last + 1, last + 1 + len(rows))), cells
            last += len(rows)
        if not more:
            if rest == b"</sheetData></worksheet>":
                return
            break
    yield None, None


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[Sheets]:
        system, at = located(self.path)
        info = system.get_file_info(at)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
        out, held = [], 0
        for f in sorted((f.path for f in found if f.is_file and f.base_name.endswith(".xlsx") and not f.base_name.startswith((".", "_")))):
            with system.open_input_file(f) as file, zipfile.ZipFile(file) as book:
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_tag("sheet")):
                    target = targets[s.get(f"{{{DOC_RELS}}}id")]
                    member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                    size = book.getinfo(member).file_size
                    if not out or held + size > TASK_BYTES:
                        out.append(Sheets([]))
                        held = 0
                    out[-1].sheets.append(Sheet(f, member, s.get("name")))
                    held += size
        return out

    def read(self, partition: Sheets | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition of a folder without sheets
            return
        held, n = [], 0
        for batch in self._batches(partition):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        for path, sheets in groupby(partition.sheets, key=lambda s: s.path):
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as book:
                strings = None
                for sheet in sheets:
                    last = 0
                    with book.open(sheet.member) as x:
                        for numbers, cells in plain_rows(x):
                            if numbers is None:
                                break
                            yield pa.record_batch([pa.array([path] * len(numbers)), pa.array([sheet.name] * len(numbers)), pa.array(numbers, pa.int64()), cells], schema=ARROW_SCHEMA)
                            last = numbers[-1]
                        else:
                            continue
                    if strings is None:
                        strings = self._strings(book)
                    with book.open(sheet.member) as x:
                        rows = (r for r in self._rows(sheet, x, strings) if r[2] > last)
                        while part := list(islice(rows, BATCH)):
                            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*part, strict=True), ARROW_SCHEMA, strict=True)], schema=ARROW_SCHEMA)

    @staticmethod
    def _strings(book: zipfile.ZipFile) -> list[str]:
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as x:
                for _, item in ElementTree.iterparse(x):
                    if item.tag == _tag("si"):
                        strings.append(_text(item))
                        item.clear()
        return strings

    @staticmethod
    def _rows(partition: Sheet, x, strings: list[str]) -> Iterator[tuple]:
        last, held = 0, None
        for event, item in ElementTree.iterparse(x, ("start", "end")):
            if event == "start":
                held = item if item.tag == _tag("sheetData") else held
            elif item.tag == _tag("row"):
                number, cells = int(item.get("r") or last + 1), []
                for c in item.iter(_tag("c")):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    kind, value, inline = c.get("t"), c.find(_tag("v")), c.find(_tag("is"))
                    said = _text(inline) if inline is not None else (value.text or "") if value is not None else ""
                    cells.append(strings[int(said)] if kind == "s" and said else {"1": "TRUE", "0": "FALSE"}.get(said, said) if kind == "b" else said)
                for blank in range(last + 1, number):
                    yield partition.path, partition.name, blank, []
                yield partition.path, partition.name, number, cells
                last = number
                held.clear()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class XlsxWriter(DataSourceArrowWriter):
    """Rows (sheet, cells); `header`, column names apart by a line end, is the first row of each sheet."""

    def __init__(self, options):
        self.path, self.header = options["path"], options.get("header", "").split("\n") if options.get("header") else None
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = located(self.path)
        hidden = f"{folder}/_writing-{self.run}"
        system.create_dir(hidden, recursive=True)
        task, files, book, sheet = TaskContext.get().partitionId(), [], None, None
        try:
            for batch in rows:
                names, made, cells = [n or "Sheet" for n in batch.column("sheet").to_pylist()], row_texts(batch.column("cells")), batch.column("cells")
                at = 0
                while at < len(names):
                    name = names[at]
                    if book and (book.name != name or book.rows >= MOST_ROWS):
                        book.end_sheet()
                    if book is None or book.sheet is None:
                        if book is None or name in book.known:  # the same sheet goes on in another workbook
                            if book:
                                book.close()
                            files.append(f"{hidden}/part-{task:05d}-{len(files):05d}-{uuid.uuid4().hex[:8]}.xlsx")
                            book = _Book(system.open_output_stream(files[-1]))
                        book.begin_sheet(name)
                        if self.header:
                            book.add(self.header)
                    end, most = at + 1, at + MOST_ROWS - book.rows
                    while end < len(names) and end < most and names[end] == name:
                        end += 1
                    if made is None:  # a cell can't be held: the one that it is says so
                        for row in cells.slice(at, end - at).to_pylist():
                            book.add(row or [])
                    else:
                        book.add_texts(made[at:end])
                    at = end
        finally:
            if book:
                book.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, at = located(self.path)
        for m in messages:
            for f in m.files if m else []:
                system.move(f, f"{at}/{f.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        system, at = located(self.path)
        hidden = f"{at}/_writing-{self.run}"
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


def row_texts(cells: pa.ListArray) -> list[str] | None:
    """The XML of each row's cells, or None where no workbook can hold some of them."""
    filled = pc.fill_null(cells.flatten(), "")
    filled.validate(full=True)
    if len(filled) and (pc.max(pc.utf8_length(filled)).as_py() > LONGEST_CELL or pc.any(pc.match_substring_regex(filled, REFUSED_BYTES)).as_py()):
        return None
    if pc.any(pc.match_substring_regex(filled, "[&<>\r]")).as_py():
        for c, said in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), *_ESCAPES.items()):
            filled = pc.replace_substring(filled, c, said)
    sizes = pc.fill_null(pc.list_value_length(cells), 0).to_pylist()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), filled), NEXT).to_pylist()
    return [OPEN + t + SHUT if n else "" for t, n in zip(joined, sizes, strict=True)]


class _Book:
    """One workbook as it is written: a sheet's rows go to the file as they come."""

    def __init__(self, stream):
        self.stream, self.zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.known: set[str] = set()
        self.sheet, self.name, self.rows = None, None, 0

    def begin_sheet(self, name: str) -> None:
        if len(name) > MOST_SHEET_NAME or re.search(r"[\[\]:*?/\\]", name) or REFUSED.search(name):
            raise ValueError(f"no sheet can have the name {name[:40]!r}")
        self.names.append(name)
        self.known.add(name)
        self.name, self.rows = name, 0
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.sheet.write(SHEET.encode())

    def add(self, cells) -> None:
        self.rows += 1
        out = []
        for c in cells:
            text = c or ""
            if len(text) > LONGEST_CELL or REFUSED.search(text):
                raise ValueError(f"row {self.rows} of sheet {self.name!r} has a cell that no workbook can hold: {text[:40]!r}")
            out.append(OPEN + escape(text, _ESCAPES) + SHUT)
        self.sheet.write(f'<row r="{self.rows}">{"".join(out)}</row>'.encode())

    def add_texts(self, texts: list[str]) -> None:
        """Rows whose cells are XML."""
        self.sheet.write("".join([f'<row r="{i}">{t}</row>' for i, t in enumerate(texts, self.rows + 1)]).encode())
        self.rows += len(texts)

    def end_sheet(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        self.end_sheet()
        sheets = range(1, len(self.names) + 1)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in sheets)
            + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{DOC_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{DOC_RELS}"><sheets>'
            + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(sheets, self.names))
            + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{RELS}">'
            + "".join(f'<Relationship Id="rId{i}" Type="{DOC_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in sheets)
            + "</Relationships>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, HEAD + text)
        self.zip.close()
        self.stream.close()


#: XML readers make a line end of these.
_ESCAPES = {"\r": "&#13;"}


class Xlsx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options)

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        if {f.name for f in schema.fields} != {"sheet", "cells"}:
            raise ValueError("a workbook is written from (sheet, cells)")
        return XlsxWriter(self.options)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of a workbook, or of all in a folder."""
    spark.dataSource.register(Xlsx)
    return spark.read.format("xlsx").load(path)


def write_workbooks(df: DataFrame, path: str, header: list[str] | None = None) -> None:
    """`df` (sheet, cells) as workbooks in a folder. A partition's rows of a sheet come one after the other; what a sheet can't hold goes on in a
    workbook beside it. A cell that no workbook can hold fails the job: `tables.illegal_cells` names such rows before."""
    df.sparkSession.dataSource.register(Xlsx)
    writer = df.select("sheet", "cells").write.format("xlsx").mode("append")
    (writer.option("header", "\n".join(header)) if header else writer).save(path)


def export_workbooks(df: DataFrame, path: str, columns: dict[str, str], title: str = "Sheet") -> None:
    """Only the named columns, in order, as text below a header, in the order of the rows of each partition."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.values()])
    write_workbooks(df.select(F.lit(title).alias("sheet"), cells.alias("cells")), path, list(columns))


def table_of(rows: DataFrame) -> DataFrame:
    """Rows of sheets without their headers: (path, sheet, row, cells) below row 1."""
    return rows.where("row > 1")
