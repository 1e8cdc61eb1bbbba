"""Files as rows: CSV and workbook cells, document and plain text. Bytes are read by Spark and parsed file by file in Arrow batches."""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, sheet_index int, row_index int, cells array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def file_kind(path: Column, content_type: Column | None = None) -> Column:
    """csv, xlsx, docx, pdf, txt, html or unsupported, by content type, else by extension."""
    t = F.lower(F.coalesce(content_type if content_type is not None else F.lit(None).cast("string"), F.lit("")))
    p = F.lower(F.regexp_replace(path, r"[?#].*$", ""))
    out = None
    for kind, words, ends in (
        ("csv", ("text/csv",), (".csv",)), ("xlsx", ("spreadsheetml",), (".xlsx",)), ("docx", ("wordprocessingml",), (".docx",)),
        ("pdf", ("application/pdf",), (".pdf",)), ("html", ("text/html",), (".html", ".htm")), ("txt", ("text/plain",), (".txt",)),
    ):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        for e in ends:
            hit = hit | ((t == "") & F.endswith(p, F.lit(e)))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unsupported")


#: Bytes of a file that a task decodes at a time, and rows and bytes of a batch of its rows: what Python holds beside the pieces that Arrow brings.
PIECE, BATCH_ROWS, BATCH_BYTES = 1 << 20, 10_000, 4 << 20


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """A text that comes in pieces, cut at its \\n; invalid bytes are replaced. A quote that spans lines is the csv reader's, which asks for the next one."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    rest: list[str] = []
    for piece in pieces:
        *lines, last = decode(piece).split("\n")
        if lines:
            yield "".join([*rest, lines[0], "\n"])
            yield from (x + "\n" for x in lines[1:])
            rest = []
        rest.append(last)
    rest.append(decode(b"", True))
    if last := "".join(rest):
        yield last


def _csv(pieces: Iterator[bytes]) -> Iterator[tuple[str, int, int, list[str]]]:
    # lone \r end rows too: StringIO cuts a line at them
    return (("", 0, n, row) for n, row in enumerate(csv.reader(x for line in _lines(pieces) for x in (io.StringIO(line, newline="") if "\r" in line else (line,)))))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(data: bytes) -> list[tuple[str, int, int, list[str]]]:
    """Computed values of every sheet."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for index, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)):
            path = targets[sheet.get(_REL)].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for n, row in enumerate(ElementTree.fromstring(z.read(path)).findall("m:sheetData/m:row", _NS)):
                cells: list[str] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value = c.findtext("m:v", "", _NS)
                    if c.get("t") == "s":
                        value = shared[int(value)] if value else ""
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    cells.append(value)
                out.append((sheet.get("name"), index, int(row.get("r", n + 1)) - 1, cells))
    return out


def _rows(kind: str):
    parse = {"csv": _csv, "xlsx": lambda pieces: _xlsx(b"".join(pieces))}[kind]

    def batch(path: str, rows: list) -> pa.RecordBatch:
        columns = [pa.array([path] * len(rows), pa.string()), *[pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))]]
        return pa.RecordBatch.from_arrays(columns, ["file", "sheet", "sheet_index", "row_index", "cells"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((path.as_py(), data) for b in batches for path, data in zip(b.column(0), b.column(1)))
        for path, own in groupby(pieces, lambda x: x[0]):
            some, size = [], 0
            for row in parse(data.as_py() for _, data in own):
                some.append(row)
                size += sum(map(len, row[3]))
                if len(some) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(path, some)
                    some, size = [], 0
            if some:
                yield batch(path, some)

    return of


def read_sheet_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of the csv or xlsx files below a path, in file order by row_index. A file goes to Python in pieces, one behind the other, and its rows leave in
    batches, so a csv file of any length takes the memory of a few of them there; a workbook is put together again."""
    most = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    if not 0 < most <= 8 * PIECE:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * PIECE))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("content") - 1), F.lit(PIECE))
    pieces = files.select("path", "content", F.explode(starts).alias("start")).select("path", F.substring("content", F.col("start") + 1, F.lit(PIECE)).alias("content"))
    return pieces.mapInArrow(_rows(kind), CELLS)


def read_docx_text(spark: SparkSession, path: str) -> DataFrame:
    """file, text: the paragraphs of Word documents, one a line."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for data in b.column(1):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{{{_NS['w']}}}t")) for p in body.iter(f"{{{_NS['w']}}}p")).strip())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["file", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(of, "file string, text string")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole text files, trimmed; empty ones give no row."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("file"), F.trim(F.make_valid_utf8("value")).alias("text"))
    return rows.where("text <> ''")


def coerced(df: DataFrame) -> DataFrame:
    """Columns as an export shows them: decimals as doubles, nested values as JSON, bytes as text, moments without a zone in UTC, the rest unchanged."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif kind == "timestamp":
            c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
        elif kind == "binary":
            c = F.decode(c, "UTF-8")
        out.append(c.alias(name))
    return df.select(*out)
