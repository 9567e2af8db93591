"""Workbooks (XLSX) as rows of cells, with the standard library alone."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Collection, Iterator
from itertools import islice
from xml.etree import ElementTree as Tree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows that a task hands on at once.
ROWS = 5000
SHEET_CELLS = "file string, sheet string, row_no long, cells array<string>"


def _column(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _elements(source, *tags: str) -> Iterator:
    """The elements of these tags as they end, read as a stream; each is emptied afterwards."""
    for _, node in Tree.iterparse(source):
        if node.tag in tags:
            yield node
            node.clear()


def workbook_rows(content: bytes, names: Collection[str] | None = None, columns: Collection[int] | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row_no, cells) of all sheets, or of those in ``names``: others are never
    opened.  Blank cells are None; with ``columns`` a row has these cells only, in this order.
    Sheets are read as streams, a row at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        held = set(z.namelist())
        targets = {r.get("Id"): r.get("Target") for r in Tree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] | None = None
        for sheet in Tree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            if names is not None and sheet.get("name") not in names:
                continue
            if shared is None:  # read once, and only if some sheet is wanted
                shared = []
                if "xl/sharedStrings.xml" in held:
                    with z.open("xl/sharedStrings.xml") as source:
                        shared = [_text(si) for si in _elements(source, f"{_MAIN}si")]
            target = targets[sheet.get(_REL)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as source:
                for n, row in enumerate(_elements(source, f"{_MAIN}row")):
                    cells: dict[int, str | None] = {}
                    at = -1
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else at + 1
                        if columns is not None and at not in columns:
                            continue
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells[at] = _text(c)
                        elif value is not None:
                            cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                    yield sheet.get("name"), n, [cells.get(k) for k in (range(at + 1) if columns is None else columns)]


def workbook_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells."""
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(
                "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows
            )
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def parse_sheets(found: DataFrame, title_rows: int = 1, names: Collection[str] | None = None, columns: Collection[int] | None = None) -> DataFrame:
    """Files (path, content) to (file, sheet, row_no, cells) without title rows, of the sheets
    and columns that are named; a file that is no workbook gives no rows."""

    def rows(path: str, content: bytes) -> Iterator[dict]:
        file = path.rsplit("/", 1)[-1]
        for sheet, n, cells in workbook_rows(content, names, columns):
            if n >= title_rows:
                yield {"file": file, "sheet": sheet, "row_no": n - title_rows, "cells": cells}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                # Rows go out as they are read, so that a book is read to its end first: one
                # with a fault gives none.
                try:
                    for _ in workbook_rows(bytes(content), names, columns):
                        pass
                except (zipfile.BadZipFile, KeyError, IndexError, Tree.ParseError) as error:
                    logging.getLogger(__name__).warning("%s: no workbook: %s", path, error)
                    continue
                own = rows(path, bytes(content))
                while part := list(islice(own, ROWS)):
                    yield pd.DataFrame(part)

    return found.select("path", "content").mapInPandas(run, SHEET_CELLS)
