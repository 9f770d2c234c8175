"""Formats that need a library or a program which may be missing: PDF, and the Office formats before OOXML.

Each is read from a file's bytes where what it needs is there, and raises an error that names it where it isn't.
`capabilities` tells beforehand.
"""

from __future__ import annotations

import importlib.util
import io
import shutil
import subprocess
from collections.abc import Callable

#: Programs that print the text of a .doc file which they are given on standard input, and how long they may take.
DOC_PROGRAMS = (("antiword", "-"), ("catdoc", "-w", "-"))
DOC_SECONDS = 30


def has_library(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


def doc_program() -> tuple[str, ...] | None:
    return next((p for p in DOC_PROGRAMS if shutil.which(p[0])), None)


def capabilities() -> dict[str, str]:
    """Of each optional suffix "ok", or what it needs."""
    return {
        ".pdf": "ok" if has_library("fitz") else "the library PyMuPDF",
        ".xls": "ok" if has_library("xlrd") else "the library xlrd",
        ".doc": "ok" if doc_program() else "one of the programs antiword and catdoc",
        ".ppt": "a conversion to .pptx",
    }


def _need(suffix: str) -> None:
    if (told := capabilities()[suffix]) != "ok":
        raise RuntimeError(f"files of type {suffix} need {told}, which is not here")


def pdf_spans(document) -> list[tuple[int, int, dict]]:
    """(page, block, span) of the spans of a document that hold more than blanks."""
    found = []
    for number, page in enumerate(document):
        for block, body in enumerate(page.get_text("dict")["blocks"]):
            lines = body.get("lines", []) if body.get("type") == 0 else []
            found += [(number, block, span) for line in lines for span in line.get("spans", []) if span.get("text", "").strip()]
    return found


def pdf_place(page: int, block: int, number: int) -> str:
    """Location of the number-th span of a file, counted from 0."""
    return f"pdf:page{page}:block{block}:span{number}"


def pdf_segments(data: bytes) -> list[tuple[str, str, dict]]:
    _need(".pdf")
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        return [(span["text"], pdf_place(page, block, n), {"page": str(page), "font": str(span.get("font", "")), "size": str(span.get("size", ""))}) for n, (page, block, span) in enumerate(pdf_spans(document))]


def pdf_text(data: bytes) -> str:
    """The texts of all pages, joined by line ends."""
    _need(".pdf")
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        return "\n".join(page.get_text() for page in document)


def pdf_rewritten(data: bytes, edit: Callable[[str, str], str]) -> bytes:
    """The file with changed spans blanked out and their new text put in their place, in a standard font."""
    _need(".pdf")
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        changed: dict[int, list[tuple[dict, str]]] = {}
        for n, (page, block, span) in enumerate(pdf_spans(document)):
            new = edit(pdf_place(page, block, n), span["text"])
            if new != span["text"]:
                changed.setdefault(page, []).append((span, new))
        for number, spans in changed.items():
            page = document[number]
            for span, _ in spans:
                page.add_redact_annot(fitz.Rect(span["bbox"]), fill=(1, 1, 1))
            page.apply_redactions()
            for span, new in spans:
                box = fitz.Rect(span["bbox"])
                page.insert_text((box.x0, box.y1 - 2), new, fontsize=span.get("size", 11), fontname="helv")
        out = io.BytesIO()
        document.save(out)
        return out.getvalue()


def cell_value(kind: int, value, text_kind: int = 1, number_kind: int = 2) -> str:
    """A cell of an old workbook as text: numbers as Python writes them (1.0), other kinds but text only where they are true."""
    if kind == text_kind:
        return value
    return str(value) if kind == number_kind or value else ""


def xls_segments(data: bytes) -> list[tuple[str, str, dict]]:
    _need(".xls")
    import xlrd

    book = xlrd.open_workbook(file_contents=data)
    rows = []
    for s in range(book.nsheets):
        sheet = book.sheet_by_index(s)
        for r in range(sheet.nrows):
            for c in range(sheet.ncols):
                text = cell_value(sheet.cell(r, c).ctype, sheet.cell(r, c).value)
                if text.strip():
                    rows.append((text, f"sheet{s}:row{r}:col{c}", {"sheet": str(s), "row": str(r), "col": str(c)}))
    return rows


def paragraph_segments(text: str) -> list[tuple[str, str, dict]]:
    """Lines that are not blank, by their number."""
    return [(line, f"para:{n}", {}) for n, line in enumerate(text.split("\n")) if line.strip()]


def doc_segments(data: bytes) -> list[tuple[str, str, dict]]:
    _need(".doc")
    done = subprocess.run(doc_program(), input=data, capture_output=True, timeout=DOC_SECONDS, check=True)
    return paragraph_segments(done.stdout.decode("utf-8", "replace"))


_SEGMENTERS = {".pdf": pdf_segments, ".xls": xls_segments, ".doc": doc_segments}


def optional_segments(suffix: str, data: bytes) -> list[tuple[str, str, dict]]:
    """Rows (text, location, metadata) of a file of an optional format."""
    _need(suffix)
    return _SEGMENTERS[suffix](data)
