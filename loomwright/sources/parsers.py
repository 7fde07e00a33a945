"""Text of files by format; standard library only, other libraries where they are installed."""

from __future__ import annotations

import csv
import importlib.util
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = "azw azw3 csv doc docx epub htm html markdown md mobi pdf ppt pptx rst tsv txt xls xlsx".split()
SKIPPED = tuple("header footer nav style script".split())
BAR = " | "
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def plain(data: bytes) -> str:
    """S04."""
    return data.decode("utf-8", "replace")


def table(data: bytes) -> str:
    """The dialect is sniffed on the first 4096 characters; cells by bar, rows by line."""
    text = plain(data)
    if not text.strip():
        return ""
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(text), dialect))


class _Visible(HTMLParser):
    def __init__(self, skip: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.parts = skip, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html(data: bytes, skip: tuple[str, ...] = SKIPPED) -> str:
    """Visible text, a line a piece."""
    p = _Visible(skip)
    p.feed(plain(data))
    p.close()
    return "\n".join(p.parts)


def docx(data: bytes) -> str:
    """Paragraphs, then the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        parts.append(" | ".join(text(c).strip() for c in row.findall(f"{_W}tc")))
    return "\n\n".join(p for p in parts if p.strip(" |"))


def xlsx(data: bytes) -> str:
    """A heading a sheet, then its rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
        out = []
        for k, name in enumerate(sheets, 1):
            out.append(f"# Sheet: {name}")
            path = f"xl/worksheets/sheet{k}.xml"
            if path not in names:
                continue
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_X}row"):
                cells = []
                for c in row.findall(f"{_X}c"):
                    v = c.find(f"{_X}v")
                    raw = v.text if v is not None and v.text else "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw or "")
                if any(x.strip() for x in cells):
                    out.append(BAR.join(cells))
    return "\n".join(out)


def pptx(data: bytes) -> str:
    """A heading a slide that has text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for k, name in enumerate(slides, 1):
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p")]
            lines = [x for x in lines if x]
            if lines:
                out.append("\n".join([f"## Slide {k}", *lines]))
    return "\n\n".join(out)


def epub(data: bytes) -> str:
    """The visible text of every page, in archive order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [html(z.read(n), ("script", "style")) for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(p for p in pages if p)


def mobi(data: bytes) -> str:
    """S14 without a converter: printable runs of 30 characters or more."""
    for encoding in ("utf-8", "latin-1"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    return "\n".join(re.findall(r"[^\x00-\x08\x0b-\x1f\x7f]{30,}", text))


def is_scan(pages: list[str]) -> bool:
    """S16."""
    return not any(p.strip() for p in pages)


_OCR: list = []


def ocr(image: bytes) -> str:
    """Lines of an image; the engine is loaded once a worker, and any failure is an empty text."""
    try:
        if not _OCR:
            from rapidocr_onnxruntime import RapidOCR

            _OCR.append(RapidOCR())
        found, _ = _OCR[0](image)
        return "\n".join(x[1] for x in found or [])
    except Exception:
        return ""


def pdf(data: bytes) -> str:
    """Text layer by page, OCR for pages of images alone; needs PyMuPDF."""
    import fitz

    pages = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            text = page.get_text().strip()
            if not text and page.get_images():
                text = ocr(page.get_pixmap().tobytes())
            pages.append(text)
    if is_scan(pages):
        raise RuntimeError("the PDF has images only and nothing could be read from them")
    return "\n\n".join(p for p in pages if p)


PARSERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md", "markdown", "rst"), plain), **dict.fromkeys(("csv", "tsv"), table), **dict.fromkeys(("html", "htm"), html),
    **dict.fromkeys(("docx", "doc"), docx), **dict.fromkeys(("xlsx", "xls"), xlsx), **dict.fromkeys(("pptx", "ppt"), pptx),
    "pdf": pdf, "epub": epub, **dict.fromkeys(("mobi", "azw", "azw3"), mobi),
}
#: Parsers to Markdown, tried first; (suffixes, function) pairs that an installation may add.
MARKDOWN_PARSERS: list[tuple[tuple[str, ...], Callable[[bytes], str | None]]] = []


def markdown(data: bytes, suffix: str) -> str | None:
    """Null where no parser knows the suffix, fails, or finds nothing."""
    for suffixes, parse in MARKDOWN_PARSERS:
        if suffix in suffixes:
            try:
                return parse(data) or None
            except Exception:
                return None
    return None


def extract(data: bytes, suffix: str) -> tuple[str, bool]:
    """(text, is Markdown)."""
    md = markdown(data, suffix)
    if md is not None:
        return md, True
    if suffix not in PARSERS:
        raise ValueError(f"unsupported format: {suffix}")
    return PARSERS[suffix](data), False


PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("is_markdown", T.BooleanType()), T.StructField("error", T.StringType())])


def parse_column(content: Column, suffix: Column) -> Column:
    """Struct (text, is_markdown, error); a failure or a blank text is an error of its row, never of the job."""

    @F.pandas_udf(PARSED)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, names in it:
            out = []
            for d, s in zip(data, names):
                try:
                    text, md = extract(bytes(d or b""), s or "")
                    out.append((text, md, None) if text.strip() else (None, md, "empty text"))
                except Exception as e:
                    out.append((None, False, ": ".join((type(e).__name__, str(e)))))
            yield pd.DataFrame(out, columns=["text", "is_markdown", "error"])

    return run(content, suffix)


def installed(name: str) -> bool:
    return importlib.util.find_spec(name) is not None
