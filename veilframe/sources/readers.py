"""Files as tables of documents and text segments."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.expr import empty, let, matches
from veilframe.sources.optional import capabilities, optional_segments
from veilframe.types import SEGMENT

ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "latin-1")
#: Reader of each format; a suffix names a format. The last entry of a suffix counts.
FORMATS: dict[str, str] = {}
_SEGMENTERS: dict[str, Callable[[str, bytes], list[tuple]]] = {}


def register(format_name: str, suffixes: tuple[str, ...], segmenter: Callable[[str, bytes], list[tuple]] | None = None) -> None:
    """segmenter: from a suffix and a file's bytes to rows (text, location, metadata)."""
    for suffix in suffixes:
        FORMATS[suffix] = format_name
    if segmenter:
        _SEGMENTERS[format_name] = segmenter


def format_of(path: Column) -> Column:
    """Format by the lower-cased suffix, null if there is none for it."""
    suffix = F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in FORMATS.items():
        out = F.when(suffix == name, F.lit(kind)).otherwise(out)
    return out


def is_supported(path: str) -> bool:
    m = re.search(r"(\.[^./\\]+)$", path)
    return bool(m) and m[1].lower() in FORMATS


def usable() -> dict[str, str]:
    """Of each suffix "ok", or what is missing to read it."""
    return {suffix: "ok" for suffix in FORMATS} | capabilities()


def supported() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for suffix, kind in FORMATS.items():
        out.setdefault(kind, []).append(suffix)
    return out


def decoded(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes everything")


def text_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole text files. UTF-8 is decoded by the engine; only other files pass through Python."""
    raw = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    plain = F.try_validate_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(decoded)

    good = raw.withColumn("text", plain)
    return good.filter("text is not null").select("path", "text").unionByName(good.filter("text is null").select("path", other("content").alias("text")))


def combined(segments: Column) -> Column:
    """Segments' texts joined by line ends."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "\n")


def with_offsets(segments: Column) -> Column:
    """Segments with their offsets in the combined text."""

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(s.withField("start_offset", acc["at"]).withField("end_offset", end))).alias("out"))

    return F.aggregate(segments, F.struct(F.lit(0).alias("at"), empty(SEGMENT).alias("out")), step, lambda acc: acc["out"])


def _segment(no: Column | int, text: Column, location: Column, start: Column, end: Column) -> Column:
    no = no if isinstance(no, Column) else F.lit(no)
    return F.struct(no.cast("int").alias("seg_no"), text.alias("text"), location.alias("location"), start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"))


def plain_segments(text: Column) -> Column:
    return F.array(_segment(0, text, F.lit("file"), F.lit(0), F.length(text)))


def markdown_segments(text: Column) -> Column:
    """What lies between fenced blocks and inline code, blank parts left out; the whole text if nothing is left.

    Fences and inline code are looked for each by itself, so that a backtick run that closes one block and one that
    opens the next also enclose what is between them: such text is not scanned.
    """
    code = F.concat(matches(text, "```[\\s\\S]*?```"), matches(text, "`[^`]+`"))
    cuts = F.array_sort(F.transform(code, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    closed = F.concat(cuts, F.array(F.struct(F.length(text).cast("int").alias("start"), F.length(text).cast("int").alias("end"))))

    def step(acc: Column, x: Column) -> Column:
        part = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        keep = (acc["at"] < x["start"]) & part.rlike("(?U)\\S")
        row = _segment(F.size(acc["out"]), part, F.concat(F.lit("text:"), acc["at"].cast("string"), F.lit("-"), x["start"].cast("string")), acc["at"], x["start"])
        return F.struct(x["end"].alias("at"), F.when(keep, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(closed, F.struct(F.lit(0).alias("at"), empty(SEGMENT).alias("out")), step, lambda acc: acc["out"])
    return let(found, lambda s: F.when(F.size(s) == 0, plain_segments(text)).otherwise(s))


def leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of the strings in a tree that are not blank, in order."""
    if isinstance(value, str):
        if value.strip():
            yield path, value
    elif isinstance(value, dict):
        for key, own in value.items():
            yield from leaves(own, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list):
        for i, own in enumerate(value):
            yield from leaves(own, f"{path}[{i}]")


def _json(suffix: str, data: bytes) -> list[tuple]:
    return [(text, f"json:{path}", {"path": path}) for path, text in leaves(json.loads(decoded(data)))]


def _yaml(suffix: str, data: bytes) -> list[tuple]:
    text = decoded(data)
    try:
        import yaml

        tree = yaml.safe_load(text)
    except Exception:  # no parser here, or no YAML: the text as it is
        return [(text, "yaml:file", {})]
    return [(t, f"yaml:{path}", {"path": path}) for path, t in leaves(tree)] or [(text, "yaml:file", {})]


def csv_rows(text: str) -> list[list[str]]:
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    return list(csv.reader(io.StringIO(text), dialect))


def _csv(suffix: str, data: bytes) -> list[tuple]:
    return [(cell, f"csv:row{r}:col{c}", {"row": str(r), "col": str(c)}) for r, row in enumerate(csv_rows(decoded(data))) for c, cell in enumerate(row) if cell.strip()]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Parts of an Office file that hold text: by suffix, patterns of names, the tag of text nodes and of what groups them.
OFFICE = {
    ".docx": (r"word/(document|header[1-3]|footer[1-3]|comments|footnotes|endnotes)\.xml", f"{_W}t", (f"{_W}p",)),
    ".pptx": (r"ppt/(slides|notesSlides|slideMasters|slideLayouts)/[^/]+\.xml", f"{_A}t", (f"{_A}p",)),
    ".xlsx": (r"xl/worksheets/[^/]+\.xml", f"{_S}t", (f"{_S}si", f"{_S}is")),
}


def part_texts(root: ElementTree.Element, tag: str, groups: tuple[str, ...]) -> list[list[ElementTree.Element]]:
    """Text nodes of a part, those of one paragraph (or cell) together, empty ones left out."""
    out: list[list[ElementTree.Element]] = []

    def walk(node: ElementTree.Element, group: list | None) -> None:
        if node.tag in groups:
            group = []
            out.append(group)
        for child in node:
            if child.tag == tag and child.text:
                if group is None:
                    out.append([child])
                else:
                    group.append(child)
            else:
                walk(child, group)

    walk(root, None)
    return [g for g in out if g]


def _office(suffix: str, data: bytes) -> list[tuple]:
    names, tag, groups = OFFICE[suffix]
    rows: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        parts = [n for n in box.namelist() if re.fullmatch(names, n)]
        if suffix == ".xlsx":
            shared = [] if "xl/sharedStrings.xml" not in box.namelist() else ["".join(t.text or "" for t in si.iter(tag)) for si in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
            for part in parts:
                for cell in ElementTree.fromstring(box.read(part)).iter(f"{_S}c"):
                    text = cell_text(cell, shared)
                    if text:
                        rows.append((text, f"{part}:{cell.get('r')}", {"part": part, "cell": cell.get("r") or ""}))
        else:
            for part in parts:
                for n, nodes in enumerate(part_texts(ElementTree.fromstring(box.read(part)), tag, groups)):
                    rows.append(("".join(x.text for x in nodes), f"{part}:{n}", {"part": part, "text_nodes": str(len(nodes))}))
    return rows


def cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    """Text of a worksheet cell: of its shared string or its own; none of numbers."""
    if cell.get("t") == "s":
        value = cell.find(f"{_S}v")
        place = int(value.text) if value is not None and (value.text or "").isdigit() else -1
        return shared[place] if 0 <= place < len(shared) else ""
    return "".join(t.text or "" for t in cell.iter(f"{_S}t"))


register("text", (".txt", ".md", ".rst", ".log", ".text"))
register("markdown", (".md", ".markdown"))
register("json", (".json",), _json)
register("yaml", (".yaml", ".yml"), _yaml)
register("csv", (".csv", ".tsv"), _csv)
register("office", (".docx", ".pptx", ".xlsx"), _office)
register("pdf", (".pdf",), optional_segments)
register("legacy", (".doc", ".xls", ".ppt"), optional_segments)


def segments(spark: SparkSession, *paths: str) -> DataFrame:
    """path, format, seg_no, text, location, start_offset, end_offset, metadata of files of all formats, each read once."""
    return segments_of(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def segments_of(files: DataFrame) -> DataFrame:
    """segments() of a table of files (path, content), wherever they come from.

    Text and Markdown are cut by expressions, the others by a batched function over the files' bytes.
    """
    files = files.select("path", "content", format_of(F.col("path")).alias("format")).filter("format is not null")
    is_text = F.col("format").isin("text", "markdown")
    valid = F.try_validate_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def other_text(content: pd.Series) -> pd.Series:
        return content.map(lambda c: decoded(c) if c is not None else None)

    @F.pandas_udf("array<struct<text:string,location:string,metadata:map<string,string>>>")
    def read(path: pd.Series, kind: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "location": at, "metadata": m} for t, at, m in _SEGMENTERS[k](re.search(r"(\.[^./\\]+)$", p)[1].lower(), c)] if c is not None else None for p, k, c in zip(path, kind, content, strict=True)])

    # what either function has no use for reaches it as null
    read_once = files.withColumn("valid", F.when(is_text, valid)).select("path", "format", F.coalesce("valid", other_text(F.when(is_text & F.col("valid").isNull(), F.col("content")))).alias("text"), read("path", "format", F.when(~is_text, F.col("content"))).alias("rows"))
    made = F.transform("rows", lambda r, i: F.struct(i.alias("seg_no"), r["text"].alias("text"), r["location"].alias("location"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), r["metadata"].alias("metadata")))
    cut = F.when(F.col("format") == "markdown", markdown_segments(F.col("text"))).when(F.col("format") == "text", plain_segments(F.col("text"))).otherwise(with_offsets(made))
    return read_once.select("path", "format", F.explode(cut).alias("s")).select("path", "format", "s.*")


def extract_text(spark: SparkSession, *paths: str) -> DataFrame:
    """path and text of files of all formats: their segments' texts joined by line ends."""
    rows = segments(spark, *paths).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("s"))
    return rows.select("path", combined(F.col("s")).alias("text"))
