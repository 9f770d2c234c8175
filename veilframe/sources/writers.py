"""Files with their texts changed: the same formats that the readers take, from bytes to bytes."""

from __future__ import annotations

import copy
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.sources.optional import pdf_rewritten
from veilframe.sources.readers import _S, ENCODINGS, FORMATS, OFFICE, cell_text, decoded, part_texts

#: From a segment's location and text to its new text.
Edit = Callable[[str, str], str]


def replacer(pairs: dict[str, str]) -> Edit:
    """Replaces every key of a map, longest first."""
    ordered = sorted((k for k in pairs if k), key=len, reverse=True)

    def edit(location: str, text: str) -> str:
        for key in ordered:
            text = text.replace(key, pairs[key])
        return text

    return edit


def splicer(spans: dict[str, Sequence[tuple[int, int, str, str]]]) -> Edit:
    """Puts (start, end, original, masked) into the segment at each location, the last first; what doesn't fit is left out."""

    def edit(location: str, text: str) -> str:
        for start, end, original, masked in sorted(spans.get(location, ()), key=lambda s: -s[0]):
            if 0 <= start and end <= len(text) and text[start:end] == original:
                text = text[:start] + masked + text[end:]
        return text

    return edit


def _encoding(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def _plain(suffix: str, data: bytes, edit: Edit) -> bytes:
    name = _encoding(data)
    return edit("file", data.decode(name)).encode(name, errors="xmlcharrefreplace")


def edited_tree(value, edit: Edit, path: str = "", root: str = "json"):
    """A tree with its strings changed; keys, numbers and blank strings stay."""
    if isinstance(value, str):
        return edit(f"{root}:{path}", value) if value.strip() else value
    if isinstance(value, dict):
        return {k: edited_tree(v, edit, f"{path}.{k}" if path else str(k), root) for k, v in value.items()}
    if isinstance(value, list):
        return [edited_tree(v, edit, f"{path}[{i}]", root) for i, v in enumerate(value)]
    return value


def _json(suffix: str, data: bytes, edit: Edit) -> bytes:
    text = decoded(data)
    m = re.search(r"^([ \t]+)\S", text, re.M)
    return json.dumps(edited_tree(json.loads(text), edit), ensure_ascii=False, indent=len(m[1]) if m else None).encode()


def _yaml(suffix: str, data: bytes, edit: Edit) -> bytes:
    try:
        import yaml

        tree = yaml.safe_load(decoded(data))
    except Exception:  # no parser here, or no YAML: the text as it is
        return edit("yaml:file", decoded(data)).encode()
    return yaml.safe_dump(edited_tree(tree, edit, root="yaml"), allow_unicode=True, sort_keys=False).encode()


def _csv(suffix: str, data: bytes, edit: Edit) -> bytes:
    text = decoded(data)
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    out = io.StringIO(newline="")
    rows = csv.reader(io.StringIO(text), dialect)
    csv.writer(out, dialect).writerows([edit(f"csv:row{r}:col{c}", x) if x.strip() else x for c, x in enumerate(row)] for r, row in enumerate(rows))
    return out.getvalue().encode()


def spread(nodes: Sequence[ElementTree.Element], text: str) -> None:
    """A paragraph's new text over its nodes: each takes as much as it had, the last one the rest."""
    at = 0
    for node in nodes[:-1]:
        n = len(node.text or "")
        node.text = text[at : at + n]
        at += n
    nodes[-1].text = text[at:]


def _parse(data: bytes) -> ElementTree.Element:
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), ["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.fromstring(data)


def _dump(root: ElementTree.Element) -> bytes:
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def _paragraphs(name: str, data: bytes, tag: str, groups: tuple[str, ...], edit: Edit) -> bytes:
    root, changed = _parse(data), False
    for n, nodes in enumerate(part_texts(root, tag, groups)):
        old = "".join(x.text for x in nodes)
        new = edit(f"{name}:{n}", old)
        if new != old:
            spread(nodes, new)
            changed = True
    return _dump(root) if changed else data


def _sheet(name: str, data: bytes, tag: str, table: ElementTree.Element | None, strings: list[str], edit: Edit) -> bytes:
    """A worksheet with changed cells. A shared string that changes in one cell is copied, so that others keep it."""
    root, changed = _parse(data), False
    for cell in root.iter(f"{_S}c"):
        old = cell_text(cell, strings)
        new = edit(f"{name}:{cell.get('r')}", old) if old else old
        if new == old:
            continue
        changed = True
        if cell.get("t") == "s" and table is not None:
            place = cell.find(f"{_S}v")
            twin = copy.deepcopy(table.findall(f"{_S}si")[int(place.text)])
            spread(list(twin.iter(tag)), new)
            table.append(twin)
            place.text = str(len(strings))
            strings.append(new)
            if table.get("uniqueCount"):
                table.set("uniqueCount", str(int(table.get("uniqueCount")) + 1))
        else:
            spread(list(cell.iter(tag)), new)
    return _dump(root) if changed else data


def _office(suffix: str, data: bytes, edit: Edit) -> bytes:
    names, tag, groups = OFFICE[suffix]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        parts = {n: box.read(n) for n in box.namelist()}
    shared = "xl/sharedStrings.xml"
    table = _parse(parts[shared]) if suffix == ".xlsx" and shared in parts else None
    strings = ["".join(t.text or "" for t in si.iter(tag)) for si in table.findall(f"{_S}si")] if table is not None else []
    before = len(strings)
    for name in [n for n in parts if re.fullmatch(names, n)]:
        parts[name] = _sheet(name, parts[name], tag, table, strings, edit) if suffix == ".xlsx" else _paragraphs(name, parts[name], tag, groups, edit)
    if len(strings) > before:
        parts[shared] = _dump(table)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, body in parts.items():
            box.writestr(name, body)
    return out.getvalue()


def _pdf(suffix: str, data: bytes, edit: Edit) -> bytes:
    return pdf_rewritten(data, edit)


_WRITERS: dict[str, Callable[[str, bytes, Edit], bytes]] = {"pdf": _pdf, "text": _plain, "markdown": _plain, "json": _json, "yaml": _yaml, "csv": _csv, "office": _office}


def rewritten(suffix: str, data: bytes, edit: Edit) -> bytes:
    """A file's bytes with its segments changed by `edit`."""
    kind = FORMATS.get(suffix)
    if kind not in _WRITERS:
        raise ValueError(f"files of type {suffix} can't be written")
    return _WRITERS[kind](suffix, data, edit)


def rewrite_files(files: DataFrame) -> DataFrame:
    """path and content of files (path, content, pairs: map of what is replaced by what) after replacement.

    The result is a table of files: it is kept with any of Spark's writers, or handed out by the caller.
    """

    @F.pandas_udf("binary")
    def change(path: pd.Series, content: pd.Series, pairs: pd.Series) -> pd.Series:
        suffix = lambda p: re.search(r"(\.[^./\\]+)$", p)[1].lower()
        return pd.Series([rewritten(suffix(p), c, replacer(dict(m or {}))) for p, c, m in zip(path, content, pairs, strict=True)])

    return files.select("path", change("path", "content", "pairs").alias("content"))


EDITS = "array<struct<location:string,start:int,end:int,original:string,masked:string>>"


def edits_of(segments: Column, replacements: Column, whole: Column) -> Column:
    """Replacements in the joined text of a file's segments, as edits of the segments they lie in (EDITS).

    segments: of readers.segments(), in order, with the offsets they have in the joined text as joined_start and
    joined_end. whole: the file is one text, whose edits count from its beginning. What crosses from one segment
    into the next belongs to none and is left out.
    """

    def of(s: Column) -> Column:
        inside = F.filter(replacements, lambda r: (r["start"] >= s["joined_start"]) & (r["end"] <= s["joined_end"]))
        move = F.when(whole, s["start_offset"]).otherwise(0) - s["joined_start"]
        return F.transform(inside, lambda r: F.struct(F.when(whole, F.lit("file")).otherwise(s["location"]).alias("location"), (r["start"] + move).cast("int").alias("start"), (r["end"] + move).cast("int").alias("end"), r["original"].alias("original"), r["masked"].alias("masked")))

    return F.flatten(F.transform(segments, of)).cast(EDITS)


def splice_files(files: DataFrame) -> DataFrame:
    """path and content of files (path, content, edits: EDITS) with each edit made where it belongs, and nowhere else."""

    @F.pandas_udf("binary")
    def change(path: pd.Series, content: pd.Series, edits: pd.Series) -> pd.Series:
        out = []
        for p, c, rows in zip(path, content, edits, strict=True):
            by_place: dict[str, list[tuple[int, int, str, str]]] = {}
            for e in rows if rows is not None else ():
                by_place.setdefault(e["location"], []).append((e["start"], e["end"], e["original"], e["masked"]))
            out.append(rewritten(re.search(r"(\.[^./\\]+)$", p)[1].lower(), c, splicer(by_place)))
        return pd.Series(out)

    return files.select("path", change("path", "content", "edits").alias("content"))


def process_files(files: DataFrame, dry: bool = False) -> DataFrame:
    """path, ok, changes, content, error of files (path, content, pairs: map of what is replaced by what).

    changes counts what the segments hold of each key by itself. A file without any, and each file of a dry run, has
    no new content; a file that can't be read or written says why.
    """

    @F.pandas_udf("struct<ok:boolean,changes:long,content:binary,error:string>")
    def process(path: pd.Series, content: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        out = []
        for p, c, m in zip(path, content, pairs, strict=True):
            suffix, own, found = (re.search(r"(\.[^./\\]+)$", p) or [None, ""])[1].lower(), dict(m) if m is not None else {}, []
            try:
                rewritten(suffix, c, lambda at, text, found=found: found.append(text) or text)
                n = sum(text.count(key) for text in found for key in own if key)
                out.append((True, n, rewritten(suffix, c, replacer(own)) if n and not dry else None, None))
            except Exception as problem:  # noqa: BLE001  whatever is wrong with one file must not stop the others
                out.append((False, 0, None, str(problem)))
        return pd.DataFrame(out, columns=["ok", "changes", "content", "error"])

    return files.select("path", process("path", "content", "pairs").alias("r")).select("path", "r.*")
