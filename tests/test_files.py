"""Writers: files with values replaced, and files in a working tree."""

import io
import json
import subprocess
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F
from test_engine import _docx, _xlsx

from veilframe.operators import model_service
from veilframe.operators.splice import originals_of, replacements_of, spliced
from veilframe.sources import optional
from veilframe.sources.changed import Options, changed_files, create_options, load_options, save_options
from veilframe.sources.readers import _SEGMENTERS, extract_text, usable
from veilframe.sources.writers import process_files, replacer, rewrite_files, rewritten, splicer


def parts(kind, suffix, data):
    return [(t, at) for t, at, _ in _SEGMENTERS[kind](suffix, data)]


def test_formats():
    edit = replacer({"v": "W", "vv": "X"})
    assert rewritten(".txt", "中v vv".encode("gbk"), edit).decode("gbk") == "中W X"
    assert json.loads(rewritten(".json", b'{\n  "v": ["v", 1, {"k": "vvv"}]\n}', edit)) == {"v": ["W", 1, {"k": "XW"}]}
    assert b'\n  "v"' in rewritten(".json", b'{\n  "v": "v"\n}', edit)
    assert rewritten(".csv", b"a;v\r\n1;vv\r\n", edit) == b"a;W\r\n1;X\r\n"
    assert rewritten(".md", b"v `v`", edit) == b"W `W`"
    with pytest.raises(ValueError):
        rewritten(".bin", b"", edit)


def test_paragraph_text_spreads_over_nodes():
    out = rewritten(".docx", _docx(), replacer({"张三": "{{PERSON_000001}}"}))
    assert [t for t, _ in parts("office", ".docx", out)] == ["{{PERSON_000001}}", "b"]
    back = rewritten(".docx", out, replacer({"{{PERSON_000001}}": "张三"}))
    assert parts("office", ".docx", back) == parts("office", ".docx", _docx())


def test_one_cell_of_a_shared_string():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}" count="2" uniqueCount="1"><si><t>Alice</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>0</v></c></row></sheetData></worksheet>')
    new = rewritten(".xlsx", out.getvalue(), splicer({"xl/worksheets/sheet1.xml:A2": [(0, 5, "Alice", "Carol"), (0, 3, "Bob", "x")]}))
    assert parts("office", ".xlsx", new) == [("Alice", "xl/worksheets/sheet1.xml:A1"), ("Carol", "xl/worksheets/sheet1.xml:A2")]
    assert b'uniqueCount="2"' in zipfile.ZipFile(io.BytesIO(new)).read("xl/sharedStrings.xml")
    inline = rewritten(".xlsx", _xlsx(), replacer({"Bob": "Eve"}))
    assert [t for t, _ in parts("office", ".xlsx", inline)] == ["Alice", "Eve"]


def test_rewrite_files(spark):
    df = spark.createDataFrame([("/a/x.txt", b"hello", {"hello": "bye"}), ("/a/y.json", b'{"k": "hello"}', None)], "path string, content binary, pairs map<string,string>")
    assert {r["path"]: bytes(r["content"]) for r in rewrite_files(df).collect()} == {"/a/x.txt": b"bye", "/a/y.json": b'{"k": "hello"}'}


def test_changed_files_and_options(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert changed_files(str(tmp_path / "nowhere")) == []
    run("init", "-q")
    (tmp_path / "a.txt").write_text("1")
    run("add", "a.txt")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")
    (tmp_path / "a.txt").write_text("2")
    assert changed_files(str(tmp_path)) == [str(tmp_path / "a.txt")] and changed_files(str(tmp_path), True) == []
    assert load_options(str(tmp_path)) == Options()
    save_options(Options(engine="regex", safe=True), str(tmp_path / "veilframe.json"))
    (tmp_path / "sub").mkdir()
    assert load_options(str(tmp_path / "sub")) == Options(engine="regex", safe=True)
    (tmp_path / "veilframe.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        load_options(str(tmp_path))


def test_created_options(tmp_path):
    path = create_options(str(tmp_path))
    assert load_options(str(tmp_path)) == Options()
    save_options(Options(engine="regex"), path)
    assert create_options(str(tmp_path)) == path and load_options(str(tmp_path)).engine == "regex"


def test_process_files(spark):
    rows = [("/a/x.txt", b"v and v", {"v": "W", "d": "D"}), ("/a/y.json", b'{"k": "n"}', {"v": "W"}), ("/a/z.json", b"{broken", {"v": "W"}), ("/a/q.zip", b"", {"v": "W"}), ("/a/none", b"v", None)]
    df = spark.createDataFrame(rows, "path string, content binary, pairs map<string,string>")
    got = {r["path"]: (r["ok"], r["changes"], r["content"] and bytes(r["content"]), bool(r["error"])) for r in process_files(df).collect()}
    assert got == {"/a/x.txt": (True, 3, b"W anD W", False), "/a/y.json": (True, 0, None, False), "/a/z.json": (False, 0, None, True), "/a/q.zip": (False, 0, None, True), "/a/none": (False, 0, None, True)}
    assert {(r["path"], r["changes"], r["content"]) for r in process_files(df, dry=True).filter("ok").collect()} == {("/a/x.txt", 3, None), ("/a/y.json", 0, None)}


def test_replacements_and_their_way_back(spark):
    df = spark.sql("select 'Al and Bo' as t, array(named_struct('start', 0, 'end', 2, 'text', 'Al', 'type', 'PERSON'), named_struct('start', 7, 'end', 9, 'text', 'Bo', 'type', 'PERSON')) as s")
    made = replacements_of(F.col("s"), lambda text, kind: F.concat(F.lit("<"), F.lower(kind), F.lit("-"), F.lower(text), F.lit(">")))
    masked, back = df.select(spliced(F.col("t"), made), originals_of(made)).first()
    assert masked == "<person-al> and <person-bo>" and back == {"<person-al>": "Al", "<person-bo>": "Bo"}


def test_extract_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": ["one", 2, "two"]}')
    (tmp_path / "b.txt").write_text("whole")
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in extract_text(spark, str(tmp_path / "a.json"), str(tmp_path / "b.txt")).collect()} == {"a.json": "one\ntwo", "b.txt": "whole"}


def test_optional_formats():
    told = usable()
    assert told[".txt"] == "ok" and set(optional.capabilities()) == {".pdf", ".xls", ".doc", ".ppt"}
    for suffix, needs in optional.capabilities().items():
        if needs != "ok":
            with pytest.raises(RuntimeError, match=needs):
                optional.optional_segments(suffix, b"")
    assert optional.cell_value(1, " a ") == " a " and optional.cell_value(2, 1.0) == "1.0" and optional.cell_value(2, 0.0) == "0.0" and optional.cell_value(0, "") == "" and optional.cell_value(4, 1) == "1"
    assert optional.paragraph_segments("a\n \nb") == [("a", "para:0", {}), ("b", "para:2", {})]


def test_old_word_files_through_a_program(tmp_path, monkeypatch):
    (tmp_path / "antiword").write_text("#!/bin/sh\ncat\n")
    (tmp_path / "antiword").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert optional.optional_segments(".doc", b"one\n\ntwo") == [("one", "para:0", {}), ("two", "para:2", {})]


class _Page:
    """What a PDF library gives of a page, as far as it is used."""

    def __init__(self, *texts):
        self.spans = [{"text": t, "bbox": (0, 0, 1, 1), "size": 9, "font": "f"} for t in texts]
        self.redacted, self.put = [], []

    def get_text(self, kind="text"):
        return "\n".join(s["text"] for s in self.spans) if kind == "text" else {"blocks": [{"type": 1}, {"type": 0, "lines": [{"spans": self.spans}]}]}

    def add_redact_annot(self, box, fill):
        self.redacted.append(box)

    def apply_redactions(self):
        pass

    def insert_text(self, at, text, fontsize, fontname):
        self.put.append(text)


class _Pdf(list):
    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass

    def save(self, out):
        out.write(repr([p.put for p in self]).encode())


def test_pdf(monkeypatch):
    book = _Pdf([_Page("Alice", " "), _Page("Bob and Alice", "Alice")])
    box = lambda b: types.SimpleNamespace(x0=b[0], y1=b[3])
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: book, Rect=box, __spec__=types.SimpleNamespace(name="fitz")))
    monkeypatch.setattr(optional, "has_library", lambda name: True)
    assert [(t, at) for t, at, _ in optional.pdf_segments(b"")] == [("Alice", "pdf:page0:block1:span0"), ("Bob and Alice", "pdf:page1:block1:span1"), ("Alice", "pdf:page1:block1:span2")]
    assert optional.pdf_text(b"") == "Alice\n \nBob and Alice\nAlice"
    out = rewritten(".pdf", b"", splicer({"pdf:page1:block1:span1": [(8, 13, "Alice", "Carol")]}))
    assert out == b"[[], ['Bob and Carol']]"


def test_model_service(spark):
    tags = {"models": [{"name": "qwen3:4b-instruct"}, {"name": "other:1b"}]}
    ask = lambda url, body, seconds: tags if body is None else {"response": body["prompt"].rsplit("\n", 2)[1].upper()}

    def away(url, body, seconds):
        raise OSError("no one there")

    assert model_service.probe("http://x", "qwen3:4b-instruct", ask).model == "qwen3:4b-instruct" and model_service.probe("http://x", "qwen3:4b", ask).model == "qwen3:4b-instruct"
    assert model_service.probe("http://x", "qwen3:30b", ask).model == "qwen3:30b" and model_service.probe("http://x", "none", ask).model is None
    assert model_service.probe("http://x", "q", away) == model_service.Probe(False)
    for wanted, service, word in (("none", ask, "no model none"), ("q", away, "no model service")):
        with pytest.raises(RuntimeError, match=word):
            model_service.ensured("http://x", wanted, service)
    assert model_service.ensured("http://x", "other:1b", ask) == "other:1b" and "{" in model_service.PROMPT.format(text="t")


def test_asking(spark):
    df = spark.createDataFrame([("piece one",), (None,), ("",)], "t string")
    reply = model_service.asking("http://x", "m", lambda url, body, seconds: {"response": f"{body['model']} {len(body['prompt']) > 100} {body['prompt'].split()[-1]}"})
    assert [r[0] for r in df.select(reply(F.col("t"))).collect()] == ["m True one", None, None]
