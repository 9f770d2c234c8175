"""Readers, vault, engine and streams."""

import io
import json
import re
import zipfile

from pyspark.sql import functions as F

from veilframe.functions.masks import variant
from veilframe.operators import vault as vaults
from veilframe.operators.counters import dense_counter
from veilframe.operators.names import NameRules, find_names, likely_name
from veilframe.operators.tokens import bioes_spans, refined
from veilframe.plans import engine
from veilframe.sources.readers import OFFICE, is_supported, segments
from veilframe.streaming.mask_stream import compacted, mask_stream
from veilframe.types import SPAN

TEXTS = ["联系人：张三，电话：13812345678，邮箱：zhangsan@example.com", "姓名：李四\n电话：13812345678", "nothing", "", None]


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")


def test_mask_hides_and_restore_returns(spark):
    found = engine.detect(docs(spark))
    masked, vault = engine.mask(found, F.lit("p"), vaults.empty_vault(spark))
    rows = {r["doc_id"]: r["masked_text"] for r in masked.collect()}
    for value in ("张三", "13812345678", "zhangsan", "李四"):
        assert all(value not in (t or "") for t in rows.values())
    assert rows[2] == "nothing" and rows[3] == "" and rows[4] is None
    back = engine.restore(masked.select("doc_id", F.col("masked_text").alias("text")), engine.mappings_of(masked))
    assert {r["doc_id"]: r["restored_text"] for r in back.collect()} == dict(enumerate(TEXTS))
    again, vault2 = engine.mask(found, F.lit("p"), vault)
    assert {r["doc_id"]: r["masked_text"] for r in again.collect()} == rows
    assert vault2.count() == vault.count()
    assert vault.groupBy("project_id", "masked_text").count().filter("count > 1").count() == 0


def test_collisions_give_different_masks(spark):
    rows = [("p", f"n{i}", "PERSON", "{{PERSON_000001}}", "regex", 1.0, i) for i in range(120)]
    requests = spark.createDataFrame(rows, "project_id string, original_text string, entity_type string, proposed string, source string, confidence double, first_seen int")
    got = vaults.assign(vaults.empty_vault(spark), requests).collect()
    assert len({r["masked_text"] for r in got}) == 120
    full = spark.createDataFrame([("p", "PERSON", f"x{i}", f"a{i % 10}", "regex", 1.0, None, None) for i in range(10)], vaults.MAPPINGS)
    one = requests.limit(3).withColumn("proposed", F.lit("a1"))
    assert len({r["masked_text"] for r in vaults.assign(full, one).collect()} & {f"a{i}" for i in range(10)}) == 0


def test_one_proposal_for_many(spark):
    """One proposal's rows lie in several parts, and every part's numbers follow those of the part before."""
    n, columns = 5000, ["project_id", "original_text", "entity_type", "proposed", "source", "confidence", "first_seen"]
    requests = spark.range(n).select(F.lit("p").alias("project_id"), F.format_string("n%05d", "id").alias("original_text"), F.lit("PERSON").alias("entity_type"), F.lit("{{PERSON_000001}}").alias("proposed"), F.lit("regex").alias("source"), F.lit(1.0).alias("confidence"), F.col("id").alias("first_seen"))
    done = vaults.assign(vaults.empty_vault(spark), requests.select(*columns))
    got = {r["original_text"]: r["masked_text"] for r in done.collect()}
    assert len(got) == n == len(set(got.values())) and got["n00000"] == "{{PERSON_000001}}" and got["n04999"] == "{{PERSON_005000}}"
    numbered = dense_counter(requests.withColumn("project_id", F.lit(None).cast("string")), ["project_id", "proposed"], ["first_seen"], "rank", "width")
    assert [(r["rank"], r["width"]) for r in numbered.orderBy("first_seen").collect()] == [(k, n) for k in range(n)]
    plan = re.sub("#[0-9]+L?", "", done._jdf.queryExecution().toString())
    assert "windowspecdefinition(project_id, proposed, first_seen" not in plan


def test_one_proposal_for_more_than_four_digits_count(spark):
    """Numbers go on behind 9999: all digits of a mask may count, and a token's number grows beyond them."""
    n, columns = 10_050, ["project_id", "original_text", "entity_type", "proposed", "source", "confidence", "first_seen"]
    requests = spark.range(n).select(F.lit("p").alias("project_id"), F.format_string("n%05d", "id").alias("original_text"), F.lit("PERSON").alias("entity_type"), F.lit("{{PERSON_000001}}").alias("proposed"), F.lit("regex").alias("source"), F.lit(1.0).alias("confidence"), F.col("id").alias("first_seen"))
    for proposed, last in (("{{PERSON_000001}}", "{{PERSON_010050}}"), ("{{PERSON_001}}", "{{PERSON_10050}}"), ("139-0000-0001", "139-0001-0050")):
        got = {r["original_text"]: r["masked_text"] for r in vaults.assign(vaults.empty_vault(spark), requests.withColumn("proposed", F.lit(proposed)).select(*columns)).collect()}
        assert len(got) == n == len(set(got.values())) and got["n00000"] == proposed and got["n10049"] == last
    grown = spark.range(1).select(variant(F.lit("{{PERSON_000001}}"), F.lit(1_234_567)).alias("v"), variant(F.lit("a1"), F.lit(12)).alias("w")).first()
    assert grown["v"] == "{{PERSON_1234567}}" and grown["w"] == "a2"


def test_names():
    rules = NameRules()
    first = find_names("联系人：王小明，到场", rules)[0]
    assert (first["text"], first["reason"], first["start"]) == ("王小明", "colon_structure", 4)
    for word in ("高级教师", "单位", "范围", "任务", "程序"):
        assert all(x["text"] != word for x in find_names(f"这是一个{word}的测试", rules))
    assert find_names("淳安县列入名单，杭州市同步推进。", rules) == []
    assert likely_name("欧阳小雪", rules) and not likely_name("张力", rules)
    assert [x["text"] for x in find_names("王芳 李娜 张伟", rules)] == ["王芳", "李娜", "张伟"]


def test_bioes_and_refined(spark):
    text = "姓名: 杨嘉明 电话: 18606518817"
    tokens = spark.createDataFrame([(1, 0, "O", 0, 3), (1, 1, "B-private_person", 3, 5), (1, 2, "I-private_person", 5, 6), (1, 3, "E-private_person", 6, 7), (1, 4, "O", 7, 12), (1, 5, "S-private_phone", 11, 23), (1, 6, "I-secret", 3, 3)], "doc_id int, tok int, label string, start int, end int")
    got = sorted((r["type"], r["text"], r["start"]) for r in bioes_spans(tokens, spark.createDataFrame([(1, text)], "doc_id int, text string")).collect())
    assert got == [("PERSON", "杨嘉明", 4), ("PHONE", "18606518817", 12)]
    school = "2001年9月浙江幼儿师范学校学习"
    df = spark.createDataFrame([([(0, 5, 5 + len(school), school, "DATE_TIME", "privacy_filter", 1.0, "privacy_filter:private_date"), (1, 0, 7, "1971.11", "DATE_TIME", "privacy_filter", 1.0, "privacy_filter:private_date")],)], f"s array<{SPAN}>")
    a, b = df.select(refined(F.col("s")).alias("s")).first()["s"]
    assert a["type"] == "ORG" and a["text"].endswith("学校") and b["text"] == "1971.11" and b["type"] == "DATE_TIME"


def _docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>张</w:t></w:r><w:r><w:t>三</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def _xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Alice</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Bob</t></is></c><c r="C1"><v>5</v></c><c r="D1" t="s"><v>9</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    files = {"a.txt": "中文".encode("gbk"), "b.md": b"x `code` y", "c.json": json.dumps({"a": {"b": ["v", 1, " "]}}).encode(), "d.csv": b"h1,h2\n1,two\n", "e.docx": _docx(), "f.xlsx": _xlsx(), "g.bin": b"?"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in segments(spark, *[str(tmp_path / n) for n in files]).orderBy("path", "seg_no").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["text"], r["location"], r["start_offset"]))
    assert got["a.txt"] == [("中文", "file", 0)]
    assert got["b.md"] == [("x ", "text:0-2", 0), (" y", "text:8-10", 8)]
    assert got["c.json"] == [("v", "json:a.b[0]", 0)]
    assert [x[:2] for x in got["d.csv"]] == [("h1", "csv:row0:col0"), ("h2", "csv:row0:col1"), ("1", "csv:row1:col0"), ("two", "csv:row1:col1")]
    assert [x[0] for x in got["e.docx"]] == ["张三", "b"] and got["e.docx"][1][2] == 3
    assert [x[:2] for x in got["f.xlsx"]] == [("Alice", "xl/worksheets/sheet1.xml:A1"), ("Bob", "xl/worksheets/sheet1.xml:B1")]
    assert "g.bin" not in got and is_supported("X.DOCX") and not is_supported("x") and len(OFFICE) == 3


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    docs(spark).filter("text is not null").coalesce(1).write.parquet(str(source))
    q = mask_stream(spark.readStream.schema("doc_id int, text string").parquet(str(source)), F.lit("p"), str(tmp_path / "vault"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 4 and all("13812345678" not in r["masked_text"] for r in rows)
    first = {r["doc_id"]: r["masked_text"] for r in rows}
    docs(spark).filter("doc_id < 2").withColumn("doc_id", F.col("doc_id") + 10).coalesce(1).write.mode("append").parquet(str(source))
    q = mask_stream(spark.readStream.schema("doc_id int, text string").parquet(str(source)), F.lit("p"), str(tmp_path / "vault"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert q.exception() is None
    again = {r["doc_id"]: r["masked_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert again[10] == first[0] and again[11] == first[1]
    parts = spark.read.schema(f"{vaults.MAPPINGS}, v int").parquet(str(tmp_path / "vault"))
    assert sorted({r["v"] for r in parts.collect()}) == [0, 1] and compacted(parts.drop("v")).count() == parts.filter("v = 0").count()
