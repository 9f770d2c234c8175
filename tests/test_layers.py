"""Names among words, documents with sheets, replies of models, edits where they belong, and wrapped commands."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_engine import _docx, _xlsx

from veilframe.__main__ import main, shell_functions
from veilframe.functions.expr import matches
from veilframe.operators import detect as layers
from veilframe.operators import name_words
from veilframe.operators.merge import deduplicated, first_wins
from veilframe.operators.names import NameRules, find_names, likely_name
from veilframe.operators.recognisers import PATTERNS, analysed, verified
from veilframe.operators.smart_names import closed_up, smart_layer, smart_names, valid_name, verdicts, word_confidence
from veilframe.operators.tokens import scan_and_rewrite, scanned, sectioned_reply
from veilframe.plans import engine
from veilframe.sources.readers import _SEGMENTERS, segments
from veilframe.sources.writers import edits_of, rewritten, splice_files


def test_word_lists_are_whole():
    assert len(set(name_words.SURNAMES)) == len(name_words.SURNAMES) > 230 and len(name_words.COMPOUND) == 24
    assert "傅" in name_words.PATTERN_SURNAMES and "宋" not in name_words.PATTERN_SURNAMES and "宋" in name_words.SURNAMES
    rules = NameRules()
    for word in ("郑重", "高效", "金融", "方法", "程序", "中国", "北京", "研究", "公司", "蔡司", "月份", "高科技", "计算机", "联系人", "任务书", "郑重承诺"):
        assert not likely_name(word, rules), word
    for name in ("王芳", "欧阳小雪", "温家文", "翟天", "晏殊文", "花木兰"):
        assert likely_name(name, rules), name
    assert find_names("联系人：晏小花，到", rules)[0]["text"] == "晏小花"


def words_of(parts):
    def segment(text):
        at = 0
        while at < len(text):
            part = next((p for p in parts if text.startswith(p, at)), text[at])
            yield part, at, at + len(part)
            at += len(part)

    return segment


def test_names_among_words():
    segment = words_of(["王小明", "高级教师", "高中数学", "韩潇", "淳安县", "李娜", "老师", "张三丰"])
    found = smart_names("王小明老师高级教师，高中数学由韩  潇老师教，淳安县", segment)
    assert [(x["text"], x["start"], x["end"], x["reason"]) for x in found] == [("王小明", 0, 3, "jieba_word_name"), ("韩潇", 15, 19, "jieba_word_name+normalized")]
    assert found[0]["confidence"] == pytest.approx(0.95)
    assert smart_names("他李娜去", segment) == [] and [x["text"] for x in smart_names("姓名：李娜", segment, strict=True)] == ["李娜"]
    assert word_confidence("姓名：李娜", 3, 5) == pytest.approx(0.95) and word_confidence("李娜", 0, 2) == 0.5
    assert smart_names("没有分词", None) == [] and valid_name("欧阳小雪") and not valid_name("淳安县") and not valid_name("高级教师") and not valid_name("A王")
    assert closed_up("韩 　潇 a 王") == ("韩潇 a 王", [0, 3, 4, 5, 6, 7])
    people = smart_names("张三丰 met", None, lambda t: [(0, 3, "PERSON"), (4, 7, "PERSON"), (0, 3, "ORG")])
    assert [(x["text"], x["reason"]) for x in people] == [("张三丰", "spacy_ner:PERSON")]


def test_verdicts_of_a_model():
    assert verdicts("Y\nn\n1. Y\n2. N\nmaybe\n") == [True, False, True, False, True]
    segment, asked = words_of(["王小明", "李娜", "老师"]), []

    def judge(text, names):
        asked.append((text, names))
        return "Y\nN"

    found = smart_names("王小明老师，李娜老师", segment, judge=judge)
    assert [(x["text"], x["reason"]) for x in found] == [("王小明", "jieba_word_name+llm_kept")] and asked == [("王小明老师，李娜老师", ["王小明", "李娜"])]


def test_smart_layer_is_a_layer(spark):
    layers.register("words", lambda text: smart_layer(text, words_of(["王小明"])), 45)
    try:
        docs = spark.createDataFrame([(1, "姓名：王小明"), (2, None), (3, "none")], "doc_id int, text string")
        got = {r["doc_id"]: [x["text"] for x in r["spans"]] for r in engine.detect(docs, "words").collect()}
        assert got == {1: ["王小明"], 2: [], 3: []}
    finally:
        layers.LAYERS.pop("words")
    for name in ("qwen", "privacy-filter", "nope"):
        with pytest.raises(ValueError):
            engine.detect(docs, name)


def test_pattern_engine(spark):
    docs = spark.createDataFrame([(1, "联系人 傅小花 13812345678"), (2, "宋小花")], "doc_id int, text string")
    got = {r["doc_id"]: [(x["text"], x["type"], round(x["confidence"], 2)) for x in r["s"]] for r in docs.select("doc_id", analysed(F.col("text")).alias("s")).collect()}
    assert ("13812345678", "PHONE_NUMBER", 0.9) in got[1] and ("傅小花", "PERSON", 0.85) in got[1] and got[2] == []
    only = docs.select(analysed(F.col("text"), ["PHONE_NUMBER"]).alias("s")).first()["s"]
    assert [x["type"] for x in only] == ["PHONE_NUMBER"] and len(PATTERNS) == 7
    said = docs.filter("doc_id = 1").select(verified(analysed(F.col("text")), F.lit("傅小花:N, 13812345678:Y")).alias("s")).first()["s"]
    assert [(x["text"], x["source"], round(x["confidence"], 2)) for x in said if x["type"] == "PHONE_NUMBER"] == [("13812345678", "llm_judge", 1.0)] and not any(x["text"] == "傅小花" for x in said)
    assert [x["type"] for r in engine.detect(docs, "presidio").collect() for x in r["spans"] if x["type"] == "PHONE_NUMBER"] == ["PHONE_NUMBER"]


def test_hybrid_layers_together(spark):
    text = "申报人：何黎明\n电话：18606518817\n个人主页：https://person.zju.edu.cn/zhaojunbo\nAlice Smith lives at 12 3rd St.\n"
    model = lambda t: F.concat(F.transform(matches(t, "Alice Smith"), lambda x: layers.span(x, "PERSON", "privacy_filter", 1.0, "m")), F.transform(matches(t, "12 3rd St"), lambda x: layers.span(x, "ADDRESS", "privacy_filter", 1.0, "m")))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    found = {r["doc_id"]: {x["text"]: (x["type"], x["source"]) for x in r["spans"]} for r in engine.detect_documents(docs, None, model).collect()}
    want = {"何黎明": ("PERSON", "schema"), "18606518817": ("PHONE", "regex"), "https://person.zju.edu.cn/zhaojunbo": ("URL", "regex"), "Alice Smith": ("PERSON", "privacy_filter"), "12 3rd St": ("ADDRESS", "privacy_filter")}
    assert found == {1: want, 2: {}, 3: {}}
    layers.register("test_model", model, 80, hybrid=True)
    try:
        assert {x["text"]: (x["type"], x["source"]) for x in engine.detect(docs).filter("doc_id = 1").first()["spans"]} == want
    finally:
        layers.MODELS.discard("test_model")
        layers.LAYERS.pop("test_model")


def test_rows_of_a_sheet_replace_its_text(spark):
    cells = [(1, "s", "A1", "序号", 0, 2), (1, "s", "B1", "姓名", 3, 5), (1, "s", "A2", "Bob", 6, 9), (1, "s", "B2", "Alice", 10, 15), (1, "s", "A3", "x", 16, 17), (1, "s", "B3", "Carol", 18, 23)]
    docs = spark.createDataFrame([(1, "序号\n姓名\nBob\nAlice\nx\nCarol"), (2, "Bob and Alice")], "doc_id int, text string")
    table = spark.createDataFrame(cells, "doc_id int, part string, cell string, text string, start_offset int, end_offset int")
    model = lambda t: F.transform(matches(t, "[A-Z][a-z]+"), lambda x: layers.span(x, "PERSON", "privacy_filter", 1.0, "m"))
    got = {r["doc_id"]: [(x["start"], x["end"], x["text"], x["reason"]) for x in r["spans"]] for r in engine.detect_documents(docs, table, model).collect()}
    assert got == {1: [(10, 15, "Alice", "m+row_context"), (18, 23, "Carol", "m+row_context")], 2: [(0, 3, "Bob", "m"), (8, 13, "Alice", "m")]}


def test_sections_of_a_reply(spark):
    reply = "ok\n===脱敏文本===\n 你好 [A] \n===映射表===\n张三 -> 赵甲 | PERSON\n李四->赵甲|\n王五 -> 钱乙\nnonsense\nx | y -> z\n张三 -> 孙丙 | NAME\n"
    row = spark.createDataFrame([(reply,), ("plain",)], "r string").select(sectioned_reply(F.col("r")).alias("s"), "r").collect()
    got = {r["r"][:2]: r["s"] for r in row}
    assert got["ok"]["text"] == "你好 [A]" and got["ok"]["mappings"] == {"李四": "赵甲2", "王五": "钱乙", "张三": "孙丙"} and got["ok"]["types"] == {"王五": "UNKNOWN", "张三": "NAME"}
    assert got["pl"]["text"] == "plain" and got["pl"]["mappings"] == {} == got["pl"]["types"]


def test_scan_and_rewrite(spark):
    docs = spark.createDataFrame([(1, "张三 13812345678\n" + "x" * 30 + "\n张三丰"), (2, "none"), (3, None)], "doc_id int, text string")
    made = json.dumps({"entities": [{"text": "张三", "type": "name"}, {"text": "13812345678", "type": "PHONE"}]}, ensure_ascii=False)
    ask = lambda piece: F.when(F.contains(piece, F.lit("138")), made).when(F.contains(piece, F.lit("张三丰")), '{"entities": [{"text": "张三丰", "type": "PERSON"}, {"text": "张三", "type": "OTHER"}]}').otherwise("{}")
    named = {(r["doc_id"], r["original"], r["type"]) for r in scanned(docs.filter("text is not null"), ask, 20).collect()}
    assert named == {(1, "张三", "NAME"), (1, "13812345678", "PHONE"), (1, "张三丰", "PERSON")}
    out = {r["doc_id"]: r for r in scan_and_rewrite(docs, ask, 20).collect()}
    assert "张三" not in out[1]["text"] and "138" not in out[1]["text"][:20] or "13812345678" not in out[1]["text"]
    assert set(out[1]["mappings"]) == {"张三", "张三丰", "13812345678"} and len(set(out[1]["mappings"].values())) == 3
    assert out[2]["text"] == "none" and out[2]["mappings"] == {} and out[3]["text"] is None


def test_only_the_chosen_place_is_masked(spark, tmp_path):
    for name, data in {"a.txt": b"Alice is public. Alice is private.", "b.csv": b"n,m\nAlice,Alice\n", "c.md": b"Alice `Alice` Alice", "d.xlsx": _xlsx(), "e.docx": _docx()}.items():
        (tmp_path / name).write_bytes(data)
    segs = segments(spark, *[str(p) for p in sorted(tmp_path.iterdir())])
    docs = segs.groupBy("path", "format").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text", "location", "start_offset"))).alias("s"))
    at = "transform(s, (x, i) -> named_struct('seg_no', x.seg_no, 'text', x.text, 'location', x.location, 'start_offset', x.start_offset, 'joined_start', cast(length(array_join(transform(slice(s, 1, i), y -> y.text), '\n')) + if(i > 0, 1, 0) as int)))"
    placed = docs.withColumn("text", F.array_join(F.transform("s", lambda x: x["text"]), "\n")).withColumn("s", F.expr(at))
    placed = placed.withColumn("s", F.transform("s", lambda x: x.withField("joined_end", x["joined_start"] + F.length(x["text"]))))
    last = F.length("text") - F.length(F.substring_index("text", "Alice", -1)) - 5
    only = F.when(F.contains("text", F.lit("Alice")), F.array(F.struct(last.alias("start"), (last + 5).alias("end"), F.lit("Alice").alias("original"), F.lit("Carol").alias("masked")))).otherwise(F.array().cast("array<struct<start:int,end:int,original:string,masked:string>>"))
    edits = placed.select("path", edits_of(F.col("s"), only, F.col("format").isin("text", "markdown")).alias("edits"))
    files = spark.read.format("binaryFile").load([str(p) for p in tmp_path.iterdir()]).select("path", "content")
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in splice_files(files.join(edits, "path")).collect()}
    assert got["a.txt"] == b"Alice is public. Carol is private." and got["b.csv"] == b"n,m\r\nAlice,Carol\r\n" and got["c.md"] == b"Alice `Alice` Carol"
    assert [t for t, _, _ in _SEGMENTERS["office"](".xlsx", got["d.xlsx"])] == ["Carol", "Bob"] and [t for t, _, _ in _SEGMENTERS["office"](".docx", got["e.docx"])] == ["张三", "b"]


def test_yaml():
    pytest.importorskip("yaml")
    data = "a:\n  b: [x, 1, ' ']\nc: 中文\n".encode()
    assert [(t, at) for t, at, _ in _SEGMENTERS["yaml"](".yaml", data)] == [("x", "yaml:a.b[0]"), ("中文", "yaml:c")]
    assert "中文" not in rewritten(".yml", data, lambda at, text: "new" if at == "yaml:c" else text).decode()


def test_yaml_that_is_none_stays_a_text():
    assert [t for t, _, _ in _SEGMENTERS["yaml"](".yaml", b"a: [unclosed")] == ["a: [unclosed"]


def test_repeated_and_overlapping_spans(spark):
    span = lambda a, b, sure, kind="PERSON": (0, a, b, "x", kind, "regex", sure, None)
    rows = [span(0, 3, 0.5), span(0, 3, 0.9), span(2, 5, 1.0), span(6, 8, 0.1), span(0, 3, 0.5, "URL")]
    df = spark.createDataFrame([(rows,)], "s array<struct<seq:int,start:int,end:int,text:string,type:string,source:string,confidence:double,reason:string>>")
    a, b = df.select(deduplicated(F.col("s")), first_wins(layers.numbered(F.col("s")))).first()
    assert [(x["start"], x["confidence"], x["type"]) for x in a] == [(0, 0.5, "PERSON"), (2, 1.0, "PERSON"), (6, 0.1, "PERSON"), (0, 0.5, "URL")]
    assert [(x["start"], x["confidence"]) for x in b] == [(0, 0.9), (6, 0.1)]


def test_each_pattern_stands_few_times_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "联系人：张三")], "doc_id int, text string")
    plan = engine.detect(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3 * 9


def test_wrapped_commands(spark, tmp_path, capfd):
    root = tmp_path / "work"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("old.txt", "new.txt", "data.bin"):
        (root / name).write_text("start")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")
    (root / "old.txt").write_text("changed before")
    tool = tmp_path / "tool.py"
    tool.write_text("import sys\nfor n in ('new.txt', 'data.bin'):\n    open(n, 'w').write('got ' + sys.argv[2])\nprint(sys.argv[1:])\nsys.exit(3)\n")
    common = ["--vault", str(tmp_path / "vault"), "--project", "p", "--root", str(root)]
    command = ["--", sys.executable, str(tool), "--flag", "联系人：张三，电话：13812345678"]
    assert main(["exec", "--dry-run", *common, *command]) == 0 and not (tmp_path / "vault").exists()
    shown = capfd.readouterr().out
    assert "张三" not in shown and "13812345678" not in shown and "--flag" in shown
    assert main(["exec", *common, *command]) == 3
    shown = capfd.readouterr().out
    assert "张三" not in shown and "restored" in shown
    assert (root / "new.txt").read_text() == "got 联系人：张三，电话：13812345678" and (root / "old.txt").read_text() == "changed before"
    assert "张三" not in (root / "data.bin").read_text()
    assert main(["run", *common, "--no-restore", "--", "no-such-command-here"]) == 1
    assert shell_functions(["tool", "bad name;"]).count("exec -- tool") == 1 and "bad" not in shell_functions(["bad name;"])
