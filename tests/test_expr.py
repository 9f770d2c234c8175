"""Expressions against plain Python on random inputs."""

import random
import re

from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.functions.expr import base36, fill_digits, matches, occurrences, valid_identity
from veilframe.operators import detect, merge, splice
from veilframe.operators.detect import numbered
from veilframe.types import SPAN


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def test_match_offsets_count_code_points(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab@.c😀中 \n1") for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", "a@b.cc", "😀x@y.zz"]
    pattern = "[a-c1]+@[a-c.]+"
    got = {r["i"]: [(x["start"], x["end"], x["text"]) for x in r["m"]] for r in rows(spark, texts).select("i", matches(F.col("t"), pattern).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(*m.span(), m[0]) for m in re.finditer(pattern, t)]


def test_layers_on_known_texts(spark):
    cases = {
        "联系人：张三，电话：13812345678，邮箱：zhangsan@example.com": [("PERSON", "张三"), ("PHONE", "13812345678"), ("EMAIL", "zhangsan@example.com")],
        "申报人：何黎明\n联系电话：18606518817\n学号：202401230045\nAPI Key: sk-live-test-token\n": [("PERSON", "何黎明"), ("ACCOUNT_NUMBER", "202401230045"), ("SECRET", "sk-live-test-token"), ("PHONE", "18606518817")],
        "姓名\n何黎明\n学号\n202401230045\nToken\nsk-live-test-token\n": [("PERSON", "何黎明"), ("ACCOUNT_NUMBER", "202401230045"), ("SECRET", "sk-live-test-token")],
        "申报单位：杭州市教育局\n": [],
        "姓名\n专业\n个人主页\n手机号码\n": [],
        'token = "abcdef123456"': [],
        "电话 138-1234-5678，1381234567": [("PHONE", "138-1234-5678")],
        "全角 １３８": [],
    }
    df = rows(spark, list(cases)).select("t", F.concat(detect.schema_layer(F.col("t")), detect.regex_layer(F.col("t"))).alias("s"))
    for r in df.collect():
        assert [(x["type"], x["text"]) for x in r["s"]] == cases[r["t"]], r["t"]
        for x in r["s"]:
            assert r["t"][x["start"] : x["end"]] == x["text"]


def test_nulls_and_empty_texts_have_no_spans(spark):
    df = rows(spark, [None, ""]).select(F.size(detect.detected(F.col("t"))).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 0]


def plain_merge(spans, text):
    """The rules of merging, written as a loop."""
    source = {"schema": 100, "regex": 90, "privacy_filter": 80, "heuristic": 50}
    rank = {"SECRET": 110, "PHONE": 100, "URL": 95, "ORG": 40, "PERSON": 30}
    pri = lambda s: source[s["source"]] + (s["end"] - s["start"]) / 100.0 + s["confidence"]
    tp = lambda s: rank.get(s["type"], 0)
    inside = lambda a, b: a["start"] <= b["start"] and b["end"] <= a["end"]

    def wins(a, b):
        if inside(a, b) and pri(a) > pri(b) or tp(a) > tp(b) + 20:
            return True
        return (a["start"], a["end"]) == (b["start"], b["end"]) and (a["source"] == "schema" or a["source"] == "regex" and b["source"] not in ("schema", "regex"))

    good = [s for s in spans if text[s["start"] : s["end"]] == s["text"] and 0 < s["end"] - s["start"] <= 256]
    kept = []
    for s in sorted(good, key=lambda s: (s["start"], -pri(s), -(s["end"] - s["start"]))):
        rivals = [k for k in kept if max(k["start"], s["start"]) < min(k["end"], s["end"])]
        if any(inside(k, s) and tp(k) >= tp(s) or not wins(s, k) and wins(k, s) for k in rivals):
            continue
        kept = [k for k in kept if not (k in rivals and wins(s, k))] + [s]
    return sorted(kept, key=lambda s: s["start"])


def test_merge_against_a_loop(spark):
    rng, text = random.Random(2), "abcdefghijklmnopqrst" * 2
    sets = []
    for _ in range(300):
        own = []
        for _ in range(rng.randrange(0, 7)):
            a = rng.randrange(0, 30)
            b = a + rng.randrange(0, 9)
            own.append((0, a, b, text[a:b] if rng.random() < 0.95 else "?", rng.choice(["SECRET", "PHONE", "URL", "ORG", "PERSON", "NRP"]), rng.choice(["schema", "regex", "privacy_filter", "heuristic"]), rng.choice([0.5, 0.9, 1.0]), None))
        sets.append(own)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], f"i int, s array<{SPAN}>")
    got = {r["i"]: r["m"] for r in df.select("i", merge.merged(numbered(F.col("s")), F.lit(text)).alias("m")).collect()}
    names = ["seq", "start", "end", "text", "type", "source", "confidence", "reason"]
    for i, own in enumerate(sets):
        want = plain_merge([dict(zip(names, s, strict=True)) | {"seq": k} for k, s in enumerate(own)], text)
        assert [(x["start"], x["end"], x["type"], x["source"]) for x in got[i]] == [(x["start"], x["end"], x["type"], x["source"]) for x in want], own
    safe = df.select(merge.merged(numbered(F.col("s")), F.lit(text), True).alias("m")).collect()
    for r in safe:
        assert all(a["end"] <= b["start"] for a, b in zip(r["m"], r["m"][1:]))


def test_recogniser_strategies(spark):
    span = lambda a, b, c: (0, a, b, "", "PERSON", "regex", c, None)
    df = spark.createDataFrame([([span(0, 5, 0.5), span(3, 10, 0.9), span(12, 14, 0.3)],)], f"s array<{SPAN}>")
    found = {k: [(x["start"], x["end"]) for x in df.select(merge.recognised(numbered(F.col("s")), k).alias("m")).first()["m"]] for k in ("highest_score", "longest", "first")}
    assert found == {"highest_score": [(3, 10), (12, 14)], "longest": [(3, 10), (12, 14)], "first": [(0, 5), (12, 14)]}


def test_masks_keep_their_form(spark):
    cases = [("PERSON", "欧阳小雪", "{{PERSON_000001}}"), ("PHONE", "138-1234-5678", "130-0000-0000"), ("EMAIL", "test@example.com", "u000@example.com"), ("ADDRESS", "北京市xx路123号", "某某某XX某000某"), ("DATE_TIME", "2024年01月15日", "0000年00月00日"), ("URL", "https://example.com/user/123", "https://example.com/U000XXXX"), ("ACCOUNT_NUMBER", "4111111111111111", "0" * 16), ("SECRET", "sk-test-secret", "＊" * 13 + "0"), ("ORG", "浙江大学", "组织00"), ("URL", "https://a.cn", "https://a.cn")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, k string, v string")
    got = {r["i"]: r["m"] for r in df.select("i", masks.mask(F.col("k"), F.col("v"), F.lit(0)).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_identity_masks_are_valid(spark):
    df = spark.range(0, 3000, 7).select(masks.mask(F.lit("IDCN"), F.lit("11010119880101123X"), F.col("id")).alias("m"))
    assert df.filter(~valid_identity(F.col("m")) | (F.length("m") != 18)).count() == 0


def test_splice_and_replace(spark):
    df = spark.createDataFrame([("Alice is public. Alice is private.", [(17, 22, "Alice", "Carol"), (0, 3, "Bob", "x")])], "t string, r array<struct<start:int,end:int,original:string,masked:string>>")
    r = df.select(splice.spliced(F.col("t"), F.col("r")).alias("a"), splice.valid_replacements(F.col("t"), F.col("r")).alias("n"), splice.replaced(F.col("t"), F.create_map(F.lit("is"), F.lit("1"), F.lit("is public"), F.lit("2"))).alias("b"), occurrences(F.col("t"), F.lit("i")).alias("c"), fill_digits(F.lit("a1b22"), F.lit("987")).alias("d"), base36(F.lit(1295)).alias("e")).first()
    assert tuple(r) == ("Alice is public. Carol is private.", 1, "Alice 2. Alice 1 private.", 6, "a9b87", "ZZ")
