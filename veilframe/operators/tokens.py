"""Spans from token labels, row context of sheets, and pieces of text for a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.expr import column_number, empty, let
from veilframe.functions.masks import mask
from veilframe.operators.splice import replaced
from veilframe.types import FILTER_LABELS, MODEL_TYPES


def label_type(label: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, kind in FILTER_LABELS.items():
        out = F.when(label == name, kind).otherwise(out)
    return out


def model_type(kind: Column) -> Column:
    """Entity type of what a language model calls a value."""
    name, out = F.upper(F.trim(F.coalesce(kind, F.lit("")))), F.lit("UNKNOWN")
    for key, value in MODEL_TYPES.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def bioes_spans(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, start, end, text, type, label from tokens (doc_id, tok, label, start, end) and texts (doc_id, text).

    Runs are told apart by gaps and islands: a token begins one at B or S, behind an O, an E or an S, and where the
    label changes. Tokens of no width don't count; labels without a known prefix stand alone. Blanks at the edges
    are trimmed and empty spans dropped.
    """
    raw = F.coalesce("label", F.lit(""))
    prefix = F.when(raw.isin("", "O"), "O").when(raw.rlike("^[BIES]-"), F.substring(raw, 1, 1)).otherwise("S")
    name = F.when(raw.contains("-"), F.regexp_extract(raw, "^[^-]*-(.*)$", 1)).otherwise(raw)
    own = tokens.filter("start != end").select("doc_id", "tok", "start", "end", prefix.alias("p"), name.alias("l"))
    order = Window.partitionBy("doc_id").orderBy("tok")
    fresh = F.col("p").isin("B", "S") | F.lag("p", 1, "O").over(order).isin("O", "E", "S") | (F.lag("l").over(order) != F.col("l"))
    runs = own.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(order)).filter("p != 'O'")
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("l").alias("label")).join(texts, "doc_id")
    part = F.substring("text", F.col("start") + 1, F.least("end", F.length("text")) - F.col("start"))
    left = F.length(part) - F.length(F.regexp_replace(part, "(?U)^\\s+", ""))
    body = F.regexp_replace(part, "(?U)^\\s+|\\s+$", "")
    return spans.select("doc_id", (F.col("start") + left).cast("int").alias("start"), (F.col("start") + left + F.length(body)).cast("int").alias("end"), body.alias("text"), label_type(F.col("label")).alias("type"), "label").filter("end > start")


_SCHOOL = "[\\u4e00-\\u9fff]{2,30}(?:学校|大学|学院|幼儿园|中学|小学|师范学校)"


def refined(spans: Column) -> Column:
    """Date spans of the model that swallowed a school's name give way to that name, as an organisation."""

    def of(x: Column) -> Column:
        name = F.regexp_extract(x["text"], _SCHOOL, 0)
        start = x["start"] + F.instr(x["text"], name) - 1
        told = (x["type"] == "DATE_TIME") & F.contains(F.coalesce(x["reason"], F.lit("")), F.lit("privacy_filter:private_date")) & ((F.length(x["text"]) > 16) | x["text"].rlike("[\\u4e00-\\u9fff]")) & x["text"].rlike("学习|毕业|结业|专业") & (name != "")
        new = x.withField("start", start.cast("int")).withField("end", (start + F.length(name)).cast("int")).withField("text", name).withField("type", F.lit("ORG")).withField("source", F.lit("privacy_filter")).withField("reason", F.lit("privacy_filter:private_date_refined_org"))
        return F.when(told, new).otherwise(x)

    return F.transform(spans, of)


# Words in the headers of columns that hold personal data.
HEADER_HINTS = ("姓名", "个人主页", "手机", "手机号码", "联系电话", "电话", "邮箱", "电子邮箱", "身份证", "证件号", "学号", "工号")


def _hinted(value: Column) -> Column:
    out = F.lit(False)
    for hint in HEADER_HINTS:
        out = out | F.contains(value, F.lit(hint))
    return out


def row_context(cells: DataFrame) -> DataFrame:
    """doc_id, part, row, line, values from cells (doc_id, part, cell, text, start_offset, end_offset).

    A part's header is its first row of two filled cells or more with a hint word among them. Every later row
    becomes a line "header: value | ..." of the columns that have both; values (array of start, end, original_start,
    original_end, original_text) tells where in the line the values under hinted headers stand.
    """
    name = F.regexp_replace("cell", "\\$", "")
    own = cells.select("doc_id", "part", F.regexp_extract(name, "[0-9]+", 0).cast("int").alias("row"), column_number(F.regexp_extract(name, "[A-Za-z]+", 0)).alias("col"), F.trim("text").alias("value"), "text", "start_offset", "end_offset").filter("value != ''")
    rows = own.groupBy("doc_id", "part", "row").agg(F.count("*").alias("n"), F.max(_hinted(F.col("value"))).alias("hinted"))
    head = rows.filter("n >= 2 and hinted").groupBy("doc_id", "part").agg(F.min("row").alias("head"))
    placed = own.join(head, ["doc_id", "part"])
    headers = placed.filter("row = head").select("doc_id", "part", "col", F.col("value").alias("header"))
    body = placed.filter("row > head").join(headers, ["doc_id", "part", "col"])
    entry = F.struct("col", "header", "value", "text", "start_offset", "end_offset", _hinted(F.col("header")).alias("hinted"))
    lines = body.groupBy("doc_id", "part", "row").agg(F.array_sort(F.collect_list(entry)).alias("cells"))
    kind = "struct<start:int,end:int,original_start:int,original_end:int,original_text:string>"

    def step(acc: Column, c: Column) -> Column:
        lead = F.concat(F.when(acc["line"] == "", "").otherwise(" | "), c["header"], F.lit(": "))
        start = F.length(acc["line"]) + F.length(lead)
        value = F.struct(start.cast("int").alias("start"), (start + F.length(c["value"])).cast("int").alias("end"), c["start_offset"].cast("int").alias("original_start"), c["end_offset"].cast("int").alias("original_end"), c["text"].alias("original_text"))
        return F.struct(F.concat(acc["line"], lead, c["value"]).alias("line"), F.when(c["hinted"], F.concat(acc["values"], F.array(value))).otherwise(acc["values"]).alias("values"))

    folded = F.aggregate("cells", F.struct(F.lit("").alias("line"), empty(kind).alias("values")), step)
    return lines.select("doc_id", "part", "row", folded.alias("f")).select("doc_id", "part", "row", "f.line", "f.values")


def mapped_back(spans: Column, values: Column) -> Column:
    """Spans in a context line as spans in the document: those inside a value, by the first value that holds them."""

    def of(x: Column) -> Column:
        hit = F.get(F.filter(values, lambda v: (v["start"] <= x["start"]) & (x["end"] <= v["end"])), F.lit(0))
        start = hit["original_start"] + x["start"] - hit["start"]
        text = F.substring(hit["original_text"], x["start"] - hit["start"] + 1, x["end"] - x["start"])
        return F.when(hit.isNotNull(), x.withField("start", start).withField("end", start + x["end"] - x["start"]).withField("text", text).withField("reason", F.concat(F.coalesce(F.concat(x["reason"], F.lit("+")), F.lit("")), F.lit("row_context"))))

    return F.filter(F.transform(spans, of), lambda x: x.isNotNull() & (x["text"] != ""))


def line_chunks(text: Column, most: int = 1800) -> Column:
    """A text in pieces of whole lines, each of `most` characters at most unless one line alone is longer."""
    lines = F.filter(F.split(text, "(?<=\\n)"), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        full = (acc["buffer"] != "") & (F.length(acc["buffer"]) + F.length(line) > most)
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["buffer"]))).otherwise(acc["out"]).alias("out"), F.when(full, line).otherwise(F.concat(acc["buffer"], line)).alias("buffer"))

    start = F.struct(empty("string").alias("out"), F.lit("").alias("buffer"))
    cut = F.aggregate(lines, start, step, lambda acc: F.when(acc["buffer"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buffer"]))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)


def reply_entities(reply: Column) -> Column:
    """map<text,type> from a model's reply: the entities of the object from its first to its last brace; of a text
    named twice the last type counts, in upper case; null if there is no such object."""
    body = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    parsed = F.from_json(body, "entities array<struct<text:string,type:string>>")["entities"]
    kept = F.filter(parsed, lambda e: (F.trim(F.coalesce(e["text"], F.lit(""))) != "") & (F.trim(F.coalesce(e["type"], F.lit(""))) != ""))
    last = lambda rows: F.filter(rows, lambda e, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["text"] == e["text"]))
    return let(kept, lambda k: F.map_from_entries(F.transform(last(k), lambda e: F.struct(e["text"].alias("k"), F.upper(F.trim(e["type"])).alias("v")))))


def document_context(rows: DataFrame) -> DataFrame:
    """doc_id, context, values: the lines of row_context() of a document as one text, by part and row, and where in it the
    values stand."""
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "row", "line", "values"))).alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        moved = F.transform(x["values"], lambda v: v.withField("start", v["start"] + acc["at"]).withField("end", v["end"] + acc["at"]))
        return F.struct((acc["at"] + F.length(x["line"]) + 1).alias("at"), F.concat(acc["values"], moved).alias("values"))

    kind = "struct<start:int,end:int,original_start:int,original_end:int,original_text:string>"
    values = F.aggregate("lines", F.struct(F.lit(0).alias("at"), empty(kind).alias("values")), step, lambda acc: acc["values"])
    return lines.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"), values.alias("values"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


# What parts the sections of a model's older replies.
TEXT_SECTION, MAP_SECTION = "===脱敏文本===", "===映射表==="


def sectioned_reply(reply: Column) -> Column:
    """struct<text, mappings, types> of a model's older kind of reply: a section with the masked text and one with lines
    "original -> replacement | type".

    A replacement that an earlier line has already gets a number behind it, 2 and on, so that it can be undone. Of an
    original named twice the last line counts; without a type it is UNKNOWN. A reply without sections is all text.
    """
    parts = F.split(reply, TEXT_SECTION, 0)
    sections = F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), MAP_SECTION, 0)
    lines = F.transform(F.split(_stripped(F.coalesce(F.get(sections, F.lit(1)), F.lit(""))), "\n"), _stripped)

    def parsed(line: Column) -> Column:
        left = F.regexp_extract(line, "^([^|]*)", 1)
        kind = F.when(F.contains(line, F.lit("|")), _stripped(F.regexp_extract(line, "(?s)^[^|]*\\|(.*)$", 1))).otherwise(F.lit("UNKNOWN"))
        return F.struct(_stripped(F.regexp_extract(left, "(?s)^(.*?)->", 1)).alias("original"), _stripped(F.regexp_extract(left, "(?s)->(.*)$", 1)).alias("base"), kind.alias("type"))

    rows = F.transform(F.filter(lines, lambda x: F.regexp_extract(x, "^([^|]*)", 1).contains("->")), parsed)

    def step(acc: Column, x: Column) -> Column:
        used = F.transform(acc, lambda y: y["masked"])
        free = F.filter(F.sequence(F.lit(2), F.size(acc) + 2), lambda n: ~F.array_contains(used, F.concat(x["base"], n.cast("string"))))
        masked = F.when(F.array_contains(used, x["base"]), F.concat(x["base"], F.get(free, F.lit(0)).cast("string"))).otherwise(x["base"])
        return F.concat(acc, F.array(F.struct(x["original"].alias("original"), masked.alias("masked"), x["type"].alias("type"))))

    numbered = F.aggregate(rows, empty("struct<original:string,masked:string,type:string>"), step)
    last = lambda found: F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["original"] == x["original"]))
    pairs = lambda found, name: F.map_from_entries(F.transform(last(found), lambda x: F.struct(x["original"].alias("k"), x[name].alias("v"))))
    text = F.when(F.size(parts) >= 2, _stripped(F.get(sections, F.lit(0)))).otherwise(reply)
    return let(numbered, lambda found: F.struct(text.alias("text"), pairs(found, "masked").alias("mappings"), pairs(F.filter(found, lambda x: x["type"] != ""), "type").alias("types")))


def scanned(documents: DataFrame, ask: Callable[[Column], Column], most: int = 1800) -> DataFrame:
    """doc_id, original, type: what a language model names in documents (doc_id, text), piece by piece.

    ask turns a column of pieces into its replies, most often a pandas UDF around a service. A reply is read as an
    object of entities, else as sections. The first piece of a document that names a text decides its type.
    """
    pieces = documents.select("doc_id", F.posexplode(line_chunks(F.col("text"), most)).alias("chunk", "piece"))
    replies = pieces.select("doc_id", "chunk", ask(F.col("piece")).alias("reply"))
    kinds = let(reply_entities(F.col("reply")), lambda found: F.when(found.isNotNull(), found).otherwise(sectioned_reply(F.col("reply"))["types"]))
    named = replies.select("doc_id", "chunk", F.explode(kinds).alias("original", "type"))
    return named.groupBy("doc_id", "original").agg(F.min_by("type", "chunk").alias("type"))


def scan_and_rewrite(documents: DataFrame, ask: Callable[[Column], Column], most: int = 1800) -> DataFrame:
    """doc_id, text, mappings (original to mask), types: documents with what a model names replaced, longest first, by masks made
    here, numbered by type in order of appearance, so that they can be undone."""
    named = scanned(documents, ask, most).join(documents.select("doc_id", "text"), "doc_id")
    placed = named.withColumn("at", F.instr("text", F.col("original"))).withColumn("kind", model_type(F.col("type")))
    number = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("at", "original")) - 1
    made = placed.withColumn("masked", mask(F.col("kind"), F.col("original"), number))
    pairs = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", name))))
    by_doc = made.groupBy("doc_id").agg(pairs("masked").alias("mappings"), pairs("type").alias("types"))
    none = F.create_map().cast("map<string,string>")
    out = documents.select("doc_id", "text").join(by_doc, "doc_id", "left").withColumn("mappings", F.coalesce("mappings", none)).withColumn("types", F.coalesce("types", none))
    return out.select("doc_id", replaced(F.col("text"), F.col("mappings")).alias("text"), "mappings", "types")
