"""Registered queries of the masking engine, and what DuckDB says to each."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.functions.expr import column_number, matches, valid_identity
from veilframe.operators import detect as layers
from veilframe.operators import vault as vaults
from veilframe.operators.merge import deduplicated, first_wins, recognised
from veilframe.operators.names import NameRules, name_layer
from veilframe.operators.recognisers import analysed, anonymised, counted_entities, pattern_layer, verified
from veilframe.operators.recognisers import first_types as layers_by_model
from veilframe.operators.smart_names import smart_layer
from veilframe.operators.splice import originals_of, potential, replaced, replacements_of, spliced
from veilframe.operators.tokens import bioes_spans, label_type, line_chunks, mapped_back, model_type, refined, reply_entities, row_context, scanned, sectioned_reply
from veilframe.plans import engine
from veilframe.plans.stage import saved
from veilframe.sources.changed import newly_changed
from veilframe.sources.readers import combined, format_of, leaves, markdown_segments, segments_of, with_offsets
from veilframe.sources.writers import process_files, splice_files

#: Contact cards made of customers; both SQL dialects can run it. Every offset in a card is known.
_LOCAL = "'user' || lpad(cast(c_custkey as {s}), 6, '0')"
_PHONE = "'1' || cast(3 + c_custkey % 7 as {s}) || lpad(cast(c_custkey as {s}), 9, '0')"
_NAME = "'张' || substring('伟芳娜敏静丽强磊军洋', cast(c_custkey % 10 + 1 as int), 1)"
_CARD = f"select c_custkey as doc_id, '联系人：' || {_NAME} || '，电话：' || {_PHONE} || '，邮箱：' || {_LOCAL} || '@example.com' as text from customer"
CARDS, CARDS_DUCK = _CARD.replace("{s}", "string"), _CARD.replace("{s}", "varchar")
_IDS = "select o_orderkey as k, '110101' || cast(1960 + o_orderkey % 50 as {s}) || lpad(cast(1 + o_orderkey % 12 as {s}), 2, '0') || lpad(cast(1 + o_orderkey % 28 as {s}), 2, '0') || lpad(cast(o_orderkey % 1000 as {s}), 3, '0') as base from orders"
_URLS = "select c_custkey as k, case c_custkey % 3 when 0 then 'https://github.com/u' || cast(c_custkey as {s}) when 1 then 'https://example.com/~u' || cast(c_custkey as {s}) else 'https://example.com/A-' || cast(c_custkey as {s}) end as url from customer"
_FIELDS = "select s_suppkey as k, '学号：2024' || lpad(cast(s_suppkey as {s}), 6, '0') || '，Token: sk' || lpad(cast(s_suppkey as {s}), 6, '0') || '，姓名：李' || substring('伟芳娜敏静丽强磊军洋', cast(s_suppkey % 10 + 1 as int), 1) || '，申请人：教育局' as text from supplier"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    return spark.sql(query.replace("{s}", "string").replace(f" from {tables[0]}", " from {" + tables[0] + "}"), **{t: _table(spark, sf_dir, t) for t in tables})


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CARDS, "customer")


def _duck(query: str) -> str:
    return query.replace("{s}", "varchar")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_EMAIL_RE = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def _rows(df: DataFrame, key: str, spans) -> DataFrame:
    return df.select(F.col(key), F.explode(spans).alias("s")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"), F.col("s.type").alias("type"), F.col("s.confidence").alias("confidence"))


@query(f"""with m as (select doc_id, regexp_extract_all(text, '{_EMAIL_RE}') as ms, string_split_regex(text, '{_EMAIL_RE}') as gs from documents where regexp_matches(text, '{_EMAIL_RE}')),
e as (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i from m),
o as (select doc_id, ms[i] as text, cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as "start" from e)
select doc_id, "start", cast("start" + length(text) as int) as "end", text, 'EMAIL' as type, cast(1.0 as double) as confidence from o""")
def email_spans(spark, sf_dir):
    return _rows(_table(spark, sf_dir, "documents"), "doc_id", layers.emails(F.col("text")))


@query(f"select doc_id, 10 as \"start\", 21 as \"end\", substring(text, 11, 11) as text, 'PHONE' as type, cast(1.0 as double) as confidence from ({CARDS_DUCK})")
def phone_spans(spark, sf_dir):
    return _rows(_cards(spark, sf_dir), "doc_id", layers.phones(F.col("text")))


@query("select c_custkey as doc_id, 3 as \"start\", 16 as \"end\", '138-' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || '-' || lpad(cast(c_custkey % 977 as varchar), 4, '0') as text, 'PHONE' as type, cast(0.95 as double) as confidence from customer")
def phone_separated_spans(spark, sf_dir):
    text = "select c_custkey as doc_id, 'tel138-' || lpad(cast(c_custkey % 10000 as string), 4, '0') || '-' || lpad(cast(c_custkey % 977 as string), 4, '0') || '.' as text from customer"
    return _rows(_sql(spark, sf_dir, text, "customer"), "doc_id", layers.separated_phones(F.col("text")))


_CHECK = "substring('10X98765432', cast((" + " + ".join(f"cast(substring(base, {i + 1}, 1) as int) * {w}" for i, w in enumerate((7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))) + ") % 11 + 1 as int), 1)"


@query(f"select k, base || case when k % 2 = 0 then {_CHECK} else '0' end as id, base || case when k % 2 = 0 then {_CHECK} else '0' end = base || {_CHECK} as valid from ({_duck(_IDS)})")
def identity_checksum(spark, sf_dir):
    from veilframe.functions.expr import check_character

    rows = _sql(spark, sf_dir, _IDS, "orders").withColumn("id", F.concat("base", F.when(F.col("k") % 2 == 0, check_character(F.col("base"))).otherwise("0")))
    return rows.select("k", "id", valid_identity(F.col("id")).alias("valid"))


@query(f"select k, 3 as \"start\", 21 as \"end\", base || '0' as text, 'IDCN' as type, case when {_CHECK} = '0' then cast(1.0 as double) else cast(0.7 as double) end as confidence from ({_duck(_IDS)})")
def identity_spans(spark, sf_dir):
    rows = _sql(spark, sf_dir, _IDS, "orders").withColumn("text", F.concat(F.lit("证件 "), F.col("base"), F.lit("0。")))
    return _rows(rows, "k", layers.checked_identities(F.col("text")))


@query(f"select k, 2 as \"start\", 2 + length(url) as \"end\", url as text, 'URL' as type, case k % 3 when 0 then cast(0.95 as double) else cast(0.8 as double) end as confidence from ({_duck(_URLS)}) where k % 3 < 2")
def url_spans(spark, sf_dir):
    rows = _sql(spark, sf_dir, _URLS, "customer").withColumn("text", F.concat(F.lit("见 "), F.col("url"), F.lit(" 。")))
    return _rows(rows, "k", layers.urls(F.col("text")))


@query(f"""select k, "start", "end", text, type, confidence from (
select k, 3 as "start", 13 as "end", substring(text, 4, 10) as text, 'ACCOUNT_NUMBER' as type, cast(0.95 as double) as confidence from ({_duck(_FIELDS)}) union all
select k, 21 as "start", 29 as "end", substring(text, 22, 8) as text, 'SECRET', cast(0.95 as double) from ({_duck(_FIELDS)}) union all
select k, 33 as "start", 35 as "end", substring(text, 34, 2) as text, 'PERSON', cast(0.98 as double) from ({_duck(_FIELDS)}))""")
def schema_fields(spark, sf_dir):
    return _rows(_sql(spark, sf_dir, _FIELDS, "supplier"), "k", layers.schema_layer(F.col("text")))


_CARD_SPANS = f"""select doc_id, 4 as "start", 6 as "end", substring(text, 5, 2) as text, 'PERSON' as type, 'schema' as source from ({CARDS_DUCK}) union all
select doc_id, 10, 21, substring(text, 11, 11), 'PHONE', 'regex' from ({CARDS_DUCK}) union all
select doc_id, 25, 47, substring(text, 26, 22), 'EMAIL', 'regex' from ({CARDS_DUCK})"""


@query(f'select doc_id, "start", "end", text, type, source from ({_CARD_SPANS})')
def merged_spans(spark, sf_dir):
    return engine.span_rows(engine.detect(_cards(spark, sf_dir))).select("doc_id", "start", "end", "text", "type", "source")


@query(f"select type, count(*) as n from ({_CARD_SPANS}) group by type")
def stats_by_type(spark, sf_dir):
    return engine.stats_by_type(engine.detect(_cards(spark, sf_dir)))


@query(f"select text as original, min(type) as type, count(*) as n, min(doc_id) as first_doc from ({_CARD_SPANS}) group by text")
def analysis_summary(spark, sf_dir):
    return engine.analysis(engine.detect(_cards(spark, sf_dir))).select("original", "type", "n", F.col("first.doc_id").alias("first_doc"))


@query("""select c_mktsegment as type, c_name as original, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as counter from customer""")
def dense_counters(spark, sf_dir):
    from veilframe.operators.counters import dense_counter

    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type"), F.col("c_name").alias("original"), "c_custkey")
    return dense_counter(rows, ["type"], ["c_custkey"]).select("type", "original", "counter")


_MASKED = f"""with cards as ({CARDS_DUCK}),
names as (select substring(text, 5, 2) as name, row_number() over (order by min(doc_id)) as r from cards group by 1),
n as (select doc_id, text, row_number() over (order by doc_id) - 1 as c from cards)
select n.doc_id, '联系人：' || printf('{{{{PERSON_%06d}}}}', names.r) || '，电话：1' || cast(3 + c % 7 as varchar) || lpad(cast((c // 7) % 1000000000 as varchar), 9, '0') || '，邮箱：' || rpad(printf('u%03d', c), 10, 'x') || '@example.com' as masked_text
from n join names on substring(n.text, 5, 2) = names.name"""


def _masked(spark, sf_dir):
    return engine.mask(engine.detect(_cards(spark, sf_dir)), F.lit("p"), vaults.empty_vault(spark), F.lit("2024-01-01").cast("timestamp"))


@query(_MASKED)
def masked_documents(spark, sf_dir):
    return _masked(spark, sf_dir)[0].select("doc_id", "masked_text")


@query(f"""with cards as ({CARDS_DUCK}),
names as (select substring(text, 5, 2) as name, row_number() over (order by min(doc_id)) as r from cards group by 1),
n as (select text, row_number() over (order by doc_id) - 1 as c from cards)
select name as original_text, 'PERSON' as entity_type, printf('{{{{PERSON_%06d}}}}', r) as masked_text from names union all
select substring(text, 11, 11), 'PHONE', '1' || cast(3 + c % 7 as varchar) || lpad(cast((c // 7) % 1000000000 as varchar), 9, '0') from n union all
select substring(text, 26, 22), 'EMAIL', rpad(printf('u%03d', c), 10, 'x') || '@example.com' from n""")
def vault_contents(spark, sf_dir):
    return _masked(spark, sf_dir)[1].select("original_text", "entity_type", "masked_text")


@query(f"select doc_id, text, len(regexp_extract_all(text, '{_EMAIL_RE}')) as n_emails, true as hidden from documents")
def restore_roundtrip(spark, sf_dir):
    """Documents masked and restored are the documents; and no e-mail address stands in what was masked."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    masked, _ = engine.mask(engine.detect(docs), F.lit("p"), vaults.empty_vault(spark), F.lit("2024-01-01").cast("timestamp"))
    masked = saved(masked.select("doc_id", "text", "masked_text", "replacements"))
    back = engine.restore(masked.select("doc_id", F.col("masked_text").alias("text")), engine.mappings_of(masked))
    mails = F.regexp_extract_all("text", F.lit(_EMAIL_RE), F.lit(0))
    shown = masked.select("doc_id", F.size(mails).cast("bigint").alias("n_emails"), (~F.exists(mails, lambda m: F.contains(F.col("masked_text"), m))).alias("hidden"))
    return back.select("doc_id", F.col("restored_text").alias("text")).join(shown, "doc_id")


@query(f"select doc_id, text, row_number() over (order by doc_id) > 1 as hidden from ({CARDS_DUCK})")
def card_roundtrip(spark, sf_dir):
    """Cards masked, and restored by the vault's tokens and words; the masked ones hold neither phone nor address. (The
    first number of the mask's form is the first card's phone, by chance.)"""
    masked, vault = _masked(spark, sf_dir)
    masked = saved(masked.select("doc_id", "text", "masked_text"))
    hidden = ~F.contains("masked_text", F.substring("text", 11, 11)) & ~F.contains("masked_text", F.substring("text", 26, 22))
    back = engine.restore_by_vault(masked.select("doc_id", F.col("masked_text").alias("text")), vault, "p")
    return back.select("doc_id", F.col("restored_text").alias("text")).join(masked.select("doc_id", hidden.alias("hidden")), "doc_id")


@query("""select c_name as original_text, case when c_custkey % 3 = 0 then 'M' || cast(c_custkey as varchar) else null end as stored, c_custkey % 3 <> 0 as is_new from customer""")
def vault_reuse(spark, sf_dir):
    """Known originals keep their masks, others are new."""
    c = _table(spark, sf_dir, "customer")
    key = [F.lit("p").alias("project_id"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("original_text")]
    now = F.lit("2024-01-01").cast("timestamp")
    vault = c.filter("c_custkey % 3 = 0").select(*key, F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("masked_text"), F.lit("regex").alias("source"), F.lit(1.0).alias("confidence"), now.alias("created_at"), now.alias("last_seen_at"))
    requests = c.select(*key, F.lit("regex").alias("source"), F.lit(1.0).alias("confidence"), F.col("c_custkey").alias("first_seen"))
    done = vaults.assign(vault, vaults.proposals(requests))
    return done.select("original_text", F.when(~F.col("is_new"), F.col("masked_text")).alias("stored"), "is_new")


@query("select c_custkey as k, printf('{{PERSON_%06d}}', row_number() over (order by c_custkey)) as masked_text from customer")
def vault_collision(spark, sf_dir):
    """All customers are proposed one mask, and get one each; two of one name are two originals."""
    original = F.concat_ws(" ", "c_name", "c_custkey").alias("original_text")
    rows = _table(spark, sf_dir, "customer").select(F.lit("p").alias("project_id"), F.lit("PERSON").alias("entity_type"), original, F.lit("{{PERSON_000001}}").alias("proposed"), F.lit("regex").alias("source"), F.lit(1.0).alias("confidence"), F.col("c_custkey").alias("first_seen"))
    done = vaults.assign(vaults.empty_vault(spark), rows)
    return done.join(_table(spark, sf_dir, "customer").select(original, F.col("c_custkey").alias("k")), "original_text").select("k", "masked_text")


_MASKS = "select o_orderkey as c, '138-' || lpad(cast(o_orderkey % 10000 as {s}), 4, '0') || '-0000' as phone, 'https://example.com/path/' || cast(o_orderkey as {s}) as url, lpad(cast(o_orderkey as {s}), 12, '0') as number, '2024-01-15' as day from orders"


@query(f"""select c, '1' || cast(3 + c % 7 as varchar) || substring(d, 1, 1) || '-' || substring(d, 2, 4) || '-' || substring(d, 6, 4) as phone, 'https://example.com' || rpad(printf('/U%03d', c), cast(length(url) - 19 as int), 'X') as url, lpad(cast(c as varchar), 12, '0') as number,
substring(e, 1, 4) || '-' || substring(e, 5, 2) || '-' || substring(e, 7, 2) as day from (select *, lpad(cast((c // 7) % 1000000000 as varchar), 9, '0') as d, lpad(cast(c as varchar), 8, '0') as e from ({_duck(_MASKS)}))""")
def mask_forms(spark, sf_dir):
    rows, c = _sql(spark, sf_dir, _MASKS, "orders"), F.col("c")
    kinds = {"phone": "PHONE", "url": "URL", "number": "ACCOUNT_NUMBER", "day": "DATE_TIME"}
    return rows.select("c", *[masks.mask(F.lit(kind), F.col(name), c).alias(name) for name, kind in kinds.items()])


@query("""select conv_id as doc_id, cast(turn as int) as turn, cast(coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as int) as start_offset from conversations""")
def segment_offsets(spark, sf_dir):
    """Turns as segments of a document, with their offsets in the joined text."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("seg_no"), "text"))).alias("t"))
    full = F.transform("t", lambda s: F.struct(s["seg_no"].alias("seg_no"), s["text"].alias("text"), F.lit("turn").alias("location"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.create_map().cast("map<string,string>").alias("metadata")))
    return docs.select("doc_id", F.explode(with_offsets(full)).alias("s")).select("doc_id", F.col("s.seg_no").alias("turn"), F.col("s.start_offset").alias("start_offset"))


@query("select conv_id as doc_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def combined_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("doc_id", combined(F.col("t")).alias("text"))


_ARGS = "select event_id, case event_id % 6 when 0 then '--flag' when 1 then 'x' when 2 then '文件' when 3 then 'plain' when 4 then 'two words' else 'a@b' end as arg from events"


@query(f"select event_id, arg, event_id % 6 in (2, 4, 5) as maskable from ({_ARGS})")
def argument_filter(spark, sf_dir):
    return _sql(spark, sf_dir, _ARGS, "events").select("event_id", "arg", engine.maskable_argument(F.col("arg")).alias("maskable"))


_FILES = "select p_partkey as k, '/d/' || p_brand || case p_partkey % 4 when 0 then '.MD' when 1 then '.bin' when 2 then '.json' else '' end as path, cast(p_partkey * 40000 as bigint) as size from part"


@query(f"select k, case when k % 4 in (1, 3) then 'not_text_file' when size > 5242880 then 'file_too_large:' || cast(size as varchar) else 'ok' end as verdict, case k % 4 when 0 then 'text' when 2 then 'json' else null end as format from ({_FILES.replace('.MD', '.TXT')})")
def file_filter(spark, sf_dir):
    rows = _sql(spark, sf_dir, _FILES.replace(".MD", ".TXT"), "part")
    return rows.select("k", engine.file_verdict(F.col("path"), F.col("size")).alias("verdict"), format_of(F.col("path")).alias("format"))


@query(f"select k, replace(path, '.MD', '') as stem, case when k % 4 = 3 then path || '_masked' else substring(path, 1, length(path) - length(suffix)) || '_masked' || suffix end as masked from (select *, case k % 4 when 0 then '.MD' when 1 then '.bin' when 2 then '.json' else '' end as suffix from ({_FILES}))")
def output_names(spark, sf_dir):
    return _sql(spark, sf_dir, _FILES, "part").select("k", F.replace("path", F.lit(".MD"), F.lit("")).alias("stem"), engine.output_path(F.col("path")).alias("masked"))


@query("select doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'he', ''))) / 2 as bigint) as n from documents")
def restore_count(spark, sf_dir):
    keys = F.array(F.lit("the"), F.lit("he"))
    return _table(spark, sf_dir, "documents").select("doc_id", potential(F.col("text"), keys).alias("n"))


@query("select doc_id, replace(replace(text, 'tion', '<1>'), 'on', '<2>') as text from documents")
def replace_longest_first(spark, sf_dir):
    pairs = F.create_map(F.lit("on"), F.lit("<2>"), F.lit("tion"), F.lit("<1>"))
    return _table(spark, sf_dir, "documents").select("doc_id", replaced(F.col("text"), pairs).alias("text"))


@query("select o_orderkey as k, 'status' as path, o_orderstatus as value from orders union all select o_orderkey, 'list[0]', o_orderpriority from orders union all select o_orderkey, 'list[2].x', '中' from orders union all select o_orderkey, 'deep.key', 'c' || cast(o_custkey as varchar) from orders")
def json_leaves(spark, sf_dir):
    """String leaves of JSON texts, by a batched function over whole trees; blank strings, numbers and nulls are none."""

    @F.pandas_udf("array<struct<path:string,text:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "text": x} for p, x in leaves(json.loads(t))] if t else [])

    tree = F.format_string('{"status": "%s", "n": %d, "list": ["%s", " ", {"x": "\\u4e2d"}], "deep": {"key": "c%d", "none": null}}', "o_orderstatus", "o_orderkey", "o_orderpriority", "o_custkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(walk(tree)).alias("l"))
    return rows.select("k", "l.path", F.col("l.text").alias("value"))


@query("""with words as (select conv_id as doc_id, turn, string_split(text, ' ') as w, text from conversations),
t as (select doc_id, turn, text, w, unnest(range(1, len(w) + 1)) as i from words),
p as (select doc_id * 1000 + turn as doc_id, i, w[i] as word, coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0) as s from t),
b as (select *, ['B', 'I', 'E', 'S', 'O', 'I'][length(word) % 6 + 1] as x, ['secret', 'secret', 'secret', 'private_person', 'O', 'private_date'][length(word) % 6 + 1] as l from p where length(word) > 0),
r as (select *, case when x in ('B', 'S') or lag(x, 1, 'O') over o in ('O', 'E', 'S') or lag(l) over o <> l then 1 else 0 end as fresh from b window o as (partition by doc_id order by i)),
g as (select *, sum(fresh) over (partition by doc_id order by i) as run from r)
select doc_id, cast(min(s) as int) as "start", cast(max(s + length(word)) as int) as "end", case arg_min(l, i) when 'secret' then 'SECRET' when 'private_person' then 'PERSON' else 'DATE_TIME' end as type from g where x <> 'O' group by doc_id, run""")
def bioes_runs(spark, sf_dir):
    """Words with labels by their length, of all five kinds and several names, as spans."""
    docs = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    words = docs.select("doc_id", "text", F.posexplode(F.split("text", " ")).alias("tok", "word"), F.split("text", " ").alias("w"))
    start = F.aggregate(F.slice("w", 1, F.col("tok")), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    label = F.get(F.array(*[F.lit(x) for x in ("B-secret", "I-secret", "E-secret", "S-private_person", "O", "I-private_date")]), F.length("word") % 6)
    tokens = words.select("doc_id", "tok", label.alias("label"), start.alias("start"), (start + F.length("word")).alias("end"))
    return bioes_spans(tokens, docs).select("doc_id", "start", "end", "type")


@query("""select n_regionkey as doc_id, n_nationkey + 2 as row, '姓名: ' || n_name || ' | 电话: 138' || lpad(cast(n_nationkey as varchar), 8, '0') as line from nation""")
def sheet_rows(spark, sf_dir):
    """Nations as sheets, one for each region, with a header row: lines of row context."""
    n = _table(spark, sf_dir, "nation")
    body = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 2).alias("r"), F.col("n_name").alias("a"), F.concat(F.lit("138"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("b"))
    head = n.select(F.col("n_regionkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("r"), F.lit("姓名").alias("a"), F.lit("电话").alias("b"))
    cells = head.unionByName(body).select("doc_id", F.lit("sheet1").alias("part"), F.explode(F.array(*[F.struct(F.concat(F.lit(c), F.col("r").cast("string")).alias("cell"), F.col(x).alias("text")) for c, x in (("A", "a"), ("B", "b"))])).alias("c"))
    placed = cells.select("doc_id", "part", "c.cell", "c.text", F.lit(0).alias("start_offset"), F.length("c.text").alias("end_offset"))
    return row_context(placed).select("doc_id", "row", "line")


@query("""with recursive l as (select doc_id, string_split(text, chr(10)) as parts, len(string_split(text, chr(10))) as m from documents where length(text) > 1800),
s as (select doc_id, i, parts[i] || case when i < m then chr(10) else '' end as line from (select *, unnest(range(1, m + 1)) as i from l)),
k as (select doc_id, row_number() over (partition by doc_id order by i) as i, line from s where line <> ''),
f as (select doc_id, i, length(line) as used, 1 as piece from k where i = 1 union all
select k.doc_id, k.i, case when f.used + length(k.line) > 1800 then length(k.line) else f.used + length(k.line) end, case when f.used + length(k.line) > 1800 then f.piece + 1 else f.piece end from f join k on k.doc_id = f.doc_id and k.i = f.i + 1)
select doc_id, max(piece) as pieces from f group by doc_id union all select doc_id, 1 from documents where length(text) <= 1800""")
def model_chunks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(line_chunks(F.col("text"))).alias("pieces"))


_SPAN_SETS = "select o_custkey as id, o_orderkey as k, cast(o_orderkey % 40 as int) as a, cast(o_orderkey % 40 + 1 + o_orderkey % 7 as int) as b, cast((o_orderkey % 10) / 10.0 as double) as score from orders"


def _recognised(spark, sf_dir, strategy: str) -> DataFrame:
    rows = _sql(spark, sf_dir, _SPAN_SETS, "orders")
    x = F.struct(F.lit(0).alias("seq"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit("").alias("text"), F.lit("UNKNOWN").alias("type"), F.lit("regex").alias("source"), F.col("score").alias("confidence"), F.lit(None).cast("string").alias("reason"))
    sets = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", x.alias("x")))).alias("s")).select("id", layers.numbered(F.transform("s", lambda e: e["x"])).alias("spans"))
    return sets.select("id", F.explode(recognised(F.col("spans"), strategy)).alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.confidence").alias("score"))


#: What settles a conflict with the first kept span that a new one overlaps, in SQL.
_RECOGNISED = """with recursive s as (select id, row_number() over (partition by id order by a, score desc, b - a desc, k) as i, struct_pack(a := a, b := b, score := score) as x from ({sets})),
f as (select id, i, [x] as kept from s where i = 1 union all
select s.id, s.i, case when coalesce(list_position(list_transform(f.kept, lambda y: greatest(y.a, s.x.a) < least(y.b, s.x.b)), true), 0) = 0 then list_append(f.kept, s.x)
else list_transform(f.kept, lambda y, j: case when j = list_position(list_transform(f.kept, lambda z: greatest(z.a, s.x.a) < least(z.b, s.x.b)), true) and {better} then s.x else y end) end
from f join s on s.id = f.id and s.i = f.i + 1)
select id, u.a as "start", u.b as "end", u.score as score from (select id, unnest(arg_max(kept, i)) as u from f group by id)"""


def _recognised_sql(better: str) -> str:
    return _RECOGNISED.replace("{sets}", _SPAN_SETS).replace("{better}", better)


@query(_recognised_sql("false"))
def recogniser_first(spark, sf_dir):
    """Overlapping results of different confidence and length where the first stays."""
    return _recognised(spark, sf_dir, "first")


@query(_recognised_sql("s.x.score > y.score"))
def recogniser_highest(spark, sf_dir):
    """Of overlapping results the surer one."""
    return _recognised(spark, sf_dir, "highest_score")


@query(_recognised_sql("s.x.b - s.x.a > y.b - y.a"))
def recogniser_longest(spark, sf_dir):
    """Of overlapping results the longer one."""
    return _recognised(spark, sf_dir, "longest")


def _sessions(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("session_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.array(F.concat(F.lit("/f"), (F.col("o_custkey") % 7).cast("string"))).alias("input_files"), F.array().cast("array<string>").alias("output_files"), F.create_map(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")), F.lit("v")).alias("mappings"), F.create_map().cast("map<string,bigint>").alias("stats"))


@query("select 's' || cast(o_orderkey as varchar) as session_id from orders where o_custkey % 5 = 2 order by o_orderdate desc, 's' || cast(o_orderkey as varchar) limit 50")
def session_list(spark, sf_dir):
    return vaults.list_sessions(_sessions(spark, sf_dir), "p2").select("session_id")


@query("select session_id from (select 's' || cast(o_orderkey as varchar) as session_id, o_orderdate, o_custkey from orders order by o_orderdate desc, session_id limit 100) where o_custkey % 7 = 3 order by o_orderdate desc, session_id limit 1")
def session_of_file(spark, sf_dir):
    return vaults.session_of_file(_sessions(spark, sf_dir), "/f3").select("session_id")


@query("""select o_orderkey as doc_id, 's' || cast(o_orderkey as varchar) as session_id, cast(1 as bigint) as hits from orders order by o_orderdate desc, session_id limit 10""")
def best_session(spark, sf_dir):
    """A document for every order, with the mask of its session; only the ten newest sessions are held against them."""
    named = F.concat(F.lit("<"), F.map_keys("mappings")[0], F.lit(">"))
    sessions = _sessions(spark, sf_dir)
    docs = sessions.select(F.substring("session_id", 2, 20).cast("bigint").alias("doc_id"), named.alias("text"))
    return vaults.best_session(docs, sessions.withColumn("mappings", F.create_map(named, F.lit("v"))))


@query("""select 'mapping' as kind, case when c_acctbal < 0 then 'PHONE' else 'EMAIL' end as name, count(*) as n from customer group by 2 union all select 'mapping', null, count(*) from customer union all
select 'session', case when o_orderstatus = 'F' then 'completed' else 'pending' end, count(*) from orders group by 2 union all select 'session', null, count(*) from orders""")
def vault_stats(spark, sf_dir):
    vault = _table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") < 0, "PHONE").otherwise("EMAIL").alias("entity_type"))
    return vaults.vault_stats(vault, _sessions(spark, sf_dir))


@query("select count(*) as files, sum(case when o_orderstatus = 'F' then 1 else 0 end) as ok, sum(case when o_orderstatus <> 'F' then 1 else 0 end) as failed, sum(o_orderkey) as changes from orders")
def restore_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderkey").alias("changes"), F.lit(None).cast("string").alias("error"))
    return engine.summary(rows).select("files", "ok", "failed", "changes")


@query("select p_partkey as k, case p_partkey % 3 when 0 then p_partkey % 26 + 1 when 1 then 26 + p_partkey % 26 + 1 else 26 * 3 + p_partkey % 26 + 1 end as n from part")
def column_numbers(spark, sf_dir):
    letter = F.char(65 + F.col("p_partkey") % 26)
    name = F.when(F.col("p_partkey") % 3 == 0, letter).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("A"), letter)).otherwise(F.concat(F.lit("c"), letter))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), column_number(name).cast("bigint").alias("n"))


@query("select item_id, 'PHONE' as a, 'ADDRESS' as b, text, 'DATE_TIME' as t from benchmark where trim(text) <> ''")
def model_reply(spark, sf_dir):
    """Entities of model replies over whole texts, the last type of a text counting, and their types here."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    quoted = F.to_json(F.struct(F.col("t").alias("text"), F.lit("person").alias("type")))
    last = F.to_json(F.struct(F.col("t").alias("text"), F.lit(" date ").alias("type")))
    found = rows.select("item_id", F.explode(reply_entities(F.concat(F.lit('ok {"entities":['), quoted, F.lit(","), last, F.lit("]} end")))).alias("text", "kind"))
    return found.select("item_id", model_type(F.lit("phone_number")).alias("a"), model_type(F.lit("location")).alias("b"), "text", model_type(F.col("kind")).alias("t"))


@query("select doc_id, 0 as seg_no, 'text:0-' || cast(length(text) as varchar) as location from documents where trim(text) <> '' union all select doc_id, 1, 'text:' || cast(length(text) + 7 as varchar) || '-' || cast(length(text) + 13 as varchar) from documents where trim(text) <> ''")
def markdown_parts(spark, sf_dir):
    """Documents as Markdown with a fenced block and a tail behind each."""
    rows = _table(spark, sf_dir, "documents").filter("trim(text) != ''").select("doc_id", F.concat(F.replace("text", F.lit("`"), F.lit("'")), F.lit("```abc```tail")).alias("text"))
    return rows.select("doc_id", F.explode(markdown_segments(F.col("text"))).alias("s")).select("doc_id", F.col("s.seg_no").alias("seg_no"), F.col("s.location").alias("location"))


@query(f"select doc_id, 4 as \"start\", 6 as \"end\", substring(text, 5, 2) as text from ({CARDS_DUCK})")
def name_spans(spark, sf_dir):
    """Names found by label and surname alone."""
    return _cards(spark, sf_dir).select("doc_id", F.explode(name_layer(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


@query("select c_custkey as doc_id, 10 as \"start\", 12 as \"end\", 'ab' as text from customer")
def mapped_values(spark, sf_dir):
    """Spans in a context line, mapped back into the document."""
    kind = "array<struct<start:int,end:int,original_start:int,original_end:int,original_text:string>>"
    values = F.array(F.struct(F.lit(0), F.lit(2), F.lit(0), F.lit(2), F.lit("zz")), F.struct(F.lit(4), F.lit(9), F.lit(10), F.lit(15), F.lit("abcde"))).cast(kind)
    spans = F.array(layers.span(F.struct(F.lit(4).alias("start"), F.lit(6).alias("end"), F.lit("ab").alias("text")), "PERSON", "privacy_filter", 1.0, "m"), layers.span(F.struct(F.lit(1).alias("start"), F.lit(6).alias("end"), F.lit("x").alias("text")), "PERSON", "privacy_filter", 1.0, "m"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(mapped_back(spans, values)).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


@query(f"select doc_id, '联系人：<人名>，电话：*****' || substring(text, 16, 6) || '，邮箱：' || substring(text, 26) as text from ({CARDS_DUCK})")
def anonymised_cards(spark, sf_dir):
    """Cards with names and phones masked for good, by the pattern recognisers."""
    text = F.col("text")
    found = F.filter(recognised(pattern_layer(text), "highest_score"), lambda x: x["type"].isin("PHONE_NUMBER", "PERSON") & (x["start"] >= 4))
    return _cards(spark, sf_dir).select("doc_id", spliced(text, anonymised(found)).alias("text"))


@query("select item_id as doc_id, text as original, 'A' as type from benchmark")
def first_types(spark, sf_dir):
    """Of the types that pieces of a document give a text, the first counts."""
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("original"), F.explode(F.array(*[F.struct(F.lit(k).alias("chunk"), F.lit(t).alias("type")) for k, t in ((2, "B"), (1, "A"))])).alias("c"))
    return layers_by_model(rows.select("doc_id", "original", "c.chunk", "c.type"))


@query("select 'PHONE' as type, sum(cast((length(text) - length(replace(text, 'e', ''))) as bigint)) as n from documents")
def model_entity_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return counted_entities(docs, docs.select("doc_id", F.lit("e").alias("original"), F.lit("phone_number").alias("type")))


@query(f"select text as original, min(type) as type, count(*) as n from ({_CARD_SPANS}) group by text order by min(doc_id * 100 + \"start\") limit 20")
def analysis_preview(spark, sf_dir):
    return engine.preview(engine.analysis(engine.detect(_cards(spark, sf_dir)))).select("original", "type", "n")


@query("select 'f' || cast(k as varchar) as path from (select c_nationkey as k from customer union select s_nationkey from supplier except select n_nationkey from nation where n_nationkey < 5)")
def changed_files(spark, sf_dir):
    """Changed and staged files together, less those that were there before."""
    path = lambda table, col: _table(spark, sf_dir, table).select(F.concat(F.lit("f"), F.col(col).cast("string")).alias("path"))
    before = _table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"))
    return newly_changed(path("customer", "c_nationkey"), path("supplier", "s_nationkey"), before)


@query("select c_custkey as doc_id, 3 as \"start\", 15 as \"end\", '0571-' || lpad(cast(c_custkey % 10000000 as varchar), 7, '0') as text, 'PHONE' as type, cast(0.95 as double) as confidence from customer")
def landline_spans(spark, sf_dir):
    text = "select c_custkey as doc_id, 'tel0571-' || lpad(cast(c_custkey % 10000000 as string), 7, '0') || '.' as text from customer"
    return _rows(_sql(spark, sf_dir, text, "customer"), "doc_id", layers.landlines(F.col("text")))


@query(f"select k, 3 as \"start\", 21 as \"end\", base || '0' as text, 'IDCN' as type, cast(1.0 as double) as confidence from ({_duck(_IDS)})")
def identity_plain_spans(spark, sf_dir):
    rows = _sql(spark, sf_dir, _IDS, "orders").withColumn("text", F.concat(F.lit("证件 "), F.col("base"), F.lit("0。")))
    return _rows(rows, "k", layers.identities(F.col("text")))


_SHEET = """with s as (select n_regionkey as doc_id, n_nationkey as r, n_name as a, '138' || lpad(cast(n_nationkey as varchar), 8, '0') as b, 'NOTE' as c from nation),
p as (select doc_id, r, a, 11 + coalesce(sum(length(a) + length(b) + length(c) + 3) over (partition by doc_id order by r rows between unbounded preceding and 1 preceding), 0) as pos from s)"""


@query(f"{_SHEET} select doc_id, cast(pos as int) as \"start\", cast(pos + length(a) as int) as \"end\", a as text, 'test:model+row_context' as reason from p")
def sheet_documents(spark, sf_dir):
    """Sheets detected as documents: a model that finds words in capitals sees rows as lines, so that those in columns without a telling header are left out."""
    n = _table(spark, sf_dir, "nation")
    body = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 2).alias("r"), F.col("n_name").alias("a"), F.concat(F.lit("138"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("b"), F.lit("NOTE").alias("c"))
    head = n.select(F.col("n_regionkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("r"), F.lit("姓名").alias("a"), F.lit("手机号码").alias("b"), F.lit("专业").alias("c"))
    filled = F.array(*[F.struct(F.concat(F.lit(col), F.col("r").cast("string")).alias("cell"), F.col(x).alias("text")) for col, x in (("A", "a"), ("B", "b"), ("C", "c"))])
    rows = head.unionByName(body).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", filled.alias("x")))), lambda e: e["x"])).alias("cells"))

    def step(acc, x):
        end = acc["at"] + F.length(x["text"])
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(x.withField("start_offset", acc["at"]).withField("end_offset", end))).alias("out"))

    placed = F.aggregate("cells", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<cell:string,text:string,start_offset:int,end_offset:int>>").alias("out")), step, lambda acc: acc["out"])
    documents = rows.select("doc_id", F.array_join(F.transform("cells", lambda x: x["text"]), "\n").alias("text"))
    cells = rows.select("doc_id", F.explode(placed).alias("c")).select("doc_id", F.lit("sheet1").alias("part"), "c.*")
    model = lambda text: F.transform(matches(text, "[A-Z]+(?:[ _][A-Z0-9]+)*"), lambda x: layers.span(x, "PERSON", "privacy_filter", 1.0, "test:model"))
    found = engine.span_rows(engine.detect_documents(documents, cells, model)).filter("source = 'privacy_filter'")
    return found.select("doc_id", "start", "end", "text", "reason")


@query("select doc_id, case doc_id % 2 when 0 then 'the' else 'of' end as original, case doc_id % 2 when 0 then 'PERSON' else 'place' end as type from documents where contains(text, case doc_id % 2 when 0 then 'the' else 'of' end)")
def model_scan(spark, sf_dir):
    """Whole documents named piece by piece by a model that answers in the newer or in the older form."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "@").otherwise("#"), "text").alias("text"), "doc_id")
    ask = lambda piece: F.when(F.contains(piece, F.lit("the")) & (F.col("doc_id") % 2 == 0), '{"entities": [{"text": "the", "type": "person"}]}').when(F.contains(piece, F.lit("of")) & (F.col("doc_id") % 2 == 1), "===脱敏文本===x===映射表===\nof -> [1] | place").otherwise("nothing")
    return scanned(docs, ask)


@query("""with recursive s as (select id, row_number() over (partition by id order by a, score desc, k) as i, a, b, score from (""" + _SPAN_SETS + """)),
f as (select id, i, a, b, score, b as reach, true as kept from s where i = 1 union all
select s.id, s.i, s.a, s.b, s.score, case when s.a < f.reach then f.reach else s.b end, s.a >= f.reach from f join s on s.id = f.id and s.i = f.i + 1)
select id, a as "start", b as "end", score from f where kept""")
def first_wins_spans(spark, sf_dir):
    """Spans by start and confidence, without those that overlap one kept before."""
    return _settled(spark, sf_dir, first_wins)


@query("select id, a as \"start\", b as \"end\", arg_min(score, k) as score from (" + _SPAN_SETS + ") group by 1, 2, 3")
def deduplicated_spans(spark, sf_dir):
    """The first of spans with one place, text and type."""
    return _settled(spark, sf_dir, deduplicated)


def _settled(spark, sf_dir, how) -> DataFrame:
    rows = _sql(spark, sf_dir, _SPAN_SETS, "orders")
    x = F.struct(F.lit(0).alias("seq"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit("").alias("text"), F.lit("UNKNOWN").alias("type"), F.lit("regex").alias("source"), F.col("score").alias("confidence"), F.lit(None).cast("string").alias("reason"))
    sets = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", x.alias("x")))).alias("s")).select("id", layers.numbered(F.transform("s", lambda e: e["x"])).alias("spans"))
    return sets.select("id", F.explode(how(F.col("spans"))).alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.confidence").alias("score"))


@query(f"""select doc_id, 4 as "start", 6 as "end", substring(text, 5, 2) as text, 'PERSON' as type, cast(0.75 as double) as confidence from ({CARDS_DUCK}) union all
select doc_id, 10, 21, substring(text, 11, 11), 'PHONE_NUMBER', cast(0.9 as double) from ({CARDS_DUCK})""")
def pattern_engine(spark, sf_dir):
    """Cards as the pattern engine reports them: names behind a context word are surer than names alone."""
    found = _rows(_cards(spark, sf_dir), "doc_id", analysed(F.col("text"), ["PERSON", "PHONE_NUMBER"]))
    return found.withColumn("confidence", F.round("confidence", 6))


@query(f"select doc_id, 10 as \"start\", 21 as \"end\", case when doc_id % 3 = 0 then cast(1.0 as double) else cast(0.9 as double) end as confidence from ({CARDS_DUCK}) where doc_id % 3 < 2")
def verified_spans(spark, sf_dir):
    """Phones that a model confirms, says nothing about, or rejects."""
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 11, 11), F.lit(":Y"))).when(F.col("doc_id") % 3 == 2, F.concat(F.substring("text", 11, 11), F.lit(":n, x:Y"))).otherwise("")
    found = _rows(_cards(spark, sf_dir), "doc_id", verified(analysed(F.col("text"), ["PHONE_NUMBER"]), reply))
    return found.select("doc_id", "start", "end", F.round("confidence", 6).alias("confidence"))


_NAMED = "select c_custkey as k, case c_custkey % 6 when 0 then '王小明老师' when 1 then '见王小明' when 2 then '公司：王小明' when 3 then '负责人：王小明。' when 4 then '王芳 李娜 张伟' else '欧阳小雪：' end as text from customer"


@query(f"""with n as ({_duck(_NAMED)})
select k, 0 as "start", 3 as "end", '王小明' as text, cast(0.85 as double) as confidence, 'single_surname' as reason from n where k % 6 = 0 union all
select k, 4, 7, '王小明', 0.85, 'colon_structure' from n where k % 6 = 3 union all
select k, 3 * u, 3 * u + 2, substring(text, cast(3 * u + 1 as int), 2), 0.75, 'name_list' from n, (select unnest([0, 1, 2]) as u) where k % 6 = 4""")
def name_confidence(spark, sf_dir):
    """Names by label, surname and list; what stands around them decides, and how sure they are."""
    rows = _sql(spark, sf_dir, _NAMED, "customer")
    found = rows.select("k", F.explode(name_layer(F.col("text"), NameRules(strict=True))).alias("s")).select("k", "s.start", "s.end", "s.text", F.round("s.confidence", 6).alias("confidence"), "s.reason")
    return found.filter("k % 6 != 3 or reason = 'colon_structure'")


_WORDS = "select c_custkey as k, case c_custkey % 5 when 0 then '王小明 老师' when 1 then '高级教师 老师' when 2 then '姓名： 韩 潇' when 3 then '淳安县 同学' else '只有 王小明' end as text from customer"


@query("""select c_custkey as k, 0 as "start", 3 as "end", '王小明' as text, cast(0.8 as double) as confidence, 'jieba_word_name' as reason from customer where c_custkey % 5 = 0 union all
select c_custkey, 3, 6, '王小明', 0.6, 'jieba_word_name' from customer where c_custkey % 5 = 4""")
def smart_name_words(spark, sf_dir):
    """Names among words that blanks part: known words and administrative units are none."""
    segment = lambda text: [(m[0], m.start(), m.end()) for m in re.finditer("[^ ]+", text)]
    rows = _sql(spark, sf_dir, _WORDS, "customer")
    return rows.select("k", F.explode(smart_layer(F.col("text"), segment)).alias("s")).select("k", "s.start", "s.end", "s.text", F.round("s.confidence", 6).alias("confidence"), "s.reason").filter("not reason like '%normalized'")


_MORE = "select o_orderkey as c, cast(110101199001010000 + o_orderkey % 1000 as {s}) as id, 'user@mail.org' as mail, '北京路' || cast(o_orderkey % 90 + 10 as {s}) || '号A' as place, '某某大学' as org, 'sk-' || lpad(cast(o_orderkey as {s}), 9, '0') as secret, 'none' as word from orders"


@query(f"""with m as ({_duck(_MORE)}), n as (select *, '110101' || cast(1980 + (c // 366) % 30 as varchar) || lpad(cast((c % 366) // 31 + 1 as varchar), 2, '0') || lpad(cast((c % 366) % 31 + 1 as varchar), 2, '0') || lpad(cast(c % 1000 as varchar), 3, '0') as base from m)
select c, base || {_CHECK} as id, substring(rpad(printf('u%03d', c), 4, 'x'), 1, 4) || '@mail.org' as mail, '某某某' || right(printf('%04d', c), 2) || '某X' as place, substring(rpad(printf('组织%02d', c), 4, 'X'), 1, 4) as org from n""")
def mask_forms_of_ids(spark, sf_dir):
    """Masks of identity numbers with a right check character, of addresses, local parts and organisations."""
    rows, c = _sql(spark, sf_dir, _MORE, "orders"), F.col("c")
    kinds = {"id": "IDCN", "mail": "EMAIL", "place": "ADDRESS", "org": "ORG"}
    return rows.select("c", *[masks.mask(F.lit(kind), F.col(name), c).alias(name) for name, kind in kinds.items()])


@query("select c_custkey as k, substring(sha256(c_name || ':' || c_mktsegment), 1, 16) as project from customer")
def project_ids(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), vaults.project_id(F.col("c_name"), F.col("c_mktsegment")).alias("project"))


_KINDS = "PERSON NAME PHONE PHONE_NUMBER EMAIL EMAIL_ADDRESS ID IDCN CN_ID_CARD ADDRESS LOCATION DATE DATE_TIME URL HEALTH".split()
_KNOWN_AS = "PERSON PERSON PHONE PHONE EMAIL EMAIL IDCN IDCN IDCN ADDRESS ADDRESS DATE_TIME DATE_TIME URL UNKNOWN".split()
_LABELS = "account_number private_address private_date private_email private_person private_phone private_url secret other".split()
_LABELLED = "ACCOUNT_NUMBER ADDRESS DATE_TIME EMAIL PERSON PHONE URL SECRET UNKNOWN".split()


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


@query(f"select p_partkey as k, {_list_sql(_KNOWN_AS)}[p_partkey % 15 + 1] as by_model, {_list_sql(_LABELLED)}[p_partkey % 9 + 1] as by_filter from part")
def type_names(spark, sf_dir):
    """What a language model's and a token classifier's names of types are called here."""
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("p_partkey") % len(values)).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), model_type(F.concat(F.lit(" "), F.lower(pick(_KINDS)))).alias("by_model"), label_type(pick(_LABELS)).alias("by_filter"))


@query("select c_custkey as k, case when c_custkey % 3 = 2 then 'DATE_TIME' else 'ORG' end as type, case c_custkey % 3 when 0 then '浙江师范学校' when 1 then '杭州大学' else '1971.11' end as text, case c_custkey % 3 when 0 then 12 when 1 then 18 else 10 end as \"start\" from customer")
def refined_dates(spark, sf_dir):
    """Dates that swallowed a school's name give way to it."""
    text = F.when(F.col("c_custkey") % 3 == 0, "9.浙江师范学校毕业").when(F.col("c_custkey") % 3 == 1, "2001年9月 杭州大学学习").otherwise("1971.11")
    x = F.struct(F.lit(10).alias("start"), (F.length(text) + 10).alias("end"), text.alias("text"))
    spans = refined(F.array(layers.span(x, "DATE_TIME", "privacy_filter", 1.0, "privacy_filter:private_date")))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(spans).alias("s")).select("k", "s.type", "s.text", F.col("s.start").alias("start"))


def _made_files(spark, sf_dir) -> DataFrame:
    """path and content of files of eight formats made of nations, with the nation's key and name."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kinds = n.select("*", F.explode(F.array(*[F.lit(x) for x in ("txt", "md", "json", "csv", "yaml", "docx", "pptx", "xlsx")])).alias("kind"))

    @F.pandas_udf("binary")
    def make(kind: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([_made(k, x) for k, x in zip(kind, name, strict=True)])

    return kinds.select("n_nationkey", "n_name", "kind", F.concat(F.lit("/d/f"), F.col("n_nationkey").cast("string"), F.lit("."), F.col("kind")).alias("path"), make("kind", "n_name").alias("content"))


def _made(kind: str, name: str) -> bytes:
    if kind in ("docx", "pptx", "xlsx"):
        part, body = {
            "docx": ("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'),
            "pptx": ("ppt/slides/slide1.xml", '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{a}</a:t></a:r><a:r><a:t>{b}</a:t></a:r></a:p><a:p><a:r><a:t>end</a:t></a:r></a:p></p:sld>'),
            "xlsx": ("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{a}{b}</t></is></c><c r="B1" t="inlineStr"><is><t>end</t></is></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'),
        }[kind]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as box:
            box.writestr(part, body.format(a=name[:3], b=name[3:]))
        return out.getvalue()
    return {"txt": f"{name}\nend", "md": f"{name} `code` end", "json": json.dumps({"k": {"name": [name, 1]}, "e": "end"}), "csv": f"{name},end\n", "yaml": f"k:\n  name: [{name}, 1]\ne: end\n"}[kind].encode()


#: Segments of those files: of each kind the number, text and place of each.
_MADE_SQL = """select k, kind, seg_no, case when seg_no = 0 then replace(first, '@', n_name) else second end as text, case when seg_no = 0 then place0 else place1 end as location from
(select n_nationkey as k, n_name, length(n_name) as l from nation), lateral (select * from (values ('txt', '@' || chr(10) || 'end', null, 'file', null), ('md', '@ ', ' end', 'text:0-' || cast(l + 1 as varchar), 'text:' || cast(l + 7 as varchar) || '-' || cast(l + 11 as varchar)), ('json', '@', 'end', 'json:k.name[0]', 'json:e'),
('csv', '@', 'end', 'csv:row0:col0', 'csv:row0:col1'), ('yaml', '@', 'end', 'yaml:k.name[0]', 'yaml:e'), ('docx', '@', 'end', 'word/document.xml:0', 'word/document.xml:1'), ('pptx', '@', 'end', 'ppt/slides/slide1.xml:0', 'ppt/slides/slide1.xml:1'), ('xlsx', '@', 'end', 'xl/worksheets/sheet1.xml:A1', 'xl/worksheets/sheet1.xml:B1')) t(kind, first, second, place0, place1)), (select unnest([0, 1]) as seg_no) where seg_no = 0 or second is not null"""


@query(_MADE_SQL)
def file_segments(spark, sf_dir):
    """Files of eight formats as segments, with their places."""
    files = _made_files(spark, sf_dir)
    found = segments_of(files).join(files.select("path", F.col("n_nationkey").alias("k"), "kind"), "path")
    return found.select("k", "kind", "seg_no", "text", "location")


@query(f"select k, kind, seg_no, case when seg_no = 0 then replace(text, n_name, '<' || cast(k as varchar) || '>') else text end as text, location, changes from (select * exclude (location), case when kind = 'md' then 'text' else location end as location, cast(1 as bigint) as changes from ({_MADE_SQL})) join nation on n_nationkey = k")
def processed_files(spark, sf_dir):
    """Files of eight formats with a value replaced, read again."""
    files = _made_files(spark, sf_dir)
    pairs = F.create_map("n_name", F.concat(F.lit("<"), F.col("n_nationkey").cast("string"), F.lit(">")))
    done = saved(process_files(files.select("path", "content", pairs.alias("pairs"))))
    found = segments_of(done.select("path", "content")).join(files.select("path", F.col("n_nationkey").alias("k"), "kind"), "path").join(done.select("path", "changes"), "path")
    place = F.when(F.col("kind") == "md", "text").otherwise(F.col("location"))  # places in Markdown move with the texts before them
    return found.select("k", "kind", "seg_no", "text", place.alias("location"), "changes")


@query(f"select k, kind, seg_no, case when seg_no = 0 and kind in ('docx', 'pptx', 'xlsx') then '#' || substring(text, 2) else text end as text from ({_MADE_SQL}) where kind in ('docx', 'pptx', 'xlsx', 'json', 'txt')")
def spliced_files(spark, sf_dir):
    """Edits by place: the first letter of the first segment of Office files, and nothing where the original is not what stands there."""
    files = _made_files(spark, sf_dir).filter("kind in ('docx', 'pptx', 'xlsx', 'json', 'txt')")
    place = F.when(F.col("kind") == "docx", "word/document.xml:0").when(F.col("kind") == "pptx", "ppt/slides/slide1.xml:0").when(F.col("kind") == "xlsx", "xl/worksheets/sheet1.xml:A1").when(F.col("kind") == "json", "json:k.name[0]").otherwise("file")
    fits = F.when(F.col("kind").isin("json", "txt"), "?").otherwise(F.substring("n_name", 1, 1))
    edits = F.array(F.struct(place.alias("location"), F.lit(0).alias("start"), F.lit(1).alias("end"), fits.alias("original"), F.lit("#").alias("masked")))
    done = splice_files(files.select("path", "content", edits.alias("edits")))
    return segments_of(done).join(files.select("path", F.col("n_nationkey").alias("k"), "kind"), "path").select("k", "kind", "seg_no", "text")


@query(f"select doc_id, '<person ' || substring(text, 5, 2) || '>' as masked, substring(text, 5, 2) as original from ({CARDS_DUCK})")
def span_replacements(spark, sf_dir):
    """Replacements made of spans by a function, and the way back from their masks."""
    spans = layers.person_fields(F.col("text"))
    made = replacements_of(spans, lambda text, kind: F.concat(F.lit("<"), F.lower(kind), F.lit(" "), text, F.lit(">")))
    return _cards(spark, sf_dir).select("doc_id", F.explode(originals_of(made)).alias("masked", "original"))


@query("select c_custkey as k, case when c_custkey % 2 = 0 then '甲' || cast(c_custkey as varchar) else '甲' || cast(c_custkey as varchar) || '2' end as second, case when c_custkey % 2 = 0 then 'UNKNOWN' else 'PERSON' end as type from customer")
def sectioned_replies(spark, sf_dir):
    """Older replies of a model: a replacement that an earlier line has gets a number."""
    k = F.col("c_custkey").cast("string")
    first = F.when(F.col("c_custkey") % 2 == 0, "乙").otherwise(F.concat(F.lit("甲"), k))
    last = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(" | PERSON")
    reply = F.concat(F.lit("===脱敏文本===\nx\n===映射表===\na -> "), first, F.lit("\nb -> 甲"), k, last)
    got = sectioned_reply(reply)
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), got["mappings"]["b"].alias("second"), got["types"]["b"].alias("type"))


def masked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: contact cards, masked."""
    return masked_documents(spark, sf_dir)

