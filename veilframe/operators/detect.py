"""Detection layers: a text column in, an array of spans out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.expr import has_cjk, matches, valid_identity

# Patterns. (?U) makes \d and \s cover all of Unicode, (?iu) ignores case there.
PHONE = "(?U)(?<![0-9])1[3-9]\\d{9}(?![0-9])"
EMAIL = "(?iu)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
IDENTITY = "(?U)(?<![0-9Xx])[1-9]\\d{5}(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dXx](?![0-9Xx])"
URL = "(?iU)https?://(?:www\\.)?[a-zA-Z0-9]+(?:[.-][a-zA-Z0-9]+)*\\.[a-zA-Z]{2,}(?:/[^\\s<>\"']*)?"
PHONE_SEPARATED = "(?U)(?<![0-9])1[3-9]\\d[-\\s]?\\d{4}[-\\s]?\\d{4}(?![0-9])"
LANDLINE = "(?U)(?<![0-9])0\\d{2,3}[-\\s]?\\d{7,8}(?![0-9])"
PERSONAL_HOSTS = ("person.zju.edu.cn", "homepage.zju.edu.cn", "github.com", "linkedin.com", "researchgate.net", "scholar.google.com", "orcid.org", "weibo.com", "zhihu.com")

# Field labels, the separator behind them, and values that are no names.
SEPARATOR = "(?:[ \\t]*[：:=][ \\t]*|[ \\t]*\\n[ \\t]*)"
PERSON_LABELS = ("姓名", "申报人", "联系人", "负责人", "申请人", "填报人")
ACCOUNT_LABELS = ("学号", "工号", "账号", "帐号", "账户", "银行账号", "银行卡号", "证件号")
SECRET_LABELS = ("api key", "apikey", "api_key", "token", "secret", "password", "passwd", "密码", "密钥")
NOT_PERSON_ENDS = ("局", "厅", "委", "办", "院", "校", "处", "科", "所", "中心", "公司", "单位", "大学", "学院", "学校", "教育局")
NOT_PERSONS = ("专业", "个人主页", "手机号码", "联系电话", "联系方式", "邮箱", "电子邮箱", "单位", "所在单位", "学院", "学校", "部门", "职称", "职务", "奖项", "序号")


def span(x: Column, kind: str, source: str, confidence: Column | float, reason: Column | str | None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    fields = [F.lit(0).alias("seq"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(kind).alias("type"), F.lit(source).alias("source"), lit(confidence).cast("double").alias("confidence"), lit(reason).cast("string").alias("reason")]
    return F.struct(*fields)


def numbered(spans: Column) -> Column:
    """Spans with their place in the array as seq, which settles ties later on."""
    return F.transform(spans, lambda x, i: x.withField("seq", i))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def phones(text: Column, reason: str | None = None) -> Column:
    return F.transform(matches(text, PHONE), lambda x: span(x, "PHONE", "regex", 1.0, reason))


def emails(text: Column, reason: str | None = None) -> Column:
    return F.transform(matches(text, EMAIL), lambda x: span(x, "EMAIL", "regex", 1.0, reason))


def identities(text: Column, reason: str | None = None) -> Column:
    return F.transform(matches(text, IDENTITY), lambda x: span(x, "IDCN", "regex", 1.0, reason))


def checked_identities(text: Column) -> Column:
    """Identity numbers, those with a wrong check character at lower confidence."""
    return F.transform(matches(text, IDENTITY), lambda x: span(x, "IDCN", "regex", F.when(valid_identity(x["text"]), 1.0).otherwise(0.7), F.when(~valid_identity(x["text"]), "checksum_failed")))


def separated_phones(text: Column) -> Column:
    """Phones with separators that overlap no plain phone."""
    plain = matches(text, PHONE)
    found = F.filter(matches(text, PHONE_SEPARATED), lambda x: ~F.exists(plain, lambda p: overlap(p, x)))
    return F.transform(found, lambda x: span(x, "PHONE", "regex", 0.95, "regex:phone_with_sep"))


def landlines(text: Column) -> Column:
    """Not part of any layer: an addition for callers who want it."""
    return F.transform(matches(text, LANDLINE), lambda x: span(x, "PHONE", "regex", 0.95, "regex:landline"))


def _personal(url: Column) -> Column:
    out = F.lit(False)
    for host in PERSONAL_HOSTS:
        out = out | F.contains(F.lower(url), F.lit(host))
    return out


def urls(text: Column) -> Column:
    """URLs of personal pages: known hosts, or a user's path."""
    kept = F.filter(matches(text, URL), lambda x: _personal(x["text"]) | F.contains(x["text"], F.lit("/~")) | F.lower(x["text"]).rlike("/[a-z]+[0-9]*$"))
    return F.transform(kept, lambda x: span(x, "URL", "regex", F.when(_personal(x["text"]), 0.95).otherwise(0.8), F.when(_personal(x["text"]), "regex:personal_url").otherwise("regex:url")))


def regex_layer(text: Column) -> Column:
    return F.concat(phones(text, "regex:phone"), emails(text, "regex:email"), identities(text, "regex:idcn"), separated_phones(text), urls(text))


def _field(text: Column, labels: Sequence[str], value: str, flags: str = "") -> Column:
    return matches(text, f"{flags}(?:{'|'.join(labels)}){SEPARATOR}{value}", 1)


def public_body(value: Column) -> Column:
    out = value.isin(*NOT_PERSONS)
    for end in NOT_PERSON_ENDS:
        out = out | F.endswith(value, F.lit(end))
    return out


def person_fields(text: Column) -> Column:
    found = F.filter(_field(text, PERSON_LABELS, "([\\u4e00-\\u9fff]{2,4})"), lambda x: ~public_body(x["text"]))
    return F.transform(found, lambda x: span(x, "PERSON", "schema", 0.98, "schema:person_field"))


def account_fields(text: Column) -> Column:
    return F.transform(_field(text, ACCOUNT_LABELS, "([A-Za-z0-9][A-Za-z0-9_-]{5,31})", "(?iu)"), lambda x: span(x, "ACCOUNT_NUMBER", "schema", 0.95, "schema:account_field"))


def secret_fields(text: Column) -> Column:
    # the value's own characters leave out the signs that are stripped behind it, so that there is nothing to strip
    return F.transform(_field(text, SECRET_LABELS, "([A-Za-z0-9][A-Za-z0-9_.:/+=-]{5,127})", "(?iu)"), lambda x: span(x, "SECRET", "schema", 0.95, "schema:secret_field"))


def schema_layer(text: Column) -> Column:
    return F.concat(person_fields(text), account_fields(text), secret_fields(text))


#: Layers by name: what turns a text column into an array of spans. Models are added by register().
LAYERS: dict[str, Callable[[Column], Column]] = {"schema": schema_layer, "regex": regex_layer}
_PRIORITY: dict[str, int] = {"schema": 100, "regex": 90}


#: Engine names that stand for a layer, most of which wrap a model that the caller registers.
ENGINES = {"privacy-filter": "privacy_filter", "privacy-filter-mlx": "privacy_filter_mlx", "qwen": "llm_scan", "presidio": "analysed"}
#: Names of the layers that hybrid detection takes between regex and names.
MODELS: set[str] = set()


def register(name: str, layer: Callable[[Column], Column], priority: int = 50, hybrid: bool = False) -> None:
    """Adds a layer, for instance a pandas UDF around a model that returns array<span>; hybrid: it takes part in hybrid detection."""
    LAYERS[name] = layer
    _PRIORITY[name] = priority
    (MODELS.add if hybrid else MODELS.discard)(name)


def registered() -> list[str]:
    """Names of the layers, those of the highest priority first."""
    return sorted(LAYERS, key=lambda n: -_PRIORITY[n])


def detected(text: Column, engine: str = "hybrid", rules=None) -> Column:
    """All spans of an engine's layers before they are merged, numbered in layer order.

    hybrid is schema, regex, a registered model and names (where the text has an ideograph); regex and schema are
    those layers; the names in ENGINES stand for layers; any other name is a registered layer. rules: of the name layer, see names.NameRules.
    """
    from veilframe.operators.names import NameRules, name_layer

    text = F.coalesce(text, F.lit(""))
    if engine == "hybrid":
        parts = [schema_layer(text), regex_layer(text), *[LAYERS[n](text) for n in registered() if n in MODELS]]
        return numbered(F.concat(*parts, name_layer(F.when(has_cjk(text), text), rules or NameRules())))
    name = ENGINES.get(engine, engine)
    if name not in LAYERS:
        needs = f"engine {engine} needs a model: add it with register({name!r}, layer)" if engine in ENGINES else f"no such engine: {engine}; known are hybrid, {', '.join([*ENGINES, *LAYERS])}"
        raise ValueError(needs)
    return numbered(LAYERS[name](text))
