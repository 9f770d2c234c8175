"""Pattern recognisers without digit boundaries, irreversible masking, and entities named by a language model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.expr import let, matches, occurrences
from veilframe.operators.detect import numbered, register, span
from veilframe.operators.merge import recognised
from veilframe.operators.name_words import PATTERN_CONTEXT, PATTERN_SURNAMES

_SURNAME = f"[{''.join(PATTERN_SURNAMES)}]"
# Patterns with their scores, in the order in which ties are settled.
PATTERNS = (
    ("PHONE_NUMBER", "(?U)1[3-9]\\d{9}", 0.9, "chinese_phone"),
    ("PHONE_NUMBER", "(?U)1[3-9]\\d[- ]?\\d{4}[- ]?\\d{4}", 0.85, "chinese_phone_sep"),
    ("CN_ID_CARD", "(?U)[1-9]\\d{5}(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dXx]", 0.95, "chinese_id_18"),
    ("CN_ID_CARD", "(?U)[1-9]\\d{5}\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}", 0.85, "chinese_id_15"),
    ("PERSON", f"{_SURNAME}[\\u4e00-\\u9fa5]", 0.4, "chinese_name_2"),
    ("PERSON", f"{_SURNAME}[\\u4e00-\\u9fa5]{{2}}", 0.5, "chinese_name_3"),
    ("PERSON", f"{_SURNAME}[\\u4e00-\\u9fa5]{{3}}", 0.4, "chinese_name_4"),
)


# How far from a name a context word counts, in words before it, what it adds, and the least score then.
CONTEXT_WORDS_BEFORE = 5
CONTEXT_BONUS = 0.35
CONTEXT_LEAST = 0.4


def _with_context(x: Column, text: Column) -> Column:
    """A name's score, raised where one of the last words before it, or its own, is a context word."""
    words = F.split(F.rtrim(F.substring(text, F.lit(1), x["start"])), "[\\s,，。；;：:、]+")
    before = let(F.filter(words, lambda w: w != ""), lambda w: F.slice(w, F.greatest(F.size(w) - (CONTEXT_WORDS_BEFORE - 1), F.lit(1)), CONTEXT_WORDS_BEFORE))
    near = F.concat_ws(" ", F.when(x["start"] > 0, before).otherwise(F.array().cast("array<string>")), x["text"])
    told = F.lit(False)
    for word in PATTERN_CONTEXT:
        told = told | F.contains(near, F.lit(word))
    return F.when(told & (x["type"] == "PERSON"), x.withField("confidence", F.least(F.greatest(x["confidence"] + CONTEXT_BONUS, F.lit(CONTEXT_LEAST)), F.lit(1.0)))).otherwise(x)


def pattern_layer(text: Column) -> Column:
    """array<span> of all patterns, before any conflict is settled (see merge.recognised)."""

    def of(kind: str, pattern: str, score: float, name: str) -> Column:
        return F.transform(matches(text, pattern), lambda x: span(x, kind, "heuristic", score, name))

    return numbered(F.concat(*[of(*p) for p in PATTERNS]))


def analysed(text: Column, entities: Sequence[str] | None = None, strategy: str = "highest_score") -> Column:
    """array<span> as the pattern engine reports them: all patterns, or those of the named types, names with a context word
    near them scored higher, and conflicts settled. What a model verified is left to verified()."""
    found = pattern_layer(text)
    if entities is not None:
        found = F.filter(found, lambda x: x["type"].isin(*entities))
    return let(F.transform(found, lambda x: _with_context(x, text)), lambda rows: recognised(rows, strategy))


def verified(spans: Column, reply: Column) -> Column:
    """Spans after a model's verdicts, written as text:Y or text:N: rejected ones go, confirmed ones gain 0.1, all others stay."""

    def of(x: Column) -> Column:
        says = lambda letter: F.contains(reply, F.concat(x["text"], F.lit(f":{letter}"))) | F.contains(reply, F.concat(x["text"], F.lit(f":{letter.lower()}")))
        yes = x.withField("confidence", F.least(x["confidence"] + 0.1, F.lit(1.0))).withField("source", F.lit("llm_judge"))
        return F.when(reply.isNull(), x).when(says("Y"), yes).when(says("N"), F.lit(None)).otherwise(x)

    return F.filter(F.transform(spans, of), lambda x: x.isNotNull())


register("patterns", pattern_layer, 40)
register("analysed", analysed, 40)

#: What an irreversible mask of a type looks like; DEFAULT stands for all others.
POLICIES: dict[str, Callable[[Column], Column]] = {
    "DEFAULT": lambda value: F.lit("<MASKED>"),
    "PERSON": lambda value: F.lit("<人名>"),
    "PHONE_NUMBER": lambda value: F.concat(F.repeat(F.lit("*"), F.least(F.length(value), F.lit(5)).cast("int")), F.substring(value, F.lit(6), F.length(value))),
}


def anonymised(spans: Column, policies: Mapping[str, Callable[[Column], Column]] = POLICIES) -> Column:
    """Replacements (for splice.spliced) of spans by masks that can't be undone."""

    def masked(x: Column) -> Column:
        out = policies["DEFAULT"](x["text"])
        for kind, policy in policies.items():
            if kind != "DEFAULT":
                out = F.when(x["type"] == kind, policy(x["text"])).otherwise(out)
        return out

    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("original"), masked(x).alias("masked")))


def model_kind(kind: Column) -> Column:
    """A language model's name of a type as it is counted and kept; only the names that differ are changed."""
    name = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(name.isin("ID", "CN_ID_CARD", "ID_CARD"), "IDCN").when(name == "PHONE_NUMBER", "PHONE").when(name == "EMAIL_ADDRESS", "EMAIL").when(name == "DATE", "DATE_TIME").when(name == "LOCATION", "ADDRESS").when(name == "", "UNKNOWN").otherwise(name)


def first_types(replies: DataFrame) -> DataFrame:
    """doc_id, original, type from entities of pieces (doc_id, chunk, original, type): the first piece that names a text decides."""
    return replies.groupBy("doc_id", "original").agg(F.min_by("type", "chunk").alias("type"))


def counted_entities(documents: DataFrame, named: DataFrame) -> DataFrame:
    """type and n: how often texts named by a model (doc_id, original, type) stand in their documents."""
    rows = named.join(documents.select("doc_id", "text"), "doc_id")
    return rows.groupBy(model_kind(F.col("type")).alias("type")).agg(F.sum(occurrences(F.col("text"), F.col("original"))).alias("n"))


