"""Settling overlaps between spans, one document at a time, as folds over its array of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.expr import empty, let
from veilframe.operators.detect import overlap
from veilframe.types import SOURCE_PRIORITY, SPAN, TYPE_PRIORITY

LONGEST = 256
_RANKED = SPAN[:-1] + ",tp:int,pri:double>"


def _table(values: dict[str, int], key: Column) -> Column:
    out = F.lit(0)
    for name, value in values.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def length(x: Column) -> Column:
    return x["end"] - x["start"]


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def valid(x: Column, text: Column) -> Column:
    """In bounds, of 1 to 256 characters, and the text it says it is."""
    n = length(x)
    return (x["start"] >= 0) & (x["end"] <= F.length(text)) & (n > 0) & (n <= LONGEST) & (F.substring(text, x["start"] + 1, n) == x["text"])


def priority(x: Column) -> Column:
    return (_table(SOURCE_PRIORITY, x["source"]) + length(x) / F.lit(100.0)) + x["confidence"]


def _replaces(new: Column, old: Column) -> Column:
    same = (new["start"] == old["start"]) & (new["end"] == old["end"])
    by_source = (new["source"] == "schema") | ((new["source"] == "regex") & ~old["source"].isin("schema", "regex"))
    return (contains(new, old) & (new["pri"] > old["pri"])) | (new["tp"] > old["tp"] + 20) | (same & by_source)


def merged(spans: Column, text: Column, safe: bool = False) -> Column:
    """Spans of a document after conflicts are settled, by start.

    Spans are taken in order of start, falling priority, falling length and place in the input. A new one is dropped
    if an accepted one contains it at the same or a higher type priority, or wins over it; accepted ones that it wins
    over go. Where neither wins both stay, so overlaps may remain. safe makes one span of what still overlaps (type
    and source of the first), so that no part of a value is left in clear.
    """
    fine = F.filter(spans, lambda x: valid(x, text))
    ranked = F.transform(fine, lambda x: x.withField("tp", _table(TYPE_PRIORITY, x["type"])).withField("pri", priority(x)))
    keyed = F.array_sort(F.transform(ranked, lambda x: F.struct(x["start"].alias("k1"), (-x["pri"]).alias("k2"), (-length(x)).alias("k3"), x["seq"].alias("k4"), x.alias("x"))))
    rows = F.transform(keyed, lambda k: k["x"])

    def step(acc: Column, new: Column) -> Column:
        drop = F.exists(acc, lambda old: overlap(old, new) & ((contains(old, new) & (old["tp"] >= new["tp"])) | (~_replaces(new, old) & _replaces(old, new))))
        return F.when(drop, acc).otherwise(F.concat(F.filter(acc, lambda old: ~(overlap(old, new) & _replaces(new, old))), F.array(new)))

    def settle(rows: Column) -> Column:
        kept = F.aggregate(rows, F.slice(rows, 1, 0), step)
        plain = F.transform(kept, lambda x, i: F.struct(x["start"].alias("k1"), i.alias("k2"), x.dropFields("tp", "pri").alias("x")))
        out = F.transform(F.array_sort(plain), lambda k: k["x"])
        return _united(out, text) if safe else out

    return let(rows, settle)


def _united(spans: Column, text: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["end"], x["end"])
        joint = last.withField("end", end).withField("text", F.substring(text, last["start"] + 1, end - last["start"]))
        return F.when(F.size(acc) == 0, F.array(x)).when(overlap(last, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joint))).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.size(spans) == 0, spans).otherwise(let(spans, lambda s: F.aggregate(s, empty(SPAN), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))))


def deduplicated(spans: Column) -> Column:
    """The first of each (start, end, text, type)."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["text"] == b["text"]) & (a["type"] == b["type"])
    return let(spans, lambda s: F.filter(s, lambda x, i: ~F.exists(F.slice(s, 1, i), lambda y: same(x, y))))


def first_wins(spans: Column) -> Column:
    """Spans by start and falling confidence, without those that overlap one kept before."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("k1"), (-x["confidence"]).alias("k2"), x["seq"].alias("k3"), x.alias("x"))))
    return let(F.transform(keyed, lambda k: k["x"]), lambda rows: F.aggregate(rows, F.slice(rows, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))


def recognised(spans: Column, strategy: str = "highest_score") -> Column:
    """Recogniser results by start, falling confidence and falling length; each meets the first kept one that it
    overlaps: the better by confidence (highest_score) or length (longest) stays in its place, or the first one (first)."""
    if strategy not in ("highest_score", "longest", "first"):
        raise ValueError(f"no such strategy: {strategy}")
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("k1"), (-x["confidence"]).alias("k2"), (-length(x)).alias("k3"), x["seq"].alias("k4"), x.alias("x"))))
    better = {"highest_score": lambda new, old: new["confidence"] > old["confidence"], "longest": lambda new, old: length(new) > length(old), "first": lambda new, old: F.lit(False)}[strategy]

    def step(acc: Column, new: Column) -> Column:
        hit = F.array_position(F.transform(acc, lambda old: overlap(new, old)), F.lit(True))
        put = F.transform(acc, lambda old, i: F.when((i + 1 == hit) & better(new, old), new).otherwise(old))
        return F.when(hit == 0, F.concat(acc, F.array(new))).otherwise(put)

    out = let(F.transform(keyed, lambda k: k["x"]), lambda rows: F.aggregate(rows, F.slice(rows, 1, 0), step))
    return F.transform(F.array_sort(F.transform(out, lambda x, i: F.struct(x["start"].alias("k1"), i.alias("k2"), x.alias("x")))), lambda k: k["x"])
