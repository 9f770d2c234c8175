"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blank characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
_BLANKS = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """reject: true for a document to be dropped, of a mapping from measure names to columns; a null counts as false.
    needs: the measures it reads, which decide what it costs."""

    name: str
    reject: Callable[[Mapping[str, Column]], Column]
    needs: tuple[str, ...]


#: The two base rules come with fixed limits. The others are set wide, so that ordinary prose of any kind stays.
BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50, ("n_words",)),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], ("n_words", "n_repeat_words")),
)
DEFAULT_RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], ("n_words", "n_symbols")),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), ("n_words", "word_chars")),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 5 * m["n_lines"], ("n_lines", "n_dup_lines")),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 6 * m["word_chars"], ("word_chars", "n_capitals")),
    Rule("exclamations", lambda m: 10 * m["n_exclamations"] > 5 * m["n_words"], ("n_words", "n_exclamations")),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: inside a lambda of its own an expression would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def window_keys(words: Column, bits: Column) -> Column:
    """Sorted keys of the 3-word windows: hash shifted left by `bits`, with the window's position in those bits.

    Sorting such longs brings equal windows together and keeps their places.
    """
    key = lambda i: F.call_function("shiftleft", F.xxhash64(words[i], words[i + 1], words[i + 2]), bits).bitwiseOR(i.cast("bigint"))
    return F.sort_array(F.when(F.size(words) > 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)).otherwise(F.array().cast("array<bigint>")))


def repeated_starts(words: Column, keys: Column, bits: Column) -> Column:
    """Positions of the windows whose three words stand elsewhere too.

    Of the sorted keys only neighbours whose hashes agree are looked at, and their words compared. Where the words of
    both neighbours differ, which takes windows that share a hash by chance, all others under the hash are compared.
    """
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    agree = lambda x, y: F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0, F.lit(False))
    alike = lambda a, b: (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))
    equal = lambda x, y: agree(x, y) & alike(place(x), place(y))

    def twice(x: Column, k: Column) -> Column:
        before, behind = F.get(keys, k - 1), F.get(keys, k + 1)
        return (agree(x, before) | agree(x, behind)) & (equal(x, before) | equal(x, behind) | F.exists(keys, lambda y: (y != x) & equal(x, y)))

    return F.transform(F.filter(keys, twice), place)


def covered(starts: Column) -> Column:
    """How many words windows of three with these starts cover."""
    return F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda x: x + 1), F.transform(starts, lambda x: x + 2))))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more."""
    return let(F.ceil(F.log2(F.size(words) + 1)).cast("int"), lambda bits: let(window_keys(words, bits), lambda keys: let(repeated_starts(words, keys, bits), covered)))


def measure(name: str, text: Column, words: Column) -> Column:
    """A measure as a long column.

    n_words, word_chars (code points in words), n_symbols (of # * $ % & | < >), n_lines (with a word),
    n_dup_lines (such lines equal to an earlier one), n_repeat_words, n_capitals, n_exclamations (! and ?).
    """
    made = {
        "n_words": lambda: F.size(words),
        "word_chars": lambda: F.length(F.concat_ws("", words)),
        "n_symbols": lambda: F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": lambda: F.size(lines_with_words(text)),
        "n_dup_lines": lambda: let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": lambda: repeated_words(words),
        "n_capitals": lambda: F.regexp_count(text, F.lit("[A-Z]")),
        "n_exclamations": lambda: F.regexp_count(text, F.lit("[!?]")),
    }
    return made[name]().cast("bigint")


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lean = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    return lean.withColumn("w", words_of(F.col("t")))


def measures(docs: DataFrame, names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the named measures of every whole text. Null and empty texts have no words and lines; repeated rows are
    measured each by itself; an empty table gives an empty result; other columns are ignored, whatever their names."""
    return _with_words(docs, id_col, text_col).select("doc_id", *[measure(x, F.col("t"), F.col("w")).alias(x) for x in names])


def measured_order(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second on a sample of about sample_rows rows, best first.

    The sample is drawn by a hash of the id from the whole table, however large; it decides the order alone, never
    which documents are kept. A rule's cost is the time of a job in which it judges each row `rounds` times, less the
    time of the same job without a rule.
    """
    rounds = 5
    step = max(1, docs.count() // max(1, sample_rows))
    drawn = docs.filter(docs[id_col].isNotNull() & (F.pmod(F.xxhash64(docs[id_col].cast("string"), F.lit("rules")), F.lit(step)) == 0))
    sample = drawn.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).cache()

    def judged(reject: Callable[[Mapping[str, Column]], Column], needs: Sequence[str]) -> tuple[int, float]:
        rows = sample.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_round"))
        # each round measures a text of its own, so that none is spared
        ask = measures(rows.withColumn("text", F.concat("text", F.repeat(F.lit(" "), F.col("_round")))), needs).agg(F.count_if(reject({x: F.col(x) for x in needs})).alias("n"))
        began = time.perf_counter()
        return ask.first()["n"], time.perf_counter() - began

    try:
        sample.count()
        judged(lambda m: F.lit(False), ())  # the first job also sets things up
        _, idle = judged(lambda m: F.lit(False), ())
        worth = []
        for rule in rules:
            n, seconds = judged(rule.reject, rule.needs)
            worth.append((n / max(seconds - idle, 0.05 * idle, 1e-3), rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(worth, key=lambda x: -x[0])]


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 1000, report: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures named in `report`, failed_rule (null if none fails) and kept.

    The rules stand in one CASE in the order of measured_order(): a row stops at the first that rejects it, and the
    measures of later rules are not computed for it, since they stand inside their branches. failed_rule is the
    first failing rule in that order, so it may differ between runs where several fail; kept never does. Measures in
    `report` are computed for all rows, and the rules read them from there. One narrow pass of built-in functions.
    Null and empty texts have no words; repeated rows are judged each by itself; an empty table gives an empty
    result; other columns are ignored.
    """
    ordered = measured_order(docs, rules, sample_rows, id_col, text_col)
    t, w = F.col("t"), F.col("w")
    table = _with_words(docs, id_col, text_col).select("doc_id", "t", "w", *[measure(x, t, w).alias(x) for x in report])
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.reject({x: F.col(x) if x in report else measure(x, t, w) for x in rule.needs}), F.lit(rule.name)).otherwise(verdict)
    return table.select("doc_id", *report, verdict.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())
