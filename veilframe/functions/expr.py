"""Column expressions on text: matches with offsets, digit templates, number systems, checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<start:int,end:int,text:string>"
DIGIT = "(?U)^\\d$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, and only where the result is needed."""
    return F.transform(F.array(value), body)[0]


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def chars(text: Column) -> Column:
    """Code points of a text, none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,text>> of a pattern's matches, left to right, in code points.

    With a group, which must end where the match ends, its span is given instead. Offsets come from a running sum
    over the lengths of the texts between matches and of the matches. A cheap test comes first, so that texts without
    a match cost one search.
    """

    def placed(whole: Column) -> Column:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(whole)), F.length)
        rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + x["gap"] + F.length(x["whole"])
            span = F.struct((end - F.length(x["part"])).cast("int").alias("start"), end.cast("int").alias("end"), x["part"].alias("text"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty(MATCH).alias("out")), step, lambda acc: acc["out"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(pattern), found).otherwise(empty(MATCH))


def fill_digits(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, one by one, by those of `digits`."""

    def filled(digits: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            hit = c.rlike(DIGIT)
            return F.struct(F.concat(acc["out"], F.when(hit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + F.when(hit, 1).otherwise(0)).alias("i"))

        return F.aggregate(chars(template), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])

    return let(digits, filled)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\D", "")


def padded(number: Column, width: Column) -> Column:
    """The number with zeros in front to `width` characters, of longer ones the last `width`."""
    text = number.cast("string")
    return F.right(F.lpad(text, F.greatest(width, F.length(text)), F.lit("0")), width)


def base36(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 36)


def column_number(letters: Column) -> Column:
    """A spreadsheet column's letters as a number, A = 1."""
    return F.aggregate(chars(F.upper(letters)), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


# Weights and check characters of 18-digit identity numbers.
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CHECKS = "10X98765432"


def check_character(first17: Column) -> Column:
    """Check character of the first 17 digits of an identity number."""
    total = sum((F.substring(first17, i + 1, 1).cast("int") * w for i, w in enumerate(_WEIGHTS)), F.lit(0))
    return F.substring(F.lit(_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))


def valid_identity(number: Column) -> Column:
    return F.when(number.rlike("^[0-9]{17}[0-9Xx]$"), F.upper(F.right(number, F.lit(1))) == check_character(number)).otherwise(F.lit(False))


def occurrences(text: Column, key: Column) -> Column:
    """How often key stands in text, without overlaps."""
    return F.when(F.length(key) > 0, ((F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")
