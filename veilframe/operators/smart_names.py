"""Names among segmented words, with a model's entities and its verdicts: the layer above the heuristic one.

A segmenter (text -> words with their places), an entity model and a model that judges candidates are parameters; the
two libraries that usually provide the first are used where they are installed. Without any of them nothing is found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.operators.name_words import DIVISIONS, NOT_WORDS, WORD_COMPOUND, WORD_NEAR, WORD_SURNAMES, WORD_TITLES
from veilframe.types import SPAN

Segmenter = Callable[[str], Iterable[tuple[str, int, int]]]
Entities = Callable[[str], Iterable[tuple[int, int, str]]]
Judge = Callable[[str, list[str]], str]

_IDEOGRAPHS = re.compile("[一-鿿]{2,4}")
_INNER_BLANKS = re.compile("(?<=[一-鿿])[ 　]+(?=[一-鿿])")
_NEAR = re.compile("|".join(WORD_NEAR))
_SURNAMES, _COMPOUND, _NOT_WORDS = frozenset(WORD_SURNAMES), frozenset(WORD_COMPOUND), frozenset(NOT_WORDS)
#: Candidates that a model is asked about, characters of the text it sees, and what its consent adds, up to a limit.
ASKED, SEEN, CONSENT, SUREST = 15, 500, 0.1, 0.95


def installed_segmenter() -> Segmenter | None:
    """The segmenter of jieba, where that is installed."""
    try:
        import jieba
    except ImportError:
        return None
    return jieba.tokenize


def valid_name(value: str) -> bool:
    """Two to four ideographs that begin with a surname and are neither a known word nor an administrative unit."""
    if not _IDEOGRAPHS.fullmatch(value) or value in _NOT_WORDS or value.endswith(DIVISIONS):
        return False
    return value[0] in _SURNAMES or value[:2] in _COMPOUND


def word_confidence(text: str, start: int, end: int) -> float:
    """How sure a word is a name by what stands around it: a title behind, a colon before, telling words near, its length."""
    sure = 0.5
    if text.startswith(WORD_TITLES, end):
        sure += 0.35
    if re.search("[：:]", text[max(0, start - 3) : start]):
        sure += 0.3
    if _NEAR.search(text, max(0, start - 20), end + 20):
        sure += 0.2
    sure += {3: 0.1, 4: -0.1}.get(end - start, 0.0)
    return min(max(sure, 0.0), 0.95)


def closed_up(text: str) -> tuple[str, list[int]]:
    """The text without blanks between ideographs, and where each of its characters stands in the original."""
    parts, places, at = [], [], 0
    for gap in [m.span() for m in _INNER_BLANKS.finditer(text)] + [(len(text), len(text))]:
        parts.append(text[at : gap[0]])
        places.extend(range(at, gap[0]))
        at = gap[1]
    return "".join(parts), places


def _candidates(text: str, segment: Segmenter | None, entities: Entities | None, least: float) -> list[tuple[int, int, float, str]]:
    found = [(a, b, 0.85, "spacy_ner:PERSON") for a, b, label in (entities(text) if entities else ()) if label == "PERSON" and valid_name(text[a:b])]
    for word, a, b in segment(text) if segment else ():
        if valid_name(word) and (sure := word_confidence(text, a, b)) >= least:
            found.append((a, b, sure, "jieba_word_name"))
    return found


def verdicts(reply: str) -> list[bool]:
    """A model's answers, line by line: Y or N in front, else whichever of them stands in the line; what says neither consents."""
    out = []
    for line in reply.strip().split("\n"):
        line = line.strip().upper()
        out.append(line[:1] == "Y" or (line[:1] != "N" and ("N" not in line)))
    return out


def smart_names(text: str, segment: Segmenter | None = None, entities: Entities | None = None, judge: Judge | None = None, strict: bool = False) -> list[dict]:
    """Spans of names, by start, without overlaps; of two that overlap the one that begins first or is surer.

    Words are looked for in the text, and in the text with blanks between ideographs closed up, whose finds are put
    back where they stand. judge gets the text's beginning and the candidates and answers with a line for each; what
    it rejects goes.
    """
    least = 0.75 if strict else 0.55
    found = [(a, b, sure, why, text[a:b]) for a, b, sure, why in _candidates(text, segment, entities, least)]
    closed, place = closed_up(text)
    if closed != text:
        found += [(place[a], place[b - 1] + 1, sure, f"{why}+normalized", closed[a:b]) for a, b, sure, why in _candidates(closed, segment, entities, least)]
    kept: list[tuple[int, int, float, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[2])):
        if not kept or x[0] >= max(y[1] for y in kept):
            kept.append(x)
    if judge and kept:
        asked = list(dict.fromkeys(x[4] for x in kept[:ASKED]))
        rejected = {value for value, good in zip(asked, verdicts(judge(text[:SEEN], asked)), strict=False) if not good}
        kept = [(a, b, min(sure + CONSENT, SUREST), f"{why}+llm_kept", value) for a, b, sure, why, value in kept if value not in rejected]
    return [{"seq": 0, "start": a, "end": b, "text": value, "type": "PERSON", "source": "heuristic", "confidence": sure, "reason": why} for a, b, sure, why, value in kept]


def smart_layer(text: Column, segment: Segmenter | None = None, entities: Entities | None = None, judge: Judge | None = None, strict: bool = False) -> Column:
    """array<span> of smart_names(), for detect.register(). Without a segmenter the installed one is taken, if there is one."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series) -> pd.Series:
        own = segment or installed_segmenter()
        return texts.map(lambda t: smart_names(t, own, entities, judge, strict) if t else [])

    return run(F.when(text.rlike("[\\u4e00-\\u9fff]"), text))
