"""Secret scanning in built-in functions only: fixed patterns, and entropy in sliding windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.quality_rules import let


@dataclass(frozen=True)
class SecretPattern:
    """regex: matched leftmost and without overlaps. A match counts if its group `group` has min_chars characters."""

    kind: str
    regex: str
    group: int
    min_chars: int


#: Fixed values of the base scan, in the order in which kinds are listed.
BASE_PATTERNS = (
    SecretPattern("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretPattern("access", "AKIA[A-Z0-9]+", 0, 20),
    SecretPattern("hex", "[0-9a-f]+", 0, 24),
)
#: A faster test that holds wherever a pattern has a match that counts, and maybe elsewhere.
_GUARDS = {"assign": "(?i)(?:pass(?:word|wd)|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}

#: Candidate strings of the entropy scan: long runs of characters that keys are made of.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Signs that part a run, so that a key is judged without what stands beside it: = before a value (not after the name of
#: a digest), and / beside a piece made of words.
_WORDS = "[A-Z]?[a-z][a-z_-]{1,60}"
SEPARATOR = f"=(?<!(?:sha1|sha256|sha384|sha512|md5)=)(?=[A-Za-z0-9+/_-])|/(?={_WORDS}(?![A-Za-z0-9+_-]))|/(?<=(?<![A-Za-z0-9+_-]){_WORDS}/)"  # the sign comes first, so that one look at a character rules it out
#: Character classes from the narrowest to the widest, each with the least bits per character that a window of 20 must
#: reach, the 1st percentile of the entropy of 20 random characters of the class (simulated), and the share of frequent
#: letter pairs from which on a string counts as words. Digits with signs are dates, ranges and phone numbers, which are
#: never looked at: no window of 20 characters has NEVER bits.
NEVER = 9.0
CLASSES = (
    ("[0-9]+", 2.5, 1.1), ("[0-9+/_=-]+", NEVER, 1.1), ("[0-9a-fA-F]+", 2.9, 1.1), ("[a-z]+|[A-Z]+", 3.24, 0.5), ("[a-z0-9]+|[A-Z0-9]+", 3.34, 0.6),
    ("[A-Za-z]+", 3.58, 0.5), ("[A-Za-z0-9]+", 3.64, 0.6), ("[A-Za-z0-9+/_=-]+", 3.64, 0.6),
)
#: The most frequent letter pairs of English, German, French and Spanish. Words have three quarters of
#: their pairs among these 127, random letters a fifth.
_PAIRS = (
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ei ie ic ge un be sc ne me li ri ro io ll la ta el us ma il co ce da ns ss tr no so di ho ec em ai ue qu ut om pr "
    "pe po au ac ad am im ul ct ca do lo mi ni na os su vi wa we wi ow sh ee oo pa pl rs rt ts ck ig ht ir iv ol op if mo mp id ab ag ex fo fr lu tu nc"
).split()
#: Strings that look random but are no secrets: UUIDs, digests named as such, placeholders with less than a key beside them.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^(?:sha(?:1|256|384|512)|md5)[-_=]",
    "(?i)^(?>.{0,19}?(?:example|placeholder|xxxx|abcdefgh|12345678))+.{0,19}$",
)


def match_spans(text: Column, pattern: SecretPattern) -> Column:
    """array<struct<start,end>> in code points of the matches that count, from the texts between matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0)), F.split(text, pattern.regex)
    group = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group)) if pattern.group else found
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["chars"]
        return F.struct(end.alias("at"), F.when(x["long"], F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"]).alias("out"))

    parts = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("chars"), F.transform(group, lambda g: F.length(g) >= pattern.min_chars).alias("long"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


#: Windows looked at in one go. A candidate string is cut into pieces that overlap by a window, so that what is done for a
#: character does not grow with the string.
_PIECE = 128
#: The characters of candidate strings lie between these two.
_LOWEST, _HIGHEST = ord("+"), ord("z")


def peak_window(text: Column, window: int, least: Column) -> Column:
    """struct<first,last>: where the first and last window of `window` characters start whose Shannon entropy is `least`
    bits or more; nulls if there is none.

    The entropy of a window of w characters is log2(w) - s / w with s the sum of c * log2(c) over the counts c of its
    characters. Counts and s are kept from window to window: a character that enters or leaves changes one count. The
    counts stand in a text with a character for each character code, which is the cheapest array that built-in
    functions can change in one place. Counting starts anew in each piece of the string.
    """
    none = F.lit(None).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{_PIECE + window - 1}}})).{{1,{_PIECE}}}"), F.lit(1))
    term = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    grown = F.array(*[F.lit(term[c + 1] - term[c]) for c in range(window)])  # what one more of c equal characters adds to s
    zero = F.lit("A" * (_HIGHEST - _LOWEST + 1))

    def peaks(piece: Column, most: Column) -> Column:
        code = lambda k: F.ascii(F.substring(piece, k + 1, F.lit(1))) - (_LOWEST - 1)
        event = lambda at, change, spot: F.struct(at.alias("at"), F.lit(change).alias("change"), spot.alias("spot"))

        def events(i: Column) -> Column:
            came = event(code(i), 1, i - (window - 1))
            return F.when(i >= window, F.array(event(code(i - window), -1, F.lit(-1)), came)).otherwise(F.array(came))

        def step(acc: Column, e: Column) -> Column:
            def counted(c: Column) -> Column:
                counts = F.overlay(acc["counts"], F.char(c + e["change"] + 65), e["at"])

                def summed(total: Column) -> Column:
                    full = (e["spot"] >= 0) & (total <= most)
                    return F.struct(counts.alias("counts"), total.alias("s"), F.when(full, F.coalesce(acc["first"], e["spot"])).otherwise(acc["first"]).alias("first"), F.when(full, e["spot"]).otherwise(acc["last"]).alias("last"))

                return let(acc["s"] + F.when(e["change"] > 0, F.get(grown, c)).otherwise(-F.get(grown, c - 1)), summed)

            return let(F.ascii(F.substring(acc["counts"], e["at"], F.lit(1))) - 65, counted)

        start = F.struct(zero.alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.flatten(F.transform(F.sequence(F.lit(0), F.length(piece) - 1), events)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    most = window * (math.log2(window) - least)  # of s, where the entropy is `least`
    nothing = F.struct(none.alias("first"), none.alias("last"))

    def peaks_of(piece: Column) -> Column:
        """peaks(), where the piece has as many different characters as that much entropy takes."""
        return F.when(F.size(F.array_distinct(F.split(piece, ""))) >= F.pow(F.lit(2.0), least), peaks(piece, most)).otherwise(nothing)

    def both(parts: Column) -> Column:
        # from the front up to the first piece with such a window, then from the back up to that piece
        forward = lambda acc, k: F.when(acc["first"].isNull(), let(peaks_of(F.get(parts, k)), lambda p: F.struct((p["first"] + k * _PIECE).alias("first"), (p["last"] + k * _PIECE).alias("last"), k.alias("k")))).otherwise(acc)
        backward = lambda acc, k: F.when(acc.isNull(), peaks_of(F.get(parts, k))["last"] + k * _PIECE).otherwise(acc)
        start = F.struct(none.alias("first"), none.alias("last"), F.lit(0).alias("k"))

        def ends(hit: Column) -> Column:
            behind = F.when(hit["first"].isNotNull() & (hit["k"] < F.size(parts) - 1), F.sequence(F.size(parts) - 1, hit["k"] + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
            return F.struct(hit["first"].alias("first"), F.coalesce(F.aggregate(behind, none, backward), hit["last"]).alias("last"))

        return let(F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, forward), ends)

    return F.when(F.length(text) >= window, let(pieces, both)).otherwise(nothing)


def entropy_spans(text: Column, window: int = 20, allowed: Sequence[str] = ALLOWED) -> Column:
    """array<struct<start,end>> of candidate strings' parts that windows of high entropy cover, allow-listed strings and words left out."""
    def of(c: Column) -> Column:
        pairs = F.regexp_count(c, F.lit("(?=[A-Za-z]{2})"))
        usual = F.regexp_count(c, F.lit(f"(?i)(?={'|'.join(_PAIRS)})"))
        bits = F.lit(NEVER)
        for regex, b, words in reversed(CLASSES):
            least = F.when(usual >= words * pairs, NEVER).otherwise(b) if words < 1 else F.lit(b)
            bits = F.when(c.rlike(f"^(?:{regex})$"), least).otherwise(bits)
        fine = F.lit(False)
        for regex in allowed:
            fine = fine | c.rlike(regex)
        return F.when(fine, F.lit(NEVER)).otherwise(bits)

    text = F.regexp_replace(text, SEPARATOR, " ")  # as long as before
    found, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE)
    parts = F.arrays_zip(F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), found.alias("text"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        spans = let(of(x["text"]), lambda bits: F.when(bits >= NEVER, none).otherwise(let(peak_window(x["text"], window, bits), lambda p: F.when(p["first"].isNull(), none).otherwise(F.array(F.struct((start + p["first"]).alias("start"), (start + p["last"] + window).alias("end")))))))
        return let(spans, lambda more: F.struct((start + F.length(x["text"])).alias("at"), F.when(F.size(more) == 0, acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out")))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, window: int = 20, allowed: Sequence[str] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one array<struct<start,end>> each for assign, access, hex and entropy (code points, end exclusive).

    A cheap test guards each pattern, so that texts without matches, nearly all of them, are searched once and not
    cut up. Null and empty texts have no spans; repeated rows are reported each by itself; an empty table gives an
    empty result; other columns are ignored, whatever their names. Entropy spans of one string that tie are one span,
    from its first such window to its last. Work grows in proportion to the text, however long a string of key
    characters it holds. One narrow pass.
    """
    lean = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    t, none = F.col("t"), F.array().cast("array<struct<start:int,end:int>>")
    kinds = [F.when(t.rlike(_GUARDS[p.kind]), match_spans(t, p)).otherwise(none).alias(p.kind) for p in BASE_PATTERNS]
    return lean.select("doc_id", *kinds, F.when(t.rlike(CANDIDATE), entropy_spans(t, window, allowed)).otherwise(none).alias("entropy"))


def listed(kinds: Sequence[str]) -> Column:
    """kind:start:end of the spans in the columns `kinds`, by start and then in the order of kinds, comma-joined."""
    def tagged(n: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    tags = [tagged(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tags)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", window: int = 20, allowed: Sequence[str] = ALLOWED, text_col: str = "text") -> DataFrame:
    """docs, all columns and rows kept, with each run of secret spans in the text replaced by `mark`.

    An assignment loses its value only, not the name in front of it. Null texts stay null, empty ones empty; repeated
    rows are each changed alike; overlapping and touching finds share one mark; an empty table stays empty; columns of
    any name are kept, since the one that is added takes a name that none has.
    """
    taken = set(docs.columns)
    name = next(x for x in ("found", *(f"found_{k}" for k in range(len(taken) + 1))) if x not in taken)
    t, none = F.col(f"`{text_col}`"), F.array().cast("array<struct<start:int,end:int>>")
    kinds = [F.when(t.rlike(_GUARDS[p.kind]), match_spans(t, p)).otherwise(none) for p in BASE_PATTERNS]
    assign, *others = [*kinds, F.when(t.rlike(CANDIDATE), entropy_spans(t, window, allowed)).otherwise(none)]
    value = F.lit("[A-Za-z0-9+/_.=-]+$")
    tail = F.transform(assign, lambda x: F.struct((x["end"] - F.length(F.regexp_substr(F.substring(t, x["start"] + 1, x["end"] - x["start"]), value))).cast("int").alias("start"), x["end"].alias("end")))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))
    clean = F.aggregate(F.col(name), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    marked = docs.withColumn(name, F.array_sort(F.concat(tail, *others)))
    return marked.select(*[F.when(F.size(name) > 0, clean).otherwise(t).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
