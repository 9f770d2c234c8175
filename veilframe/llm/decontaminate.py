"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.components import written
from veilframe.llm.textio import bound_batches, id_and_text, release, text_buffer, text_offsets

#: Upper to lower case for A-Z; every other byte outside 0-9, a-z and 0x80-0xFF becomes a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of ASCII letters (A-Z lower-cased), digits and everything outside ASCII."""
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """All substrings of all items, over words.

    window: so many consecutive item words make a hit; an item with fewer words is one window as a whole.
    For a state that holds strings of window words or more, `windows` names its ancestor that holds the last
    `window` words; `items` of that ancestor are the items in which they occur. `short` lists the short items
    that end in a state or one of its ancestors.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.short: list[list[tuple[int, str]]] = [[]]
        for item, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
                if len(words) >= window:
                    self.items[last].add(item)
            if words and len(words) < window:
                self.short[last].append((len(words), item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            if self.length[self.link[v]] >= window:
                self.items[self.link[v]] |= self.items[v]
        self.windows = [0] * len(self.length)
        for v in order:
            up = self.link[v]
            self.windows[v] = (self.windows[up] if self.length[up] >= window else v) if self.length[v] >= window else 0
        for v in order:
            if self.short[self.link[v]]:
                self.short[v] = self.short[v] + self.short[self.link[v]]
        self.marked = [bool(w or s) for w, s in zip(self.windows, self.short, strict=True)]

    def _new(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        self.short.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state of its own for the strings of `to` that are one word longer than those of `at`."""
        copy = self._new(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Merged [start, end) runs of hit words, the items that have windows there, the longest match with any item."""
        nxt, link, length, marked, window = self.next, self.link, self.length, self.marked, self.window
        runs: list[list[int]] = []
        states: set[int] = set()
        found: set[str] = set()
        state = matched = longest = 0
        for end, word in enumerate(words, 1):
            to = nxt[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            if marked[state]:
                reach = 0
                if matched >= window:
                    states.add(self.windows[state])
                    reach = window
                for n, item in self.short[state]:
                    if n <= matched:
                        found.add(item)
                        reach = max(reach, n)
                if reach:
                    start = end - reach
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append([start, end])
        for state in states:
            found |= self.items[state]
        return runs, found, longest


#: So many bytes of items at most are broadcast at once; a larger benchmark takes further passes over the documents.
BROADCAST_BYTES = 32 << 20
#: So many bytes of documents are held while automata take turns, where there are several.
_HELD_BYTES = 16 << 20


@functools.lru_cache(maxsize=1)
def _only(key: tuple, window: int) -> SuffixAutomaton:
    return _built(key, window)


def _built(key: tuple, window: int) -> SuffixAutomaton:
    return SuffixAutomaton(((item, normal_words(text)) for item, text in key), window)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple]:
    held, size = [], 0
    for item, text in benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col].cast("string")).toLocalIterator():
        if item is None or not text:
            continue
        data = text.encode()
        if held and size + len(data) > block_bytes:
            yield tuple(held)
            held, size = [], 0
        held.append((item, data))
        size += len(data)
    if held:
        yield tuple(held)


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int, broadcast_bytes: int) -> Iterator[list]:
    """The broadcast blocks of each pass over the documents; one pass without a block if there is no item."""
    context = benchmark.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    some = list(itertools.islice(blocks, max(1, broadcast_bytes // block_bytes)))
    yield [context.broadcast(x) for x in some]
    while some := list(itertools.islice(blocks, max(1, broadcast_bytes // block_bytes))):
        yield [context.broadcast(x) for x in some]


def _scan(parts: list, window: int, texts: list[bytes]) -> list[tuple[list[list[int]], set[str], int]]:
    """Runs of hit words, items and longest match of each text. The blocks are the outer loop, so that each automaton is built once for all texts."""
    out: list[tuple[list[list[int]], set[str], int]] = [([], set(), 0) for _ in texts]
    for part in parts:
        automaton = _only(part.value, window) if len(parts) == 1 else _built(part.value, window)
        for k, text in enumerate(texts):
            runs, found, longest = automaton.scan(normal_words(text))
            if longest:
                old = out[k]
                out[k] = (_merged(old[0], runs) if old[0] and runs else old[0] or runs, old[1] | found, max(old[2], longest))
        del automaton
    return out


def _portions(batches, place: int, several: bool):
    """(batch, texts as bytes) one by one, of 256 rows at most; where there are several blocks, batches are joined up to _HELD_BYTES first."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows and not several:
            yield from (_joined([batch.slice(low, 256)], place) for low in range(0, batch.num_rows, 256))
        elif batch.num_rows:
            held.append(batch)
            size += batch.column(place).nbytes
        if size >= _HELD_BYTES:
            yield _joined(held, place)
            held, size = [], 0
    if held:
        yield _joined(held, place)
    release()


def _joined(held: list[pa.RecordBatch], place: int) -> tuple[pa.RecordBatch, list[bytes]]:
    batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    offsets, data = text_offsets(batch.column(place)), text_buffer(batch.column(place))
    return batch, [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


_HITS = "_hits"
_RUNS = pa.list_(pa.list_(pa.int64()))
_HIT_TYPE = T.StructType([T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])


def _hits_so_far(docs: DataFrame, passes: Iterator[list], window: int, text_col: str) -> tuple[DataFrame, list]:
    """docs and the blocks of the last pass; where there are several passes, the hits of the others stand in a last column of docs,
    each pass written out before the next one."""
    bound_batches(docs.sparkSession)
    parts = next(passes)
    for further in passes:
        place, told = docs.columns.index(text_col), docs.columns[-1] == _HITS
        fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name != _HITS]

        def run(batches, parts=parts, place=place, told=told):
            for batch, texts in _portions(batches, place, len(parts) > 1):
                out = _with_earlier(batch, _scan(parts, window, texts), told)
                hits = pa.StructArray.from_arrays([pa.array([r for r, _, _ in out], _RUNS), pa.array([sorted(f) for _, f, _ in out], pa.list_(pa.string())), pa.array([n for _, _, n in out], pa.int64())], ["runs", "items", "longest"])
                columns = batch.columns[:-1] if told else batch.columns
                names = batch.schema.names[:-1] if told else batch.schema.names
                yield pa.RecordBatch.from_arrays([*columns, hits], [*names, _HITS])

        docs = written(docs.mapInArrow(run, T.StructType([*fields, T.StructField(_HITS, _HIT_TYPE)])))
        parts = further
    return docs, parts


def _with_earlier(batch: pa.RecordBatch, out: list[tuple], told: bool) -> list[tuple]:
    if not told:
        return out
    return [(_merged(old["runs"], runs), set(old["items"]) | found, max(old["longest"], n)) for old, (runs, found, n) in zip(batch.column(batch.num_columns - 1).to_pylist(), out, strict=True)]


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _char_spans(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code-point spans of runs of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 1 << 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids as strings, sorted), longest_match, spans (array of
    start, end in code points) of every whole text.

    The items are cut into blocks of block_bytes at most, each an automaton of its own in a worker; one is held at a
    time, and with several of them each is built once for 16 MB of documents. What is broadcast for a pass is
    broadcast_bytes at most; a larger benchmark takes a further pass over the documents for each such portion, so
    that what is held grows with neither table. Null and empty texts have no words; items without words have no
    windows; items under the same id count as one; overlapping hits count a word once; repeated documents are
    reported one by one; empty tables give no rows or no hits; other columns are ignored.
    """
    source, parts = _hits_so_far(id_and_text(docs, id_col, text_col), _passes(benchmark, item_col, item_text_col, block_bytes, broadcast_bytes), window, "text")
    kind, told = source.schema["doc_id"].dataType.simpleString(), source.columns[-1] == _HITS
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "n_words", "n_hit", "items", "longest_match", "spans"]

    def run(batches):
        for batch, texts in _portions(batches, 1, len(parts) > 1):
            n, hit, items, best, spans = [], [], [], [], []
            for text, (runs, found, longest) in zip(texts, _with_earlier(batch, _scan(parts, window, texts), told), strict=True):
                n.append(len(normal_words(text)))
                hit.append(sum(b - a for a, b in runs))
                items.append(sorted(found))
                best.append(longest)
                spans.append([{"start": a, "end": b} for a, b in _char_spans(text.decode(), runs)] if runs else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(best, pa.int64()), pa.array(spans, span)], names)

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, longest_match long, spans array<struct<start:int,end:int>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 1 << 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, all columns kept, with every run of hit words cut out of the text.

    Two limits: matches of `window` words or more are removed, and a document of which more than max_coverage of
    the words are hits goes as a whole, since what is left of it makes no text. All windows are judged on the input,
    whichever pass finds them. Null and empty texts stay as they are; repeated rows are each treated alike; empty
    tables give no rows or no changes; columns of any name but `_hits` are kept.
    """
    if _HITS in docs.columns:
        raise ValueError(f"a column is called {_HITS}")
    columns = docs.schema
    source, parts = _hits_so_far(docs, _passes(benchmark, item_col, item_text_col, block_bytes, broadcast_bytes), window, text_col)
    place, told = docs.columns.index(text_col), source.columns[-1] == _HITS

    def run(batches):
        for batch, own in _portions(batches, place, len(parts) > 1):
            texts, keep = batch.column(place), np.ones(batch.num_rows, bool)
            changed: dict[int, str] = {}
            for k, (runs, _, _) in enumerate(_with_earlier(batch, _scan(parts, window, own), told)):
                if not runs:
                    continue
                if sum(b - a for a, b in runs) > max_coverage * len(normal_words(own[k])):
                    keep[k] = False
                    continue
                text, kept, at = own[k].decode(), [], 0
                for a, b in _char_spans(text, runs):
                    kept.append(text[at:a])
                    at = b
                changed[k] = "".join([*kept, text[at:]])
            if told:
                batch = batch.select(batch.schema.names[:-1])
            if changed:
                values = texts.to_pylist()
                for k, text in changed.items():
                    values[k] = text
                batch = batch.set_column(place, batch.schema.field(place), pa.array(values, texts.type))
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return source.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in columns]))
