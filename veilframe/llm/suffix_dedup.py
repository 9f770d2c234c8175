"""Removal of repeated passages with a sparse, distributed suffix array.

Every string of `length` bytes has an anchor, its least k bytes in a fixed random order (a minimizer), so equal
strings have equal anchors at equal places. Only suffixes that start at anchors are sorted, about one in eighteen:

1. Anchors that occur in one document alone can't be part of a repeat. Anchors meet by hash, and each document
   learns which of its own occur elsewhere.
2. Of the others, each maximal run of strings with one anchor is shipped once, as the bytes it covers. Sampled
   splitters range-partition them by the first 16 bytes of the suffix at the anchor; equal anchors never straddle a
   boundary, because splitters part whole leading words, so that no comparison across buckets is left over. A bucket
   is sorted by multikey quicksort over 8-byte words; neighbours with all words equal are equal runs, and where
   different runs share an anchor their single strings are compared.
3. What is found to start in a document with a smaller id is cut out there.

Hashes bring strings together, bytes decide: wherever two strings count as equal, they have been compared.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import saved, written
from veilframe.llm.idfilter import MOST, filter_bits, id_filter, parted
from veilframe.llm.shingles import mix64
from veilframe.llm.textio import id_and_text, integer_ids, text_buffer, text_offsets

_POSITION_BITS = 20
_STRETCH = 1 << _POSITION_BITS
#: Bytes of texts that are worked on at once: what is worked out for them stays in the cache.
_GROUP = 1 << 16


@dataclass(frozen=True)
class RepeatSettings:
    """length: bytes of a string that counts as a repeat. k: bytes of an anchor. The rest sets how much a task holds:
    bucket: anchors in a bucket; unit: bytes of text in a unit; stretch: anchors gathered before they are sent. hot:
    places from which on an anchor's strings are compared one by one, spread over all buckets; max_hot: so many anchors
    at most are treated so (8 bytes each, broadcast), those of the most places. sample: one anchor in so many, of those
    that differ in a stretch, is drawn for the splitters. None changes results."""

    length: int = 50
    k: int = 16
    bucket: int = 1 << 19
    unit: int = 8 << 20
    stretch: int = 1 << 20
    hot: int = 1 << 14
    max_hot: int = 200_000
    sample: int = 4096


@dataclass
class Runs:
    """Maximal runs of strings with one anchor: number of the text, first and last start of a string, place of the anchor (all counted in the text), hash and leading 16 bytes of the anchor."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    lead: np.ndarray


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; the last 7 places are left out."""
    two = (data[:-1].astype(np.uint32) << np.uint32(8)) | data[1:]
    four = (two[:-2] << np.uint32(16)) | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:]


def anchor_runs(data: np.ndarray, offsets: np.ndarray, settings: RepeatSettings):
    """Runs of the texts data[offsets[i]:offsets[i + 1]], some texts at a time; long texts come in stretches."""
    length, k = settings.length, settings.k
    texts, starts, ends = [], [], []
    for text in np.flatnonzero(np.diff(offsets) >= length):
        for low in range(int(offsets[text]), int(offsets[text + 1]) - length + 1, _STRETCH // 2):
            texts.append(text)
            starts.append(low)
            ends.append(min(low + _STRETCH // 2 + length - 1, int(offsets[text + 1])))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + ends[stop] - starts[stop] <= _GROUP):
            size += ends[stop] - starts[stop]
            stop += 1
        yield _runs_of(data, np.array(texts[at:stop]), np.array(starts[at:stop]), np.array(ends[at:stop]), offsets, length, k)
        at = stop


def _runs_of(data, texts, starts, ends, offsets, length, k) -> Runs:
    parts = np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)] + [np.zeros(8, np.uint8)])
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = _words(parts)
    n = len(parts) - 8
    value = words[: n - k + 1].copy()
    for low in range(8, k, 8):
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        value += words[min(low, k - 8) :][: n - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    value = mix64(value)
    mask = np.uint64(_STRETCH - 1)
    packed = (value & ~mask) | np.arange(len(value), dtype=np.uint64)
    least, span, want = packed, 1, length - k + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = (least & mask).astype(np.int64)  # of the anchor of the string that starts at each place
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    good = np.arange(len(place)) + length <= bounds[1:][owner]
    fresh = good.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | ~good[:-1]
    first = np.flatnonzero(fresh)
    done = good.copy()
    done[:-1] &= fresh[1:] | ~good[1:]
    last = np.flatnonzero(done)
    own = owner[first]
    shift = starts[own] - offsets[texts[own]] - bounds[own]
    anchor = place[first]
    lead = np.stack([words[anchor], words[anchor + min(8, k - 8)]], 1).astype(">u8").view("S16").reshape(-1)
    return Runs(texts[own], first + shift, last + shift, anchor + shift, value[anchor], lead)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of rows by their columns, and for each column the number of the group of rows, in that order, that agree up to it.

    Multikey quicksort, all groups of a level at once: rows that are still tied are sorted by the next word, the
    others are done.
    """
    m = len(words)
    order, group = np.arange(m), np.zeros(m, np.int64)
    groups = []
    for column in range(words.shape[1]):
        size = np.bincount(group, minlength=1) if m else np.zeros(1, np.int64)
        tied = np.flatnonzero(size[group] > 1)
        if len(tied):
            value = words[order[tied], column]
            by = np.lexsort((value, group[tied]))
            order[tied] = order[tied][by]
            value, own = value[by], group[tied]
            cut = np.zeros(m, np.int64)
            cut[tied[1:]] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
            group = group + np.cumsum(cut)
        groups.append(group)
    return order, groups


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start[i]:start[i] + size[i]] one behind the other."""
    out = [data[:0]]
    for a, b in _portions(size):
        total = np.cumsum(size[a:b])
        out.append(data[np.arange(total[-1]) + np.repeat(start[a:b] - (total - size[a:b]), size[a:b])])
    return np.concatenate(out)


def _portions(size: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes in all, so that what is worked out for each byte stays small."""
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    base = 0xD6E8FEB86659FD93
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
        out[0] = 1
        done = 1
        while done < n:
            out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(pow(b, done, 1 << 64))
            done *= 2
    return up, down


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over the bytes, and the inverse powers that shift a part of it to the start."""
    up, down = _powers(1 << max(21, int(len(data)).bit_length()))
    number = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(number[data] * up[: len(data)], out=sums[1:])
    return sums, down


def run_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each data[start[i]:start[i] + size[i]]."""
    out = np.zeros(len(start), np.uint64)
    for a, b in _portions(size):
        sums, down = _prefix_sums(_gather(data, start[a:b], size[a:b]))
        end = np.cumsum(size[a:b])
        begin = end - size[a:b]
        out[a:b] = mix64((sums[end] - sums[begin]) * down[begin] + size[a:b].astype(np.uint64))
    return out


def string_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of `length` bytes of each data[start[i]:start[i] + size[i]], run by run."""
    out = [np.zeros(0, np.uint64)]
    for a, b in _portions(size):
        sums, down = _prefix_sums(_gather(data, start[a:b], size[a:b]))
        n = size[a:b] - length + 1
        begin = np.repeat(np.cumsum(size[a:b]) - size[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(mix64((sums[begin + length] - sums[begin]) * down[begin]))
    return np.concatenate(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a[i]:a[i] + size[i]] and data[b[i]:b[i] + size[i]] are the same; sizes are 1 at least."""
    out = np.zeros(len(a), bool)
    for low, high in _portions(size):
        differ = _gather(data, a[low:high], size[low:high]) != _gather(data, b[low:high], size[low:high])
        end = np.cumsum(size[low:high])
        out[low:high] = ~np.logical_or.reduceat(differ, end - size[low:high])
    return out


def equal_strings(data: np.ndarray, at: np.ndarray, value: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[at[i]:at[i] + length] that brings equal ones together, by document, and where in that order a
    new string begins. Strings are brought together by their hashes `value` and then compared; where different ones
    share a hash, their bytes put them in order."""
    by = np.lexsort((doc, value))
    fresh = np.ones(len(by), bool)
    fresh[1:] = value[by][1:] != value[by][:-1]
    look = np.flatnonzero(~fresh)
    wrong = look[~same_bytes(data, at[by[look]], at[by[look - 1]], np.full(len(look), length))] if len(look) else look
    if len(wrong):
        clash = np.flatnonzero(np.isin(value, value[by[wrong]]))
        code = np.zeros(len(value), np.int64)
        code[clash] = np.unique([data[k : k + length].tobytes().hex() for k in at[clash]], return_inverse=True)[1]
        by = np.lexsort((doc, code, value))
        fresh[1:] = (value[by][1:] != value[by][:-1]) | (code[by][1:] != code[by][:-1])
    return by, fresh


def _unit_of(ids: np.ndarray, units: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(units)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns of its rows), in the order in which rows came."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]]) if len(ordered) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(ordered[a]), [c[order[a:b]] for c in columns]


class _Blobs:
    """Columns of numbers as bytes, each behind the other: count, then the columns of given types."""

    def __init__(self, *types):
        self.types = [np.dtype(t) for t in types]
        self.width = sum(t.itemsize for t in self.types)

    def put(self, *columns: np.ndarray) -> bytes:
        return b"".join(np.ascontiguousarray(c, t).tobytes() for c, t in zip(columns, self.types, strict=True))

    def get(self, blobs) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in self.types]
        for blob in blobs:
            n, at = len(blob) // self.width, 0
            for part, kind in zip(parts, self.types, strict=True):
                part.append(np.frombuffer(blob, kind, n, at))
                at += n * kind.itemsize
        return [np.concatenate(p) for p in parts]


_SHARED = _Blobs("<i8", "<u4", "<u2")  # document, upper and lower part of a 48-bit anchor key
_SPANS = _Blobs("<i8", "<i8", "<i8")  # document, start, end
_ROW = "key long, kind byte, body binary"
#: Kinds of rows in transit: anchors to be counted, anchors known as shared, sampled leading words, runs to be sorted, spans found, single strings.
_ANCHORS, _KNOWN, _SAMPLE, _RUNS, _FOUND, _STRINGS = range(6)


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    keys, kinds, bodies = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int8()), pa.array(bodies, pa.binary())], ["key", "kind", "body"])


def _join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(16)) | low


def _known_rows(ids: np.ndarray, key: np.ndarray, units: int) -> list[tuple[int, int, bytes]]:
    """Rows that tell documents of their shared anchors (48-bit keys)."""
    return [(-1 - unit, _KNOWN, _SHARED.put(*cols)) for unit, cols in _by_bucket(_unit_of(ids, units), ids, (key >> np.uint64(16)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16))]


_SENT = _Blobs("<u4", "<u2", "<i8", "<u4", "i1")  # key, document, places in the stretch, whether several documents of it have it
_HOT = _Blobs("<i8", "<i8")  # key, places


def _send_anchors(source: DataFrame, settings: RepeatSettings, buckets: int, units: int) -> DataFrame:
    """Each different anchor of a stretch once, to its bucket. Anchors of two documents of one stretch are known as
    shared at once: their documents are told directly, so that no bucket gets more than a row a stretch of a key."""

    def send(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            ids, key, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, key))
            ids, key, lead = ids[order], key[order], lead[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            least, most = ids[start], ids[start + count - 1]
            several = least != most
            out = []
            local = np.repeat(several, count)
            pair = np.flatnonzero(local)
            pair = pair[np.concatenate([[True], (key[pair][1:] != key[pair][:-1]) | (ids[pair][1:] != ids[pair][:-1])])] if len(pair) else pair
            out += _known_rows(ids[pair], key[pair], units)
            by = np.argsort(least, kind="stable")
            top, least_key = key[start][by], least[by]
            for bucket, cols in _by_bucket((mix64(top) % np.uint64(buckets)).astype(np.int64), (top >> np.uint64(16)).astype(np.uint32), (top & np.uint64(0xFFFF)).astype(np.uint16), least_key, count[by], several[by]):
                out.append((bucket, _ANCHORS, _SENT.put(*cols)))
            drawn = lead[start[:: settings.sample]]
            out.append((-1 - units - 1 - int(_unit_of(ids[:1], units)[0]), _SAMPLE, drawn.astype("S16").tobytes()))  # over as many groups as there are units
            return _rows(out)

        for batch in batches:
            ids, offsets, data = batch.column(0).to_numpy(), text_offsets(batch.column(1)), text_buffer(batch.column(1))
            for runs in anchor_runs(data, offsets, settings):
                key = runs.key >> np.uint64(16)
                held.append((ids[runs.text], key, runs.lead))
                size += len(key)
                if size > settings.stretch:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return source.mapInArrow(send, _ROW)


def _meet(sent: DataFrame, settings: RepeatSettings, units: int) -> DataFrame:
    """unit, body: documents with the anchors that they share with others; the sampled words, under unit -1; anchors of `hot` places or more with their counts, under unit -2."""

    def meet(key, table):
        bucket = key[0].as_py()
        if bucket < 0:
            return pa.table({"unit": pa.array([-1 - bucket if bucket >= -units else -1] * table.num_rows, pa.int64()), "body": table.column("body")})
        high, low, ids, places, several = _SENT.get(x.as_buffer() for x in table.column("body"))
        anchors = _join(high, low)
        order = np.argsort(anchors, kind="stable")
        anchors, ids, several, places = anchors[order], ids[order], several[order], places[order]
        start = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, np.int64)
        if not len(start):
            return pa.table({"unit": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        shared = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) | (np.maximum.reduceat(several, start) > 0)
        tell = np.repeat(shared, np.diff(np.append(start, len(anchors)))) & (several == 0)
        rows = _known_rows(ids[tell], anchors[tell], units)
        total = np.add.reduceat(places.astype(np.int64), start)
        hot = np.flatnonzero(shared & (total >= settings.hot))
        if len(hot):
            rows.append((1, _SAMPLE, _HOT.put(anchors[start[hot]].astype(np.int64), total[hot])))
        return pa.table({"unit": pa.array([-1 - k for k, _, _ in rows], pa.int64()), "body": pa.array([b for _, _, b in rows], pa.binary())})

    return sent.groupBy("key").applyInArrow(meet, "unit long, body binary")


def _parted_by(source: DataFrame, n: int, rows: DataFrame, blobs: _Blobs) -> tuple[DataFrame, DataFrame]:
    """source, n documents, in two parts: those named in column body of rows, with a few others, and the rest.

    Where a filter for n ids may be broadcast, each task fills it from the bodies, and no id becomes a row.
    """
    named = lambda batch: blobs.get(x.as_buffer() for x in batch.column(0))[0]
    bodies = rows.select("body")
    if n <= MOST:
        return parted(source, bodies, table=id_filter(bodies, filter_bits(n), named))

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(named(batch)))], ["id"])

    return parted(source, saved(bodies.mapInArrow(name, "id long").distinct()))


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unsqueezed(blob) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _in_units(source: DataFrame, units: int) -> DataFrame:
    """unit, body: the documents of source, those of a batch and a unit together and compressed: count, ids, lengths, bytes."""

    def choose(batches):
        for batch in batches:
            unit = _unit_of(batch.column(0).to_numpy(), units)
            part = batch.take(pa.array(np.argsort(unit, kind="stable")))
            unit.sort()
            ids, offsets, data = part.column(0).to_numpy(), text_offsets(part.column(1)), text_buffer(part.column(1))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]]) if len(unit) else [0]
            bodies = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                lengths = np.diff(offsets[a : b + 1])
                bodies.append(_squeezed(int(b - a).to_bytes(8, "little") + ids[a:b].astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + data[offsets[a] : offsets[b]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(unit[cut[:-1]] if len(unit) else unit, pa.int64()), pa.array(bodies, pa.binary())], ["unit", "body"])

    return source.mapInArrow(choose, "unit long, body binary")


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and bytes of a unit's documents."""
    ids, lengths, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for x in table.column("body"):
        blob = _unsqueezed(x.as_buffer())
        n = int.from_bytes(blob[:8], "little")
        ids.append(np.frombuffer(blob, "<i8", n, 8))
        lengths.append(np.frombuffer(blob, "<i8", n, 8 + 8 * n))
        parts.append(np.frombuffer(blob, np.uint8, -1, 8 + 16 * n))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(parts)


_SINGLE = _Blobs("<i8", "<i8")  # document and start of a string, whose bytes follow
_HEAD = _Blobs("<i8", "<i8", "u1", "u1")  # document, first start, bytes covered, place of the anchor among them


def _send_runs(docs: DataFrame, shared: DataFrame, settings: RepeatSettings, splitters, hot, buckets: int, units: int) -> DataFrame:
    """Runs with shared anchors, each different one of a unit once, to the bucket of the suffix at its anchor. The same
    run in a document with a larger id of the same unit is a repeat as it stands.

    Anchors in the broadcast list `hot` stand in so many places that one bucket could not hold their runs, which
    differ at the edges of a passage. Their strings go one by one, once for a unit, to buckets by hash.
    """

    def send(left, right):
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            ids, offsets, data = _texts(left)
            _, high, low = _SHARED.get(x.as_buffer() for x in right.column("body"))
            wanted = np.unique(_join(high, low))
            for runs in anchor_runs(data, offsets, settings):
                key = runs.key >> np.uint64(16)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                use = np.flatnonzero(wanted[at] == key)
                if not len(use):
                    continue
                text, first = runs.text[use], runs.first[use]
                held.append((ids[text], first, runs.last[use] - first + settings.length, runs.anchor[use] - first, offsets[text] + first, runs.lead[use], np.isin(key[use], hot.value)))
            if held:
                out = finish(data)
                held.clear()
        return pa.Table.from_batches([_rows(out)])

    held: list[tuple[np.ndarray, ...]] = []

    def finish(data: np.ndarray) -> list[tuple[int, int, bytes]]:
        ids, first, size, inner, start, lead, often = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = run_hashes(data, start, size)
        order = np.lexsort((ids, size, whole))
        same = np.concatenate([[False], (whole[order][1:] == whole[order][:-1]) & (size[order][1:] == size[order][:-1])])
        look = np.flatnonzero(same)
        if len(look):  # where a run under the same hash differs from the one before, both are sent on and compared there
            same[look] = same_bytes(data, start[order[look]], start[order[look - 1]], size[order[look]])
        head = np.flatnonzero(~same)
        least = np.repeat(ids[order][head], np.diff(np.append(head, len(order))))
        repeat = order[same & (ids[order] > least)]
        out = [(-1 - unit, _FOUND, _SPANS.put(*cols)) for unit, cols in _by_bucket(_unit_of(ids[repeat], units), ids[repeat], first[repeat], first[repeat] + size[repeat])]
        # of the document with the least id all places of the run are sent: there may be several in it
        send = np.sort(order[ids[order] == least])
        single = send[often[send]]
        if len(single):
            out += strings(data, ids[single], first[single], size[single], start[single])
        send = send[~often[send]]
        bucket = np.searchsorted(splitters.value, lead[send], "right")
        for to, (rows,) in _by_bucket(bucket, send):
            text = _gather(data, start[rows], size[rows]).tobytes()
            heads = _HEAD.put(ids[rows], first[rows], size[rows], inner[rows])
            out.append((to, _RUNS, _squeezed(len(rows).to_bytes(8, "little") + heads + text)))
        return out

    def strings(data, ids, first, size, start) -> list[tuple[int, int, bytes]]:
        n, length = size - settings.length + 1, settings.length
        value = string_hashes(data, start, size, length)
        doc = np.repeat(ids, n)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        place, at = np.repeat(first, n) + step, np.repeat(start, n) + step
        by, fresh = equal_strings(data, at, value, doc, length)
        value, doc, place, at = value[by], doc[by], place[by], at[by]
        head = np.flatnonzero(fresh)
        least = np.repeat(doc[head], np.diff(np.append(head, len(doc))))
        repeat = doc > least
        out = [(-1 - unit, _FOUND, _SPANS.put(d, p, p + length)) for unit, (d, p) in _by_bucket(_unit_of(doc[repeat], units), doc[repeat], place[repeat])]
        value, doc, place, at = value[~repeat], doc[~repeat], place[~repeat], at[~repeat]
        for to, (d, p, own) in _by_bucket((mix64(value) % np.uint64(buckets)).astype(np.int64), doc, place, at):
            body = _gather(data, own, np.full(len(own), length)).tobytes()
            out.append((buckets + to, _STRINGS, _squeezed(len(d).to_bytes(8, "little") + _SINGLE.put(d, p) + body)))
        return out

    return docs.groupBy("unit").cogroup(shared.groupBy("unit")).applyInArrow(send, _ROW)


def _sorted_buckets(sent: DataFrame, settings: RepeatSettings, buckets: int, units: int) -> DataFrame:
    """unit, body: spans of strings that start in a document with a smaller id as well."""
    length, k = settings.length, settings.k
    ahead, behind = 2 * length - k, length - k  # most bytes of a run from its anchor on, and before it

    def compare(key, table):
        if key[0].as_py() < 0:
            return pa.table({"unit": pa.array([-1 - key[0].as_py()] * table.num_rows, pa.int64()), "body": table.column("body")})
        if key[0].as_py() >= buckets:
            return singles(table)
        heads, texts = [], []
        for x in table.column("body"):
            blob = _unsqueezed(x.as_buffer())
            n = int.from_bytes(blob[:8], "little")
            heads.append(blob[8 : 8 + n * _HEAD.width])
            texts.append(np.frombuffer(blob, np.uint8, -1, 8 + n * _HEAD.width))
        ids, first, size, inner = _HEAD.get(heads)
        size, inner = size.astype(np.int64), inner.astype(np.int64)
        body = np.concatenate([*texts, np.zeros(1, np.uint8)])
        start = np.cumsum(size) - size
        # one row of words for each run: the suffix at its anchor, what stands before the anchor, both lengths
        wide = -(-(ahead + behind + 2) // 8) * 8
        grid = np.zeros((len(ids), wide), np.uint8)
        for column in range(ahead):
            have = inner + column < size
            grid[have, column] = body[(start + inner)[have] + column]
        for column in range(behind):
            have = column < inner
            grid[have, ahead + column] = body[start[have] + column]
        grid[:, -2], grid[:, -1] = inner, size
        words = grid.view(">u8").astype(np.uint64)
        del grid
        order, groups = multikey_order(words)
        anchor, whole = groups[-(-k // 8) - 1], groups[-1]
        del words
        ids, first, size, start = ids[order], first[order], size[order], start[order]
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        head = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(ids))))
        repeat = ids > least
        spans.append((ids[repeat], first[repeat], first[repeat] + size[repeat]))
        # anchors with several different runs: their single strings, of the documents that hold a run first
        a_head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.repeat((whole[np.append(a_head[1:], len(ids)) - 1] != whole[a_head]), np.diff(np.append(a_head, len(ids))))
        rows = np.flatnonzero(several & ~repeat)
        if len(rows):
            n = size[rows] - length + 1
            run = np.repeat(np.arange(len(rows)), n)
            step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            value = string_hashes(body, start[rows], size[rows], length)
            doc = ids[rows][run]
            by, fresh = equal_strings(body, start[rows][run] + step, value, doc, length)
            low = doc[by][np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
            hit = np.zeros(len(run), bool)
            hit[by] = doc[by] > low
            spans.append(_stretches(hit, run, step, ids[rows], first[rows], length))
        ids, low, high = (np.concatenate(x) for x in zip(*spans, strict=True))
        rows = [(unit, _SPANS.put(*cols)) for unit, cols in _by_bucket(_unit_of(ids, units), ids, low, high)]
        return pa.table({"unit": pa.array([u for u, _ in rows], pa.int64()), "body": pa.array([b for _, b in rows], pa.binary())})

    def singles(table):
        heads, texts = [], []
        for x in table.column("body"):
            blob = _unsqueezed(x.as_buffer())
            n = int.from_bytes(blob[:8], "little")
            heads.append(blob[8 : 8 + n * _SINGLE.width])
            texts.append(np.frombuffer(blob, np.uint8, -1, 8 + n * _SINGLE.width))
        doc, place = _SINGLE.get(heads)
        grid = np.zeros((len(doc), -(-length // 8) * 8), np.uint8)
        grid[:, :length] = np.concatenate(texts).reshape(-1, length)
        order, groups = multikey_order(np.concatenate([grid.view(">u8").astype(np.uint64), doc.astype(np.uint64)[:, None] ^ np.uint64(1 << 63)], 1))
        doc, place, whole = doc[order], place[order], groups[-2]
        head = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        repeat = doc > np.repeat(doc[head], np.diff(np.append(head, len(doc))))
        doc, place = doc[repeat], place[repeat]
        rows = [(unit, _SPANS.put(d, p, p + length)) for unit, (d, p) in _by_bucket(_unit_of(doc, units), doc, place)]
        return pa.table({"unit": pa.array([u for u, _ in rows], pa.int64()), "body": pa.array([b for _, b in rows], pa.binary())})

    return sent.groupBy("key").applyInArrow(compare, "unit long, body binary")


def _stretches(hit, run, step, ids, first, length):
    """Spans that hit strings of a run cover, where strings in a row make one span."""
    head = hit.copy()
    head[1:] &= ~hit[:-1] | (run[1:] != run[:-1])
    tail = hit.copy()
    tail[:-1] &= ~hit[1:] | (run[1:] != run[:-1])
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    own = run[a]
    return ids[own], first[own] + step[a], first[own] + step[b] + length


def _united(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document as maximal runs, in order; spans that touch are one run."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    shift = (np.cumsum(fresh) - 1) * (high.max(initial=0) + 1)
    reach = np.maximum.accumulate(high + shift)  # of all spans so far; a later document's lie beyond
    fresh[1:] |= low[1:] + shift[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    return doc[head], low[head], np.maximum.reduceat(high, head) if len(head) else high


def _cut(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    names = ["doc_id", "n_bytes", "spans", "kept_sha256", *(["kept"] if with_text else [])]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(left, right):
        ids, offsets, data = _texts(left)
        doc, low, high = _SPANS.get(x.as_buffer() for x in right.column("body"))
        doc, low, high = _united(doc, low, high)
        runs, digests, kept = [], [], []
        for k, doc_id in enumerate(ids):
            text = data[offsets[k] : offsets[k + 1]]
            own = slice(*np.searchsorted(doc, [doc_id, doc_id + 1]))
            merged = [(a, min(b, len(text))) for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True) if a < len(text)]
            rest, at = [], 0
            for a, b in merged:
                rest.append(text[at:a].tobytes())
                at = b
            left_over = b"".join([*rest, text[at:].tobytes()])
            runs.append([{"start": a, "end": b} for a, b in merged])
            digests.append(hashlib.sha256(left_over).hexdigest())
            kept.append(left_over)
        cols = [pa.array(ids, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(runs, span), pa.array(digests, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])]
        return pa.table(dict(zip(names, cols, strict=True)))

    kind = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept binary" if with_text else "")
    return docs.groupBy("unit").cogroup(spans.groupBy("unit")).applyInArrow(cut, kind)


def remove_repeats(docs: DataFrame, settings: RepeatSettings = RepeatSettings(), with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: maximal removed runs), kept_sha256, and with_text kept
    (binary: a cut may fall inside a character).

    A byte of a text goes if it lies in a string of settings.length bytes that also starts in a document with a
    smaller id, as the input stands. Ids are integers, others raise a TypeError. Null texts count as empty; texts shorter than a string
    stay; repeats inside one document stay; repeated rows under one id stay and each lose what other documents
    hold; different texts under one id are cut at the union of their spans; rows without an id stay whole and cut no other. An empty table gives an empty result;
    other columns are ignored. The text is scanned four times and only documents with shared anchors move.
    """
    spark = docs.sparkSession
    rows = integer_ids(id_and_text(docs, id_col, text_col))
    source, nameless = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    total, n = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = 2 * total // (settings.length - settings.k + 2)
    buckets, units = max(least, anchors // settings.bucket + 1), max(least, total // settings.unit + 1)

    shared = written(_meet(_send_anchors(source, settings, buckets, units), settings, units))
    splitters = _splitters(shared.filter("unit = -1").select("body"), buckets)

    def counted(batches):
        for batch in batches:
            key, places = _HOT.get(x.as_buffer() for x in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(places)], ["key", "places"])

    often = shared.filter("unit = -2").select("body").mapInArrow(counted, "key long, places long").orderBy(F.desc("places"), "key").limit(settings.max_hot).toPandas()
    context = spark.sparkContext
    hot = context.broadcast(np.sort(often["key"].to_numpy(np.int64).astype(np.uint64)))
    told = shared.filter("unit >= 0")
    near, _ = _parted_by(source, n, told, _SHARED)
    spans = written(_sorted_buckets(_send_runs(_in_units(near, units), told, settings, context.broadcast(splitters), hot, buckets, units), settings, buckets, units))
    touched, plain = _parted_by(source, n, spans, _SPANS)
    changed = _cut(_in_units(touched, units), spans, with_text)
    plain = plain.unionAll(nameless)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = plain.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), *([text.cast("binary").alias("kept")] if with_text else []))
    return changed.unionByName(same)


def _splitters(sample: DataFrame, buckets: int) -> np.ndarray:
    """Leading 16 bytes that part the sampled ones (column body, 16 bytes each) into `buckets` ranges of like size.

    The sample is sorted on the cluster, where each range keeps every n-th; what comes to the driver are two
    splitters a bucket at most, however large the sample.
    """

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([body[k : k + 16] for body in batch.column(0).to_pylist() for k in range(0, len(body), 16)], pa.binary())], ["w"])

    words = saved(sample.mapInArrow(spread, "w binary"))
    step = max(1, words.count() // max(1, buckets))

    def thin(batches):
        seen = 0
        for batch in batches:
            at = np.arange((-seen - 1) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    ranged = words.repartitionByRange("w").sortWithinPartitions("w").mapInArrow(thin, "w binary")
    found = np.unique(np.array([bytes(r["w"]) for r in ranged.collect()], "S16"))
    # one less than buckets at most, since numbers from `buckets` on are those of the strings that go by hash
    return found if len(found) < buckets else found[np.linspace(0, len(found) - 1, buckets + 1).astype(np.int64)[1:-1]]
