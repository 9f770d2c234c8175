"""Self-join of documents on the Jaccard similarity of their word shingles, as a size-aware heavy-light join.

Sets of few shingles are joined by the fixed-size subsets that they share, larger ones by inverted lists; a cost
model on the histogram of set sizes draws the boundary. Equal sets are one node from the start. What is asked for
is the classes of linked documents, so that pairs inside a class that is already linked are not looked at, and of
the candidates between two classes the likeliest are verified first: one link joins them for good.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import components, saved, written
from veilframe.llm.idfilter import Keep, narrowed, parted
from veilframe.llm.shingles import digested_sets, mix64, shingle_sets
from veilframe.llm.textio import id_and_text, integer_ids, release


@dataclass(frozen=True)
class JaccardSettings:
    """percent: two sets link when 100 * |intersection| >= percent * |union|. k: words in a shingle.

    The rest decides cost, never results. max_heavy: so many frequent shingles at most are put last in the order of
    shingles (12 bytes each, broadcast). heavy_count: occurrences, as counted, that make one frequent. block: so
    many entries of one inverted list at most meet in one group. seeds: shingles per set that the first, linear
    round looks at, those of the least hashes; agree: so many of them must
    bring a pair together there. posting_cost: cost of an inverted-list entry in subsets. bucket: about so many inverted-list
    entries (13 bytes each, and some for each set) are held by a task. tries: so many candidates of two classes are
    verified in a round at first, sixteen times as many in the next. sketch: most bits of a set's parity sketch.
    """

    percent: int = 85
    k: int = 4
    max_heavy: int = 400_000
    heavy_count: int = 9
    block: int = 4096
    seeds: int = 6
    agree: int = 4
    posting_cost: float = 4.0
    bucket: int = 1 << 19
    tries: int = 8
    sketch: int = 16384

    def least_overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least_size(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        """So many of its shingles, first in the common order, that a partner must share one of them."""
        return n - self.least_size(n) + 1

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Overlaps that a set of n shingles can need with one of `boundary` shingles at most."""
        partners = range(self.least_size(n), min(boundary, 100 * n // self.percent) + 1)
        return sorted({o for m in partners if (o := self.least_overlap(n, m)) <= min(n, m)})

    def subsets(self, n: int, boundary: int) -> int:
        return sum(math.comb(n, o) for o in self.subset_sizes(n, boundary))

    def boundary(self, sizes: dict[int, int]) -> int:
        """The largest size joined by subsets: the one of least total cost over the histogram `sizes`."""

        def cost(b: int) -> float:
            lists = sum(c * self.prefix(n) for n, c in sizes.items() if n >= self.least_size(b + 1))
            return sum(c * self.subsets(n, b) for n, c in sizes.items() if n <= b) + self.posting_cost * lists

        return min(range(41), key=lambda b: (cost(b), b))


def _frequent(source: DataFrame, settings: JaccardSettings) -> DataFrame:
    """kind 0: shingles found in two or more of the different sets of one stretch of a task, with how many; kind 1: set sizes, with how many sets."""
    limit = 1 << 21

    def count(batches):
        def flush():
            tokens, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = times >= 2
            keys = np.concatenate([tokens[often].view(np.int64), np.array(list(sizes), np.int64)])
            counts = np.concatenate([times[often], np.array(list(sizes.values()), np.int64)])
            kinds = np.repeat(np.array([0, 1], np.int8), [often.sum(), len(sizes)])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

        held, sizes, seen, size = [], {}, set(), 0
        for batch in batches:
            for _, tokens, own in digested_sets(batch.column(1), settings.k):
                if len(tokens) and own not in seen:
                    seen.add(own)
                    held.append(tokens)
                    size += len(tokens)
                    sizes[len(tokens)] = sizes.get(len(tokens), 0) + 1
                    if size > limit:
                        yield flush()
                        held, sizes, seen, size = [], {}, set(), 0
        yield flush()
        held = []
        release()

    return source.mapInArrow(count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class _Order:
    """The common order of shingles: all that are not known as frequent by their hash, then those by how frequent they are."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def counts_of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)

    def first(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n of sorted tokens, with their counts (0: not frequent)."""
        counts = self.counts_of(tokens)
        light = tokens[counts == 0][:n]
        if len(light) == n:
            return light, np.zeros(n, np.int64)
        heavy = np.flatnonzero(counts)
        heavy = heavy[np.lexsort((tokens[heavy], counts[heavy]))][: n - len(light)]
        return np.concatenate([light, tokens[heavy]]), np.concatenate([np.zeros(len(light), np.int64), counts[heavy]])


def _subset_keys(tokens: np.ndarray, sizes: list[int]) -> tuple[list[int], list[int]]:
    """A key for each subset of the given sizes, and the sizes."""
    spread = mix64(tokens * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    keys, lengths = [], []
    for o in sizes:
        for left_out in itertools.combinations(range(len(tokens)), len(tokens) - o):
            rest = np.delete(spread, left_out).sum(dtype=np.uint64)
            keys.append(rest ^ np.uint64(o * 0x2545F4914F6CDD1D % (1 << 64)))
            lengths.append(o)
    return [int(x) for x in mix64(np.array(keys, np.uint64)).view(np.int64)], lengths


def _batch(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _signatures(source: DataFrame, settings: JaccardSettings, boundary: int) -> DataFrame:
    """doc_id, n, d1, d2 and, for the first row of a set in a stretch of a task: seeds, its shingles of the least hashes, and parts (key, o), its subsets."""
    lists_from = settings.least_size(boundary + 1)
    part = pa.list_(pa.struct([("key", pa.int64()), ("o", pa.int32())]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), part]
    names = ["doc_id", "n", "d1", "d2", "seeds", "parts"]

    def sign(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row, tokens, own in digested_sets(batch.column(1), settings.k):
                size = len(tokens)
                seeds = parts = None
                if size and own not in seen and ids[row] is not None:  # rows without an id are no nodes
                    if len(seen) < 1 << 18:
                        seen.add(own)
                    if size >= lists_from:
                        seeds = tokens[: settings.seeds].view(np.int64).tolist()
                    if size <= boundary:
                        parts = [{"key": x, "o": o} for x, o in zip(*_subset_keys(tokens, settings.subset_sizes(size, boundary)), strict=True)]
                rows.append((ids[row], size, *own, seeds, parts))
            yield _batch(names, rows, types)
        release()

    return source.mapInArrow(sign, "doc_id long, n int, d1 long, d2 long, seeds array<long>, parts array<struct<key:long,o:int>>")


def _sketch_bits(n, most: int):
    """Bits of the parity sketch of a set of n shingles: a power of two, 2 n at least where `most` allows it, so that few of
    the places in which two sets differ fall together."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), most)


def _sketch(tokens: np.ndarray, bits: int) -> bytes:
    """For each of `bits` places whether an odd number of the shingles falls there. Two sketches differ in as many
    places at most as the sets in shingles, and the sketch of half the size is the exclusive or of the halves."""
    spots = mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _prefixes(source: DataFrame, keep: Keep, settings: JaccardSettings, boundary: int, order) -> DataFrame:
    """id, n and posts (int64 keys as bytes), the whole prefix of every set that goes into inverted lists. Rows without an id have none."""
    lists_from = settings.least_size(boundary + 1)
    names, types = ["id", "n", "posts"], [pa.int64(), pa.int32(), pa.binary()]

    def post(batches):
        known = _Order(*order.value)
        for batch in map(keep, batches):
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for row, tokens in shingle_sets(batch.column(1), settings.k):
                if len(tokens) >= lists_from and ids[row] is not None:
                    rows.append((ids[row], len(tokens), known.first(tokens, settings.prefix(len(tokens)))[0].tobytes()))
                    held += len(rows[-1][2])
                    if held > 4 << 20:
                        yield _batch(names, rows, types)
                        rows, held = [], 0
            yield _batch(names, rows, types)
        release()

    return source.mapInArrow(post, "id long, n int, posts binary")


def _sketches(source: DataFrame, keep: Keep, settings: JaccardSettings) -> DataFrame:
    """id, n and the parity sketch of every set."""
    names, types = ["id", "n", "sketch"], [pa.int64(), pa.int32(), pa.binary()]

    def draw(batches):
        for batch in map(keep, batches):
            ids = batch.column(0).to_pylist()
            yield _batch(names, [(ids[row], len(t), _sketch(t, int(_sketch_bits(len(t), settings.sketch)))) for row, t in shingle_sets(batch.column(1), settings.k) if len(t) and ids[row] is not None], types)
        release()

    return source.mapInArrow(draw, "id long, n int, sketch binary")


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.stack([np.minimum(u, v), np.maximum(u, v)], 1) if len(u) else np.zeros((0, 2), np.int64)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _runs(entries: DataFrame, fits) -> DataFrame:
    """Candidate pairs of each key's entries in order of (rank, id): every entry with the one before it and with the
    first of its key, where fits(smaller n, larger n, o) holds, and with how many keys a pair is found. Rows stream by;
    only one entry is carried over.
    """

    def link(batches):
        last = head = None  # (key, o, n, id) of the row before and of the first row of its key
        for batch in batches:
            key, o, n, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            same = np.ones(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (o[1:] == o[:-1])
            same[0] = last is not None and last[:2] == (key[0], o[0])
            at = np.where(same, -1, np.arange(len(key)))
            at = np.maximum.accumulate(at)
            head_n, head_id = np.where(at >= 0, n[at], head[2] if head else 0), np.where(at >= 0, ids[at], head[3] if head else 0)
            prev_n, prev_id = np.concatenate([[last[2] if last else 0], n[:-1]]), np.concatenate([[last[3] if last else 0], ids[:-1]])
            near, star = (same & fits(np.minimum(x, n), np.maximum(x, n), o) for x in (prev_n, head_n))
            near &= prev_id != head_id
            yield _pairs(np.concatenate([prev_id[near], head_id[star]]), np.concatenate([ids[near], ids[star]]))
            last = (key[-1], o[-1], n[-1], ids[-1])
            head = last if not same[-1] else (key[-1], o[-1], head_n[-1], head_id[-1])

    return entries.repartition("key").sortWithinPartitions("key", "o", "rank", "id").select("key", "o", "n", "id").mapInArrow(link, "u long, v long").groupBy("u", "v").agg(F.count("*").alias("keys"))


def _dealt(rows: DataFrame, settings: JaccardSettings, buckets: int, order) -> DataFrame:
    """bucket and entries: the inverted-list entries of rows (id, n, class, met, posts, sketch) that fall into a bucket of
    keys, and their sets, once each, as compressed bytes (see _Bucket).

    A list counted at more than `block` entries is dealt over cells, one for each pair of blocks, by the hash of its
    ids; side then tells the two blocks of a cell apart (1, 2) and is 0 elsewhere.
    """

    def deal(batches):
        known, squeeze = _Order(*order.value), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                some = batch.slice(low, 2048)
                if not some.num_rows:
                    continue
                lengths = np.array([len(x.as_buffer()) // 8 for x in some.column(4)])
                keys = np.frombuffer(b"".join(x.as_buffer() for x in some.column(4)), np.uint64)
                ids, n, classes, met = (some.column(k).to_numpy() for k in (0, 1, 2, 3))
                sketches = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in some.column(5)]
                row = np.repeat(np.arange(some.num_rows), lengths)
                blocks = -(-known.counts_of(keys) // settings.block)
                side = np.zeros(len(keys), np.int8)
                big = np.flatnonzero(blocks > 1)
                if len(big):
                    own = (mix64(ids[row[big]].astype(np.uint64)) % blocks[big].astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(big)), blocks[big])
                    other = np.concatenate([np.arange(b) for b in blocks[big]])
                    i, j = np.minimum(own[again], other), np.maximum(own[again], other)
                    cells = mix64(keys[big][again] ^ mix64((i * (1 << 31) + j + 1).astype(np.uint64)))
                    sides = np.where(i == j, 0, np.where(own[again] == i, 1, 2)).astype(np.int8)
                    rest = np.flatnonzero(blocks <= 1)
                    take = np.concatenate([rest, big[again]])
                    keys, side, row = np.concatenate([keys[rest], cells]), np.concatenate([side[rest], sides]), row[take]
                bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                blobs = []
                for b in full:
                    at = by[cut[b] : cut[b + 1]]
                    sets, place = np.unique(row[at], return_inverse=True)
                    head = np.array([len(at), len(sets)], "<i8").tobytes()
                    body = [keys[at], place.astype(np.int32), side[at], ids[sets], classes[sets], n[sets].astype(np.int32), met[sets].astype(np.int32)]
                    blobs.append(squeeze(b"".join([head, *[x.tobytes() for x in body], *[sketches[k] for k in sets]])))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])
        release()

    return rows.select("id", "n", "class", "met", "posts", "sketch").mapInArrow(deal, "bucket int, entries binary")


class _Bucket:
    """A bucket's entries of lists with several classes: set and side of each, in order of (key, n, id), and the number of
    its list; and the sets: ids, classes, n, met, and where the sketch of each begins in `sketches`."""

    def __init__(self, table: pa.Table):
        entry, of_set = ((np.uint64, 8), (np.int32, 4), (np.int8, 1)), ((np.int64, 8), (np.int64, 8), (np.int32, 4), (np.int32, 4))
        parts: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind, _ in (*entry, *of_set)]
        sketches, sets = [np.zeros(0, np.uint64)], 0
        for x in table.column("entries"):
            data = zstandard.ZstdDecompressor().decompress(x.as_buffer())
            m, s = (int(v) for v in np.frombuffer(data, "<i8", 2))
            at = 16
            for k, (kind, width) in enumerate((*entry, *of_set)):
                count = m if k < len(entry) else s
                own = np.frombuffer(data, kind, count, at)
                parts[k].append(own + np.int32(sets) if k == 1 else own)
                at += count * width
            sketches.append(np.frombuffer(data, "<u8", -1, at) if at < len(data) else sketches[0])
            sets += s
        key, place, side, self.ids, self.classes, self.n, self.met = (np.concatenate(p) for p in parts)
        self.sketches = np.concatenate(sketches)
        by = np.lexsort((self.ids[place], self.n[place], key))
        key, place, side = key[by], place[by], side[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        own = self.classes[place]
        mixed = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start) if len(start) else np.zeros(0, bool)
        use = np.repeat(mixed, size)
        self.place, self.side, self.list = place[use], side[use], np.repeat(np.cumsum(mixed) - 1, size)[use]

    def differ(self, u: np.ndarray, v: np.ndarray, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
        """In how many places the sketches of sets u[i] and v[i] differ, at the size of the smaller."""
        out = np.zeros(len(u), np.int64)
        for w in np.unique(words[v]):
            for x in np.unique(words[u[words[v] == w]]):
                at = np.flatnonzero((words[v] == w) & (words[u] == x))
                few, small = (min(w, x), max(1, (1 << 20) // int(max(w, x))))
                for low in range(0, len(at), small):
                    some = at[low : low + small]
                    a = self.sketches[begin[u[some]][:, None] + np.arange(x)].reshape(len(some), -1, few)
                    b = self.sketches[begin[v[some]][:, None] + np.arange(w)].reshape(len(some), -1, few)
                    out[some] = np.bitwise_count(np.bitwise_xor.reduce(a, 1) ^ np.bitwise_xor.reduce(b, 1)).sum(1)
        return out


#: Kinds of rows that tell of lists: keys of a set's lists with others, such a key itself, keys of a set's frequent shingles.
_SHARED, _KEY, _FREQUENT = range(3)


def _meetings(rows: DataFrame, settings: JaccardSettings, buckets: int, order) -> DataFrame:
    """kind, id, class, keys of rows (id, n, class, posts): of each set the keys of those of its lists in which a set of
    another class and a fitting size stands (_SHARED). Lists counted at more than `block` entries are not gathered:
    what meets there are the least and the greatest class of each task. Keys of several classes are told (_KEY), and
    each set's keys of such lists, whether of several classes or not (_FREQUENT).
    """
    spread = 16

    def deal(batches):
        known, squeeze = _Order(*order.value), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                some = batch.slice(low, 2048)
                if not some.num_rows:
                    continue
                lengths = np.array([len(x.as_buffer()) // 8 for x in some.column(3)])
                keys = np.frombuffer(b"".join(x.as_buffer() for x in some.column(3)), np.uint64)
                ids, n, classes = (some.column(k).to_numpy() for k in (0, 1, 2))
                row = np.repeat(np.arange(some.num_rows), lengths)
                often = known.counts_of(keys) > settings.block
                out: list[tuple[int, bytes]] = []
                if often.any():
                    own, of = keys[often], row[often]
                    by = np.argsort(own, kind="stable")
                    head = np.flatnonzero(np.concatenate([[True], own[by][1:] != own[by][:-1]]))
                    c = classes[of[by]]
                    table = np.stack([own[by][head].view(np.int64), np.minimum.reduceat(c, head), np.maximum.reduceat(c, head)], 1)
                    to = (mix64(own[by][head]) % np.uint64(spread)).astype(np.int64)
                    out += [(-1 - int(b), table[to == b].tobytes()) for b in np.unique(to)]
                    sets, place = np.unique(of, return_inverse=True)
                    body = b"".join([np.array([len(of), len(sets)], "<i8").tobytes(), own.tobytes(), place.astype(np.int32).tobytes(), ids[sets].tobytes(), classes[sets].tobytes()])
                    out.append((-1 - spread - int(mix64(ids[:1].astype(np.uint64))[0] % np.uint64(buckets)), squeeze(body)))
                    keys, row = keys[~often], row[~often]
                bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    at = by[cut[b] : cut[b + 1]]
                    sets, place = np.unique(row[at], return_inverse=True)
                    head = np.array([len(at), len(sets)], "<i8").tobytes()
                    body = [keys[at], place.astype(np.int32), ids[sets], (classes - ids)[sets], n[sets].astype(np.int32)]
                    out.append((int(b), squeeze(head + b"".join(x.tobytes() for x in body))))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "entries"])
        release()

    names = ["kind", "id", "class", "keys"]

    def told(kind: int, keys: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> list[pa.Array]:
        """One row for each run of equal ids."""
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        bodies = [x.tobytes() for x in np.split(keys, head[1:])] if len(head) else []
        return [pa.array(np.full(len(head), kind, np.int8)), pa.array(ids[head]), pa.array(classes[head]), pa.array(bodies, pa.binary())]

    def meet(key, table):
        bucket = key[0].as_py()
        if -1 - spread < bucket < 0:
            rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in table.column("entries")])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            head = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            mixed = rows[head, 0][np.minimum.reduceat(rows[:, 1], head) != np.maximum.reduceat(rows[:, 2], head)]
            return pa.table([pa.array(np.full(len(mixed), _KEY, np.int8)), pa.array(mixed), pa.array(mixed), pa.array([b""] * len(mixed), pa.binary())], names)
        often = bucket < 0
        kinds = ((np.uint64, 8), (np.int32, 4), (np.int64, 8), (np.int64, 8)) + (() if often else ((np.int32, 4),))
        parts: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind, _ in kinds]
        sets = 0
        for x in table.column("entries"):
            data = zstandard.ZstdDecompressor().decompress(x.as_buffer())
            m, count = (int(v) for v in np.frombuffer(data, "<i8", 2))
            at = 16
            for k, (kind, width) in enumerate(kinds):
                size = m if k < 2 else count
                own = np.frombuffer(data, kind, size, at)
                parts[k].append(own + np.int32(sets) if k == 1 else own)
                at += size * width
            sets += count
        keys, place, ids, classes, *n = (np.concatenate(p) for p in parts)
        if often:
            by = np.lexsort((place, ids[place]))
            return pa.table(told(_FREQUENT, keys[by], ids[place][by], classes[place][by]), names)
        classes, n = classes + ids, n[0].astype(np.int64)
        by = np.lexsort((ids[place], n[place], keys))
        keys, place = keys[by], place[by]
        start = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        own, size = classes[place], n[place]
        # runs of one class within a list: the entries around a run are the nearest ones of another class
        run = np.flatnonzero(start | np.concatenate([[True], own[1:] != own[:-1]])) if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.append(run, len(keys)))
        before, behind = np.repeat(run - 1, length), np.repeat(run + length, length)
        i = np.arange(len(keys))
        fits = lambda a, b, ok: ok & (100 * np.minimum(size[a], size[b]) >= settings.percent * np.maximum(size[a], size[b]))
        left, right = np.maximum(before, 0), np.minimum(behind, len(keys) - 1)
        shared = fits(i, left, (before >= 0) & (keys[left] == keys)) | fits(i, right, (behind < len(keys)) & (keys[right] == keys))
        keys, place = keys[shared], place[shared]
        by = np.lexsort((place, ids[place]))
        out = pa.table(told(_SHARED, keys[by], ids[place][by], classes[place][by]), names)
        del parts, own, size, run, length, before, behind, i, left, right, shared, start
        release()
        return out

    dealt = rows.select("id", "n", "class", "posts").mapInArrow(deal, "bucket long, entries binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "kind byte, id long, class long, keys binary")


def _kept_keys(met: DataFrame, mixed) -> DataFrame:
    """id, class, posts and met of _meetings(): each set's keys, of the frequent ones those in the broadcast list `mixed`, and how many."""

    def choose(batches):
        for batch in batches:
            kinds, keep, bodies = batch.column(0).to_numpy(), [], []
            for row, x in enumerate(batch.column(3)):
                own = np.frombuffer(x.as_buffer(), np.int64)
                if kinds[row] == _FREQUENT:
                    at = np.minimum(np.searchsorted(mixed.value, own), max(len(mixed.value) - 1, 0))
                    own = own[mixed.value[at] == own] if len(mixed.value) else own[:0]
                if len(own):
                    keep.append(row)
                    bodies.append(own.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(bodies, pa.binary())], ["id", "class", "keys"])

    def join(batches):
        for batch in batches:
            bodies = [b"".join(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary()), pa.array([len(x) // 8 for x in bodies], pa.int32())], ["id", "class", "posts", "met"])

    rows = met.filter(F.col("kind") != _KEY).mapInArrow(choose, "id long, class long, keys binary")
    return rows.groupBy("id").agg(F.min("class").alias("class"), F.collect_list("keys").alias("keys")).mapInArrow(join, "id long, class long, posts binary, met int")


def _list_pairs(dealt: DataFrame, settings: JaccardSettings, boundary: int, tries: int) -> DataFrame:
    """u, v, more: of the entries of one inverted list that are in different classes so far and may link, for each two
    classes the likeliest `tries` pairs of a bucket; more tells that there are others.

    Three bounds decide what may link, all exact: by sizes; by the number c of shingles that the two prefixes share,
    which is `met` of either set at most; and by their parity sketches. The prefix that ends first in the common
    order, say of n shingles, shares all that it shares with the other set within the other's prefix, so that the
    overlap is c + n - prefix(n) at most. Sets differ in as many shingles at least as their sketches do in places. So
    copies with many changes, which share a list but don't link, are refused here, by the thousands in one step, and
    are not sent anywhere.
    """
    percent, most = settings.percent, settings.sketch

    def link(table: pa.Table) -> pa.Table:
        held = _Bucket(table)
        n, ids, classes, met = held.n.astype(np.int64), held.ids, held.classes, held.met
        words = np.maximum(_sketch_bits(n, most) // 64, 1)
        begin = np.cumsum(words) - words
        place, side, row = held.place, held.side, held.list
        base = np.int64(1 << 32)
        own = n[place]
        rank = row * base + own
        low = np.searchsorted(rank, row * base - (-percent * own // 100))  # the first in its list that is not too small
        span = np.where(own > boundary, np.arange(len(place)) - low, 0)
        found: list[tuple[np.ndarray, ...]] = []
        done, size = np.cumsum(span), 0

        def best():
            """For each two classes the pairs that differ least, and whether some were left out or had been before."""
            u, v, gap, more = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = np.minimum(classes[u], classes[v]), np.maximum(classes[u], classes[v])
            by = np.lexsort((ids[v], ids[u], gap, b, a))
            u, v, gap, more, a, b = (x[by] for x in (u, v, gap, more, a, b))
            fresh = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            u, v, gap, a, b = u[fresh], v[fresh], gap[fresh], a[fresh], b[fresh]
            more = np.maximum.reduceat(more, np.flatnonzero(fresh))
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            count = np.diff(np.append(head, len(a)))
            turn = np.arange(len(a)) - np.repeat(head, count)
            cut = np.repeat((count > tries) | np.maximum.reduceat(more, head), count)
            keep = turn < tries
            return u[keep], v[keep], gap[keep], cut[keep]

        k = 0
        while k < len(place):
            stop = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + (1 << 19), "right")))
            count = span[k:stop]
            v = np.repeat(np.arange(k, stop), count)
            u = np.arange(len(v)) + np.repeat(low[k:stop] - np.cumsum(count) + count, count)
            k = stop
            ok = (classes[place[u]] != classes[place[v]]) & ((side[v] == 0) | (side[u] != side[v]))
            u, v = place[u[ok]].astype(np.int64), place[v[ok]].astype(np.int64)
            least = -(-percent * (n[u] + n[v]) // (100 + percent))
            common = least - np.maximum(-(-percent * n[u] // 100), -(-percent * n[v] // 100)) + 1
            ok = np.minimum(met[u], met[v]) >= common
            u, v, least = u[ok], v[ok], least[ok]
            if not len(u):
                continue
            swap = ids[u] > ids[v]
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            _, at = np.unique(u * len(n) + v, return_index=True)
            u, v, least = u[at], v[at], least[at]
            gap = held.differ(u, v, begin, words)
            ok = gap <= n[u] + n[v] - 2 * least
            if ok.any():
                found.append((u[ok], v[ok], gap[ok] / (n[u] + n[v])[ok], np.zeros(int(ok.sum()), bool)))
                size += int(ok.sum())
                if size > 1 << 18:
                    found[:] = [best()]
                    size = len(found[0][0])
        u, v, _, more = best() if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        out = pa.table({"u": ids[u], "v": ids[v], "more": more})
        del held, found
        release()
        return out

    pairs = dealt.groupBy("bucket").applyInArrow(link, "u long, v long, more boolean")
    return pairs.groupBy("u", "v").agg(F.max("more").alias("more"))


def _verified(pairs: DataFrame, source: DataFrame, settings: JaccardSettings) -> DataFrame:
    """The pairs u, v whose sets link, by exact intersection."""
    wanted = written(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct())
    (few, kept), _ = narrowed(source, wanted)

    def content(batches):
        for batch in map(kept, batches):
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for row, tokens in shingle_sets(batch.column(1), settings.k):
                rows.append((ids[row], tokens.tobytes()))
                held += len(rows[-1][1])
                if held > 4 << 20:
                    yield _batch(["id", "content"], rows, [pa.int64(), pa.binary()])
                    rows, held = [], 0
            yield _batch(["id", "content"], rows, [pa.int64(), pa.binary()])
        release()

    sets = few.mapInArrow(content, "id long, content binary")  # the few that the filter lets through by chance meet no pair

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= settings.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    with_u = pairs.join(sets.select(F.col("id").alias("u"), F.col("content").alias("a")), "u")
    full = with_u.join(sets.select(F.col("id").alias("v"), F.col("content").alias("b")), "v").select("u", "v", "a", "b")
    return full.mapInArrow(check, "u long, v long")


def keep_one_each(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with the document of the smallest id of each class; of rows under one id one stays, and all rows without an id.

    Texts of documents that may have to go, and of repeated ids, meet the list of those that do in a join; the
    others pass by it.
    """
    classes = written(jaccard_classes(docs, settings, id_col, text_col).filter("doc_id is not null"))
    losers = written(classes.filter("doc_id != component_id").select(F.col("doc_id").alias("_loser")).distinct())
    repeated = classes.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    doubtful, plain = parted(docs, written(losers.unionAll(repeated)), id_col)
    kept = doubtful.join(losers, doubtful[id_col] == losers["_loser"], "left_anti").dropDuplicates([id_col])
    return plain.unionByName(kept)


def jaccard_classes(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text: the smallest doc_id reachable over links, itself included.

    Ids are integers, others raise a TypeError. Null texts and texts without words have no shingles and no links. Repeated rows and copies
    are one node from the start. Rows under one id with different texts count as one document with several sets; rows
    without an id link with nothing and have no component.
    An empty table gives an empty result; other columns are ignored. Every link between different sets is either
    verified or lies inside a class that verified links already join; no list, group or partner is cut off.
    """
    spark = docs.sparkSession
    source = integer_ids(id_and_text(docs, id_col, text_col))
    counted = written(_frequent(source, settings))
    lists = counted.filter("kind = 1").agg(F.sum(F.col("n") * (F.col("key") - F.ceil(F.col("key") * settings.percent / 100) + 1))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(lists) // settings.bucket + 1)
    sizes = {int(r["key"]): int(r["n"]) for r in counted.filter("kind = 1 and key <= 64").collect()}
    sizes[64] = sizes.get(64, 0) + 1  # sets of any larger size cost the same under every boundary
    boundary = settings.boundary(sizes)
    heavy = counted.filter(f"kind = 0 and n >= {settings.heavy_count}").orderBy(F.desc("n"), "key").limit(settings.max_heavy).select("key", "n").toPandas()
    order = spark.sparkContext.broadcast((heavy["key"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)))

    signed = written(_signatures(source, settings, boundary))
    nodes = written(signed.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("seeds", True).alias("seeds"), F.first("parts", True).alias("parts")))

    # round 1, linear: in the lists of each set's least shingles by hash, neighbours and the set of the most copies, from
    # which near copies are most likely made, with all others; and all links by subsets
    seeds = nodes.select("id", "n", (-F.col("copies")).alias("rank"), F.explode("seeds").alias("key")).select("key", F.lit(0).alias("o"), "rank", "n", "id")
    near = _runs(seeds, lambda n, m, o: 100 * n >= settings.percent * m)
    parts = nodes.select("id", "n", F.explode("parts").alias("p")).select("p.key", "p.o", F.col("n").cast("long").alias("rank"), "n", "id")
    # in a group of sets with a common subset of size o the smallest set links with every one that has a link there
    small = _runs(parts, lambda n, m, o: (100 + settings.percent) * o >= settings.percent * (n + m))
    # one shingle in common may be that of a shared passage; what only one brings together is left to round 2
    likely = near.filter(f"keys >= {min(settings.agree, settings.seeds)}").unionAll(small).select("u", "v").distinct()
    links = written(_verified(written(likely), source, settings))
    first = written(components(links))

    # round 2, complete: what the inverted lists of whole prefixes hold across those classes. Most sets are a class of
    # their own, which no table needs to tell them; copies and sets of larger classes are looked up
    classed = nodes.filter("seeds is not null").select("id").join(first, "id", "left").select("id", F.coalesce("component", "id").alias("class"))
    alone = nodes.select("id").join(first.select("id"), "id", "left_anti")
    others = written(signed.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct().join(alone, "id", "left_anti"))
    looked_up, single = narrowed(source, others)
    posts = _prefixes(*looked_up, settings, boundary, order).join(classed, "id").unionByName(_prefixes(*single, settings, boundary, order).withColumn("class", F.col("id")))
    met = written(_meetings(posts, settings, buckets, order))
    mixed = spark.sparkContext.broadcast(np.sort(met.filter(F.col("kind") == _KEY).select("id").toPandas()["id"].to_numpy(np.int64)))
    meeting = written(_kept_keys(met, mixed))
    # few of all entries are left: they go to as many buckets as they fill, so that a pair's shingles meet in few places
    left = meeting.agg(F.sum("met")).first()[0] or 0
    final, tries, rows = first, settings.tries, None
    if left:
        few, _ = narrowed(source, meeting.select("id"))
        rows = written(_sketches(*few, settings).join(meeting, "id"))
    while left:
        across = written(_list_pairs(_dealt(rows, settings, int(left) // settings.bucket + 1, order), settings, boundary, tries))
        if across.isEmpty():
            break
        joined = final.filter("id != component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        final = written(components(joined.unionAll(_verified(across.select("u", "v"), source, settings))))
        # classes of which some pairs have not been verified, and that no link has joined so far
        open_pairs = across.filter("more")
        for end in ("u", "v"):
            open_pairs = open_pairs.join(final.select(F.col("id").alias(end), F.col("component").alias(f"class_{end}")), end, "left")
        open_pairs = open_pairs.select(F.coalesce("class_u", "u").alias("a"), F.coalesce("class_v", "v").alias("b")).filter("a != b")
        again = saved(open_pairs.select(F.col("a").alias("class")).unionAll(open_pairs.select(F.col("b").alias("class"))).distinct())
        if again.isEmpty():
            break
        now = meeting.select("id").join(final, "id", "left").select("id", F.coalesce("component", "id").alias("class"))
        classed = written(now.join(again, "class", "left_semi").select("id", "class"))
        few, _ = parted(rows.drop("class"), classed, "id")
        rows = written(few.join(classed, "id"))
        tries *= 16

    labels = nodes.select("d1", "d2", "id").join(final, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("class"))
    linked = signed.select("doc_id", "n", "d1", "d2").join(labels, ["d1", "d2"], "left")
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id")).alias("component_id"))
