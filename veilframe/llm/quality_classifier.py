"""Quality classification by positive-unlabelled learning.

A text is seen through the words and word pairs it holds, hashed, and through shares of characters and of repeated
words and lines. A linear model of the former and a small network of the latter are trained together on trusted
positives and unlabelled text with the non-negative unbiased risk
prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)).
The class prior is estimated from the same two samples; no negative label is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shingles import mix64, word_hashes
from veilframe.llm.textio import id_and_text, slices_by_bytes, text_buffer, text_offsets

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "line": (10,), "stop": b".", "comma": b",;:", "cry": b"!?", "sign": b"#*$%&|<>", "other": b"\"'()[]{}=+-_/\\@^`~", "high": range(128, 256)}
N_FEATURES = len(_CLASSES) + 10


@dataclass(frozen=True)
class QualitySettings:
    """positives, unlabelled: rows of each kind fitted on at most, in the order of a hash of their id. words: columns that
    words and word pairs are hashed to. hidden, steps, batch, rate, decay: of the model and its training; seed: of its
    start. prior: the share of positives in unlabelled text, where it is known; else it is estimated."""

    positives: int = 4000
    unlabelled: int = 8000
    words: int = 8192
    hidden: int = 16
    steps: int = 400
    batch: int = 512
    rate: float = 5e-3
    decay: float = 1e-2
    seed: int = 17
    prior: float | None = None


def features(texts: pa.Array, low: int, high: int) -> np.ndarray:
    """One row of numbers for each whole text: shares of kinds of characters, repetition of words, word triples and lines, lengths. A null counts as empty."""
    offsets, data = text_offsets(texts), text_buffer(texts)
    base = offsets[low]
    part, starts = data[base : offsets[high]], offsets[low:high] - base
    n = np.diff(offsets[low : high + 1]).astype(np.float64)
    out = np.zeros((high - low, N_FEATURES))
    if not len(part):
        return out
    kind = np.zeros(256, np.int64) + len(_CLASSES)
    for k, chars in enumerate(_CLASSES.values()):
        kind[list(chars)] = k
    owner = np.repeat(np.arange(high - low), n.astype(np.int64))
    counts = np.bincount(owner * (len(_CLASSES) + 1) + kind[part], minlength=(high - low) * (len(_CLASSES) + 1)).reshape(high - low, -1)
    out[:, : len(_CLASSES)] = np.sqrt(counts[:, : len(_CLASSES)] / np.maximum(n, 1)[:, None])
    words, text_of = word_hashes(part, starts)
    bounds = np.searchsorted(text_of, np.arange(high - low + 1))
    triples = mix64(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)) if len(words) > 2 else words[:0]
    c = len(_CLASSES)
    for k in range(high - low):
        a, b = bounds[k], bounds[k + 1]
        m = b - a
        if not m:
            continue
        own, times = np.unique(words[a:b], return_counts=True)
        out[k, c] = len(own) / m
        out[k, c + 1] = times.max() / m
        out[k, c + 2] = len(np.unique(triples[a : b - 2])) / (m - 2) if m > 2 else 1
        out[k, c + 3] = (words[a + 1 : b] == words[a : b - 1]).mean() if m > 1 else 0
        out[k, c + 4] = np.log1p(m) / 10
        out[k, c + 5] = np.log1p(n[k] / m) / 3
        raw = part[starts[k] : starts[k] + int(n[k])].tobytes()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[k, c + 6] = len(set(lines)) / max(1, len(lines))
        out[k, c + 7] = np.log1p(n[k] / max(1, len(lines))) / 10
        out[k, c + 8] = min(1.0, np.log1p(times[times > 1].sum()) / 10)
        out[k, c + 9] = 1
    return out


@dataclass
class Texts:
    """Texts as numbers: `dense` features, and the columns of the words and word pairs each holds, `columns[bounds[i]:bounds[i + 1]]`."""

    dense: np.ndarray
    columns: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def take(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])
        return Texts(self.dense[rows], self.columns[at], bounds)

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Texts:
        """Of (dense, columns) of single texts."""
        return Texts(np.array([d for d, _ in parts]).reshape(len(parts), N_FEATURES), np.concatenate([np.zeros(0, np.int32), *[c for _, c in parts]]), np.cumsum([0, *[len(c) for _, c in parts]]))


def word_columns(texts: pa.Array, low: int, high: int, width: int) -> list[np.ndarray]:
    """For each whole text the sorted distinct columns of its words and word pairs, A-Z as a-z; none of a null."""
    offsets, data = text_offsets(texts), text_buffer(texts)
    part, starts = data[offsets[low] : offsets[high]], offsets[low:high] - offsets[low]
    if not len(part):
        return [np.zeros(0, np.int32)] * (high - low)
    words, text_of = word_hashes(part, starts)
    bounds = np.searchsorted(text_of, np.arange(high - low + 1))
    one = (words >> np.uint64(20)) % np.uint64(width)
    two = (mix64(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(20)) % np.uint64(width)
    return [np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]])).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def seen(texts: pa.Array, low: int, high: int, width: int) -> Texts:
    columns = word_columns(texts, low, high, width)
    return Texts(features(texts, low, high), np.concatenate([np.zeros(0, np.int32), *columns]), np.cumsum([0, *[len(c) for c in columns]]))


class Network:
    """One hidden layer of rectified units over the dense features, scaled to mean 0 and variance 1, plus a linear model of
    the words: the mean of their weights, times the root of how many there are."""

    def __init__(self, mean, scale, hidden: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.width = mean, scale, width
        self.w = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1), np.zeros(width)]

    def _share(self, x: Texts) -> tuple[np.ndarray, np.ndarray]:
        """What each column of each text counts, and the text it is of."""
        size = np.diff(x.bounds)
        return np.repeat(1 / np.sqrt(np.maximum(size, 1)), size), np.repeat(np.arange(len(x)), size)

    def forward(self, x: Texts):
        z = np.clip((x.dense - self.mean) / self.scale, -6, 6)
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        share, owner = self._share(x)
        return z, h, h @ self.w[2] + self.w[3][0] + np.bincount(owner, self.w[4][x.columns] * share, len(x))

    def scores(self, x: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))

    def gradient(self, x: Texts, by_output):
        z, h, _ = self.forward(x)
        back = by_output[:, None] * self.w[2] * (h > 0)
        share, owner = self._share(x)
        return [z.T @ back, back.sum(0), h.T @ by_output, np.array([by_output.sum()]), np.bincount(x.columns, by_output[owner] * share, self.width)]


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk, with the sigmoid loss, of the scores of positives and of unlabelled texts: of
    positives taken for negatives, and of negatives taken for positives, which a sample can make negative."""
    return prior * float((1 - positive).mean()), float(unlabelled.mean() - prior * positive.mean())


def train_network(positive: Texts, unlabelled: Texts, prior: float, settings: QualitySettings) -> Network:
    """Minimises the non-negative risk by Adam. Where the part that stands for the negatives turns negative, its own gradient is climbed instead."""
    whole = np.concatenate([positive.dense, unlabelled.dense])
    net = Network(whole.mean(0), whole.std(0) + 1e-6, settings.hidden, settings.words, settings.seed)
    rng = np.random.default_rng(settings.seed + 1)
    first, second = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for step in range(1, settings.steps + 1):
        p, u = positive.take(rng.integers(0, len(positive), settings.batch)), unlabelled.take(rng.integers(0, len(unlabelled), settings.batch))
        sp, su = net.scores(p), net.scores(u)
        slope_p, slope_u = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # of the score; the loss as 0 is the score, as 1 it is 1 - score
        if risk(sp, su, prior)[1] >= 0:
            grad = [a + b for a, b in zip(net.gradient(p, -2 * prior * slope_p), net.gradient(u, slope_u), strict=True)]
        else:
            grad = [a + b for a, b in zip(net.gradient(p, prior * slope_p), net.gradient(u, -slope_u), strict=True)]
        for k, g in enumerate(grad):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.w[k] = net.w[k] * (1 - settings.rate * settings.decay) - settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Estimate of the share of positives in unlabelled text from scores of both, neither of them fitted on.

    Above any limit stands at least that share of the unlabelled texts, times the part of the positives that stand
    there. The limit where the ratio of both parts is least, with a bound for the chance in either, gives the ratio.
    """
    limits = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), limits, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), limits, "left") / len(unlabelled)
    chance = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    return float((u / p)[np.argmin((u + chance) / p)])


def estimated_prior(positive: Texts, unlabelled: Texts, settings: QualitySettings) -> float:
    """The class prior, between 0.02 and 0.98: a model that tells positives from unlabelled text is fitted on every other row of
    both and judges the rest. With fewer than 20 rows of a kind it is 0.5."""
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    half = lambda x, k: x.take(np.arange(k, len(x), 2))
    net = train_network(half(positive, 0), half(unlabelled, 0), 0.5, replace(settings, steps=max(1, settings.steps // 2)))
    return min(0.98, max(0.02, least_ratio(net.scores(half(positive, 1)), net.scores(half(unlabelled, 1)))))


def _drawn(rows: DataFrame, id_col: str, salt: str, most: int) -> DataFrame:
    """The ids of `most` rows at most, in the order of a hash, each once."""
    return rows.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(salt)), "_id").limit(most)


def _rows_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> dict:
    """What is seen of the rows with these ids, a bounded list; texts stay on the executors. Of rows under one id the one whose text comes first counts."""

    def measure(batches):
        for batch in batches:
            for low, high in slices_by_bytes(batch.column(1), 4 << 20, 2048):
                rows = seen(batch.column(1), low, high, width)
                columns = [x.astype("<i4").tobytes() for x in np.split(rows.columns, rows.bounds[1:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(list(rows.dense), pa.list_(pa.float64())), pa.array(columns, pa.binary())], ["doc_id", "x", "words"])

    wanted = docs.join(F.broadcast(ids), docs[id_col] == ids["_id"], "left_semi")
    source = id_and_text(wanted, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    out: dict = {}
    for r in source.mapInArrow(measure, f"doc_id {kind}, x array<double>, words binary").groupBy("doc_id").agg(F.min(F.struct("x", "words")).alias("r")).collect():
        out[r["doc_id"]] = np.array(r["r"]["x"]), np.frombuffer(bytes(r["r"]["words"]), "<i4")
    return out


def train(docs: DataFrame, labels: DataFrame, rows: Column, settings: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """A model of the rows for which `rows` (a condition on the id) holds: trusted positives are those labelled 1, unlabelled
    text is any row, whatever its label.

    Other labels than 1 are never read. Samples are bounded by settings.positives and settings.unlabelled; ids are
    drawn before texts are read. Labels of ids that no document has, null labels and null ids don't count; an id that is
    labelled twice is a positive if one of its labels is 1; null texts are texts without a character; other columns
    are ignored. None without positives or texts, as of empty tables.
    """
    good_ids = _drawn(labels.filter(rows & (F.col(label_col) == 1)), id_col, "quality", settings.positives)
    plain_ids = _drawn(docs.filter(rows), id_col, "unlabelled", settings.unlabelled)
    good, plain = ([r[0] for r in ids.collect()] for ids in (good_ids, plain_ids))
    if not good or not plain:
        return None
    kind = docs.schema[id_col].dataType
    listed = docs.sparkSession.createDataFrame([(i,) for i in {*good, *plain}], "_id " + kind.simpleString())
    table = _rows_of(docs, listed, id_col, text_col, settings.words)
    positive, unlabelled = (Texts.of([table[i] for i in sorted(ids) if i in table]) for ids in (good, plain))
    if not len(positive) or not len(unlabelled):
        return None
    prior = settings.prior if settings.prior is not None else estimated_prior(positive, unlabelled, settings)
    return train_network(positive, unlabelled, prior, settings)


def classify(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from a score of 0.5 on) of every whole text.

    Null and empty texts are scored as texts without a character. Without a model all scores are 0.5. Repeated rows
    are scored one by one, an empty table gives an empty result, other columns are ignored. One narrow pass.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for batch in batches:
            for low, high in slices_by_bytes(batch.column(1), 4 << 20, 2048):
                score = net.scores(seen(batch.column(1), low, high, net.width)) if net else np.full(high - low, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
