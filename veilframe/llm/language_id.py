"""Language identification with string kernels.

k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|) over the sets G of byte n-grams of one to three bytes (a blended
spectrum of presences). n-grams of two and three bytes are hashed to a fixed number of columns, so that G is a set of
columns: very long texts, which hold most n-grams of their language, fill a large part of them, and the kernel then
compares which columns they leave out. Landmark texts give the Nystroem features k(x, L) K(L, L)^(-1/2), and one ridge regression
for each language against the rest is fitted on them. Scoring multiplies a batch's presence matrix with the
landmarks' and the result with the regressions' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.textio import bound_batches, has_letter, release, text_buffer, text_offsets

#: A-Z as a-z; digits, signs and blanks as one blank; bytes of other scripts as they are.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


@dataclass(frozen=True)
class LanguageSettings:
    """width: columns of the presence matrix, to which n-grams are hashed (1-grams have 256 of their own).
    train_rows: labelled texts fitted on at most, taken in the order of a hash of their id. landmarks: so many of them, dealt evenly over the languages.
    ridge: weight of the squared norm. sharpness: of the softmax that turns regression values into a score."""

    width: int = 8192
    train_rows: int = 3000
    landmarks: int = 256
    ridge: float = 1e-2
    sharpness: float = 4.0


def presence(text: np.ndarray, width: int) -> np.ndarray:
    """Columns of the n-grams of one text given as bytes; some may be named twice."""
    one = _PLAIN[text]
    two = (one[:-1] << 8) | one[1:]
    three = (two[:-1] << 8) | one[2:]
    place = lambda x, salt: 256 + ((x * np.uint32(0x9E3779B1) + np.uint32(salt)) >> np.uint32(8)) % np.uint32(width - 256)
    return np.concatenate([one, place(two, 0x1F123BB5), place(three, 0x5BD1E995)])


def presence_matrix(texts: pa.Array, rows: range, width: int) -> np.ndarray:
    offsets, data = text_offsets(texts), text_buffer(texts)
    out = np.zeros((len(rows), width), np.float32)
    for k, row in enumerate(rows):
        part = data[offsets[row] : offsets[row + 1]]
        for low in range(0, len(part), 1 << 18):  # long texts in stretches that overlap by two bytes: the union is the whole text's set
            out[k, presence(part[low : low + (1 << 18) + 2], width)] = 1
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x width, rows divided by the root of their number of n-grams
    weights: np.ndarray  # landmarks x languages
    usual: np.ndarray  # width x languages, logarithm of the share of a language's fitted texts that have an n-gram
    least: float  # evidence that a text of a learned language has

    def scores(self, found: np.ndarray, sharpness: float) -> np.ndarray:
        """texts x languages, rows sum to 1."""
        norm = np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))
        value = ((found @ self.landmarks.T) / norm) @ self.weights
        value = np.exp(sharpness * (value - value.max(1, keepdims=True)))
        return value / value.sum(1, keepdims=True)

    def evidence(self, found: np.ndarray) -> np.ndarray:
        """Of each text how usual its n-grams are, on average, in the language they fit best. Other languages neither add to it nor take from it."""
        return (found @ self.usual).max(1) / np.maximum(found.sum(1), 1)


def fit(bits: np.ndarray, languages: np.ndarray, settings: LanguageSettings) -> LanguageModel:
    """Nystroem features and one-versus-rest ridge regression on a presence matrix."""
    names, y = np.unique(languages, return_inverse=True)
    found = bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[: settings.landmarks]
    marks = found[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    features = (found @ marks.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.sqrt(np.bincount(y)[y])[:, None]  # rare languages weigh as much as frequent ones, by half
    left = (features * share).T @ features + settings.ridge * share.mean() * len(y) / 100 * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(left, (features * share).T @ target)
    usual = np.stack([np.log((bits[y == k].sum(0) + 0.5) / ((y == k).sum() + 1)) for k in range(len(names))], 1)
    model = LanguageModel([str(x) for x in names], marks.astype(np.float32), weights.astype(np.float32), usual.astype(np.float32), 0.0)
    known = model.evidence(bits)
    model.least = float(known.min() - (np.median(known) - known.min()) / 2)  # all fitted texts stay, with room for those that were not drawn
    return model


def train(docs: DataFrame, rows: Column, settings: LanguageSettings = LanguageSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel | None:
    """A model of the labelled rows for which `rows` holds; None if there is none.

    The sample is bounded by settings.train_rows: ids are drawn first, without reading texts, and texts come to the
    driver as bit sets of width / 8 bytes each, whatever their length. Null labels and null ids don't count; of rows
    under one id the one of the least label and n-grams does; null and empty texts have no n-grams; an empty table
    gives no model; other columns are ignored.
    """
    width = settings.width
    known = docs.filter(rows & F.col(label_col).isNotNull())
    drawn = known.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit("language")), "_id").limit(settings.train_rows).collect()
    if not drawn:
        return None
    ids = docs.sparkSession.createDataFrame(drawn, "_id " + docs.schema[id_col].dataType.simpleString())
    texts = known.join(F.broadcast(ids), known[id_col] == ids["_id"], "left_semi").select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("y"), F.col(id_col).cast("string").alias("id"))

    def pack(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                own = range(low, min(low + 256, batch.num_rows))
                bits = np.packbits(presence_matrix(batch.column(0), own, width).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(low, len(own)), batch.column(1).slice(low, len(own)), pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "y", "bits"])

    one = texts.mapInArrow(pack, "id string, y string, bits binary").groupBy("id").agg(F.min(F.struct("y", "bits")).alias("r"))
    got = sorted((r["r"]["y"], bytes(r["r"]["bits"])) for r in one.collect())
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return fit(bits, np.array([y for y, _ in got]), settings)


def identify(docs: DataFrame, model: LanguageModel | None, settings: LanguageSettings = LanguageSettings(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every whole text, and the columns in `keep` (not named like these).

    A text that is null or has no letter is `und` with score 0, and so is all without a model. Languages that tie give
    the first of them by name. Repeated rows are scored one by one, an empty table gives an empty result, columns that
    are not asked for are ignored. One narrow pass; the model that is broadcast has landmarks * width floats (8 MB).
    """
    bound_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    width, sharpness = settings.width, settings.sharpness
    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(0)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows if known else 0, 128):
                rows = range(low, min(low + 128, batch.num_rows))
                values = known.scores(presence_matrix(texts, rows, width), sharpness)
                best[rows.start : rows.stop], score[rows.start : rows.stop] = values.argmax(1), values.max(1)
            names = [known.languages[b] if b >= 0 and has_letter(t.as_py()) else "und" for b, t in zip(best, texts, strict=True)]
            score[[n == "und" for n in names]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])
        release()

    return source.mapInArrow(run, f"{out}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel | None, settings: LanguageSettings = LanguageSettings(), text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """docs, all columns kept, without the rows that have no letter or less evidence of every learned language than the
    labelled rows the model was fitted on. A column named by lang_col holds what language a row's text is in, whatever
    its label says, or none. Without a model nothing is rejected but texts without letters, null and empty ones among
    them, and labels stay. Repeated rows are each judged alike; an empty table stays empty; columns of any name are kept."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, width, sharpness = docs.columns.index(text_col), settings.width, settings.sharpness
    lang = docs.columns.index(lang_col) if lang_col in docs.columns and model else None

    def run(batches):
        known = shared.value
        for batch in batches:
            texts, keep, best = batch.column(place), np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for low in range(0, batch.num_rows if known else 0, 128):
                rows = range(low, min(low + 128, batch.num_rows))
                found = presence_matrix(texts, rows, width)
                keep[rows.start : rows.stop] = known.evidence(found) >= known.least
                if lang is not None:
                    best[rows.start : rows.stop] = known.scores(found, sharpness).argmax(1)
            keep &= np.array([has_letter(t.as_py()) for t in texts], bool)
            if lang is not None:
                batch = batch.set_column(lang, batch.schema.names[lang], pa.array([known.languages[b] for b in best], pa.string()))
            yield batch.filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if k == lang else f.dataType, True) for k, f in enumerate(docs.schema)]))
