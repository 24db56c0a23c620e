"""Language identification by nearest centroids.

A text's vector is the TF-IDF of its hashed byte bigrams and trigrams (letters lower-cased
in A-Z, digits and ASCII signs folded to one space), with sublinear counts and unit
length. Each language has several centroids, made by spherical k-means on a bounded sample of
labelled rows: TRAIN_ROWS in all, as many of each language (the least hashes of their ids),
so that rare languages are learned, too (of more than TRAIN_ROWS languages the most
frequent). A text gets the language of
the centroid of largest cosine; it is rejected when that cosine is less than FAR of what a
text of its length shows. That is one curve over all lengths, fitted to the training texts
and to a piece of each (a beginning of 4 to 8192 bytes), so that tables of all sizes have
it for all lengths.

Defined results: a null text, or one without a letter, is `und` with score 0 and
rejected. Ties go to the lesser language name. Without any labelled row every text is
`und`. Repeated rows get equal results; of training rows that share an id and a language
the least text counts. Only the named columns are read as input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import LOWER, column, slices, text_buffers
from .skew import near_least
from .staging import Staging

DIMS_2, DIMS_3 = 1024, 3072
DIMS = DIMS_2 + DIMS_3
TRAIN_ROWS = 4000
CENTROIDS = 4
ROUNDS = 12
SHARPNESS = 25.0
FAR = 0.37
PIECES = 12
#: Lengths in n-grams at which a curve has half of its square.
TURNS = 2.0 ** np.arange(-2, 14, 0.25)
MOST_ROWS = 128
STEPS = 20

FOLD = LOWER.copy()
FOLD[:65] = 32
FOLD[91:97] = 32
FOLD[123:128] = 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts of hashed n-grams, whether each text has a letter)."""
    data, offsets = text_buffers(texts)
    for a, b in slices(offsets, 1 << 18):
        for first in range(a, b, MOST_ROWS):
            last = min(first + MOST_ROWS, b)
            at = offsets[first : last + 1] - offsets[first]
            raw = data[offsets[first] : offsets[last]]
            rows, n = last - first, len(raw)
            counts = np.zeros(rows * DIMS, np.float32)
            letters = np.zeros(rows, bool)
            if n:
                of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
                letters = np.bincount(of, ASCII_LETTER[raw], rows) > 0
                for k in np.flatnonzero(~letters & (np.diff(at) > 0)):
                    letters[k] = any(map(str.isalpha, raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
                x = FOLD[raw].astype(np.uint32)
                if n > 1:
                    same = of[1:] == of[:-1]
                    pair = x[:-1] * np.uint32(257) + x[1:]
                    h = ((pair * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
                    counts += np.bincount((of[:-1] * DIMS + h)[same], minlength=rows * DIMS)
                    if n > 2:
                        same = of[2:] == of[:-2]
                        h = ((pair[:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)) >> np.uint32(12)).astype(np.int64) % DIMS_3 + DIMS_2
                        counts += np.bincount((of[:-2] * DIMS + h)[same], minlength=rows * DIMS)
            yield first, counts.reshape(rows, DIMS), letters


def unit_vectors(logs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors from log1p of counts."""
    v = logs * idf
    v /= np.maximum(np.sqrt(np.einsum("rd,rd->r", v, v))[:, None], 1e-12)
    return v


def expected_curve(grams: np.ndarray, cos: np.ndarray) -> tuple[float, float]:
    """(height, turn) of the curve height / sqrt(1 + turn / n-grams) with the least absolute errors."""
    grams = np.maximum(grams, 1)
    fits = []
    for turn in TURNS:
        shape = 1 / np.sqrt(1 + turn / grams)
        height = float(np.median(cos / shape))
        fits.append((float(np.abs(cos - height * shape).sum()), height, float(turn)))
    return min(fits)[1:]


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    height: float
    turn: float

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, cosine, rejected)."""
        own, score, top = self.compare(unit_vectors(np.log1p(counts), self.idf))
        return own, score, top, top < self.least(counts.sum(axis=1))

    def least(self, grams: np.ndarray) -> np.ndarray:
        """The least cosine that isn't rejected, for texts of so many n-grams."""
        return FAR * self.height / np.sqrt(1 + self.turn / np.maximum(grams, 1))

    def compare(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = v @ self.centroids.T
        best = np.stack([cos[:, self.of == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        own = best.argmax(axis=1)
        top = best.max(axis=1)
        p = np.exp(SHARPNESS * (best - top[:, None]))
        return own, 1 / p.sum(axis=1), top


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; no randomness."""
    mean = v.mean(axis=0)
    seeds = [v[int((v @ mean).argmax())]]
    near = v @ seeds[0]
    while len(seeds) < min(k, len(v)):
        seeds.append(v[int(near.argmin())])
        near = np.maximum(near, v @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        member = (own == np.arange(len(c))[:, None]).astype(np.float32)
        c = np.where(member.any(axis=1)[:, None], member @ v, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _beginnings(texts: pa.Array) -> pa.Array:
    """A beginning of each text, of a length that its bytes choose; null where the text is no longer."""
    out = []
    for text in texts:
        raw = text.as_py().encode()
        most = 4 << zlib.crc32(raw) % PIECES
        out.append(raw[:most] if len(raw) > most else None)
    return pa.array(out, pa.binary())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-grams, log1p of counts in steps of 1 / STEPS, a byte each): what a training text sends to the driver, and its piece without the lang."""
    for batch in batches:
        langs, texts = column(batch, "_lang"), column(batch, "_text")
        pieces = _beginnings(texts).drop_null()
        for some, names in ((texts, langs), (pieces, pa.nulls(len(pieces), pa.string()))):
            for first, counts, letters in gram_counts(some):
                raw = [np.minimum(np.rint(np.log1p(c) * STEPS), 255).astype(np.uint8).tobytes() for c in counts[letters]]
                sizes = pa.array(counts[letters].sum(axis=1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([names.slice(first, len(letters)).filter(pa.array(letters)), sizes, pa.array(raw, pa.binary())], names=["lang", "grams", "logs"])


def fit(docs: DataFrame, trains: Column, train_rows: int = TRAIN_ROWS, centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from at most train_rows labelled rows where `trains` holds; what comes to the driver is a vector for each and one for its piece."""
    staging = Staging(docs.sparkSession, "langid")
    base = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), trains.alias("_t")).where(F.col("_t") & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    known = staging.table(base.where(F.col("_d").isNotNull()).select("_d", "_lang"), "ids")
    langs = staging.table(known.groupBy("_lang").agg(F.approx_count_distinct("_d", 0.02).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(train_rows), "languages")
    each = max(1, train_rows // max(1, langs.count()))
    near = known.join(F.broadcast(langs), "_lang").where(near_least("_d", each, F.col("_n"))).select("_d", "_lang").distinct()
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_d"), "_d")
    first = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each)
    ids = first.select(F.col("_d").alias("_id"), F.col("_lang").alias("_l"))
    rows = base.join(F.broadcast(ids), (F.col("_d") == F.col("_id")) & (F.col("_lang") == F.col("_l"))).groupBy("_d", "_lang").agg(F.min("_text").alias("_text"))
    got = rows.mapInArrow(_vectors, "lang string, grams long, logs binary").toArrow()
    own = np.array(got.column("lang").is_valid())
    n = int(own.sum())
    if not n:
        return None
    langs, grams = np.array(got.column("lang").to_pylist(), dtype=object).astype(str), got.column("grams").to_numpy()
    logs = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8, len(c) * DIMS, c.offset * DIMS).reshape(-1, DIMS) for c in got.column("logs").chunks if len(c)])
    del got
    key = np.array([zlib.crc32(row) for row in logs])
    order = np.lexsort((key, grams, langs))  # rows may come in any order
    order = order[own[order]]
    names = sorted(set(langs[own]))
    within = sum(np.count_nonzero(logs[order[k : k + MOST_ROWS]], axis=0) for k in range(0, n, MOST_ROWS))
    idf = (np.log((1 + n) / (1 + within)) + 1).astype(np.float32)

    def vectors(rows: np.ndarray) -> np.ndarray:
        return unit_vectors(logs[rows].astype(np.float32) / np.float32(STEPS), idf)

    parts = [_clusters(vectors(order[langs[order] == name]), centroids) for name in names]
    model = Model(names, np.repeat(np.arange(len(names)), [len(p) for p in parts]), np.concatenate(parts).astype(np.float32), idf, 0.0, 1.0)
    cos = np.concatenate([model.compare(vectors(np.arange(k, min(k + MOST_ROWS, len(logs)))))[2] for k in range(0, len(logs), MOST_ROWS)])
    model.height, model.turn = expected_curve(grams, cos)
    return model


def _judge(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, scores, rejected) of a column."""
    n = len(texts)
    langs, scores, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    if model is not None:
        for first, counts, letters in gram_counts(texts):
            own, score, _, far = model.predict(counts)
            for k in np.flatnonzero(letters):
                langs[first + k] = model.languages[own[k]]
            scores[first : first + len(letters)] = np.where(letters, score, 0.0)
            rejected[first : first + len(letters)] = far | ~letters
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = _judge(model, column(batch, "_text"))
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_held"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), held_out.alias("_held"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns; without a model, the rows with a letter."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            if model is None:
                keep = np.concatenate([x for _, _, x in gram_counts(texts)] or [np.zeros(0, bool)])
            else:
                keep = ~_judge(model, texts)[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
