"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the set of its words, their stems (the first 4 to 7 letters, so that endings do
not hide a word), the words and stems that it holds at least two and at least three times,
neighbouring pairs, and pairs with one word between them (lower case, without punctuation at the
ends), hashed into ``2 ** BITS`` places.  FTRL-proximal
keeps a learning rate for each place and its L1 term leaves most weights at exactly zero, so the
fitted model is a short list (place, weight) that is broadcast.

A null or empty text, or one without words, has the score of the bias alone.  A null label is no
label.  Long texts are scored whole.  Equal texts have equal scores; repeated rows are each scored.
Of several texts of a labelled doc_id one is learnt from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bare, bounded_features, bounded_labelled, lists_of, map_texts, mix, ngrams, place_hash

BITS = 20
#: Documented bounds: at most so many labelled documents, and so many places of them in all, are used to fit.
MOST_LABELLED, MOST_PLACES = 10_000, 30_000_000
#: Chosen by three-fold cross-validation on the rows of sf0.1 that are not held out.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 1.0, 4
STEMS, OFTEN = (4, 5, 6, 7), (2, 3)


def forms(word: str) -> tuple[int, ...]:
    w = bare(word)
    return (place_hash(w), *(place_hash(w[:k], k) for k in STEMS))


def word_table() -> WordTable:
    return WordTable(forms, 1 + len(STEMS))


def features(text: bytes, words: WordTable) -> np.ndarray:
    """Distinct places of a text; place 0 is the bias."""
    h = words.hashes(text.decode("utf-8", "replace").split())
    single, n = np.unique(h, return_counts=True)
    often = [mix(single[n >= k] + np.uint64(k)) for k in OFTEN]
    grams = np.concatenate([single, *often, ngrams(h[:, 0], 0, 1), ngrams(h[:, 0], 0, 2)]) >> np.uint64(64 - BITS)
    places = np.unique(grams).astype(np.int64)
    return np.r_[0, places[places > 0]]


def labelled_features(docs: DataFrame, labels: DataFrame, rating: Column, where=None, most: int = MOST_LABELLED) -> DataFrame:
    """At most ``most`` rows with MOST_PLACES places in all: doc_id, _rating and ``places``."""

    def make():
        words = word_table()
        return lambda raw: {"places": [features(x, words).astype(np.int32) for x in raw]}

    make.factory = True
    rows = map_texts(bounded_labelled(docs, labels, rating, most, where), make, {"places": "array<int>"}, ("doc_id", "_rating"))
    return bounded_features(rows, "places", MOST_PLACES)


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after some passes; ``examples`` are (places, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(zi) <= L1) & (at > 0), 0.0, w)  # the bias has no L1 term worth keeping

    for _ in range(epochs):
        for at, y in examples:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def fit(docs: DataFrame, labels: DataFrame, label: Column, where=None) -> list[tuple[int, float]]:
    """Non-zero weights as (place, weight), fitted in one task on the bounded labelled rows.

    Without any labelled rows the model is the bias alone, at zero.
    """
    sample = labelled_features(docs, labels, label, where)

    def task(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            ids, ratings, places = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "_rating", "places"))
            rows += zip(map(hash_order, ids.to_pylist()), ids.to_pylist(), lists_of(places, np.int32), ratings.to_pylist(), strict=True)
        rows.sort(key=lambda r: r[:2])
        w = ftrl([(at, y) for _, _, at, y in rows]) if rows else np.zeros(1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["place", "weight"])

    return [(r.place, r.weight) for r in sample.repartition(1).mapInArrow(task, "place bigint, weight double").collect()]


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFF


def scored(docs: DataFrame, model: list[tuple[int, float]]) -> DataFrame:
    """doc_id and ``score`` between 0 and 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w = np.zeros(1 << BITS, np.float32)
        for place, weight in shared.value:
            w[place] = weight
        words = word_table()

        def run(raw):
            s = np.array([w[features(x, words)].sum(dtype=np.float64) for x in raw])
            return {"score": 1 / (1 + np.exp(-np.clip(s, -35, 35)))}

        return run

    make.factory = True
    return map_texts(docs, make, {"score": "double"})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted.  Only labels of rows that are not held out are learnt from."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, labels, F.col("toxic").cast("int"), ~held)
    return scored(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
