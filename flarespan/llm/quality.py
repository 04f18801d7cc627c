"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k | text) = sigmoid(w.x - t_k) for k = 1 .. K-1 with one weight vector for all grades
and ordered thresholds t_1 < t_2 < ...  x holds hashed words, hashed shapes of words (letter
case, digits, punctuation) and two places for repetition (words equal to the one before, words that
were there before), by share of the text.  The results are the expected grade and the tail
probabilities that a selection compares with its limit.

A null or empty text, or one without words, has x = 0, so its tails come from the thresholds alone.
Long texts are read whole.  Equal texts have equal grades; repeated rows are each graded.  Of several
texts of a rated doc_id one is learnt from.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bare, bounded_features, bounded_labelled, give_back, lists_of, map_texts, place_hash, slices, small_batches

BITS = 18
#: Documented bounds: at most so many rated documents, and so many places of them in all, are used to fit.
MOST_RATED, MOST_PLACES = 10_000, 20_000_000
STEPS, RATE, L2 = 150, 0.3, 1e-4
#: Places after those of hashes.
REPETITION, PLACES = np.array([1 << BITS, (1 << BITS) + 1]), (1 << BITS) + 2


class Classes(dict):
    """Character to the one that stands for its class: capitals X, other letters x, digits 9, marks themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        found = self[code] = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return found


_CLASS_OF, _RUNS = Classes(), re.compile(r"([Xx9])\1+")


def shape(word: str) -> str:
    """Case, digits and marks of a word; the same class in a row counts once, marks stay."""
    return _RUNS.sub(r"\1", word.translate(_CLASS_OF))


def word_table() -> WordTable:
    return WordTable(lambda word: (place_hash(bare(word)), place_hash(shape(word), 1)), 2)


def features(text: bytes, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; words, shapes and repetition each by the root of their share."""
    h = words.hashes(text.decode("utf-8", "replace").split())
    places, counts = np.unique(h >> np.uint64(64 - BITS), return_counts=True)
    again = np.array([(h[1:, 0] == h[:-1, 0]).sum(), len(h) - len(np.unique(h[:, 0]))])
    return np.r_[places.astype(np.int64), REPETITION], np.sqrt(np.r_[counts, again] / max(1, len(h)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by adaptive gradient steps on the mean log loss of all tails."""
    w, first, gaps = np.zeros(PLACES), 0.0, np.zeros(max(0, grades - 2))
    if not rows:
        return w, np.arange(grades - 1, dtype=float)
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    tails = (y[:, None] >= np.arange(1, grades)).astype(float)
    used, at = np.unique(at, return_inverse=True)
    v, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    seen_t = np.full(grades - 1, 1e-8)
    for _ in range(STEPS):
        t = first + np.r_[0, np.cumsum(np.exp(gaps))]
        s = np.bincount(row, v[at] * x, len(rows))
        e = (1 / (1 + np.exp(-np.clip(s[:, None] - t, -35, 35))) - tails) / len(rows)
        g = np.bincount(at, e.sum(1)[row] * x, len(used)) + L2 * v
        seen += g * g
        v -= RATE * g / np.sqrt(seen)
        back = -e.sum(0)[::-1].cumsum()[::-1]  # threshold k moves with its gap and all before
        gt = np.r_[back[:1], back[1:] * np.exp(gaps)]
        seen_t += gt * gt
        step = RATE * gt / np.sqrt(seen_t)
        first -= step[0]
        gaps -= step[1:]
    w[used] = v
    return w, first + np.r_[0, np.cumsum(np.exp(gaps))]


def fit(docs: DataFrame, labels: DataFrame, rating: Column, grades: int, where=None) -> tuple[list[tuple[int, float]], list[float]]:
    """Weights as (place, weight) and thresholds, fitted in one task on the bounded rated rows."""
    def make():
        words = word_table()

        def run(raw):
            both = [features(x, words) for x in raw]
            return {"places": [p.astype(np.int32) for p, _ in both], "shares": [v for _, v in both]}

        return run

    make.factory = True
    rated = map_texts(bounded_labelled(docs, labels, rating, MOST_RATED, where), make, {"places": "array<int>", "shares": "array<double>"}, ("doc_id", "_rating"))
    rated = bounded_features(rated, "places", MOST_PLACES)

    def task(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            ids, ratings, places, shares = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "_rating", "places", "shares"))
            rows += zip(ids.to_pylist(), lists_of(places, np.int32), lists_of(shares, float), ratings.to_pylist(), strict=True)
        rows.sort(key=lambda r: r[0])
        w, t = fit_ordinal([r[1:] for r in rows if 0 <= r[3] < grades], grades)
        at = np.flatnonzero(np.abs(w) > 1e-4)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1 - np.arange(len(t))]), pa.array(np.r_[w[at], t])], ["place", "weight"])

    got = rated.repartition(1).mapInArrow(task, "place bigint, weight double").collect()
    if not got:  # no task runs on a table without rows
        return [], fit_ordinal([], grades)[1].tolist()
    weights = [(r.place, r.weight) for r in got if r.place >= 0]
    return weights, [r.weight for r in sorted(got, key=lambda r: -r.place) if r.place < 0]


def graded(docs: DataFrame, model: tuple[list[tuple[int, float]], list[float]]) -> DataFrame:
    """doc_id, expected_grade, and ``tails`` P(grade >= k), k = 1 .., of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"expected_grade": "double", "tail_1": "double", **{f"tail_{k}": "double" for k in range(2, len(model[1]) + 1)}}

    def make():
        w, t = np.zeros(PLACES, np.float32), np.array(shared.value[1])
        for place, weight in shared.value[0]:
            w[place] = weight
        words = word_table()

        def run(raw):
            s = []
            for x in raw:
                at, v = features(x, words)
                s.append(float(w[at] @ v))
            p = 1 / (1 + np.exp(-np.clip(np.array(s)[:, None] - t, -35, 35)))
            return {"expected_grade": p.sum(1), **{f"tail_{k + 1}": p[:, k] for k in range(len(t))}}

        return run

    make.factory = True
    return map_texts(docs, make, kinds)


def corpus_rating() -> Column:
    """Grades of the ``labels`` table: 0 low quality, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)


def quality(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_1, tail_2, selected (tail_1 at least ``least_tail``)."""
    return graded(docs, fit(docs, labels, corpus_rating(), 3)).withColumn("selected", F.col("tail_1") >= least_tail)


def drop_rejected(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with all their columns, whatever their names, whose tail probability is high enough.

    Scored beside the text in one pass: a join would move every text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, corpus_rating(), 3))
    at_text = [c.lower() for c in docs.columns].index("text")

    def task(batches):
        import pyarrow as pa

        w, t = np.zeros(PLACES, np.float32), shared.value[1][0]
        for place, weight in shared.value[0]:
            w[place] = weight
        words = word_table()
        least = t + np.log(least_tail / (1 - least_tail))  # sigmoid(s - t) >= least_tail
        for b in batches:
            raw = b.column(at_text).cast(pa.binary())
            for lo, hi in slices(raw):
                keep = []
                for x in raw.slice(lo, hi - lo):
                    at, v = features(x.as_py() or b"", words)
                    keep.append(float(w[at] @ v) >= least)
                yield b.slice(lo, hi - lo).filter(pa.array(keep, pa.bool_()))
            del b, raw
            give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)
