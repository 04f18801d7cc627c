"""The whole job and the parts that SQL cannot express, against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flarespan.config import EVENT_ROLES as ROLES
from flarespan.functions import encoding as enc
from flarespan.jobs import queries
from flarespan.operators import confidence, embedding, estimation, evaluation, graph, importance
from flarespan.sources import transactions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int)
    return x, y, spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, label int").persist()


def test_shapley_values_equal_all_coalitions(numbers):
    x, y, df = numbers
    model = importance.fit_trees(df, depth=3, trees=3)
    leaves = importance.leaves_of(model, df.sparkSession)

    def worth(row, known):
        return sum(v * math.prod((lo < row[f] <= hi) if f in known else share for f, lo, hi, share in path) for v, path in leaves)

    got = importance.shap_values(x[:20], leaves)
    for row, phi in zip(x[:20], got):
        for f in range(4):
            rest, want = [g for g in range(4) if g != f], 0.0
            for k in range(4):
                for s in itertools.combinations(rest, k):
                    want += math.factorial(k) * math.factorial(3 - k) / math.factorial(4) * (worth(row, {*s, f}) - worth(row, set(s)))
            assert abs(want - phi[f]) < 1e-9
    raw = model.transform(df.limit(20).select(estimation.array_to_vector("features").alias("_v"))).select("rawPrediction").collect()
    assert np.allclose([r[0][1] for r in raw], [worth(row, set(range(4))) for row in x[:20]])


def test_importance_is_zero_without_rows_or_classes(numbers):
    x, y, df = numbers
    settings = {"depth": 3, "trees": 2}
    assert [r.phi for r in importance.mean_abs_shap(df, df.where("false"), 4, **settings).collect()] == [0.0] * 4
    assert [r.phi for r in importance.mean_abs_shap(df.where("label = 1"), df, 4, **settings).collect()] == [0.0] * 4
    leaves = importance.leaves_of(importance.fit_trees(df, **settings), df.sparkSession)
    want = np.abs(importance.shap_values(x[y == 1], leaves)).mean(0)
    got = importance.mean_abs_shap(df, df.where("label = 1"), 4, **settings).orderBy("feature").collect()
    assert np.allclose([r.phi for r in got], want)


def test_quotas_round_half_to_even():
    assert graph.quotas({0: 75, 1: 25}, 50) == {0: 38, 1: 12}
    assert graph.quotas({0: 25, 1: 75}, 50) == {0: 12, 1: 38}


def columns_of(spark, columns):
    n = max(map(len, columns.values()))
    rows = list(zip(*[[*c, *[None] * (n - len(c))] for c in columns.values()], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in columns)).repartition(3)


@pytest.mark.parametrize("most", [100_000, 20, 2])
def test_medians_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(enc, "MOST_RANKED", most)
    rng = random.Random(1)
    columns = {
        "even": [rng.gauss(0, 1) for _ in range(3000)], "odd": [1.0, 5.0, 2.0], "same": [3.0] * 90, "far": [rng.random() for _ in range(2001)] + [1e9], "two": [1.0] * 50 + [4.0] * 50,
        "heavy": [7.0] * 1000 + [rng.random() * 14 for _ in range(1500)], "tail": [math.exp(rng.gauss(0, 6)) for _ in range(999)], "none": [None], "one": [2.0],
    }
    got = enc.medians(columns_of(spark, columns), list(columns))
    assert got == {k: float(np.median(c)) if k != "none" else None for k, c in columns.items()}


def test_few_values_are_ranked_whatever_the_distribution(spark, monkeypatch):
    """One value of 1e9 among 20,000 small ones."""
    monkeypatch.setattr(enc, "MOST_RANKED", 500)
    monkeypatch.setattr(enc, "ACCURACY", 1000)
    seen = []
    plain = spark.__class__.createDataFrame
    monkeypatch.setattr(spark.__class__, "createDataFrame", lambda self, rows, *a: seen.append(rows) or plain(self, rows, *a))
    rows = spark.range(20_001).selectExpr("IF(id = 0, 1e9, CAST(id % 9973 AS DOUBLE)) AS x")
    want = float(np.median([1e9, *[i % 9973 for i in range(1, 20_001)]]))
    assert enc.medians(rows, ["x"]) == {"x": want}
    start = seen[-1][0][1]
    assert start > 9_500  # all values below the bounds are only counted


def test_scores_are_dealt_evenly_whatever_the_distribution(spark):
    rows = spark.range(4000).selectExpr("id AS row_id", "CAST(id % 3 = 0 AS INT) AS label", "IF(id = 0, 1e9, CAST(id AS DOUBLE) / 4000) AS score")
    c = evaluation.cumulative(rows).orderBy("up_n").collect()
    assert [r.up_n for r in c] == list(range(1, 4001)) and c[-1].up_pos == c[0].all_pos == 1334
    y, n, hit = [r.pos for r in c], 0, 0
    ap = 0.0
    for x in y:
        n, hit = n + 1, hit + x
        ap += x / 1334 * hit / n
    assert abs(evaluation.average_precision(rows).first()[0] - ap) < 1e-12


def test_fraud_means_and_possibility_equal_loops(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3 % 2, int(i % 5 < 2), t0 + dt.timedelta(seconds=rng.randrange(7200)), [rng.random(), rng.random()]) for i in range(60)]
    rows += [(60, 0, 1, rows[0][3], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, lifetime_id long, label int, ts timestamp_ntz, v array<double>")
    frauds = [r for r in rows if r[2]]
    means = {}
    for j, life, _, t, _ in frauds:
        total = np.zeros(2)
        for g in range(-15, 16):
            a, b = sorted((t, t + dt.timedelta(minutes=g)))
            total += np.mean([r[4] for r in frauds if r[1] == life and a <= r[3] <= b], axis=0)
        means[j] = total
    got = {r.j: r.w for r in confidence.windowed_fraud_means(df.where("label = 1"), "v").collect()}
    assert got.keys() == means.keys() and all(np.allclose(got[j], means[j]) for j in got)
    fps = dict.fromkeys([r[0] for r in rows if not r[2]], 0.0)
    for j, life, _, t, _ in frauds:
        a = {r[0]: 1 / (1 + math.exp(abs((r[3] - t).total_seconds() / 60))) * float(np.dot(r[4], means[j])) for r in rows if not r[2] and r[1] == life}
        if sum(a.values()) > 0:
            for i, x in a.items():
                fps[i] += x / sum(a.values())
    raw = confidence.possibility_raw(df, df.where("label = 0"), ["v"]).collect()
    assert {r.row_id for r in raw} == fps.keys() and all(abs(r.fps - fps[r.row_id]) < 1e-9 for r in raw)


def test_fraud_means_of_one_long_lifetime(spark):
    """Parts of a lifetime: frauds of many parts, some at the same time, some far from all others."""
    rng = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 50 == 0, t0 + dt.timedelta(seconds=rng.choice([60, 7, 1]) * rng.randrange(3000)), [rng.random(), float(i % 3)]) for i in range(400)]
    rows = [(i, int(odd), t, v) for i, odd, t, v in rows]
    df = spark.createDataFrame(rows, "row_id long, lifetime_id int, ts timestamp_ntz, v array<double>").repartition(5)
    got = {r.j: r.w for r in confidence.windowed_fraud_means(df, "v").collect()}
    assert len(got) == 400
    for j, life, t, _ in rows[::9]:
        total = np.zeros(2)
        for g in range(-15, 16):
            a, b = sorted((t, t + dt.timedelta(minutes=g)))
            total += np.mean([r[3] for r in rows if r[1] == life and a <= r[2] <= b], axis=0)
        assert np.allclose(got[j], total)
    assert confidence.windowed_fraud_means(df.where("false"), "v").collect() == []


def test_ranking_of_equal_scores(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), 0.5) for i in range(200)], "row_id long, label int, score double")
    assert [r.row_id for r in evaluation.top_percent(df, 5).where("flagged = 1").orderBy("row_id").collect()] == list(range(10))
    assert sorted(r["rank"] for r in evaluation.ranked(df).collect()) == list(range(1, 201))


def test_embedding_of_unseen_rows_equals_a_dense_pass(spark):
    rng = np.random.default_rng(2)
    xs, ys, q = rng.normal(size=(40, 3)), np.arange(40) % 4 % 2, rng.normal(size=(7, 3))
    d = embedding.distances(xs, xs, 3.0)
    np.fill_diagonal(d, np.inf)
    a = embedding.weights_matrix(d.shape, embedding.signed_edges(d, ys, ys, 0.2, 0.1)).astype(float)
    w, _ = embedding.trained(xs, a, ys, epochs=3, out=5)
    ref = spark.createDataFrame([(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(xs, ys))], "row_id long, label int, x array<double>")
    new = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(q)], "row_id long, x array<double>")
    hidden = np.maximum(xs @ w["self1"] + a @ xs @ w["near1"] + w["bias1"], 0)
    got = {r.row_id: r.embedding for r in embedding.embed(new, w, ref, 0.2, 0.1).collect()}
    votes = {r.src: r.vote for r in embedding.vote_unseen(new, ref, 0.2).collect()}
    sizes = {c: int((ys == c).sum()) for c in (0, 1)}
    for i, x in enumerate(q):
        far = (np.abs(xs - x) ** 3).sum(1) ** (1 / 3)
        order = np.argsort(far)
        k = max(1, min(graph.neighbours(0.2, n - 1) for n in sizes.values()))
        own = int(np.bincount(ys[order[:k]], minlength=2).argmax())
        assert votes[100 + i] == own
        near = [(j, 1) for j in order if ys[j] == own][: graph.neighbours(0.2, sizes[own] - 1)] + [(j, -1) for j in order if ys[j] != own][: graph.neighbours(0.1, 40 - sizes[own])]
        row = np.zeros(40)
        for j, sign in near:
            row[j] = sign / (1 + far[j]) / len(near)
        h = np.maximum(x @ w["self1"] + row @ xs @ w["near1"] + w["bias1"], 0)
        assert np.allclose(got[100 + i], h @ w["self2"] + row @ hidden @ w["near2"] + w["bias2"], atol=1e-5)


def test_choice_of_ratios_equals_a_plain_search(spark):
    rng = np.random.default_rng(6)
    xs, ys, grid = rng.normal(size=(24, 2)), np.arange(24) % 2, (0.1, 0.3)
    ref = spark.createDataFrame([(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(xs, ys))], "row_id long, label int, x array<double>")
    found = []
    for r_pos, r_neg in itertools.product(grid, grid):
        to = {}
        for i in range(24):
            far = (np.abs(xs - xs[i]) ** 3).sum(1) ** (1 / 3)
            order = [j for j in np.argsort(far) if j != i]
            to[i] = set([j for j in order if ys[j] == ys[i]][: graph.neighbours(r_pos, 11)] + [j for j in order if ys[j] != ys[i]][: graph.neighbours(r_neg, 12)])
        hops = []
        for i in range(24):
            seen, front, n = {i}, {i}, 0
            while front:
                n, front = n + 1, {k for j in front for k in to[j]} - seen
                seen |= front
                hops += [n] * len(front)
        back = sum(i in to[j] for i in to for j in to[i]) / sum(map(len, to.values()))
        found.append((max(hops), np.mean(hops), len(hops), back))
    span = np.ptp(found, axis=0)
    score = np.where(span > 0, (np.array(found) - np.min(found, axis=0)) / np.where(span > 0, span, 1), 1).mean(1).round(12)
    rows = embedding.select_k_ratios(ref, grid).orderBy("candidate").collect()
    assert np.allclose([[r.diameter, r.mean_path, r.pairs, r.reciprocity] for r in rows], found) and np.allclose([r.score for r in rows], score)
    assert [r.candidate for r in rows if r.chosen] == [int(score.argmax())]


def test_transactions_are_written_read_and_checked(spark, tmp_path):
    t = transactions.event_transactions(spark, SF).where("created IS NOT NULL")
    transactions.write_transactions(t, str(tmp_path / "t"))
    back = transactions.read_transactions(spark, str(tmp_path / "t"))
    assert back.count() == t.count() and {*t.columns, "slot_date"} == set(back.columns)
    transactions.validate(back, ROLES, require_labels=True)
    bad = [t.drop("k"), t.withColumn("ts", F.col("ts").cast("string")), t.withColumn("amount", -F.abs("amount") - 1), t.withColumn("amount", F.lit(float("nan"))), t.withColumn("label", F.lit(2)), t.where("false")]
    for x in bad:
        with pytest.raises(ValueError):
            transactions.validate(x, ROLES, require_labels=True)


def test_whole_job(spark):
    model, test = queries.fitted(spark, SF)
    s = model.summary
    assert s["folds"] == 2 and s["lifetimes"] > 0 and s["inside"] > 0 and s["remaining"] >= 0 and s["active_slots"] >= s["lifetimes"]
    assert model.enricher.enabled and set(model.enricher.ratios) == set(ROLES.levels) and s["transaction_k_pos_0"] >= 2
    out = queries.job.predict(model, test)
    assert out.count() == test.count() and out.where("score NOT BETWEEN 0 AND 1 OR p_fraud NOT BETWEEN 0 AND 1").count() == 0
    assert out.where("lifetime_id >= 0 AND adjusted <> score").count() == 0
