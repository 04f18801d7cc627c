"""Hand cases, edge cases, and each query against its SQL twin on the smallest tables."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flarespan.config import Settings
from flarespan.functions import encoding as enc
from flarespan.jobs.queries import QUERIES
from flarespan.jobs.sql import SQL
from flarespan.operators import confidence, embedding, estimation, evaluation, graph, slots
from flarespan.sources import transactions

SF = "/root/testdata/sf0.001"


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        text = out[c].dtype == object or str(out[c].dtype).startswith("datetime")
        out[c] = out[c].astype(str) if text else out[c].astype(float)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["c4_slot_stats", "c5_lifetimes", "c6_assign_lifetime", "b1_b4_scalar_encoding", "e1_stratified_sample", "e3_signed_knn_edges", "f2_confidence", "f3_high_confidence", "g9_adjust_scores", "h7_evaluate", "b9_scale_views", "d5_fuse", "d6_final_features", "e6_query_edges", "e13_path_metrics", "e14_strong_components"])
def test_query_equals_sql(spark, duck, name):
    a, b = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.sql(SQL[name]).df())
    assert a.equals(b)


def at(h, m, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, at(0, 5), 100.0, 0), (2, at(0, 10), 100.0, 1), (3, at(2, 40), 50.0, 1), (4, at(3, 5), 50.0, 1), (5, at(5, 55), 10.0, 0)]
    return spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, amount double, label int")


def test_lifetimes_by_hand(spark, small):
    s = slots.stats_of(small, 1.2, 4.0)
    assert s.count() == 12
    assert [(r.start, r.end) for r in slots.lifetimes(s).collect()] == [(at(2, 30), at(3, 30))]
    assert [round(x, 6) for x in slots.active_averages(s).first()] == [4.8, 4.8]
    times = spark.createDataFrame([(1, at(2, 30)), (2, at(3, 29, 59)), (3, at(3, 30)), (4, at(2, 0))], "row_id long, ts timestamp_ntz")
    got = {r.row_id: r.lifetime_id for r in slots.assign_lifetime(times, slots.lifetimes(s)).collect()}
    assert got == {1: 0, 2: 0, 3: -1, 4: -1}
    scores = slots.adjust_scores(times.withColumn("score", F.lit(1.0)), slots.lifetimes(s)).collect()
    assert {r.row_id: round(r.adjusted, 6) for r in scores} == {1: 1.0, 2: 1.0, 3: 1.0, 4: round(math.exp(-3), 6)}


def test_empty_table(spark, small):
    none = small.where("false")
    s = slots.stats_of(none, 1.2, 4.0)
    assert s.count() == 0 and slots.lifetimes(s).count() == 0
    assert slots.assign_lifetime(small, slots.lifetimes(s)).where("lifetime_id >= 0").count() == 0
    assert slots.adjust_scores(small.withColumn("score", F.lit(0.5)), slots.lifetimes(s)).where("adjusted <> 0.5").count() == 0


def test_ranking_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.1)], "row_id long, label int, score double")
    assert round(evaluation.average_precision(df).first()[0], 6) == 0.833333
    assert evaluation.roc_auc(df).first()[0] == 0.875
    assert [r.row_id for r in evaluation.top_percent(df, 50).where("flagged = 1").orderBy("row_id").collect()] == [1, 2]
    assert evaluation.roc_auc(df.where("label = 1")).first()[0] is None


def test_small_rules(spark):
    assert graph.quotas({0: 95, 1: 5}, 20) == {0: 15, 1: 5}
    cases = spark.createDataFrame([(0.01, 99), (0.5, 5), (0.5, 7), (0.9, 1), (0.1, 0)], "r double, m long")
    assert [x[0] for x in cases.select(graph.k_from_ratio(F.col("r"), F.col("m"))).collect()] == [2, 2, 4, 1, 0]
    sim = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0), (3, 0, 0.0)], "row_id long, lifetime_id int, similarity double")
    for mode, want in (("paper", [0.207519, 1.0, 512.0]), ("log1p", [0.138647, 0.569323, 1.0])):
        got = [r.confidence for r in confidence.confidence(sim, mode).orderBy("row_id").collect()]
        assert np.allclose(got, want, atol=1e-1 if mode == "paper" else 1e-6)
    with pytest.raises(ValueError):
        Settings(rho=-1)


def test_scale_views(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "row_id long, v array<double>")
    assert [r.v for r in enc.scale_views(df, ["v"]).orderBy("row_id").collect()] == [[0.0, 0.0], [1.0, 0.0]]


def test_split_needs_both_sides(small):
    with pytest.raises(ValueError):
        transactions.temporal_split(small, "2030-01-01")


def test_net_gradient_and_loss():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4)), np.arange(30) % 3 % 2
    d = embedding.distances(x, x, 3.0)
    np.fill_diagonal(d, np.inf)
    a = embedding.weights_matrix(d.shape, embedding.signed_edges(d, y, y, 0.2, 0.1)).astype(float)
    w = embedding.start(4, 5, 4, 1)
    _, g = embedding.loss_and_gradient(w, x, a, y)
    for k in w:
        flat = w[k].reshape(-1)
        for i in (0, len(flat) - 1):
            keep, ends = flat[i], []
            for step in (1e-6, -1e-6):
                flat[i] = keep + step
                ends.append(embedding.loss_and_gradient(w, x, a, y)[0])
            flat[i] = keep
            assert abs((ends[0] - ends[1]) / 2e-6 - g[k].reshape(-1)[i]) < 1e-6
    losses = embedding.trained(x, a, y)[1]
    assert losses[-1] < losses[0]


def enrich_input(spark, flip):
    rows = []
    for i in range(120):
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), 1.0 + i % 5, int(i % 17 < 3), [float(i % 7), float(i % 4) + (i == flip)]))
    return spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, amount double, label int, v array<double>")


def test_out_of_fold_rows_do_not_reach_their_own_model(spark):
    def run(flip):
        return {r.row_id: (r.fold, r.fused) for r in embedding.oof_enrich(enrich_input(spark, flip), "v", size=1000, folds=3, frequency=1.2, epochs=5).collect()}

    a, b = run(-1), run(60)
    assert len(a) == 120 and any(any(v) for _, v in a.values())
    fold = a[60][0]
    assert all(np.allclose(a[i][1], b[i][1]) for i in a if a[i][0] == fold and i != 60)
    assert any(not np.allclose(a[i][1], b[i][1]) for i in a if a[i][0] != fold)


def test_one_class_gives_a_constant(spark):
    one = spark.createDataFrame([(1, [1.0], 1, 1.0)], "row_id long, features array<double>, target int, weight double")
    assert estimation.fit_detector(one) == 1.0
    assert estimation.fraud_scores(one, 1.0).first().score == 1.0
    none = embedding.oof_enrich(enrich_input(spark, -1).where("label = 0"), "v", folds=3).collect()
    assert none and not any(any(r.fused) for r in none)
