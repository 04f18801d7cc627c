"""One query for each operator over the given tables, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flarespan.config import EVENT_ROLES as ROLES
from flarespan.config import Settings
from flarespan.functions import encoding as enc
from flarespan.jobs import model as job
from flarespan.operators import confidence as conf
from flarespan.operators import estimation as est
from flarespan.operators import evaluation as ev
from flarespan.operators import embedding as emb
from flarespan.operators import graph, paths, slots
from flarespan.operators import importance as importance_op
from flarespan.sources import transactions as src
from flarespan.sources.lineage import checkpointed

I, FR = 1.2, 1.5
SPLIT = "2024-01-24"


def tx(spark, d) -> DataFrame:
    return src.event_transactions(spark, d)


def events(spark, d) -> DataFrame:
    """The few columns that slots and rankings need, straight from the scan."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("row_id"), "ts", F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("label"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def stats(spark, d, frequency=FR):
    return slots.stats_of(events(spark, d), I, frequency)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def near(df: DataFrame, *cols: str) -> DataFrame:
    """Four places, shifted off the halves on which means of cents often fall."""
    return df.withColumns({c: F.round(F.col(c) + 0.0000123, 4) for c in cols})


def inside(spark, d) -> DataFrame:
    """Events with their lifetime and two small views: (amount, k) and (amount, k of the hour), scaled."""
    t = slots.assign_lifetime(events(spark, d), slots.lifetimes(stats(spark, d)))
    a, k = F.col("amount") / 100, F.col("k") / 99
    return checkpointed(t.withColumns({"va": F.array(a, k), "vb": F.array(a, F.hour("ts") / 24)}))  # used several times in a query


def sure(rows):
    return conf.confidence(conf.similarity_to_frauds(rows, ["va", "vb"]))


def high(rows):
    return conf.high_confidence(sure(rows), rows, 1)


def rest(rows):
    return conf.remaining(rows, high(rows))


def raw_possibility(rows):
    return conf.possibility_raw(rows, rest(rows), ["va", "vb"])


def scored(spark, d):
    return events(spark, d).withColumn("score", F.round((F.col("k") + F.col("label") * 20) / 120, 6))


def vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def reference(spark, d):
    """A fifth of the rows."""
    rows = vectors(spark, d)
    return graph.stratified_sample(rows, "label", max(2, rows.count() // 5))


def edges(spark, d):
    return graph.signed_knn_edges(reference(spark, d), 0.05, 0.03, 2.0)


def numbers(spark, d):
    """B1 - B4 side by side."""
    t = tx(spark, d)
    out = {"b1": enc.clean_numeric(F.when(F.col("k") == 0, float("inf")).otherwise(F.col("k"))), "b2": enc.signed_log1p(F.col("amount") - 20), "b3_time": enc.time_of_day(F.col("ts")), "b3_day": F.weekday("ts"), "b4": enc.age_days(F.col("ts"), F.col("created"))}
    return r6(t.select("row_id", *[c.alias(k) for k, c in out.items()]), "b1", "b2", "b3_time", "b4")


def one_hots(spark, d):
    v = enc.one_hot(F.col("segment"), ROLES.levels["customer"].categorical["segment"])
    return tx(spark, d).select("row_id", F.concat_ws(",", F.transform(v, lambda x: x.cast("int").cast("string"))).alias("hot"))


def encoded_sums(spark, d):
    """Sum of each place of the encoded vectors."""
    t = tx(spark, d)
    e = enc.encode(t, enc.fit_encoder(t, ROLES))
    return e.select(F.posexplode("v_original").alias("place", "x")).groupBy("place").agg(F.round(F.sum("x"), 4).alias("total"))


def feature_slots(spark, d):
    t = tx(spark, d)
    cats = {"k_band": ("low", "mid", "high"), "last_status": ("F", "O", "P")}
    return near(slots.slot_features(t, ["amount", "k", "gap_sec"], cats), "mean_amount", "mean_k", "mean_gap_sec")


def split_counts(spark, d):
    a, b = src.temporal_split(events(spark, d), SPLIT)
    return a.agg(F.lit("train").alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount")).unionByName(b.agg(F.lit("test").alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount")))


def summary(spark, d):
    t = slots.assign_lifetime(events(spark, d), slots.lifetimes(stats(spark, d)))
    return t.where("lifetime_id >= 0").groupBy("lifetime_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("amount") * F.col("label")), 4).alias("fraud_amount"))


def importance(spark, d):
    """A stand-in importance: the deviation of each raw column."""
    t = tx(spark, d)
    cols = ("amount", "k", "cnt_1h", "n_orders", "acctbal")
    return t.agg(*[F.stddev_pop(enc.signed_log1p(F.col(c))).alias(c) for c in cols]).unpivot([], list(cols), "feature", "phi")


def run_summary(spark, d):
    """Counts of a run in one row."""
    s, rows = stats(spark, d), inside(spark, d)
    one = s.agg(F.count_if("active").alias("active_slots"), F.count(F.lit(1)).alias("slots"))
    two = rows.where("lifetime_id >= 0").agg(F.count_distinct("lifetime_id").alias("lifetimes"), F.count(F.lit(1)).alias("inside"), F.sum("label").alias("frauds"))
    return one.crossJoin(two)  # two rows of one


def views(spark, d) -> DataFrame:
    """Two blocks of raw numbers of each event."""
    return tx(spark, d).select("row_id", F.array("amount", "k", "cnt_1h").alias("va"), F.array(F.coalesce("n_orders", F.lit(0.0)), F.coalesce("acctbal", F.lit(0.0)), F.lit(1.0)).alias("vb"))


def places(df: DataFrame, vector: str) -> DataFrame:
    return df.select("row_id", F.posexplode(vector).alias("place", "v")).withColumn("v", F.round("v", 6))


def unseen(spark, d) -> DataFrame:
    """The vectors that are not in the reference."""
    return vectors(spark, d).join(reference(spark, d).select("row_id"), "row_id", "left_anti")


def embedded(spark, d) -> DataFrame:
    ref = checkpointed(reference(spark, d))
    fitted = emb.fit_embeddings(ref.select(F.lit(0).alias("fold"), F.lit("x").alias("level"), "row_id", "label", "x"), 0.05, 0.03)
    return emb.embed(unseen(spark, d), emb.weights_of(fitted, 0, "x"), ref, 0.05, 0.03)


def encoded(spark, d) -> DataFrame:
    t = tx(spark, d)
    return enc.encode(t, enc.fit_encoder(t, ROLES))


def enriched(spark, d) -> DataFrame:
    rows = checkpointed(encoded(spark, d).select("row_id", "ts", "amount", "label", "v_transaction"))
    return emb.oof_enrich(rows, "v_transaction", frequency=FR).select("row_id", "fold", F.round(F.sqrt(enc.dot(F.col("fused"), F.col("fused"))), 6).alias("length"))


def soft_rows(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first weeks with soft labels (features, target, weight), the last one, and the lifetimes of the first."""
    rows = checkpointed(encoded(spark, d).select("row_id", "ts", "amount", "label", F.col("v_original").alias("features")))
    train, test = src.temporal_split(rows, SPLIT)
    found = checkpointed(slots.lifetimes(slots.stats_of(train, I, FR)))
    there = checkpointed(enc.scale_views(slots.assign_lifetime(train, found), ["features"]).where("lifetime_id >= 0"))
    sure_rows = conf.high_confidence(conf.confidence(conf.similarity_to_frauds(there, ["features"])), there, 1)
    possible = conf.fraud_possibility(conf.possibility_raw(there, conf.remaining(there, checkpointed(sure_rows)), ["features"]))
    soft = conf.weighted_training_set(train, checkpointed(possible.select("row_id", "p")))
    return checkpointed(soft.join(train.select("row_id", "features"), "row_id")), test, found


def detected(spark, d, estimator=None) -> DataFrame:
    """A detector of the first weeks, with soft labels, scores the last one."""
    train, test, _ = soft_rows(spark, d)
    s = est.fraud_scores(test, est.fit_detector(train, estimator))
    out = est.predictions(slots.adjust_scores(s, slots.lifetimes(stats(spark, d))))
    return r6(out.select("row_id", "p_normal", "p_fraud"), "p_normal", "p_fraud")


def neighbour_counts(spark, d) -> DataFrame:
    """Neighbours of the own class and of the others, for each class of the vectors and each candidate ratio."""
    sizes = vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("c").alias("n"))))  # one row
    each = sizes.withColumn("ratio", F.explode(F.array(*map(F.lit, emb.RATIOS))))
    return each.select("label", "ratio", graph.k_from_ratio(F.col("ratio"), F.col("c") - 1).alias("k_pos"), graph.k_from_ratio(F.col("ratio"), F.col("n") - F.col("c")).alias("k_neg"))


def slot_rows(spark, d) -> DataFrame:
    """Standardised slot features with whether the slot is active."""
    f = feature_slots(spark, d)
    names = [c for c in f.columns if c != "slot"]
    z = est.standardize_slots(f, names).select("slot", F.array(*[F.col(c).cast("double") for c in names]).alias("features"))
    return checkpointed(z.join(stats(spark, d).select("slot", F.col("active").cast("int").alias("target")), "slot"))


def estimated(spark, d) -> DataFrame:
    rows = slot_rows(spark, d)
    return slots.lifetimes(est.estimated_active(rows, est.fit_slot_ensemble(rows)))


#: Settings of the whole job for the event table: short training, ratios given for two levels and searched for one.
JOB = {"out": 8, "epochs": 20, "share": 0.05, "sample": 60, "grid": (0.05, 0.1, 0.2), "ratios": {"transaction": (0.05, 0.03), "customer": (0.05, 0.03)}, "trees": {"depth": 3, "trees": 8}}


def fitted(spark, d):
    train, test = src.temporal_split(tx(spark, d).where("created IS NOT NULL"), SPLIT)
    return job.fit(train, ROLES, Settings(frequency=FR, folds=2), estimator=None, **JOB), test


def job_predictions(spark, d) -> DataFrame:
    """Fit on the first weeks, soft labels in the detector, score the last one."""
    model, test = fitted(spark, d)
    return r6(job.predict(model, test).select("row_id", "lifetime_id", "score", "adjusted"), "score", "adjusted")


def job_update(spark, d) -> DataFrame:
    """The counts of a refit on the last two weeks with thresholds from quantiles, as rows of a name and a value."""
    first = job.Fitted(ROLES, Settings(frequency=FR, folds=2), {**JOB, "ratios": {v: (0.05, 0.03) for v in ROLES.levels}}, None, {}, None, None, [], {})
    summary = job.update(first, tx(spark, d).where("created IS NOT NULL"), 14, 0.9).summary
    return spark.createDataFrame(sorted((k, round(float(v), 6)) for k, v in summary.items()), "name string, value double")


def importance_inside(spark, d) -> DataFrame:
    """Mean absolute Shapley values over the rows inside lifetimes, of 100 trees of depth 7."""
    rows = checkpointed(encoded(spark, d).select("row_id", "ts", "label", F.col("v_original").alias("features")))
    there = slots.assign_lifetime(rows, slots.lifetimes(stats(spark, d))).where("lifetime_id >= 0")
    return r6(importance_op.mean_abs_shap(rows, there, rows.select(F.size("features").alias("n")).first().n), "phi")


QUERIES = {
    "lifetime_summary": summary,
    "a1_read_transactions": lambda s, d: r6(src.event_transactions(s, d).select("row_id", "user_id", "amount", "label", "k", "gap_sec", "cnt_1h", "sum_1h", "k_band", "n_orders", "avg_total", "last_status", "segment", "region"), "gap_sec", "sum_1h", "avg_total"),
    "a3_contract_violations": lambda s, d: src.contract_violations(tx(s, d), ROLES),
    "a4_temporal_split": split_counts,
    "a5_recent_window": lambda s, d: src.recent_window(events(s, d), 7).select("row_id", "amount"),
    "b1_b4_scalar_encoding": numbers,
    "b5_one_hot": one_hots,
    "b6_fit_encoder": lambda s, d: r6(enc.fit_stats(tx(s, d), ROLES), "median", "least", "most"),
    "b7_b8_encode": encoded_sums,
    "b9_scale_views": lambda s, d: places(enc.scale_views(views(s, d), ["va", "vb"]).withColumn("v", F.concat("va", "vb")), "v"),
    "c1_with_slot": lambda s, d: slots.with_slot(events(s, d)).select("row_id", "slot"),
    "c2_slot_totals": lambda s, d: r6(slots.slot_totals(slots.with_slot(events(s, d))), "amount", "fraud_amount"),
    "c3_slot_grid": lambda s, d: r6(slots.slot_grid(slots.slot_totals(slots.with_slot(events(s, d)))), "amount", "fraud_amount"),
    "c4_slot_stats": lambda s, d: r6(stats(s, d).select("slot", "intensity", "frequency", "rel_intensity", "rel_frequency", "active"), "intensity", "frequency", "rel_intensity", "rel_frequency"),
    "c5_lifetimes": lambda s, d: slots.lifetimes(stats(s, d)),
    "c5_lifetimes_default": lambda s, d: slots.lifetimes(stats(s, d, 4.0)),
    "c6_assign_lifetime": lambda s, d: slots.assign_lifetime(events(s, d), slots.lifetimes(stats(s, d))).select("row_id", "lifetime_id"),
    "c7_active_averages": lambda s, d: r6(slots.active_averages(stats(s, d)), "avg_intensity", "avg_frequency"),
    "c8_quantile_thresholds": lambda s, d: r6(slots.quantile_thresholds(stats(s, d), 0.9), "intensity", "frequency"),
    "c9_slot_features": feature_slots,
    "d2_minmax_importance": lambda s, d: r6(graph.minmax_importance(importance(s, d)), "phi"),
    "d3_level_weights": lambda s, d: r6(graph.level_weights(graph.minmax_importance(importance(s, d)), slots.active_averages(stats(s, d))), "weight"),
    "d4_project": lambda s, d: vectors(s, d).select("row_id", F.posexplode(graph.project(F.col("x"), 24)).alias("place", "v")).withColumn("v", F.round("v", 6)),
    "d5_fuse": lambda s, d: places(views(s, d).select("row_id", graph.fuse(F.col("va"), F.col("vb")).alias("v")), "v"),
    "d6_final_features": lambda s, d: places(views(s, d).select("row_id", F.concat("va", "vb", graph.fuse(F.col("va"), F.col("vb"))).alias("v")), "v"),
    "e1_stratified_sample": lambda s, d: reference(s, d).select("row_id", "label"),
    "e2_k_from_ratio": neighbour_counts,
    "e3_signed_knn_edges": lambda s, d: r6(edges(s, d), "distance"),
    "e4_edge_weights": lambda s, d: r6(graph.signed_knn_edges(reference(s, d), 0.05, 0.03, 2.0, weighted=True).select("src", "dst", "weight"), "weight"),
    "e5_vote_label": lambda s, d: graph.vote_nearest(reference(s, d), 0.05, 0.03, 3, 2.0),
    "d1_shap_importance": importance_inside,
    "e5_vote_unseen": lambda s, d: emb.vote_unseen(unseen(s, d), reference(s, d), 0.05, 2.0),
    "g11_fit_predict": job_predictions,
    "g11_g12_update_summary": job_update,
    "e6_query_edges": lambda s, d: r6(emb.query_edges(unseen(s, d), reference(s, d), 0.05, 0.03, 2.0), "distance"),
    "e7_signed_neighbor_mean": lambda s, d: r6(graph.signed_knn_means(reference(s, d), 0.05, 0.03, 2.0), "mean").withColumnRenamed("at", "place"),
    "e8_e9_embed": lambda s, d: embedded(s, d).select("row_id", F.size("embedding").alias("width"), F.round(F.sqrt(enc.dot(F.col("embedding"), F.col("embedding"))), 6).alias("length")),
    "e10_fold_assign": lambda s, d: graph.fold_assign(events(s, d), "label").select("row_id", "fold"),
    "e11_oof_enrich": enriched,
    "e12_edge_reciprocity": lambda s, d: r6(graph.signed_knn_reciprocity(reference(s, d), 0.05, 0.03, 2.0), "reciprocity"),
    "e13_path_metrics": lambda s, d: r6(paths.path_metrics(edges(s, d)), "mean_path"),
    "e14_strong_components": lambda s, d: paths.strong_components(edges(s, d), reference(s, d)),
    "e15_select_k_ratios": lambda s, d: r6(emb.select_k_ratios(graph.stratified_sample(vectors(s, d), "label", 500)), "mean_path", "reciprocity", "score"),
    "f1_similarity": lambda s, d: r6(conf.similarity_to_frauds(inside(s, d), ["va", "vb"]), "similarity"),
    "f2_confidence": lambda s, d: r6(sure(inside(s, d)).drop("similarity"), "confidence"),
    "f3_high_confidence": lambda s, d: high(inside(s, d)).select("row_id", "lifetime_id"),
    "f4_remaining": lambda s, d: rest(inside(s, d)).select("row_id", "lifetime_id"),
    "f5_temporal_weight": lambda s, d: events(s, d).select("row_id", F.round(conf.temporal_weight(F.col("k") - 50), 9).alias("weight")),
    "f6_windowed_fraud_means": lambda s, d: near(conf.windowed_fraud_means(inside(s, d).where("lifetime_id >= 0 AND label = 1"), "va").select("j", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1")), "w0", "w1"),
    "f7_possibility_raw": lambda s, d: r6(raw_possibility(inside(s, d)), "fps"),
    "f8_temporal_correlation": lambda s, d: r6(conf.temporal_correlation(inside(s, d), ["va", "vb"]).select("i", "j", "view", "m"), "m"),
    "f9_fraud_possibility": lambda s, d: r6(conf.fraud_possibility(raw_possibility(inside(s, d))).select("row_id", "p"), "p"),
    "f10_weighted_training_set": lambda s, d: r6(conf.weighted_training_set(events(s, d), conf.fraud_possibility(raw_possibility(inside(s, d)))), "weight"),
    "g1_g2_g10_detect": detected,
    "g1_kernel_machine": lambda s, d: detected(s, d, "svm"),
    "g3_standardize_slots": lambda s, d: r6(est.standardize_slots(stats(s, d).select("slot", "intensity", "frequency"), ["intensity", "frequency"]), "intensity", "frequency"),
    "g4_stratified_bootstrap": lambda s, d: est.stratified_bootstrap(stats(s, d).select("slot", "active"), "active", "slot", 1),
    "g5_g6_estimate_lifetimes": estimated,
    "g7_holdout": lambda s, d: r6(est.holdout_evaluation(slot_rows(s, d)), "macro_f1", "roc_auc"),
    "g8_nearest_lifetimes": lambda s, d: slots.nearest_lifetimes(events(s, d), slots.lifetimes(stats(s, d))).select("row_id", "prev_end", "next_start"),
    "g9_adjust_scores": lambda s, d: slots.adjust_scores(scored(s, d), slots.lifetimes(stats(s, d))).select("row_id", F.round("adjusted", 6).alias("adjusted")),
    "g12_run_summary": run_summary,
    "h1_average_precision": lambda s, d: r6(ev.average_precision(scored(s, d)), "average_precision"),
    "h2_roc_auc": lambda s, d: r6(ev.roc_auc(scored(s, d)), "roc_auc"),
    "h3_top_percent": lambda s, d: ev.top_percent(scored(s, d), 5).select("row_id", "flagged"),
    "h4_h6_confusion": lambda s, d: r6(ev.with_rates(ev.confusion_counts(ev.top_percent(scored(s, d), 5))), "macro_f1", "fpr"),
    "h7_evaluate": lambda s, d: r6(ev.evaluate(scored(s, d)), "average_precision", "macro_f1", "fpr"),
}
