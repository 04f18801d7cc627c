"""Samples, folds, signed nearest-neighbour graphs and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flarespan.operators.neighbours import Meeting, edges_of


def hashed(key: str, seed: int) -> Column:
    """An order that depends on the key and the seed only, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))


def quotas(counts: dict, size: int) -> dict:
    """Rows of each class: its share rounded half to even, at least min(count, size // (2 classes)); the largest class takes the rest."""
    n = sum(counts.values())
    if n <= size:
        return dict(counts)
    out = {c: max(round(size * k / n), min(k, size // (2 * len(counts)))) for c, k in counts.items()}
    largest = max(sorted(counts), key=lambda c: counts[c])
    out[largest] += size - sum(out.values())
    return out


def stratified_sample(df: DataFrame, y: str, size: int, key: str = "row_id", seed: int = 0) -> DataFrame:
    """Exact class quotas in hash order, of any size.  Class counts come to the driver; ranks come from ``class_rank``, so no class is sorted in one task."""
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = quotas(counts, size)
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])[F.col(y)] if quota else F.lit(0)
    return class_rank(df, [y], key, seed).where(F.col("_rank") < limit).select(*df.columns)


def k_from_ratio(r: Column, m: Column) -> Column:
    """min(m, max(2, round half to even of r * m))."""
    return F.least(m, F.greatest(F.lit(2), F.bround(r * m).cast("long")))


def neighbours(r: float, m: int) -> int:
    """``k_from_ratio`` for one number."""
    return min(m, max(2, round(r * m)))


def class_counts(rows: DataFrame, y: str = "label") -> dict[int, int]:
    """Rows of each class; one for each class comes to the driver."""
    return {r.c: r.n for r in rows.groupBy(F.col(y).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}


def quota_of(counts: dict[int, int], r_pos: float, r_neg: float) -> dict[int, tuple[int, int]]:
    """Neighbours of the own class and of the others, for each class of the reference."""
    n = sum(counts.values())
    return {c: (neighbours(r_pos, max(m - 1, 0)), neighbours(r_neg, n - m)) for c, m in counts.items()}


def vectors_of(rows: DataFrame, key: str, c: Column, vector: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), c.cast("int").alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("x"))


def reference_meeting(ref: DataFrame, r_pos: float, r_neg: float, p: float = 3.0, key: str = "row_id", y: str = "label", vector: str = "x", cell_rows: int | None = None, most: int | None = None) -> Meeting:
    """The rows of a reference and their neighbours in it; ``most`` of each sign where it is given."""
    rows = vectors_of(ref, key, F.col(y), vector)
    ks = quota_of(class_counts(ref, y), r_pos, r_neg)
    return Meeting(rows, rows, ks if most is None else {c: (min(a, most), min(b, most)) for c, (a, b) in ks.items()}, p, itself=True, cell_rows=cell_rows)


def signed_knn_edges(ref: DataFrame, r_pos: float, r_neg: float, p: float = 3.0, key: str = "row_id", y: str = "label", vector: str = "x", cell_rows: int | None = None, weighted: bool = False) -> DataFrame:
    """(src, dst, sign, distance): nearest of the own class with +, of the others with -; ties by id.  A reference of any size.  ``weighted``: with E4's weight."""
    return edges_of(reference_meeting(ref, r_pos, r_neg, p, key, y, vector, cell_rows), weighted)


def signed_knn_means(ref: DataFrame, r_pos: float, r_neg: float, p: float = 3.0, key: str = "row_id", y: str = "label", vector: str = "x", cell_rows: int | None = None) -> DataFrame:
    """E7 of the graph of E3: (src, at, mean) by place, without a table of edges."""
    met = reference_meeting(ref, r_pos, r_neg, p, key, y, vector, cell_rows)
    if not met.pairs:
        return ref.sparkSession.createDataFrame([], "src bigint, at int, mean double")
    return met.sums().select(F.col("id").alias("src"), F.posexplode("m").alias("at", "mean"))


def signed_knn_reciprocity(ref: DataFrame, r_pos: float, r_neg: float, p: float = 3.0, key: str = "row_id", y: str = "label", vector: str = "x", cell_rows: int | None = None) -> DataFrame:
    """E12 of the graph of E3, without a table of edges: an edge's reverse is there if its distance is within that of the other end's last neighbour."""
    met = reference_meeting(ref, r_pos, r_neg, p, key, y, vector, cell_rows)
    sums = met.backs() if met.pairs else ref.sparkSession.createDataFrame([], "hits bigint, n bigint")
    return sums.agg(F.coalesce(F.try_divide(F.sum("hits"), F.sum("n")), F.lit(0.0)).alias("reciprocity"))


def vote_nearest(ref: DataFrame, r_pos: float, r_neg: float, k: int, p: float = 3.0, key: str = "row_id", y: str = "label", vector: str = "x", cell_rows: int | None = None) -> DataFrame:
    """E5 on the graph of E3: the k nearest ends of a row's edges are among the k nearest of each sign, so no more are looked for."""
    return vote_label(edges_of(reference_meeting(ref, r_pos, r_neg, p, key, y, vector, cell_rows, k)), ref, k, key, y)


def edge_weights(edges: DataFrame) -> DataFrame:
    """Sign / (1 + distance) / number of edges of the source."""
    degree = F.count(F.lit(1)).over(Window.partitionBy("src"))
    return edges.withColumn("weight", F.col("sign") / (1 + F.col("distance")) / degree)


def signed_neighbor_mean(edges: DataFrame, nodes: DataFrame, key: str = "row_id", vector: str = "x") -> DataFrame:
    """(src, at, mean): the weighted sum of the neighbours' vectors, by place."""
    x = nodes.select(F.col(key).alias("dst"), F.posexplode(vector).alias("at", "v"))
    return edges.join(x, "dst").groupBy("src", "at").agg(F.sum(F.col("weight") * F.col("v")).alias("mean"))


def vote_label(edges: DataFrame, ref: DataFrame, k: int, key: str = "row_id", y: str = "label") -> DataFrame:
    """E5: (src, vote) from (src, dst, distance): the majority class of the k nearest, smallest class on ties."""
    near = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("_r") <= k)
    votes = near.join(ref.select(F.col(key).alias("dst"), F.col(y).alias("c")), "dst").groupBy("src", "c").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("src").agg(F.max_by("c", F.struct("n", (-F.col("c")).alias("low"))).alias("vote"))


def class_rank(df: DataFrame, names: list[str], key: str, seed: int) -> DataFrame:
    """``_rank`` from 0 within the class in hash order: ranks inside slices of the order plus the slices' totals, so no class is sorted in one task."""
    rows = df.withColumn("_h", hashed(key, seed)).withColumn("_s", F.substring("_h", 1, 2))
    totals = rows.groupBy(*names, "_s").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "_s", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*names, "_s").orderBy("_h", key)) - 1 + F.col("_b")
    return rows.join(F.broadcast(totals), [*names, "_s"]).withColumn("_rank", rank).drop("_h", "_s", "_b")  # 256 rows for each class


def fold_assign(df: DataFrame, y: str, folds: int = 5, key: str = "row_id", seed: int = 0) -> DataFrame:
    """``fold`` by rank within the class in hash order; fewer folds where the smallest class is smaller, plain folds below two."""
    counts = [r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()]
    n = min(folds, *counts) if counts else folds
    names = [y] if n >= 2 else ["_all"]
    n = n if n >= 2 else max(1, min(folds, sum(counts)))
    out = class_rank(df.withColumn("_all", F.lit(0)), names, key, seed)
    return out.withColumn("fold", (F.col("_rank") % n).cast("int")).drop("_rank", "_all")


def edge_reciprocity(edges: DataFrame) -> DataFrame:
    """Share of directed edges whose reverse exists; 0 without edges."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("hit"))
    return e.join(back, ["src", "dst"], "left").agg(F.coalesce(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))), F.lit(0.0)).alias("reciprocity"))


def project(vector: Column, out_dim: int) -> Column:
    """Place i goes to group i mod out_dim; the mean of each group."""
    at = F.sequence(F.lit(0), F.lit(out_dim - 1))

    def mean(g):
        mine = F.filter(vector, lambda _, i: i % out_dim == g)
        return F.coalesce(F.try_divide(F.aggregate(mine, F.lit(0.0), lambda s, x: s + x), F.size(mine)), F.lit(0.0))

    return F.transform(at, mean)


def fuse(embedding: Column, projected: Column) -> Column:
    """Product by place."""
    return F.zip_with(embedding, projected, lambda a, b: a * b)


def minmax_importance(phi: DataFrame) -> DataFrame:
    """(feature, phi) to 0..1; zeros where all are equal."""
    ends = phi.agg(F.min("phi").alias("lo"), F.max("phi").alias("hi"))
    return phi.crossJoin(F.broadcast(ends)).select(*phi.drop("phi").columns, F.coalesce(F.try_divide(F.col("phi") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("phi"))  # one row


def level_weights(phi: DataFrame, averages: DataFrame, alpha: float = 0.3) -> DataFrame:
    """D3: weight = phi * (alpha * average intensity + (1 - alpha) * average frequency)."""
    both = phi.crossJoin(F.broadcast(averages))  # one row
    return both.select(*phi.drop("phi").columns, (F.col("phi") * (alpha * F.col("avg_intensity") + (1 - alpha) * F.col("avg_frequency"))).alias("weight"))
