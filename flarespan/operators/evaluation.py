"""Ranking quality of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flarespan.sources.lineage import checkpointed

def cumulative(df: DataFrame, y: str = "label", s: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores, best first, with their own and cumulative rows (n, pos, up_n, up_pos) and totals.

    Scores are dealt by range, with borders from a sample of them, so parts are about equal whatever
    the distribution; sums run inside a part, and over the parts' totals.
    """
    each = df.groupBy(F.col(s).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("pos"))
    each = checkpointed(each)  # dealing by range reads it twice
    each = checkpointed(each.repartitionByRange(F.desc("s"), *keys).withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.groupBy("slice").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp"))
    whole = Window.partitionBy()
    totals = totals.select(
        "slice", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.sum("sn").over(whole).alias("all_n"), F.sum("sp").over(whole).alias("all_pos")
    )
    run = Window.partitionBy("slice").orderBy(F.desc("s"), *keys).rowsBetween(Window.unboundedPreceding, 0)
    out = each.join(F.broadcast(totals), "slice")  # a row for each part
    return out.select("s", *keys, "n", "pos", (F.col("bn") + F.sum("n").over(run)).alias("up_n"), (F.col("bp") + F.sum("pos").over(run)).alias("up_pos"), "all_n", "all_pos")


def average_precision(df: DataFrame, y: str = "label", s: str = "score") -> DataFrame:
    """H1: sum of the steps of recall times precision, over distinct scores."""
    return cumulative(df, y, s).agg(F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("up_pos") / F.col("up_n")).alias("average_precision"))


def roc_auc(df: DataFrame, y: str = "label", s: str = "score") -> DataFrame:
    """H2: the chance that a fraud scores above a normal row, ties half; null with one class only."""
    neg, up_neg, all_neg = F.col("n") - F.col("pos"), F.col("up_n") - F.col("up_pos"), F.col("all_n") - F.col("all_pos")
    c = cumulative(df, y, s).select((F.col("pos") * (all_neg - up_neg) + 0.5 * F.col("pos") * neg).alias("won"), "all_pos", all_neg.alias("all_neg"))
    return c.agg(F.try_divide(F.sum("won"), F.max(F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"))


def ranked(df: DataFrame, s: str = "score") -> DataFrame:
    """The rows with ``rank`` by score, ties by row_id, and ``all_n``.

    Rows are range-partitioned by both, so equal scores need not share a task, and ranked inside
    their part; the totals of the parts before are added.
    """
    parts = checkpointed(df.repartitionByRange(F.desc(s), "row_id").withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("all_n"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(s), "row_id"))
    return parts.join(F.broadcast(totals), "_part").withColumn("rank", rank).drop("_part", "_before")  # one row for each part


def in_top(percent: float) -> Column:
    return (F.col("rank") <= F.ceil(F.col("all_n") * percent / 100)).cast("int")


def top_percent(df: DataFrame, percent: float, s: str = "score") -> DataFrame:
    """H3: ``flagged`` 1 for the first ceil(n * percent / 100) rows by score, ties by row_id."""
    return ranked(df, s).withColumn("flagged", in_top(percent)).drop("rank", "all_n")


def confusion_counts(df: DataFrame, y: str = "label", pred: str = "flagged") -> DataFrame:
    """H4."""
    both = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.agg(both(0, 0).alias("tn"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(1, 1).alias("tp"))


def with_rates(counts: DataFrame) -> DataFrame:
    """H5, H6: macro_f1 over the classes there are (0/0 is 0) and fpr (null without negatives)."""
    f1 = lambda hit: F.coalesce(F.try_divide(2 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    there = lambda hit: ((F.col(hit) + F.col("fp") + F.col("fn")) > 0).cast("int")
    macro = F.coalesce(F.try_divide(f1("tp") * there("tp") + f1("tn") * there("tn"), there("tp") + there("tn")), F.lit(0.0))
    return counts.withColumns({"macro_f1": macro, "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))})


def evaluate(df: DataFrame, percents: tuple[float, ...] = (1, 2, 5, 10), y: str = "label", s: str = "score") -> DataFrame:
    """H7: one row for each percentage: percent, average_precision, macro_f1, fpr.  Rows are ranked once and counted for all percentages in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percent"), in_top(p).alias("flagged")) for p in percents]))
    flags = ranked(df, s).select(F.col(y), each.alias("_f")).select(y, "_f.*")
    both = lambda a, b: F.count_if((F.col(y) == a) & (F.col("flagged") == b))
    counts = flags.groupBy("percent").agg(both(0, 0).alias("tn"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(1, 1).alias("tp"))
    return with_rates(counts).select("percent", "macro_f1", "fpr").crossJoin(F.broadcast(average_precision(df, y, s)))  # one row
