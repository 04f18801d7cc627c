"""Time slots, active slots and active lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most so many rows; a larger one is joined by shuffling.
MOST_BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast what is small enough, by counting."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def step(minutes: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def with_slot(t: DataFrame, time: str = "ts", minutes: int = 30) -> DataFrame:
    """``slot``, the start of the slot."""
    return t.withColumn("slot", F.window(time, f"{minutes} minutes")["start"])


def slot_totals(t: DataFrame, amount: str = "amount", label: str = "label") -> DataFrame:
    """Sums and counts of each slot; needs ``slot``."""
    y = F.col(label)
    return t.groupBy("slot").agg(F.sum(amount).alias("amount"), F.sum(F.col(amount) * y).alias("fraud_amount"), F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("frauds"))


def slot_grid(totals: DataFrame, minutes: int = 30) -> DataFrame:
    """Every slot from first to last, zeros where there is none."""
    grid = totals.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", step(minutes))).alias("slot"))
    return grid.join(totals, "slot", "left").na.fill(0)


def slot_stats(grid: DataFrame, intensity: float = 1.2, frequency: float = 4.0) -> DataFrame:
    """C4: shares of fraud, relative to their mean over all slots, and ``active``."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = grid.withColumns({"intensity": share("fraud_amount", "amount"), "frequency": share("frauds", "n")})
    mean = s.agg(F.avg("intensity").alias("mi"), F.avg("frequency").alias("mf"))
    s = s.crossJoin(F.broadcast(mean)).withColumns({"rel_intensity": share("intensity", "mi"), "rel_frequency": share("frequency", "mf")})  # one row
    return s.drop("mi", "mf").withColumn("active", (F.col("rel_intensity") > intensity) & (F.col("rel_frequency") > frequency))


def stats_of(t: DataFrame, intensity: float, frequency: float, minutes: int = 30, time: str = "ts", amount: str = "amount", label: str = "label") -> DataFrame:
    return slot_stats(slot_grid(slot_totals(with_slot(t, time, minutes), amount, label), minutes), intensity, frequency)


def lifetimes(stats: DataFrame, minutes: int = 30) -> DataFrame:
    """Runs of active slots as (lifetime_id, start, end), half open.  Its windows see slots, not transactions."""
    order = Window.orderBy("slot")
    s = stats.where("active").select("slot", F.coalesce(F.col("slot") != F.lag("slot").over(order) + step(minutes), F.lit(True)).cast("int").alias("new"))
    runs = s.withColumn("run", F.sum("new").over(order)).groupBy("run").agg(F.min("slot").alias("start"), (F.max("slot") + step(minutes)).alias("end"))
    return runs.select((F.row_number().over(Window.orderBy("start")) - 1).cast("long").alias("lifetime_id"), "start", "end")


def lifetime_slots(found: DataFrame, minutes: int = 30) -> DataFrame:
    return found.select("lifetime_id", F.explode(F.sequence("start", F.col("end") - step(minutes), step(minutes))).alias("slot"))


def assign_lifetime(t: DataFrame, found: DataFrame, time: str = "ts", minutes: int = 30) -> DataFrame:
    """``lifetime_id`` of the interval that holds the time, else -1.  Intervals lie on the slot grid, so slots are joined."""
    keyed = with_slot(t, time, minutes)
    return keyed.join(bounded(lifetime_slots(found, minutes)), "slot", "left").withColumn("lifetime_id", F.coalesce("lifetime_id", F.lit(-1).cast("long"))).drop("slot")


def active_averages(stats: DataFrame) -> DataFrame:
    """Mean relative intensity and frequency over active slots, 0 without any."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("active"), F.col(c))), F.lit(0.0))
    return stats.agg(mean("rel_intensity").alias("avg_intensity"), mean("rel_frequency").alias("avg_frequency"))


def quantile_thresholds(stats: DataFrame, q: float) -> DataFrame:
    """Quantiles of the relative values over all slots, linear between neighbours."""
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    return stats.agg(F.percentile("rel_intensity", q).alias("intensity"), F.percentile("rel_frequency", q).alias("frequency"))


def slot_features(t: DataFrame, numeric: list[str], categorical: dict[str, tuple[str, ...]], time: str = "ts", minutes: int = 30) -> DataFrame:
    """Means, codes of modes (ties: smallest value), counts, hour and weekday of every slot."""
    from flarespan.functions.encoding import clean_numeric

    code = lambda c, vocab: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, vocab)), F.mode(c, True)), F.lit(0)) - 1, F.lit(-1)).cast("int")
    each = with_slot(t, time, minutes).groupBy("slot").agg(
        *[F.avg(clean_numeric(F.col(c))).alias(f"mean_{c}") for c in numeric], *[code(c, v).alias(f"code_{c}") for c, v in categorical.items()], F.count(F.lit(1)).alias("n")
    )
    grid = each.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", step(minutes))).alias("slot"))
    full = grid.join(each, "slot", "left").na.fill(-1, [f"code_{c}" for c in categorical]).na.fill(0)
    return full.withColumns({"slot_hour": F.hour("slot"), "slot_weekday": F.weekday("slot")})


def nearest_lifetimes(t: DataFrame, found: DataFrame, time: str = "ts", minutes: int = 30) -> DataFrame:
    """``prev_end`` (last end <= time) and ``next_start`` (first start > time).

    Both are constant within a slot: they are found on the grid of slots by windows and joined by slot.
    """
    keyed = with_slot(t, time, minutes)
    slots = keyed.select("slot").distinct()
    marks = slots.withColumns({"end": F.lit(None).cast("timestamp_ntz"), "start": F.lit(None).cast("timestamp_ntz")})
    ends = found.select(F.col("end").alias("slot"), F.col("end"), F.lit(None).cast("timestamp_ntz").alias("start"))
    starts = found.select(F.col("start").alias("slot"), F.lit(None).cast("timestamp_ntz").alias("end"), F.col("start"))
    line = marks.unionByName(ends).unionByName(starts).groupBy("slot").agg(F.max("end").alias("end"), F.max("start").alias("start"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    near = line.select("slot", F.max("end").over(before).alias("prev_end"), F.min("start").over(after).alias("next_start"))
    return keyed.join(bounded(near), "slot", "left").drop("slot")


def adjust_scores(t: DataFrame, found: DataFrame, score: str = "score", rho: float = 0.1, unit_minutes: float = 1.0, time: str = "ts", minutes: int = 30) -> DataFrame:
    """``adjusted``: unchanged inside lifetimes, else times the mean decay to the neighbours there are."""
    if not rho >= 0 or unit_minutes <= 0:
        raise ValueError("rho must not be negative and the unit must be positive")
    from flarespan.functions.encoding import micros

    near = nearest_lifetimes(assign_lifetime(t, found, time, minutes), found, time, minutes)
    away = lambda a, b: F.exp(-rho * ((micros(F.col(a)) - micros(F.col(b))) / (unit_minutes * 60e6)))
    left, right = away(time, "prev_end"), away("next_start", time)
    factor = F.coalesce((left + right) / 2, left, right, F.lit(1.0))
    return near.withColumn("adjusted", F.when(F.col("lifetime_id") >= 0, F.col(score)).otherwise(F.col(score) * factor))
