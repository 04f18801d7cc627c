"""Column expressions and the min-max encoder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flarespan.config import Level, Roles
from flarespan.sources.lineage import checkpointed

UNKNOWN = "__unknown__"


def clean_numeric(c: Column) -> Column:
    """B1: double; infinities and NaN become null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def signed_log1p(x: Column) -> Column:
    """B2."""
    return F.signum(x) * F.log1p(F.abs(x))


def time_of_day(t: Column) -> Column:
    """Hours with minutes, without seconds."""
    return F.hour(t) + F.minute(t) / 60


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def age_days(time: Column, created: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((micros(time) - micros(created)) / F.lit(86_400_000_000)).cast("double")


def one_hot(c: Column, vocabulary: tuple[str, ...]) -> Column:
    """One place for each value in order, then one for all else and null."""
    hit = [F.when(c == v, 1.0).otherwise(0.0) for v in vocabulary]
    return F.array(*hit, F.when(F.coalesce(c.isin(*vocabulary), F.lit(False)), 0.0).otherwise(1.0))


def numeric_columns(name: str, level: Level, roles: Roles) -> dict[str, Column]:
    """Cleaned numeric columns of a level, logarithms of money, and the derived time columns."""
    out = {c: signed_log1p(clean_numeric(F.col(c))) if c in level.monetary else clean_numeric(F.col(c)) for c in level.numeric}
    if name == "transaction":
        out |= {"time_of_day": time_of_day(F.col(roles.time)), "weekday": F.weekday(roles.time).cast("double")}
    if name == "account" and roles.created:
        out["age_days"] = age_days(F.col(roles.time), F.col(roles.created))
    return out


@dataclass(frozen=True)
class Encoder:
    """Level -> column -> (median, least, most)."""

    roles: Roles
    stats: dict[str, dict[str, tuple[float, float, float]]]


#: Values that are ranked at once to find a median; of more, a sketch finds the few around it first.
MOST_RANKED = 100_000
#: Accuracy of that sketch, and how far from the middle its bounds are put for it.
ACCURACY, MARGIN = 1_000, 0.004


def medians(rows: DataFrame, names: list[str]) -> dict[str, float | None]:
    """The exact median of each column without nulls; None where there is nothing.  Give it a checkpointed table.

    Mergeable quantile sketches give bounds on both sides of the middle, and a pass counts the values below and between.
    The values between are sketched again until they are few, or nearly all are equal; then only they are ranked, each once
    with its number.  So no task sorts a column, whatever its distribution.
    """
    n = dict(zip(names, rows.agg(*[F.count(c) for c in names]).first(), strict=True))
    rank = {c: ((k + 1) // 2, k // 2 + 1) for c, k in n.items()}  # of the two middle values
    state = {c: (float("-inf"), float("inf"), 0, k) for c, k in n.items() if k}
    todo = [c for c in state if n[c] > MOST_RANKED]
    between = lambda c, lo, hi: F.col(c).between(F.lit(lo), F.lit(hi))
    while todo:
        aggs = []
        for c in todo:
            lo, hi, below, inside = state[c]
            ends = [max(0.0, (rank[c][0] - below) / inside - MARGIN), min(1.0, (rank[c][1] - below) / inside + MARGIN)]
            aggs.append(F.percentile_approx(F.when(between(c, lo, hi), F.col(c)), ends, ACCURACY))
        bounds = dict(zip(todo, rows.agg(*aggs).first(), strict=True))
        counts = rows.agg(*[x for c in todo for x in (F.count_if(F.col(c) < bounds[c][0]), F.count_if(between(c, *bounds[c])))]).first()
        again = []
        for i, c in enumerate(todo):
            below, inside = counts[2 * i : 2 * i + 2]
            if below < rank[c][0] and below + inside >= rank[c][1]:
                if MOST_RANKED < inside < state[c][3] / 2:
                    again.append(c)
                state[c] = (*bounds[c], below, inside)
        todo = again
    if not state:
        return dict.fromkeys(names)
    spark = rows.sparkSession
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.when(between(c, *state[c][:2]), F.col(c)).alias("x")) for c in state]))
    each = rows.select(each).where("x IS NOT NULL").groupBy("name", "x").agg(F.count(F.lit(1)).alias("n"))
    start = spark.createDataFrame([(c, x[2], *rank[c]) for c, x in state.items()], "name string, start bigint, low bigint, high bigint")
    run = Window.partitionBy("name").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = each.join(F.broadcast(start), "name").withColumn("upto", F.col("start") + F.sum("n").over(run))  # a row for each column
    has = lambda r: F.max(F.when((F.col("upto") >= F.col(r)) & (F.col("upto") - F.col("n") < F.col(r)), F.col("x")))
    found = near.groupBy("name").agg(((has("low") + has("high")) / 2).alias("median")).collect()
    return dict.fromkeys(names) | {r.name: r["median"] for r in found}


def fit_stats(t: DataFrame, roles: Roles, exact: bool = True) -> DataFrame:
    """B6 as rows: level, feature, median, least, most.  All-null columns have median 0.

    ``exact=False`` uses approximate medians.
    """
    cols = [(name, c, x) for name, level in roles.levels.items() for c, x in numeric_columns(name, level, roles).items()]
    names = [f"x{i}" for i in range(len(cols))]
    rows = checkpointed(t.select(*[x.alias(n) for n, (_, _, x) in zip(names, cols, strict=True)]))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max, F.count)]).first()
    if exact:
        mids = medians(rows, names)
    else:
        mids = dict(zip(names, rows.agg(*[F.percentile_approx(n, 0.5, 10_000) for n in names]).first(), strict=True))
    out = []
    for n, (level, feature, _) in zip(names, cols, strict=True):
        median, least, most = mids[n] or 0.0, ends[f"min_{n}"], ends[f"max_{n}"]
        if ends[f"count_{n}"] < ends.n:
            least, most = min(median, median if least is None else least), max(median, median if most is None else most)
        out.append((level, feature, float(median), least, most))
    return t.sparkSession.createDataFrame(out, "level string, feature string, median double, least double, most double")


def fit_encoder(t: DataFrame, roles: Roles, exact: bool = True) -> Encoder:
    """One row for each column comes to the driver."""
    stats: dict = {name: {} for name in roles.levels}
    for r in fit_stats(t, roles, exact).collect():
        if r.least is None:
            raise ValueError("cannot fit on an empty table")
        stats[r.level][r.feature] = (r.median, r.least, r.most)
    return Encoder(roles, stats)


def scaled(x: Column, least: float, most: float) -> Column:
    """Min-max to 0..1, clipped; a constant column is divided by 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(least)) / F.lit(most - least or 1.0)))


def encode(t: DataFrame, model: Encoder) -> DataFrame:
    """An array column for each level, and ``original``, all of them in a row."""
    arrays = {}
    for name, level in model.roles.levels.items():
        stats = model.stats[name]
        numbers = [scaled(F.coalesce(x, F.lit(stats[c][0])), *stats[c][1:]) for c, x in numeric_columns(name, level, model.roles).items()]
        arrays[name] = F.concat(F.array(*numbers), *[one_hot(F.col(c), v) for c, v in level.categorical.items()])
    out = t.withColumns({f"v_{k}": a for k, a in arrays.items()})
    return out.withColumn("v_original", F.concat(*[F.col(f"v_{k}") for k in arrays]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector divided by its length; a zero vector stays zero."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def vector_sum(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Sum of an array column within keys: by place, so partial sums are made before the shuffle."""
    places = df.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(out))


def scale_views(df: DataFrame, views: list[str]) -> DataFrame:
    """Min-max of each place of each view over all rows; constant places become 0."""
    for v in views:
        ends = df.select(F.posexplode(v).alias("_at", "_x")).groupBy("_at").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        ends = ends.agg(F.array_sort(F.collect_list(F.struct("_at", "lo", "hi"))).alias("_ends"))
        s = lambda x, e: F.when(e["hi"] > e["lo"], (x - e["lo"]) / (e["hi"] - e["lo"])).otherwise(0.0)
        df = df.crossJoin(F.broadcast(ends)).withColumn(v, F.zip_with(v, "_ends", s)).drop("_ends")  # one row
    return df
