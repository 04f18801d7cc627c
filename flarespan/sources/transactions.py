"""Reading, checking and splitting the transaction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flarespan.config import Roles


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A1: read with a fixed schema where one is given (always give one for text formats)."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def write_transactions(t: DataFrame, path: str, time: str = "ts") -> None:
    """A1: write as Parquet, a folder for each day, so that later time filters prune files."""
    t.withColumn("slot_date", F.to_date(time)).write.partitionBy("slot_date").parquet(path)


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction table derived from events, orders and customers."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    e = read("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select(
        F.col("event_id").alias("row_id"), "user_id", "ts", F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), ((F.col("us") - F.lag("us").over(by_user)) / 1e6).alias("gap_sec"),
        F.count(F.lit(1)).over(hour).cast("double").alias("cnt_1h"), F.sum("value").over(hour).alias("sum_1h"),
    )
    e = e.withColumn("k_band", F.when(F.col("k") < 30, "low").when(F.col("k") < 60, "mid").when(F.col("k") < 90, "high").otherwise("top"))
    accounts = read("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min("o_orderdate").alias("created"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_total"),
        F.max("o_totalprice").alias("max_total"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"),
    )
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    customers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), "region"
    )
    return e.join(accounts, "user_id", "left").join(customers, "user_id", "left")


def violation_rules(t: DataFrame, roles: Roles, require_labels: bool) -> dict[str, Column]:
    time, amount, label = (F.col(c) for c in (roles.time, roles.amount, roles.label))
    bad = amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount < 0)
    rules = {"amount_not_finite_or_negative": bad, "time_null": time.isNull()}
    if roles.created:
        rules["created_null"] = F.col(roles.created).isNull()
    if require_labels:
        rules["label_not_0_or_1"] = F.coalesce(~label.isin(0, 1), F.lit(True))
    return rules


def contract_violations(t: DataFrame, roles: Roles, require_labels: bool = True) -> DataFrame:
    """A3: rows (rule, n), counted in one pass."""
    rules = violation_rules(t, roles, require_labels)
    one = t.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "n")


def validate(t: DataFrame, roles: Roles, require_labels: bool = False) -> None:
    """A2: raise ``ValueError`` for missing columns, wrong types, or rows against the contract."""
    wanted = {roles.row_id, roles.time, roles.amount, *roles.required, *([roles.created] if roles.created else []), *([roles.label] if require_labels else [])}
    for level in roles.levels.values():
        wanted |= {*level.numeric, *level.categorical}
    if missing := sorted(wanted - set(t.columns)):
        raise ValueError(f"missing columns: {missing}")
    for c in (roles.time, roles.created):
        if c and not isinstance(t.schema[c].dataType, (T.TimestampNTZType, T.TimestampType)):
            raise ValueError(f"{c} must be a timestamp")
    found = {r.rule: r.n for r in contract_violations(t, roles, require_labels).collect() if r.n}  # one row for each rule
    if found:
        raise ValueError(f"rows against the contract: {found}")
    if require_labels and t.isEmpty():
        raise ValueError("no rows")


def temporal_split(t: DataFrame, start: str, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """A4: rows before and from ``start``; an empty side is an error."""
    at = F.lit(start).cast("timestamp_ntz")
    train, test = t.where(F.col(time) < at), t.where(F.col(time) >= at)
    if train.isEmpty() or test.isEmpty():
        raise ValueError("one side of the split is empty")
    return train, test


def recent_window(t: DataFrame, days: int = 30, time: str = "ts") -> DataFrame:
    """A5: rows later than the latest time less ``days``, strictly."""
    if days <= 0:
        raise ValueError("days must be positive")
    last = t.agg((F.max(time) - F.make_dt_interval(F.lit(days))).alias("_from"))
    return t.crossJoin(F.broadcast(last)).where(F.col(time) > F.col("_from")).drop("_from")  # one row
