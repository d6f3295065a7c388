"""Star schema: dimensions, inferred members, facts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_key, net, surrogate_key


def dim_date(*days: DataFrame) -> DataFrame:
    """One row per day that occurs in the first column of any of the frames."""
    found = days[0].select(F.col(days[0].columns[0]).cast("date").alias("full_date"))
    for d in days[1:]:
        found = found.union(d.select(F.col(d.columns[0]).cast("date")))
    found = found.where("full_date is not null").distinct()
    return found.select(date_key("full_date").alias("date_key"), "full_date", F.year("full_date").alias("year"), F.quarter("full_date").alias("quarter"), F.month("full_date").alias("month"), F.dayofmonth("full_date").alias("day"), F.date_format("full_date", "MMMM").alias("month_name"), F.dayofweek("full_date").alias("day_of_week"), F.dayofweek("full_date").isin(1, 7).alias("is_weekend"))


def dim_instrument(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    """The static instruments, given as (instrument, asset class, contract size)."""
    made = spark.createDataFrame(rows, "instrument string, asset_class string, contract_size int")
    return made.select(surrogate_key("instrument").alias("instrument_key"), "instrument", "asset_class", F.col("contract_size").cast("decimal(9,0)").alias("contract_size"))


def stub_age(stubs: DataFrame, since: str, as_of: Column, days: int = 7) -> DataFrame:
    """Members still inferred after ``days`` are to be chased at their source."""
    old = F.datediff(as_of, F.col(since))
    return stubs.where("is_inferred").withColumn("age_days", old).withColumn("stale", old > days)


def dim_low_card(df: DataFrame, name: str, key_name: str) -> DataFrame:
    return df.select(name).where(F.col(name).isNotNull()).distinct().select(surrogate_key(name).alias(key_name), name)


def infer_members(dim_keys: DataFrame, facts: DataFrame, key: str, stub: dict[str, Column]) -> DataFrame:
    """A stub for each key that facts hold and the dimension lacks."""
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dim_keys.select(key), key, "left_anti")
    return missing.select(surrogate_key(F.col(key), F.lit("1900-01-01")).alias("sk"), key, *(v.alias(k) for k, v in stub.items()), F.lit(True).alias("is_inferred"))


def upgrade_stubs(stubs: DataFrame, arrived: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Stubs whose member has arrived take its attributes and keep their surrogate key."""
    new = arrived.select(key, *(F.col(a).alias(f"_{a}") for a in attributes), F.lit(True).alias("_here"))
    joined = stubs.join(new, key, "left")
    here = F.coalesce(F.col("_here"), F.lit(False))
    return joined.select("sk", key, *(F.when(here, F.col(f"_{a}")).otherwise(F.col(a)).alias(a) for a in attributes), (F.col("is_inferred") & ~here).alias("is_inferred"))


def fact_deposit(deposits: DataFrame, clients: DataFrame) -> DataFrame:
    """Deposits bound to the current client version; a small dimension is broadcast by its size."""
    return deposits.join(clients.select("client_id", "client_sk"), "client_id", "left").select(
        surrogate_key("deposit_id", "source_system").alias("deposit_sk"), "deposit_id", "client_sk", "client_id", date_key("deposit_date").alias("date_key"), F.when(F.col("payment_method").isNotNull(), surrogate_key("payment_method")).alias("payment_method_key"), "source_system", "amount_usd", "fee_usd", net("amount_usd", "fee_usd").cast("decimal(18,2)").alias("net_amount_usd")
    )


def fact_trade(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Trades with their keys and the derived PnL beside the reported one, which never changes; an unknown instrument derives null.

    Takes trades with client_sk (bound to the client's current version) and trade_date.
    """
    joined = trades.join(instruments.select("instrument", "instrument_key", "contract_size"), "instrument", "left")
    joined = joined.withColumn("pnl_usd_derived", derived_pnl())
    joined = joined.withColumn("pnl_variance_usd", (F.col("pnl_usd_reported") - F.col("pnl_usd_derived")).cast("decimal(18,2)"))
    return joined.withColumn("trade_sk", surrogate_key("trade_id")).withColumn("date_key", date_key("trade_date"))


def derived_pnl() -> Column:
    sign = F.when(F.col("direction") == "buy", F.lit(1)).otherwise(F.lit(-1))
    return (F.round((F.col("close_price") - F.col("open_price")) * F.col("contract_size") * F.col("volume_lots"), 2) * sign).cast("decimal(18,2)")


def bind_current(facts: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Facts with the surrogate key of their member's current version, null where there is none."""
    versions = dim.where("is_current AND NOT is_deleted").select(F.col(key).alias("_k"), F.col("sk").alias(name))
    return facts.join(versions, F.col(key) == F.col("_k"), "left").drop("_k")


def pnl_control(trades: DataFrame) -> DataFrame:
    return trades.where(F.abs("pnl_variance_usd") > 0.01)


def balance_snapshot(dim: DataFrame, key: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """The version valid at each day's end, by clipping intervals to the window and unfolding their days."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.greatest(F.col("valid_from").cast("date"), low)
    last = F.least(F.date_sub(F.col("valid_to").cast("date"), 1), high)
    return dim.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("day"), *keep).select(date_key("day").alias("date_key"), key, *keep)


def infer_contract_size(trades: DataFrame) -> DataFrame:
    """Per instrument the size that most trades imply; ties go to the smaller one."""
    size = F.round(F.abs(F.col("pnl_usd_reported") / ((F.col("close_price") - F.col("open_price")) * F.col("volume_lots"))), 0).cast("long")
    implied = trades.where("close_price <> open_price AND volume_lots <> 0")
    counted = implied.select("instrument", size.alias("size")).groupBy("instrument", "size").agg(F.count("*").alias("n"))
    return counted.groupBy("instrument").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("contract_size"))


def fx(original: str | Column, rate: str | Column) -> Column:
    o, r = (F.col(c) if isinstance(c, str) else c for c in (original, rate))
    return F.round(o * r, 2).cast("decimal(18,2)")


def erase(df: DataFrame, keys: DataFrame, key: str, personal: list[str]) -> DataFrame:
    """Personal columns of the listed keys become null; the rows stay."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    out = df.join(gone, key, "left")
    return out.select(*(F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in personal else F.col(c) for c in df.columns))
