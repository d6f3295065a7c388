"""The flagship query: net deposits by day and source system, from raw rows through the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import net
from ..operators import dq, upsert
from . import inputs


def net_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.deposits(spark, sf_dir).join(inputs.clients(spark, sf_dir), "client_id", "left")
    clean, _ = dq.split(dq.evaluate(raw, inputs.rules()))
    one = upsert.dedupe(clean, ["deposit_id"], [F.col("deposit_date").desc(), F.col("amount_usd").desc()])
    return one.groupBy("deposit_date", "source_system").agg(F.count("*").alias("n_deposits"), F.sum(net("amount_usd", "fee_usd")).cast("decimal(18,2)").alias("net_amount"))
