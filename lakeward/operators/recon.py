"""Two-tier reconciliation of two feeds, with breaks, ageing and control totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATERIAL = 10_000
STALE_DAYS = 3


def window(vendor: DataFrame) -> DataFrame:
    """One row: the vendor feed's event dates."""
    return vendor.agg(F.min("deposit_date").alias("lo"), F.max("deposit_date").alias("hi"))


def tier1(v: DataFrame, w: DataFrame) -> DataFrame:
    """Equal ids."""
    a = v.select(F.col("deposit_id").alias("vendor_id"), F.col("amount_usd").alias("amount_vendor"), "client_id", "deposit_date")
    b = w.select(F.col("deposit_id").alias("warehouse_id"), F.col("amount_usd").alias("amount_warehouse"))
    return a.join(b, F.col("vendor_id") == F.col("warehouse_id")).select(F.lit(1).alias("match_tier"), "vendor_id", "warehouse_id", "client_id", "deposit_date", "amount_vendor", "amount_warehouse", (F.col("amount_vendor") - F.col("amount_warehouse")).cast("decimal(18,2)").alias("variance_usd"))


def tier2(v: DataFrame, w: DataFrame, first: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Equal client and date with amounts less than the tolerance apart, of what tier 1 leaves.

    Amounts meet per cell of the tolerance and its neighbours, so a client's busy day is not held
    against itself whole.
    """
    a = v.join(first.select(F.col("vendor_id").alias("deposit_id")), "deposit_id", "left_anti").select(F.col("deposit_id").alias("vendor_id"), F.col("amount_usd").alias("amount_vendor"), "client_id", "deposit_date")
    b = w.join(first.select(F.col("warehouse_id").alias("deposit_id")), "deposit_id", "left_anti").select(F.col("deposit_id").alias("warehouse_id"), F.col("amount_usd").alias("amount_warehouse"), "client_id", "deposit_date")
    a = a.withColumn("_cell", F.floor(F.col("amount_vendor") / F.lit(Decimal(tolerance))))
    cell = F.floor(F.col("amount_warehouse") / F.lit(Decimal(tolerance)))
    b = b.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = a.join(b, ["client_id", "deposit_date", "_cell"]).where(F.abs(F.col("amount_vendor") - F.col("amount_warehouse")) < F.lit(Decimal(tolerance)))
    return near.select(F.lit(2).alias("match_tier"), "vendor_id", "warehouse_id", "client_id", "deposit_date", "amount_vendor", "amount_warehouse", (F.col("amount_vendor") - F.col("amount_warehouse")).cast("decimal(18,2)").alias("variance_usd"))


def breaks(v: DataFrame, w: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows of either feed without a match; warehouse rows only inside the vendor's dates."""
    only_v = v.join(matched.select(F.col("vendor_id").alias("deposit_id")).distinct(), "deposit_id", "left_anti").select(F.lit("VENDOR_ONLY").alias("break_type"), "deposit_id", "client_id", "deposit_date", F.col("amount_usd").cast("decimal(18,2)").alias("variance_usd"))
    inside = w.crossJoin(F.broadcast(window(v))).where(F.col("deposit_date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    only_w = inside.join(matched.select(F.col("warehouse_id").alias("deposit_id")).distinct(), "deposit_id", "left_anti").select(F.lit("WAREHOUSE_ONLY").alias("break_type"), "deposit_id", "client_id", "deposit_date", (-F.col("amount_usd")).cast("decimal(18,2)").alias("variance_usd"))
    return only_v.unionByName(only_w)


def unmatched(v: DataFrame, w: DataFrame) -> DataFrame:
    """The breaks of two feeds of cent amounts under a tolerance of one cent, without forming pairs.

    A row has a partner by id if its id stands in both feeds, else by equal client, date and amount
    among the rows that have none by id. Two windows say so; each feed is read once, and once more
    for the vendor's dates.
    """
    cols = ["deposit_id", "client_id", "deposit_date", "amount_usd"]
    rows = v.select(*cols, F.lit(0).alias("_w")).unionByName(w.select(*cols, F.lit(1).alias("_w")))
    both = lambda over, on: (F.min(F.when(on, F.col("_w"))).over(over) == 0) & (F.max(F.when(on, F.col("_w"))).over(over) == 1)
    rows = rows.withColumn("_one", both(Window.partitionBy("deposit_id"), F.lit(True)) & F.col("deposit_id").isNotNull())
    rows = rows.withColumn("_two", both(Window.partitionBy("client_id", "deposit_date", "amount_usd"), ~F.col("_one")))
    known = F.col("client_id").isNotNull() & F.col("deposit_date").isNotNull() & F.col("amount_usd").isNotNull()
    left = rows.where(~F.col("_one") & ~F.coalesce(F.col("_two") & known, F.lit(False))).crossJoin(F.broadcast(window(v)))
    left = left.where((F.col("_w") == 0) | F.col("deposit_date").between(F.col("lo"), F.col("hi")))
    kind = F.when(F.col("_w") == 0, "VENDOR_ONLY").otherwise("WAREHOUSE_ONLY")
    amount = F.when(F.col("_w") == 0, F.col("amount_usd")).otherwise(-F.col("amount_usd"))
    return left.select(kind.alias("break_type"), "deposit_id", "client_id", "deposit_date", amount.cast("decimal(18,2)").alias("variance_usd"))


def evidence(matched: DataFrame, broken: DataFrame, run_id: str) -> DataFrame:
    """Matches and breaks as one table to append."""
    return matched.unionByName(broken.withColumnRenamed("deposit_id", "broken_id"), allowMissingColumns=True).withColumn("run_id", F.lit(run_id))


def ageing(broken: DataFrame, as_of: Column) -> DataFrame:
    """Per break type; money at stake beats age."""
    total, old = F.sum(F.abs("variance_usd")), F.max(F.datediff(as_of, F.col("deposit_date")))
    action = F.when(F.col("total_abs_variance") > MATERIAL, "PAGE_IMMEDIATELY").when(F.col("max_age_days") > STALE_DAYS, "ESCALATE_TO_VENDOR").otherwise("MONITOR")
    return broken.groupBy("break_type").agg(F.count("*").alias("breaks"), total.cast("decimal(18,2)").alias("total_abs_variance"), old.alias("max_age_days")).withColumn("action", action)


def pages(broken: DataFrame) -> DataFrame:
    """Single breaks that page by themselves."""
    return broken.where(F.abs("variance_usd") > MATERIAL)


def control_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("deposit_date", "source_system").agg(F.count("*").alias("n_rows"), F.sum("amount_usd").cast("decimal(18,2)").alias("amount"), F.sum("fee_usd").cast("decimal(18,2)").alias("fee"))


def source_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("source_system").agg(F.count("*").alias("n_rows"), F.sum("amount_usd").cast("decimal(18,2)").alias("amount"), F.min("deposit_date").alias("first_date"), F.max("deposit_date").alias("last_date"))
