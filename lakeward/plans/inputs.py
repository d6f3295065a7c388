"""The driver's tables as the feeds of a deposit platform."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dq import BLOCK, QUARANTINE, WARN, Rule
from ..operators.upsert import dedupe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as deposits; some keys get a defect of each kind."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    amount = F.when(k % 41 == 0, -money).when(k % 43 == 0, F.lit(None)).otherwise(money).cast("decimal(18,2)")
    fee = F.round(money * F.when(k % 37 == 0, F.lit(Decimal("0.02"))).otherwise(F.lit(Decimal("0.01"))), 2).cast("decimal(18,2)")
    return o.select(k.alias("deposit_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("deposit_date"), amount.alias("amount_usd"), fee.alias("fee_usd"), F.when(k % 29 != 0, F.col("o_orderpriority")).alias("payment_method"), F.when(k % 2 == 0, "VENDOR").otherwise("WAREHOUSE").alias("source_system"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as clients; every fiftieth is unknown."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.where(k % 50 != 0).select(k.alias("client_id"), F.date_add(F.lit("1992-01-01").cast("date"), (k % 2400).cast("int")).alias("signup_date"), F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("approved").alias("kyc_status"))


def rules() -> list[Rule]:
    amount, fee = F.col("amount_usd"), F.col("fee_usd")
    return [
        Rule("amount_positive", QUARANTINE, amount.isNull() | (amount <= 0), F.concat(F.lit("amount="), F.coalesce(amount.cast("string"), F.lit("null")))),
        Rule("client_exists", QUARANTINE, F.col("signup_date").isNull(), F.concat(F.lit("client="), F.col("client_id").cast("string"))),
        Rule("payment_method_present", QUARANTINE, F.col("payment_method").isNull(), F.lit("payment_method=null")),
        Rule("deposit_not_before_signup", WARN, F.col("deposit_date") < F.col("signup_date"), F.concat(F.lit("signup="), F.col("signup_date").cast("string"))),
        Rule("fee_within_tolerance", WARN, (amount > 0) & (fee > 0) & (F.abs(fee - amount * F.lit(Decimal("0.01"))) > amount * F.lit(Decimal("0.002"))), F.concat(F.lit("fee="), fee.cast("string"))),
        Rule("kyc_approved_for_deposit", WARN, F.col("kyc_status") != "approved", F.concat(F.lit("kyc="), F.col("kyc_status"))),
    ]


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with birth dates, some before 1920 and some in the future of 2000."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("client_id"), F.date_add(F.lit("1915-01-01").cast("date"), (k * 37 % 33000).cast("int")).alias("birth_date"))


def birth_rules(today: str) -> list[Rule]:
    born = F.col("birth_date")
    return [Rule("dob_plausible", WARN, (born < F.lit("1920-01-01").cast("date")) | (born > F.lit(today).cast("date")), F.concat(F.lit("birth_date="), born.cast("string")))]


def id_rules(key: str) -> list[Rule]:
    """A row without an id stops the load."""
    return [Rule(f"{key}_not_null", BLOCK, F.col(key).isNull() | (F.trim(key) == ""), F.concat(F.lit(f"{key}="), F.coalesce(F.col(key), F.lit("null"))))]


def warehouse_rules() -> list[Rule]:
    """The warehouse feed's gate: only orphans and malformed keys are checked."""
    return [
        Rule("client_exists", QUARANTINE, F.col("signup_date").isNull(), F.concat(F.lit("client="), F.col("client_id").cast("string"))),
        Rule("deposit_id_well_formed", QUARANTINE, ~F.col("deposit_ref").rlike(r"^DEP\d+$"), F.concat(F.lit("deposit_id="), F.col("deposit_ref"))),
    ]


def recovered_rules() -> list[Rule]:
    return [Rule("malformed_key_recovered", WARN, F.col("_recovered"), F.concat(F.lit("payment_method="), F.col("payment_method")))]


def pnl_rules() -> list[Rule]:
    return [Rule("pnl_recomputes", WARN, F.abs("pnl_variance_usd") > F.lit(Decimal("0.01")), F.concat(F.lit("variance="), F.col("pnl_variance_usd").cast("string")))]


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits with the ids of the warehouse feed, some blank, some absent, some malformed."""
    k = F.col("deposit_id")
    ref = F.when(k % 83 == 0, F.lit(" ")).when(k % 89 == 0, F.lit(None)).when(k % 53 == 0, F.concat(F.lit("dep-"), k.cast("string"))).otherwise(F.concat(F.lit("DEP"), k.cast("string")))
    return deposits(spark, sf_dir).withColumn("deposit_ref", ref)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: band is tracked, note is carried, both absent in some images."""
    kind = F.col("event_type")
    given = ~kind.isin("view", "error")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), "user_id", F.col("ts").alias("commit_ts"), F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update").alias("op"), F.when(given, F.floor(F.col("value") / 25)).cast("long").alias("band"), F.when(given, F.col("props")).alias("note"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades, one row per key; some reported results do not recompute."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,4)").alias("open_price"))
    fields = ["l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag"]
    one = dedupe(li.select("l_orderkey", "l_linenumber", *fields), ["l_orderkey", "l_linenumber"], [F.col(c) for c in fields])
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("trade_date"))
    return one.join(owner, "l_orderkey", "left").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"), F.col("l_returnflag").alias("instrument"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("direction"), F.col("l_quantity").cast("decimal(9,2)").alias("volume_lots"), "open_price", F.col("l_extendedprice").cast("decimal(18,4)").alias("close_price"), F.col("l_orderkey"), "client_id", "trade_date")
