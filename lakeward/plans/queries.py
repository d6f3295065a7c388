"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_key, masked, row_hash, surrogate_key, typed
from ..operators import backfill, contract, control, dq, recon, scd2, star, upsert
from ..streaming import bronze
from . import flagship
from .inputs import birth_rules, births, clients, deposits, events, id_rules, pnl_rules, recovered_rules, refs, rules, table, trades, warehouse_rules

AS_OF = "2000-01-01"
INSTRUMENTS = [("A", "FX", 100), ("N", "METAL", 10)]
PARTNER_KEY = "partner-1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _window():
    return F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _as_of():
    return F.lit(AS_OF).cast("date")


def _checked(spark, d):
    return dq.evaluate(deposits(spark, d).join(clients(spark, d), "client_id", "left"), rules())


def _feeds(spark, d):
    """Two feeds of one truth: some ids shared, some amounts a cent or more off, some rows missing."""
    base = deposits(spark, d).where("amount_usd is not null")
    k = F.col("deposit_id")
    vendor = base.where(k % 5 != 0)
    off = F.when(k % 3 == 0, F.col("amount_usd") + F.lit(Decimal("0.01"))).otherwise(F.col("amount_usd")).cast("decimal(18,2)")
    house = base.where(k % 7 != 0).withColumn("amount_usd", off).withColumn("deposit_id", F.when(k % 2 == 0, k).otherwise(k + 100_000_000))
    return vendor, house


def _matched(spark, d):
    v, w = _feeds(spark, d)
    first = recon.tier1(v, w)
    return v, w, first, recon.tier2(v, w, first)


def _history(spark, d):
    return scd2.build(events(spark, d), "user_id", ["band"], ["note"])


DIM = ["sk", "record_hash", "user_id", "band", "note", "valid_from", "valid_to", "is_current", "is_deleted", "source_lsn", "source_op"]


@query
def net_by_day(spark, d):
    return flagship.net_by_day(spark, d)


@query
def typed_projection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("bad"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"))
    return o.select(typed("o_orderkey", "bigint"), typed("bad", "int"), typed("amount", "decimal(18,2)"))


@query
def row_hash_null_safe(spark, d):
    dep = deposits(spark, d)
    return dep.select("deposit_id", row_hash("deposit_id", "client_id", "payment_method", "amount_usd").alias("row_hash"))


@query
def alias_coalesce(spark, d):
    c = contract.Contract({"id": "bigint", "payment_method": "string"}, ("id",), {"method": "payment_method"}, {"credit_card": "payment_method"})
    o = table(spark, d, "orders")
    even = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("method"))
    odd = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("payment_method"), F.lit("CARD").alias("credit_card"))
    return contract.normalise(even, c).unionByName(contract.normalise(odd, c)).select("id", "payment_method", F.col("_recovered").alias("recovered"))


@query
def watermark_read(spark, d):
    o = table(spark, d, "orders")
    master = o.agg(F.max("o_orderdate").alias("latest_loaded_ts")).select(F.lit("orders").alias("table_name"), F.lit("SUCCESS").alias("last_load_status"), "latest_loaded_ts")
    return control.read_at_watermark(o, master, "orders", "o_orderdate").select("o_orderkey", "o_custkey")


@query
def load_manifest(spark, d):
    """Order months as files; a third was seen before, half of those with other content, and one is not delivered again."""
    m = F.date_format("o_orderdate", "yyyyMM")
    found = table(spark, d, "orders").groupBy(m.alias("source_file")).agg(F.count("*").alias("n")).select("source_file", F.sha2(F.col("n").cast("string"), 256).alias("file_hash"))
    seen = found.where(F.col("source_file").cast("int") % 3 == 0).select("source_file", F.when(F.col("source_file").cast("int") % 2 == 0, F.col("file_hash")).otherwise("old").alias("file_hash"), F.lit(1).alias("ingest_count"))
    return control.register_files(found, seen.unionByName(spark.createDataFrame([("190001", "old", 1)], seen.schema)))


@query
def reingested_rows(spark, d):
    """Months as files again: corrected ones replace their old rows, duplicates are left out."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("source_file"))
    held = o.where(F.col("source_file").cast("int") % 3 == 0).withColumn("o_orderkey", -F.col("o_orderkey"))
    return control.reingest(held, o, load_manifest(spark, d))


def _attempts(spark, d):
    """Loads per priority and year: files are its expensive orders, and very dear ones break a load."""
    dear = F.max("o_totalprice")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("table_name"), F.year("o_orderdate").alias("y"))
    tries = o.agg(F.count_if(F.col("o_totalprice") > 400000).alias("n_files"), F.count("*").alias("n_rows"), F.when(dear > 499000, "too dear").alias("error"))
    return control.attempts(tries.withColumn("load_ts", F.make_date("y", F.lit(12), F.lit(31))).drop("y"))


@query
def load_history(spark, d):
    return _attempts(spark, d)


@query
def load_master(spark, d):
    old = spark.createDataFrame([("1-URGENT", "SUCCESS", 10), ("OTHER", "FAILED", 20)], "table_name string, last_load_status string, total_records long").withColumn("latest_loaded_ts", F.lit("1990-01-01").cast("date"))
    return control.update_master(old, _attempts(spark, d))


@query
def file_lag(spark, d):
    li = table(spark, d, "lineitem").select(F.last_day(F.col("l_shipdate").cast("date")).alias("label"), F.col("l_shipdate").cast("date").alias("day"))
    return control.file_lag(li, "label", "day")


@query
def missing_days(spark, d):
    return control.missing_days(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@query
def sequence_gaps(spark, d):
    """Prices, in whole units at the end of an id, as numbers of which many are missing."""
    ref = F.concat(F.lit("DEP"), F.floor("o_totalprice").cast("string"))
    return control.sequence_gaps(table(spark, d, "orders"), F.regexp_extract(ref, r"(\d+)$", 1))


@query
def dq_evidence(spark, d):
    return dq.evidence(_checked(spark, d), "deposit_id")


@query
def dq_summary(spark, d):
    return dq.summary(dq.evidence(_checked(spark, d), "deposit_id"))


@query
def dq_clean(spark, d):
    return dq.split(_checked(spark, d))[0].select("deposit_id", "client_id", "amount_usd")


@query
def dq_quarantine(spark, d):
    return dq.split(_checked(spark, d))[1].select("deposit_id", "failed_checks")


def _open(spark, d):
    held = dq.split(_checked(spark, d))[1]
    return held.select("deposit_id", "failed_checks", F.col("deposit_date").alias("quarantined_at"), F.lit(None).cast("date").alias("resolved_at"))


@query
def quarantine_release(spark, d):
    """Later the unknown clients arrive; rows with another fault stay open."""
    late = clients(spark, d).unionByName(table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("client_id"), F.lit("1992-01-01").cast("date").alias("signup_date"), F.lit("approved").alias("kyc_status")))
    now = dq.split(dq.evaluate(deposits(spark, d).join(late, "client_id", "left"), rules()))[0]
    return dq.release(_open(spark, d), now, "deposit_id", _as_of()).select("deposit_id", "failed_checks", "resolved_at")


@query
def quarantine_new_only(spark, d):
    rows = _open(spark, d)
    return dq.new_only(rows, rows.where("deposit_id % 2 = 0"), "deposit_id").select("deposit_id")


@query
def quarantine_ageing(spark, d):
    return dq.age(_open(spark, d), "quarantined_at", _as_of()).groupBy("ageing_action").agg(F.count("*").alias("n"), F.max("age_days").alias("oldest"))


@query
def restatement_bound(spark, d):
    fresh, old = dq.bound(deposits(spark, d), "deposit_date", F.lit("1995-06-01").cast("date"))
    return fresh.agg(F.count("*").alias("restatable")).crossJoin(old.agg(F.count("*").alias("too_old")))


@query
def dedupe_last_wins(spark, d):
    li = table(spark, d, "lineitem")
    return upsert.dedupe(li, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc(), F.col("l_extendedprice").desc(), F.col("l_quantity").desc()]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def _merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    with_hash = lambda x: x.withColumn("row_hash", row_hash("o_orderkey", "amount"))
    target = with_hash(o.where("o_orderkey % 5 <> 0"))
    source = with_hash(o.where("o_orderkey % 3 = 0").withColumn("amount", F.when(F.col("o_orderkey") % 2 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)")))
    return upsert.merge(target, source, ["o_orderkey"], "row_hash")


@query
def merge_state(spark, d):
    return _merge(spark, d).drop("_action")


@query
def merge_actions(spark, d):
    return upsert.actions(_merge(spark, d))


@query
def replace_where(spark, d):
    dep = deposits(spark, d).select("deposit_id", date_key("deposit_date").alias("date_key"), "amount_usd")
    inside = F.col("date_key").between(19950101, 19950131)
    return upsert.replace_range(dep, dep.where(inside & (F.col("deposit_id") % 2 == 0)), inside)


@query
def lsn_gaps(spark, d):
    """Log numbers taken from the clock, in milliseconds, as far apart as the events."""
    return scd2.lsn_gaps(events(spark, d).select(F.unix_millis(F.col("commit_ts").cast("timestamp")).alias("lsn")))


@query
def replay_guard(spark, d):
    e = events(spark, d)
    return scd2.fresh(e, e.where("lsn % 3 = 0")).select("lsn", "user_id")


@query
def cdc_order(spark, d):
    """Next commit per key in log order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("lsn")
    return events(spark, d).select("lsn", "user_id", F.row_number().over(w).alias("seq"), F.lead("commit_ts").over(w).alias("next_commit"))


@query
def scd2_build(spark, d):
    return _history(spark, d)[0].select(*DIM)


@query
def scd2_current(spark, d):
    return scd2.current(_history(spark, d)[0]).select("user_id", "band", "note", "source_lsn")


@query
def scd2_tombstones(spark, d):
    return _history(spark, d)[0].where("is_deleted").select("user_id", "valid_from", "source_lsn")


@query
def scd2_actions(spark, d):
    return _history(spark, d)[1].groupBy("action_taken").agg(F.count("*").alias("n"))


@query
def scd2_apply_log(spark, d):
    return _history(spark, d)[1].select("lsn", "user_id", "op", "action_taken")


@query
def scd2_incremental(spark, d):
    """Half of the log at first, then the rest with late lower lsns: the same history."""
    e = events(spark, d)
    first, rest = e.where("lsn % 2 = 0"), e.where("lsn % 2 = 1")
    dim, log = scd2.build(first, "user_id", ["band"], ["note"])
    return scd2.apply(dim, first, rest, log, "user_id", ["band"], ["note"])[0].select(*DIM)


@query
def scd2_seed(spark, d):
    """Customers as the snapshot that opens the history of the users with their numbers."""
    snapshot = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("band"), F.col("c_mktsegment").alias("note"))
    log = scd2.seed(snapshot, "user_id", ["band"], ["note"]).unionByName(events(spark, d).withColumn("lsn", F.col("lsn") + 1))
    return scd2.build(log, "user_id", ["band"], ["note"])[0].select(*DIM)


def _same_ts(spark, d):
    """All events of a day at one commit time: only the last of a key's versions is ever valid."""
    return scd2.build(events(spark, d).withColumn("commit_ts", F.date_trunc("day", "commit_ts").cast("timestamp_ntz")), "user_id", ["band"], ["note"])


@query
def scd2_same_ts(spark, d):
    return _same_ts(spark, d)[0].select(*DIM)


@query
def scd2_same_ts_log(spark, d):
    return _same_ts(spark, d)[1].groupBy("action_taken").agg(F.count("*").alias("n"))


@query
def orphan_facts(spark, d):
    return scd2.orphans(deposits(spark, d).select("deposit_id", "client_id"), clients(spark, d), "client_id")


@query
def bind_current(spark, d):
    """Events with the key of their user's current version, null where the user is deleted."""
    facts = table(spark, d, "events").select("event_id", "user_id")
    return star.bind_current(facts, _history(spark, d)[0], "user_id", "client_sk")


@query
def lsn_watermark(spark, d):
    return events(spark, d).agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("watermark")).unionByName(events(spark, d).where("op = 'none'").agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("watermark")))


@query
def scd2_invariants(spark, d):
    return scd2.invariants(_history(spark, d)[0], "user_id")


@query
def as_of_join(spark, d):
    facts = table(spark, d, "events").select("event_id", "user_id", "ts")
    return scd2.as_of(facts, _history(spark, d)[0], "user_id", "ts", ["band", "source_lsn"])


@query
def interval_overlap(spark, d):
    return scd2.overlapping(_history(spark, d)[0], *_window()).select("user_id", "valid_from", "valid_to", "source_lsn")


@query
def balance_snapshot(spark, d):
    return star.balance_snapshot(_history(spark, d)[0], "user_id", "2024-01-01", "2024-01-31", ["band", "is_deleted"])


@query
def aum_by_day(spark, d):
    snap = star.balance_snapshot(_history(spark, d)[0], "user_id", "2024-01-01", "2024-01-31", ["band", "is_deleted"])
    return snap.where("NOT is_deleted").groupBy("date_key").agg(F.sum("band").alias("total_band"), F.count("*").alias("clients"))


@query
def inferred_members(spark, d):
    c = clients(spark, d)
    return star.infer_members(c, deposits(spark, d), "client_id", {"kyc_status": F.lit("unknown")})


@query
def stub_ageing(spark, d):
    """Stubs by the first deposit that named them."""
    seen = deposits(spark, d).groupBy("client_id").agg(F.min("deposit_date").alias("first_seen"))
    stubs = star.infer_members(clients(spark, d), deposits(spark, d), "client_id", {"kyc_status": F.lit("unknown")}).join(seen, "client_id")
    return star.stub_age(stubs, "first_seen", F.lit("1995-01-10").cast("date")).select("client_id", "first_seen", "age_days", "stale")


@query
def stub_upgrade(spark, d):
    stubs = star.infer_members(clients(spark, d), deposits(spark, d), "client_id", {"kyc_status": F.lit("unknown")})
    arrived = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("client_id"), F.lit("approved").alias("kyc_status"))
    return star.upgrade_stubs(stubs, arrived, "client_id", ["kyc_status"])


@query
def dim_date(spark, d):
    return star.dim_date(table(spark, d, "orders").select("o_orderdate"), table(spark, d, "lineitem").select("l_shipdate"))


@query
def dim_payment_method(spark, d):
    return star.dim_low_card(deposits(spark, d), "payment_method", "payment_method_key")


@query
def fact_deposit(spark, d):
    c = clients(spark, d).select("client_id", surrogate_key(F.col("client_id"), F.lit("1900-01-01")).alias("client_sk"))
    return star.fact_deposit(dq.split(_checked(spark, d))[0], c)


def _trades(spark, d):
    """Trades whose reported result is the derived one, but for one order in 31."""
    extra = F.when(F.col("l_orderkey") % 31 == 0, F.lit(Decimal("245.00"))).otherwise(F.lit(Decimal("0.00")))
    size = F.when(F.col("instrument") == "A", F.lit(100)).when(F.col("instrument") == "N", F.lit(10)).cast("decimal(9,0)")
    raw = trades(spark, d).withColumn("contract_size", size)
    raw = raw.withColumn("pnl_usd_reported", (F.coalesce(star.derived_pnl(), F.lit(Decimal("0.00"))) + extra).cast("decimal(18,2)")).drop("contract_size")
    raw = raw.withColumn("client_sk", surrogate_key(F.col("client_id"), F.lit("1900-01-01")))
    return star.fact_trade(raw, star.dim_instrument(spark, INSTRUMENTS))


@query
def fact_trade(spark, d):
    return _trades(spark, d).select("trade_sk", "trade_id", "client_sk", "date_key", "instrument_key", "instrument", "pnl_usd_reported", "pnl_usd_derived", "pnl_variance_usd")


@query
def dim_instrument(spark, d):
    return star.dim_instrument(spark, INSTRUMENTS)


@query
def dq_pnl(spark, d):
    return dq.evidence(dq.evaluate(_trades(spark, d), pnl_rules()), "trade_id")


@query
def dq_birth_dates(spark, d):
    return dq.evidence(dq.evaluate(births(spark, d), birth_rules(AS_OF)), "client_id")


@query
def dq_deposit_id(spark, d):
    """Rows that would stop the load, with their place in place of an id."""
    return dq.evidence(dq.evaluate(refs(spark, d), id_rules("deposit_ref")), "deposit_id")


@query
def dq_recovered_keys(spark, d):
    c = contract.Contract({"id": "bigint", "payment_method": "string"}, ("id",), {}, {"credit_card": "payment_method"})
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("payment_method"), F.lit("CARD").alias("credit_card"))
    return dq.evidence(dq.evaluate(contract.normalise(o, c), recovered_rules()), "id")


@query
def warehouse_gate(spark, d):
    return dq.evidence(dq.evaluate(refs(spark, d).join(clients(spark, d), "client_id", "left"), warehouse_rules()), "deposit_id")


@query
def pnl_control(spark, d):
    return star.pnl_control(_trades(spark, d)).select("trade_id", "pnl_variance_usd")


@query
def contract_size(spark, d):
    return star.infer_contract_size(_trades(spark, d).where("pnl_usd_derived is not null").select("instrument", "volume_lots", F.col("open_price").cast("decimal(12,4)").alias("open_price"), F.col("close_price").cast("decimal(12,4)").alias("close_price"), "pnl_usd_reported"))


@query
def fx_normalise(spark, d):
    rate = F.when(F.col("c_nationkey") % 2 == 0, F.lit(Decimal("1.250000"))).otherwise(F.lit(Decimal("0.910000")))
    return table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("original"), rate.alias("fx_rate"), star.fx(F.col("c_acctbal").cast("decimal(18,2)"), rate).alias("usd"))


@query
def erase_personal(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return star.erase(c, c.where("c_custkey % 13 = 0"), "c_custkey", ["c_name"])


@query
def partner_view(spark, d):
    return table(spark, d, "customer").select(masked("c_custkey", PARTNER_KEY).alias("client_token"), "c_mktsegment", (F.col("c_custkey") % 50 == 0).alias("is_deleted"), F.lit(AS_OF).cast("date").alias("data_as_of"))


@query
def recon_window(spark, d):
    return recon.window(_feeds(spark, d)[0])


@query
def recon_tier1(spark, d):
    return _matched(spark, d)[2]


@query
def recon_tier2(spark, d):
    return _matched(spark, d)[3]


@query
def recon_breaks(spark, d):
    return recon.unmatched(*_feeds(spark, d))


@query
def recon_evidence(spark, d):
    v, w, a, b = _matched(spark, d)
    out = recon.evidence(a.unionByName(b), recon.unmatched(v, w), "run")
    return out.groupBy("match_tier", "break_type", "run_id").agg(F.count("*").alias("n"))


@query
def recon_summary(spark, d):
    return recon.ageing(recon.unmatched(*_feeds(spark, d)), _as_of())


@query
def recon_pages(spark, d):
    return recon.pages(recon.unmatched(*_feeds(spark, d)))


@query
def control_totals(spark, d):
    return recon.control_totals(deposits(spark, d))


@query
def source_totals(spark, d):
    return recon.source_totals(deposits(spark, d))


@query
def backfill_affected(spark, d):
    return backfill.affected(_history(spark, d)[0], "user_id", *_window())


@query
def backfill_unwind(spark, d):
    """The history as if nothing had come between two commit times."""
    dim, log = _history(spark, d)
    _, lsns = backfill.rewind(log, *_window())
    return backfill.unwind(dim, events(spark, d), log, lsns, "user_id", ["band"], ["note"])[0].select(*DIM)


@query
def backfill_restate(spark, d):
    """The events between two commit times come again with the next band."""
    e = events(spark, d)
    dim, log = _history(spark, d)
    corrected = e.where((F.col("commit_ts") >= _window()[0]) & (F.col("commit_ts") < _window()[1])).withColumn("band", F.col("band") + 1)
    return backfill.restate(dim, e, log, corrected, *_window(), "user_id", ["band"], ["note"])[0].select(*DIM)


@query
def backfill_delta(spark, d):
    """Control totals before and after a range is restated."""
    facts = deposits(spark, d).select("deposit_id", "client_id", date_key("deposit_date").alias("date_key"), "amount_usd")
    inside = F.col("date_key").between(19950101, 19950331)
    after = upsert.replace_range(facts, facts.where(inside & (F.col("deposit_id") % 4 != 0)), inside)
    return backfill.delta(backfill.totals(facts, 19950101, 19950331), backfill.totals(after, 19950101, 19950331))


@query
def top_n_recent(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20).select("o_orderkey", "o_orderdate")


@query
def having_dups(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query
def business_rollup(spark, d):
    """Net deposits by country and segment."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("client_id"), "n_name", "c_mktsegment")
    clean = dq.split(_checked(spark, d))[0]
    return clean.join(c, "client_id").groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_deposits"), F.sum(F.col("amount_usd") - F.col("fee_usd")).cast("decimal(18,2)").alias("net_amount"))


@query
def partner_rollup(spark, d):
    """A partner is a region: net deposits by partner and segment, with subtotals."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("client_id"), F.col("r_name").alias("partner"), "c_mktsegment")
    clean = dq.split(_checked(spark, d))[0]
    return clean.join(c, "client_id").rollup("partner", "c_mktsegment").agg(F.count("*").alias("n_deposits"), F.sum(F.col("amount_usd") - F.col("fee_usd")).cast("decimal(18,2)").alias("net_amount"))


@query
def referral_rollup(spark, d):
    """Clients were referred by the client with a tenth of their number."""
    clean = dq.split(_checked(spark, d))[0]
    return clean.groupBy(F.floor(F.col("client_id") / 10).alias("referrer")).agg(F.count_distinct("client_id").alias("clients"), F.sum(F.col("amount_usd") - F.col("fee_usd")).cast("decimal(18,2)").alias("net_amount"))


@query
def having_global(spark, d):
    """One row if any deposit has no amount, else none."""
    return deposits(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(F.col("amount_usd").isNull()).alias("n_null")).where("n_null > 0")


@query
def validation_rows(spark, d):
    """Counts and totals of three tables, one row each."""
    clean = dq.split(_checked(spark, d))[0]
    t = _trades(spark, d)
    row = lambda name, df, total: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(total).cast("decimal(24,2)").alias("total"))
    return row("clients", clients(spark, d), F.lit(0)).unionByName(row("fact_deposit", clean, F.col("amount_usd"))).unionByName(row("fact_trade", t, F.col("pnl_usd_reported")))


def _velocity(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return bronze.velocity(e, "user_id", "ts", "value").withColumn("total", F.col("total").cast("decimal(18,2)"))


@query
def velocity_features(spark, d):
    return _velocity(spark, d)


@query
def score_divergence(spark, d):
    scored = bronze.score(_velocity(spark, d))
    live = scored.withColumn("risk", F.when(F.col("user_id") % 10 == 0, F.col("risk") + 0.5).otherwise(F.col("risk")))
    return bronze.divergence(scored, live, ["user_id", "window_start"]).select("user_id", "window_start")
