"""Operators on small invented data: each defect class and its handling."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lakeward.operators import control, dq, recon, scd2, star, upsert
from lakeward.operators.contract import Blocked, Contract, normalise
from lakeward.plans import runner
from lakeward.sources import ingest
from lakeward.sources.files import exclusive
from lakeward.sources.store import Store
from lakeward.streaming import bronze

CONTRACT = Contract({"deposit_id": "string", "amount_usd": "decimal(18,2)", "payment_method": "string"}, ("deposit_id",), {"method": "payment_method", "amount": "amount_usd"}, {"credit_card": "payment_method"})
EVENTS = "lsn long, k long, commit_ts timestamp_ntz, op string, a string, b string"


def test_alias_recovery_and_block(spark):
    df = spark.createDataFrame([("D1", "1.5", None, "CARD"), ("D2", "x", "wire", None)], "deposit_id string, amount string, method string, credit_card string")
    got = {r.deposit_id: r for r in normalise(df, CONTRACT).collect()}
    assert got["D1"].payment_method == "CARD" and got["D1"]._recovered
    assert got["D2"].amount_usd is None and not got["D2"]._recovered
    with pytest.raises(Blocked):
        normalise(df.withColumn("surprise", F.lit(1)), CONTRACT)


def test_csv_headers_differ(spark, tmp_path):
    (tmp_path / "v_20240301.csv").write_text("deposit_id,amount_usd,payment_method\nD1,10.00,card\n")
    (tmp_path / "v_20240302.csv").write_text("method,deposit_id,amount\nwire,D2,20.00\n")
    got = {r.deposit_id: (str(r.amount_usd), r.payment_method, r._source_file) for r in ingest.read_csv_by_header(spark, str(tmp_path), CONTRACT).collect()}
    assert got == {"D1": ("10.00", "card", "v_20240301.csv"), "D2": ("20.00", "wire", "v_20240302.csv")}
    (tmp_path / "v_20240303.csv").write_text("deposit_id,surprise\nD3,1\n")
    with pytest.raises(Blocked):
        ingest.read_csv_by_header(spark, str(tmp_path), CONTRACT)


def test_json_array_and_lineage(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    df = ingest.with_lineage(ingest.read_json_array(spark, str(tmp_path), "id long"), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    got = df.collect()
    assert sorted(r.id for r in got) == [1, 2] and got[0]._source_file.endswith("a.json") and str(got[0].delta_created_dt) == "2024-03-01"


def test_manifest_pending_drain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f_20240302.csv").write_text("a\n1\n")
    assert len(ingest.pending(spark, str(tmp_path / "in"), ".csv", "20240302")) == 1 and ingest.pending(spark, str(tmp_path / "in"), ".csv", "2025") == []
    found = ingest.file_hashes(spark, str(tmp_path / "in"))
    none = spark.createDataFrame([], "source_file string, file_hash string, ingest_count int")
    first = control.register_files(found, none)
    assert [r.status for r in first.collect()] == ["INGESTED"]
    assert [r.status for r in control.register_files(found, first).collect()] == ["SKIPPED_DUPLICATE"]
    assert ingest.drain(spark, ingest.pending(spark, str(tmp_path / "in"), ".csv"), str(tmp_path / "archive"), "t", "20240302000000") == []
    assert ingest.pending(spark, str(tmp_path / "in"), ".csv") == [] and (tmp_path / "archive" / "t" / "20240302000000" / "f_20240302.csv").exists()
    assert spark.range(1).select(control.label_date(F.lit("f_20240302.csv"))).first()[0] == dt.date(2024, 3, 2)


def test_watermark_blocks_without_success(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, ts int")
    master = spark.createDataFrame([("t", "SUCCESS", 20), ("u", "FAILED", 20)], "table_name string, last_load_status string, latest_loaded_ts int")
    assert [r.id for r in control.read_at_watermark(df, master, "t", "ts").collect()] == [2]
    for name in ("u", "none"):
        with pytest.raises(Blocked):
            control.read_at_watermark(df, master, name, "ts")


def test_null_amount_is_quarantined_and_block_stops(spark):
    df = spark.createDataFrame([("D1", None), ("D2", -1.0), ("D3", 0.0), ("D4", 2.0)], "id string, amount double")
    rule = dq.Rule("amount_positive", dq.QUARANTINE, F.col("amount").isNull() | (F.col("amount") <= 0), F.col("amount").cast("string"))
    checked = dq.evaluate(df, [rule])
    clean, held = dq.split(checked)
    assert [r.id for r in clean.collect()] == ["D4"] and held.count() == 3
    dq.stop_if_blocked(checked)
    with pytest.raises(Blocked):
        dq.stop_if_blocked(dq.evaluate(df, [dq.Rule("x", dq.BLOCK, F.col("id") == "D1", F.lit(""))]))


def test_merge_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    s = spark.createDataFrame([(2, "c"), (3, "d")], "k int, h string")
    once = upsert.merge(t, s, ["k"], "h")
    assert {r.action: r.n for r in upsert.actions(once).collect()} == {"kept": 1, "update": 1, "insert": 1}
    again = upsert.merge(once.drop("_action"), s, ["k"], "h")
    assert {r.action: r.n for r in upsert.actions(again).collect()} == {"kept": 1, "unchanged": 2}
    for bad in (s.union(s), spark.createDataFrame([(None, "x")], "k int, h string")):
        with pytest.raises(Blocked):
            upsert.merge(t, bad, ["k"], "h")
    assert upsert.changed(once) and not upsert.changed(again)


def _sequential(events):
    """Event by event, as plain Python."""
    dim, cur = [], {}
    for lsn, k, ts, op, a, b in sorted(events):
        c = cur.get(k)
        if op == "delete":
            if c is None:
                continue
            new = dict(c, lsn=lsn, ts=ts, deleted=True)
        else:
            na = a if a is not None else (c["a"] if c else None)
            nb = b if b is not None else (c["b"] if c else None)
            if c and not c["deleted"] and na == c["a"]:
                continue
            new = {"lsn": lsn, "ts": ts, "a": na, "b": nb, "deleted": False}
        cur[k] = new
        dim.append((k, lsn, new["a"], new["b"], new["deleted"]))
    return sorted(dim, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_history_any_order_and_batches(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    ev = [(i, rnd.randint(1, 6), base + dt.timedelta(minutes=i), rnd.choice(["insert", "update", "update", "delete"]), rnd.choice([None, "x", "y"]), rnd.choice([None, "p", "q"])) for i in range(1, 60)]
    ev = [(i, k, t, op, None if op == "delete" else a, None if op == "delete" else b) for i, k, t, op, a, b in ev]
    shuffled = ev[:]
    rnd.shuffle(shuffled)
    want = _sequential(ev)
    show = lambda d: sorted(((r.k, r.source_lsn, r.a, r.b, r.is_deleted) for r in d.collect()), key=str)
    dim, log = scd2.build(spark.createDataFrame(shuffled, EVENTS), "k", ["a"], ["b"])
    assert show(dim) == want and log.count() == len(ev)
    assert all(r.violations == 0 for r in scd2.invariants(dim, "k").collect())
    first, rest = spark.createDataFrame(shuffled[:30], EVENTS), spark.createDataFrame(shuffled[30:], EVENTS)
    d1, l1 = scd2.build(first, "k", ["a"], ["b"])
    d2, l2 = scd2.apply(d1, first, rest, l1, "k", ["a"], ["b"])
    assert show(d2) == want
    d3, _ = scd2.apply(d2, first.union(rest), rest, l2, "k", ["a"], ["b"])
    assert show(d3) == want


def test_equal_commit_times_keep_highest_lsn(spark):
    t = dt.datetime(2024, 1, 1)
    dim, log = scd2.build(spark.createDataFrame([(1, 1, t, "insert", "x", None), (2, 1, t, "update", "y", None)], EVENTS), "k", ["a"], ["b"])
    assert [r.source_lsn for r in dim.collect()] == [2]
    assert {r.lsn: r.action_taken for r in log.collect()} == {1: "superseded_same_ts", 2: "new_version"}


def test_reconciliation_tolerance_is_strict(spark):
    schema = "deposit_id long, client_id long, deposit_date date, amount_usd decimal(18,2)"
    from decimal import Decimal as D

    day = dt.date(2024, 3, 1)
    v = spark.createDataFrame([(1, 1, day, D("5.00")), (2, 2, day, D("7.00")), (3, 3, day, D("9.00"))], schema)
    w = spark.createDataFrame([(1, 1, day, D("5.00")), (12, 2, day, D("7.00")), (13, 3, day, D("9.01")), (14, 3, dt.date(2023, 1, 1), D("1.00"))], schema)
    one = recon.tier1(v, w)
    two = recon.tier2(v, w, one)
    assert [r.vendor_id for r in one.collect()] == [1] and [r.vendor_id for r in two.collect()] == [2]
    assert sorted(map(tuple, recon.unmatched(v, w).collect())) == sorted(map(tuple, recon.breaks(v, w, one.union(two)).collect()))
    got = sorted((r.break_type, r.deposit_id, str(r.variance_usd)) for r in recon.breaks(v, w, one.union(two)).collect())
    assert got == [("VENDOR_ONLY", 3, "9.00"), ("WAREHOUSE_ONLY", 13, "-9.01")]


def test_stub_keeps_its_key(spark):
    dim = spark.createDataFrame([(1,)], "client_id long")
    facts = spark.createDataFrame([(1,), (2,), (None,)], "client_id long")
    stubs = star.infer_members(dim, facts, "client_id", {"status": F.lit("unknown")})
    up = star.upgrade_stubs(stubs, spark.createDataFrame([(2, "approved")], "client_id long, status string"), "client_id", ["status"])
    a, b = stubs.first(), up.first()
    assert (a.client_id, b.client_id, a.sk) == (2, 2, b.sk) and b.status == "approved" and not b.is_inferred


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    a = spark.range(5)
    assert s.version() == 0 and not s.has("t")
    s.commit_bundle({"t": a, "log": a})
    s.append("t", spark.range(5, 7).withColumn("extra", F.lit(1)))
    assert s.read("t").count() == 7 and s.read("t", 1).count() == 5 and s.read("log").count() == 5
    s.replace("t", spark.range(0).withColumn("extra", F.lit(1)), F.col("id") < 3)
    assert s.read("t").count() == 4
    s.restore(1)
    assert s.read("t").count() == 5 and s.version() == 4


def test_stream_is_audited_and_captures_once(spark, tmp_path):
    src, sink, audit = (tmp_path / n for n in ("src", "sink", "audit"))
    src.mkdir()
    (src / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    go = lambda: bronze.start(bronze.read_files(spark, str(src), "k long"), "q", str(sink), str(audit), str(tmp_path / "cp"))
    bronze.await_all([go()])
    (src / "b.json").write_text('{"k": 3}\n')
    bronze.await_all([go()])
    bronze.await_all([go()])
    assert sorted(r.k for r in spark.read.parquet(str(sink)).collect()) == [1, 2, 3]
    assert sorted(r.records_processed for r in spark.read.parquet(f"{audit}/q/*").collect()) == [1, 2]
    with pytest.raises(ValueError):
        bronze.trigger("now and then")


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    a.write("t", spark.range(5))
    base = b.version()
    a.append("t", spark.range(100, 102))
    with pytest.raises(RuntimeError):
        b.commit_bundle({"t": spark.range(50, 55)}, base=base)
    assert sorted(r.id for r in a.read("t").collect()) == [0, 1, 2, 3, 4, 100, 101]
    assert len(list((tmp_path / "store" / "t").iterdir())) == 2


def test_append_and_replace_leave_other_folders(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write("t", spark.range(10).withColumn("p", F.col("id") % 2), ["p"])
    first = s._state(1)["t"]
    s.append("t", spark.range(10, 20).withColumn("p", F.lit(7).cast("long")))
    assert s._state(2)["t"][:1] == first and spark.read.parquet(s._state(2)["t"][1]["path"]).count() == 10
    s.replace("t", spark.range(100, 101).withColumn("p", F.lit(0).cast("long")), F.col("id") >= 15)
    assert s._state(3)["t"][:1] == first
    assert sorted(r.id for r in s.read("t").collect()) == [*range(15), 100]


def test_gaps_of_far_apart_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3_000_000_000, -5, 70_000, 1 << 62)], "lsn long")
    got = sorted(tuple(r) for r in scd2.lsn_gaps(rows).collect())
    assert got == [(-5, 1), (2, 70_000), (70_000, 3_000_000_000), (3_000_000_000, 1 << 62)]
    planted = control.sequence_gaps(spark.range(40).where("id % 5 <> 0"), F.col("id"))
    assert sorted(r.after for r in planted.collect()) == [4, 9, 14, 19, 24, 29, 34]
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS day").where("day(day) NOT IN (3, 4, 20)")
    assert sorted(r.day.day for r in control.missing_days(days, "day").collect()) == [3, 4, 20]


def test_partial_images_at_one_time(spark):
    t = dt.datetime(2024, 1, 1)
    dim, _ = scd2.build(spark.createDataFrame([(1, 1, t, "insert", "x", None), (2, 1, t, "update", "y", "p"), (3, 1, t, "update", None, "q")], EVENTS), "k", ["a", "b"], [])
    assert [(r.a, r.b) for r in dim.collect()] == [("y", "q")]


def test_as_of_equals_a_range_join(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    cuts = {k: sorted(rnd.sample(range(50), 5)) for k in range(4)}
    versions = [(k, base + dt.timedelta(hours=a), base + dt.timedelta(hours=b), a) for k, c in cuts.items() for a, b in zip(c, c[1:], strict=False)]
    dim = spark.createDataFrame([*versions, (None, base, base + dt.timedelta(hours=9), -1)], "k int, valid_from timestamp_ntz, valid_to timestamp_ntz, v int")
    facts = [(i, rnd.choice([0, 1, 2, 3, 9, None]), base + dt.timedelta(hours=rnd.randint(-2, 60))) for i in range(80)]
    got = {r.i: r.v for r in scd2.as_of(spark.createDataFrame(facts, "i int, k int, at timestamp_ntz"), dim, "k", "at", ["v"]).collect()}
    assert got == {i: next((v for kk, a, b, v in versions if kk == k and a <= at < b), None) for i, k, at in facts}


def test_csv_edges(spark, tmp_path):
    assert ingest.read_csv_by_header(spark, str(tmp_path), CONTRACT, number_rows=True).collect() == []
    (tmp_path / "q.csv").write_text('"deposit_id","amount_usd","payment_method"\nD1,1.00,card\nD2,2.00,"a,b"\n')
    got = sorted((r._row_number, r.deposit_id, r.payment_method) for r in ingest.read_csv_by_header(spark, str(tmp_path), CONTRACT, number_rows=True).collect())
    assert got == [(1, "D1", "card"), (2, "D2", "a,b")]


def test_load_attempts(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    (tmp_path / "a.csv").write_text("x")
    tries = [ingest.load(spark, "none", str(tmp_path / "nothing"), ".csv", lambda f: 1, at), ingest.load(spark, "ok", str(tmp_path), ".csv", lambda f: 7, at), ingest.load(spark, "bad", str(tmp_path), ".csv", lambda f: 1 // 0, at)]
    history = control.attempts(tries[0].union(tries[1]).union(tries[2]))
    assert {r.table_name: (r.load_status, r.records_loaded) for r in history.collect()} == {"none": ("NO_FILES", 0), "ok": ("SUCCESS", 7), "bad": ("FAILED", 0)}
    master = spark.createDataFrame([("bad", "SUCCESS", dt.datetime(2024, 1, 1), 3)], "table_name string, last_load_status string, latest_loaded_ts timestamp, total_records long")
    got = {r.table_name: r for r in control.update_master(master, history).collect()}
    assert set(got) == {"ok", "bad"} and got["bad"].last_load_status == "FAILED" and got["bad"].latest_loaded_ts == dt.datetime(2024, 1, 1)


def test_nested_change_log(spark, tmp_path):
    lines = [{"lsn": 1, "op": "insert", "before": None, "after": {"k": 1, "a": "x"}}, {"lsn": 2, "op": "delete", "before": {"k": 1, "a": "x"}, "after": None}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    image = "struct<k: long, a: string>"
    got = ingest.flatten_images(ingest.read_cdc(spark, str(tmp_path), f"lsn long, op string, before {image}, after {image}"), ["k", "a"]).orderBy("lsn").collect()
    assert [(r.lsn, r.op, r.k, r.a) for r in got] == [(1, "insert", 1, "x"), (2, "delete", 1, "x")]


def test_stream_rescues_and_reads_headers(spark, tmp_path):
    js, cs = tmp_path / "js", tmp_path / "cs"
    js.mkdir()
    cs.mkdir()
    (js / "a.json").write_text('{"k": 1, "new": "z"}\n{"k": 2}\n')
    (cs / "a.csv").write_text("deposit_id,amount_usd\nD1,1.00\n")
    (cs / "b.csv").write_text("amount,deposit_id\n2.00,D2\n")
    a = bronze.start(bronze.read_files(spark, str(js), "k long"), "js", str(tmp_path / "o1"), str(tmp_path / "a1"), str(tmp_path / "c1"))
    b = bronze.start(bronze.read_csv_files(spark, str(cs)), "cs", str(tmp_path / "o2"), str(tmp_path / "a2"), str(tmp_path / "c2"), transform=bronze.by_header(CONTRACT))
    bronze.await_all([a, b])
    assert {r.k: r._rescued for r in spark.read.parquet(str(tmp_path / "o1")).collect()} == {1: '{"new":"z"}', 2: None}
    assert {r.deposit_id: str(r.amount_usd) for r in spark.read.parquet(str(tmp_path / "o2")).collect()} == {"D1": "1.00", "D2": "2.00"}
    now = dt.datetime(2024, 1, 3)
    assert bronze.overdue({"old": dt.datetime(2024, 1, 1), "new": dt.datetime(2024, 1, 2, 12)}, now) == ["old"]


def test_velocity_with_a_watermark_equals_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, m), 2.0) for m in (1, 30, 59)] + [(1, dt.datetime(2024, 1, 1, 5), 1.0)]
    schema = "k int, ts timestamp, v double"
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(str(tmp_path / "in"))
    live = bronze.velocity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", "v", late="1 hour")
    q = live.writeStream.format("memory").queryName("vel").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    bronze.await_all([q])
    batch = {tuple(r) for r in bronze.velocity(frame, "k", "ts", "v").collect()}
    closed = {tuple(r) for r in spark.table("vel").collect()}
    assert closed <= batch and len(closed) == 1


def test_second_run_is_refused(spark, tmp_path):
    lock = str(tmp_path / "lock")
    with exclusive(spark, lock):
        with pytest.raises(RuntimeError), exclusive(spark, lock):
            pass
    with exclusive(spark, lock):
        assert runner.Stage("bronze", lambda r: r).retries is None


def test_runner_retries():
    calls = []

    def flaky(run_id):
        calls.append(run_id)
        if len(calls) < 2:
            raise OSError
        return "ok"

    done = runner.run([runner.Stage("a", flaky, retries=1), runner.Stage("b", lambda r: r, after=("a",))], "r1")
    assert done["a"]["attempts"] == 2 and done["b"]["result"] == "r1"
    with pytest.raises(ValueError):
        runner.run([runner.Stage("b", lambda r: r, after=("a",))])
