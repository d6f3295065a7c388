"""DuckDB SQL for the queries of ``lakeward.plans.queries``."""

from __future__ import annotations

DEP = """dep0 AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS money FROM orders),
dep AS (SELECT k AS deposit_id, o_custkey AS client_id, day AS deposit_date,
  CASE WHEN k % 41 = 0 THEN -money WHEN k % 43 = 0 THEN NULL ELSE money END AS amount_usd,
  CAST(round(money * CASE WHEN k % 37 = 0 THEN 0.02 ELSE 0.01 END, 2) AS DECIMAL(18,2)) AS fee_usd,
  CASE WHEN k % 29 <> 0 THEN o_orderpriority END AS payment_method,
  CASE WHEN k % 2 = 0 THEN 'VENDOR' ELSE 'WAREHOUSE' END AS source_system FROM dep0),
cli AS (SELECT c_custkey AS client_id, CAST(DATE '1992-01-01' + CAST(c_custkey % 2400 AS INT) AS DATE) AS signup_date,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'pending' ELSE 'approved' END AS kyc_status FROM customer WHERE c_custkey % 50 <> 0)"""

DQ = f"""{DEP}, j AS (SELECT dep.*, signup_date, kyc_status FROM dep LEFT JOIN cli USING (client_id)),
q AS (SELECT *, amount_usd IS NULL OR amount_usd <= 0 AS f1, signup_date IS NULL AS f2, payment_method IS NULL AS f3 FROM j),
ev AS (
  SELECT deposit_id, 'amount_positive' AS check_name, 'QUARANTINE' AS severity, 'amount=' || coalesce(CAST(amount_usd AS VARCHAR), 'null') AS detail FROM q WHERE f1
  UNION ALL SELECT deposit_id, 'client_exists', 'QUARANTINE', 'client=' || CAST(client_id AS VARCHAR) FROM q WHERE f2
  UNION ALL SELECT deposit_id, 'payment_method_present', 'QUARANTINE', 'payment_method=null' FROM q WHERE f3
  UNION ALL SELECT deposit_id, 'deposit_not_before_signup', 'WARN', 'signup=' || CAST(signup_date AS VARCHAR) FROM q WHERE deposit_date < signup_date
  UNION ALL SELECT deposit_id, 'fee_within_tolerance', 'WARN', 'fee=' || CAST(fee_usd AS VARCHAR) FROM q WHERE amount_usd > 0 AND fee_usd > 0 AND abs(fee_usd - amount_usd * 0.01) > amount_usd * 0.002
  UNION ALL SELECT deposit_id, 'kyc_approved_for_deposit', 'WARN', 'kyc=' || kyc_status FROM q WHERE kyc_status <> 'approved')"""

HELD = f"""{DQ}, held AS (SELECT deposit_id, deposit_date, concat_ws(' | ', CASE WHEN f1 THEN 'amount_positive' END, CASE WHEN f2 THEN 'client_exists' END, CASE WHEN f3 THEN 'payment_method_present' END) AS failed_checks, f1, f3 FROM q WHERE f1 OR f2 OR f3)"""

FEEDS = f"""{DEP}, base AS (SELECT * FROM dep WHERE amount_usd IS NOT NULL), v AS (SELECT * FROM base WHERE deposit_id % 5 <> 0),
w AS (SELECT CASE WHEN deposit_id % 2 = 0 THEN deposit_id ELSE deposit_id + 100000000 END AS deposit_id, client_id, deposit_date, CAST(CASE WHEN deposit_id % 3 = 0 THEN amount_usd + 0.01 ELSE amount_usd END AS DECIMAL(18,2)) AS amount_usd FROM base WHERE deposit_id % 7 <> 0),
t1 AS (SELECT 1 AS match_tier, v.deposit_id AS vendor_id, w.deposit_id AS warehouse_id, v.client_id, v.deposit_date, v.amount_usd AS amount_vendor, w.amount_usd AS amount_warehouse, CAST(v.amount_usd - w.amount_usd AS DECIMAL(18,2)) AS variance_usd FROM v JOIN w USING (deposit_id)),
t2 AS (SELECT 2 AS match_tier, v.deposit_id AS vendor_id, w.deposit_id AS warehouse_id, v.client_id, v.deposit_date, v.amount_usd AS amount_vendor, w.amount_usd AS amount_warehouse, CAST(v.amount_usd - w.amount_usd AS DECIMAL(18,2)) AS variance_usd FROM v JOIN w ON v.client_id = w.client_id AND v.deposit_date = w.deposit_date AND abs(v.amount_usd - w.amount_usd) < 0.01
  WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.vendor_id = v.deposit_id) AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.warehouse_id = w.deposit_id)),
m AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
b AS (SELECT 'VENDOR_ONLY' AS break_type, deposit_id, client_id, deposit_date, CAST(amount_usd AS DECIMAL(18,2)) AS variance_usd FROM v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.vendor_id = v.deposit_id)
  UNION ALL SELECT 'WAREHOUSE_ONLY', deposit_id, client_id, deposit_date, CAST(-amount_usd AS DECIMAL(18,2)) FROM w WHERE deposit_date BETWEEN (SELECT min(deposit_date) FROM v) AND (SELECT max(deposit_date) FROM v) AND NOT EXISTS (SELECT 1 FROM m WHERE m.warehouse_id = w.deposit_id))"""

EVENTS = """ev AS (SELECT event_id AS lsn, user_id, ts AS commit_ts, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_type IN ('view','error') THEN NULL ELSE CAST(floor(value / 25) AS BIGINT) END AS band, CASE WHEN event_type IN ('view','error') THEN NULL ELSE props END AS note FROM events)"""


def history(log: str) -> str:
    """The history of the events in ``ev`` as ``log`` defines it: alog and dim."""
    return f"""{log},
s1 AS (SELECT *, op = 'delete' AND coalesce(max(CASE WHEN op <> 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ignored FROM ev),
s2 AS (SELECT lsn, user_id, commit_ts, op, note, ignored, last_value(band IGNORE NULLS) OVER (PARTITION BY user_id, ignored ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, ignored ORDER BY lsn) > 1 AND op <> 'delete' AND lag(op) OVER (PARTITION BY user_id, ignored ORDER BY lsn) <> 'delete' AND band IS NOT DISTINCT FROM lag(band) OVER (PARTITION BY user_id, ignored ORDER BY lsn) AS noop FROM s2),
s4 AS (SELECT *, last_value(note IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, EXISTS (SELECT 1 FROM s3 l WHERE l.user_id = s3.user_id AND l.commit_ts = s3.commit_ts AND l.lsn > s3.lsn AND NOT l.ignored AND NOT l.noop) AS gone FROM s3 WHERE NOT ignored AND NOT noop),
alog AS (SELECT lsn, user_id, op, commit_ts, CASE WHEN ignored THEN 'delete_for_unknown_key_ignored' WHEN noop THEN 'no_change_noop' WHEN lsn IN (SELECT lsn FROM s4 WHERE gone) THEN 'superseded_same_ts' WHEN op = 'delete' THEN 'soft_delete_tombstone' ELSE 'new_version' END AS action_taken FROM s3),
dim AS (SELECT sha256(CAST(user_id AS VARCHAR) || '|' || CAST(commit_ts AS VARCHAR)) AS sk, sha256(coalesce(CAST(band AS VARCHAR), '')) AS record_hash, user_id, band, held AS note, commit_ts AS valid_from,
  coalesce(lead(commit_ts) OVER (PARTITION BY user_id ORDER BY lsn), TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(commit_ts) OVER (PARTITION BY user_id ORDER BY lsn) IS NULL AS is_current, op = 'delete' AS is_deleted, lsn AS source_lsn, op AS source_op FROM s4 WHERE NOT gone)"""


HISTORY = history(EVENTS)
EVENTS0 = EVENTS.replace("ev AS", "ev0 AS", 1)
INSIDE = "commit_ts >= TIMESTAMP '2024-01-01 06:00:00' AND commit_ts < TIMESTAMP '2024-01-03 00:00:00'"
UNWOUND = history(f"{EVENTS0}, ev AS (SELECT * FROM ev0 WHERE NOT ({INSIDE}))")
RESTATED = history(f"{EVENTS0}, ev AS (SELECT lsn, user_id, commit_ts, op, CASE WHEN {INSIDE} THEN band + 1 ELSE band END AS band, note FROM ev0)")
SAME_TS = history(f"{EVENTS0}, ev AS (SELECT lsn, user_id, date_trunc('day', commit_ts) AS commit_ts, op, band, note FROM ev0)")
SEEDED = history(f"{EVENTS0}, ev AS (SELECT 0::BIGINT AS lsn, c_custkey AS user_id, TIMESTAMP '1900-01-01 00:00:00' AS commit_ts, 'seed' AS op, c_nationkey::BIGINT AS band, c_mktsegment AS note FROM customer UNION ALL SELECT lsn + 1, user_id, commit_ts, op, band, note FROM ev0)")
REFS = f"{DEP}, refs AS (SELECT dep.*, CASE WHEN deposit_id % 83 = 0 THEN ' ' WHEN deposit_id % 89 = 0 THEN NULL WHEN deposit_id % 53 = 0 THEN 'dep-' || deposit_id ELSE 'DEP' || deposit_id END AS deposit_ref FROM dep)"
ATTEMPTS = """x AS (SELECT o_orderpriority AS table_name, make_date(year(o_orderdate), 12, 31) AS load_ts, count(*) FILTER (o_totalprice > 400000) AS n_files, count(*) AS n_rows, CASE WHEN max(o_totalprice) > 499000 THEN 'too dear' END AS error_message FROM orders GROUP BY 1, 2),
h AS (SELECT table_name, load_ts, CASE WHEN error_message IS NOT NULL THEN 'FAILED' WHEN n_files = 0 THEN 'NO_FILES' ELSE 'SUCCESS' END AS load_status, n_files, CAST(CASE WHEN error_message IS NULL AND n_files > 0 THEN n_rows ELSE 0 END AS BIGINT) AS records_loaded, error_message FROM x)"""
MANIFEST = """f AS (SELECT strftime(o_orderdate, '%Y%m') AS source_file, sha256(CAST(count(*) AS VARCHAR)) AS file_hash FROM orders GROUP BY 1),
man AS (SELECT source_file, file_hash, CAST(CASE WHEN CAST(source_file AS INT) % 3 = 0 THEN 2 ELSE 1 END AS INT) AS ingest_count, CASE WHEN CAST(source_file AS INT) % 3 <> 0 THEN 'INGESTED' WHEN CAST(source_file AS INT) % 2 = 0 THEN 'SKIPPED_DUPLICATE' ELSE 'RE_INGESTED_CORRECTION' END AS status FROM f UNION ALL SELECT '190001', 'old', 1, 'NOT_DELIVERED')"""

SNAP = f"""{HISTORY}, snap AS (SELECT CAST(strftime(s.day, '%Y%m%d') AS INT) AS date_key, user_id, band, is_deleted FROM dim JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) s ON s.day >= CAST(valid_from AS DATE) AND s.day < CAST(valid_to AS DATE))"""

TRADES = """one AS (SELECT l_orderkey, l_linenumber, min(struct_pack(a := l_partkey, b := l_quantity, c := l_extendedprice, d := l_linestatus, e := l_returnflag)) AS r FROM lineitem GROUP BY ALL),
tr AS (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS trade_id, r.e AS instrument, CASE WHEN r.d = 'O' THEN 1 ELSE -1 END AS sign, CAST(r.b AS DECIMAL(9,2)) AS lots, CAST(p_retailprice AS DECIMAL(18,4)) AS open_price, CAST(r.c AS DECIMAL(18,4)) AS close_price,
  CASE r.e WHEN 'A' THEN CAST(100 AS DECIMAL(3,0)) WHEN 'N' THEN CAST(10 AS DECIMAL(3,0)) END AS size, o_custkey, CAST(o_orderdate AS DATE) AS day FROM one JOIN part ON r.a = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey),
ft AS (SELECT *, CAST(round((close_price - open_price) * size * lots, 2) * sign AS DECIMAL(18,2)) AS pnl_usd_derived FROM tr),
fact AS (SELECT *, CAST(coalesce(pnl_usd_derived, 0) + CASE WHEN l_orderkey % 31 = 0 THEN 245.00 ELSE 0.00 END AS DECIMAL(18,2)) AS pnl_usd_reported FROM ft),
tf AS (SELECT *, CAST(pnl_usd_reported - pnl_usd_derived AS DECIMAL(18,2)) AS pnl_variance_usd FROM fact)"""

MERGE = """t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + 1 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 3 = 0),
mg AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN t.amount ELSE s.amount END AS amount, CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'kept' WHEN s.amount = t.amount THEN 'unchanged' ELSE 'update' END AS action FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey)"""

VELOCITY = """vel AS (SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY ALL)"""

NET = "CAST(sum(amount_usd - fee_usd) AS DECIMAL(18,2)) AS net_amount"

ORACLES: dict[str, str] = {
    "net_by_day": f"WITH {DQ} SELECT deposit_date, source_system, count(*) AS n_deposits, {NET} FROM q WHERE NOT (f1 OR f2 OR f3) GROUP BY ALL",
    "typed_projection": "SELECT o_orderkey, CAST(NULL AS INT) AS bad, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders",
    "row_hash_null_safe": f"WITH {DEP} SELECT deposit_id, sha256(concat_ws('|', CAST(deposit_id AS VARCHAR), CAST(client_id AS VARCHAR), coalesce(payment_method, ''), coalesce(CAST(amount_usd AS VARCHAR), ''))) AS row_hash FROM dep",
    "alias_coalesce": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'CARD' END AS payment_method, o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AS recovered FROM orders",
    "watermark_read": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "load_manifest": f"WITH {MANIFEST} SELECT * FROM man",
    "file_lag": "WITH x AS (SELECT last_day(l_shipdate) AS l, CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT l AS file_label_date, count(*) AS row_count, min(d) AS min_event_date, max(d) AS max_event_date, CAST(date_diff('day', max(d), l) AS INT) AS lag_days, date_diff('day', max(d), l) > 1 AS is_late FROM x GROUP BY l",
    "missing_days": "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(g AS DATE) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS g FROM x) WHERE CAST(g AS DATE) NOT IN (SELECT day FROM x)",
    "sequence_gaps": "SELECT n AS after, nx AS before FROM (SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)) WHERE nx > n + 1",
    "dq_evidence": f"WITH {DQ} SELECT CAST(deposit_id AS VARCHAR) AS record_key, check_name, severity, lower(severity) AS on_failure, detail FROM ev",
    "dq_summary": f"WITH {DQ} SELECT severity, check_name, count(*) AS n FROM ev GROUP BY ALL",
    "dq_clean": f"WITH {DQ} SELECT deposit_id, client_id, amount_usd FROM q WHERE NOT (f1 OR f2 OR f3)",
    "dq_quarantine": f"WITH {HELD} SELECT deposit_id, failed_checks FROM held",
    "quarantine_release": f"WITH {HELD} SELECT deposit_id, failed_checks, CASE WHEN NOT (f1 OR f3) THEN DATE '2000-01-01' END AS resolved_at FROM held",
    "quarantine_new_only": f"WITH {HELD} SELECT deposit_id FROM held WHERE deposit_id % 2 <> 0",
    "quarantine_ageing": f"WITH {HELD} SELECT CASE WHEN a > 7 THEN 'ESCALATE' ELSE 'WAIT' END AS ageing_action, count(*) AS n, CAST(max(a) AS INT) AS oldest FROM (SELECT date_diff('day', deposit_date, DATE '2000-01-01') AS a FROM held) GROUP BY 1",
    "restatement_bound": f"WITH {DEP} SELECT count(*) FILTER (deposit_date >= DATE '1995-06-01' - 90) AS restatable, count(*) FILTER (deposit_date < DATE '1995-06-01' - 90) AS too_old FROM dep",
    "dedupe_last_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1",
    "merge_state": f"WITH {MERGE} SELECT o_orderkey, amount, sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(amount AS VARCHAR)) AS row_hash FROM mg",
    "merge_actions": f"WITH {MERGE} SELECT action, count(*) AS n FROM mg GROUP BY 1",
    "replace_where": f"WITH {DEP}, x AS (SELECT deposit_id, CAST(strftime(deposit_date, '%Y%m%d') AS INT) AS date_key, amount_usd FROM dep) SELECT * FROM x WHERE date_key NOT BETWEEN 19950101 AND 19950131 OR deposit_id % 2 = 0",
    "lsn_gaps": "SELECT n AS after, nx AS before FROM (SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM (SELECT DISTINCT epoch_us(ts) // 1000 AS n FROM events)) WHERE nx > n + 1",
    "replay_guard": f"WITH {EVENTS} SELECT lsn, user_id FROM ev WHERE lsn % 3 <> 0",
    "cdc_order": f"WITH {EVENTS} SELECT lsn, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY lsn) AS INT) AS seq, lead(commit_ts) OVER (PARTITION BY user_id ORDER BY lsn) AS next_commit FROM ev",
    "scd2_build": f"WITH {HISTORY} SELECT * FROM dim",
    "scd2_current": f"WITH {HISTORY} SELECT user_id, band, note, source_lsn FROM dim WHERE is_current AND NOT is_deleted",
    "scd2_tombstones": f"WITH {HISTORY} SELECT user_id, valid_from, source_lsn FROM dim WHERE is_deleted",
    "scd2_actions": f"WITH {HISTORY} SELECT action_taken, count(*) AS n FROM alog GROUP BY 1",
    "scd2_apply_log": f"WITH {HISTORY} SELECT lsn, user_id, op, action_taken FROM alog",
    "scd2_incremental": f"WITH {HISTORY} SELECT * FROM dim",
    "scd2_invariants": f"WITH {HISTORY} SELECT 'one_current' AS invariant, (SELECT count(*) FROM (SELECT user_id FROM dim WHERE is_current GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'contiguous', (SELECT count(*) FROM (SELECT lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from, source_lsn) AS nx, valid_to FROM dim) WHERE nx <> valid_to) UNION ALL SELECT 'positive_interval', (SELECT count(*) FROM dim WHERE NOT valid_from < valid_to)",
    "as_of_join": f"WITH {HISTORY} SELECT e.event_id, e.user_id, e.ts, dim.band, dim.source_lsn FROM events e LEFT JOIN dim ON e.user_id = dim.user_id AND e.ts >= valid_from AND e.ts < valid_to",
    "interval_overlap": f"WITH {HISTORY} SELECT user_id, valid_from, valid_to, source_lsn FROM dim WHERE valid_from < TIMESTAMP '2024-01-03 00:00:00' AND valid_to >= TIMESTAMP '2024-01-01 06:00:00'",
    "balance_snapshot": f"WITH {SNAP} SELECT * FROM snap",
    "aum_by_day": f"WITH {SNAP} SELECT date_key, CAST(sum(band) AS BIGINT) AS total_band, count(*) AS clients FROM snap WHERE NOT is_deleted GROUP BY 1",
    "inferred_members": f"WITH {DEP} SELECT DISTINCT sha256(CAST(client_id AS VARCHAR) || '|1900-01-01') AS sk, client_id, 'unknown' AS kyc_status, true AS is_inferred FROM dep WHERE client_id NOT IN (SELECT client_id FROM cli)",
    "stub_upgrade": f"WITH {DEP} SELECT DISTINCT sha256(CAST(client_id AS VARCHAR) || '|1900-01-01') AS sk, client_id, CASE WHEN client_id % 100 = 0 AND client_id IN (SELECT c_custkey FROM customer) THEN 'approved' ELSE 'unknown' END AS kyc_status, NOT (client_id % 100 = 0 AND client_id IN (SELECT c_custkey FROM customer)) AS is_inferred FROM dep WHERE client_id NOT IN (SELECT client_id FROM cli)",
    "dim_date": "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, monthname(d) AS month_name, CAST(dayofweek(d) + 1 AS INT) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend FROM x",
    "dim_payment_method": f"WITH {DEP} SELECT DISTINCT sha256(payment_method) AS payment_method_key, payment_method FROM dep WHERE payment_method IS NOT NULL",
    "fact_deposit": f"WITH {DQ} SELECT sha256(CAST(deposit_id AS VARCHAR) || '|' || source_system) AS deposit_sk, deposit_id, sha256(CAST(client_id AS VARCHAR) || '|1900-01-01') AS client_sk, client_id, CAST(strftime(deposit_date, '%Y%m%d') AS INT) AS date_key, sha256(payment_method) AS payment_method_key, source_system, amount_usd, fee_usd, CAST(amount_usd - fee_usd AS DECIMAL(18,2)) AS net_amount_usd FROM q WHERE NOT (f1 OR f2 OR f3)",
    "fact_trade": f"WITH {TRADES} SELECT sha256(trade_id) AS trade_sk, trade_id, sha256(CAST(o_custkey AS VARCHAR) || '|1900-01-01') AS client_sk, CAST(strftime(day, '%Y%m%d') AS INT) AS date_key, CASE WHEN instrument IN ('A', 'N') THEN sha256(instrument) END AS instrument_key, instrument, pnl_usd_reported, pnl_usd_derived, pnl_variance_usd FROM tf",
    "pnl_control": f"WITH {TRADES} SELECT trade_id, pnl_variance_usd FROM tf WHERE abs(pnl_variance_usd) > 0.01",
    "fx_normalise": "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS original, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 1.25 ELSE 0.91 END AS DECIMAL(7,6)) AS fx_rate, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * CASE WHEN c_nationkey % 2 = 0 THEN 1.250000 ELSE 0.910000 END, 2) AS DECIMAL(18,2)) AS usd FROM customer",
    "erase_personal": "SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS c_name, c_mktsegment FROM customer",
    "partner_view": "SELECT sha256('partner-1|' || sha256('partner-1|' || CAST(c_custkey AS VARCHAR))) AS client_token, c_mktsegment, c_custkey % 50 = 0 AS is_deleted, DATE '2000-01-01' AS data_as_of FROM customer",
    "recon_window": f"WITH {FEEDS} SELECT min(deposit_date) AS lo, max(deposit_date) AS hi FROM v",
    "recon_tier1": f"WITH {FEEDS} SELECT * FROM t1",
    "recon_tier2": f"WITH {FEEDS} SELECT * FROM t2",
    "recon_breaks": f"WITH {FEEDS} SELECT * FROM b",
    "recon_evidence": f"WITH {FEEDS} SELECT match_tier, CAST(NULL AS VARCHAR) AS break_type, 'run' AS run_id, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT NULL, break_type, 'run', count(*) FROM b GROUP BY 2",
    "recon_summary": f"WITH {FEEDS}, g AS (SELECT break_type, count(*) AS breaks, CAST(sum(abs(variance_usd)) AS DECIMAL(18,2)) AS total_abs_variance, CAST(max(date_diff('day', deposit_date, DATE '2000-01-01')) AS INT) AS max_age_days FROM b GROUP BY 1) SELECT *, CASE WHEN total_abs_variance > 10000 THEN 'PAGE_IMMEDIATELY' WHEN max_age_days > 3 THEN 'ESCALATE_TO_VENDOR' ELSE 'MONITOR' END AS action FROM g",
    "recon_pages": f"WITH {FEEDS} SELECT * FROM b WHERE abs(variance_usd) > 10000",
    "control_totals": f"WITH {DEP} SELECT deposit_date, source_system, count(*) AS n_rows, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS amount, CAST(sum(fee_usd) AS DECIMAL(18,2)) AS fee FROM dep GROUP BY ALL",
    "source_totals": f"WITH {DEP} SELECT source_system, count(*) AS n_rows, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS amount, min(deposit_date) AS first_date, max(deposit_date) AS last_date FROM dep GROUP BY ALL",
    "backfill_affected": f"WITH {HISTORY} SELECT count(*) AS versions, count(DISTINCT user_id) AS clients FROM dim WHERE valid_from < TIMESTAMP '2024-01-03 00:00:00' AND valid_to >= TIMESTAMP '2024-01-01 06:00:00'",
    "backfill_unwind": f"WITH {UNWOUND} SELECT * FROM dim",
    "backfill_delta": f"WITH {DEP}, x AS (SELECT *, CAST(strftime(deposit_date, '%Y%m%d') AS INT) AS date_key FROM dep), r AS (SELECT * FROM x WHERE date_key BETWEEN 19950101 AND 19950331) SELECT (SELECT count(*) FROM r WHERE deposit_id % 4 <> 0) - (SELECT count(*) FROM r) AS delta_n_rows, (SELECT CAST(sum(amount_usd) AS DECIMAL(18,2)) FROM r WHERE deposit_id % 4 <> 0) - (SELECT CAST(sum(amount_usd) AS DECIMAL(18,2)) FROM r) AS delta_amount, (SELECT count(DISTINCT client_id) FROM r WHERE deposit_id % 4 <> 0) - (SELECT count(DISTINCT client_id) FROM r) AS delta_clients",
    "top_n_recent": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "having_dups": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "business_rollup": f"WITH {DQ} SELECT n_name, c_mktsegment, count(*) AS n_deposits, {NET} FROM q JOIN customer ON client_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE NOT (f1 OR f2 OR f3) GROUP BY ALL",
    "velocity_features": f"WITH {VELOCITY} SELECT * FROM vel",
    "score_divergence": f"WITH {VELOCITY} SELECT user_id, window_start FROM vel WHERE user_id % 10 = 0",
    "contract_size": f"WITH {TRADES}, i AS (SELECT instrument, CAST(round(CAST(abs(pnl_usd_reported) AS DOUBLE) / abs(CAST((close_price - open_price) * lots AS DOUBLE)), 0) AS BIGINT) AS size FROM tf WHERE pnl_usd_derived IS NOT NULL AND close_price <> open_price AND lots <> 0) SELECT instrument, size AS contract_size FROM (SELECT instrument, size, count(*) AS n FROM i GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY n DESC, size) = 1",
    "reingested_rows": f"WITH {MANIFEST}, o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS source_file FROM orders), held AS (SELECT -o_orderkey AS o_orderkey, source_file FROM o WHERE CAST(source_file AS INT) % 3 = 0) SELECT * FROM held WHERE source_file NOT IN (SELECT source_file FROM man WHERE status = 'RE_INGESTED_CORRECTION') UNION ALL SELECT * FROM o WHERE source_file IN (SELECT source_file FROM man WHERE status IN ('INGESTED', 'RE_INGESTED_CORRECTION'))",
    "load_history": f"WITH {ATTEMPTS} SELECT * FROM h",
    "load_master": f"WITH {ATTEMPTS}, r AS (SELECT table_name, arg_max(load_status, load_ts) AS s, max(load_ts) FILTER (load_status = 'SUCCESS') AS t, sum(records_loaded) AS n FROM h WHERE load_status <> 'NO_FILES' GROUP BY 1), old AS (SELECT * FROM (VALUES ('1-URGENT', 'SUCCESS', 10, DATE '1990-01-01'), ('OTHER', 'FAILED', 20, DATE '1990-01-01')) v(table_name, st, n0, t0)) SELECT coalesce(r.table_name, old.table_name) AS table_name, coalesce(s, st) AS last_load_status, coalesce(t, t0) AS latest_loaded_ts, CAST(coalesce(n0, 0) + coalesce(n, 0) AS BIGINT) AS total_records FROM r FULL JOIN old ON r.table_name = old.table_name",
    "scd2_seed": f"WITH {SEEDED} SELECT * FROM dim",
    "scd2_same_ts": f"WITH {SAME_TS} SELECT * FROM dim",
    "backfill_restate": f"WITH {RESTATED} SELECT * FROM dim",
    "scd2_same_ts_log": f"WITH {SAME_TS} SELECT action_taken, count(*) AS n FROM alog GROUP BY 1",
    "orphan_facts": f"WITH {DEP} SELECT client_id, deposit_id FROM dep WHERE client_id NOT IN (SELECT client_id FROM cli)",
    "bind_current": f"WITH {HISTORY} SELECT e.event_id, e.user_id, c.sk AS client_sk FROM events e LEFT JOIN (SELECT * FROM dim WHERE is_current AND NOT is_deleted) c USING (user_id)",
    "lsn_watermark": f"WITH {EVENTS} SELECT coalesce(max(lsn), 0) AS watermark FROM ev UNION ALL SELECT coalesce(max(lsn), 0) FROM ev WHERE op = 'none'",
    "dim_instrument": "SELECT sha256(i) AS instrument_key, i AS instrument, a AS asset_class, CAST(n AS DECIMAL(9,0)) AS contract_size FROM (VALUES ('A', 'FX', 100), ('N', 'METAL', 10)) v(i, a, n)",
    "dq_pnl": f"WITH {TRADES} SELECT trade_id AS record_key, 'pnl_recomputes' AS check_name, 'WARN' AS severity, 'warn' AS on_failure, 'variance=' || CAST(pnl_variance_usd AS VARCHAR) AS detail FROM tf WHERE abs(pnl_variance_usd) > 0.01",
    "dq_birth_dates": "WITH x AS (SELECT c_custkey, CAST(DATE '1915-01-01' + CAST(c_custkey * 37 % 33000 AS INT) AS DATE) AS b FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS record_key, 'dob_plausible' AS check_name, 'WARN' AS severity, 'warn' AS on_failure, 'birth_date=' || CAST(b AS VARCHAR) AS detail FROM x WHERE b < DATE '1920-01-01' OR b > DATE '2000-01-01'",
    "dq_deposit_id": f"WITH {REFS} SELECT CAST(deposit_id AS VARCHAR) AS record_key, 'deposit_ref_not_null' AS check_name, 'BLOCK' AS severity, 'block' AS on_failure, 'deposit_ref=' || coalesce(deposit_ref, 'null') AS detail FROM refs WHERE deposit_ref IS NULL OR trim(deposit_ref) = ''",
    "dq_recovered_keys": "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, 'malformed_key_recovered' AS check_name, 'WARN' AS severity, 'warn' AS on_failure, 'payment_method=CARD' AS detail FROM orders WHERE o_orderkey % 3 = 0",
    "warehouse_gate": f"WITH {REFS} SELECT CAST(deposit_id AS VARCHAR) AS record_key, 'client_exists' AS check_name, 'QUARANTINE' AS severity, 'quarantine' AS on_failure, 'client=' || CAST(client_id AS VARCHAR) AS detail FROM refs WHERE client_id NOT IN (SELECT client_id FROM cli) UNION ALL SELECT CAST(deposit_id AS VARCHAR), 'deposit_id_well_formed', 'QUARANTINE', 'quarantine', 'deposit_id=' || deposit_ref FROM refs WHERE NOT regexp_full_match(deposit_ref, 'DEP[0-9]+')",
    "stub_ageing": f"WITH {DEP} SELECT client_id, min(deposit_date) AS first_seen, CAST(date_diff('day', min(deposit_date), DATE '1995-01-10') AS INT) AS age_days, date_diff('day', min(deposit_date), DATE '1995-01-10') > 7 AS stale FROM dep WHERE client_id NOT IN (SELECT client_id FROM cli) GROUP BY 1",
    "partner_rollup": f"WITH {DQ} SELECT r_name AS partner, c_mktsegment, count(*) AS n_deposits, {NET} FROM q JOIN customer ON client_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT (f1 OR f2 OR f3) GROUP BY ROLLUP (r_name, c_mktsegment)",
    "referral_rollup": f"WITH {DQ} SELECT client_id // 10 AS referrer, count(DISTINCT client_id) AS clients, {NET} FROM q WHERE NOT (f1 OR f2 OR f3) GROUP BY 1",
    "having_global": f"WITH {DEP} SELECT count(*) AS n_rows, count(*) FILTER (amount_usd IS NULL) AS n_null FROM dep HAVING count(*) FILTER (amount_usd IS NULL) > 0",
    "validation_rows": f"WITH {DQ}, {TRADES} SELECT 'clients' AS table_name, count(*) AS n_rows, CAST(0 AS DECIMAL(24,2)) AS total FROM cli UNION ALL SELECT 'fact_deposit', count(*), CAST(sum(amount_usd) AS DECIMAL(24,2)) FROM q WHERE NOT (f1 OR f2 OR f3) UNION ALL SELECT 'fact_trade', count(*), CAST(sum(pnl_usd_reported) AS DECIMAL(24,2)) FROM tf",
}
