"""The store's operators over the test tables, each with the same query in SQL.

events are a version log: key user_id, time ts, order event_id, value event_type; an 'error' is a delete.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine, Options
from .operators import aggregates as A
from .operators import compact as C
from .operators.history import version_history
from .operators.lookup import lookup_as_of, multi_get
from .operators.overlay import apply_overlay, overlay_rows
from .plans.resolve import live, resolve
from .plans.scan import page, prefix_scan, range_scan
from .sources.wal import fold

AS_OF = "2024-01-15 00:00:00"


def cut():
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("op"))


def runs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log dealt to four runs."""
    return versions(spark, sf_dir).withColumn("run_id", F.col("seq") % 4)


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of runs that cover parts of the key range: all events, by stretches of 40 keys and hour of the day."""
    v = versions(spark, sf_dir).withColumn("run_id", F.floor(F.col("key") / 40) * 24 + F.hour("ts"))
    return A.run_stats(v, size=F.octet_length("value") + 8)


def events_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records: ten ids make a transaction; logins commit it, errors are deletes, refunds or views write."""
    e = table(spark, sf_dir, "events")
    kv = F.struct(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))
    dead = F.col("event_type") == "error"
    return e.select(F.lit(1).cast("long").alias("wal_id"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 10).alias("txn_id"), F.col("event_id").alias("ts"), (F.col("event_id") % 10 == 9).alias("_last"), "event_type", F.when(~dead, F.array(kv)).otherwise(F.array().cast("array<struct<key:string,value:string>>")).alias("writes"), F.when(dead, F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("deletes")).withColumn("committed", F.col("_last") & (F.col("txn_id") % 3 != 0)).withColumn("aborted", F.col("_last") & (F.col("txn_id") % 3 == 0) & (F.col("txn_id") % 2 == 0))


def overlay(spark: SparkSession) -> DataFrame:
    """A transaction's operations in order: put, delete after put, put after delete, put of a new key."""
    ops = [(1, "mine", 0, 1), (2, None, 1, 2), (3, "x", 0, 3), (3, None, 1, 4), (4, None, 1, 5), (4, "back", 0, 6), (-7, "new", 0, 7)]
    return overlay_rows(spark.createDataFrame(ops, "key long, value string, op int, pos int"))


def point_get(spark, d):
    return live(versions(spark, d).where("key = 7")).select("key", "value", "ts")


def point_get_as_of(spark, d):
    return live(versions(spark, d).where("key = 7"), cut()).select("key", "value", "ts")


def multi_get_q(spark, d):
    keys = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return multi_get(versions(spark, d), keys).select("key", "value", "found")


def as_of_probes(spark, d):
    """Each order asks what its customer's last event was; orders are probes in time."""
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.col("o_custkey").alias("key"), F.lit(AS_OF).cast("timestamp_ntz").alias("_base"), (F.col("o_orderkey") % 28).cast("int").alias("_d"))
    probes = probes.select("probe_id", "key", (F.col("_base") + F.make_dt_interval(F.col("_d"))).alias("probe_ts"))
    return lookup_as_of(versions(spark, d), probes).select("probe_id", "key", "probe_ts", "value", "ts")


def full_scan_q(spark, d):
    return live(versions(spark, d)).select("key", "value", "ts")


def scan_desc_limit(spark, d):
    out = page(live(versions(spark, d)), 10, ascending=False).select("key", "value")
    return out.withColumn("pos", F.row_number().over(Window.orderBy(F.col("key").desc())))


def range_q(spark, d):
    return range_scan(table(spark, d, "customer"), "Customer#000000010", "Customer#000000050", key="c_name").select("c_name", "c_acctbal")


def open_start(spark, d):
    return range_scan(table(spark, d, "customer"), None, "Customer#000000025", key="c_name").select("c_name", "c_acctbal")


def open_end(spark, d):
    return range_scan(table(spark, d, "customer"), "Customer#000000100", None, key="c_name", ascending=False).select("c_name", "c_acctbal")


def prefix_q(spark, d):
    return prefix_scan(table(spark, d, "customer"), "Customer#00000001", key="c_name").select("c_name", "c_acctbal")


def prefix_desc_page(spark, d):
    out = page(prefix_scan(table(spark, d, "customer"), "Customer#0000000", key="c_name", ordered=False), 7, "Customer#000000060", False, key="c_name").select("c_name", "c_acctbal")
    return out.withColumn("pos", F.row_number().over(Window.orderBy(F.col("c_name").desc())))


def seek_q(spark, d):
    from .plans.scan import first_at_or_after, last_at_or_before

    c = table(spark, d, "customer").select("c_name")
    up = first_at_or_after(c, "Customer#0000000335", key="c_name").withColumn("side", F.lit("up"))
    return up.unionByName(last_at_or_before(c, "Customer#0000000335", key="c_name").withColumn("side", F.lit("down")))


def counts(spark, d):
    return A.count_live(versions(spark, d))


def min_max_live(spark, d):
    return A.min_max(live(versions(spark, d)))


def min_max_all(spark, d):
    return A.min_max(resolve(versions(spark, d)), value=None)


def latest_ts_q(spark, d):
    return A.latest_ts(versions(spark, d))


def history(spark, d):
    return version_history(versions(spark, d)).select("key", "value", F.col("ts").alias("valid_from"), "valid_to", "prev_value")


def overlay_read(spark, d):
    return apply_overlay(live(versions(spark, d), cut()), overlay(spark))


def commit_effect(spark, d):
    """The overlay appended as versions of a later time; read back by a snapshot after it."""
    at = F.lit("2030-01-01").cast("timestamp_ntz")
    log = versions(spark, d).unionByName(overlay(spark).select("key", "value", at.alias("ts"), F.lit(-1).cast("long").alias("seq"), "op"))
    return live(log).select("key", "value")


def rollback_effect(spark, d):
    """A rolled-back overlay is never appended: transactions that aborted leave nothing."""
    f = fold(events_wal(spark, d)).where("committed and not aborted and key is not null")
    return f.groupBy("op").agg(F.countDistinct("txn_id").alias("txns"), F.count("*").alias("ops"))


def wal_fold(spark, d):
    return fold(events_wal(spark, d)).where("committed and not aborted").select("txn_id", "ts", "key", "value", "op")


def recover_uncommitted(spark, d):
    return fold(events_wal(spark, d)).where("not committed and not aborted").select("txn_id", "ts", "key", "value", "op")


def flush_newest(spark, d):
    return C.merge_runs(runs_log(spark, d).where("run_id = 0")).select("key", "value", "ts", "op")


def merge_runs_newest(spark, d):
    return live(runs_log(spark, d)).select("key", "value", "ts", "run_id")


def merge_keep_tombstones(spark, d):
    return C.merge_runs(runs_log(spark, d).where("run_id in (1, 2)")).select("key", "value", "ts", "op", "run_id")


def retain_history(spark, d):
    return C.retain(versions(spark, d), cut()).select("key", "value", "ts", "op")


def drop_tombstones_q(spark, d):
    """Runs 0 and 1 merge; what is outside holds keys 20 to 60 only."""
    return C.drop_tombstones(C.merge_runs(runs_log(spark, d).where("run_id in (0, 1)")), bounds=[(20, 60)]).select("key", "value", "op")


def run_stats_q(spark, d):
    return A.run_stats(runs_log(spark, d), size=F.octet_length("value") + 8)


def overlap_q(spark, d):
    return C.overlap_pairs(runs_table(spark, d))


def level_score(spark, d):
    return A.level_scores(runs_table(spark, d).withColumn("level", F.col("run_id") % 3 + 1), base_bytes=1000)


def total_entries_q(spark, d):
    return A.total_entries(runs_table(spark, d))


def groups_q(spark, d):
    return C.key_range_groups(runs_table(spark, d)).select("run_id", "group_id")


def oldest_q(spark, d):
    return C.oldest_until(runs_table(spark, d), 0.2).select("run_id", "size_bytes", "max_ts")


def size_tiered_q(spark, d):
    rows = runs_table(spark, d).select("run_id", "size_bytes").collect()  # metadata
    picked = C.pick_size_tiered([(r.run_id, r.size_bytes) for r in rows])
    return spark.createDataFrame([(i, r) for i, r in enumerate(picked)], "pos int, run_id long")


def composed(spark, d):
    """A snapshot is a frame like any other: live users of each market segment."""
    snap = live(versions(spark, d), cut()).select("key", "value")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return c.join(snap, "key").groupBy("c_mktsegment", "value").agg(F.count("*").alias("n"))


def _folder(spark) -> str:
    """A new folder's name for a store: below spark.checkpoint.dir, or where that is unset on one machine a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: a store needs a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def _store_log(spark, d):
    return versions(spark, d).select(F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", F.col("op").cast("tinyint").alias("op"))


def _at() -> int:
    return int(datetime.datetime.fromisoformat(AS_OF).replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)


def store_compacted(spark, d):
    """The events through a store: four appended runs, three of them merged within retain_after, reopened, read at a past time."""
    root, log = _folder(spark), _store_log(spark, d)
    with Engine(spark, root, Options(retain_after=_at())) as db:
        runs = [db.append(log.where(F.col("seq") % 4 == i)) for i in range(4)]
        db.compact(runs[:3], 2)
    return Engine(spark, root).snapshot(_at()).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def store_range(spark, d):
    """A transaction's range over a flushed run, an appended one, an overlay and a rolled-back transaction."""
    db = Engine(spark, _folder(spark))
    db.append(_store_log(spark, d))
    with db.update() as t:
        t.put("1000000", "committed")
        t.delete("10")
    db.force_flush()
    lost = db.begin()
    lost.put("11", "rolled back")
    lost.rollback()
    t = db.begin()
    t.put("12", "own")
    return t.range("1", "13").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def store_recovered(spark, d):
    """What a reopened store has from its log: committed, rolled back and unfinished transactions of each user."""
    root = _folder(spark)
    db = Engine(spark, root)
    for i in range(6):
        t = db.begin()
        t.put(f"k{i}", f"v{i}")
        t.save() if i % 3 == 1 else t.commit() if i % 3 == 0 else t.rollback()
    db.close()
    return Engine(spark, root).snapshot().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_V = "(SELECT user_id AS key, event_type AS value, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, event_id % 4 AS run_id FROM events)"


def _newest(where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM {_V} v WHERE {where}) WHERE rn = 1)"


_R = "(SELECT user_id // 40 * 24 + hour(ts) AS run_id, min(user_id) AS min_key, max(user_id) AS max_key, count(*) AS entry_count, sum(strlen(event_type) + 8) AS size_bytes, max(ts) AS max_ts FROM events GROUP BY 1)"
_T = f"TIMESTAMP '{AS_OF}'"
_OV = "(VALUES (1, 'mine', 0), (2, NULL, 1), (3, NULL, 1), (4, 'back', 0), (-7, 'new', 0)) o(key, value, op)"
_FOLD = """(WITH r AS (SELECT event_id // 10 AS txn_id, event_id AS pos, CAST(user_id AS VARCHAR) AS key, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM events),
 s AS (SELECT txn_id, max(pos) AS ts, bool_or(pos % 10 = 9 AND txn_id % 3 <> 0) AS committed, bool_or(pos % 10 = 9 AND txn_id % 3 = 0 AND txn_id % 2 = 0) AS aborted FROM r GROUP BY 1),
 o AS (SELECT txn_id, key, CASE WHEN op = 1 THEN NULL ELSE event_type END AS value, op FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY pos DESC) AS rn FROM r) WHERE rn = 1)
 SELECT s.txn_id, s.ts, s.committed, s.aborted, o.key, o.value, o.op FROM s JOIN o USING (txn_id))"""

_ALL: dict[str, tuple[Callable, str | None]] = {
    "q01_point_get": (point_get, f"SELECT key, value, ts FROM {_newest('key = 7')} WHERE op = 0"),
    "q02_point_get_as_of": (point_get_as_of, f"SELECT key, value, ts FROM {_newest(f'key = 7 AND ts <= {_T}')} WHERE op = 0"),
    "q03_multi_get": (multi_get_q, f"SELECT k.key, n.value, n.key IS NOT NULL AS found FROM (SELECT DISTINCT c_custkey * 3 AS key FROM customer) k LEFT JOIN (SELECT * FROM {_newest()} WHERE op = 0) n ON k.key = n.key"),
    "q03b_lookup_as_of": (as_of_probes, f"""SELECT probe_id, key, probe_ts, value, ts FROM (SELECT p.probe_id, v.key, p.probe_ts, v.value, v.ts, v.op, row_number() OVER (PARTITION BY p.probe_id ORDER BY v.ts DESC, v.seq DESC) AS rn
        FROM (SELECT o_orderkey AS probe_id, o_custkey AS key, {_T} + to_days(CAST(o_orderkey % 28 AS INTEGER)) AS probe_ts FROM orders) p JOIN {_V} v ON v.key = p.key AND v.ts <= p.probe_ts) WHERE rn = 1 AND op = 0"""),
    "q04_full_scan": (full_scan_q, f"SELECT key, value, ts FROM {_newest()} WHERE op = 0"),
    "q05_scan_desc_limit": (scan_desc_limit, f"SELECT key, value, CAST(row_number() OVER (ORDER BY key DESC) AS INTEGER) AS pos FROM (SELECT * FROM {_newest()} WHERE op = 0 ORDER BY key DESC LIMIT 10)"),
    "q06_range": (range_q, "SELECT c_name, c_acctbal FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000050'"),
    "q07_open_start": (open_start, "SELECT c_name, c_acctbal FROM customer WHERE c_name < 'Customer#000000025'"),
    "q08_open_end": (open_end, "SELECT c_name, c_acctbal FROM customer WHERE c_name >= 'Customer#000000100'"),
    "q09_prefix": (prefix_q, "SELECT c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#00000001')"),
    "q10_prefix_desc_page": (prefix_desc_page, "SELECT c_name, c_acctbal, CAST(row_number() OVER (ORDER BY c_name DESC) AS INTEGER) AS pos FROM (SELECT * FROM customer WHERE starts_with(c_name, 'Customer#0000000') AND c_name < 'Customer#000000060' ORDER BY c_name DESC LIMIT 7)"),
    "q10b_seek": (seek_q, "SELECT min(c_name) AS c_name, 'up' AS side FROM customer WHERE c_name >= 'Customer#0000000335' UNION ALL SELECT max(c_name), 'down' FROM customer WHERE c_name <= 'Customer#0000000335'"),
    "q11_counts": (counts, f"SELECT count(*) FILTER (WHERE op = 0) AS live_count, count(*) FILTER (WHERE op = 1) AS delete_count FROM {_newest()}"),
    "q12_min_max_live": (min_max_live, f"SELECT min(key) AS min_key, max(key) AS max_key, arg_min(value, key) AS min_value, arg_max(value, key) AS max_value FROM {_newest()} WHERE op = 0"),
    "q13_min_max_all": (min_max_all, f"SELECT min(key) AS min_key, max(key) AS max_key FROM {_V} v"),
    "q14_latest_ts": (latest_ts_q, "SELECT max(ts) AS latest_ts FROM events"),
    "q15_version_history": (history, f"SELECT key, value, ts AS valid_from, lead(ts) OVER w AS valid_to, lag(value) OVER w AS prev_value FROM {_V} v WINDOW w AS (PARTITION BY key ORDER BY ts, seq)"),
    "q16_txn_overlay_read": (overlay_read, f"SELECT key, value FROM {_newest(f'ts <= {_T}')} WHERE op = 0 AND key NOT IN (1, 2, 3, 4, -7) UNION ALL SELECT CAST(key AS BIGINT), value FROM {_OV} WHERE op = 0"),
    "q17_commit_effect": (commit_effect, f"SELECT key, value FROM {_newest()} WHERE op = 0 AND key NOT IN (1, 2, 3, 4, -7) UNION ALL SELECT CAST(key AS BIGINT), value FROM {_OV} WHERE op = 0"),
    "q18_rollback_effect": (rollback_effect, f"SELECT op, count(DISTINCT txn_id) AS txns, count(*) AS ops FROM {_FOLD} WHERE committed AND NOT aborted GROUP BY 1"),
    "q19_wal_fold": (wal_fold, f"SELECT txn_id, ts, key, value, op FROM {_FOLD} WHERE committed AND NOT aborted"),
    "q20_recover_uncommitted": (recover_uncommitted, f"SELECT txn_id, ts, key, value, op FROM {_FOLD} WHERE NOT committed AND NOT aborted"),
    "q21_flush_newest": (flush_newest, f"SELECT key, value, ts, op FROM {_newest('run_id = 0')}"),
    "q22_merge_runs_newest": (merge_runs_newest, f"SELECT key, value, ts, run_id FROM {_newest()} WHERE op = 0"),
    "q23_merge_keep_tombstones": (merge_keep_tombstones, f"SELECT key, value, ts, op, run_id FROM {_newest('run_id IN (1, 2)')}"),
    "q23b_retain_history": (retain_history, f"SELECT key, value, ts, op FROM {_V} v WHERE ts > {_T} UNION ALL SELECT key, value, ts, op FROM {_newest(f'ts <= {_T}')}"),
    "q24_drop_tombstones": (drop_tombstones_q, f"SELECT key, value, op FROM {_newest('run_id IN (0, 1)')} WHERE op = 0 OR key BETWEEN 20 AND 60"),
    "q25_run_stats": (run_stats_q, f"SELECT run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS entry_count, CAST(sum(strlen(value) + 8) AS BIGINT) AS size_bytes, max(ts) AS max_ts FROM {_V} v GROUP BY 1"),
    "q26_run_overlap_pairs": (overlap_q, f"SELECT a.run_id AS run_a, b.run_id AS run_b FROM {_R} a JOIN {_R} b ON a.run_id < b.run_id AND a.max_key >= b.min_key AND a.min_key <= b.max_key"),
    "q27_level_score": (level_score, f"SELECT run_id % 3 + 1 AS level, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS run_count, CAST(sum(size_bytes) AS DOUBLE) / (1000.0::DOUBLE * pow(10.0::DOUBLE, run_id % 3)) * 0.8::DOUBLE + count(*) / 8 * 0.2::DOUBLE AS score FROM {_R} GROUP BY run_id % 3"),
    "q27b_total_entries": (total_entries_q, f"SELECT CAST(sum(entry_count) AS BIGINT) AS total_entries FROM {_R}"),
    "q28_key_range_groups": (groups_q, f"SELECT run_id, CAST(sum(n) OVER (ORDER BY min_key, run_id) AS BIGINT) AS group_id FROM (SELECT run_id, min_key, CASE WHEN min_key > lag(max_key) OVER (ORDER BY min_key, run_id) THEN 1 ELSE 0 END AS n FROM {_R})"),
    "q29_oldest_until_target": (oldest_q, f"SELECT run_id, CAST(size_bytes AS BIGINT) AS size_bytes, max_ts FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY max_ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM {_R}) WHERE before < total * 0.2"),
    "q30_size_tiered_pick": (size_tiered_q, None),
    "q32_store_compacted": (store_compacted, f"SELECT CAST(key AS VARCHAR) AS key, value FROM {_newest(f'ts <= {_T}')} WHERE op = 0"),
    "q33_store_range": (store_range, f"SELECT * FROM (SELECT CAST(key AS VARCHAR) AS key, value FROM {_newest()} WHERE op = 0 AND key NOT IN (10, 12, 1000000) UNION ALL VALUES ('1000000', 'committed'), ('12', 'own')) WHERE key >= '1' AND key < '13'"),
    "q34_store_recovered": (store_recovered, "SELECT * FROM (VALUES ('k0', 'v0'), ('k3', 'v3')) t(key, value)"),
    "q31_snapshot_join": (composed, f"SELECT c_mktsegment, value, count(*) AS n FROM customer JOIN (SELECT * FROM {_newest(f'ts <= {_T}')} WHERE op = 0) s ON s.key = c_custkey GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
