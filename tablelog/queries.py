"""Registered queries of the table engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelog import query_surface
from tablelog.functions import scalar
from tablelog.functions.integrity import pseudonyms, seal, unseal
from tablelog.functions.keys import ancestors, covers_key, decode, encode
from tablelog.functions.values import key_image, typeof, value, with_affinity
from tablelog.operators import changes, coordination, dml, integrity, log, windows

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- the log over `events`: every tenth event deletes a user's range, the next one a key, others set it

LOG_SQL = """log AS (
  SELECT event_id + 1 AS seq, event_id % 3 AS device, CAST(user_id AS VARCHAR) AS u, event_type AS e, value,
         CASE event_id % 10 WHEN 0 THEN 'range_delete' WHEN 1 THEN 'delete' ELSE 'set' END AS op FROM events
), newest AS (
  SELECT u, e, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(device, seq) AS device FROM log WHERE op <> 'range_delete' GROUP BY u, e
), wiped AS (
  SELECT u, max(seq) AS seq FROM log WHERE op = 'range_delete' GROUP BY u
), visible AS (
  SELECT n.u, n.e, n.seq, n.value, n.device FROM newest n LEFT JOIN wiped w ON w.u = n.u WHERE n.op = 'set' AND (w.seq IS NULL OR n.seq > w.seq)
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 10 == 0, "range_delete").when(F.col("event_id") % 10 == 1, "delete").otherwise("set")
    user = F.col("user_id").cast("string")
    rows = e.select((F.col("event_id") + 1).alias("admission_seq"), F.lit(0).alias("op_index"), (F.col("event_id") % 3).alias("device"), (F.col("event_id") + 1).alias("ver"), op.alias("op"), user.alias("u"), "event_type", "value")
    whole = F.col("op") == "range_delete"
    return rows.select("admission_seq", "op_index", "device", "ver", "op", F.when(~whole, F.array("u", "event_type")).alias("key"), F.when(whole, F.array("u")).alias("range"), F.when(F.col("op") == "set", F.col("value")).alias("value"))


def _split_key(df: DataFrame) -> DataFrame:
    return df.select(F.col("key")[0].alias("u"), F.col("key")[1].alias("e"), *(c for c in df.columns if c != "key"))


@_query(f"WITH {LOG_SQL} SELECT u, e, value, device, seq AS admission_seq FROM visible")
def log_visible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_key(log.visible(event_log(spark, sf_dir))).select("u", "e", "value", "device", "admission_seq")


def _cut(events_sql: str) -> str:
    return LOG_SQL.replace("FROM events\n)", f"FROM events WHERE {events_sql}\n)")


@_query(f"WITH {_cut('event_id < 500')} SELECT u, e, value FROM visible")
def log_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_key(log.visible(event_log(spark, sf_dir), 500)).select("u", "e", "value")


@_query(f"WITH {LOG_SQL} SELECT k.u, k.e, v.value FROM (SELECT DISTINCT u, e FROM log WHERE seq % 7 = 3) k LEFT JOIN visible v ON v.u = k.u AND v.e = k.e")
def log_get_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    asked = _read(spark, sf_dir, "events").where("(event_id + 1) % 7 = 3").select(F.array(F.col("user_id").cast("string"), "event_type").alias("key"))
    return _split_key(log.get(rows, asked))


@_query(f"WITH {LOG_SQL} SELECT u, e, value FROM visible WHERE u = '7' AND e > 'click' ORDER BY u, e LIMIT 3")
def log_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_key(log.list_page(event_log(spark, sf_dir), ["7"], ["7", "click"], 3)).select("u", "e", "value")


@_query(f"WITH {LOG_SQL} SELECT seq AS admission_seq, op, device FROM log WHERE u = '11' AND seq > 100 AND seq <= 900")
def log_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.delta(event_log(spark, sf_dir), ["11"], 100, 900).select("admission_seq", "op", "device")


@_query(f"WITH {LOG_SQL} SELECT u AS prefix, count(*) AS live FROM visible GROUP BY u UNION ALL SELECT u || '/' || e, count(*) FROM visible GROUP BY u, e UNION ALL SELECT '', count(*) FROM visible HAVING count(*) > 0")
def log_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.live_counts(event_log(spark, sf_dir)).select(F.array_join("prefix", "/").alias("prefix"), "live")


@_query(f"WITH {LOG_SQL}, h AS (SELECT u, device, max(seq) AS head FROM log GROUP BY u, device) SELECT u AS prefix, device, head, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY head DESC, device) AS INTEGER) AS place FROM h) t WHERE place <= 2")
def log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.heads(event_log(spark, sf_dir), 1).select(F.col("prefix")[0].alias("prefix"), "device", "head", "place")


@_query(f"WITH {LOG_SQL} SELECT n.u, n.e, greatest(n.own, coalesce(w.seq, n.own)) AS floor FROM (SELECT u, e, max(seq) AS own FROM log WHERE op <> 'range_delete' GROUP BY u, e) n LEFT JOIN wiped w ON w.u = n.u")
def log_version_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_key(log.version_floors(event_log(spark, sf_dir)))


@_query("SELECT event_id + 1 AS admission_seq, event_id % 3 AS device FROM events WHERE event_id >= 300 AND event_id < 428")
def log_pull_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.pull(event_log(spark, sf_dir), 300, 128).select("admission_seq", "device")


@_query("SELECT event_id + 1 AS last_missing FROM events WHERE event_id % 7 = 4 AND event_id + 1 IN (SELECT event_id FROM events)")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that lost two rows of every seven."""
    return log.gaps(event_log(spark, sf_dir).where("(admission_seq - 1) % 7 NOT IN (3, 4)"))


@_query(f"WITH {LOG_SQL} SELECT u, e, value FROM visible")
def log_replay_in_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    early = log.visible(rows, 1000)
    return _split_key(log.materialized(rows.where("admission_seq > 1000"), early)).select("u", "e", "value")


@_query(f"WITH {LOG_SQL}, a AS (SELECT DISTINCT u, CAST(u AS BIGINT) % 3 AS mine FROM log) SELECT a.u, max(l.seq) AS foreign_seq FROM a JOIN log l ON l.u = a.u AND l.device <> a.mine GROUP BY a.u HAVING max(l.seq) > 600")
def range_assert_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    users = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("assert_id")).distinct()
    asserts = users.select("assert_id", (F.col("assert_id").cast("bigint") % 3).alias("device"), F.array("assert_id").alias("prefix"), F.lit(600).alias("upto"))
    return log.foreign_max(rows, asserts).select(F.col("assert_id").alias("u"), "foreign_seq")


@_query(f"""WITH {LOG_SQL}, batch AS (
  SELECT device, seq, sha256(concat_ws('|', op, CASE WHEN op = 'range_delete' THEN u ELSE u || '/' || e END, CASE WHEN op = 'set' THEN coalesce(CAST(value AS VARCHAR), '') ELSE '' END, CAST(seq AS VARCHAR))) AS content FROM log
) SELECT device, list_reduce(list_prepend(repeat('0', 64), list(content ORDER BY seq)), lambda a, x: sha256(a || x)) AS checksum, count(*) AS batches FROM batch GROUP BY device""")
def log_checksum_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.checksum_chain(event_log(spark, sf_dir))


# --- coordination

_LEASES = """leases AS (SELECT event_id AS lease_id, (event_id // 2) % 3 AS holder, (event_id // 4) % 2 AS rw, CAST(user_id AS VARCHAR) AS u, event_id AS deadline FROM events WHERE event_id % 2 = 0),
requests AS (SELECT event_id AS request_id, (event_id // 2) % 3 AS device, (event_id // 4) % 2 AS rw, CAST(user_id AS VARCHAR) AS u, event_type AS e FROM events WHERE event_id % 2 = 1)"""


def _leases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every even event is a lease, every odd one a request."""
    e = _read(spark, sf_dir, "events")
    by, mode, user = F.expr("event_id div 2 % 3"), F.when(F.expr("event_id div 4 % 2") == 0, "read").otherwise("write"), F.col("user_id").cast("string")
    leases = e.where("event_id % 2 = 0").select(F.col("event_id").alias("lease_id"), by.alias("holder"), mode.alias("lease_mode"), F.array(user).alias("lease_prefix"), F.col("event_id").alias("deadline"))
    requests = e.where("event_id % 2 = 1").select(F.col("event_id").alias("request_id"), by.alias("device"), mode.alias("mode"), F.array(user, "event_type").alias("prefix"))
    return requests, leases


@_query(f"WITH {_LEASES} SELECT r.request_id, max(l.deadline) AS retry_after FROM requests r JOIN leases l ON l.u = r.u AND l.holder <> r.device AND NOT (r.rw = 0 AND l.rw = 0) AND l.deadline > 50 GROUP BY r.request_id")
def lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.lease_conflicts(*_leases(spark, sf_dir), 50)


@_query(f"WITH {_LEASES} SELECT DISTINCT r.request_id AS write_id FROM requests r JOIN leases l ON l.u = r.u AND l.holder <> r.device AND l.deadline > 50")
def lease_barred_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, leases = _leases(spark, sf_dir)
    return coordination.barred_writes(requests.select(F.col("request_id").alias("write_id"), "device", "prefix", F.lit(False).alias("wide")), leases, 50)


@_query("WITH f AS (SELECT event_id % 50 AS txn, CAST(user_id AS VARCHAR) AS u, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS e FROM events) SELECT DISTINCT txn, u, coalesce(e, '*') AS e FROM f a WHERE e IS NULL OR NOT EXISTS (SELECT 1 FROM f b WHERE b.txn = a.txn AND b.u = a.u AND b.e IS NULL)")
def footprint_antichain(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    f = _read(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("txn"), F.when(F.col("event_id") % 3 == 0, F.array(user)).otherwise(F.array(user, "event_type")).alias("prefix"))
    return coordination.antichain(f).select("txn", F.col("prefix")[0].alias("u"), F.coalesce(F.get("prefix", F.lit(1)), F.lit("*")).alias("e"))


@_query("SELECT f.event_id AS txn, min(h.event_id) AS first_conflict FROM events f JOIN events h ON h.user_id = f.user_id AND h.event_id > 2 * f.event_id - 60 AND h.event_id <> f.event_id GROUP BY f.event_id")
def occ_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a transaction that read its user, and a commit to one key of that user."""
    footprints, history = _commits(spark, sf_dir)
    return coordination.conflicts(footprints, history)


def _commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, user = _read(spark, sf_dir, "events"), F.col("user_id").cast("string")
    footprints = e.select(F.col("event_id").alias("txn"), F.lit("read").alias("kind"), F.array(user).alias("prefix"), (F.col("event_id") * 2 - 60).alias("frontier"))
    return footprints, e.select(F.col("event_id").alias("commit_seq"), F.col("event_id").alias("writer"), F.array(user, "event_type").alias("region"), F.lit(False).alias("wide"))


@_query(f"WITH {LOG_SQL}, b AS (SELECT seq, device, u, e, seq - 200 AS ver FROM log WHERE op <> 'range_delete' AND seq > 800), fl AS (SELECT u, e, max(seq) AS floor FROM log WHERE op <> 'range_delete' AND seq <= 800 GROUP BY u, e) SELECT DISTINCT device, b.seq AS device_seq, 'version regression' AS reason FROM b JOIN fl ON fl.u = b.u AND fl.e = b.e WHERE b.ver <= fl.floor UNION ALL SELECT device, min(seq), 'sequence gap' FROM b GROUP BY device HAVING max(seq) - min(seq) + 1 <> count(DISTINCT seq)")
def admission_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).where("op <> 'range_delete'")
    batches = rows.where("admission_seq > 800").select("device", F.col("admission_seq").alias("device_seq"), "key", (F.col("admission_seq") - 200).alias("ver"))
    floors = log.version_floors(rows.where("admission_seq <= 800"))
    heads = batches.groupBy("device").agg((F.min("device_seq") - 1).alias("last_seq"))
    return coordination.admission_errors(batches, heads, floors)


# --- data modification over orders

_ROWS = "rows AS (SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 10000000 END AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 5 = 0)"
_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.where("o_orderkey % 5 = 0").select((key + F.when(key % 2 == 0, 0).otherwise(10_000_000)).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate", "o_orderpriority", key.alias("ordinal"))
    return o, rows


def _after(table: DataFrame, done: DataFrame) -> DataFrame:
    return changes.apply(table, done, ["o_orderkey"])


@_query(f"WITH {_ROWS} SELECT {_COLUMNS} FROM orders UNION ALL SELECT {_COLUMNS} FROM rows WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _batch(spark, sf_dir)
    return _after(table, dml.insert(table, rows, [["o_orderkey"]], "ignore"))


@_query(f"WITH {_ROWS} SELECT {_COLUMNS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rows) UNION ALL SELECT {_COLUMNS} FROM rows")
def dml_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _batch(spark, sf_dir)
    return _after(table, dml.insert(table, rows, [["o_orderkey"]], "replace"))


@_query(f"WITH {_ROWS} SELECT {_COLUMNS} FROM rows WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def upsert_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _batch(spark, sf_dir)
    return dml.returning(dml.upsert(table, rows, ["o_orderkey"]), *table.columns)


@_query(f"WITH {_ROWS} SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus || r.o_orderstatus AS o_orderstatus, r.o_totalprice, o.o_orderdate, o.o_orderpriority FROM orders o JOIN rows r ON r.o_orderkey = o.o_orderkey WHERE o.o_orderpriority <> '5-LOW' UNION ALL SELECT {_COLUMNS} FROM rows WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def upsert_do_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _batch(spark, sf_dir)
    done = dml.upsert(table, rows, ["o_orderkey"], {"o_orderstatus": "o_orderstatus || excluded.o_orderstatus", "o_totalprice": "excluded.o_totalprice"}, "o_orderpriority <> '5-LOW'")
    return dml.returning(done, *table.columns)


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return _after(o, dml.update(o, {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"}, "o_orderstatus = 'F'")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@_query("SELECT o_orderkey, c_mktsegment AS o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 AND o_orderpriority <> c_mktsegment")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    done = dml.update(o, {"o_orderpriority": "c_mktsegment"}, "c_acctbal > 5000", _read(spark, sf_dir, "customer"), "c_custkey = o_custkey", ["o_orderkey"])
    return dml.returning(done, "o_orderkey", "o_orderpriority")


@_query(f"SELECT {_COLUMNS} FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return _after(o, dml.delete(o, "o_totalprice > 100000"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def dml_delete_limited_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return dml.returning(dml.delete(dml.selected(o, "o_orderstatus = 'O'", [F.desc("o_totalprice"), "o_orderkey"], 25, 5)), "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice + 5 AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 30")
def dml_update_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return dml.returning(dml.update(dml.selected(o, None, ["o_orderkey"], 30), {"o_totalprice": "o_totalprice + 5"}), "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey AS old_o_orderkey, o_orderkey + 1 AS new_o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def dml_key_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return dml.moves(dml.update(o, {"o_orderkey": "o_orderkey + 1"}, "o_orderstatus = 'P'"), ["o_orderkey"])


@_query("SELECT n_nationkey, coalesce(n_name, 'unnamed') AS n_name, 7 AS n_regionkey FROM nation")
def dml_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return dml.with_defaults(n.select("n_nationkey", "n_name"), n, {"n_regionkey": F.lit(7)})


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 20000 OR length(o_orderpriority) < 6")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.check_violations(_read(spark, sf_dir, "orders"), "o_totalprice > 20000 AND length(o_orderpriority) >= 6").select("o_orderkey")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS holders FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unique_violations(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.orphans(_read(spark, sf_dir, "orders"), ["o_custkey"], _read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), ["c_custkey"]).select("o_orderkey")


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def fk_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    refs = [integrity.Reference("orders", ["o_custkey"], "customer", ["c_custkey"], "cascade"), integrity.Reference("lineitem", ["l_orderkey"], "orders", ["o_orderkey"], "cascade")]
    return integrity.delete_cascade(tables, refs, "customer", tables["customer"].where("c_custkey % 10 = 0"), ["c_custkey"])["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")


@_query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _read(spark, sf_dir, t) for t in ("customer", "orders")}
    refs = [integrity.Reference("orders", ["o_custkey"], "customer", ["c_custkey"], "set_null")]
    return integrity.delete_cascade(tables, refs, "customer", tables["customer"].where("c_custkey % 10 = 0"), ["c_custkey"])["orders"].select("o_orderkey", "o_custkey")


@_query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def fk_cascade_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _read(spark, sf_dir, t) for t in ("customer", "orders")}
    refs = [integrity.Reference("orders", ["o_custkey"], "customer", ["c_custkey"], "cascade", "cascade")]
    moved = tables["customer"].where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old_c_custkey"), (F.col("c_custkey") + 1_000_000).alias("new_c_custkey"))
    return integrity.update_cascade(tables, refs, "customer", moved)["orders"].select("o_orderkey", "o_custkey")


# --- change algebra

def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = old.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0)).alias("c_nationkey"))
    return old, new.unionByName(old.where("c_custkey % 9 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


_NEW = "new AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS c_nationkey FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey FROM customer WHERE c_custkey % 9 = 0)"


@_query(f"WITH {_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS k, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS kind FROM customer o FULL JOIN new n ON n.c_custkey = o.c_custkey WHERE o.c_name IS DISTINCT FROM n.c_name OR o.c_nationkey IS DISTINCT FROM n.c_nationkey")
def change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return changes.diff(*_versions(spark, sf_dir), ["c_custkey"]).select(F.col("c_custkey").alias("k"), kind.alias("kind"))


@_query(f"WITH {_NEW} SELECT c_custkey, c_name, c_nationkey FROM new")
def change_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return changes.apply(old, changes.diff(old, new, ["c_custkey"]), ["c_custkey"])


@_query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def change_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    done = changes.diff(old, new, ["c_custkey"])
    return changes.apply(changes.apply(old, done, ["c_custkey"]), changes.inverse(done), ["c_custkey"])


@_query("WITH n AS (SELECT user_id, min_by(b, event_id) AS b, max_by(a, event_id) AS a FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 4 END AS b, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 4 END AS a FROM events) t GROUP BY user_id) SELECT user_id, nullif(b, -1) AS b, nullif(a, -1) AS a FROM n WHERE a <> b")
def change_net_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _read(spark, sf_dir, "events"), F.struct((F.col("event_id") % 4).alias("x"))
    events = e.select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, v).alias("before"), F.when(F.col("event_id") % 5 != 0, v).alias("after"))
    return changes.net_effect(events, ["user_id"], "event_id").select("user_id", F.col("before.x").alias("b"), F.col("after.x").alias("a"))


@_query(f"WITH {_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'set' END AS op, n.c_nationkey FROM customer o FULL JOIN new n ON n.c_custkey = o.c_custkey WHERE o.c_nationkey IS DISTINCT FROM n.c_nationkey")
def change_map_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return changes.map_delta(old, new, "c_custkey", "c_nationkey")


@_query(f"WITH {LOG_SQL} SELECT DISTINCT u, e FROM log d WHERE op = 'delete' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.op = 'range_delete' AND r.u = d.u AND (CAST(r.u AS BIGINT) % 2 = 0 OR r.e = d.e))")
def change_prune_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range deletes of even users cover the user, those of odd users one key."""
    deletes = event_log(spark, sf_dir).where("op = 'delete'").select("key").distinct()
    user = F.col("user_id").cast("string")
    ranges = _read(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.when(F.col("user_id") % 2 == 0, F.array(user)).otherwise(F.array(user, "event_type")).alias("range"))
    return _split_key(changes.prune_deletes(deletes, ranges))


@_query(f"WITH {_NEW} SELECT 'missing' AS audit, count(*) AS n FROM (SELECT c_custkey, c_name, c_nationkey FROM customer EXCEPT ALL SELECT * FROM new) a UNION ALL SELECT 'extra', count(*) FROM (SELECT * FROM new EXCEPT ALL SELECT c_custkey, c_name, c_nationkey FROM customer) b")
def change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.mismatches(*_versions(spark, sf_dir)).groupBy("audit").agg(F.count("*").alias("n"))


# --- values, windows and functions outside plain Spark SQL

@_query("SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS near FROM events")
def win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.with_groups(_read(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint")), ["event_type"], ["user_id"])
    return e.select("event_id", F.sum("cents").over(windows.groups_between(["event_type"], -1, 1)).alias("near"))


@_query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM orders")
def win_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    frame = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-3, 3)
    return _read(spark, sf_dir, "orders").select("o_orderkey", windows.sum_excluding_current(F.col("o_orderkey"), frame).alias("others"))


@_query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS done FROM orders")
def win_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _read(spark, sf_dir, "orders").select("o_orderkey", windows.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F", Window.partitionBy("o_custkey")).alias("done"))


@_query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS joined FROM orders GROUP BY o_custkey")
def agg_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(scalar.group_concat(F.col("o_orderkey"), ",", F.col("o_orderkey")).alias("joined"))


@_query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[L-Z].*A..*$')")
def predicate_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").where(scalar.glob(F.col("p_type"), "[L-Z]*A?*")).select("p_partkey")


@_query("SELECT o_orderkey, CASE WHEN nullif(o_orderkey % 4, 0) IS NULL THEN NULL ELSE greatest(o_orderkey % 4, o_custkey % 4) END AS high FROM orders")
def fn_scalar_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", scalar.scalar_max(F.nullif(F.col("o_orderkey") % 4, F.lit(0)), F.col("o_custkey") % 4).alias("high"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", scalar.json_extract(F.col("props"), "$.k").cast("bigint").alias("k"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day, round(julian(o_orderdate) - 0.5, 5) AS jd FROM orders")
def fn_strftime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", scalar.strftime("%Y-%m-%d %H:%M", F.col("o_orderdate")).alias("day"), F.round(scalar.julianday(F.col("o_orderdate")), 5).alias("jd"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' ELSE 'null' END AS kind FROM part")
def fn_typeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, value("integer", k)).when(k % 3 == 1, value("text", F.col("p_name"))).otherwise(value("null"))
    return _read(spark, sf_dir, "part").select("p_partkey", typeof(v).alias("kind"))


@_query("SELECT p_partkey % 5 AS image, count(*) AS n FROM part GROUP BY p_partkey % 5")
def value_key_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, integral reals and numeric texts under numeric affinity are one key."""
    k = F.col("p_partkey") % 5
    v = F.when(F.col("p_partkey") % 3 == 0, value("integer", k)).when(F.col("p_partkey") % 3 == 1, value("real", k.cast("double"))).otherwise(with_affinity(value("text", k.cast("string")), "numeric"))
    rows = _read(spark, sf_dir, "part").select(key_image(v).alias("k"), k.alias("image"))
    return rows.groupBy("k").agg(F.min("image").alias("image"), F.count("*").alias("n")).select("image", "n")


@_query("SELECT event_id FROM events WHERE event_type LIKE 'c%'")
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys survive the flat encoding, and their prefixes stay prefixes."""
    parts = F.array(F.encode(F.substring("event_type", 1, 1), "utf-8"), F.unhex(F.lit("00FF0000")), F.encode(F.col("user_id").cast("string"), "utf-8"))
    rows = _read(spark, sf_dir, "events").select("event_id", parts.alias("key")).withColumn("flat", encode(F.col("key")))
    head = F.array(F.encode(F.lit("c"), "utf-8"))
    return rows.where((decode(F.col("flat")) == F.col("key")) & F.startswith(F.col("flat"), encode(head)) & covers_key(head, F.col("key"))).select("event_id")


@_query("SELECT u, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS u FROM events UNION ALL SELECT CAST(user_id AS VARCHAR) || '/' || event_type FROM events UNION ALL SELECT '' FROM events) t GROUP BY u")
def key_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.array(F.col("user_id").cast("string"), "event_type")
    return _read(spark, sf_dir, "events").select(F.explode(ancestors(key)).alias("p")).groupBy(F.array_join("p", "/").alias("u")).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS opened FROM customer")
def seal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed values open for their own row and for no other."""
    key, own = F.unhex(F.lit("00112233445566778899AABBCCDDEEFF")), F.col("c_custkey").cast("string")
    rows = _read(spark, sf_dir, "customer").withColumn("sealed", seal(F.encode(F.col("c_name"), "utf-8"), key, F.encode(own, "utf-8")))
    back = unseal(F.col("sealed"), key, F.encode(own, "utf-8"))
    other = unseal(F.col("sealed"), key, F.encode(F.concat(own, F.lit("x")), "utf-8"))
    return rows.select("c_custkey", F.decode(back, "utf-8").alias("c_name"), F.decode(other, "utf-8").alias("opened"))


@_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def pseudonym_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with equal first components keep equal first pseudonyms."""
    key = F.array(F.encode(F.col("n_regionkey").cast("string"), "utf-8"), F.encode("n_name", "utf-8"))
    rows = _read(spark, sf_dir, "nation").select("n_regionkey", pseudonyms(key, F.unhex(F.lit("AB" * 32))).alias("p"))
    return rows.groupBy(F.col("p")[0].alias("p")).agg(F.min("n_regionkey").alias("n_regionkey"), F.count("*").alias("n")).select("n_regionkey", "n")


# --- schemas, dialect, streams

@_query("SELECT o_orderkey AS id, o_orderstatus AS state, 'none' AS note FROM orders")
def schema_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written under an old schema, read after a rename, an added and a dropped column."""
    from tablelog.plans.catalog import Column, Table

    first = Table("orders", (Column("id", "INTEGER"), Column("status", "TEXT"), Column("price", "REAL")), ("id",))
    o = _read(spark, sf_dir, "orders")
    stored = first.store(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    later = first.rename_column("status", "state").add_column(Column("note", "TEXT", True, "'none'")).drop_column("price")
    return later.project(stored)


@_query("SELECT * FROM (VALUES (0, 'id', 'INTEGER', 1, NULL, 1), (1, 'body', 'TEXT', 0, '''x''', 0)) t(cid, name, type, \"notnull\", dflt_value, pk)")
def pragma_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.plans.catalog import Column, Table

    return Table("notes", (Column("id", "INTEGER", True), Column("body", "TEXT", False, "'x'")), ("id",)).info(spark)


@_query("SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (lower(c_mktsegment) = 'building') AS b, 'real' AS kind, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS parts, true AS whole FROM customer WHERE c_acctbal IS NOT NULL GROUP BY c_nationkey")
def dialect_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collations, postfix null tests, typeof, group_concat's comma and random() as text."""
    from tablelog.plans.dialect import to_spark

    sql = """SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'building' COLLATE NOCASE) AS b, typeof(1.5) AS kind,
        array_join(array_sort(split(group_concat(DISTINCT c_mktsegment), ',')), ',') AS parts, (SELECT typeof(random())) = 'integer' AS whole
        FROM customer_of_dialect WHERE c_acctbal NOTNULL AND NOT c_name ISNULL GROUP BY c_nationkey"""
    session = spark.newSession()
    session.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer_of_dialect")
    return session.sql(to_spark(sql))


@_query("SELECT c_custkey AS k, c_name AS n FROM customer WHERE lower(c_mktsegment) LIKE 'b%' AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey < 100) ORDER BY c_custkey LIMIT 10 OFFSET 2")
def dialect_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.plans.dialect import to_spark

    sql = """SELECT "c_custkey" AS k, [c_name] AS n FROM customer_of_dialect WHERE c_mktsegment LIKE 'B%' AND c_custkey < 100 AND NOT c_custkey IN () ORDER BY 1 LIMIT 2, 10"""
    session = spark.newSession()
    session.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer_of_dialect")
    return session.sql(to_spark(sql))


@_query(f"WITH {LOG_SQL} SELECT u, e, value FROM visible")
def stream_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log arrives as a stream of files; each micro-batch commits one version of the state."""
    import uuid

    from tablelog.sources.tables import TableStore, pinned
    from tablelog.streaming.replay import materialize_into, once_per_batch, read_log

    rows = event_log(spark, sf_dir)
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartitionByRange(4, "admission_seq").write.parquet(f"{base}/log")
    store = TableStore(spark, f"{base}/store")
    materialize_into(once_per_batch(read_log(spark, f"{base}/log", rows, 4)), store, "state", f"{base}/progress").awaitTermination()
    return _split_key(pinned(store.read("state"))).select("u", "e", "value")


def _shared(spark: SparkSession) -> str:
    import tempfile

    return (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir() + "/tablelog-checkpoint").rstrip("/")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice <= 100000")
def store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction over a versioned store, read back by a statement."""
    import uuid

    from tablelog.plans.connection import Connection

    c = Connection(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
    c.update(lambda t: t.put("orders", _read(spark, sf_dir, "orders")))
    c.update(lambda t: t.change("orders", dml.delete(t.table("orders"), "o_totalprice > 100000"), ["o_orderkey"]))
    return c.query("SELECT o_orderkey, o_custkey FROM orders")


# --- replicas, recursion, stores and statements

@_query("WITH RECURSIVE near(k) AS (SELECT 0 UNION SELECT (k * k + 1) % 25 FROM near) SELECT k, n_name FROM near JOIN nation ON n_nationkey = k")
def recursion_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.operators.recursion import fixpoint

    reached = fixpoint(spark.range(1).select(F.lit(0).alias("k")), lambda new: new.select(((F.col("k") * F.col("k") + 1) % 25).alias("k")))
    return reached.join(_read(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select("k", "n_name")


def _foreign(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and a log of two changes for every third of them by devices 0 to 2."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    image = lambda name: F.struct(k.alias("c_custkey"), name.alias("c_name"))
    base = c.where(k % 3 == 0)
    one = base.select((k * 2).alias("admission_seq"), (k % 2 + 1).alias("device"), image(F.col("c_name")).alias("before"), image(F.concat("c_name", F.lit("!"))).alias("after"))
    last = F.when(k % 4 != 0, image(F.lit("gone over")))
    two = base.select((k * 2 + 1).alias("admission_seq"), (k % 2 + 1).alias("device"), image(F.concat("c_name", F.lit("!"))).alias("before"), last.alias("after"))
    return c, one.unionByName(two)


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'gone over' ELSE c_name END AS c_name FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 1 AND c_custkey % 4 = 0)")
def replica_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.operators.replicate import rebase

    table, foreign = _foreign(spark, sf_dir)
    return rebase(table, foreign, 1, ["c_custkey"])


@_query("SELECT c_custkey, c_name FROM customer")
def replica_roll_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.operators.replicate import rebase, roll_back

    table, foreign = _foreign(spark, sf_dir)
    done = rebase(table, foreign, -1, ["c_custkey"])
    return roll_back(done, foreign.withColumnRenamed("admission_seq", "ordinal"), ["c_custkey"])


@_query("SELECT event_id % 97 AS device_seq, event_id % 3 AS device FROM events WHERE event_id % 97 >= 50 GROUP BY 1, 2")
def replica_submit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablelog.operators.replicate import once

    rows = _read(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("device_seq"), (F.col("event_id") % 3).alias("device"))
    return once(rows, rows.where("device_seq < 50"))


@_query("WITH r AS (SELECT event_id AS txn, user_id, CAST(row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS INTEGER) AS place FROM events), last AS (SELECT user_id, max(event_id) AS one, max(event_id) FILTER (event_id < top) AS two FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS top FROM events) t GROUP BY user_id) SELECT txn, place, CAST(floor((place - 1) / 32) AS BIGINT) AS grp, coalesce(CASE WHEN one = txn THEN two ELSE one END > 2 * txn - 60, false) AS refused FROM r JOIN last USING (user_id)")
def group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is proposed, in eight spaces, against the commits of all events."""
    from tablelog.operators import recursion

    footprints, history = _commits(spark, sf_dir)
    proposals = footprints.select("txn", (F.col("txn") % 8).alias("space"), F.col("txn").alias("arrival"))
    return recursion.group_commit(proposals, footprints, history).withColumnRenamed("group", "grp")


@_query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY k")
def ordered_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from tablelog.sources.ordered import OrderedStore

    kv = OrderedStore(spark, f"{_shared(spark)}/cells-{uuid.uuid4().hex}")
    text = lambda c: F.encode(c.cast("string"), "utf-8")
    kv.apply(_read(spark, sf_dir, "customer").select(F.array(text(F.col("c_mktsegment")), text(F.col("c_custkey"))).alias("key"), text(F.col("c_name")).alias("value"), F.lit(0).alias("ordinal")))
    return kv.scan_prefix([b"BUILDING"]).select(F.decode(F.col("key")[1], "utf-8").cast("bigint").alias("k"), F.decode("value", "utf-8").alias("v"))


@_query("SELECT s_suppkey AS id, upper(s_name) AS name, s_acctbal + 1 AS balance FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'odd', NULL FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey > 5")
def statements_over_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition, upsert, update and delete statements of one transaction, read back."""
    import uuid

    from tablelog.plans.connection import Connection

    c = Connection(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")

    def work(t) -> None:
        t.execute("CREATE TABLE given (id INTEGER PRIMARY KEY, name TEXT, balance REAL)")
        rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
        from tablelog.plans.executor import Executor

        t.put("given", Executor(spark, t).definition("given").store(rows))
        t.execute("CREATE TABLE s (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'odd', balance REAL)")
        t.execute("INSERT INTO s (id) SELECT id FROM given")
        t.execute("INSERT INTO s SELECT id, name, balance FROM given WHERE id % 2 = 0 ON CONFLICT (id) DO UPDATE SET name = upper(excluded.name), balance = excluded.balance")
        t.execute("UPDATE s SET balance = balance + 1 WHERE balance IS NOT NULL")
        t.execute("DELETE FROM s WHERE id IN (SELECT id FROM given WHERE id <= 5) AND name = 'odd'")

    c.update(work)
    return c.query("SELECT id, name, balance FROM s")


def queries() -> dict:
    return {**{n: query_surface.query(n) for n in query_surface.TWINS}, **_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{n: query_surface.oracle(n) for n in query_surface.TWINS}, **_SQL}
