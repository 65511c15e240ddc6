"""Every query of the engine over the test tables, with an independent SQL oracle where SQL can express it.

Log E (events): key = user id as text, seq = event id + 1, errors delete.  Log L (lineitem): key = order/line, seq = shipping day,
ord = four columns, returns delete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.database import Database
from tidelog.functions import bloom, codec
from tidelog.model import DELETE, PUT, Options
from tidelog.operators import compaction, lookup, sorted_tables, state, transactions
from tidelog.sources import logs, runs, wal
from tidelog.sources.shared import materialize, shared_dir
from tidelog.streaming import live

E_SQL = """SELECT cast(user_id AS VARCHAR) AS key, event_id + 1 AS seq, 0 AS ord, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
       CASE WHEN event_type = 'error' THEN '' ELSE coalesce(props, '') END AS value FROM events"""
L_SQL = """SELECT concat_ws('/', l_orderkey, l_linenumber) AS key, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS seq, l_partkey, l_suppkey, l_extendedprice, l_quantity,
       CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS kind FROM lineitem"""
WITH_E = f"WITH v AS ({E_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) AS rn FROM v)"
LIVE_E = f"{WITH_E} SELECT key, seq, value FROM ranked WHERE rn = 1 AND kind = 1"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def live_rows(df: DataFrame) -> DataFrame:
    return df.select("key", "seq", "value")


@query(LIVE_E)
def kv_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(state.visible(logs.events_log(spark, sf_dir)))


@query(LIVE_E)
def kv_live_state_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(state.newest_by_max(logs.events_log(spark, sf_dir), ["value"]).filter("kind = 1"))


@query(f"""WITH v AS ({L_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM v)
SELECT key, seq, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM ranked WHERE rn = 1 AND kind = 1""")
def kv_batch_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.visible(logs.lineitem_log(spark, sf_dir)).select("key", "seq", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(f"{LIVE_E} AND key = '42'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(state.get(logs.events_log(spark, sf_dir), "42"))


@query(f"""{WITH_E}, p AS (SELECT DISTINCT cast(o_custkey AS VARCHAR) AS key FROM orders)
SELECT p.key, r.seq, r.value FROM p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1 AND kind = 1) r USING (key)""")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = logs.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    return live_rows(state.multi_get(probes, logs.events_log(spark, sf_dir)))


@query(f"""WITH v AS ({E_SQL}), ts(t) AS (VALUES (500), (5000)), ranked AS (SELECT t, v.*, row_number() OVER (PARTITION BY t, key ORDER BY seq DESC) AS rn FROM v JOIN ts ON seq <= t WHERE key = '7')
SELECT t AS ts, key, seq, value FROM ranked WHERE rn = 1 AND kind = 1""")
def kv_snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.events_log(spark, sf_dir)
    at = [live_rows(state.get(log, "7", ts)).withColumn("ts", F.lit(ts)) for ts in (500, 5000)]
    return at[0].unionByName(at[1])


@query(f"""WITH v AS ({E_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM v WHERE seq <= 5000)
SELECT key, seq, value FROM ranked WHERE rn = 1 AND kind = 1 AND key >= '1' AND key < '2' ORDER BY key""")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(state.scan(logs.events_log(spark, sf_dir), "1", "2", 5000))


@query(f"{WITH_E} SELECT key, seq, kind, rn AS age, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_to FROM ranked")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(logs.events_log(spark, sf_dir)).select("key", "seq", "kind", F.col("age").cast("long").alias("age"), "valid_to")


@query(f"{WITH_E} SELECT key, seq FROM ranked WHERE rn = 1 AND kind = 2")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(logs.events_log(spark, sf_dir)).select("key", "seq")


@query(f"WITH v AS ({E_SQL}) SELECT key, seq, kind FROM v WHERE key > '42' OR (key = '42' AND seq <= 5000) ORDER BY key, seq DESC LIMIT 1")
def kv_find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seek: the one row is the feature."""
    return state.find_first(logs.events_log(spark, sf_dir), "42", 5000).select("key", "seq", "kind")


@query(f"""{WITH_E} SELECT DISTINCT cast(c_custkey AS VARCHAR) AS key FROM customer
WHERE cast(c_custkey AS VARCHAR) NOT IN (SELECT key FROM ranked WHERE rn = 1 AND kind = 1)""")
def kv_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = logs.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    return state.absent(probes, logs.events_log(spark, sf_dir))


@query(f"WITH v AS ({E_SQL}) SELECT key, sum(octet_length(encode(key)) + octet_length(encode(value)) + 16)::BIGINT AS bytes FROM v GROUP BY key")
def kv_memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events_log(spark, sf_dir).groupBy("key").agg(F.sum(state.version_bytes()).cast("long").alias("bytes"))


@query(f"WITH v AS ({E_SQL}) SELECT (seq - 1) // 100 AS seq, row_number() OVER (PARTITION BY (seq - 1) // 100 ORDER BY seq) - 1 AS ord, kind, key, value FROM v")
def kv_batch_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = logs.events_log(spark, sf_dir).withColumn("ord", F.col("seq")).withColumn("seq", F.expr("(seq - 1) div 100"))
    return logs.decode_batches(logs.batches(given)).withColumn("ord", F.col("ord").cast("long"))


def events_runs(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return logs.events_log(spark, sf_dir).withColumn("run_id", F.expr(f"(seq - 1) div {size}"))


RUNS = """SELECT (seq - 1) // {size} AS run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows, count(*) FILTER (kind = 2) AS n_tombstones,
       min(seq) AS min_seq, max(seq) AS max_seq FROM v GROUP BY ALL"""


@query(f"WITH v AS ({E_SQL}) {RUNS.format(size=1000)}")
def kv_flush_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summaries(events_runs(spark, sf_dir, 1000))


@query(LIVE_E)
def kv_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run is reduced to its newest versions, then the runs are merged."""
    given = events_runs(spark, sf_dir, 1000)
    order = Window.partitionBy("run_id", "key").orderBy(F.desc("seq"), F.desc("ord"))
    flushed = given.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    return live_rows(compaction.merge([flushed]))


@query(f"{WITH_E} SELECT key, (seq - 1) // 1000 AS run_id, seq, kind FROM ranked WHERE rn = 1")
def kv_newest_run_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.newest_run_first(events_runs(spark, sf_dir, 1000)).select("key", "run_id", "seq", "kind")


@query(f"WITH v AS ({E_SQL}), m AS ({RUNS.format(size=100)}), p(key) AS (VALUES ('100'), ('42'), ('zz')) SELECT p.key, m.run_id FROM p JOIN m ON p.key BETWEEN m.min_key AND m.max_key")
def kv_manifest_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([("100",), ("42",), ("zz",)], "key string")
    return lookup.prune_runs(probes, runs.summaries(events_runs(spark, sf_dir, 100)))


@query("""WITH b AS (SELECT cast(p_partkey AS VARCHAR) AS last_key FROM part WHERE p_partkey % 10 = 0), p AS (SELECT DISTINCT cast(o_custkey AS VARCHAR) AS key FROM orders)
SELECT p.key, (SELECT min(last_key) FROM b WHERE last_key >= p.key) AS last_key FROM p""")
def kv_find_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = logs.read(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("last_key"))
    probes = logs.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct()
    return lookup.find_block(probes, index)


GC = """, c AS (SELECT *, row_number() OVER (PARTITION BY key, seq <= 6000 ORDER BY seq DESC) AS crn FROM v)
SELECT key, seq, kind, value FROM c WHERE seq > 6000 OR (crn = 1 AND kind = 1)"""


@query(f"WITH v AS ({E_SQL}){GC}")
def kv_gc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.collect_versions(logs.events_log(spark, sf_dir), 6000).select("key", "seq", "kind", "value")


@query(f"{WITH_E} SELECT key, seq, kind, value FROM ranked WHERE rn = 1 AND kind = 1")
def kv_compact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = events_runs(spark, sf_dir, 5000)
    parts = [given.filter(F.col("run_id") % 2 == k).drop("run_id") for k in (0, 1)]
    return compaction.compact(parts).select("key", "seq", "kind", "value")


@query(f"{WITH_E.replace(' FROM events', ' FROM events WHERE event_id >= 5000')} SELECT key, seq, kind FROM ranked WHERE rn = 1")
def kv_compact_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction above other runs keeps its tombstones."""
    return compaction.compact([logs.events_log(spark, sf_dir).filter("seq > 5000")], bottommost=False).select("key", "seq", "kind")


@query(f"WITH v AS (SELECT * FROM ({E_SQL}) UNION ALL SELECT * FROM ({E_SQL})), ranked AS (SELECT DISTINCT *, dense_rank() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM v) SELECT key, seq, value FROM ranked WHERE rn = 1 AND kind = 1")
def kv_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.events_log(spark, sf_dir)
    return live_rows(state.visible(log.unionByName(log)))


@query("""WITH r AS (SELECT event_id // 1000 AS segment, event_id AS "offset", event_id % 97 = 96 AS bad FROM events),
s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT segment, "offset" FROM s WHERE n = 0""")
def kv_wal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = logs.read(spark, sf_dir, "events")
    records = events.select(F.expr("event_id div 1000").alias("segment"), F.col("event_id").alias("offset"), (F.col("event_id") % 97 == 96).alias("bad"))
    return wal.valid_prefix(records).select("segment", "offset")


def _varint_sql(n: str) -> str:
    return f"CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 WHEN {n} < 268435456 THEN 4 ELSE 5 END"


K, V = "octet_length(encode(key))", "octet_length(encode(value))"


@query(f"WITH v AS ({E_SQL}) SELECT key, seq, (22 + {_varint_sql(K)} + {_varint_sql(V)} + {K} + {V})::BIGINT AS bytes FROM v")
def kv_wal_frame_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events_log(spark, sf_dir).select("key", "seq", wal.frame_length(F.col("key"), F.col("value")).alias("bytes"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, strlen(coalesce(text, '')) + 9 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
w AS (SELECT source, doc_id, i, size AS used, 0 AS no FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN w.used + d.size > 50000 THEN d.size ELSE w.used + d.size END, w.no + CASE WHEN w.used + d.size > 50000 THEN 1 ELSE 0 END
  FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1)
SELECT source, doc_id, no AS group_no FROM w""")
def kv_wal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = logs.read(spark, sf_dir, "documents").select("source", "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 9).cast("long").alias("size"))
    return lookup.greedy_groups(docs, "source", "doc_id", "size", 50_000).select("source", "doc_id", "group_no")


@query("""WITH k AS (SELECT DISTINCT cast(user_id AS VARCHAR) AS key FROM events),
t AS (SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN i < 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n))
SELECT key, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
  lambda c, b: xor(crc[(xor(c, b) & 255) + 1]::BIGINT, c >> 8)), 4294967295) AS crc FROM k, t""")
def kv_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = logs.events_log(spark, sf_dir).select("key").distinct()
    return keys.select("key", codec.crc32c(F.col("key")).alias("crc"))


@query("""WITH k AS (SELECT DISTINCT cast(user_id AS VARCHAR) AS key FROM events),
h AS (SELECT key, list_reduce([14695981039346656037::UHUGEINT] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::UHUGEINT),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM k)
SELECT key, (h // 4294967296::UHUGEINT)::BIGINT AS hi, (h % 4294967296::UHUGEINT)::BIGINT AS lo FROM h""")
def kv_fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = logs.events_log(spark, sf_dir).select("key").distinct()
    return keys.select("key", codec.fnv1a64(F.col("key")).alias("h")).select("key", "h.hi", "h.lo")


@query("SELECT event_id, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 WHEN n < 34359738368 THEN 5 WHEN n < 4398046511104 THEN 6 WHEN n < 562949953421312 THEN 7 WHEN n < 72057594037927936 THEN 8 ELSE 9 END AS bytes, n AS back FROM (SELECT event_id, event_id * event_id * event_id * 1009 AS n FROM events)")
def kv_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the code, and the number read back from it.  Numbers wrap at 2^64: from event 209,090 on they exceed a long, where the
    SQL has no result but an error; those from 2^63 on take ten bytes and are given as negative longs."""
    n = codec.wrapping_product(F.col("event_id"), F.col("event_id"), F.col("event_id"), F.lit(1009).cast("long"))
    numbers = logs.read(spark, sf_dir, "events").select("event_id", n.alias("n"))
    coded = numbers.select("event_id", codec.varint_encode(F.col("n")).alias("code"))
    return coded.select("event_id", F.octet_length("code").alias("bytes"), codec.varint_decode(F.col("code")).alias("back"))


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events), m AS (SELECT n, greatest(64, ceil(-n * ln(0.01) / (0.6931471805599453 * 0.6931471805599453)))::BIGINT AS m FROM n)
SELECT n, m, least(16, greatest(1, floor(m / greatest(n, 1) * 0.6931471805599453 + 0.5)))::BIGINT AS k FROM m""")
def kv_bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = logs.events_log(spark, sf_dir).agg(F.countDistinct("key").alias("n"))
    m, k = bloom.size_columns(F.col("n"))
    return n.select("n", m.alias("m"), k.alias("k"))


_TWO64, _SEED = "18446744073709551616::UHUGEINT", f"{bloom.SEED}::UHUGEINT"


def _fnv_sql(data: str, seed: str) -> str:
    """FNV-1a of a list of bytes, from the offset basis under a seed."""
    return f"list_reduce([xor(14695981039346656037::UHUGEINT, {seed})] || {data}, lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_TWO64})"


def _mix_sql(name: str, source: str, of: str) -> str:
    """CTEs that mix the column `of` of `source` into a column `mixed`."""
    shift = lambda x: f"xor({x}, {x} // 8589934592::UHUGEINT)"
    return f"""{name}1 AS (SELECT *, {shift(of)} AS m1 FROM {source}), {name}2 AS (SELECT *, (m1 * 18397679294719823053::UHUGEINT) % {_TWO64} AS m2 FROM {name}1),
{name}3 AS (SELECT *, ({shift("m2")} * 14181476777654086739::UHUGEINT) % {_TWO64} AS m3 FROM {name}2), {name} AS (SELECT * EXCLUDE (m1, m2, m3), {shift("m3")} AS mixed FROM {name}3)"""


def _bits_sql(keys: str, n: int | str) -> str:
    """CTEs: size (n, m, k) of n keys, and bits(key, bit) of every key in the CTE `keys`."""
    bytes_of = "list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::UHUGEINT)"
    little = f"list_transform(range(8), lambda i: (h // power(256, i)::UHUGEINT) % 256::UHUGEINT)"
    return f"""size AS (SELECT n, m, least(16, greatest(1, floor(m / greatest(n, 1) * 0.6931471805599453 + 0.5)))::BIGINT AS k
  FROM (SELECT n, greatest(64, ceil(-n * ln(0.01) / (0.6931471805599453 * 0.6931471805599453)))::BIGINT AS m FROM ({n}) c(n))),
plain AS (SELECT key, {_fnv_sql(bytes_of, "0::UHUGEINT")} AS h FROM {keys}), seeded AS (SELECT key, {_fnv_sql(little, _SEED)} AS s FROM plain),
{_mix_sql("first", "seeded", "s")}, again AS (SELECT key, mixed AS h1, xor(mixed, {bloom.SEED * int(bloom.GOLDEN) % (1 << 64)}::UHUGEINT) AS x FROM first),
{_mix_sql("second", "again", "x")}, bits AS (SELECT key, (((h1 + i::UHUGEINT * mixed) % {_TWO64}) % m::UHUGEINT)::BIGINT AS bit FROM (SELECT *, unnest(range(k)) AS i FROM second, size))"""


USERS_SQL = "users AS (SELECT DISTINCT cast(user_id AS VARCHAR) AS key FROM events)"
N_USERS = "SELECT count(*) FROM users"


@query(f"WITH {USERS_SQL}, {_bits_sql('users', N_USERS)} SELECT DISTINCT bit FROM bits")
def kv_bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of a filter of the event users.  A job counts the keys first, as the filter is sized by them."""
    keys = logs.events_log(spark, sf_dir).select("key").distinct()
    return bloom.build(keys, keys.count())


@query(f"""WITH {USERS_SQL}, asked AS (SELECT DISTINCT cast(c_custkey AS VARCHAR) AS key FROM customer),
every AS (SELECT key FROM users UNION SELECT key FROM asked), {_bits_sql('every', N_USERS)},
filled AS (SELECT DISTINCT bit FROM bits JOIN users USING (key))
SELECT key, bool_and(f.bit IS NOT NULL) AS may_contain FROM asked JOIN bits USING (key) LEFT JOIN filled f ON bits.bit = f.bit GROUP BY key""")
def kv_bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a filter of the event users.  A job counts the keys first."""
    keys = logs.events_log(spark, sf_dir).select("key").distinct()
    n = keys.count()
    probes = logs.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    return bloom.may_contain(probes, bloom.build(keys, n), n)


@query(f"""WITH {USERS_SQL}, h AS (SELECT key, {_fnv_sql("list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::UHUGEINT)", "7::UHUGEINT")} AS h FROM users), {_mix_sql("m", "h", "h")}
SELECT key, (mixed // 4294967296::UHUGEINT)::BIGINT AS hi, (mixed % 4294967296::UHUGEINT)::BIGINT AS lo FROM m""")
def kv_seeded_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's own hash: FNV-1a under a seed (7 here), then the 64-bit mixer."""
    keys = logs.events_log(spark, sf_dir).select("key").distinct()
    mixed = bloom.mixed_column(F.col("key"), 7)
    return keys.select("key", F.call_function("shiftrightunsigned", mixed, F.lit(32)).alias("hi"), mixed.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("lo"))


def text_rows(df: DataFrame, columns: tuple[str, ...] = ("key", "value")) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c in ("key", "value") else F.col(c) for c in columns])


LIVE_ROWS = f"{WITH_E}, live AS (SELECT key, value FROM ranked WHERE rn = 1 AND kind = 1)"


@query(f"{LIVE_ROWS} SELECT key, value FROM live")
def kv_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live state built into binary sorted tables, which are opened again and iterated block by block."""
    return text_rows(sorted_tables.scan_tables(sorted_tables.written(state.visible(logs.events_log(spark, sf_dir)), 40)))


@query(f"{LIVE_ROWS} SELECT key, value FROM live WHERE key >= '13' AND key < '42'")
def kv_table_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = sorted_tables.written(state.visible(logs.events_log(spark, sf_dir)), 40)
    return text_rows(sorted_tables.scan_tables(tables, b"13", b"42"))


@query(f"{LIVE_ROWS} SELECT key, value FROM live WHERE key IN (SELECT cast(c_custkey AS VARCHAR) FROM customer)")
def kv_table_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers looked up in binary sorted tables: table by last key, filter, index, block."""
    probes = logs.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return text_rows(sorted_tables.get_from_tables(sorted_tables.written(state.visible(logs.events_log(spark, sf_dir)), 40), probes))


@query(f"{LIVE_ROWS}, n AS (SELECT count(*) AS n FROM live) SELECT count(*)::BIGINT AS n_rows, min(key) AS min_key, max(key) AS max_key FROM live")
def kv_table_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the facts of all tables add up to: every live row in one table, none twice."""
    tables = sorted_tables.written(state.visible(logs.events_log(spark, sf_dir)), 40)
    return tables.agg(F.sum("n_rows").cast("long").alias("n_rows"), F.min("min_key").cast("string").alias("min_key"), F.max("max_key").cast("string").alias("max_key"))


def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log as bytes of log segments of a thousand batches each."""
    return materialize(wal.encode_segments(logs.events_log(spark, sf_dir).withColumn("segment", F.expr("(seq - 1) div 1000"))), "segments")


@query(f"WITH v AS ({E_SQL}) SELECT key, seq, ord, kind, value FROM v")
def kv_wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to checksummed frames in segments, and back."""
    return text_rows(wal.replay_contents(log_segments(spark, sf_dir)), ("key", "seq", "ord", "kind", "value"))


@query(f"""WITH v AS ({E_SQL}), last AS (SELECT (seq - 1) // 1000 AS segment, max(seq) AS seq FROM v GROUP BY ALL)
SELECT key, v.seq, kind FROM v JOIN last ON (v.seq - 1) // 1000 = segment WHERE segment % 2 = 0 OR v.seq < last.seq""")
def kv_wal_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second segment lost its last two bytes: its last frame, and only that one, is gone."""
    torn = log_segments(spark, sf_dir).withColumn("content", F.expr("if(segment % 2 = 1, substring(content, 1, octet_length(content) - 2), content)"))
    return text_rows(wal.replay_contents(torn), ("key", "seq", "kind"))


@query("SELECT (event_id) // 1000 AS segment, event_id % 1000 AS place FROM events WHERE event_id % 1000 < 500")
def kv_wal_bad_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flipped bit in the frame of every segment's batch of place 500: it and all behind it go."""
    events = logs.read(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("segment"), (F.col("event_id") + 1).alias("seq"))
    rows = events.select("segment", F.lit("key").alias("key"), "seq", F.lit(0).alias("ord"), F.lit(1).alias("kind"), F.lit("12345").alias("value"))
    length = 30 + len("key12345") - 6  # of such a frame: 22 bytes, two lengths, key and value
    broken = wal.encode_segments(rows).withColumn("content", F.expr(f"overlay(content PLACING X'FF' FROM {500 * length + 20} FOR 1)"))
    return wal.replay_contents(materialize(broken, "broken")).select(F.expr("(seq - 1) div 1000").alias("segment"), F.expr("(seq - 1) % 1000").alias("place"))


def database(spark: SparkSession, name: str, options: Options = Options()) -> Database:
    return Database.open(spark, f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}", options)


@query("""SELECT n_name AS key, 'region ' || n_regionkey AS value FROM nation WHERE n_regionkey NOT IN (0, 1)
UNION ALL SELECT n_name, 'again' FROM nation WHERE n_regionkey = 1""")
def kv_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened empty, written (a batch for each region's nations, then deletes and overwrites), closed, and opened again from the log
    alone.  The embedded writer is one process by nature; the table is as small at every scale."""
    rows = logs.read(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()
    db = database(spark, "recovery")
    for region in sorted({r["n_regionkey"] for r in rows}):
        db.write((PUT, r["n_name"], f"region {region}") for r in rows if r["n_regionkey"] == region)
    db.write((DELETE, r["n_name"], "") for r in rows if r["n_regionkey"] == 0)
    db.write((PUT, r["n_name"], "again") for r in rows if r["n_regionkey"] == 1)
    db.close()
    return text_rows(Database.open(spark, db.path).scan())


def filled(spark: SparkSession, sf_dir: str, name: str) -> Database:
    """A database with the events log in two runs, the older half in the first."""
    db, log = database(spark, name), logs.events_log(spark, sf_dir).withColumn("ord", F.col("seq").cast("int"))
    for part in (log.filter("seq <= 5000"), log.filter("seq > 5000")):
        db.append(part)
    return db


@query(f"WITH v AS ({E_SQL}) SELECT CASE WHEN seq <= 5000 THEN 1 ELSE 2 END::BIGINT AS run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows, count(*) FILTER (kind = 2) AS n_tombstones FROM v GROUP BY ALL")
def kv_manifest_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bulk writes become runs; a database opened anew reads them from the manifest."""
    found = Database.open(spark, filled(spark, sf_dir, "manifest").path).manifest_frame()
    return found.select("run_id", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"), "n_rows", "n_tombstones")


@query(f"{LIVE_ROWS} SELECT key, value FROM live")
def kv_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged reading over written runs, found through the manifest."""
    return text_rows(filled(spark, sf_dir, "runs").scan())


@query(f"{LIVE_ROWS} SELECT key, value FROM live WHERE key IN (SELECT cast(c_custkey AS VARCHAR) FROM customer)")
def kv_run_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of written runs, by key range and Parquet's Bloom filters."""
    probes = logs.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    return text_rows(filled(spark, sf_dir, "get").multi_get(probes).filter("value IS NOT NULL"))


@query(f"{LIVE_ROWS} SELECT key, value FROM live")
def kv_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a backup, opened as a database at a third place."""
    db = filled(spark, sf_dir, "live")
    db.backup(f"{db.path}-backup")
    return text_rows(Database.restore(spark, f"{db.path}-backup", f"{db.path}-again").scan())


@query(f"{WITH_E} SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_tombstones, 1 AS run_folders FROM ranked WHERE rn = 1 AND kind = 1")
def kv_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a compaction, the expiry of old manifests and the removal of what only they named."""
    db = filled(spark, sf_dir, "space")
    db.compact()
    db.expire()
    db.vacuum()
    left = db.info()["run_folders"]
    return db.manifest_frame().agg(F.sum("n_rows").alias("n_rows"), F.sum("n_tombstones").alias("n_tombstones")).withColumn("run_folders", F.lit(left))


@query(f"WITH v AS ({E_SQL}) SELECT a.key, a.seq AS winner, b.seq AS loser FROM v a JOIN v b ON a.key = b.key AND b.seq - 10 < a.seq AND a.seq < b.seq")
def kv_si_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = logs.events_log(spark, sf_dir).select("key", (F.col("seq") - 10).alias("start"), F.col("seq").alias("commit"))
    return transactions.write_conflicts(writes)


@query(f"WITH v AS ({E_SQL}), r AS (SELECT *, coalesce(max(CASE WHEN kind = 2 THEN seq END) OVER (PARTITION BY key), -1) AS reset FROM v) SELECT key, count(*) AS n FROM r WHERE kind = 1 AND seq > reset GROUP BY key")
def kv_incr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.increments(logs.events_log(spark, sf_dir))


@query(f"WITH v AS ({E_SQL}), o AS (SELECT key, lag(key) OVER (PARTITION BY (seq - 1) // 1000 ORDER BY key, seq DESC) AS before FROM v) SELECT count(*) AS violations FROM o WHERE before >= key")
def kv_key_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that keep all versions repeat keys, so the strict order of a reduced run is violated; the count shows how often."""
    order = Window.partitionBy("run_id").orderBy("key", F.desc("seq"))
    placed = events_runs(spark, sf_dir, 1000).withColumn("pos", F.row_number().over(order))
    return state.order_violations(placed).agg(F.count("*").alias("violations"))


@query(LIVE_E)
def kv_stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, folded into the newest version of each key, then read as a table."""
    at = f"{shared_dir(spark)}/tidelog/stream-{uuid.uuid4().hex}"
    log = logs.events_log(spark, sf_dir)
    log.write.parquet(f"{at}/log")
    stream = live.read_log_stream(spark, f"{at}/log", log.schema)
    live.run_available(live.newest_stream(stream), f"{at}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/state/batch={n}"))
    newest = state.newest(spark.read.parquet(f"{at}/state"))
    return live_rows(newest.filter("kind = 1"))


@query("SELECT event_type AS op, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def kv_op_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = logs.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("op", "n", (F.col("n") / F.col("all")).alias("share"))
