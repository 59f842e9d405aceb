"""Event log, lookups and job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import scalars
from cataloom.operators import eventlog, files, jobs, lookups
from cataloom.plans.registry import Plans
from cataloom.sources.tables import table
from cataloom.streaming import stateful

plans = Plans()

#: Line items that a task keeps at once.
LINES = 200_000


@plans.add("SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def compact_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return eventlog.compact(events, ["event_type", "user_id"], "event_id")


@plans.add("SELECT event_type, count(*) AS n, CAST(count(*) - count(user_id) AS BIGINT) AS without_key, max(event_id) AS tail FROM events GROUP BY event_type")
def topic_tails(spark, sf_dir):
    return eventlog.topic_tails(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@plans.add("SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type IN ('click', 'view') ORDER BY event_id LIMIT 100")
def tail_after_cursor(spark, sf_dir):
    return eventlog.after_cursor(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 500, ["click", "view"], "event_type", 100)


@plans.add("SELECT conv_id AS \"group\", count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def group_by_correlation(spark, sf_dir):
    rows = eventlog.grouped_by(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", F.col("role"))
    return rows.select("group", F.size("events").cast("long").alias("n"), F.array_join("events.body", ",").alias("roles"))


@plans.add("SELECT CASE WHEN event_id % 5 = 0 THEN 'e:' || event_id ELSE 'g:' || user_id || '/' || (event_id // 250) END AS chunk, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def chunks_by_correlation(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("by"))
    return eventlog.chunked(events, "event_id", 250, "by").groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from the event table: each event type stands for a file state."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return events.withColumn("status", ((F.length("event_type") * F.col("event_id") + F.col("event_id") % 7) % 6 + 1).cast("int"))


STATES_SQL = "s AS (SELECT user_id, event_id // 500 AS grp, CAST((length(event_type) * event_id + event_id % 7) % 6 + 1 AS INTEGER) AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


@plans.add(f"""
WITH RECURSIVE {STATES_SQL},
f AS (SELECT user_id, i, status AS state FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, CASE WHEN state IN (2, 5) OR status > state THEN status ELSE state END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, arg_max(state, i) AS state FROM f GROUP BY user_id""")
def status_fold(spark, sf_dir):
    return eventlog.fold_states(file_states(spark, sf_dir), "user_id", "event_id", F.col("status"))


@plans.add(f"""
WITH RECURSIVE {STATES_SQL},
f AS (SELECT user_id, i, status AS step, grp FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, CASE WHEN status > step OR s.grp <> f.grp THEN status ELSE step END, s.grp FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, arg_max(step, i) AS step, CAST(arg_max(grp, i) AS VARCHAR) AS correlation FROM f GROUP BY user_id""")
def lookup_fold(spark, sf_dir):
    rows = file_states(spark, sf_dir).withColumn("by", (F.col("event_id") / 500).cast("long"))
    return eventlog.fold_lookups(rows, "user_id", "event_id", F.col("status"), "by")


@plans.add("SELECT user_id, event_type AS error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value < 50")
def latest_failures(spark, sf_dir):
    return eventlog.latest_failures(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") < 50, F.col("event_type"))


@plans.add("SELECT event_type AS error, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value < 50 GROUP BY 1")
def failure_histogram(spark, sf_dir):
    return latest_failures(spark, sf_dir).groupBy("error").agg(F.count("*").alias("n"))


@plans.add("SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) > 330 AS throttled FROM events GROUP BY 1")
def rate_window_throttle(spark, sf_dir):
    return eventlog.windows_over_limit(table(spark, sf_dir, "events"), "ts", "1 day", 330)


@plans.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of the list of their customer, parts as the items; the state follows from the key."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = orders.select("o_orderkey", F.col("o_custkey").alias("root")).join(line.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    segments = both.groupBy("root", "o_orderkey").agg(F.collect_set(F.concat(F.lit("i"), F.col("l_partkey").cast("string"))).alias("items"), F.collect_set(F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("siblings"))
    found = lookups.list_components(segments, "root", "siblings", "items")
    states = found.select("component").distinct().where("component not like '%7'").select(F.col("component").alias("key"), (F.substring("component", 2, 12).cast("long") % 6 + 1).cast("int").alias("state"))
    # Lists with a small root are done.
    out = lookups.component_states(found, states, "key")
    return out.withColumn("state", F.when(F.col("root") % 5 == 0, F.when(F.col("state") % 2 == 0, 5).otherwise(6)).when(F.col("root") % 5 == 1, F.when(F.col("component").startswith("s"), 1).otherwise(F.col("state"))).when(F.col("root") % 5 == 2, 5).otherwise(F.col("state")))


COMPONENTS_SQL = """
comp AS (SELECT DISTINCT root, component FROM (SELECT o_custkey AS root, 'i' || CAST(l_partkey AS VARCHAR) AS component FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT o_custkey, 's' || CAST(o_orderkey AS VARCHAR) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)),
st AS (SELECT root, component, CASE WHEN component LIKE '%7' THEN 1 ELSE CAST(substr(component, 2) AS BIGINT) % 6 + 1 END AS s0 FROM comp),
states AS (SELECT root, component, CASE WHEN root % 5 = 0 THEN CASE WHEN s0 % 2 = 0 THEN 5 ELSE 6 END
  WHEN root % 5 = 1 THEN CASE WHEN component LIKE 's%' THEN 1 ELSE s0 END WHEN root % 5 = 2 THEN 5 ELSE s0 END AS state FROM st)"""


@plans.add(f"""
WITH {COMPONENTS_SQL},
k AS (SELECT root, count(*) FILTER (WHERE component LIKE 's%') AS segments, count(*) FILTER (WHERE component LIKE 's%' AND state IN (4, 5, 6)) AS parsed, count(*) AS n,
  count(*) FILTER (WHERE state = 5) AS failed, count(*) FILTER (WHERE state IN (5, 6)) AS terminal, count(*) FILTER (WHERE state = 6) AS updated FROM states GROUP BY root)
SELECT c_custkey AS root, CASE WHEN coalesce(segments, 0) = 0 THEN 'Invalid' WHEN parsed = 0 THEN 'Started' WHEN parsed < segments THEN 'InProgress' WHEN failed = n THEN 'Failed'
  WHEN terminal = n THEN 'Completed' ELSE 'InProgress' END AS status, CAST(coalesce(round(100.0 * updated / nullif(n, 0)), 0) AS INTEGER) AS completion
FROM customer LEFT JOIN k ON root = c_custkey""")
def list_status(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"))
    return lookups.list_status(roots, _components(spark, sf_dir).withColumn("is_segment", F.col("component").startswith("s")), "root", "is_segment")


@plans.add(f"WITH {COMPONENTS_SQL} SELECT root, component FROM states WHERE state IN (1, 2)")
def dormant_components(spark, sf_dir):
    return lookups.dormant(_components(spark, sf_dir)).select("root", "component")


@plans.add(f"""
WITH {COMPONENTS_SQL},
k AS (SELECT root, count(*) FILTER (WHERE component LIKE 's%') AS segments, count(*) FILTER (WHERE component LIKE 's%' AND state IN (4, 5, 6)) AS parsed, count(*) AS n,
  count(*) FILTER (WHERE state = 5) AS failed, count(*) FILTER (WHERE state IN (5, 6)) AS terminal, count(*) FILTER (WHERE state = 6) AS updated, count(*) FILTER (WHERE state IN (1, 2)) AS enqueued FROM states GROUP BY root)
SELECT 'list/' || c_custkey AS key, '{{"status":"' || CASE WHEN coalesce(segments, 0) = 0 THEN 'Invalid' WHEN parsed = 0 THEN 'Started' WHEN parsed < segments THEN 'InProgress' WHEN failed = n THEN 'Failed'
  WHEN terminal = n THEN 'Completed' ELSE 'InProgress' END || '","completion":' || CAST(coalesce(round(100.0 * updated / nullif(n, 0)), 0) AS INTEGER) || '}}' AS event, coalesce(enqueued, 0) AS enqueued
FROM customer LEFT JOIN k ON root = c_custkey""")
def list_run(spark, sf_dir):
    """A run of all lists: the event of each, and how many of its components are enqueued again."""
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"))
    enqueued, _, events = lookups.run_lists(roots, _components(spark, sf_dir).withColumn("is_segment", F.col("component").startswith("s")), "root", "is_segment")
    counts = enqueued.groupBy(F.concat(F.lit("list/"), F.col("root").cast("string")).alias("key")).agg(F.count("*").alias("enqueued"))
    return events.join(counts, "key", "left").select("key", "event", F.coalesce("enqueued", F.lit(0)).alias("enqueued"))


@plans.add("""
WITH saved AS (SELECT o_orderkey AS file_name FROM orders WHERE o_orderpriority = '1-URGENT'), gone AS (SELECT o_orderkey AS file_name FROM orders WHERE o_orderstatus = 'P'),
old AS (SELECT o_orderkey AS file_name, o_orderdate AS saved_at FROM orders WHERE o_orderstatus <> 'O'),
put AS (SELECT file_name, saved_at FROM old WHERE file_name NOT IN (SELECT file_name FROM saved) UNION ALL SELECT file_name, TIMESTAMP '2024-02-01' FROM saved)
SELECT 'metadata' AS kind, count(*) AS n, count(*) FILTER (WHERE saved_at = TIMESTAMP '2024-02-01') AS fresh FROM put WHERE file_name NOT IN (SELECT file_name FROM gone)
UNION ALL SELECT 'FileSaved', count(*), 0 FROM saved UNION ALL SELECT 'FileDeleted', count(*), 0 FROM put WHERE file_name IN (SELECT file_name FROM gone)""")
def file_put_and_delete(spark, sf_dir):
    """Metadata and events after some files were saved and others deleted."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_name"), F.col("o_orderdate").alias("last_saved_at"), "o_orderstatus", "o_orderpriority")
    old = orders.where("o_orderstatus <> 'O'").select("file_name", "last_saved_at")
    now = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    metadata, saved = files.put_files(old, orders.where("o_orderpriority = '1-URGENT'").select("file_name"), now, [F.col("last_saved_at")])
    metadata, gone = files.delete_files(metadata, orders.where("o_orderstatus = 'P'").select("file_name"))
    counts = metadata.select(F.lit("metadata").alias("kind"), (F.col("last_saved_at") == now).cast("int").alias("fresh")).unionByName(saved.unionByName(gone).select(F.col("event").alias("kind"), F.lit(0).alias("fresh")))
    return counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@plans.add("SELECT DISTINCT o_custkey AS root FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 100 = 3 OR o_orderkey % 500 = 9")
def lookups_touched(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    both = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("root")).join(line, "o_orderkey")
    # A list's pages meet in one of as many tasks as the line items fill.
    segments = both.repartition(line.count() // LINES + 1, "root").groupBy("root", "o_orderkey").agg(F.collect_set(F.concat(F.lit("i"), F.col("l_partkey").cast("string"))).alias("items"), F.collect_set(F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("siblings"))
    changed = both.select(F.explode(F.array(F.when(F.col("l_partkey") % 100 == 3, F.concat(F.lit("i"), F.col("l_partkey").cast("string"))), F.when(F.col("o_orderkey") % 500 == 9, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))))).alias("key")).where("key is not null").distinct()
    return lookups.touched(segments, changed, "root", "siblings", "items")


@plans.add("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_acctbal < 0")
def pending_imports(spark, sf_dir):
    imports = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.col("c_custkey").alias("identity"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "AlbumParsed").otherwise("Started").alias("status"))
    return lookups.pending_imports(imports, found, "identity").select("c_custkey", "o_orderkey")


@plans.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'crawl_search' WHEN o_custkey % 2 = 0 THEN 'use_album' ELSE 'crawl_album' END AS action FROM orders")
def album_lookup_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("parsed", F.col("o_orderstatus") != "O").withColumn("known", F.col("o_custkey") % 2 == 0)
    return rows.select("o_orderkey", lookups.album_lookup_step().alias("action"))


@plans.add("""
WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 7 = 6 AND event_id % 2 = 0 THEN NULL ELSE user_id END AS k, event_id % 7 AS kind, CAST(event_id % 50 AS VARCHAR) AS album FROM events),
known AS (SELECT DISTINCT album FROM e WHERE k IS NULL AND CAST(album AS INTEGER) % 4 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS i FROM e WHERE k IS NOT NULL),
f AS (SELECT k, 0::BIGINT AS i, 0 AS step, NULL::VARCHAR AS album FROM (SELECT DISTINCT k FROM s)
  UNION ALL SELECT s.k, s.i, CASE WHEN step = 0 THEN CASE WHEN kind = 0 THEN 2 ELSE 0 END WHEN kind = 1 AND step < 3 THEN 3 WHEN kind = 3 AND step < 4 THEN 4 WHEN kind = 2 AND step < 5 THEN 6
    WHEN f.album IS NULL THEN step WHEN kind = 4 AND step < 7 THEN 7 WHEN kind = 5 AND step < 8 THEN 8 WHEN kind = 6 THEN 9 ELSE step END,
    CASE WHEN kind = 2 AND step BETWEEN 1 AND 4 THEN s.album ELSE f.album END FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1),
last AS (SELECT k, arg_max(step, i) AS step, arg_max(CASE WHEN album IS NULL THEN '' ELSE album END, i) AS album FROM f GROUP BY k)
SELECT 'lookup:' || k AS key, nullif(album, '') AS album, CASE WHEN album IN (SELECT album FROM known) THEN 'AlbumParsed'
  ELSE ['', 'SearchCrawling', 'SearchParsing', 'SearchParseFailed', '', 'AlbumCrawling', 'AlbumParsing', 'AlbumParseFailed', 'AlbumParsed'][step] END AS step FROM last WHERE step > 0""")
def lookup_outcomes(spark, sf_dir):
    """How far the lookup of each user gets, from its events and albums that are parsed for other reasons."""
    kinds = ["Started", "SearchSaved", "SearchParsed", "SearchParseFailed", "AlbumSaved", "AlbumParseFailed", "AlbumParsed"]
    kind, album = F.col("event_id") % 7, (F.col("event_id") % 50).cast("string")
    other = (kind == 6) & (F.col("event_id") % 2 == 0)
    key = F.when(other, F.when(F.col("event_id") % 50 % 4 == 0, F.concat(F.lit("album:"), album))).otherwise(F.concat(F.lit("lookup:"), F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), key.alias("key"), F.array(*map(F.lit, kinds))[kind.cast("int")].alias("kind"), F.lit("page").alias("file_name"), album.alias("detail"))
    return stateful.lookup_outcomes(rows.where("key is not null")).select("key", "album", "step")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: priority, due date, some claimed."""
    o = table(spark, sf_dir, "orders")
    claimed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("next_execution"), claimed.alias("claimed_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderkey") % 2 == 0, 3600).alias("interval_seconds"))


@plans.add("SELECT o_orderkey AS id, o_orderstatus AS name FROM orders WHERE o_orderkey IN (SELECT l_orderkey + 1 FROM lineitem WHERE l_quantity > 40)")
def find_jobs(spark, sf_dir):
    """The jobs of some ids; ids repeat, and some have no job."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select((F.col("l_orderkey") + 1).alias("id"))
    return jobs.find(_jobs(spark, sf_dir), ids).select("id", "name")


@plans.add("SELECT event_id, date_trunc('milliseconds', ts) AS made_at FROM events")
def ulid_times(spark, sf_dir):
    """The time of each event, read back from an id that begins with it."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    digits = [F.substring(F.lit(scalars.ULID_DIGITS), (F.floor(ms / F.lit(32**k)) % 32 + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    ids = table(spark, sf_dir, "events").where("ts is not null").select("event_id", F.concat(*digits, F.lit("0" * 16)).alias("ulid"))
    return ids.select("event_id", scalars.ulid_time(F.col("ulid")).cast("timestamp_ntz").alias("made_at"))


NOW = "1996-01-01"


@plans.add(f"""
SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '{NOW}'
  AND (o_orderkey % 3 <> 0 OR o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 600 SECOND) ORDER BY priority, o_orderdate, id LIMIT 25""")
def claim_next_jobs(spark, sf_dir):
    return jobs.next_jobs(_jobs(spark, sf_dir), "F", F.lit(NOW).cast("timestamp_ntz"), 25).select("id", "priority")


@plans.add("""
SELECT name, coalesce(n, 0) AS jobs, coalesce(c, 0) AS claimed FROM (SELECT unnest(['F', 'O', 'P', 'unknown']) AS name)
LEFT JOIN (SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS c FROM orders GROUP BY 1) ON name = o_orderstatus""")
def job_monitor(spark, sf_dir):
    processors = spark.createDataFrame([("F",), ("O",), ("P",), ("unknown",)], "name string")
    return jobs.monitor(_jobs(spark, sf_dir), processors)


@plans.add("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 2 = 1) THEN 3600 WHEN o_orderkey % 2 = 0 THEN 3600 END AS interval_seconds FROM orders
UNION ALL SELECT -o_orderkey - 1, 3600 FROM orders WHERE o_orderkey % 5 = 0""")
def put_jobs(spark, sf_dir):
    existing = _jobs(spark, sf_dir)
    some = existing.where("id % 5 = 0").withColumn("interval_seconds", F.lit(3600)).withColumn("claimed_at", F.lit(None).cast("timestamp_ntz"))
    asked = some.withColumn("overwrite", F.col("id") % 10 == 0).unionByName(some.withColumn("id", -F.col("id") - 1).withColumn("overwrite", F.lit(False)))
    return jobs.put(existing, asked).select("id", "interval_seconds")


@plans.add(f"""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '{NOW}' + INTERVAL 1 HOUR ELSE o_orderdate END AS next_execution
FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""")
def finish_jobs(spark, sf_dir):
    rows = _jobs(spark, sf_dir)
    return jobs.finish(rows, rows.where("name = 'F'"), F.lit(NOW).cast("timestamp_ntz")).select("id", "next_execution")


@plans.add(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN greatest(CAST(600000000 - (epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) AS BIGINT), 0) END AS seconds_left FROM orders")
def claim_time_left(spark, sf_dir):
    return _jobs(spark, sf_dir).select("id", jobs.claim_time_left(F.lit(NOW).cast("timestamp_ntz"), 600_000_000).alias("seconds_left"))
