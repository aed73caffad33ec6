"""Ledger queries: events stand for step logs and job snapshots, users for sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelframe.operators import ledger as L
from panelframe.operators import memory as M
from panelframe.plans.registry import query, table


def events(spark, folder):
    """events with ts as a timestamp."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END"
_LOG = f"SELECT user_id AS session, (event_id % 12 + 1)::INTEGER AS step, {_STATUS} AS status, event_id AS seq FROM events"


def log(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 12 + 1).cast("int").alias("step"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("event_id").alias("seq"))


@query(f"SELECT session, step, arg_max(status, seq) AS status, max(seq) AS seq FROM ({_LOG}) GROUP BY session, step")
def h01_step_ledger(spark, folder):
    return L.step_ledger(log(spark, folder))


@query(f"""SELECT session, coalesce(ls, 0)::INTEGER AS last_successful, CASE WHEN status = 'failed' THEN step ELSE least(step + 1, 12) END::INTEGER AS current_step,
  CASE WHEN status = 'failed' THEN 'failed' WHEN step = 12 THEN 'done' ELSE 'paused' END AS status FROM (SELECT session, arg_max(step, seq) AS step, arg_max(status, seq) AS status, arg_max(step, seq) FILTER (status = 'success') AS ls FROM ({_LOG}) GROUP BY session)""")
def h01_session_state(spark, folder):
    return L.session_state(log(spark, folder))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR text IS NULL")
def h02_drift(spark, folder):
    d = table(spark, folder, "documents")
    hashes = lambda t: F.map_from_arrays(F.array(F.lit("text"), F.lit("lang")), F.array(F.sha2(t, 256), F.col("lang")))
    stored = d.select("doc_id", hashes(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hashes"))
    return L.drifted(stored, d.select("doc_id", hashes(F.col("text")).alias("hashes")), ["doc_id"])


@query(f"""WITH l AS (SELECT session, step, arg_max(status, seq) AS status FROM ({_LOG}) GROUP BY session, step), e AS (SELECT user_id AS session, min(CASE event_type WHEN 'purchase' THEN 9 WHEN 'signup' THEN 6 END) AS f FROM events GROUP BY user_id)
SELECT l.session, step, CASE WHEN status = 'success' AND step >= f THEN 'stale' ELSE status END AS status FROM l LEFT JOIN e USING (session)""")
def h03_invalidation_whole(spark, folder):
    return invalidation(spark, folder, table(spark, folder, "events"))


def invalidation(spark, folder, edits):
    changed = F.when(F.col("event_type") == "purchase", "voice.json").when(F.col("event_type") == "signup", "order")
    edits = edits.select(F.col("user_id").alias("session"), changed.alias("changed"))
    return L.invalidated(L.step_ledger(log(spark, folder)).drop("seq"), edits)


@query("""WITH r AS (SELECT (p_partkey % 12 + 1)::INTEGER AS step, p_partkey, p_size % 2 = 0 AS required FROM part), l AS (SELECT ps AS p_partkey, n AS bytes FROM (SELECT l_partkey AS ps, sum((l_quantity > 25)::INT)::BIGINT AS n FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey)),
  b AS (SELECT step, required, p_partkey || CASE WHEN bytes IS NULL THEN ' missing' WHEN bytes = 0 THEN ' empty' END AS told FROM r LEFT JOIN l USING (p_partkey))
SELECT step, coalesce(string_agg(told, ',' ORDER BY told) FILTER (required), '') AS problems, coalesce(string_agg(told, ',' ORDER BY told) FILTER (NOT required), '') AS soft FROM b GROUP BY step""")
def h04_completeness(spark, folder):
    rules = table(spark, folder, "part").select((F.col("p_partkey") % 12 + 1).cast("int").alias("step"), F.col("p_partkey").cast("string").alias("artifact"), (F.col("p_size") % 2 == 0).alias("required"))
    listing = table(spark, folder, "lineitem").where("l_partkey % 7 <> 0").groupBy(F.col("l_partkey").cast("string").alias("artifact")).agg(F.count_if(F.col("l_quantity") > 25).alias("bytes"))
    return L.completeness(rules, listing)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'computed' ELSE 'reused' END AS origin FROM documents")
def h05_incremental(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    cache = d.where("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")))
    reused, todo = L.incremental(d, cache, ["doc_id"])
    return reused.select("doc_id", F.lit("reused").alias("origin")).unionByName(todo.select("doc_id", F.lit("computed").alias("origin")))


@query("SELECT user_id, arg_max(event_id, (value, event_id)) AS event_id, arg_max(event_type, (value, event_id)) AS status FROM events GROUP BY user_id")
def h06_latest_snapshot(spark, folder):
    s = table(spark, folder, "events").select("user_id", "event_id", F.col("event_type").alias("status"), "value")
    return L.latest_snapshot(s, "user_id", ["value", "event_id"]).select("user_id", "event_id", "status")


@query("""WITH s AS (SELECT user_id AS job, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id)
SELECT job, CASE WHEN status = 'running' AND job % 2 = 1 THEN 'failed' ELSE status END AS status, status = 'running' AND job % 2 = 1 AS interrupted FROM s""")
def h07_interrupted(spark, folder):
    newest = table(spark, folder, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("t"))
    jobs = newest.select("job", F.when(F.col("t") == "purchase", "done").when(F.col("t") == "error", "failed").otherwise("running").alias("status"))
    return L.interrupted(jobs, jobs.where("job % 2 = 0").select("job"))


@query("""SELECT user_id, round(silent, 3) AS silent_seconds, silent > 86400 AS stalled FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1e6 AS silent FROM events GROUP BY user_id)""")
def h07_stalled(spark, folder):
    return L.stalled(events(spark, folder), "user_id", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp"), 86400)


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE over = 0 AND (was IS NULL OR was <> event_type)""")
def h08_change_feed(spark, folder):
    return L.change_feed(table(spark, folder, "events"), "user_id", "event_id", ["event_type"], F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) // 1000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def h09_hourly_counts(spark, folder):
    rows = events(spark, folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "total")


@query("""SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, s""")
def h10_bursts(spark, folder):
    rows = events(spark, folder).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


@query("SELECT user_id, event_type, (event_id // 4) AS grp, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type, grp")
def h11_idempotent(spark, folder):
    log = table(spark, folder, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 4).alias("grp"), "event_id", "value")
    return L.once(log, ["user_id", "event_type", "grp"], "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def a07_event_tail(spark, folder):
    return L.newest(table(spark, folder, "events").where("event_type = 'error'"), "user_id", "event_id", 5).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def f14_newest_kept(spark, folder):
    return L.newest(table(spark, folder, "events"), "user_id", "event_id", 50).select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f15_page(spark, folder):
    return L.page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 20)


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 2000")
def f13_capped_block(spark, folder):
    return L.capped(table(spark, folder, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn")


@query("""SELECT source, doc_id, left_out FROM (SELECT source, doc_id, greatest(count(*) OVER (PARTITION BY source) - 5, 0) AS left_out, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS u, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS d FROM documents) WHERE u <= 3 OR d <= 2""")
def f13_head_and_tail(spark, folder):
    return L.head_and_tail(table(spark, folder, "documents"), "source", "doc_id", 3, 2).select("source", "doc_id", "left_out")


def timeline(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("panel"), F.col("turn").alias("position"), (2.0 + F.length(F.coalesce("text", F.lit(""))) % 30 / 10.0).alias("seconds"))


@query("""WITH b AS (SELECT conv_id AS chapter, turn AS panel, turn AS position, 2.0 + length(coalesce(text, '')) % 30 / 10.0::DOUBLE AS seconds FROM conversations),
  c AS (SELECT conv_id AS chapter, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id), m AS (SELECT max(conv_id) + 1 AS many FROM conversations),
  g AS (SELECT event_id % many AS chapter, event_id // many AS nth, event_type, value, event_id AS seq FROM events, m WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error')),
  s AS (SELECT *, sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY chapter ORDER BY seq) AS total FROM g),
  h AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY chapter ORDER BY seq)) AS height FROM s),
  k AS (SELECT *, min(height) OVER (PARTITION BY chapter ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM h),
  e AS (SELECT chapter, nth % turns AS panel, CASE event_type WHEN 'view' THEN 'duration' WHEN 'click' THEN 'position' ELSE 'removed' END AS field, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.0::DOUBLE ELSE value / 10.0 END AS value, seq
    FROM k JOIN c USING (chapter) WHERE event_type <> 'error' AND coalesce(later >= height, true)),
  l AS (SELECT chapter, panel, field, arg_max(value, seq) AS value FROM e GROUP BY ALL),
  r AS (SELECT b.chapter, b.panel, coalesce(p.value, position::DOUBLE) AS position, coalesce(d.value, seconds) AS seconds FROM b LEFT JOIN l p ON p.chapter = b.chapter AND p.panel = b.panel AND p.field = 'position'
    LEFT JOIN l d ON d.chapter = b.chapter AND d.panel = b.panel AND d.field = 'duration' LEFT JOIN l x ON x.chapter = b.chapter AND x.panel = b.panel AND x.field = 'removed' WHERE coalesce(x.value, 0) = 0)
SELECT chapter, panel, row_number() OVER w AS "order", round(seconds, 6) AS seconds, round(coalesce(sum(seconds) OVER (PARTITION BY chapter ORDER BY position, panel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS start FROM r WINDOW w AS (PARTITION BY chapter ORDER BY position, panel)""")
def f11_edit_replay_whole(spark, folder):
    """Every event is an edit, put back for signup, or an undo for error, dealt to all panels of all conversations."""
    c = table(spark, folder, "conversations")
    turns = c.groupBy(F.col("conv_id").alias("chapter")).agg((F.max("turn") + 1).alias("turns"))
    many = F.broadcast(c.agg((F.max("conv_id") + 1).alias("many")))  # one row
    t = F.col("event_type")
    log = table(spark, folder, "events").where(t.isin("view", "click", "purchase", "signup", "error")).crossJoin(many)
    log = log.select((F.col("event_id") % F.col("many")).alias("chapter"), F.expr("event_id div many").alias("nth"), t, "value", F.col("event_id").alias("seq"))
    edits = L.in_force(log, "chapter", "seq", t == "error").join(turns, "chapter")
    field = F.when(t == "view", "duration").when(t == "click", "position").otherwise("removed")
    value = F.when(t == "purchase", 1.0).when(t == "signup", 0.0).otherwise(F.col("value") / 10.0)
    edits = edits.select("chapter", (F.col("nth") % F.col("turns")).alias("panel"), field.alias("field"), value.alias("value"), "seq")
    return L.replayed(timeline(spark, folder), edits).withColumn("seconds", F.round("seconds", 6))


@query("""SELECT user_id, stage, round(seconds, 3) AS seconds, round(seconds / sum(seconds) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_id AS stage, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS seconds FROM events) WHERE seconds IS NOT NULL""")
def g12_stage_durations(spark, folder):
    rows = L.stage_durations(events(spark, folder).select("user_id", F.col("event_id").alias("stage"), "ts"), "user_id", "ts")
    return rows.select("user_id", "stage", F.round("seconds", 3).alias("seconds"), F.round("share", 6).alias("share"))


@query("""SELECT c_custkey, coalesce(n, 0) AS jobs, last_order, coalesce(big, false) AS has_big FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, bool_or(o_totalprice > 300000) AS big FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def g13_session_library(spark, folder):
    jobs = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("jobs"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.bool_or(F.col("o_totalprice") > 300000).alias("has_big"))
    return table(spark, folder, "customer").select("c_custkey").join(jobs, "c_custkey", "left").fillna({"jobs": 0, "has_big": False})


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS cast_list FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY user_id")
def g14_first_seen(spark, folder):
    first = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_type"))), lambda p: p["event_type"])
    return first.groupBy("user_id").agg(F.array_join(names, ",").alias("cast_list"))


@query("""SELECT l_orderkey, min(l_partkey % 500) AS x, max(l_partkey % 500 + (l_quantity * 4)::BIGINT) AS right_edge, round(avg(l_quantity * 2), 4) AS confidence, count(*) AS words, string_agg(l_suppkey::VARCHAR, ' ' ORDER BY l_linenumber, l_suppkey, l_partkey) AS line FROM lineitem WHERE l_quantity * 2 > 30 GROUP BY l_orderkey""")
def g06_words_to_lines(spark, folder):
    q = F.col("l_quantity")
    words = table(spark, folder, "lineitem").where(q * 2 > 30).withColumn("x", F.col("l_partkey") % 500)
    text = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda w: w["l_suppkey"].cast("string"))
    return words.groupBy("l_orderkey").agg(F.min("x").alias("x"), F.max(F.col("x") + (q * 4).cast("long")).alias("right_edge"), F.round(F.avg(q * 2), 4).alias("confidence"), F.count(F.lit(1)).alias("words"), F.array_join(text, " ").alias("line"))


@query("""SELECT o_orderstatus, count(*) FILTER (d IS NOT NULL) AS measured, count(*) FILTER (d IS NULL) AS unsnapped, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, max(d) AS most FROM (SELECT o_orderstatus, unnest([CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 41 END, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 37 END])::DOUBLE AS d FROM orders) GROUP BY o_orderstatus""")
def g07_snap_stats(spark, folder):
    k = F.col("o_orderkey")
    sides = F.array(F.when(k % 3 != 0, (k % 41).cast("double")), F.when(k % 4 != 0, (F.col("o_custkey") % 37).cast("double")))
    rows = table(spark, folder, "orders").select("o_orderstatus", F.explode(sides).alias("d"))
    return rows.groupBy("o_orderstatus").agg(F.count("d").alias("measured"), F.count_if(F.col("d").isNull()).alias("unsnapped"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("median"), F.max("d").alias("most"))


@query("SELECT user_id, 'k' AS key, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total FROM events WHERE props::JSON->>'k' IS NOT NULL GROUP BY user_id")
def g08_usage_totals(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.withColumn("n", F.expr("try_cast(value as bigint)")).where("n is not null").groupBy("user_id", "key").agg(F.sum("n").alias("total"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id")
def g09_source_counts(spark, folder):
    p = table(spark, folder, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).count()
    return p.fillna(0)


@query("""SELECT n_regionkey AS series, n_name AS name, min(c_custkey) AS first_seen, max(c_custkey) AS last_seen, arg_min(c_mktsegment, c_custkey) AS description FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def g02_roster(spark, folder):
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy(F.col("n_regionkey").alias("series"), F.col("n_name").alias("name")).agg(F.min("c_custkey").alias("first_seen"), F.max("c_custkey").alias("last_seen"), F.min_by("c_mktsegment", "c_custkey").alias("description"))


@query("SELECT c_custkey, origin FROM (SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'known' ELSE 'seed' END AS origin FROM customer)")
def g03_seed_ingest(spark, folder):
    known = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    seeds = table(spark, folder, "customer").select("c_custkey")
    return known.join(seeds, "c_custkey", "left_semi").withColumn("origin", F.lit("known")).unionByName(seeds.join(known, "c_custkey", "left_anti").withColumn("origin", F.lit("seed")))


@query("""WITH e AS (SELECT conv_id AS series, turn AS chapter, CASE role WHEN 'system' THEN 'event' WHEN 'user' THEN 'character' ELSE 'thread' END AS kind, role || length(coalesce(text, '')) % 4 AS name FROM conversations),
  f AS (SELECT series, kind, name, min(chapter) AS since FROM e WHERE kind <> 'event' GROUP BY ALL)
SELECT c.series, c.chapter, kind, name, 0 AS first_seen, 0 AS last_seen FROM (SELECT DISTINCT series, chapter FROM e) c JOIN f ON f.series = c.series AND c.chapter > since""")
def g04_carry_forward(spark, folder):
    kind = F.when(F.col("role") == "system", "event").when(F.col("role") == "user", "character").otherwise("thread")
    name = F.concat("role", (F.length(F.coalesce("text", F.lit(""))) % 4).cast("string"))
    entries = table(spark, folder, "conversations").select(F.col("conv_id").alias("series"), F.col("turn").alias("chapter"), kind.alias("kind"), name.alias("name"))
    return M.carried_forward(entries, entries)


@query("SELECT event_id, coalesce(props::JSON->>'k', '0') AS k, 'calm' AS mood, '3' AS version FROM events")
def g05_deep_merge(spark, folder):
    base = F.create_map(F.lit("k"), F.lit("0"), F.lit("mood"), F.lit("calm"), F.lit("version"), F.lit("3"))
    own = F.from_json("props", "map<string,string>")
    merged = F.map_zip_with(base, own, lambda k, b, o: F.coalesce(o, b))
    return table(spark, folder, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["mood"].alias("mood"), F.col("m")["version"].alias("version"))
