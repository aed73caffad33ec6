"""Step ledgers, job snapshots, logs: latest rows, drift, invalidation, feeds, and incremental recompute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.operators.ranks import top

LAST_STEP = 12
# The first step that a changed artifact invalidates.
INVALIDATES = {"panels.json": 4, "panels_edit.json": 5, "panels_validation.json": 5, "panels_confirmed.json": 7, "narration_edit.json": 8, "voice.json": 9, "order": 6}


def step_ledger(log: DataFrame) -> DataFrame:
    """The newest entry of each (session, step) of log(session, step, status, seq)."""
    return log.groupBy("session", "step").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def session_state(log: DataFrame) -> DataFrame:
    """(session, last_successful, current_step, status) after the whole log: a success moves on, a failure is to be tried again."""
    newest = log.groupBy("session").agg(F.max_by(F.struct("step", "status"), "seq").alias("e"), F.max_by("step", F.when(F.col("status") == "success", F.col("seq"))).alias("last_successful"))
    step, status = F.col("e.step"), F.col("e.status")
    done = F.when(status == "failed", "failed").when((status == "success") & (step == LAST_STEP), "done").otherwise("paused")
    return newest.select("session", F.coalesce("last_successful", F.lit(0)).cast("int").alias("last_successful"), F.when(status == "failed", step).otherwise(F.least(step + 1, F.lit(LAST_STEP))).cast("int").alias("current_step"), done.alias("status"))


def drifted(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose stored input hashes are not the current ones; hashes are maps, compared by their entries."""
    entries = lambda c: F.array_sort(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))))
    rows = stored.select(*keys, F.col("hashes").alias("_a")).join(current.select(*keys, F.col("hashes").alias("_b")), keys, "left")
    return rows.where(entries("_a") != entries("_b")).select(*keys)


def invalidated(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """ledger(session, step, status) with the steps from each session's first invalidated one on marked stale. edits: (session, changed)."""
    first = F.lit(None).cast("int")
    for name, step in INVALIDATES.items():
        first = F.when(F.col("changed") == name, step).otherwise(first)
    starts = edits.select("session", first.alias("_first")).groupBy("session").agg(F.min("_first").alias("_first"))
    stale = (F.col("status") == "success") & (F.col("step") >= F.col("_first"))
    return ledger.join(starts, "session", "left").withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).drop("_first")


def completeness(rules: DataFrame, listing: DataFrame, session: str | None = None) -> DataFrame:
    """(step, problems, soft) from rules(step, artifact, required) and listing(artifact, bytes): missing or empty artifacts.

    With `session`, both have it, and so does the result: the rules are those of each session.
    """
    keys = [session] if session else []
    rows = rules.join(listing, [*keys, "artifact"], "left").withColumn("bad", F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") == 0, "empty"))
    told = F.concat("artifact", F.lit(" "), "bad")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c & F.col("bad").isNotNull(), told))), ",")
    return rows.groupBy(*keys, "step").agg(names(F.col("required")).alias("problems"), names(~F.col("required")).alias("soft"))


def incremental(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that are still valid, wanted rows to compute): valid means equal key and input hash."""
    return cache.join(wanted.select(*keys, "hash"), [*keys, "hash"], "left_semi"), wanted.join(cache.select(*keys, "hash").distinct(), [*keys, "hash"], "left_anti")


def latest_snapshot(snapshots: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest snapshot of each session; ties go by the order's later columns."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(key, "_s.*")


def interrupted(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """snapshots(job, status) with runs that neither ended nor have a live process marked failed."""
    ended = F.col("status").isin("done", "failed", "cancelled")
    rows = snapshots.join(live.select("job", F.lit(True).alias("_live")), "job", "left")
    gone = ~ended & F.col("_live").isNull()
    return rows.withColumn("interrupted", gone).withColumn("status", F.when(gone, "failed").otherwise(F.col("status"))).drop("_live")


def stalled(log: DataFrame, key: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """(key, silent_seconds, stalled): how long each run has been silent."""
    silent = (F.unix_micros(now) - F.unix_micros(F.max(ts))) / 1e6
    return log.groupBy(key).agg(F.round(silent, 3).alias("silent_seconds"), (silent > seconds).alias("stalled"))


def change_feed(log: DataFrame, key: str, order: str, watched: list[str], terminal: Column | None = None) -> DataFrame:
    """Rows in which a watched column differs from the row before, up to the first terminal one."""
    w = Window.partitionBy(key).orderBy(order)
    state = F.struct(*watched)
    rows = log.withColumn("_was", F.lag(state).over(w))
    if terminal is not None:
        rows = rows.withColumn("_over", F.coalesce(F.max(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_over = 0").drop("_over")
    return rows.where(F.col("_was").isNull() | ~F.col("_was").eqNullSafe(state)).drop("_was")


def once(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each event once, however often it was sent: the first by order of those with equal keys. Combined before the shuffle."""
    return log.groupBy(*keys).agg(F.min_by(F.struct("*"), order).alias("_e")).select("_e.*")


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows with the total; the total is an aggregate of its own, so only the page is sorted to one place."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def capped(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Leading rows of each key whose running length, a line end each, stays within a budget: the first that would overflow stops it."""
    w = Window.partitionBy(key).orderBy(order)
    used = F.sum(F.length(text) + 1).over(w)
    rows = rows.withColumn("_used", used)
    return rows.where(F.col("_used") <= budget).drop("_used")


def head_and_tail(rows: DataFrame, key: str, order: str, head: int, tail: int) -> DataFrame:
    """The first and last rows of each key, with how many are left out between."""
    ends = top(rows, [key], [F.col(order)], head).withColumn("_end", F.lit(0)).unionByName(top(rows, [key], [F.desc(order)], tail).withColumn("_end", F.lit(1)))
    # A row at both ends is there once; rows of a key are told apart by their order.
    once = top(ends, [key, order], [F.col("_end")], 1).drop("_end")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return once.join(counts, key).withColumn("left_out", F.greatest(F.col("_n") - (head + tail), F.lit(0))).drop("_n")


def in_force(log: DataFrame, key: str, seq: str, undo: Column) -> DataFrame:
    """The edits of a log that no undo took back: an undo row takes the newest edit of its key still in force, if there is one."""
    w, back = Window.partitionBy(key).orderBy(seq), Window.partitionBy(key).orderBy(F.desc(seq))
    total = F.sum(F.when(F.col("_undo"), -1).otherwise(1)).over(w)
    rows = log.withColumn("_undo", F.coalesce(undo, F.lit(False))).withColumn("_total", total)
    rows = rows.withColumn("_height", F.col("_total") - F.least(F.lit(0), F.min("_total").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    # An edit is taken back once the height falls below its own.
    rows = rows.withColumn("_later", F.min("_height").over(back.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where("not _undo and coalesce(_later >= _height, true)").drop("_undo", "_total", "_height", "_later")


def replayed(baseline: DataFrame, edits: DataFrame, cursor: int | None = None) -> DataFrame:
    """Timeline rows after the edits with seq up to the cursor (all without one): durations, removals and orders, with starts summed anew.

    baseline(chapter, panel, position, seconds); edits(chapter, panel, field, value, seq), the newest of each field counts.
    """
    last = (edits if cursor is None else edits.where(F.col("seq") <= cursor)).groupBy("chapter", "panel", "field").agg(F.max_by("value", "seq").alias("value"))
    fields = last.groupBy("chapter", "panel").pivot("field", ["duration", "position", "removed"]).agg(F.first("value"))
    rows = baseline.join(fields, ["chapter", "panel"], "left").where(F.coalesce(F.col("removed"), F.lit(0.0)) == 0)
    rows = rows.select("chapter", "panel", F.coalesce(fields["position"], baseline["position"].cast("double")).alias("position"), F.coalesce("duration", "seconds").alias("seconds"))
    w = Window.partitionBy("chapter").orderBy("position", "panel")
    return rows.select("chapter", "panel", F.row_number().over(w).cast("long").alias("order"), "seconds", F.round(F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 3).alias("start"))


def stage_durations(times: DataFrame, key: str, at: str) -> DataFrame:
    """times(key, stage, at) with the seconds to the next stage, and their share of the key's total."""
    w = Window.partitionBy(key).orderBy(at, "stage")
    seconds = (F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)) / 1e6
    rows = times.withColumn("seconds", seconds).where("seconds is not null")
    return rows.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy(key)))
