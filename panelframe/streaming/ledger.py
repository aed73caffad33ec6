"""The ledger's operators on live logs, with Structured Streaming. In batch form they are in operators.ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(log: DataFrame, ts: str, keys: list[str], late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per event-time window; rows later than `late` behind the newest are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return log.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def bursts(log: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of activity of each session, ended by a gap."""
    return log.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def once(log: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is sent within `late`."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def change_feed(log: DataFrame, key: str, order: str, watched: str, terminal: set[str]) -> DataFrame:
    """(key, order, watched): an event only where the watched value differs from the last one of its session; nothing after a terminal value.

    The state is one value per session. Rows of a micro-batch are taken in order; across batches the log must be in order.
    """
    kinds = dict(log.dtypes)

    def feed(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, over = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values(order)
        keep = []
        for value in rows[watched]:
            keep.append(not over and value != last)
            last, over = value, over or value in terminal
        state.update((last, over))
        yield rows[keep][[key, order, watched]]

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {watched} {kinds[watched]}"
    return log.groupBy(key).applyInPandasWithState(feed, out, f"last {kinds[watched]}, over boolean", "append", GroupStateTimeout.NoTimeout)


def stalls(log: DataFrame, key: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, last): a run once it has been silent for `seconds` of event time; it counts anew when it speaks again."""
    kinds = dict(log.dtypes)

    def watch(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(f[ts].max().timestamp() * 1000) for f in frames)
        newest = max(newest, state.get[0] if state.exists else 0)
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return log.withWatermark(ts, late).groupBy(key).applyInPandasWithState(watch, f"{key} {kinds[key]}, last timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_ledger(log: DataFrame, path: str):
    """A stream writer that keeps the newest entry of each (session, step) as a table at path.

    Each batch writes a new version beside the old one, whose number is the batch's: a batch that runs again overwrites its own.
    """
    from panelframe.operators.ledger import step_ledger

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("session", "step", "status", "seq")
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}").select("session", "step", "status", "seq"))
        step_ledger(rows).write.mode("overwrite").parquet(f"{path}/version={number}")

    return log.writeStream.foreachBatch(write)


MOST_EVENTS = 50


def story_memory(panels: DataFrame, series: str = "series", order: str = "idx") -> DataFrame:
    """(series, name, first_seen, last_seen, mentions, events): the roster of each series as it stands after each batch.

    panels: (series, idx, name, event). The state holds the roster and at most MOST_EVENTS events of a series.
    """
    kinds = dict(panels.dtypes)

    def remember(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, firsts, lasts, counts, events = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        at = {n: i for i, n in enumerate(names)}
        for name, idx, event in pd.concat(list(frames)).sort_values(order)[["name", order, "event"]].itertuples(index=False):
            if name not in at:
                at[name] = len(names)
                names.append(name)
                firsts.append(int(idx))
                lasts.append(int(idx))
                counts.append(0)
            i = at[name]
            firsts[i], lasts[i], counts[i] = min(firsts[i], int(idx)), max(lasts[i], int(idx)), counts[i] + 1
            if event:
                events.append(str(event))
        events = events[-MOST_EVENTS:]
        state.update((names, firsts, lasts, counts, events))
        yield pd.DataFrame({series: k[0], "name": names, "first_seen": firsts, "last_seen": lasts, "mentions": counts, "events": len(events)})

    out = f"{series} {kinds[series]}, name string, first_seen long, last_seen long, mentions long, events long"
    held = "names array<string>, firsts array<long>, lasts array<long>, counts array<long>, events array<string>"
    return panels.groupBy(series).applyInPandasWithState(remember, out, held, "update", GroupStateTimeout.NoTimeout)
