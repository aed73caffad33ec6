"""Live story memory: operators.story on a stream, with the memory of each series in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelframe.operators import story as S

_ENTITY = "name string, role string, description string, aliases array<string>, first_seen bigint, last_seen bigint"
_THREAD = "description string, status string, first_seen bigint, last_seen bigint"
_EVENT = "description string, first_seen bigint"
_NAMES = {k: [f.split(" ")[0] for f in v.split(", ")] for k, v in {"cast": _ENTITY, "places": _ENTITY, "threads": _THREAD, "events": _EVENT}.items()}


class _Memory(StatefulProcessor):
    """Entries by their place in four maps; a batch writes back only those that it changed."""

    def __init__(self, series: str, idle_ms: int | None):
        self.series, self.idle_ms = series, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {k: handle.getMapState(k, "pos bigint", t) for k, t in (("cast", _ENTITY), ("places", _ENTITY), ("threads", _THREAD), ("events", _EVENT))}

    def _load(self) -> S.Story:
        held = {}
        for k, m in self.maps.items():
            rows = sorted((key[0], value) for key, value in m.iterator()) if m.exists() else []
            held[k] = [dict(zip(_NAMES[k], value)) for _, value in rows]
            for e in held[k]:
                if "aliases" in e:
                    e["aliases"] = list(e["aliases"] if e["aliases"] is not None else [])
        return S.Story(**held)

    def _save(self, kind: str, entries: list[dict], places: list[int]) -> None:
        for pos in places:
            self.maps[kind].updateValue((pos,), tuple(entries[pos][n] for n in _NAMES[kind]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory = self._load()
        pdf = pd.concat(list(rows)).sort_values(["n", "tie"])
        for idx, *fields in pdf[["n", *S.FIELDS]].itertuples(index=False):
            memory.update(int(idx), *fields)
        for kind, held in (("cast", memory.cast.entries), ("places", memory.places.entries), ("threads", memory.threads.threads)):
            changed = getattr(memory, kind).changed
            self._save(kind, held, sorted(changed))
        # At most MOST_EVENTS: all of them anew.
        self.maps["events"].clear()
        self._save("events", memory.events, list(range(len(memory.events))))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            newest = int(pdf["at"].max().timestamp() * 1000)
            self.handle.registerTimer(max(newest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._out(key, memory, False)

    def _out(self, key, memory: S.Story, closed: bool) -> pd.DataFrame:
        made = memory.rows()
        out = S.frame(self.series, [key[0]] * len(made), made)
        out["closed"] = closed
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The chapter is over: its memory goes out once more, then cast, places and threads begin the next one unseen."""
        memory = self._load()
        yield self._out(key, memory, True)
        for kind, held in (("cast", memory.cast.entries), ("places", memory.places.entries)):
            for e in held:
                e["first_seen"] = e["last_seen"] = 0
            self._save(kind, held, list(range(len(held))))
        self.maps["events"].clear()

    def close(self) -> None:
        pass


def story(updates: DataFrame, series: str = "series", order: str = "idx", ts: str = "ts", idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """operators.story's rows of every series that a batch touches, whole and as they stand, with closed = false.

    updates as there, and a timestamp; rows of a batch go in order, across batches the stream has to be.  With idle
    (say '2 hours' of event time), a series silent for so long ends its chapter: its rows come with closed = true, its
    events go, and its entries' panel numbers, which are a chapter's own, start at 0.  The session needs the RocksDB
    state store.
    """
    given, kind = set(updates.columns), dict(updates.dtypes)[series]
    types = dict(zip(S.FIELDS, (f.split(" ", 1)[1] for f in S.UPDATE.split(", ") if " array" in f)))
    fields = [(F.col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in S.FIELDS]
    rows = updates.where(F.col(series).isNotNull() & F.col(order).isNotNull()).withWatermark(ts, late)
    # The worker changes names that begin with an underscore.
    rows = rows.select(F.col(series).alias("k"), F.col(order).cast("long").alias("n"), F.col(ts).alias("at"), *fields).withColumn("tie", F.to_json(F.struct(*S.FIELDS)))
    idle_ms = None if idle is None else int(updates.sparkSession.sql(f"SELECT CAST(unix_micros(timestamp_micros(0) + INTERVAL {idle}) / 1000 AS BIGINT)").first()[0])
    processor = _Memory(series, idle_ms)
    out = f"{series} {kind}, {S.ENTRY_TYPES}, closed boolean"
    return rows.groupBy("k").transformWithStateInPandas(processor, out, "Update", "None" if idle_ms is None else "EventTime")
