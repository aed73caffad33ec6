"""Story memory: the cast, places, threads and events that panels bring in, folded in the order of each series.

Threads make the fold depend on its order: a hint closes the first active thread that it names, and a new thread that
names an active one is no thread.  So a series is folded row by row, here and in streaming.story by the same class;
what is held is the memory itself, never the rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.functions.text import STOP_WORDS

# Lengths of what is kept, newest events kept, and the share of a hint's words that names a thread.
LONGEST, LONGEST_THREAD, MOST_EVENTS, THREAD_SHARE = 200, 300, 50, 0.6

UPDATE = "seen array<string>, cast array<struct<name:string,role:string,description:string,aliases:array<string>>>, places_seen array<string>, places array<struct<name:string,description:string>>, resolved array<string>, opened array<string>, events array<string>"
FIELDS = ["seen", "cast", "places_seen", "places", "resolved", "opened", "events"]
ENTRY = ["kind", "pos", "name", "role", "description", "aliases", "status", "first_seen", "last_seen"]
ENTRY_TYPES = "kind string, pos long, name string, role string, description string, aliases array<string>, status string, first_seen long, last_seen long"
_ARROW = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]
_WORD, _STOP = re.compile("[a-z0-9']+"), frozenset(STOP_WORDS)


def one_line(text: str | None, most: int = LONGEST) -> str:
    return (text or "").strip().replace("\n", " ")[:most]


@functools.lru_cache(4096)
def content_words(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(text.lower())) - _STOP


class Roster:
    """Named entries in the order of their coming; a name or alias, in any case, finds the first entry that has it."""

    def __init__(self, entries: list[dict]):
        self.entries, self.index, self.changed = [], {}, set()
        for e in entries:
            self._enter(e)

    def _call(self, name: str, pos: int) -> None:
        key = name.strip().lower()
        self.index[key] = min(pos, self.index.get(key, pos))

    def _enter(self, entry: dict) -> None:
        for name in (entry["name"], *entry["aliases"]):
            self._call(name, len(self.entries))
        self.entries.append(entry)

    def find(self, name: str | None) -> int | None:
        key = (name or "").strip().lower()
        return self.index.get(key) if key else None

    def see(self, names: list | None, panel: int) -> None:
        for name in names if names is not None else []:
            pos = self.find(name)
            if pos is not None:
                self.entries[pos]["last_seen"] = panel
                self.changed.add(pos)

    def meet(self, name: str | None, role: str | None, description: str | None, aliases: list | None, panel: int, describe: bool = True) -> None:
        """A new entry, or one seen again, which gets what it lacks: a description, if `describe`, and aliases."""
        name = one_line(name)
        if not name:
            return
        pos, given = self.find(name), [a for a in (aliases if aliases is not None else []) if a]
        if pos is None:
            pos = len(self.entries)
            self._enter({"name": name, "role": one_line(role), "description": one_line(description), "aliases": [one_line(a) for a in given], "first_seen": panel, "last_seen": panel})
        else:
            entry = self.entries[pos]
            entry["last_seen"] = panel
            if describe:
                entry["description"] = entry["description"] or one_line(description)
            for alias in map(one_line, given):
                if alias and alias not in entry["aliases"]:
                    entry["aliases"].append(alias)
                    self._call(alias, pos)
        self.changed.add(pos)


class Threads:
    """Threads in the order of their opening, with lists of the active ones by word."""

    def __init__(self, threads: list[dict]):
        self.threads, self.words, self.changed = threads, {}, set()
        for pos, t in enumerate(threads):
            if t["status"] == "active":
                self._list(pos)

    def _list(self, pos: int) -> None:
        for w in content_words(self.threads[pos]["description"]):
            self.words.setdefault(w, set()).add(pos)

    def find(self, hint: str) -> int | None:
        """The first active thread that has enough of the hint's words; a hint of one word names none."""
        words = content_words(hint)
        if len(words) < 2:
            return None
        # Whatever has enough has one of all but that many words: the rarest are looked at.
        enough = math.ceil(THREAD_SHARE * len(words) - 1e-9)
        rare = sorted((self.words.get(w, ()) for w in words), key=len)[: len(words) - enough + 1]
        for pos in sorted(set().union(*rare)):
            if sum(pos in self.words.get(w, ()) for w in words) / len(words) >= THREAD_SHARE:
                return pos
        return None

    def resolve(self, hint: str, panel: int) -> None:
        pos = self.find(hint)
        if pos is not None:
            self.threads[pos].update(status="resolved", last_seen=panel)
            for w in content_words(self.threads[pos]["description"]):
                self.words[w].discard(pos)
            self.changed.add(pos)

    def open(self, summary: str, panel: int) -> None:
        summary = one_line(summary, LONGEST_THREAD)
        if summary and self.find(summary) is None:
            self.threads.append({"description": summary, "status": "active", "first_seen": panel, "last_seen": None})
            self._list(len(self.threads) - 1)
            self.changed.add(len(self.threads) - 1)


class Story:
    """The memory of one series."""

    def __init__(self, cast=(), places=(), threads=(), events=()):
        self.cast, self.places, self.threads, self.events = Roster(list(cast)), Roster(list(places)), Threads(list(threads)), list(events)

    def update(self, panel: int, seen, cast, places_seen, places, resolved, opened, events) -> None:
        some = lambda x: x if x is not None else ()
        self.cast.see(seen, panel)
        for c in some(cast):
            self.cast.meet(c["name"], one_line(c["role"]) or "unknown", c["description"], c["aliases"], panel)
        self.places.see(places_seen, panel)
        for p in some(places):
            self.places.meet(p["name"], None, p["description"], None, panel, describe=False)
        for hint in some(resolved):
            if hint is not None:
                self.threads.resolve(hint, panel)
        for summary in some(opened):
            self.threads.open(summary, panel)
        self.events += [{"description": line, "first_seen": panel} for e in some(events) if (line := one_line(e))]
        self.events = self.events[-MOST_EVENTS:]

    def rows(self) -> list[tuple]:
        """The whole memory, as ENTRY tuples."""
        out = [("character", k + 1, e["name"], e["role"], e["description"], e["aliases"], None, e["first_seen"], e["last_seen"]) for k, e in enumerate(self.cast.entries)]
        out += [("place", k + 1, e["name"], None, e["description"], None, None, e["first_seen"], e["last_seen"]) for k, e in enumerate(self.places.entries)]
        out += [("thread", k + 1, f"t{k + 1}", None, t["description"], None, t["status"], t["first_seen"], t["last_seen"]) for k, t in enumerate(self.threads.threads)]
        return out + [("event", k + 1, None, None, e["description"], None, None, e["first_seen"], None) for k, e in enumerate(self.events)]


def frame(series_name: str, series: list, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=ENTRY).astype({"pos": "Int64", "first_seen": "Int64", "last_seen": "Int64"})
    out.insert(0, series_name, series)
    return out


def story(updates: DataFrame, series: str = "series", order: str = "idx") -> DataFrame:
    """(series, kind, pos, name, role, description, aliases, status, first_seen, last_seen): what each series remembers in the end.

    updates(series, idx, and the fields of UPDATE, any of which may be null or missing) go in the order of idx, ties by
    their contents; a thread is last seen where it was resolved, an event has no name.  Rows without a series or a
    number take no part.  A task folds its series one after another from sorted rows and holds the memory of one:
    a series of most rows is one long fold, as every row rests on those before, but never in memory at once.
    """
    kind = dict(updates.dtypes)[series]
    # Only the fields that are given go to Python, in Arrow's batches: series are short and many.
    given = [c for c in FIELDS if c in updates.columns] or FIELDS[:1]
    types = dict(zip(FIELDS, (f.split(" ", 1)[1] for f in UPDATE.split(", ") if " array" in f)))
    fields = [(F.col(c) if c in updates.columns else F.lit(None)).cast(types[c]).alias(c) for c in given]
    rows = updates.where(F.col(series).isNotNull() & F.col(order).isNotNull()).select(F.col(series).alias("_series"), F.col(order).cast("long").alias("_order"), *fields)
    told = F.coalesce(*[F.when(F.size(c) > 0, True) for c in given], F.lit(False))
    rows = rows.where(told)
    sorted_ = rows.repartition("_series").sortWithinPartitions("_series", "_order", F.to_json(F.struct(*given)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, memory, of = None, None, None
        names, done = [], []

        def end():
            made = memory.rows()
            names.extend([name] * len(made))
            done.extend(made)

        def out():
            columns = list(zip(*done)) or [()] * len(ENTRY)
            return pa.RecordBatch.from_arrays([pa.array(names, of), *map(pa.array, columns, _ARROW)], [series, *ENTRY])

        for batch in batches:
            of = batch.schema.field(0).type
            held = {c: batch.column(k + 2).to_pylist() for k, c in enumerate(given)}
            for s, idx, *told_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(held.get(c) or [None] * batch.num_rows for c in FIELDS)):
                if memory is None or s != name:
                    if memory is not None:
                        end()
                    name, memory = s, Story()
                memory.update(idx, *told_)
            if done:
                yield out()
                names.clear()
                done.clear()
        if memory is not None:
            end()
            yield out()

    return sorted_.select("_series", "_order", *given).mapInArrow(fold, f"{series} {kind}, {ENTRY_TYPES}")
