"""The edits of a chapter's timeline replayed: places, durations, captions, effects and transitions, with undo and redo."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelframe.functions import text as X
from panelframe.operators.timeline import caption_cues

# Steps that can be undone, the shortest time a panel is shown, and what joins two panels unless said.
MOST_STEPS, SHORTEST, JOIN = 200, 0.1, ("cut", 0.5)
PART = ["chapter", "kind", "place", "id", "other", "text", "start", "seconds"]


class Chapter:
    """One chapter under edit.  A panel's entry is [panel, seconds, automated seconds, automated start]; every edit leaves a
    pair of actions, one that takes it back and one that does it again, so that no step keeps a copy of the timeline.
    Steps keep entries themselves, not copies: what later edits do to an entry, their own steps take back, wherever it is."""

    def __init__(self, name):
        self.name = name
        self.original, self.timeline, self.length = [], [], 0.0
        self.captions, self.effects, self.joins = {}, {}, None
        # The newest MOST_STEPS pairs; `done` of them are in force.
        self.steps, self.done = deque(), 0

    # What a chapter begins with

    def panel(self, panel: str, seconds: float) -> None:
        self.original.append([panel, seconds, seconds, round(self.length, 3)])
        self.timeline.append(list(self.original[-1]))
        self.length += seconds

    def caption(self, caption: str, panel: str, text: str, start: float, end: float) -> None:
        self.captions[caption] = {"panel": panel, "text": text, "start": start, "end": end, "own": (start, end)}

    # Parts of an edit

    def _starts(self) -> list[float]:
        out, at = [], 0.0
        for e in self.timeline:
            out.append(round(at, 3))
            at += e[1]
        return out

    def _join(self) -> None:
        """Transitions of neighbours alone: those that are known, else the plain one."""
        ids, known = [e[0] for e in self.timeline], self.joins or {}
        self.joins = {pair: known.get(pair, JOIN) for pair in zip(ids, ids[1:])}

    def _find(self, panel: str) -> int | None:
        return next((k for k, e in enumerate(self.timeline) if e[0] == panel), None)

    def _time_captions(self, k: int, starts: list[float]) -> None:
        """Captions of the k-th panel, stretched as its time is against the automated one."""
        panel, seconds, own_seconds, own_start = self.timeline[k]
        start, end = starts[k], starts[k] + seconds
        scale = (end - start) / max(own_seconds, 0.01)
        own_end = own_start + own_seconds
        if scale != 1.0:  # an automated place of 0 counts as none
            own_start, own_end = own_start or start, own_end or end
        for c in self.captions.values():
            if c["panel"] == panel:
                c["start"], c["end"] = round(start + (c["own"][0] - own_start) * scale, 3), round(end + (c["own"][1] - own_end) * scale, 3)

    def _set_order(self, entries: list) -> None:
        self.timeline = list(entries)
        self._join()

    def _insert(self, at: list[tuple[int, list]]) -> None:
        for k, e in at:
            self.timeline.insert(k, e)
        self._join()

    def _take(self, places: list[int]) -> None:
        for k in reversed(places):
            del self.timeline[k]
        self._join()

    def _last(self, panel: str, seconds: float) -> None:
        k = self._find(panel)
        if k is not None:
            self.timeline[k][1] = seconds
            starts = self._starts()
            self._time_captions(k, starts)
            for j in range(len(self.timeline)):
                if starts[j] >= starts[k] + seconds:
                    self._time_captions(self._find(self.timeline[j][0]), starts)

    def _caption(self, caption: str, values: dict) -> None:
        if caption in self.captions:
            self.captions[caption].update(values)

    def _effect(self, panel: str, value: tuple) -> None:
        if panel in self.effects:
            self.effects[panel] = value

    def _transition(self, pair: tuple, value: tuple) -> None:
        if pair in self.joins:
            self.joins[pair] = value

    def _record(self, back: tuple, again: tuple) -> None:
        while len(self.steps) > self.done:
            self.steps.pop()
        self.steps.append((back, again))
        if len(self.steps) > MOST_STEPS:
            self.steps.popleft()
        self.done = len(self.steps)

    # The edits

    def apply(self, op: str, panel: str | None, other: str | None, text: str | None, number: float | None, order: list | None) -> None:
        if self.joins is None:
            self._join()
        if op == "undo" and self.done:
            self.done -= 1
            act, *what = self.steps[self.done][0]
            act(*what)
        elif op == "redo" and self.done < len(self.steps):
            act, *what = self.steps[self.done][1]
            self.done += 1
            act(*what)
        elif op == "reset":
            self.timeline = [list(e) for e in self.original]
            self._join()
            self.steps, self.done = deque(), 0
        elif op == "reorder":
            before, by_id = self.timeline, {e[0]: e for e in self.timeline}
            self._set_order([by_id[p] for p in order or [] if p in by_id])
            self._record((self._set_order, before), (self._set_order, self.timeline[:]))
        elif op == "duration":
            k = self._find(panel)
            if k is not None and number is not None:
                before, after = self.timeline[k][1], round(max(number, SHORTEST), 3)
                self.timeline[k][1] = after
                self._time_captions(k, self._starts())
                self._record((self._last, panel, before), (self._last, panel, after))
        elif op == "remove":
            places = [k for k, e in enumerate(self.timeline) if e[0] == panel]
            gone = [(k, self.timeline[k]) for k in places]
            self._take(places)
            self.captions = {i: c for i, c in self.captions.items() if c["panel"] != panel}
            self.effects.pop(panel, None)
            self._record((self._insert, gone), (self._take, places))
        elif op == "add":
            entry = next((e for e in self.original if e[0] == panel), None)
            if entry is not None:
                # After a panel that is not there, at the front; after none, at the end.
                k = len(self.timeline) if not other else -1 if (k := self._find(other)) is None else k
                k = k if not other else k + 1
                entry = list(entry)
                self._insert([(k, entry)])
                self._record((self._take, [k]), (self._insert, [(k, entry)]))
        elif op == "effect" and panel is not None:
            before = self.effects.get(panel, ("static", 0.0))
            self.effects[panel] = text, round(number or 0.0, 3)
            self._record((self._effect, panel, before), (self._effect, panel, self.effects[panel]))
        elif op == "caption":
            c = self.captions.get(panel)
            if c is not None and text is not None:
                before, c["text"] = c["text"], text
                self._record((self._caption, panel, {"text": before}), (self._caption, panel, {"text": text}))
        elif op == "transition" and panel is not None and other is not None:
            before = self.joins.get((panel, other), JOIN)
            self.joins[panel, other] = text, round(number or 0.0, 3)
            self._record((self._transition, (panel, other), before), (self._transition, (panel, other), self.joins[panel, other]))

    def rows(self) -> list[tuple]:
        if self.joins is None:
            self._join()
        starts = self._starts()
        out = [(self.name, "panel", k + 1, e[0], None, None, starts[k], e[1]) for k, e in enumerate(self.timeline)]
        out += [(self.name, "caption", k + 1, i, c["panel"], c["text"], c["start"], round(c["end"] - c["start"], 3)) for k, (i, c) in enumerate(sorted(self.captions.items()))]
        out += [(self.name, "transition", k + 1, a, b, kind, None, s) for k, ((a, b), (kind, s)) in enumerate(self.joins.items())]
        return out + [(self.name, "effect", k + 1, p, None, kind, None, s) for k, (p, (kind, s)) in enumerate(sorted(self.effects.items()))]


def edited(panels: DataFrame, captions: DataFrame | None, edits: DataFrame) -> DataFrame:
    """(chapter, kind, place, id, other, text, start, seconds): each chapter's panels, captions, transitions and effects after its edits.

    panels(chapter, panel string, position, seconds), captions(chapter, id string, panel string, text, start, end),
    edits(chapter, seq, op, panel, other, text, number, order array<string>), by seq:

    * reorder: the panels of `order` that are there, and no other
    * duration: `number` seconds, SHORTEST at least; the panel's captions are stretched with it
    * remove, add: every place of the panel goes, with its captions and effect; the original panel comes after `other`,
      in front if that is not there, at the end without it, and may come more than once
    * caption, effect, transition: new text of caption `panel`; kind `text` and `number` seconds, of `panel`, or of the pair
      `panel`, `other`
    * undo, redo: the newest MOST_STEPS edits, in turn; a new edit ends what could be redone. A removal taken back brings
      the panel back but not its captions. reset: the original order, and nothing to undo

    Edits of panels that are not there change nothing and are no step, but for a removal, which is one.  Null seconds are 0, null texts empty; rows
    without a chapter, and panels or captions without an id, take no part; edits of one seq go by their contents.  Each
    chapter is folded from sorted rows, so a task holds one chapter's panels and steps, not its log.
    """
    kind = dict(panels.dtypes)["chapter"]
    null = lambda t: F.lit(None).cast(t)
    line = lambda df, rank, seq, op, panel, other, text, number, more, order: df.select("chapter", F.lit(rank).alias("_r"), seq.alias("_s"), op.alias("op"), panel.alias("panel"), other.alias("other"), text.alias("text"), number.cast("double").alias("number"), more.cast("double").alias("more"), order.alias("order"))
    c = F.col
    some = lambda name: F.coalesce(c(name), F.lit(""))
    rows = line(panels.where("chapter is not null and panel is not null"), 0, c("position").cast("double"), F.lit("panel"), c("panel"), null("string"), null("string"), F.coalesce(c("seconds"), F.lit(0.0)), null("double"), null("array<string>"))
    if captions is not None:
        rows = rows.unionByName(line(captions.where("chapter is not null and id is not null"), 1, F.lit(0.0), F.lit("begin"), c("id"), c("panel"), some("text"), F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.lit(0.0)), null("array<string>")))
    rows = rows.unionByName(line(edits.where("chapter is not null"), 2, c("seq").cast("double"), c("op"), c("panel"), c("other"), c("text"), c("number"), null("double"), c("order")))
    rows = rows.repartition("chapter").sortWithinPartitions("chapter", "_r", "_s", "op", "panel", "other", "text", "number", "order")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=PART)
        none = lambda x: None if x is None or x != x else x
        chapter, done = None, []
        for pdf in frames:
            for name, op, panel, other, text, number, more, order in pdf.itertuples(index=False):
                if chapter is None or name != chapter.name:
                    done += chapter.rows() if chapter else []
                    chapter = Chapter(name)
                if op == "panel":
                    chapter.panel(panel, number)
                elif op == "begin":
                    chapter.caption(panel, other, text, number, more)
                elif op is not None:
                    chapter.apply(op, panel, other, text, none(number), list(order) if order is not None else None)
            if done:
                yield made(done)
                done = []
        if chapter:
            yield made(chapter.rows())

    out = f"chapter {kind}, kind string, place long, id string, other string, text string, start double, seconds double"
    return rows.select("chapter", "op", "panel", "other", "text", "number", "more", "order").mapInPandas(fold, out)


def bootstrap(timeline: DataFrame, srt: DataFrame | None = None) -> DataFrame:
    """(chapter, kind, place, id, other, text, start, seconds, own_start, own_seconds): what the edits of each chapter begin with.

    timeline is build_timeline's, with words (see caption_cues). Panels that are shown come in order, with their automated
    times beside them; captions from the spoken words, but not those of a panel that says what the one before said; plain
    transitions between neighbours; each panel's pan as its effect.  Captions of a chapter without any audio are those of
    srt(chapter, number, start, end, caption), if there are.  A chapter without an image has no project.

    A null text says nothing; rows without a chapter take no part; an empty timeline gives no rows.
    """
    c = F.col
    null = lambda t: F.lit(None).cast(t)
    rows = timeline.where(c("chapter").isNotNull()).withColumn("_said", X.strip(X.text(c("text"))))
    chapters = rows.groupBy("chapter").agg(F.bool_or(X.text(c("image_file")) != "").alias("_shown"), F.bool_or(c("audio_seconds").isNotNull()).alias("_spoken"))
    order = Window.partitionBy("chapter").orderBy("order")
    used = rows.join(chapters.where("_shown"), "chapter").where(c("order").isNotNull())
    used = used.withColumn("_before", F.lag("_said").over(order)).withColumn("_next", F.lead("panel_id").over(order))
    part = lambda df, kind, place, key, other, text, start, seconds: df.select("chapter", F.lit(kind).alias("kind"), place.cast("long").alias("place"), key.alias("id"), other.alias("other"), text.alias("text"), start.cast("double").alias("start"), seconds.cast("double").alias("seconds"), (start if kind in ("panel", "caption") else null("double")).cast("double").alias("own_start"), (seconds if kind in ("panel", "caption") else null("double")).cast("double").alias("own_seconds"))
    panels = part(used, "panel", c("order"), c("panel_id"), null("string"), null("string"), c("start_seconds"), c("duration_seconds"))
    joins = part(used.where("_next is not null"), "transition", c("order"), c("panel_id"), c("_next"), F.lit(JOIN[0]), null("double"), F.lit(JOIN[1]))
    effects = part(used, "effect", c("order"), c("panel_id"), null("string"), F.coalesce("pan.kind", F.lit("static")), null("double"), c("duration_seconds"))
    spoken = used.where(c("_spoken") & ((c("_said") == "") | c("_before").isNull() | (c("_said") != c("_before"))))
    cues = caption_cues(spoken).join(used.select("chapter", "idx", "panel_id"), ["chapter", "idx"])
    found = cues.select("chapter", c("panel_id").alias("panel"), F.struct("idx", "cue").alias("at"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "caption")
    if srt is not None:
        silent = srt.join(chapters.where("_shown and not _spoken").select("chapter"), "chapter")
        kind = dict(found.dtypes)["at"]
        found = found.unionByName(silent.select("chapter", F.lit("").alias("panel"), F.struct(c("number").alias("idx"), F.lit(0).alias("cue")).cast(kind).alias("at"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "caption"))
    number = F.row_number().over(Window.partitionBy("chapter").orderBy("at"))
    found = found.withColumn("_n", number)
    captions = part(found, "caption", c("_n"), F.format_string("cap_%03d", "_n"), c("panel"), c("caption"), c("start"), F.round(c("end") - c("start"), 3))
    return panels.unionByName(captions).unionByName(joins).unionByName(effects)
