"""Narration, timeline, captions and sound cues of chapters of ordered panels.

Tables are keyed by chapter; idx orders the panels of a chapter.  Every window is within a chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.functions import geometry as G
from panelframe.functions import text as X

_BEFORE = (Window.unboundedPreceding, -1)


def _chapter():
    return Window.partitionBy("chapter").orderBy("idx")


def _before():
    return _chapter().rowsBetween(*_BEFORE)


def spoken_lines(panels: DataFrame) -> DataFrame:
    """panels with raw (the line of a scene panel), previous (last scene line before it) and repeated.

    A line equal to the last non-empty scene line is repeated; context-only rows compare but never count.
    """
    raw = X.fit_speech(X.script_text(F.col("narration"), F.col("dialogue")))
    lines = panels.withColumn("raw", F.when(~F.col("context_only"), raw))
    previous = F.last(F.when(F.col("raw") != "", F.col("raw")), ignorenulls=True).over(_before())
    lines = lines.withColumn("previous", F.coalesce(previous, F.lit("")))
    return lines.withColumn("repeated", ~F.col("context_only") & (F.col("raw") != "") & (F.col("raw") == F.col("previous")))


def build_narration(panels: DataFrame) -> DataFrame:
    """(chapter, idx, panel_id, text): one row for each scene panel that gets an entry.

    Foreign characters go last, promotion is left unspoken, and a context-only row's words are carried
    to the scene row before it (those that open a chapter to its first).
    """
    lines = spoken_lines(panels.where("not blank")).where("not repeated")
    ascii_only = lambda c: ~c.rlike(r"[^\x00-\x7f]")
    latin = lambda c: F.when(ascii_only(c), c).otherwise(X.normalise(X.strip_non_latin(c)))
    own = F.coalesce(F.nullif(X.strip(X.text(F.col("dialogue"))), F.lit("")), X.strip(X.text(F.col("narration"))))
    bubble = latin(X.normalise(F.regexp_replace(own, f"{X.SPACE}*/{X.SPACE}*", " ")))
    kept = F.when(F.col("context_only"), bubble).otherwise(latin(F.col("raw")))
    silent = X.is_non_lexical(F.col("said")) | X.is_promo(F.col("said"))
    carried = F.col("context_only") & ((F.col("said") == F.col("previous")) | X.is_promo(F.col("dialogue")) | X.is_promo(F.col("narration")))
    lines = lines.withColumn("said", kept).withColumn("said", F.when(silent | carried, "").otherwise(F.col("said")))
    entry = F.sum(F.when(F.col("context_only"), 0).otherwise(1)).over(_chapter().rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("entry", F.greatest(entry, F.lit(1)))
    parts = F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("idx", "said"))))
    scene = lambda c: F.max(F.when(~F.col("context_only"), F.col(c)))
    joined = lines.groupBy("chapter", "entry").agg(scene("idx").alias("idx"), scene("panel_id").alias("panel_id"), F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"))
    return joined.where("idx is not null").drop("entry")


def build_timeline(panels: DataFrame, narration: DataFrame, audio: DataFrame, contain: bool = True) -> DataFrame:
    """One row per panel: note (why it is skipped, or that it is a silent beat), order, start and duration seconds, pan.

    Starts are contiguous: each is the sum of the durations before it in its chapter.
    """
    rows = panels.join(narration.select("chapter", "panel_id", "text"), ["chapter", "panel_id"], "left").join(audio.select("chapter", "panel_id", "audio_seconds"), ["chapter", "panel_id"], "left")
    note = (
        F.when(F.col("height") <= 0, "zero_height")
        .when(F.col("blank"), "blank")
        .when(F.col("context_only"), "context_only")
        .when(X.text(F.col("image_file")) == "", "image_missing")
        .when((X.strip(X.text(F.col("text"))) == "") & F.col("audio_seconds").isNull(), "silent_beat")
    )
    rows = rows.withColumn("note", note).withColumn("used", F.coalesce(F.col("note") == "silent_beat", F.lit(True)))
    pan = G.compute_pan(F.col("width"), F.col("height"), contain=contain)
    rows = rows.withColumn("pan", F.when(F.col("used"), pan)).withColumn("class", X.panel_class(F.col("text"), F.lit("")))
    seconds = G.display_seconds(F.col("audio_seconds"), X.word_count(F.col("text")), F.col("pan.travel_px"), F.col("class"))
    rows = rows.withColumn("duration_seconds", F.when(F.col("used"), seconds))
    start = F.coalesce(F.sum("duration_seconds").over(_before()), F.lit(0.0))
    order = F.sum(F.col("used").cast("long")).over(_chapter())
    return rows.withColumn("start_seconds", F.when(F.col("used"), F.round(start, 3))).withColumn("order", F.when(F.col("used"), order)).drop("used")


def adjacent_distinct(rows: DataFrame, value: str) -> DataFrame:
    """rows whose value is not empty and differs from the last non-empty one before it."""
    v = X.strip(X.text(F.col(value)))
    last = F.last(F.nullif(v, F.lit("")), ignorenulls=True).over(_before())
    return rows.withColumn("_last", last).where((v != "") & (F.col("_last").isNull() | (v != F.col("_last")))).drop("_last")


def caption_cues(timeline: DataFrame, most_words: int = 9) -> DataFrame:
    """(chapter, idx, cue, start, end, caption): each line in chunks of words that have times, clamped to the panel's end.

    timeline needs words: array<struct<start, end, text>>. A line with fewer than two timed words is one cue.
    """
    rows = timeline.where((X.strip(X.text(F.col("text"))) != "") & F.col("start_seconds").isNotNull())
    end = F.col("start_seconds") + F.col("duration_seconds")
    n = F.coalesce(F.size("words"), F.lit(0))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / most_words).cast("int")),
        lambda k: F.slice(F.col("words"), k * most_words + 1, F.lit(most_words)),
    )
    timed = F.transform(
        chunks,
        lambda c: F.struct(
            (F.col("start_seconds") + F.element_at(c, 1)["start"]).alias("start"),
            (F.col("start_seconds") + F.element_at(c, -1)["end"] + 0.15).alias("end"),
            F.array_join(F.transform(c, lambda w: w["text"]), " ").alias("caption"),
        ),
    )
    whole = F.array(F.struct(F.col("start_seconds").alias("start"), (F.col("start_seconds") + F.coalesce("audio_seconds", "duration_seconds")).alias("end"), F.col("text").alias("caption")))
    cues = rows.select("chapter", "idx", end.alias("_end"), F.posexplode(F.when(n >= 2, timed).otherwise(whole)).alias("cue", "c"))
    cues = cues.select("chapter", "idx", "cue", F.col("c.start").alias("start"), F.least("c.end", "_end").alias("end"), F.btrim(F.regexp_replace("c.caption", f"{X.SPACE}+", " ")).alias("caption"))
    return cues.where("end > start")


def srt_blocks(cues: DataFrame) -> DataFrame:
    """(chapter, idx, cue, number, block): numbered subtitle blocks, ready for a text sink."""
    number = F.row_number().over(Window.partitionBy("chapter").orderBy("idx", "cue"))
    block = F.concat_ws("\n", number, F.concat(X.srt_time(F.col("start")), F.lit(" --> "), X.srt_time(F.col("end"))), "caption", F.lit(""))
    return cues.select("chapter", "idx", "cue", number.cast("long").alias("number"), block.alias("block"))


def cyclic_segments(timeline: DataFrame, segments: DataFrame) -> DataFrame:
    """timeline with the camera segment of each panel (in cycle), its share of the rhythm, and the duration in that rhythm.

    A spoken panel keeps its duration, a silent one too; others are stretched to the rhythm, within the speech window.
    """
    s = segments.select(*[F.col(c).alias(f"seg_{c}" if c != "seg" else "seg") for c in segments.columns])
    count = len(G.SEGMENTS)
    rows = timeline.where("start_seconds is not null").withColumn("seg", (F.pmod(F.col("order") - 1, F.lit(count)) + 1).cast("int"))
    rows = rows.join(F.broadcast(s), "seg")  # the fixed cycle: a few rows
    all_ = Window.partitionBy("chapter")
    rows = rows.withColumn("rhythm", F.col("seg_dur") / F.sum("seg_dur").over(all_))
    scaled = F.col("seg_dur") * F.sum("duration_seconds").over(all_) / F.sum("seg_dur").over(all_)
    quiet = X.strip(X.text(F.col("text"))) == ""
    paced = F.when(F.coalesce(F.col("audio_seconds"), F.lit(0.0)) > 0, F.col("duration_seconds")).when(quiet, F.col("duration_seconds")).otherwise(X.round_ms_up(F.greatest(F.col("duration_seconds"), scaled)))
    cap = X.round_ms_up(F.greatest(F.lit(G.SPEECH_MOST + G.GAP), F.coalesce(F.col("audio_seconds") + G.GAP, F.lit(0.0))))
    return rows.withColumn("paced_seconds", F.least(paced, cap))


def alternating_direction(rows: DataFrame, is_split: Column) -> DataFrame:
    """rows with split_dir: 1 and -1 in turn over the split panels of a chapter, 1 for others."""
    seen = F.sum(is_split.cast("int")).over(_chapter())
    return rows.withColumn("split_dir", F.when(is_split & (seen % 2 == 0), -1).otherwise(1).cast("int"))


def pick(seed: Column, n: Column) -> Column:
    """A repeatable choice of 0..n-1 from a text."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long") % n


# Loudness of each kind of cue.
CUE_VOLUME, LOUDNESS = {"transition": 0.5, "action": 0.9, "reveal": 0.6}, 0.9


def sound_cues(timeline: DataFrame, bank: DataFrame) -> DataFrame:
    """(chapter, panel_id, kind, at_seconds, source, volume, trigger, number) by up to two rules for a panel.

    bank: (kind, k, source, n) with k from 0 to n - 1 in each kind. A cut into a spoken panel gets a
    transition but for the first; an action panel gets a hit at its keyword's time, if words have times, or
    just after the cut; a reveal gets one just after the cut. Times are clamped to the chapter after numbering.
    """
    rows = timeline.where("start_seconds is not null")
    total = F.sum("duration_seconds").over(Window.partitionBy("chapter"))
    first = F.row_number().over(_chapter()) == 1
    keyword = F.lower(F.regexp_extract(X.text(F.col("text")), X.ANY_CASE + X.SFX_WORDS, 1))
    rows = rows.withColumn("_total", total).withColumn("_first", first).withColumn("_word", keyword)
    bare = lambda w: F.lower(F.btrim(w["text"], F.lit(".,!?…\"'“”’ ")))
    at = F.filter(F.col("words"), lambda w: bare(w) == F.col("_word"))
    hit = (F.col("_word") != "") & (F.coalesce(F.size(at), F.lit(0)) > 0)
    cue = lambda kind, when, trigger: F.struct(F.lit(kind).alias("kind"), when.alias("at"), trigger.alias("trigger"))
    start = F.col("start_seconds")
    cut = F.when(~F.col("_first") & F.col("audio_seconds").isNotNull(), cue("transition", start, F.lit("panel_cut")))
    strike = cue("action", F.when(hit, start + F.element_at(at, 1)["start"]).otherwise(start + 0.15), F.when(hit, F.concat(F.lit("keyword:"), F.col("_word"))).otherwise("panel_class:action"))
    beat = F.when(F.col("class") == "action", strike).when(F.col("class") == "reveal", cue("reveal", start + 0.1, F.lit("panel_class:reveal")))
    cues = rows.withColumn("c", F.explode(F.array_compact(F.array(cut, beat))))
    cues = cues.select("chapter", "idx", "panel_id", "_total", F.col("c.kind").alias("kind"), F.col("c.at").alias("at"), F.col("c.trigger").alias("trigger"))
    sizes = bank.groupBy("kind").agg(F.max("n").alias("n"))
    cues = cues.join(F.broadcast(sizes), "kind").withColumn("k", pick(F.concat("panel_id", F.lit(":"), "kind"), F.col("n"))).drop("n")
    cues = cues.join(bank.select("kind", "k", "source"), ["kind", "k"])
    order = F.when(F.col("kind") == "transition", 0).otherwise(1)
    number = F.row_number().over(Window.partitionBy("chapter").orderBy("idx", order)).cast("long")
    volume = F.lit(0.0)
    for kind, v in CUE_VOLUME.items():
        volume = F.when(F.col("kind") == kind, round(min(max(v * LOUDNESS, 0.0), 2.0), 3)).otherwise(volume)
    clamped = F.least(F.greatest(F.round("at", 3), F.lit(0.0)), F.greatest(F.col("_total") - 0.2, F.lit(0.0)))
    return cues.select("chapter", "panel_id", "kind", F.round(clamped, 3).alias("at_seconds"), "source", volume.alias("volume"), "trigger", number.alias("number"))


def known_cues(cues: DataFrame, files: DataFrame) -> DataFrame:
    """cues whose source is among files(source)."""
    return cues.join(files.select("source").distinct(), "source", "left_semi")


def crossfades(timeline: DataFrame, kept: DataFrame, default: float = 0.5) -> DataFrame:
    """(chapter, from_panel, to_panel, kind, seconds, offset): a row per boundary, with kept(chapter, from_panel, to_panel, kind, seconds) settings where there are any."""
    rows = timeline.where("start_seconds is not null")
    w = _chapter()
    pairs = rows.select("chapter", "order", F.col("panel_id").alias("from_panel"), F.lead("panel_id").over(w).alias("to_panel"), F.sum("duration_seconds").over(w).alias("sum")).where("to_panel is not null")
    pairs = pairs.join(kept, ["chapter", "from_panel", "to_panel"], "left").withColumn("kind", F.coalesce("kind", F.lit("cut"))).withColumn("seconds", F.coalesce("seconds", F.lit(default)))
    fade = F.max("seconds").over(Window.partitionBy("chapter"))
    return pairs.select("chapter", "from_panel", "to_panel", "kind", "seconds", F.round(F.col("sum") - F.col("order") * fade, 3).alias("offset"))


def render_chunks(timeline: DataFrame, size: int = 12) -> DataFrame:
    """timeline rows with their chunk, and the strategy of their chapter."""
    rows = timeline.where("start_seconds is not null")
    w = Window.partitionBy("chapter")
    large = (F.count(F.lit(1)).over(w) > 25) | (F.sum("duration_seconds").over(w) > 150)
    return rows.withColumn("chunk", F.floor((F.col("order") - 1) / size).cast("long")).withColumn("strategy", F.when(large, "chunked").otherwise("direct"))


def motion_report(entries: DataFrame, segments: DataFrame, preset: str = "reference_v1", canvas: tuple[int, int] = G.CANVAS) -> DataFrame:
    """A row for each timeline entry that has a segment: what moves it, how far, and how sure the segment was measured.

    entries(chapter, order, panel_id, duration_seconds, width, height, seg); segments as in geometry.SEGMENTS, a small table.
    """
    s = F.struct(*[c for c in segments.columns if c != "seg"]).alias("_s")
    rows = entries.join(segments.select("seg", s), "seg")
    rows = rows.withColumn("_m", G.panel_motion(F.col("width"), F.col("height"), F.col("_s"), canvas)).where("_m is not null")
    own = [F.col(f"_s.{n}").alias(n) for n in ("zoom", "dx", "dy", "dxps", "dyps")]
    normal = [(F.col("_s.dx") / G.FRAME[0]).alias("ndx"), (F.col("_s.dy") / G.FRAME[1]).alias("ndy")]
    move = [F.col("_m.kind").alias("pan_kind"), *(F.col(f"_m.{n}").alias(n) for n in ("travel_px", "pan_x_px", "pan_y_px", "zoom_strength"))]
    still = G.is_static(F.col("_s.dxps"), F.col("_s.dyps")).alias("static")
    return rows.select("chapter", "order", "panel_id", F.lit(preset).alias("preset"), "seg", "duration_seconds", F.col("_s.dur").alias("reference_dur"), *own, *normal, *move, F.col("_s.match_score").alias("confidence"), still)
