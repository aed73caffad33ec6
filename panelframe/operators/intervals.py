"""Intervals on strips: tiles, runs, cuts, overlaps.

A strip's rows are numbered from the top; intervals are [y0, y1).  Joins are always within a strip, so a
range condition is a residual of an equi-join; long strips are cut into cells of CELL rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.functions.text import let

CELL = 2000


def tiles(height: Column, size: int = 2000, overlap: int = 200) -> Column:
    """array<struct<base, y0, y1>> of overlapping tiles; the last ends at the height."""
    step = size - overlap
    count = F.when(height <= size, 1).otherwise(F.ceil((height - size) / step) + 1).cast("int")
    tile = lambda k: F.struct(k.alias("k"), (k * step).alias("y0"), F.least(k * step + size, height).alias("y1"))
    return F.when(height > 0, F.transform(F.sequence(F.lit(0), count - 1), tile)).otherwise(F.array().cast("array<struct<k:int,y0:int,y1:int>>"))


def runs(rows: DataFrame, keys: list[str], pos: str, flag: Column, *more: Column) -> DataFrame:
    """(keys, lo, hi, rows): maximal runs of consecutive positions where flag holds; with more aggregates of a run's rows."""
    w = Window.partitionBy(*keys).orderBy(pos)
    on = rows.where(flag).withColumn("_island", F.col(pos) - F.row_number().over(w))
    return on.groupBy(*keys, "_island").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("rows"), *more).drop("_island")


def cells(df: DataFrame, y0: str, y1: str, name: str = "cell") -> DataFrame:
    """A row for each cell of the strip that an interval touches."""
    last = F.greatest(F.col(y0), F.col(y1) - 1)
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(y0) / CELL), F.floor(last / CELL))))


def overlapping(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str]) -> DataFrame:  # noqa: E741
    """Pairs of intervals of one strip that overlap, each once: joined by cell, kept in the first cell that both touch."""
    a, b = cells(left, *l), cells(right, *r)
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / CELL)
    return a.join(b, [key, "cell"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("cell") == first)).drop("cell")


def gutters(rows: DataFrame, forbidden: DataFrame, least: int = 3, most: int = 120, tolerance: float = 24.0) -> DataFrame:
    """(strip, lo, hi, mid): runs of single-colour rows near the background's level, without a forbidden row.

    rows: (strip, y, mono, level, background); forbidden: (strip, f0, f1).
    """
    level = runs(rows, ["strip"], "y", F.col("mono"), F.percentile("level", F.lit(0.5)).alias("median"), F.first("background").alias("background")).where(F.col("rows").between(least, most))
    level = level.where(F.abs(F.col("median") - F.col("background")) <= tolerance).withColumn("end", F.col("hi") + 1)
    hit = overlapping(level, forbidden, "strip", ("lo", "end"), ("f0", "f1")).select("strip", "lo", "hi")
    return level.join(hit, ["strip", "lo", "hi"], "left_anti").select("strip", "lo", "hi", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))


def spaced_cuts(cuts: Column, height: Column, least: int) -> Column:
    """The cuts that a top-down pass keeps: each at least `least` after the last kept one, then the strip's end.

    A fold, since each choice depends on the one before it.
    """
    kept = F.aggregate(F.array_sort(cuts), F.array(F.lit(0).cast("long")), lambda a, c: F.when(c - F.element_at(a, -1) >= least, F.concat(a, F.array(c))).otherwise(a))
    return F.transform(
        F.array(kept),
        lambda k: F.when(F.element_at(k, -1) < height - least, F.concat(k, F.array(height))).when(F.element_at(k, -1) != height, F.concat(F.slice(k, F.lit(1), F.size(k) - 1), F.array(height))).otherwise(k),
    )[0]


def nearest_run(boundaries: DataFrame, found: DataFrame, tolerances: list[int], relaxed: DataFrame | None = None) -> DataFrame:
    """boundaries(strip, b) with the middle of the nearest run (strip, lo, hi) within the first tolerance that has one; null without.

    relaxed are runs under weaker thresholds; within the widest tolerance they stand in where no other run does.
    """
    widest = max(tolerances)
    near = boundaries.withColumn("n0", F.col("b") - widest).withColumn("n1", F.col("b") + widest + 1)
    every = found.select("strip", "lo", "hi", F.lit(False).alias("weak"))
    if relaxed is not None:
        every = every.unionByName(relaxed.select("strip", "lo", "hi", F.lit(True).alias("weak")))
    pairs = overlapping(near, every.withColumn("end", F.col("hi") + 1), "strip", ("n0", "n1"), ("lo", "end"))
    distance = F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("b"))
    level = F.lit(len(tolerances))
    for k, t in reversed([*enumerate(tolerances)]):
        level = F.when((F.col("hi") >= F.col("b") - t) & (F.col("lo") <= F.col("b") + t), k).otherwise(level)
    place = F.when(F.col("weak"), len(tolerances) + 1).otherwise(level)
    best = pairs.groupBy("strip", "b").agg(F.min_by(F.floor((F.col("lo") + F.col("hi")) / 2), F.struct(place, distance, "lo")).alias("cut"))
    return boundaries.join(best, ["strip", "b"], "left")


def entry_boundaries(entries: DataFrame) -> DataFrame:
    """(strip, k, b): between each entry(strip, k, y0, y1) and the next one the middle of their gap, or of their overlap; k is the lower one."""
    w = Window.partitionBy("strip").orderBy("y0", "k")
    above = F.lag("y1").over(w)
    return entries.withColumn("b", F.floor((above + F.col("y0")) / 2)).where("b is not null").select("strip", "k", "b")


def build_cuts(entries: DataFrame, heights: DataFrame, cuts: DataFrame) -> DataFrame:
    """(strip, panel, y0, y1, text, members, top_snap, bottom_snap): entries between two cuts are one panel.

    entries(strip, k, y0, y1, text), heights(strip, height), cuts(strip, k, b, cut) for the boundary above entry
    k: without a cut the entry goes on with the one before it.  The first panel begins at the strip's top, the last
    one ends at its height.  A snap is how far a cut is from its boundary, null at the strip's ends.  Texts are
    joined in order, empty ones left out.
    """
    w = Window.partitionBy("strip").orderBy("y0", "k")
    rows = entries.join(cuts.select("strip", "k", "b", "cut"), ["strip", "k"], "left")
    rows = rows.withColumn("panel", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(w).cast("long"))
    part = F.array_sort(F.collect_list(F.struct("y0", "k", F.btrim("text").alias("t"))))
    texts = F.filter(F.transform(part, lambda p: p["t"]), lambda t: t != "")
    groups = rows.groupBy("strip", "panel").agg(F.max("cut").alias("top"), F.max(F.abs(F.col("cut") - F.col("b"))).alias("top_snap"), F.array_join(texts, " ").alias("text"), F.transform(part, lambda p: p["k"]).alias("members"))
    order = Window.partitionBy("strip").orderBy("panel")
    groups = groups.withColumn("foot", F.lead("top").over(order)).withColumn("bottom_snap", F.lead("top_snap").over(order)).join(heights, "strip")
    return groups.select("strip", "panel", F.coalesce("top", F.lit(0)).cast("long").alias("y0"), F.coalesce("foot", "height").cast("long").alias("y1"), "text", "members", "top_snap", "bottom_snap")


def without_thin(cuts: DataFrame, kept: DataFrame) -> DataFrame:
    """cuts(strip, k, b, cut) with null for those that are no longer an edge of kept(strip, y0), the panels after absorption.

    Of several boundaries that have one cut, the topmost keeps it.
    """
    w = Window.partitionBy("strip", "cut").orderBy("b", "k")
    first = cuts.withColumn("_first", (F.row_number().over(w) == 1) & F.col("cut").isNotNull())
    left = kept.select("strip", F.col("y0").alias("cut"), F.lit(True).alias("_kept")).where("cut > 0")
    rows = first.join(left, ["strip", "cut"], "left")
    return rows.select("strip", "k", "b", F.when(F.col("_first") & F.col("_kept"), F.col("cut")).alias("cut"))


def stitched(entries: Column, boxes: bool = False) -> Column:
    """Entries of overlapping tiles, array<struct<y0, y1, text>>, merged top down where half of the shorter one overlaps.

    The test is against the growing union, so this is a fold; the text of the longest single entry stays.  With boxes,
    entries have an array of these last, in rows of the strip, and a merged one gets those of all its entries in order.
    """
    # The last merged range is held apart from those before it, with the ordinals of its first and last entry and of the
    # one whose text it keeps: what is merged is next to each other.
    names = ["y0", "y1", "first", "n", "longest", "best"]
    span = lambda *c: F.struct(*[x.alias(n) for n, x in zip(names, c)])
    zero = F.lit(0).cast("long")
    kind = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), span(*[zero] * 6).alias("last"))
    close = lambda a: F.concat(a["done"], F.array(a["last"]))

    def step(a: Column, e: Column) -> Column:
        p, n = a["last"], e["y1"] - e["y0"]
        k = p["n"] + 1
        inter = F.least(p["y1"], e["y1"]) - F.greatest(p["y0"], e["y0"])
        same = (p["n"] > 0) & (inter > 0) & (2 * inter >= F.least(p["y1"] - p["y0"], n))
        both = span(F.least(p["y0"], e["y0"]), F.greatest(p["y1"], e["y1"]), p["first"], k, F.greatest(p["longest"], n), F.when(n > p["longest"], k).otherwise(p["best"]))
        apart = F.struct(F.when(p["n"] > 0, close(a)).otherwise(a["done"]).alias("done"), span(e["y0"], e["y1"], k, k, n, k).alias("last"))
        return F.when(same, F.struct(a["done"].alias("done"), both.alias("last"))).otherwise(apart)

    def merged(ordered: Column) -> Column:
        def whole(r: Column) -> Column:
            fields = [r["y0"].alias("y0"), r["y1"].alias("y1"), F.get(ordered, (r["best"] - 1).cast("int"))["text"].alias("text")]
            if boxes:
                own = F.slice(ordered, r["first"].cast("int"), (r["n"] - r["first"] + 1).cast("int"))
                fields.append(F.flatten(F.transform(own, lambda e: e["boxes"])).alias("boxes"))
            return F.struct(*fields)

        return F.aggregate(ordered, start, step, lambda a: F.transform(F.when(a["last"]["n"] > 0, close(a)).otherwise(a["done"]), whole))

    return let(F.array_sort(F.filter(entries, lambda e: e["y0"] < e["y1"])), merged)


def on_strip(base: Column, height: Column, entries: Column) -> Column:
    """A tile's entries, array<struct<y0, y1, text, boxes>>, in rows of the strip: moved by the tile's base, cut at the strip's ends, boxes moved alike."""
    long = lambda c: c.cast("long")
    moved = lambda b: F.struct(b["x"].alias("x"), (b["y"] + base).alias("y"), b["w"].alias("w"), b["h"].alias("h"))
    return F.transform(entries, lambda e: F.struct(long(F.greatest(e["y0"] + base, F.lit(0))).alias("y0"), long(F.least(e["y1"] + base, height)).alias("y1"), e["text"].alias("text"), F.transform(F.coalesce(e["boxes"], F.array()), moved).alias("boxes")))


def best_overlap(panels: DataFrame, entries: DataFrame) -> DataFrame:
    """panels(strip, id, p0, p1) with the text of the entry(strip, k, e0, e1, text) that overlaps most; the first one on ties, null without."""
    pairs = overlapping(panels, entries, "strip", ("p0", "p1"), ("e0", "e1"))
    amount = F.least("p1", "e1") - F.greatest("p0", "e0")
    best = pairs.groupBy("strip", "id").agg(F.max_by("text", F.struct(amount, -F.col("k"))).alias("text"), F.max(amount).alias("overlap"))
    return panels.join(best, ["strip", "id"], "left")


def first_overlap(spans: DataFrame, flag: float = 0.30, same: float = 0.85) -> DataFrame:
    """spans(strip, k, y0, y1) with the first earlier span that overlaps by `flag` (intersection over hull), and whether by `same`."""
    earlier = spans.select("strip", F.col("k").alias("o"), F.col("y0").alias("o0"), F.col("y1").alias("o1"))
    pairs = overlapping(spans, earlier, "strip", ("y0", "y1"), ("o0", "o1")).where("o < k")
    iou = (F.least("y1", "o1") - F.greatest("y0", "o0")) / F.greatest(F.lit(1), F.greatest("y1", "o1") - F.least("y0", "o0"))
    first = pairs.withColumn("iou", iou).where(F.col("iou") >= flag).groupBy("strip", "k").agg(F.min(F.struct("o", "iou")).alias("f"))
    return spans.join(first, ["strip", "k"], "left").select("strip", "k", "y0", "y1", F.col("f.o").alias("other"), F.round("f.iou", 6).alias("iou"), (F.col("f.iou") >= same).alias("duplicate"))


def reading_order(boxes: DataFrame, right_to_left: bool = False) -> DataFrame:
    """boxes(page, id, x, y, w, h) with their place in reading order: rows of boxes that overlap in height, then along the row."""
    w = Window.partitionBy("page").orderBy("y", "id")
    top = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    banded = boxes.withColumn("_new", F.coalesce((F.col("y") >= top).cast("int"), F.lit(1)))
    banded = banded.withColumn("band", F.sum("_new").over(w).cast("long")).drop("_new")
    along = F.desc("x") if right_to_left else F.asc("x")
    return banded.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("band", along, "id")).cast("long"))


def boundary_ranges(values: Column, height: Column, least: int = 30) -> Column:
    """array<struct<slot, y0, y1>>: clamped distinct boundaries paired up; too low ranges go, the slot numbers stay."""
    clean = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.greatest(F.lit(0).cast("long"), F.least(height, v)))))
    pair = lambda k: F.transform(F.slice(k, F.lit(1), F.size(k) - 1), lambda v, i: F.struct(i.alias("slot"), v.alias("y0"), F.element_at(k, i + 2).alias("y1")))
    pairs = F.transform(F.array(clean), lambda k: F.when(F.size(k) > 1, pair(k)))[0]
    return F.filter(pairs, lambda p: p["y1"] - p["y0"] >= least)


def covered(panels: DataFrame, blanks: DataFrame) -> DataFrame:
    """panels(strip, id, p0, p1) with the share of each that blanks(strip, b0, b1, score) cover, how many and the best score."""
    pairs = overlapping(panels, blanks, "strip", ("p0", "p1"), ("b0", "b1"))
    part = F.least("p1", "b1") - F.greatest("p0", "b0")
    sums = pairs.groupBy("strip", "id").agg(F.sum(part).alias("_rows"), F.count(F.lit(1)).alias("regions"), F.max("score").alias("score"))
    out = panels.join(sums, ["strip", "id"], "left").withColumn("share", F.coalesce(F.col("_rows") / F.greatest(F.lit(1), F.col("p1") - F.col("p0")), F.lit(0.0)))
    return out.withColumn("regions", F.coalesce("regions", F.lit(0).cast("long"))).withColumn("dropped", F.col("share") >= 0.95).drop("_rows")


def without_blanks(panels: DataFrame, regions: DataFrame) -> DataFrame:
    """panels(strip, id, p0, p1) after regions(strip, b0, b1, score, verdict): (strip, id, p0, p1, flag, score).

    A panel that blank ones cover by 95 % goes.  Blank bands at an end are trimmed, top down, with a slack for the
    detector's windows and a part that always stays; one in the middle only marks the panel as suspicious.
    What is left under 30 rows goes too.  Suspicious regions mark panels in strips without a blank one.
    """
    pairs = overlapping(panels, regions, "strip", ("p0", "p1"), ("b0", "b1"))
    blank = F.col("verdict") == "blank"
    region = F.struct("b0", "b1", "score")
    any_blank = regions.where(blank).select("strip").distinct().withColumn("_blanks", F.lit(True))
    found = pairs.groupBy("strip", "id").agg(
        F.array_sort(F.collect_list(F.when(blank, region))).alias("_cut"), F.sum(F.when(blank, F.least("p1", "b1") - F.greatest("p0", "b0"))).alias("_rows"), F.min_by("score", F.struct("b0", "b1")).alias("_doubt")
    )
    rows = panels.join(found, ["strip", "id"], "left").join(any_blank, "strip", "left")
    height = F.col("p1") - F.col("p0")
    slack, keep = F.greatest(F.lit(48), F.floor(height * 0.02)), F.greatest(F.lit(30), F.floor(height * 0.1))

    def step(a: Column, r: Column) -> Column:
        top, foot = r["b0"] <= a["y0"] + slack, r["b1"] >= a["y1"] - slack
        y0 = F.when(top, F.greatest(a["y0"], F.least(r["b1"], a["y1"] - keep))).otherwise(a["y0"])
        y1 = F.when(foot, F.least(a["y1"], F.greatest(r["b0"], y0 + keep))).otherwise(a["y1"])
        return F.struct(y0.cast("long").alias("y0"), y1.cast("long").alias("y1"), F.when(~top & ~foot, F.greatest(a["doubt"], r["score"])).otherwise(a["doubt"]).alias("doubt"))

    start = F.struct(F.col("p0").cast("long").alias("y0"), F.col("p1").cast("long").alias("y1"), F.lit(None).cast("double").alias("doubt"))
    rows = rows.withColumn("_t", F.aggregate(F.coalesce("_cut", F.array().cast("array<struct<b0:bigint,b1:bigint,score:double>>")), start, step))
    doubt = F.when(F.col("_blanks"), F.col("_t.doubt")).otherwise(F.col("_doubt"))
    covered = F.coalesce(F.col("_rows") / F.greatest(F.lit(1), height) >= 0.95, F.lit(False))
    small = (F.size(F.coalesce("_cut", F.array())) > 0) & (F.col("_t.y1") - F.col("_t.y0") < F.least(F.lit(30), keep))
    kept = rows.where(~covered & ~small)
    return kept.select("strip", "id", F.col("_t.y0").alias("p0"), F.col("_t.y1").alias("p1"), F.when(doubt.isNotNull(), "suspicious").alias("flag"), doubt.alias("score"))


def page_panels(cuts: DataFrame) -> DataFrame:
    """Panels of a cut strip(strip, width, id, k, y0, y1, image_file) as panels of its one page, over the strip's whole width."""
    box = F.struct(F.lit(0).cast("long").alias("x"), F.col("y0").cast("long").alias("y"), F.col("width").cast("long").alias("w"), (F.col("y1") - F.col("y0")).cast("long").alias("h"))
    return cuts.select("strip", "id", F.lit(1).alias("page"), F.col("k").alias("index"), box.alias("bbox"), F.col("image_file").alias("source_image"), F.lit("top_to_bottom").alias("reading_order"))
