"""Per-strip fixpoints: thin panels absorbed, oversized ones split. A group is one strip: its cuts, not its rows, are in memory at once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.operators.intervals import spaced_cuts


def absorbed(cuts: list[int], height: int, least: int) -> list[int]:
    """Inner cuts without those beside too thin panels: the first thin one joins its taller neighbour, upwards on ties, until none is left.

    One pass from the top: what is above is never thin, so a thin panel either ends there or grows downwards.
    """
    bottoms, top = [], 0
    ahead = [*sorted(cuts), height]
    for k, bottom in enumerate(ahead):
        if bottom - top < least:
            taller = top - (bottoms[-2] if len(bottoms) > 1 else 0) if bottoms else -1
            if k + 1 < len(ahead) and ahead[k + 1] - bottom > taller:
                continue  # the one below takes it in
            if bottoms:
                bottoms.pop()  # the one above does
        bottoms.append(bottom)
        top = bottom
    return bottoms[:-1]


def absorb_thin(strips: DataFrame, least: int) -> DataFrame:
    """(strip, k, y0, y1) of strips(strip, cut, height) after thin panels are absorbed."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for strip, height, cuts in pdf.itertuples(index=False):
                edges = [0, *absorbed([int(c) for c in cuts if 0 < c < height], int(height), least), int(height)]
                made += [(strip, k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(made, columns=["strip", "k", "y0", "y1"])

    kind = strips.schema["strip"].dataType.simpleString()
    # One row for each strip: a frame for each would cost more than its panels.
    rows = strips.groupBy("strip").agg(F.first("height").alias("height"), F.collect_set(F.col("cut").cast("long")).alias("cuts"))
    return rows.mapInPandas(join, f"strip {kind}, k int, y0 long, y1 long")


def _place(y0: int, y1: int, gutters: list[int]) -> int | None:
    """The gutter within (y0, y1) nearest to the middle, the upper one on ties, if both sides keep a quarter and 50 rows."""
    middle, side = (y0 + y1) // 2, max(50, (y1 - y0) // 4)
    k = bisect_left(gutters, middle)
    near = [g for g in gutters[max(k - 1, 0) : k + 1] if y0 + side <= g <= y1 - side]
    return min(near, key=lambda g: (abs(g - middle), g), default=None)


def pieces(y0: int, y1: int, name: str, gutters: list[int], most: int) -> list[tuple[str, int, int]]:
    """A panel split at the gutter nearest its middle while it is too tall and both sides stay balanced; never blindly.

    Panels are halved level by level; a half's name has one more letter.
    """
    gutters = sorted(gutters)
    done, level = [], [(name, y0, y1)]
    while level:
        halves = []
        for label, a, b in level:
            row = _place(a, b, gutters) if b - a > most else None
            if row is None:
                done.append((label, a, b))
            else:
                halves += [(label + "a", a, row), (label + "b", row, b)]
        level = halves
    return sorted(done, key=lambda p: p[1])


def split_oversized(panels: DataFrame, gutters: DataFrame, most: int) -> DataFrame:
    """(strip, id, y0, y1) of panels(strip, id, y0, y1) split at gutters(strip, mid)."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for strip, panels_, mids in pdf.itertuples(index=False):
                cuts = [] if mids is None else [int(m) for m in mids]
                made += [(strip, *p) for panel in panels_ for p in pieces(panel["y0"], panel["y1"], panel["id"], cuts, most)]
            yield pd.DataFrame(made, columns=["strip", "id", "y0", "y1"])

    kind = panels.schema["strip"].dataType.simpleString()
    # One row for each strip: a frame for each would cost more than its panels.
    panel = F.struct(F.col("id").cast("string").alias("id"), F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))
    left = panels.groupBy("strip").agg(F.collect_list(panel).alias("panels"))
    right = gutters.groupBy(F.col("strip").alias("of")).agg(F.collect_list(F.col("mid").cast("long")).alias("mids"))
    rows = left.join(right, left["strip"].eqNullSafe(right["of"]), "left").select("strip", "panels", "mids")
    return rows.mapInPandas(split, f"strip {kind}, id string, y0 long, y1 long")


def fallback_plan(rows: DataFrame, found: DataFrame, least: int, most: int, tiny: int = 5) -> DataFrame:
    """(strip, panel_index, y0, y1, panel_type, confidence): panels of a strip of which nothing is known but its rows.

    rows(strip, y) give the heights and found(strip, mid) the gutters.  Cuts are at least `least` rows apart, panels
    under `tiny` rows go, those over `most` are split at gutters within; a strip with a single cut has no panel.
    The confidence is 0: nothing was read.
    """
    heights = rows.groupBy("strip").agg((F.max("y") + 1).cast("long").alias("h"))
    mids = found.groupBy("strip").agg(F.array_sort(F.collect_list(F.col("mid").cast("long"))).alias("mids"))
    # One row for each strip: its gutters cut it and split what is too tall.
    strips = heights.join(mids, "strip", "left").withColumn("mids", F.coalesce("mids", F.array().cast("array<bigint>")))
    strips = strips.withColumn("cuts", spaced_cuts(F.col("mids"), F.col("h"), least))
    kind = rows.schema["strip"].dataType.simpleString()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for strip, gutters, cuts in pdf[["strip", "mids", "cuts"]].itertuples(index=False):
                panels = [(int(a), int(b)) for a, b in zip(cuts, cuts[1:]) if b - a >= tiny]
                parts = [p for a, b in panels for p in pieces(a, b, "", [int(g) for g in gutters], most)]
                made += [(strip, k, a, b) for k, (_, a, b) in enumerate(sorted(parts, key=lambda p: p[1]), 1)]
            yield pd.DataFrame(made, columns=["strip", "panel_index", "y0", "y1"])

    out = strips.select("strip", "mids", "cuts").mapInPandas(split, f"strip {kind}, panel_index long, y0 long, y1 long")
    return out.select("strip", "panel_index", "y0", "y1", F.lit("unknown").alias("panel_type"), F.lit(0.0).alias("confidence"))
