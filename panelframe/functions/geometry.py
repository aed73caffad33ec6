"""Panel geometry, pacing and camera moves as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelframe.functions.text import round_ms_up

# Pacing of the default edit.
GAP, MIN_DISPLAY, MAX_DISPLAY, MIN_SILENT, ACTION_FLOOR = 0.0, 2.0, 12.0, 1.0, 0.8
SILENT_WPM, PAN_SPEED, SPEECH_MOST = 160, 450, 4.6
CLASS_FACTOR = {"action": 1.0, "reveal": 1.35, "dialogue": 1.0, "calm": 1.0}
CANVAS = (1080, 1920)
# The reference camera cycle (segment, seconds, zoom, match score, dx, dy, dx per second, dy per second) and its frame.
SEGMENTS = [
    (1, 2.0, 1.14, 0.99, 0.0, 0.0, 0.0, 0.0),
    (2, 2.5, 1.0, 0.99, 0.0, 150.0, 0.0, 60.0),
    (3, 2.2, 1.0, 0.99, 150.0, 0.0, 68.0, 0.0),
    (4, 2.0, 0.92, 0.99, 0.0, 0.0, 0.0, 0.0),
    (5, 2.5, 1.0, 0.99, 0.0, -150.0, 0.0, -60.0),
    (6, 2.2, 1.0, 0.99, -150.0, 0.0, -68.0, 0.0),
    (7, 1.8, 1.12, 0.99, 0.0, 0.0, 0.0, 0.0),
    (8, 2.8, 1.0, 0.99, 0.0, 150.0, 0.0, 54.0),
]
SEGMENT_COLUMNS = "seg int, dur double, zoom double, match_score double, dx double, dy double, dxps double, dyps double"
FRAME = (1312, 2332)
STATIC_SPEED, LOW_CONFIDENCE, LOW_DAMPING = 5.0, 0.85, 0.6


def _pan(over_w: Column, over_h: Column, w: Column, h: Column) -> Column:
    down, right = (over_h > 2) & (over_h >= over_w), over_w > 2
    kind = F.when(down, "pan_down").when(right, "pan_right").otherwise("static")
    travel = F.when(down, over_h).when(right, over_w).otherwise(0)
    return F.struct(kind.alias("kind"), w.alias("scaled_w"), h.alias("scaled_h"), travel.cast("int").alias("travel_px"))


def compute_pan(width: Column, height: Column, canvas: tuple[int, int] = CANVAS, contain: bool = False) -> Column:
    """struct(kind, scaled_w, scaled_h, travel_px): cover the canvas and pan along the overflow, at most four times
    enlarged; contained panels stay whole and still. Null for a panel without positive size."""
    cw, ch = canvas
    pick = F.least if contain else F.greatest
    scale = F.least(pick(F.lit(cw) / width, F.lit(ch) / height), F.lit(4.0))
    w, h = F.ceil(width * scale).cast("int"), F.ceil(height * scale).cast("int")
    if contain:
        w, h = F.greatest(F.lit(1), w), F.greatest(F.lit(1), h)
        zero = F.lit(0)
        out = _pan(zero, zero, w, h)
    else:
        out = _pan(w - cw, h - ch, w, h)
    return F.when((width > 0) & (height > 0), out)


def fit_pan(width: Column, height: Column, canvas: tuple[int, int] = CANVAS) -> Column:
    """As compute_pan(), without the limit of four times and rounded half to even."""
    cw, ch = canvas
    scale = F.greatest(F.lit(cw) / width, F.lit(ch) / height)
    w = F.greatest(F.lit(cw), F.bround(width * scale).cast("int"))
    h = F.greatest(F.lit(ch), F.bround(height * scale).cast("int"))
    return F.when((width > 0) & (height > 0), _pan(w - cw, h - ch, w, h))


def pan_direction(width: Column, height: Column, canvas: tuple[int, int] = CANVAS) -> Column:
    panel, screen = width / F.greatest(height, F.lit(1)), canvas[0] / max(canvas[1], 1)
    return F.when(panel < screen * 0.85, "down").when(panel > screen * 1.15, "right").otherwise("none")


def display_seconds(audio: Column, words: Column, travel: Column, panel_class: Column) -> Column:
    """Seconds that a panel is shown: as long as its speech and no longer than the speech window; silent ones by reading speed."""
    pan_floor = F.coalesce(travel / F.lit(float(PAN_SPEED)), F.lit(0.0))
    factor = F.lit(CLASS_FACTOR["calm"])
    for name, f in CLASS_FACTOR.items():
        factor = F.when(panel_class == name, f).otherwise(factor)
    floor = F.when(panel_class == "action", min(MIN_DISPLAY, ACTION_FLOOR)).otherwise(MIN_DISPLAY)
    spoken = F.least(F.greatest(audio + GAP, floor, pan_floor) * factor, F.greatest(F.lit(SPEECH_MOST + GAP), audio + GAP))
    read = words / F.lit(SILENT_WPM) * 60.0
    silent = F.least(F.greatest(read + GAP, F.lit(MIN_SILENT)), F.lit(MAX_DISPLAY))
    silent = F.least(F.greatest(silent, pan_floor) * factor, F.lit(SPEECH_MOST + GAP))
    return round_ms_up(F.when(audio.isNotNull(), spoken).otherwise(silent))


def content_seconds(audio: Column, words: Column, travel: Column, least: float = 2.5, most: float = 12.0, wpm: int = SILENT_WPM) -> Column:
    """The plain variant: speech or reading time within a least and a most, never shorter than the pan."""
    pan_floor = F.coalesce(travel / F.lit(float(PAN_SPEED)), F.lit(0.0))
    return F.least(F.greatest(F.coalesce(audio, words / F.lit(wpm) * 60.0), F.lit(least), pan_floor), F.lit(most))


def cap_travel(travel: Column, pan_x: Column, pan_y: Column) -> Column:
    """struct(travel_px, pan_x_px, pan_y_px): a silent beat's move cut to what fits its hold; both axes in proportion."""
    allowed = int(MIN_SILENT * PAN_SPEED)
    over, part = travel > allowed, F.lit(float(allowed)) / travel
    return F.struct(
        F.when(over, allowed).otherwise(travel).cast("int").alias("travel_px"),
        F.when(over, F.bround(pan_x * part, 3)).otherwise(pan_x).alias("pan_x_px"),
        F.when(over, F.bround(pan_y * part, 3)).otherwise(pan_y).alias("pan_y_px"),
    )


def is_static(dxps: Column, dyps: Column) -> Column:
    return F.hypot(dxps, dyps) < STATIC_SPEED


def segment_kind(zoom: Column, dx: Column, dy: Column, dxps: Column, dyps: Column) -> Column:
    still = F.when(zoom >= 1.1, "zoom_in").when(zoom <= 0.95, "zoom_out").otherwise("static")
    vertical = F.when(dy > 0, "pan_down").otherwise("pan_up")
    sideways = F.when(dx > 0, "pan_right").otherwise("pan_left")
    return F.when(is_static(dxps, dyps), still).when(F.abs(dy) >= F.abs(dx), vertical).otherwise(sideways)


def zoom_strength(zoom: Column) -> Column:
    return F.least(F.lit(0.4), F.greatest(F.lit(0.0), 0.15 + (zoom - 1.0) * 0.5))


def damping(match_score: Column) -> Column:
    return F.when(match_score >= 0.95, 1.0).when(match_score >= LOW_CONFIDENCE, 0.8).otherwise(LOW_DAMPING)


def from_thousandths(v: Column, size: Column) -> Column:
    """A 0..1000 coordinate in pixels, clamped to the size."""
    return F.least(F.greatest(F.bround(v * size / 1000.0), F.lit(0)), size).cast("int")


# Fixed value: how far the shapes of a plan's strip and of the strip may be from each other.
ASPECT_GAP = 0.05


def rescaled(entries: Column, plan: tuple[Column, Column], strip: tuple[Column, Column]) -> Column:
    """struct(entries, scaled, problem): a plan's entries, array<struct<y0, y1, boxes array<struct<x, y, w, h>>>>, in pixels of the strip.

    plan and strip are widths and heights. Equal ones leave the entries; shapes more than ASPECT_GAP apart are of another
    image: no entries and the problem 'aspect'; sizes that are none or null the problem 'size'. Halves round to even.
    """
    # A size that is no size is null from here on.
    w, h, pw, ph = (F.when(c > 0, c.cast("double")) for c in (*strip, *plan))
    sane = w.isNotNull() & h.isNotNull() & pw.isNotNull() & ph.isNotNull()
    same, gap = (w == pw) & (h == ph), F.abs(pw / ph - w / h) / (pw / ph)
    at = lambda v, scale: F.bround(v * scale).cast("long")
    whole = lambda v: v.cast("long")

    def entry(x: Callable, y: Callable) -> Callable:
        box = lambda b: F.struct(x(b["x"]).alias("x"), y(b["y"]).alias("y"), x(b["w"]).alias("w"), y(b["h"]).alias("h"))
        return lambda e: F.struct(y(e["y0"]).alias("y0"), y(e["y1"]).alias("y1"), F.transform(e["boxes"], box).alias("boxes"))

    made = F.when(sane & same, F.transform(entries, entry(whole, whole))).when(sane & (gap <= ASPECT_GAP), F.transform(entries, entry(lambda v: at(v, w / pw), lambda v: at(v, h / ph))))
    problem = F.when(~sane, "size").when(~same & (gap > ASPECT_GAP), "aspect")
    return F.struct(made.alias("entries"), F.coalesce(sane & ~same & (gap <= ASPECT_GAP), F.lit(False)).alias("scaled"), problem.alias("problem"))


def output_size(width: Column, height: Column, target: int = 390, tallest: int = 800) -> Column:
    """struct(w, h) of the normalised panel: scaled to the target width, left as it is where that is too tall."""
    h = F.bround(height * target / width).cast("int")
    return F.struct(F.when(h > tallest, width).otherwise(target).cast("int").alias("w"), F.when(h > tallest, height).otherwise(h).cast("int").alias("h"))


# Fixed value: lower pieces are debris of gutters, not panels.
LEAST_HEIGHT = 30


def saved_range(y0: Column, y1: Column, height: Column) -> Column:
    """struct(y0, y1) of a panel within its image; null for what is too low to be one, or outside."""
    a, b = F.greatest(y0, F.lit(0)), F.least(y1, height)
    return F.when(b - a >= LEAST_HEIGHT, F.struct(a.cast("long").alias("y0"), b.cast("long").alias("y1")))


# Framing of a contained panel on its blurred copy, and when a strip is shown as two bands.
TALL_SCALE, NORMAL_SCALE, NARROW_FILL = 2.2, 2.0, 0.5
SWEEP, SLIDE = 0.35, 0.08
SPLIT_ASPECT, SPLIT_COLUMNS = 3.0, 2
LARGEST = 4.0


def panel_motion(width: Column, height: Column, segment: Column, canvas: tuple[int, int] = CANVAS, strength: float = 1.0, blurred: bool = True) -> Column:
    """struct(kind, scaled_w, scaled_h, travel_px, pan_x_px, pan_y_px, tall, panel_scale, split_columns, zoom_strength): a segment's move on one panel.

    segment: struct(zoom, match_score, dx, dy, dxps, dyps).  Blurred: the panel stands within the canvas,
    enlarged, and sweeps a fixed part of the frame; a very tall strip is two still bands.  Else it covers the
    canvas and moves as far as the segment does, damped, within what hangs over; a move of two pixels or
    less is a hold.  Null for a panel without positive size.
    """
    cw, ch = canvas
    kind = segment_kind(segment["zoom"], segment["dx"], segment["dy"], segment["dxps"], segment["dyps"])
    whole = lambda c: F.greatest(F.lit(1), F.ceil(c).cast("int"))

    def moved(kind: Column, along_x: Column, along_y: Column, **rest: Column) -> Column:
        signed = lambda plus, minus, n: F.when(kind == plus, n).when(kind == minus, -n).otherwise(0).cast("double")
        x, y = signed("pan_right", "pan_left", along_x), signed("pan_down", "pan_up", along_y)
        fields = rest | {"kind": kind, "travel_px": F.abs(x + y).cast("int"), "pan_x_px": x, "pan_y_px": y}
        return F.struct(*[fields[n].alias(n) for n in ("kind", "scaled_w", "scaled_h", "travel_px", "pan_x_px", "pan_y_px", "tall", "panel_scale", "split_columns", "zoom_strength")])

    pushed = zoom_strength(segment["zoom"])
    if blurred:
        contain = F.least(F.lit(cw) / width, F.lit(ch) / height, F.lit(LARGEST))
        narrow = width * contain / cw < NARROW_FILL
        split = narrow & (height / width >= SPLIT_ASPECT)
        scale = F.when(split, 1.0).when(narrow, TALL_SCALE).otherwise(NORMAL_SCALE)
        band = F.least(F.lit(cw) / (width * SPLIT_COLUMNS), F.lit(ch) / (height / SPLIT_COLUMNS), F.lit(LARGEST))
        shown = F.when(split, "static").otherwise(kind)
        w = F.when(split, whole(width * SPLIT_COLUMNS * band)).otherwise(whole(width * contain * scale))
        h = F.when(split, whole(height / SPLIT_COLUMNS * band)).otherwise(whole(height * contain * scale))
        out = moved(
            shown, F.bround(F.lit(cw * SLIDE)), F.bround((scale - 1.0) * ch * SWEEP), scaled_w=w, scaled_h=h, tall=narrow, panel_scale=scale,
            split_columns=F.when(split, SPLIT_COLUMNS).otherwise(0), zoom_strength=F.when(shown == "static", 0.0).otherwise(pushed),
        )
    else:
        force = damping(segment["match_score"]) * max(0.0, float(strength))
        cover = F.least(F.greatest(F.lit(cw) / width, F.lit(ch) / height), F.lit(LARGEST))
        wish = lambda d, frame, size: F.abs(segment[d] / frame * size * force)
        room = lambda n, size: F.greatest(F.lit(0), n - size - 2)
        w0, h0 = F.ceil(width * cover), F.ceil(height * cover)
        along = lambda w, h: (F.bround(F.least(wish("dx", FRAME[0], cw), room(w, cw))), F.bround(F.least(wish("dy", FRAME[1], ch), room(h, ch))))
        x0, y0 = along(w0, h0)
        short = F.when(kind.isin("pan_down", "pan_up"), y0 <= 2).when(kind.isin("pan_right", "pan_left"), x0 <= 2).otherwise(False)
        hold = F.when(segment["zoom"] >= 1.1, "zoom_in").when(segment["zoom"] <= 0.95, "zoom_out").otherwise("static")
        shown = F.when(short, hold).otherwise(kind)
        # A pan that zooms in too is a little closer, and may go further.
        closer = F.when(shown.startswith("pan_") & (segment["zoom"] >= 1.1), 1.0 + F.least(F.lit(0.25), (segment["zoom"] - 1.0) * 0.5)).otherwise(1.0)
        w, h = F.ceil(w0 * closer), F.ceil(h0 * closer)
        out = moved(shown, *along(w, h), scaled_w=w.cast("int"), scaled_h=h.cast("int"), tall=F.lit(False), panel_scale=F.lit(1.0), split_columns=F.lit(0), zoom_strength=pushed)
    return F.when((width > 0) & (height > 0), out)
