"""Row metrics of images, and the blank-region, margin and colour rules on them.

Images are decoded by Spark's image source and turned into one row of numbers per pixel row in Arrow
batches; all rules after that are expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.operators.intervals import overlapping, runs

# Thresholds of the blank score and its weights.
WINDOW = 16
MAX_VARIANCE, MAX_EDGE, MAX_ENTROPY, MAX_SPREAD, MIN_FOREGROUND = 12.0, 6.0, 2.2, 14.0, 0.02
WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.15)
MERGE_GAP, MIN_SHARE, MIN_PIXELS, GUTTER_SHARE = 2, 0.04, 24, 0.10
BLANK, SUSPICIOUS, CONTENT_FOREGROUND, CONTENT_SHARE, MAX_DRIFT = 0.90, 0.65, 0.05, 0.02, 10.0
WHITE, DARK, COLOUR_GAP = 215, 25, 25

# Weights of a row's neighbours in the 3 x 3 blur of sigma 0.5.
BLUR = 0.5
BINS = 64

ROW = (
    "strip string, y int, mean double, variance double, edge double, mono double, level double, span double, foreground double, white double, dark double, saturated double, "
    "entropy double, flat boolean, plain_variance double, plain_edge double, spread double, histogram array<int>"
)


def _framed(plane: np.ndarray) -> np.ndarray:
    """plane with one more row and column on each side, mirrored about the outermost ones."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (1, 1)
        plane = np.pad(plane, pad, "reflect" if plane.shape[axis] > 1 else "edge")
    return plane


def blurred(gray: np.ndarray, sigma: float = BLUR) -> np.ndarray:
    """A 3 x 3 Gaussian blur, in whole grey levels."""
    side = np.exp(-1 / (2 * sigma * sigma))
    k = np.array([side, 1, side]) / (1 + 2 * side)
    p = _framed(gray)
    rows = k[0] * p[:-2] + k[1] * p[1:-1] + k[2] * p[2:]
    return np.rint(k[0] * rows[:, :-2] + k[1] * rows[:, 1:-1] + k[2] * rows[:, 2:])


def sobel_x(gray: np.ndarray) -> np.ndarray:
    """Horizontal edges by the 3 x 3 Sobel kernel."""
    p = _framed(gray)
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    return down[:, 2:] - down[:, :-2]


def entropy_of(counts: np.ndarray) -> np.ndarray:
    """Bits, along the last axis of counts."""
    share = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(-1)


def _spreads(colour: np.ndarray, size: int) -> np.ndarray:
    """For each row, how far the pixels of its window lie from the window's median colour: the deviation of the distances."""
    out = np.zeros(len(colour))
    for y in range(0, len(colour), size):
        block = colour[y : y + size].reshape(-1, colour.shape[-1])
        out[y : y + size] = np.sqrt(((block - np.median(block, axis=0)) ** 2).sum(1)).std()
    return out


def row_metrics(images: DataFrame) -> DataFrame:
    """A row of metrics for each pixel row of spark.read.format('image') rows; strip is the image's origin.

    variance and edge are those of the blurred grey levels, as the cuts need them; plain_variance and plain_edge
    those of the levels themselves, as the blank score does. spread is that of the row's window of WINDOW rows.
    """

    def one(origin: str, px: np.ndarray):
        import pandas as pd

        h, w, c = px.shape
        colour = px[..., : min(c, 3)]
        blue, green, red = (px[..., min(k, c - 1)] for k in range(3))
        exact = 0.114 * blue + 0.587 * green + 0.299 * red
        gray = np.rint(exact)
        soft = blurred(gray)
        level = np.median(gray, axis=1)
        away = np.abs(gray - level[:, None])
        bins = np.stack([np.bincount(r, minlength=BINS) for r in (gray // (256 // BINS)).astype(int)])
        gap, span = colour.max(-1) - colour.min(-1), gray.max(1) - gray.min(1)
        share = lambda hit: hit.mean(1)
        columns = {
            "strip": origin, "y": np.arange(h), "mean": exact.mean(1), "variance": soft.var(1), "edge": np.abs(sobel_x(soft)).mean(1), "mono": share(away <= 8), "level": level, "span": span,
            "foreground": share(away > 28), "white": share(colour.min(-1) > WHITE), "dark": share(colour.max(-1) < DARK), "saturated": share(gap > COLOUR_GAP), "entropy": entropy_of(bins), "flat": span <= 12,
            "plain_variance": gray.var(1), "plain_edge": np.abs(sobel_x(gray)).mean(1), "spread": _spreads(colour, WINDOW), "histogram": [*bins.astype(np.int32)],
        }
        return pd.DataFrame(columns)

    def decode(batches):
        for pdf in batches:
            for origin, h, w, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                yield one(origin, np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64))

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(decode, ROW)


def background(rows: DataFrame, margin: int = 12) -> DataFrame:
    """(strip, background): the median level of flat rows at the ends, else the commonest level of single-colour rows, else of all."""
    last = F.max("y").over(Window.partitionBy("strip"))
    r = rows.withColumn("_edge", (F.col("y") < margin) | (F.col("y") > last - margin))
    end = F.percentile(F.when(F.col("_edge") & F.col("flat"), F.col("level")), F.lit(0.5))
    common = F.mode(F.when(F.col("mono") >= 0.9, F.round("level")), deterministic=True)
    return r.groupBy("strip").agg(F.coalesce(end, common, F.mode(F.round("level"), deterministic=True)).alias("background"))


def _array_entropy(counts: Column) -> Column:
    """Bits of a histogram in one array: an expression as small as the array is long."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    term = lambda n: F.when(n > 0, -n / total * F.log2(n / total)).otherwise(0.0)
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + term(n))


def _summed(histogram: Column) -> list[Column]:
    """The sums of a group's histograms, bin by bin."""
    return [F.coalesce(F.sum(F.get(histogram, F.lit(b))), F.lit(0)) for b in range(BINS)]


def windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """The signals of windows of rows: means, the entropy of the window's own histogram, and what a coarser look needs.

    That are, of every second row, the mean level, the mean square and the histogram.  Rows that fill no
    whole window are left out, unless there is no other window.
    """
    w = F.floor(F.col("y") / size).alias("w")
    half = (F.col("y") % size) % 2 == 0
    levels = {"variance": "plain_variance", "edge": "plain_edge", "spread": "spread", "foreground": "foreground", "mean": "mean"}
    means = [F.avg(c).alias(n) for n, c in levels.items()]
    coarse = F.array(*_summed(F.when(half, F.col("histogram"))))
    square = F.avg(F.when(half, F.col("plain_variance") + F.col("mean") * F.col("mean")))
    out = rows.groupBy("strip", w).agg(*means, F.array(*_summed(F.col("histogram"))).alias("_h"), F.avg(F.when(half, F.col("mean"))).alias("coarse_mean"), square.alias("coarse_square"), coarse.alias("coarse"), F.count(F.lit(1)).alias("_n"))
    out = out.withColumn("entropy", _array_entropy(F.col("_h"))).drop("_h")
    return out.where((F.col("_n") == size) | (F.col("w") == 0)).drop("_n")


def blank_score(variance: Column, edge: Column, entropy: Column, spread: Column, foreground: Column) -> Column:
    """0 to 1: the weighted shares by which each signal is under its threshold."""
    under = lambda v, t: F.least(F.greatest(1.0 - v / t, F.lit(0.0)), F.lit(1.0))
    signals = ((variance, MAX_VARIANCE), (edge, MAX_EDGE), (entropy, MAX_ENTROPY), (spread, MAX_SPREAD), (foreground, MIN_FOREGROUND * 10))
    return sum((F.lit(w) * under(v, t) for w, (v, t) in zip(WEIGHTS, signals)), F.lit(0.0))


# Presets of (least share of the height, score of a blank, foreground that counts as content).
PRESETS = {"low": (0.08, 0.95, 0.03), "conservative": (MIN_SHARE, BLANK, CONTENT_FOREGROUND), "high": (0.025, 0.82, 0.07)}


def blank_regions(windowed: DataFrame, heights: DataFrame, size: int = WINDOW, preset: str = "conservative", whole: Callable[[Column], Column] = lambda c: c.cast("int")) -> DataFrame:
    """(strip, y0, y1, score, verdict, reasons): runs of empty windows, up to MERGE_GAP noisy ones within, tall enough and no gutters.

    The last run ends at the last window if the noisy windows after it are within the gap.  A run that shows
    structure in every second row taken together, as a change from window to window does, has half its score.
    whole makes the least height, a share of the strip's, whole rows: cut off unless given.
    """
    least_share, least_score, least_content = PRESETS[preset]
    empty = (F.col("variance") <= MAX_VARIANCE) & (F.col("edge") <= MAX_EDGE) & (F.col("entropy") <= MAX_ENTROPY)
    w = Window.partitionBy("strip").orderBy("w")
    on = windowed.withColumn("_last", F.max("w").over(Window.partitionBy("strip"))).where(empty)
    started = F.coalesce((F.col("w") - F.lag("w").over(w) > MERGE_GAP + 1).cast("int"), F.lit(1))
    spans = on.withColumn("_new", started).withColumn("run", F.sum("_new").over(w)).groupBy("strip", "run").agg(F.min("w").alias("w0"), F.max("w").alias("_end"), F.first("_last").alias("_last"))
    spans = spans.withColumn("w1", F.when(F.col("_last") - F.col("_end") <= MERGE_GAP, F.col("_last")).otherwise(F.col("_end")))
    # Runs and windows of a strip meet by cells of windows.
    near = overlapping(spans.withColumn("_r1", F.col("w1") + 1), windowed.withColumn("_w1", F.col("w") + 1), "strip", ("w0", "_r1"), ("w", "_w1"))
    mean = lambda c: F.avg(c).alias(c)
    coarse = F.array(*_summed(F.col("coarse")))
    agg = near.groupBy("strip", "w0", "w1").agg(
        *map(mean, ["variance", "edge", "entropy", "spread", "foreground", "coarse_mean", "coarse_square"]), coarse.alias("_h"), (F.max("mean") - F.min("mean")).alias("drift"), F.avg((F.col("foreground") >= least_content).cast("double")).alias("content")
    )
    r = agg.join(heights, "strip").withColumn("y0", F.col("w0") * size).withColumn("y1", F.least((F.col("w1") + 1) * size, F.col("height")))
    tall = F.col("y1") - F.col("y0")
    least_tall = F.greatest(F.lit(MIN_PIXELS), whole(F.col("height") * least_share))
    r = r.where(tall >= least_tall)
    plain = blank_score(F.col("variance"), F.col("edge"), F.col("entropy"), F.col("spread"), F.col("foreground"))
    structure = (F.col("coarse_square") - F.col("coarse_mean") * F.col("coarse_mean") > 2 * MAX_VARIANCE) | (_array_entropy(F.col("_h")) > MAX_ENTROPY)
    r = r.withColumn("_plain", plain).withColumn("_veto", (F.col("_plain") >= SUSPICIOUS) & structure)
    r = r.withColumn("score", F.when(F.col("_veto"), F.col("_plain") / 2).otherwise(F.col("_plain")))
    blank = (F.col("score") >= least_score) & (F.col("content") < CONTENT_SHARE) & (F.col("drift") <= MAX_DRIFT)
    r = r.withColumn("verdict", F.when(blank, "blank").when(F.col("score") >= SUSPICIOUS, "suspicious").otherwise("normal"))
    said = [
        (F.col("variance") <= MAX_VARIANCE, F.lit("low variance")), (F.col("edge") <= MAX_EDGE, F.lit("low edge density")), (F.col("entropy") <= MAX_ENTROPY, F.lit("low entropy")),
        (F.col("spread") <= MAX_SPREAD, F.lit("low colour spread")), (F.col("foreground") < MIN_FOREGROUND, F.lit("low foreground occupancy")),
        (F.col("content") >= CONTENT_SHARE, F.lit("sparse content")), (F.col("_veto"), F.lit("structure at coarse scale")),
        (F.col("verdict") == "blank", F.format_string("height %d of at least %d", tall.cast("int"), least_tall)), (F.col("drift") > MAX_DRIFT, F.lit("row means drift")),
    ]
    r = r.withColumn("reasons", F.array_compact(F.array(*[F.when(c, text) for c, text in said])))
    gutter = tall <= (F.col("height") * GUTTER_SHARE).cast("int")
    return r.where((F.col("verdict") != "normal") & ~((F.col("verdict") == "blank") & gutter)).select("strip", F.col("y0").cast("long"), F.col("y1").cast("long"), F.round("score", 3).alias("score"), "verdict", "reasons")


def trimmed(rows: DataFrame, most: float = 0.25, keep: int = 64, least: int = 8) -> DataFrame:
    """(strip, top, bottom): each image without its flat margins: at most a share per side, enough kept, tiny trims left alone."""
    s = rows.groupBy("strip").agg(F.min(F.when(~F.col("flat"), F.col("y"))).alias("a"), F.max(F.when(~F.col("flat"), F.col("y"))).alias("b"), (F.max("y") + 1).alias("h"))
    limit = F.floor(F.col("h") * most)
    top, foot = F.least(F.col("a"), limit), F.least(F.col("h") - 1 - F.col("b"), limit)
    kept = F.col("a").isNull() | (F.col("h") - top - foot < keep) | (top + foot < least)
    return s.select("strip", F.when(kept, 0).otherwise(top).cast("int").alias("top"), F.when(kept, F.col("h")).otherwise(F.col("h") - foot).cast("int").alias("bottom"))


def crop_scores(rows: DataFrame, crops: DataFrame) -> DataFrame:
    """crops(strip, id, y0, y1) with the mean metrics of their rows: differences of running sums at their ends, so no crop is scanned."""
    w = Window.partitionBy("strip").orderBy("y")
    names = ["variance", "edge", "white", "dark", "saturated", "foreground"]
    sums = rows.select("strip", (F.col("y") + 1).alias("y"), *[F.sum(n).over(w).alias(n) for n in names])
    low, high = (sums.select("strip", F.col("y").alias(e), *[F.col(n).alias(f"{n}_{e}") for n in names]) for e in ("y0", "y1"))
    out = crops.join(high, ["strip", "y1"], "left").join(low, ["strip", "y0"], "left")
    part = lambda n: ((F.col(f"{n}_y1") - F.coalesce(f"{n}_y0", F.lit(0.0))) / (F.col("y1") - F.col("y0"))).alias(n)
    scored = out.select("strip", "id", "y0", "y1", *map(part, names))
    method = F.when(F.col("variance").isNull(), "missing").otherwise("strip")
    return scored.withColumn("two_tone", F.col("white") + F.col("dark")).withColumn("method", method)


def text_band(rows: DataFrame, gap: int = 4) -> DataFrame:
    """(strip, lo, hi): the longest band of busy rows, small gaps within it allowed."""
    busy = rows.where(F.col("edge") > F.lit(8.0)).select("strip", "y")
    w = Window.partitionBy("strip").orderBy("y")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(1))
    bands = busy.withColumn("_n", new).withColumn("band", F.sum("_n").over(w)).groupBy("strip", "band").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return bands.groupBy("strip").agg(F.max_by(F.struct("lo", "hi"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("b")).select("strip", "b.*")


def gutter_rows(rows: DataFrame, least: float = 0.7) -> DataFrame:
    return runs(rows, ["strip"], "y", F.col("mono") >= least)


REGION = "strip string, id string, variance double, edge_density double, fg_ratio double, entropy double, height int, width int"


def _region(gray: np.ndarray, y0: int, y1: int) -> tuple:
    """(variance, edges, share of pixels far from the frame's median, entropy) of rows y0 to y1."""
    part = gray[max(0, y0) : max(0, y1)]
    if not part.size:
        return 0.0, 0.0, 0.0, 0.0
    thick = min(4, max(1, len(part) // 2))
    frame = [part[:thick], part[-thick:]] + ([part[:, :4], part[:, -4:]] if part.shape[1] >= 8 else [])
    border = np.median(np.concatenate([f.ravel() for f in frame]))
    counts = np.bincount((part // (256 // BINS)).astype(int).ravel(), minlength=BINS)
    return round(float(part.var()), 2), round(float(np.abs(sobel_x(part)).mean()), 2), round(float((np.abs(part - border) > 28).mean()), 4), round(float(entropy_of(counts)), 3)


def region_metrics(images: DataFrame, panels: DataFrame) -> DataFrame:
    """Content metrics of each of panels(strip, id, y0, y1) on its strip's image (see row_metrics for images); zeros outside of it."""

    def measure(batches):
        import pandas as pd

        for pdf in batches:
            for origin, h, w, c, data, regions in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], pdf["regions"]):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                gray = np.rint(px[..., : min(c, 3)] @ np.array([0.114, 0.587, 0.299][: min(c, 3)] if c > 1 else [1.0]))
                found = [(origin, r["id"], *_region(gray, r["y0"], r["y1"]), r["y1"] - r["y0"], w) for r in regions]
                yield pd.DataFrame(found, columns=[f.split()[0] for f in REGION.split(", ")])

    asked = panels.groupBy("strip").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("y0").cast("int").alias("y0"), F.col("y1").cast("int").alias("y1"))).alias("regions"))
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").join(asked.withColumnRenamed("strip", "origin"), "origin")
    return rows.mapInPandas(measure, REGION)


def black_padding(rows: DataFrame) -> DataFrame:
    """(strip, top, bottom): each image without the rows at its ends in which every pixel is dark; a wholly dark one stays whole."""
    lit = F.when(F.col("dark") < 1, F.col("y"))
    s = rows.groupBy("strip").agg(F.min(lit).alias("a"), F.max(lit).alias("b"), (F.max("y") + 1).alias("h"))
    return s.select("strip", F.coalesce("a", F.lit(0)).cast("int").alias("top"), F.coalesce(F.col("b") + 1, F.col("h")).cast("int").alias("bottom"))


def source_of_scores(panels: DataFrame, crops: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """panels(strip, id) with the scores `names` and their method: those of the strip's crop, else of the panel's own file without padding, else missing.

    crops(strip, id, y0, y1, ...) count if they have rows and scores; files(strip, id, ...) if they have scores.
    """
    usable = crops.where((F.col("y1") > F.col("y0")) & F.col(names[0]).isNotNull()).select("strip", "id", F.struct(*names).alias("_crop"))
    own = files.where(F.col(names[0]).isNotNull()).select("strip", "id", F.struct(*names).alias("_file"))
    rows = panels.join(usable, ["strip", "id"], "left").join(own, ["strip", "id"], "left")
    method = F.when(F.col("_crop").isNotNull(), "strip_crop").when(F.col("_file").isNotNull(), "padding_stripped").otherwise("missing")
    return rows.select("strip", "id", *(F.coalesce(F.col(f"_crop.{n}"), F.col(f"_file.{n}")).alias(n) for n in names), method.alias("method"))


# Luminance in thousandths of a level; what is dark, and how much of a line has to be.
LUMINANCE, BAR_LEVEL, BAR_SHARE = (299, 587, 114), 12, 0.95
PROFILE = "strip string, axis string, k int, dark double"
SHADES = "strip string, pixels long, red long, green long, blue long, light long, squares decimal(38,0), saturation double, shades array<struct<shade:int,n:long>>"


def _decoded(pdf):
    for origin, h, w, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
        px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.int64)
        # Spark has blue, green, red.
        yield origin, np.stack([px[..., min(k, c - 1)] for k in (2, 1, 0)] if c > 1 else [px[..., 0]] * 3, axis=-1)


def _light(colour: np.ndarray) -> np.ndarray:
    return colour @ np.array(LUMINANCE)


def line_profiles(images: DataFrame) -> DataFrame:
    """(strip, axis, k, dark): the share of dark pixels of each row and each column of spark.read.format('image') rows."""

    def measure(batches):
        import pandas as pd

        for pdf in batches:
            for origin, colour in _decoded(pdf):
                dark = _light(colour) < BAR_LEVEL * 1000
                for axis, share in (("row", dark.mean(1)), ("column", dark.mean(0))):
                    yield pd.DataFrame({"strip": origin, "axis": axis, "k": np.arange(len(share)), "dark": share})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(measure, PROFILE)


def bars(profiles: DataFrame) -> DataFrame:
    """(strip, top, bottom, left, right): how many lines at each edge of an image are all but wholly dark; a wholly dark image is all of them from each side."""
    s = profiles.groupBy("strip", "axis").agg(F.min(F.when(F.col("dark") <= BAR_SHARE, F.col("k"))).alias("a"), F.max(F.when(F.col("dark") <= BAR_SHARE, F.col("k"))).alias("b"), (F.max("k") + 1).alias("n"))
    of = lambda axis, c: F.max(F.when(F.col("axis") == axis, c)).cast("int")
    first, last = F.coalesce(F.col("a"), F.col("n")), F.coalesce(F.col("n") - 1 - F.col("b"), F.col("n"))
    return s.groupBy("strip").agg(of("row", first).alias("top"), of("row", last).alias("bottom"), of("column", first).alias("left"), of("column", last).alias("right"))


def shade_parts(images: DataFrame, rows: int = 256) -> DataFrame:
    """Sums and exact luminance histograms, in thousandths of a level, of every `rows` rows of each image: parts that add up."""

    def measure(batches):
        import pandas as pd

        names = [f.split()[0] for f in SHADES.split(", ")]
        for pdf in batches:
            for origin, colour in _decoded(pdf):
                made = []
                for y in range(0, len(colour), rows):
                    block = colour[y : y + rows]
                    light = _light(block)
                    most, least = block.max(-1), block.min(-1)
                    shade, n = np.unique(light, return_counts=True)
                    made.append((origin, light.size, *(int(block[..., k].sum()) for k in range(3)), int(light.sum()), Decimal(int((light**2).sum())), float(np.where(most > 0, (most - least) / np.maximum(most, 1), 0).sum()), [{"shade": int(a), "n": int(b)} for a, b in zip(shade, n)]))
                yield pd.DataFrame(made, columns=names)

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(measure, SHADES)


def colour_stats(parts: DataFrame) -> DataFrame:
    """(strip, red, green, blue, brightness, contrast, saturation, p5, p95) from shade_parts, whatever rows they are of.

    Means, deviation and percentiles (between neighbours in proportion) are those of all pixels: each part's histogram
    is added to the others shade by shade.
    """
    total = lambda c: F.sum(c)
    n = F.col("n")
    sums = parts.groupBy("strip").agg(total("pixels").alias("n"), *[total(c).alias(c) for c in ("red", "green", "blue", "light", "squares", "saturation")])
    mean = F.col("light") / n
    spread = F.sqrt(F.greatest((F.col("squares").cast("double") / n - mean * mean), F.lit(0.0))) / 1000
    shades = parts.select("strip", F.explode("shades").alias("s")).groupBy("strip", "s.shade").agg(F.sum("s.n").alias("m"))
    w = Window.partitionBy("strip").orderBy("shade")
    placed = shades.withColumn("_to", F.sum("m").over(w)).join(sums.select("strip", "n"), "strip")
    # The place of a percentile is between two pixels in order; each is of the first shade that reaches it.
    place = lambda p: (n - 1) * p / 100
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col("shade")))
    cuts = placed.groupBy("strip").agg(F.first("n").alias("_n"), *[at(F.floor(place(p)) if low else F.ceil(place(p))).alias(f"_{p}_{low}") for p in (5, 95) for low in (1, 0)])
    between = lambda p: (F.col(f"_{p}_1") + (F.col(f"_{p}_0") - F.col(f"_{p}_1")) * (place(p) - F.floor(place(p)))) / 1000
    out = sums.join(cuts.drop("_n"), "strip")
    return out.select("strip", *[F.round(F.col(c) / n, 1).alias(c) for c in ("red", "green", "blue")], F.round(mean / 1000, 1).alias("brightness"), F.round(spread, 1).alias("contrast"), F.round(F.col("saturation") / n, 3).alias("saturation"), F.round(between(5), 1).alias("p5"), F.round(between(95), 1).alias("p95"))
