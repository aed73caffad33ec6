"""Panel validation: rule columns, verdicts, duplicates, calibration, decisions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.functions import text as X
from panelframe.operators.ranks import numbered, percentiles, top
from panelframe.operators.tables import settled

# Geometry and content limits of a verdict.
MIN_HEIGHT, MIN_AREA, THIN_SHARE, TALL_ASPECT = 24, 900, 0.015, 6.0
BLANK_VARIANCE, BLANK_EDGE, BLANK_FOREGROUND = 4.0, 9.0, 0.02
# Calibration of a session and its decisions.
FEWEST, FIXED_COLOR, FIXED_WHITE, EDGE_FLOOR = 6, 0.05, 0.80, 0.003
BW_MEDIAN, IQR_FACTOR, COLOR_CAP, WHITE_PERCENT = 0.02, 1.5, 0.15, 0.65
BLANK_SCORE, UNIFORM, TWO_TONE, RESCUED = 0.70, 0.92, 0.88, 3
# Bands that near hashes have to agree in, at most.
MOST_AGREEING = 3
# The kinds of panel that a plan may name.
KINDS = ["single", "tall_scenic", "transition_gutter", "multi_sub_panel", "unknown"]


def rules(**broken: Column) -> Column:
    """array of the names of the rules that are broken."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))


def plan_problems(entries: DataFrame) -> DataFrame:
    """entries(strip, idx, y0, y1, height, kind) with problems: degenerate or overrunning ranges, unknown kinds, order, gaps in numbering.

    Where entries have a confidence, it has to be within 0 and 1; where they have context_only and blank_flag, a panel that
    is kept as context is not blank.
    """
    w = Window.partitionBy("strip").orderBy("idx")
    more = {}
    if "confidence" in entries.columns:
        more["confidence_bounds"] = ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    if {"context_only", "blank_flag"} <= set(entries.columns):
        more["blank_context"] = F.coalesce(F.col("context_only") & (F.col("blank_flag") == "blank"), F.lit(False))
    return entries.withColumn(
        "problems",
        rules(
            degenerate=F.col("y0") >= F.col("y1"),
            out_of_strip=(F.col("y0") < 0) | (F.col("y1") > F.col("height")),
            unknown_kind=~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
            not_monotonic=F.coalesce(F.col("y0") < F.lag("y0").over(w), F.lit(False)),
            not_contiguous=F.col("idx") != F.row_number().over(w),
            **more,
        ),
    )


def verdict(height: Column, width: Column, strip_height: Column, variance: Column, edge: Column, foreground: Column) -> Column:
    """struct(quality, reasons): invalid, suspicious or normal, by size first and content next."""
    flat = sum((F.when(c, 1).otherwise(0) for c in (variance < BLANK_VARIANCE, edge < BLANK_EDGE, foreground < BLANK_FOREGROUND)), F.lit(0))
    invalid = F.when(height < MIN_HEIGHT, "thin").when(height * width < MIN_AREA, "tiny")
    thin, tall = height < THIN_SHARE * strip_height, height / F.greatest(F.lit(1), width) > TALL_ASPECT
    reasons = F.when(invalid.isNotNull(), F.array(invalid)).otherwise(rules(thin_in_strip=thin, very_tall=tall, no_content=flat >= 3, mostly_blank=flat == 2))
    quality = F.when(invalid.isNotNull() | (flat >= 3), "invalid").when(thin | tall | (flat == 2), "suspicious").otherwise("normal")
    return F.struct(quality.alias("quality"), reasons.alias("reasons"))


def verdict_counts(verdicts: DataFrame, key: str) -> DataFrame:
    q = F.col("quality")
    return verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("detected"), F.count_if(q == "normal").alias("accepted"), F.count_if(q == "suspicious").alias("suspicious"), F.count_if(q == "invalid").alias("rejected"))


def _agreeing(most: int, agree: int) -> list[int]:
    """Masks of 64 bits cut into most + agree bands, one for each choice of `agree` of these."""
    bands = most + agree
    edge = [64 * k // bands for k in range(bands + 1)]
    band = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(bands)]
    masks = [sum(chosen) for chosen in itertools.combinations(band, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_hashes(panels: DataFrame, most: int = 6, valid: Column | None = None, agree: int | None = None) -> DataFrame:
    """panels(id, hash) with the first earlier panel whose 64-bit hash differs in at most `most` bits; only valid panels count.

    Two such hashes agree in `agree` of most + agree bands at least, so each choice of that many bands is a
    join key: no pair is missed and no cross join is needed.  More bands to agree on mean longer, rarer
    keys; unless given, there are so many that a key has as many values as there are hashes, but at most MOST_AGREEING:
    a hash is 84 rows then, and beyond some two million hashes more of them meet by chance.  Keys that one hash
    alone has go before the hashes meet; each hash meets the earliest of its keys first, and others only where that one is
    not near and they would come before what is found.  Equal hashes are one node: many copies meet once.
    No table here is of a fixed size, so none is broadcast: keys take a tenth of their memory as files, by which Spark would choose.
    """
    used = panels.withColumn("_valid", F.coalesce(F.lit(True) if valid is None else valid, F.lit(False)))
    groups = used.where("_valid").groupBy("hash").agg(F.min("id").alias("first"))
    if agree is None:
        count = max(groups.count(), 2)
        agree = next((k for k in range(1, MOST_AGREEING) if 64 * k // (most + k) >= math.log2(count)), MOST_AGREEING)
    masks = F.array(*[F.lit(m).cast("long") for m in _agreeing(most, agree)])
    cut = groups.withColumn("mask", F.explode(masks)).withColumn("bits", F.col("hash").bitwiseAND(F.col("mask")))
    # The earliest hash of each key, where there are others.
    tops = cut.groupBy("mask", "bits").agg(F.min(F.struct("first", "hash")).alias("_t"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("mask", "bits", F.col("_t.first").alias("t_first"), F.col("_t.hash").alias("t_hash"))
    cut = settled(cut.join(tops.hint("merge"), ["mask", "bits"]))
    close = lambda other: F.bit_count(F.col("hash").bitwiseXOR(F.col(other))) <= most
    best = cut.where((F.col("t_hash") != F.col("hash")) & close("t_hash")).groupBy("hash").agg(F.min("t_first").alias("best"))
    # Only what is earlier than the hash itself and than the best so far counts, and a key whose earliest is near has no such.
    open_ = cut.join(best.hint("merge"), "hash", "left").withColumn("limit", F.least("first", "best")).where((F.col("t_first") < F.col("limit")) & ~close("t_hash"))
    other = cut.select("mask", "bits", F.col("hash").alias("o_hash"), F.col("first").alias("o_first"))
    near = open_.join(other.hint("merge"), ["mask", "bits"]).where((F.col("o_first") < F.col("limit")) & close("o_hash"))
    least = best.select("hash", F.col("best").alias("_b")).unionByName(near.select("hash", F.col("o_first").alias("_b"))).groupBy("hash").agg(F.min("_b").alias("other"))
    out = used.join(groups.hint("merge"), "hash", "left").join(least.hint("merge"), "hash", "left")
    earlier = lambda c: F.when(F.col("_valid") & (F.col(c) < F.col("id")), F.col(c))
    return out.select("id", F.least(earlier("first"), earlier("other")).alias("duplicate_of"))


def effective(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows that survive review: deleted ones go, kept ones stay, else invalid ones go. decisions: (key, decision, quality)."""
    seen = rows.join(decisions, key, "left")
    stay = F.when(F.col("decision") == "delete", False).when(F.col("decision") == "keep", True).otherwise(F.coalesce(F.col("quality") != "invalid", F.lit(True)))
    return seen.where(stay)


def calibrate(scores: DataFrame, key: str) -> DataFrame:
    """Thresholds of each session from its own scores(color, white): fixed below FEWEST panels, else by quartile fence and percentile."""
    # Written narrow, so that what the scores are made of is read once.
    narrow = settled(scores.select(key, "color", "white"))
    colours = percentiles(narrow, key, "color", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    whites = percentiles(narrow, key, "white", {"w": WHITE_PERCENT}).drop("n").withColumnRenamed(key, "_key")
    s = colours.join(whites, colours[key].eqNullSafe(whites["_key"])).drop("_key")
    few, bw = F.col("n") < FEWEST, F.col("median") < BW_MEDIAN
    fence = F.least(F.greatest(F.lit(0.0), F.col("q1") - IQR_FACTOR * (F.col("q3") - F.col("q1"))), F.lit(COLOR_CAP))
    return s.select(
        key, "n", F.when(few, "fixed").otherwise("adaptive").alias("method"), F.when(few | bw, FIXED_COLOR).otherwise(F.round(fence, 5)).alias("color_below"),
        F.when(few, FIXED_WHITE).otherwise(F.round(F.least(F.col("w") + 0.04, F.lit(0.97)), 5)).alias("white_above"), F.lit(EDGE_FLOOR).alias("edge_above"), (~few & bw).alias("bw"),
    )


def decide(rows: DataFrame, thresholds: DataFrame, key: str, is_promo: Callable[[Column], Column] = X.is_promo) -> DataFrame:
    """rows with their decision, in this order: confirmed, blank, promotion, unscorable, text only, lone bubble, keep."""
    c = F.col
    flag = F.lower(F.coalesce(F.nullif(c("blank_flag"), F.lit("")), F.lit("normal")))
    blank = (flag == "blank") | ((flag == "normal") & F.coalesce(c("blank_score") >= BLANK_SCORE, F.lit(False)))
    said = X.strip(X.text(c("dialogue"))) != ""
    text_kind = F.lower(X.text(c("panel_type"))).isin("transition_gutter", "unknown")
    text_only = (said | text_kind) & ((c("uniform") >= UNIFORM) | ((c("bw") | (c("color") < c("color_below"))) & (c("white") > c("white_above")) & (c("edge") > c("edge_above"))))
    bubble = (said | text_kind | (X.strip(X.text(c("narration"))) != "")) & (c("two_tone") >= TWO_TONE) & (c("bw") | (c("color") <= c("color_below"))) & (c("edge") >= c("edge_above"))
    decision = (
        F.when(c("confirmed"), "keep")
        .when(blank, "blank")
        .when(is_promo(c("dialogue")) | is_promo(c("narration")), "context_only")
        .when(c("color").isNull(), "keep")
        .when(text_only, "context_only")
        .when(bubble, "context_only")
        .otherwise("keep")
    )
    return rows.join(thresholds.drop("n"), key).withColumn("decision", decision)


def rescue(decided: DataFrame, key: str, order: str) -> DataFrame:
    """decided, with the least blank rows kept where a session would keep none. Rows of a session are told apart by `order`.

    The rows are written once, as they are read thrice: without their texts, best.
    """
    decided = settled(decided)
    sessions = decided.groupBy(key).agg((F.count_if(F.col("decision") == "keep") == 0).alias("_none"), (F.count_if(F.col("decision") != "blank") > 0).alias("_present"))
    pool = decided.join(sessions.where("_none"), key).where(~F.col("_present") | (F.col("decision") != "blank"))
    kept = top(pool, [key], [F.coalesce("blank_score", F.lit(0.5)), F.col(order)], RESCUED).select(key, order, F.lit(True).alias("_kept"))
    rows = decided.join(kept, [key, order], "left")
    return rows.select(*[F.when(F.col("_kept"), "keep_rescued").otherwise(F.col("decision")).alias(c) if c == "decision" else F.col(c) for c in decided.columns])


def renumber(rows: DataFrame, key: str, order: str) -> DataFrame:
    return numbered(rows, [key], [F.col(order)], "number")


def digest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A short hash of each session's decisions, whatever their order: of how many there are and of the sum of their hashes.

    The sum is made up in the tasks, so a session is never in one value.
    """
    line = F.concat_ws(":", *columns)
    part = F.conv(F.substring(F.sha1(line), 1, 15), 16, 10).cast("decimal(20,0)")
    s = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(part).alias("_s"))
    return s.select(key, F.substring(F.sha1(F.concat_ws(":", "_n", F.col("_s").cast("string"))), 1, 12).alias("hash"))


def low_confidence(entries: DataFrame, plans: DataFrame, key: str, below: float = 0.5, most: float = 0.30) -> DataFrame:
    """plans with the share of entries of low confidence (1.0 without entries) and whether to fall back."""
    share = entries.groupBy(key).agg(F.avg((F.col("confidence") < below).cast("double")).alias("low"))
    return plans.join(share, key, "left").withColumn("low", F.coalesce("low", F.lit(1.0))).withColumn("fallback", F.col("low") > most)


def review_list(rows: DataFrame, below: float = 0.6) -> DataFrame:
    """Rows of low confidence; none or zero counts as certain."""
    sure = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("confidence", sure).where(F.col("confidence") < below)


def identity(current: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """(key, status): match, mismatch, or unverifiable without a planned hash."""
    status = F.when(F.coalesce(F.col("planned"), F.lit("")) == "", "unverifiable").when(F.col("planned") == F.col("hash"), "match").otherwise("mismatch")
    return current.join(planned, key, "left").select(key, status.alias("status"))


def coverage(entries: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Whether the last entry of each strip reaches far enough down: entries(key, y1, height)."""
    share = F.max("y1") / F.max("height")
    return entries.groupBy(key).agg(F.round(share, 6).alias("reach"), (share < least).alias("short"))
