"""Story memory that fits a prompt, loose values brought to one type, overlays of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.operators.ranks import top

# How many entities each step of the ladder shows, and after how many panels one is stale.
LADDER, STALE = [10, 6, 4, 2, 1], 60
# How many characters, places, threads and events each step shows, and what the block says around them.
STEPS = [(10, 5, 5, 3), (6, 3, 4, 2), (4, 2, 3, 1), (2, 1, 2, 0), (1, 0, 1, 0), (1, 0, 5, 0), (1, 0, 2, 0), (1, 0, 1, 0), (0, 0, 1, 0)]
TITLES = {"character": "Characters:", "place": "Locations:", "thread": "Ongoing threads:", "event": "Recent events:"}
FOOTER = "If you recognise any of these characters or locations, refer to them by their established name and maintain continuity (do not introduce them as new).\n[/STORY MEMORY]"
SHOWN_TEXT, SHOWN_ALIASES = 100, 3


def ranked_entities(roster: DataFrame, now: Column) -> DataFrame:
    """roster(series, name, last_seen) with its rank: fresh ones, then those not yet seen, then stale ones; newest first."""
    seen = F.coalesce("last_seen", F.lit(0))
    klass = F.when(seen == 0, 1).when(now - seen > STALE, 2).otherwise(0)
    w = Window.partitionBy("series").orderBy(klass, F.desc(seen), "name")
    return roster.withColumn("rank", F.row_number().over(w).cast("long"))


def fitting_memory(ranked: DataFrame, line: Column, budget: int) -> DataFrame:
    """(series, shown, block): the lines of the most entities on the ladder whose block fits the budget; the last step if none does."""
    rows = ranked.where(F.col("rank") <= LADDER[0]).withColumn("_line", line)
    lengths = [F.coalesce(F.sum(F.when(F.col("rank") <= n, F.length("_line") + 1)), F.lit(0)) for n in LADDER]
    level = F.coalesce(*[F.when(c <= budget, n) for c, n in zip(lengths, LADDER)], F.lit(LADDER[-1]))
    lines = F.array_sort(F.collect_list(F.struct("rank", "_line")))
    s = rows.groupBy("series").agg(level.cast("int").alias("level"), lines.alias("_l"))
    kept = F.transform(F.filter("_l", lambda x: x["rank"] <= F.col("level")), lambda x: x["_line"])
    return s.select("series", F.size(kept).cast("long").alias("shown"), F.array_join(kept, "\n").alias("block"))


def memory_block(entries: DataFrame, now: Column, budget: int = 1200) -> DataFrame:
    """(series, step, block): what a series remembers, as text, by the first of STEPS whose block fits the budget, the last one if none does.

    entries as of story.story; now is the panel that asks.  Characters come fresh ones first, then those not seen yet,
    then stale ones, each newest first; places newest first, active threads and events latest first.  A series without
    characters, places and active threads has no block.  Every task passes on no more than the largest step shows.
    """
    c = F.col
    seen, kind = F.coalesce(c("last_seen"), F.lit(0)), c("kind")
    klass = F.when(kind == "character", F.when(seen == 0, 1).when(now - seen > STALE, 2).otherwise(0)).otherwise(0)
    lately = F.when(kind.isin("character", "place"), -seen).otherwise(-c("pos"))
    short = F.substring(F.coalesce("description", F.lit("")), 1, SHOWN_TEXT)
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    also = F.when(F.size(known) > 0, F.concat(F.lit(" (also: "), F.array_join(F.slice(known, 1, SHOWN_ALIASES), ", "), F.lit(")"))).otherwise("")
    panel = seen.cast("string")
    tag = F.when(seen <= 0, "(pre-read cast, not yet seen)").when(now - seen > STALE, F.concat(F.lit("[last seen panel "), panel, F.lit("]"))).otherwise(F.concat(F.lit("(panel "), panel, F.lit(")")))
    line = (
        F.when(kind == "character", F.concat(F.lit("  - "), "name", also, F.lit(" ["), F.coalesce("role", F.lit("?")), F.lit("]"), tag, F.lit(": "), short, F.lit(".")))
        .when(kind == "place", F.concat(F.lit("  - "), "name", F.lit(" (panel "), panel, F.lit("): "), short))
        .when(kind == "thread", F.concat(F.lit("  - "), F.coalesce("description", F.lit(""))))
        .otherwise(F.concat(F.lit("  - panel "), F.coalesce(c("first_seen").cast("string"), F.lit("?")), F.lit(": "), short))
    )
    rows = entries.where((kind != "thread") | (c("status") == "active")).withColumn("_now", now).withColumn("_line", line).withColumn("_at", F.struct(klass.alias("k"), lately.alias("l"), c("pos").alias("p")))
    most = [max(s[k] for s in STEPS) for k in range(4)]
    kept = top(rows, ["series", "kind"], [c("_at")], max(most))
    listed = kept.groupBy("series").agg(F.max("_now").alias("_now"), *[F.array_sort(F.collect_list(F.when(kind == k, F.struct("_at", "_line")))).alias(k) for k in TITLES])
    listed = listed.where((F.size("character") > 0) | (F.size("place") > 0) | (F.size("thread") > 0))

    def block(step: tuple) -> Column:
        part = lambda k, n: F.when((F.size(k) > 0) & F.lit(n > 0), F.concat(F.lit(f"{TITLES[k]}\n"), F.array_join(F.transform(F.slice(k, 1, max(n, 1)), lambda x: x["_line"]), "\n")))
        sections = F.array_compact(F.array(*[part(k, n) for k, n in zip(TITLES, step)]))
        return F.concat(F.lit("[STORY MEMORY -- panel "), F.col("_now").cast("string"), F.lit("]\n"), F.array_join(sections, "\n"), F.lit(f"\n{FOOTER}"))

    made = F.array(*[F.struct(F.lit(k + 1).alias("step"), block(s).alias("block")) for k, s in enumerate(STEPS)])
    chosen = F.coalesce(F.get(F.filter("_made", lambda m: F.length(m["block"]) <= budget), F.lit(0)), F.element_at("_made", -1))
    return listed.withColumn("_made", made).select("series", chosen.alias("_c")).select("series", "_c.step", "_c.block")


def as_strings(json: Column) -> Column:
    """The texts of a JSON value: those of an array, or the value itself; other types go."""
    v = F.try_parse_json(json)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.transform(F.filter(items, lambda e: F.schema_of_variant(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string"))


def box(json: Column) -> Column:
    """struct(x, y, w, h) of a box given as x/y/w/h, or as corners x0/y0/x1/y1, named or listed; null if it has no area."""
    v = F.try_parse_json(json)
    n = lambda path: F.try_variant_get(v, path, "double")
    x, y = F.coalesce(n("$.x"), n("$.x0"), n("$[0]")), F.coalesce(n("$.y"), n("$.y0"), n("$[1]"))
    w = F.coalesce(n("$.w"), n("$.x1") - n("$.x0"), n("$[2]") - n("$[0]"))
    h = F.coalesce(n("$.h"), n("$.y1") - n("$.y0"), n("$[3]") - n("$[1]"))
    whole = lambda c: c.cast("int")
    return F.when((w > 0) & (h > 0) & x.isNotNull() & y.isNotNull() & n("$[4]").isNull(), F.struct(whole(x).alias("x"), whole(y).alias("y"), whole(w).alias("w"), whole(h).alias("h")))


def overlaid(base: Column, *layers: Column, limits: dict[str, tuple[float, float]] | None = None) -> Column:
    """Maps laid over a base map in order; fields that the base lacks go, limited ones are clamped."""
    out = base
    for layer in layers:
        out = F.map_zip_with(out, layer, lambda k, b, o: F.when(b.isNotNull(), F.coalesce(o, b)))
    out = F.map_filter(out, lambda k, v: v.isNotNull())

    def clamp(k: Column, v: Column) -> Column:
        for name, (low, high) in (limits or {}).items():
            v = F.when(k == name, F.least(F.greatest(v, F.lit(low)), F.lit(high))).otherwise(v)
        return v

    return F.transform_values(out, clamp)


def merged_panel(panels: DataFrame, groups: DataFrame) -> DataFrame:
    """Panels(strip, id, y0, y1, confidence) with each group(strip, id, into) as one: joined range, least confidence; others as they are."""
    rows = panels.join(groups, ["strip", "id"], "left").withColumn("id", F.coalesce("into", "id"))
    return rows.groupBy("strip", "id").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("parts"))


def split_panel(panels: DataFrame, splits: DataFrame) -> DataFrame:
    """Panels(strip, id, y0, y1) with those of splits(strip, id, fraction) as two, named a and b."""
    rows = panels.join(splits, ["strip", "id"], "left")
    cut = F.col("y0") + F.bround((F.col("y1") - F.col("y0")) * F.col("fraction")).cast("long")
    part = lambda name, a, b: F.struct(F.concat(F.col("id").cast("string"), F.lit(name)).alias("id"), a.alias("y0"), b.alias("y1"))
    whole = F.array(part("", F.col("y0"), F.col("y1")))
    two = F.array(part("a", F.col("y0"), cut), part("b", cut, F.col("y1")))
    return rows.select("strip", F.explode(F.when(F.col("fraction").isNull(), whole).otherwise(two)).alias("p")).select("strip", "p.*")


def carried_forward(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """(series, chapter, kind, name, first_seen, last_seen): what each chapter starts with.

    entries(series, chapter, kind, name) of all chapters, chapters(series, chapter).  Whatever an earlier chapter
    of the series brought in is kept, characters, places and threads alike, but for events; panel numbers
    are a chapter's own, so the counters start at 0.
    """
    first = entries.where("kind <> 'event'").groupBy("series", "kind", "name").agg(F.min("chapter").alias("_from"))
    rows = chapters.select("series", "chapter").distinct().join(first, "series").where("chapter > _from")
    return rows.select("series", "chapter", "kind", "name", F.lit(0).alias("first_seen"), F.lit(0).alias("last_seen"))
