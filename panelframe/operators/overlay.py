"""Edits over a baseline: decisions, orders, overrides, chains of sessions. A baseline is never changed; the newest edit wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelframe.operators.ranks import numbered
from panelframe.operators.tables import settled


def latest(edits: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The newest edit of each key, by seq."""
    rest = [c for c in edits.columns if c not in keys]
    return edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_e")).select(*keys, "_e.*")


def fill_missing(known: DataFrame, wanted: DataFrame, keys: list[str], fallback: DataFrame, batch: int = 30, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(lines of all wanted keys with their source, the missing keys in numbered batches).

    known(keys, text) comes first; of the missing, those within `most` batches are to be asked again, all
    are filled from fallback(keys, text) meanwhile.
    """
    first = known.groupBy(*keys).agg(F.min("text").alias("text")).join(wanted.select(*keys), keys, "left_semi")
    missing = wanted.select(*keys).join(first, keys, "left_anti")
    number = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:]))
    batches = missing.withColumn("batch", F.ceil(number / batch)).where(F.col("batch") <= most)
    filled = missing.join(fallback.select(*keys, "text"), keys, "left")
    return first.withColumn("source", F.lit("script")).unionByName(filled.withColumn("source", F.lit("caption"))), batches


def first_lines(lines: DataFrame, panels: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first line of each known key, its part defaulting to 'beat'; lines of unknown keys go."""
    w = Window.partitionBy(*keys).orderBy(seq)
    known = lines.join(panels.select(*keys).distinct(), keys, "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return known.withColumn("part", F.coalesce("part", F.lit("beat"))).drop("_n")


def same_members(order: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """(key, valid): whether each session's order names every active id once and no other."""
    # Counted id by id, so that no session's members are in one value.
    named = order.where("id is not null").groupBy(key, "id").agg(F.count(F.lit(1)).alias("_named"))
    there = active.where("id is not null").groupBy(key, "id").agg(F.lit(True).alias("_there"))
    both = there.join(named, [key, "id"], "full").groupBy(key).agg(F.bool_and(F.coalesce((F.col("_named") == 1) & F.col("_there"), F.lit(False))).alias("valid"), F.bool_or(F.coalesce("_there", F.lit(False))).alias("_any"))
    return both.where("_any").select(key, "valid")


def edited_view(baseline: DataFrame, custom: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Panels of each session as the user sees them: (key, id, display_order, deleted, review_status).

    baseline(key, id, y_start, panel_index), custom(key, id); edits(key, id, position, deleted, review). Rows
    with a position come first, in that order, then the others as they stand; deleted ones have no order.
    """
    base = baseline.select(key, "id", F.struct(F.lit(0).alias("c"), F.col("y_start").cast("long").alias("a"), F.col("panel_index").cast("long").alias("b")).alias("at"))
    own = custom.select(key, "id", F.struct(F.lit(1).alias("c"), F.col("seq").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"))
    rows = base.unionByName(own).join(edits, [key, "id"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    rows = numbered(rows, [key, "deleted"], [F.col("position").isNull(), F.col("position"), F.col("at"), F.col("id")], "_place")
    place = F.col("_place")
    return rows.select(key, "id", F.when(~F.col("deleted"), place).cast("long").alias("display_order"), "deleted", F.when(F.col("deleted"), "deleted").otherwise(F.coalesce("review", F.lit("needs_review"))).alias("review_status"))


def chains(links: DataFrame) -> DataFrame:
    """(session, ancestor, depth): each session's chain of earlier sessions, itself at depth 0, of any length.

    links(session, earlier), one row for each session.  A link back into the chain ends it.  Each round
    doubles the depth that is reached, so the rounds grow with the logarithm of the longest chain.
    """
    sessions = links.select("session").distinct()
    known = links.where("earlier is not null")
    ends = sessions.union(known.select("earlier")).distinct()
    reached = settled(ends.select("session", F.col("session").alias("ancestor"), F.lit(0).alias("depth")))
    jump = settled(known.select("session", F.col("earlier").alias("to")))
    far, rows = 1, reached.count()
    while True:
        beyond = reached.select(F.col("session").alias("to"), "ancestor", (F.col("depth") + far).alias("depth"))
        more = jump.join(beyond, "to").select("session", "ancestor", "depth")
        # In a loop an ancestor is met again and again; the first time counts.
        reached = settled(reached.unionByName(more).groupBy("session", "ancestor").agg(F.min("depth").alias("depth")))
        before, rows = rows, reached.count()
        if rows == before:
            return reached.join(sessions, "session", "left_semi")
        jump = settled(jump.join(jump.select(F.col("session").alias("to"), F.col("to").alias("next")), "to").select("session", F.col("next").alias("to")))
        far *= 2


def combined(chain: DataFrame, panels: DataFrame) -> DataFrame:
    """The panels of a session's whole chain, oldest session first: (session, id, display_order); ids of earlier sessions are prefixed."""
    rows = chain.join(panels.select(F.col("session").alias("ancestor"), "id", "position"), "ancestor")
    name = F.when(F.col("depth") == 0, F.col("id")).otherwise(F.concat(F.lit("s"), F.substring(F.sha1(F.col("ancestor").cast("string")), 1, 8), F.lit("_"), "id"))
    w = Window.partitionBy("session").orderBy(F.desc("depth"), "position", "id")
    return rows.select("session", name.alias("id"), F.row_number().over(w).cast("long").alias("display_order"))


def resolve_prefix(asked: DataFrame, known: DataFrame, least: int = 1) -> DataFrame:
    """asked(q) with the known(name) that it names: itself, else the only one that starts with it, else null.

    A prefix of fewer than `least` characters names nothing.  Every name is looked up by each of its
    beginnings that is asked for.
    """
    names = known.select("name").distinct()
    starts = names.where(F.length("name") >= least).select("name", F.explode(F.sequence(F.lit(least), F.length("name"))).alias("_n"))
    starts = starts.select(F.expr("left(name, _n)").alias("q"), "name").join(asked.select("q").distinct(), "q", "left_semi")
    only = starts.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("only"))
    exact = names.select(F.col("name").alias("q"), F.col("name").alias("same"))
    out = asked.join(only, "q", "left").join(exact, "q", "left")
    return out.select("q", F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("name"))


def overridden(panels: DataFrame, overrides: DataFrame) -> DataFrame:
    """panels(id, narration) with the override of its id, or of its id without the session prefix: (id, narration, ai_text, edited)."""
    clean = overrides.where(F.trim("text") != "").groupBy("id").agg(F.min("text").alias("text"))
    # Which panel has which override is found on ids alone; the texts of the panels meet what was found once.
    ids = panels.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("id").alias("by")), F.struct(F.lit(1).alias("k"), F.regexp_replace("id", "^s[0-9a-f]{8}_", "").alias("by")))).alias("n"))
    chosen = ids.select("id", "n.k", "n.by").join(clean.select(F.col("id").alias("by"), "text"), "by").groupBy("id").agg(F.min_by("text", "k").alias("_text"))
    rows = panels.join(chosen, "id", "left")
    text = F.col("_text")
    return rows.select("id", F.coalesce(text, "narration", F.lit("")).alias("text"), F.coalesce("narration", F.lit("")).alias("ai_text"), text.isNotNull().alias("edited"))


def precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source that has rows of a session, with that source's rank."""
    ranked = [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    best = rows.groupBy(key).agg(F.min("_rank").alias("_best"))
    return rows.join(best, key).where("_rank = _best").drop("_best").withColumnRenamed("_rank", "source_rank")


def entity_keys(mentions: DataFrame, roster: DataFrame) -> DataFrame:
    """mentions(series, name) with the roster(series, key, pos, aliases) entry of that name or alias, in any case; the first one wins."""
    names = roster.select("series", "key", "pos", F.explode(F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"))
    found = names.select("series", "key", "pos", F.lower(F.trim("_n")).alias("_n")).groupBy("series", "_n").agg(F.min_by("key", "pos").alias("entity"))
    return mentions.withColumn("_n", F.lower(F.trim("name"))).join(found, ["series", "_n"], "left").drop("_n")


def in_ranges(rows: DataFrame, number: str, spec: str, last: bool = True) -> DataFrame:
    """rows whose number a spec such as '1-10', '1,3,5-8', '7-', '-4', 'last' names; null or 'all' keeps every row."""
    if not spec or spec.lower() in ("all", "*"):
        return rows
    keep, want_last = F.lit(False), False
    for token in (t.strip().lower() for t in spec.split(",")):
        if token == "last":
            want_last = True
        elif "-" in token:
            low, _, high = token.partition("-")
            ok = F.col(number) >= float(low or 0)
            keep = keep | (ok & (F.col(number) <= float(high)) if high else ok)
        elif token.replace(".", "", 1).isdigit():
            keep = keep | (F.col(number) == float(token))
    if want_last:
        top = rows.agg(F.max(number).alias("_top"))
        return rows.crossJoin(F.broadcast(top)).where(keep | (F.col(number) == F.col("_top"))).drop("_top")  # one row
    return rows.where(keep)


def missing_numbers(rows: DataFrame, number: str, spec: str) -> DataFrame:
    """(number): the numbers that a spec names one by one and that no row has; its ranges, 'last' and 'all' ask for none."""
    asked = sorted({float(t) for t in (x.strip() for x in (spec or "").split(",")) if t.replace(".", "", 1).isdigit()})
    named = rows.sparkSession.createDataFrame([(n,) for n in asked], "number double")
    return named.join(rows.select(F.col(number).cast("double").alias("number")), "number", "left_anti")


def orphans_removed(edits: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Edits whose panel is still in the baseline."""
    return edits.join(baseline.select(*keys).distinct(), keys, "left_semi")


def synced_captions(captions: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """captions(keys, caption) with the new texts, and whether each changed."""
    rows = captions.join(texts.select(*keys, F.col("text").alias("_new")), keys, "left")
    changed = F.coalesce(F.col("_new") != F.col("caption"), F.lit(False))
    return rows.withColumn("changed", changed).withColumn("caption", F.coalesce("_new", "caption")).drop("_new")


def checked_operations(operations: DataFrame, panels: DataFrame, batch: str, key: str) -> DataFrame:
    """The operations of batches in which every id is known: all or nothing."""
    bad = operations.join(panels.select(key).distinct(), key, "left_anti").select(batch).distinct()
    return operations.join(bad, batch, "left_anti")
