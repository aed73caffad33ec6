"""Review changes over chains of sessions: batches all or nothing, then a state machine for each strip."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.operators.overlay import chains

# What a review may say of a panel, and what it says at first.
STATUSES, UNREVIEWED, REVIEWED = ["needs_review", "reviewed", "edited"], "needs_review", "reviewed"
OPERATIONS = ["delete", "restore", "status", "confirm", "confirm_all"]
SHORT = 8


def session_name(session: Column) -> Column:
    """The name by which a session's panels are told from others': its first SHORT characters do, if no other has them."""
    return F.sha1(session.cast("string"))


def routed(log: DataFrame, chain: DataFrame) -> DataFrame:
    """log(batch, seq, session, op, id, status) with owner and raw: the session of the chain that a prefixed id names, and the id there.

    owner is null where no session of the chain, or more than one, has that prefix.
    """
    at = "^s([0-9a-f]{8,})_(.+)$"
    prefix, raw = F.regexp_extract("id", at, 1), F.regexp_extract("id", at, 2)
    rows = log.withColumn("_prefix", F.nullif(prefix, F.lit(""))).withColumn("_short", F.substring("_prefix", 1, SHORT))
    names = chain.select("session", "ancestor", session_name(F.col("ancestor")).alias("_name")).withColumn("_short", F.substring("_name", 1, SHORT))
    far = rows.where("_prefix is not null").join(names, ["session", "_short"]).where(F.col("_name").startswith(F.col("_prefix")))
    found = far.groupBy("session", "_prefix").agg(F.countDistinct("ancestor").alias("_n"), F.min("ancestor").alias("_owner")).where("_n = 1").drop("_n")
    out = rows.join(found, ["session", "_prefix"], "left")
    return out.select("batch", "seq", "session", "op", "id", "status", F.when(F.col("_prefix").isNull(), F.col("session")).otherwise(F.col("_owner")).alias("owner"), F.when(F.col("_prefix").isNull(), F.col("id")).otherwise(raw).alias("raw"))


class _Strip:
    """The panels of one strip, in the order of their place, and the order that the last confirmation locked."""

    def __init__(self, name):
        self.name, self.panels, self.order, self.confirmed = name, {}, [], None

    def apply(self, op: str, panel: str | None, status: str | None, seq: int | None) -> None:
        if op == "panel":
            self.panels[panel] = [False, None]
        elif op in ("delete", "restore"):
            self.panels[panel][0], self.confirmed = op == "delete", None
        elif op == "status":
            self.panels[panel][1] = status
        else:
            # What was locked before and is not deleted; all that is not deleted, if nothing of that is left.
            order = [p for p in self.order if not self.panels[p][0]] or [p for p, (gone, _) in self.panels.items() if not gone]
            if order:
                self.order, self.confirmed = order, seq
                for p in order if op == "confirm_all" else ():
                    self.panels[p][1] = self.panels[p][1] or REVIEWED

    def rows(self) -> list[tuple]:
        place = {p: k for k, p in enumerate(self.order, 1)}
        return [(self.name, p, gone, review or UNREVIEWED, place.get(p), self.confirmed) for p, (gone, review) in self.panels.items()]


def review_changes(panels: DataFrame, links: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panels as the reviews leave them, batches that were refused).

    panels(session, id string, y_start); links(session, earlier); log(batch, seq, session, op, id, status) with one row for each
    panel of a deletion, restoration or status, whose id may name a panel of an earlier strip by that session's prefix,
    and one without id for a confirmation of the whole chain (`confirm_all` also marks panels without a status reviewed).

    A batch with an operation or status that is none, or a panel that no strip of its session's chain has, is refused
    whole, with its first problem: (batch, seq, problem).  Others go by seq.  A change to what is deleted unlocks its
    strip.  A confirmation locks, in every strip of the chain, what was locked and is not deleted, else all that is
    not deleted by y_start and id; a strip without such panels stays as it is.  Out come (session, id, deleted,
    review_status, position, confirmed): the place in the locked order and the seq of the confirmation that still holds.

    Equal ids of a strip are one panel, the topmost; rows of panels without session or id take no part, nor log rows
    without a session.  A strip's changes are folded from sorted rows: a task holds the panels of one strip, not its log.
    """
    kind = dict(panels.dtypes)["session"]
    known = panels.where("session is not null and id is not null").groupBy("session", "id").agg(F.min("y_start").alias("y_start"))
    linked = links.groupBy("session").agg(F.min("earlier").alias("earlier"))
    everyone = known.select("session").union(log.select("session")).union(linked.select("session")).where("session is not null").distinct()
    chain = chains(everyone.join(linked, "session", "left"))
    log = log.where("session is not null")
    ops = routed(log, chain).join(known.select(F.col("session").alias("owner"), F.col("id").alias("raw"), F.lit(True).alias("_there")), ["owner", "raw"], "left")
    whole = F.col("op").isin("confirm", "confirm_all")
    problem = (
        F.when(~F.coalesce(F.col("op").isin(OPERATIONS), F.lit(False)), "unknown operation")
        .when(~whole & F.col("_there").isNull(), "unknown panel")
        .when((F.col("op") == "status") & ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "invalid status")
    )
    ops = ops.withColumn("problem", problem)
    refused = ops.where("problem is not null").groupBy("batch").agg(F.min(F.struct("seq", "problem")).alias("_p")).select("batch", "_p.*")
    # Batches without a number are not one batch, but each row by itself.
    good = ops.join(refused.select("batch"), "batch", "left_anti").where("problem is null")
    of_panels = good.where(~whole).select(F.col("owner").alias("strip"), "seq", "op", F.col("raw").alias("id"), "status", F.lit(None).cast("long").alias("y"))
    of_chains = good.where(whole).select("session", "seq", "op").join(chain.select("session", F.col("ancestor").alias("strip")), "session")
    of_chains = of_chains.select("strip", "seq", "op", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("y"))
    first = known.select(F.col("session").alias("strip"), F.lit(None).cast("long").alias("seq"), F.lit("panel").alias("op"), "id", F.lit(None).cast("string").alias("status"), F.col("y_start").cast("long").alias("y"))
    rows = first.unionByName(of_panels).unionByName(of_chains).repartition("strip").sortWithinPartitions("strip", F.col("op") != "panel", "seq", "y", "id", "op", "status")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["session", "id", "deleted", "review_status", "position", "confirmed"]
        made = lambda rows: pd.DataFrame(rows, columns=names).astype({"position": "Int64", "confirmed": "Int64"})
        strip, done = None, []
        for pdf in frames:
            for s, seq, op, panel, status in pdf.itertuples(index=False):
                if strip is None or s != strip.name:
                    done += strip.rows() if strip else []
                    strip = _Strip(s)
                strip.apply(op, panel, status, None if pd.isna(seq) else int(seq))
            if done:
                yield made(done)
                done = []
        if strip:
            yield made(strip.rows())

    out = rows.select("strip", "seq", "op", "id", "status").mapInPandas(fold, f"session {kind}, id string, deleted boolean, review_status string, position long, confirmed long")
    return out, refused
