"""Proportional stratified interleaving: every shard gets every source in the mixture's proportion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelframe.llm.common import written

# Rows that one bucket of a ranking holds on average, and the least number of buckets.
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 256


def _ranked(rows: DataFrame, strata: list[str], place: str, order: list, buckets: int, name: str) -> DataFrame:
    """rows with a gapless rank from 0 in each stratum by `place` (0 to 1), then `order`.

    Each stratum is cut into buckets of `place`; counts of the buckets give each bucket's first rank and
    rows are ranked within their bucket, so a stratum with most of the rows is still many small windows.
    """
    rows = rows.withColumn("_bucket", F.least(F.floor(F.col(place) * buckets), F.lit(buckets - 1)).cast("int"))
    sizes = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*strata, "_bucket").orderBy(place, *order)
    local = rows.withColumn("_local", F.row_number().over(within) - 1)
    same = [local[s].eqNullSafe(first[s]) for s in [*strata, "_bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return local.join(first, on).select(*[local[c] for c in local.columns if c != "_bucket"], (F.col("_first") + F.col("_local")).alias(name)).drop("_local")


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 8, seed: int = 17) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): rows dealt to shards 0..shards-1 by fractional rank.

    Rows are ranked in a seeded random order within their source; (rank + a seeded offset of the source)
    / its count places them in 0..1; all rows by that place are cut into shards whose row counts differ
    by at most one.  slot is gapless from 0 in each shard.  size is UTF-8 bytes plus 1.

    A null text has size 1 and the checksum of the empty text; rows without a source form a source of
    their own; null ids and repeated rows are rows like any other (rows alike in id and checksum are
    interchangeable; their order, and with it the deal, follows how the files are split); an empty table
    gives no rows; other columns are not read.  Texts, very long ones too, are measured in the scan and never
    shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    unit = lambda *c: (F.xxhash64(F.lit(seed), *c).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    # One narrow row for each document, read by the count and both rankings.
    # Each row has a number of its own, so that rows alike in all else are spread like others.
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_u", unit(F.col("_id"), F.col("text_crc32"), F.col("size"), F.col("_row"))), "interleave")
    counts = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of")).withColumn("_shift", unit(F.lit("shift"), F.col("_source")))
    n = rows.count()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    ranked = _ranked(rows, ["_source"], "_u", ["_id", "text_crc32", "size", "_row"], buckets, "_rank")
    placed = ranked.join(counts, ranked["_source"].eqNullSafe(counts["_source"])).select("_id", ranked["_source"], "size", "text_crc32", ((F.col("_rank") + F.col("_shift")) / F.col("_of")).alias("_place"))
    everything = _ranked(placed.withColumn("_all", F.lit(0)), ["_all"], "_place", ["_source", "_id", "text_crc32", "size"], buckets, "_at")
    # Shard k holds the ranks from ceil(k n / shards) on.
    shard = F.floor((F.col("_at") * shards) / F.lit(max(n, 1))).cast("int")
    first = -F.floor(-(F.col("shard").cast("long") * F.lit(n)) / F.lit(shards))
    return everything.withColumn("shard", shard).withColumn("slot", (F.col("_at") - first).cast("long")).select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "text_crc32", "shard", "slot")
