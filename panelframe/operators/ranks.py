"""Row numbers within keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelframe.operators.tables import settled


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 1, within each value of keys by `order`; null keys are one value.

    Rows are dealt by ranges of (keys, order), so that a key with most of the rows is in many tasks; the counts of a
    key in the ranges before give where each range's numbers begin.  Rows alike in keys and order are numbered as they come.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    # Written, as the number of a range is that of a partition of this one shuffle.
    dealt = settled(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    on = local["_range"] == first["_of"]
    for i, k in enumerate(keys):
        on = on & local[k].eqNullSafe(first[f"_k{i}"])
    return local.join(first, on).select(*rows.columns, (F.col("_before") + F.col("_local")).cast("long").alias(name))


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each value of keys by `order`; each task passes on no more than n of a value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_top", F.row_number().over(w)).where(F.col("_top") <= n).drop("_top")


def percentiles(rows: DataFrame, key: str, column: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, names...): exact percentiles of a column in each value of key, between neighbours in proportion; nulls do not count.

    The values are numbered over ranges and those at the places of a percentile picked, so that no key's values are in one
    place.  n counts all rows of the key; a key without values has null percentiles.
    """
    rows = rows.select(F.col(key), F.col(column).alias("_v"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("_m"))
    placed = numbered(rows.where("_v is not null"), [key], [F.col("_v")], "_k").withColumnRenamed(key, "_key")
    near = placed.join(counts, placed["_key"].eqNullSafe(counts[key]))
    place = {name: (F.col("_m") - 1) * p for name, p in shares.items()}
    at = lambda k: F.max(F.when(F.col("_k") - 1 == k, F.col("_v")))
    wanted = F.lit(False)
    for c in place.values():
        wanted = wanted | (F.col("_k") - 1 == F.floor(c)) | (F.col("_k") - 1 == F.ceil(c))
    ends = near.where(wanted).groupBy("_key").agg(F.first("_m").alias("_m"), *[at(f(c)).alias(f"_{side}_{name}") for name, c in place.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda name, c: (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (c - F.floor(c))).alias(name)
    found = ends.select("_key", *[between(name, c) for name, c in place.items()])
    return counts.join(found, counts[key].eqNullSafe(found["_key"]), "left").select(key, "n", *shares)
