"""Queries that write files of the given tables to the shared folder and read them by the library's own sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelframe.operators.tables import shared_folder
from panelframe.plans.registry import query, table
from panelframe.sources import event_log, scripts


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT conv_id::VARCHAR AS chapter, count(*) FILTER (said <> '') AS lines, sha256(coalesce(string_agg(said, chr(10) ORDER BY turn, conv_id::VARCHAR, said) FILTER (said <> ''), '')) AS digest, sum(length(said))::BIGINT AS chars
FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id""")
def a12_scripts(spark, folder):
    """Every conversation is a chapter, written with its index and read back."""
    path = _new(spark, "scripts")
    scripts.write(scripts.scripts(table(spark, folder, "conversations"), "conv_id", "turn", "conv_id", "text"), path)
    index = F.from_json("lines", "array<struct<line:int,panel:string,chars:int>>")
    chars = F.aggregate(F.transform(index, lambda x: x["chars"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return scripts.read(spark, path).select("chapter", F.size(index).cast("long").alias("lines"), F.sha2("script", 256).alias("digest"), chars.alias("chars"))


@query("""SELECT event_id, user_id, event_type AS step, round(value, 6) AS seconds FROM events WHERE event_type = 'error'""")
def a07_event_log(spark, folder):
    """All events as lines of a log, of which the source reads those of one step."""
    e = table(spark, folder, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("step"), F.col("value").alias("duration_s"), F.concat_ws(" ", "event_id", "user_id").alias("message"), "props"))
    path = _new(spark, "event-log")
    e.select(line.alias("value")).write.text(path)
    event_log.register(spark)
    log = spark.read.format("event_log").option("path", path).option("splitBytes", str(1 << 18)).load().where("step = 'error'")
    part = lambda k: F.split("message", " ")[k].cast("long")
    return log.select(part(0).alias("event_id"), part(1).alias("user_id"), "step", F.round("duration_s", 6).alias("seconds"))
