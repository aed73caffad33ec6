"""Readers and writers of panel documents, subtitle files, scripts and sound banks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelframe.operators.ranks import numbered

PANEL = "struct<id:string,panel_index:int,y_start:int,y_end:int,narration:string,dialogue:string,panel_type:string,confidence:double,image_file:string,bbox:struct<x:int,y:int,w:int,h:int>>"
ENTRY = "struct<panel_index:int,y_start:int,y_end:int,narration:string,dialogue:string,panel_type:string,confidence:double>"
DOCUMENT = f"source string, width int, height int, panels array<{PANEL}>, entries array<{ENTRY}>, _corrupt_record string"


def panel_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-document JSON files, one row each, with what kind they are: cut (images), page (boxes), plan (entries) or corrupt."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
    has = lambda f: F.exists(F.coalesce("panels", F.array().cast(f"array<{PANEL}>")), lambda p: p[f].isNotNull())
    kind = F.when(F.col("_corrupt_record").isNotNull(), "corrupt").when(F.col("entries").isNotNull(), "plan").when(has("image_file"), "cut").when(has("bbox"), "page").otherwise("unknown")
    return docs.withColumn("kind", kind)


def panels_of(documents: DataFrame) -> DataFrame:
    """A row per panel of cut and page documents."""
    return documents.where("kind in ('cut', 'page')").select("path", "source", "width", "height", F.posexplode("panels").alias("pos", "p")).select("path", "source", "width", "height", "pos", "p.*")


def plan_entries(documents: DataFrame) -> DataFrame:
    return documents.where("kind = 'plan'").select("path", "source", "width", "height", F.posexplode("entries").alias("pos", "e")).select("path", "source", "width", "height", "pos", "e.*")


def srt_cues(lines: DataFrame, block: str = "block") -> DataFrame:
    """lines with number, start, end (seconds) and caption of a subtitle block; blocks without a time line go."""
    time = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})"
    at = lambda k: F.regexp_extract(block, f"{time}\\s*-->\\s*{time}", k).cast("double")
    seconds = lambda k: at(k) * 3600 + at(k + 1) * 60 + at(k + 2) + at(k + 3) / 1000
    text = F.regexp_extract(block, r"(?s)-->[^\n]*\n(.*)$", 1)
    rows = lines.where(F.col(block).rlike("-->"))
    return rows.withColumn("number", F.regexp_extract(block, r"^\s*(\d+)", 1).try_cast("long")).withColumn("start", seconds(1)).withColumn("end", seconds(5)).withColumn("caption", F.trim(F.regexp_replace(text, r"\s*\n\s*", " ")))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "block").withColumn("path", F.col("_metadata.file_path"))
    return srt_cues(lines).drop("block")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """blocks(chapter, number, block) as text files, a folder for each chapter, in order."""
    ordered = blocks.repartition("chapter").sortWithinPartitions("chapter", "number")
    ordered.select("chapter", "block").write.partitionBy("chapter").text(path)


def with_provenance(rows: DataFrame, generator: str, config_hash: str, version: int = 1, inputs: dict[str, str] | None = None) -> DataFrame:
    """rows with meta: who made them, of which configuration, and the hashes of the named inputs."""
    hashes = F.map_from_arrays(F.array(*map(F.lit, inputs)), F.array(*map(F.lit, inputs.values()))) if inputs else F.create_map().cast("map<string,string>")
    meta = F.struct(F.lit(version).alias("schema_version"), F.lit(generator).alias("generator"), F.lit(config_hash).alias("config_hash"), hashes.alias("input_hashes"))
    return rows.withColumn("meta", meta)


SEGMENT = "struct<seg:int,t0:double,t1:double,dur:double,zoom:double,matchScore:double,dx:double,dy:double,dxps:double,dyps:double>"
TEMPLATE = f"name string, reference_width double, reference_height double, static_speed_threshold_px_per_s double, low_confidence_threshold double, low_confidence_damping double, segments array<{SEGMENT}>"


def motion_templates(spark: SparkSession, path: str) -> DataFrame:
    """Motion template files, one row each with defaults filled in and segments in order; one without segments, or with a value missing in one, is an error."""
    docs = spark.read.schema(TEMPLATE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    # What a template that leaves them out has.
    defaults = {"name": "reference_v1", "reference_width": 1312.0, "reference_height": 2332.0, "static_speed_threshold_px_per_s": 5.0, "low_confidence_threshold": 0.85, "low_confidence_damping": 0.6}
    whole = lambda s: F.forall(F.array(*[s[f] for f in ("t0", "t1", "dur", "zoom", "matchScore", "dx", "dy", "dxps", "dyps")]), lambda v: v.isNotNull()) & s["seg"].isNotNull()
    fine = (F.size(F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>"))) > 0) & F.forall("segments", whole)
    checked = F.when(F.coalesce(fine, F.lit(False)), F.array_sort("segments")).otherwise(F.raise_error(F.concat(F.lit("no whole segments in "), F.col("path"))).cast(f"array<{SEGMENT}>"))
    return docs.fillna(defaults).withColumn("segments", checked)


def template_segments(templates: DataFrame) -> DataFrame:
    """A row for each segment of motion_templates(), in order."""
    return templates.select("path", "name", F.posexplode("segments").alias("pos", "s")).select("path", "name", "pos", "s.*")


def keep_first_backup(rows: DataFrame, path: str) -> None:
    """Rejected rows beside the kept ones; a backup that is there already stays as it is."""
    rows.write.mode("ignore").parquet(path)


def sound_bank(files: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, source, k, n) of files(source) such as 'action/hit.wav': each kind has its own files, or those of 'default' without any."""
    audio = files.where(F.lower("source").rlike(r"\.(wav|mp3|ogg|m4a|flac)$")).withColumn("folder", F.element_at(F.split("source", "/"), -2))
    own = audio.where(F.col("folder").isin(kinds)).select(F.col("folder").alias("kind"), "source")
    wanted = audio.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    rest = wanted.join(own.select("kind").distinct(), "kind", "left_anti").crossJoin(audio.where("folder = 'default'").select("source"))  # a few kinds
    rows = own.unionByName(rest)
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return numbered(rows, ["kind"], [F.col("source")], "k").withColumn("k", F.col("k") - 1).join(counts, "kind")


def salvaged(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, item): every complete object of the array "lines" in a response that may be cut off; item is its JSON text."""

    @F.pandas_udf("array<string>")
    def objects(texts):
        import json

        import pandas as pd

        decoder = json.JSONDecoder()

        def one(t):
            out, at = [], (t or "").find('"lines"')
            at = t.find("[", at) + 1 if at >= 0 else 0
            while at > 0:
                at = t.find("{", at)
                if at < 0:
                    break
                try:
                    value, end = decoder.raw_decode(t, at)
                except ValueError:
                    break  # the rest is cut off
                out.append(json.dumps(value))
                at = end
                if t[at:].lstrip()[:1] != ",":
                    break
            return out

        return pd.Series([one(t) for t in texts], dtype=object)

    return rows.select(key, F.posexplode(objects(F.col(text))).alias("pos", "item"))


def page_order(pages: DataFrame, path: str, skip: list[str] = ()) -> DataFrame:
    """Page images(path, w, h) in natural order with a reject reason: repeated files, named ones, landscape ones."""
    from panelframe.operators.web import natural_key

    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    reason = F.when(stem.rlike(r"_1$"), "repeated").when(F.lower(stem).isin([s.lower() for s in skip]) if skip else F.lit(False), "named").when(F.col("w") >= F.col("h"), "landscape")
    return pages.withColumn("reason", reason).withColumn("sort_key", natural_key(name))


def archive_limits(pages: DataFrame, key: str, most_bytes: float = math.inf, most_pixels: float = math.inf, most_images: float = math.inf, most_stitched: float = math.inf) -> DataFrame:
    """(key, problems): caps on the bytes, the largest image, the number of images and the stitched strip of pages(bytes, w, h)."""
    w, h = F.col("w").cast("long"), F.col("h").cast("long")
    s = pages.groupBy(key).agg(F.sum("bytes").alias("b"), F.max(w * h).alias("p"), F.count(F.lit(1)).alias("n"), (F.max(w) * F.sum(h)).alias("s"))
    over = lambda c, most, name: F.when(F.col(c) > F.lit(float(most)), name)
    return s.select(key, F.array_compact(F.array(over("b", most_bytes, "bytes"), over("p", most_pixels, "pixels"), over("n", most_images, "images"), over("s", most_stitched, "stitched"))).alias("problems"))


def stitched_offsets(pages: DataFrame, key: str, order: str) -> DataFrame:
    """pages(w, h) with their place on the stitched strip: y_offset, and the strip's width."""
    w = Window.partitionBy(key).orderBy(order)
    above = F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("y_offset", F.coalesce(above, F.lit(0)).cast("long")).withColumn("strip_width", F.max("w").over(Window.partitionBy(key)))
