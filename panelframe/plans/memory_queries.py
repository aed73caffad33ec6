"""Memory, coercion and panel-edit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelframe.operators import intervals as I
from panelframe.operators import memory as M
from panelframe.plans import interval_queries as IQ
from panelframe.plans.registry import query, table

_RANKED = """SELECT series, name, last_seen, row_number() OVER (PARTITION BY series ORDER BY CASE WHEN last_seen = 0 THEN 1 WHEN 1000 - last_seen > 60 THEN 2 ELSE 0 END, last_seen DESC, name) AS rank FROM (SELECT c_nationkey AS series, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 37 % 1000 END AS last_seen FROM customer)"""


def ranked(spark, folder):
    k = F.col("c_custkey")
    roster = table(spark, folder, "customer").select(F.col("c_nationkey").alias("series"), F.col("c_name").alias("name"), F.when(k % 5 == 0, 0).otherwise(k * 37 % 1000).alias("last_seen"))
    return M.ranked_entities(roster, F.lit(1000))


@query(f"""WITH l AS (SELECT series, rank, '- ' || name || ' (panel ' || last_seen || ')' AS line FROM ({_RANKED}) WHERE rank <= 10), s AS (SELECT series, CASE WHEN sum(length(line) + 1) <= 180 THEN 10 WHEN sum(length(line) + 1) FILTER (rank <= 6) <= 180 THEN 6 WHEN sum(length(line) + 1) FILTER (rank <= 4) <= 180 THEN 4
  WHEN sum(length(line) + 1) FILTER (rank <= 2) <= 180 THEN 2 ELSE 1 END AS level FROM l GROUP BY series) SELECT series, count(*) AS shown, string_agg(line, chr(10) ORDER BY rank) AS block FROM l JOIN s USING (series) WHERE rank <= level GROUP BY series""")
def f12_story_memory(spark, folder):
    line = F.concat(F.lit("- "), "name", F.lit(" (panel "), "last_seen", F.lit(")"))
    return M.fitting_memory(ranked(spark, folder), line, 180)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || ',b' ELSE '' END AS names FROM events""")
def b15_as_list(spark, folder):
    k, t = F.col("event_id") % 4, F.col("event_type")
    json = F.when(k == 0, F.concat(F.lit('"'), t, F.lit('"'))).when(k == 1, F.concat(F.lit('["'), t, F.lit('", 1, null, {"a": 2}, "b"]'))).when(k == 2, "17").otherwise("not json")
    return table(spark, folder, "events").select("event_id", F.coalesce(F.array_join(M.as_strings(json), ","), F.lit("")).alias("names"))


@query("""SELECT p_partkey, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN w END AS w, CASE WHEN ok THEN h END AS h FROM (SELECT p_partkey, (p_partkey % 50)::INTEGER AS x, (p_partkey % 70)::INTEGER AS y, (p_size - 5)::INTEGER AS w, (p_size + 3)::INTEGER AS h, p_size > 5 AND p_partkey % 4 <> 3 AS ok FROM part)""")
def b33_boxes(spark, folder):
    x, y, w, h, k = F.col("p_partkey") % 50, F.col("p_partkey") % 70, F.col("p_size") - 5, F.col("p_size") + 3, F.col("p_partkey") % 4
    named = F.format_string('{"x": %d, "y": %d, "w": %d, "h": %d}', x, y, w, h)
    corners = F.format_string('{"x0": %d, "y0": %d, "x1": %d, "y1": %d}', x, y, x + w, y + h)
    listed = F.format_string("[%d, %d, %d, %d]", x, y, x + w, y + h)
    json = F.when(k == 0, named).when(k == 1, corners).when(k == 2, listed).otherwise('{"x": 1}')
    return table(spark, folder, "part").select("p_partkey", M.box(json).alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")


@query("""SELECT event_id, least(greatest(coalesce((props::JSON->>'k')::DOUBLE, 0.5), 0.0), 60.0) AS k, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS zoom FROM events""")
def e24_presets(spark, folder):
    base = F.create_map(F.lit("k"), F.lit(0.5), F.lit("zoom"), F.lit(1.0))
    toggles = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("zoom"), F.lit(2.0), F.lit("unknown"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    own = F.from_json("props", "map<string,double>")
    m = M.overlaid(base, toggles, own, limits={"k": (0.0, 60.0)})
    return table(spark, folder, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["zoom"].alias("zoom"))


@query(f"""WITH s AS (SELECT {IQ._STRIP_SQL} FROM lineitem) SELECT strip, CASE WHEN k IN (2, 3) THEN 2 ELSE k END AS id, min(y0) AS y0, max(y1) AS y1, round(min(y0 % 10 / 10.0::DOUBLE), 1) AS confidence, count(*) AS parts FROM s GROUP BY ALL""")
def e18_merged_panels(spark, folder):
    s = IQ.spans(spark, folder)
    panels = s.select("strip", F.col("k").alias("id"), "y0", "y1", (F.col("y0") % 10 / 10.0).alias("confidence"))
    groups = s.where("k in (2, 3)").select("strip", F.col("k").alias("id"), F.lit(2).cast("long").alias("into"))
    return M.merged_panel(panels, groups).withColumn("confidence", F.round("confidence", 1))


@query(f"""WITH s AS (SELECT {IQ._STRIP_SQL} FROM lineitem), c AS (SELECT *, y0 + round_even((y1 - y0) * 0.3::DOUBLE, 0)::BIGINT AS cut FROM s)
SELECT strip, k::VARCHAR AS id, y0, y1 FROM c WHERE k <> 1 UNION ALL SELECT strip, k || 'a', y0, cut FROM c WHERE k = 1 UNION ALL SELECT strip, k || 'b', cut, y1 FROM c WHERE k = 1""")
def e18_split_panels(spark, folder):
    s = IQ.spans(spark, folder).select("strip", F.col("k").alias("id"), "y0", "y1")
    return M.split_panel(s, s.where("id = 1").select("strip", "id", F.lit(0.3).alias("fraction")))


@query(f"""WITH s AS (SELECT {IQ._STRIP_SQL} FROM lineitem), b AS (SELECT strip, y0 AS b0, y1 AS b1 FROM s WHERE k % 3 = 0) SELECT strip, k, y0 AS y FROM s WHERE k % 3 <> 0 AND EXISTS (SELECT 1 FROM b WHERE b.strip = s.strip AND y0 >= b0 AND y0 < b1)""")
def c14_covered_rows(spark, folder):
    s = IQ.spans(spark, folder)
    rows = s.where("k % 3 <> 0").select("strip", "k", F.col("y0").alias("y"), (F.col("y0") + 1).alias("y_end"))
    regions = s.where("k % 3 = 0").select("strip", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    hit = I.overlapping(rows, regions, "strip", ("y", "y_end"), ("b0", "b1")).select("strip", "k").distinct()
    return rows.drop("y_end").join(hit, ["strip", "k"], "left_semi")
