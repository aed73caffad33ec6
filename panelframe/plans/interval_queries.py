"""Interval queries: parts, order lines and events stand for strips and their rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelframe.operators import intervals as I
from panelframe.plans.registry import query, table

_STRIP_SQL = """l_orderkey AS strip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
  l_partkey % 3000 AS y0, l_partkey % 3000 + 50 + (l_quantity * 30)::BIGINT AS y1, l_returnflag || l_suppkey AS text"""


def spans(spark, folder):
    """Order lines as entries of strips: numbered within the order, with a range and a text."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    y0 = (F.col("l_partkey") % 3000).cast("long")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("strip"), F.row_number().over(w).cast("long").alias("k"), y0.alias("y0"), (y0 + 50 + (F.col("l_quantity") * 30).cast("long")).alias("y1"), F.concat("l_returnflag", "l_suppkey").alias("text"))


@query("""SELECT p_partkey, k::INTEGER AS k, k * 1800 AS y0, least(k * 1800 + 2000, h) AS y1
FROM (SELECT *, unnest(range(0, CASE WHEN h <= 2000 THEN 1 ELSE ceil((h - 2000) / 1800.0)::BIGINT + 1 END)) AS k FROM (SELECT p_partkey, p_size * 397 AS h FROM part)) WHERE h > 0""")
def c02_tiles(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", F.explode(I.tiles((F.col("p_size") * 397).cast("long"))).alias("t"))
    return rows.select("p_partkey", "t.k", F.col("t.y0").cast("long").alias("y0"), F.col("t.y1").cast("long").alias("y1"))


def row_metrics(spark, folder):
    """A strip per user: each event is a row, single-coloured unless it is an error."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, folder, "events").select(F.col("user_id").alias("strip"), (F.row_number().over(w) - 1).cast("long").alias("y"), (F.col("event_type") != "error").alias("mono"), F.col("value").alias("level"), F.lit(30.0).alias("background"), F.col("event_type").alias("kind"))


def marks(spark, folder):
    rows = row_metrics(spark, folder).where("kind = 'signup' and y % 7 = 0")
    return rows.select("strip", F.col("y").alias("f0"), (F.col("y") + 1).alias("f1"))


_ROWS = "r AS (SELECT user_id AS strip, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS y, event_type <> 'error' AS mono, value AS level, event_type AS kind FROM events)"
_GUTTERS = f"""{_ROWS}, i AS (SELECT strip, y, y - row_number() OVER (PARTITION BY strip ORDER BY y) AS island FROM r WHERE mono),
  g AS (SELECT strip, min(y) AS lo, max(y) AS hi FROM i GROUP BY strip, island HAVING count(*) BETWEEN 3 AND 120),
  v AS (SELECT g.strip, lo, hi, (lo + hi) // 2 AS mid FROM g JOIN r ON r.strip = g.strip AND y BETWEEN lo AND hi GROUP BY ALL HAVING abs(quantile_cont(level, 0.5) - 30.0) <= 24 AND count(*) FILTER (kind = 'signup' AND y % 7 = 0) = 0)"""


@query(f"WITH {_GUTTERS} SELECT * FROM v")
def c04_gutters(spark, folder):
    return I.gutters(row_metrics(spark, folder), marks(spark, folder))


@query(f"""WITH RECURSIVE {_GUTTERS}, hs AS (SELECT strip, max(y) + 1 AS h FROM r GROUP BY strip),
  o AS (SELECT strip, mid, row_number() OVER (PARTITION BY strip ORDER BY mid) AS n FROM v),
  f AS (SELECT strip, 0::BIGINT AS n, 0::BIGINT AS last, [0::BIGINT] AS cuts FROM hs UNION ALL
    SELECT f.strip, o.n, CASE WHEN mid - last >= 8 THEN mid ELSE last END, CASE WHEN mid - last >= 8 THEN list_append(cuts, mid) ELSE cuts END FROM f JOIN o ON o.strip = f.strip AND o.n = f.n + 1),
  e AS (SELECT strip, arg_max(cuts, n) AS cuts FROM f GROUP BY strip)
SELECT strip, array_to_string(CASE WHEN cuts[-1] < h - 8 THEN list_append(cuts, h) WHEN cuts[-1] <> h THEN list_append(cuts[1:len(cuts) - 1], h) ELSE cuts END, ',') AS cuts FROM e JOIN hs USING (strip)""")
def c05_spaced_cuts(spark, folder):
    rows = row_metrics(spark, folder)
    mids = I.gutters(rows, marks(spark, folder)).groupBy("strip").agg(F.collect_list("mid").alias("mids"))
    heights = rows.groupBy("strip").agg((F.max("y") + 1).alias("h"))
    cuts = I.spaced_cuts(F.coalesce("mids", F.array().cast("array<bigint>")), F.col("h"), 8)
    return heights.join(mids, "strip", "left").select("strip", F.array_join(cuts.cast("array<string>"), ",").alias("cuts"))


@query(f"""WITH {_GUTTERS}, b AS (SELECT DISTINCT user_id AS strip, event_id % 60 AS b FROM events),
  p AS (SELECT b.strip, b, mid, lo, CASE WHEN hi >= b - 2 AND lo <= b + 2 THEN 0 WHEN hi >= b - 6 AND lo <= b + 6 THEN 1 ELSE 2 END AS level, abs((lo + hi) / 2.0 - b) AS d FROM b JOIN v ON v.strip = b.strip AND hi >= b - 15 AND lo <= b + 15),
  q AS (SELECT strip, b, mid AS cut FROM p QUALIFY row_number() OVER (PARTITION BY strip, b ORDER BY level, d, lo) = 1)
SELECT strip, b, cut FROM b LEFT JOIN q USING (strip, b)""")
def c06_nearest_gutter_whole(spark, folder):
    return nearest_gutter(spark, folder, table(spark, folder, "events"))


def nearest_gutter(spark, folder, events):
    boundaries = events.select(F.col("user_id").alias("strip"), (F.col("event_id") % 60).alias("b")).distinct()
    return I.nearest_run(boundaries, I.gutters(row_metrics(spark, folder), marks(spark, folder)), [2, 6, 15])


_ENTRIES = """e AS (SELECT user_id AS strip, k, k * 6 + k % 5 AS y0, k * 6 + 7 - k % 3 AS y1, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE event_type <> 'error')"""


def entries(spark, folder):
    """Entries of strips in reading order, some of which overlap the next one."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    rows = table(spark, folder, "events").withColumn("k", k).where("event_type <> 'error'")
    return rows.select(F.col("user_id").alias("strip"), "k", (F.col("k") * 6 + F.col("k") % 5).alias("y0"), (F.col("k") * 6 + 7 - F.col("k") % 3).alias("y1"), F.col("event_type").alias("text"))


@query(f"""WITH {_GUTTERS}, {_ENTRIES}, tall AS (SELECT user_id AS strip, count(*) * 6 AS height FROM events GROUP BY user_id),
  bounds AS (SELECT strip, k, (lag(y1) OVER (PARTITION BY strip ORDER BY y0, k) + y0) // 2 AS b FROM e QUALIFY b IS NOT NULL),
  weak AS (SELECT strip, y0 AS lo, y0 + 1 AS hi FROM e WHERE text = 'view'),
  near AS (SELECT t.strip, t.k, b, (lo + hi) // 2 AS mid, lo, CASE WHEN hi >= b - 2 AND lo <= b + 2 THEN 0 ELSE 1 END AS level, abs((lo + hi) / 2.0 - b) AS d FROM bounds t JOIN v ON v.strip = t.strip AND hi >= b - 4 AND lo <= b + 4
    UNION ALL SELECT t.strip, t.k, b, (lo + hi) // 2, lo, 3, abs((lo + hi) / 2.0 - b) FROM bounds t JOIN weak w ON w.strip = t.strip AND hi >= b - 4 AND lo <= b + 4),
  cut AS (SELECT strip, k, b, mid AS cut FROM near QUALIFY row_number() OVER (PARTITION BY strip, k ORDER BY level, d, lo) = 1),
  placed AS (SELECT e.*, cut.b, cut.cut, count(cut.cut) OVER (PARTITION BY e.strip ORDER BY y0, e.k) AS panel FROM e LEFT JOIN cut ON cut.strip = e.strip AND cut.k = e.k),
  groups_ AS (SELECT strip, panel, max(cut) AS top, max(abs(cut - b)) AS top_snap, string_agg(text, ' ' ORDER BY y0, k) AS text, count(*) AS members FROM placed GROUP BY strip, panel)
SELECT strip, panel, coalesce(top, 0)::BIGINT AS y0, coalesce(lead(top) OVER w, height)::BIGINT AS y1, text, members, top_snap, lead(top_snap) OVER w AS bottom_snap FROM groups_ JOIN tall USING (strip) WINDOW w AS (PARTITION BY strip ORDER BY panel)""")
def c08_build_cuts(spark, folder):
    e = entries(spark, folder)
    boundaries = I.entry_boundaries(e)
    relaxed = e.where("text = 'view'").select("strip", F.col("y0").alias("lo"), (F.col("y0") + 1).alias("hi"))
    cuts = I.nearest_run(boundaries, I.gutters(row_metrics(spark, folder), marks(spark, folder)), [2, 4], relaxed)
    heights = table(spark, folder, "events").groupBy(F.col("user_id").alias("strip")).agg((F.count(F.lit(1)) * 6).alias("height"))
    return I.build_cuts(e, heights, cuts).withColumn("members", F.size("members").cast("long"))


@query(f"""WITH s AS (SELECT {_STRIP_SQL} FROM lineitem), b AS (SELECT strip, y0 + 60 * (k % 4 - 1) AS b0, y0 + 60 * (k % 4 - 1) + 90 + y1 % 900 AS b1, y0 % 100 / 100.0::DOUBLE AS score, CASE WHEN k % 5 = 0 THEN 'suspicious' ELSE 'blank' END AS verdict FROM s WHERE k % 3 = 0),
  o AS (SELECT s.strip, s.k AS id, list({{'b0': b0, 'b1': b1, 'score': score}} ORDER BY b0, b1, score) FILTER (verdict = 'blank') AS cut, coalesce(sum(least(y1, b1) - greatest(y0, b0)) FILTER (verdict = 'blank'), 0) AS n, arg_min(score, (b0, b1)) AS doubt FROM s JOIN b ON b.strip = s.strip AND b0 < y1 AND y0 < b1 GROUP BY s.strip, s.k),
  p AS (SELECT s.strip, s.k AS id, y0, y1, cut, coalesce(n, 0) AS n, doubt, greatest(48, floor((y1 - y0) * 0.02)::BIGINT) AS slack, greatest(30, floor((y1 - y0) * 0.1)::BIGINT) AS keep, s.strip IN (SELECT strip FROM b WHERE verdict = 'blank') AS blanks FROM s LEFT JOIN o ON o.strip = s.strip AND o.id = s.k),
  t AS (SELECT *, list_reduce(coalesce(cut, []), lambda a, r: {{'b0': CASE WHEN r.b0 <= a.b0 + slack THEN greatest(a.b0, least(r.b1, a.b1 - keep)) ELSE a.b0 END,
    'b1': CASE WHEN r.b1 >= a.b1 - slack THEN least(a.b1, greatest(r.b0, CASE WHEN r.b0 <= a.b0 + slack THEN greatest(a.b0, least(r.b1, a.b1 - keep)) ELSE a.b0 END + keep)) ELSE a.b1 END,
    'score': CASE WHEN r.b0 > a.b0 + slack AND r.b1 < a.b1 - slack THEN greatest(a.score, r.score) ELSE a.score END}}, {{'b0': y0, 'b1': y1, 'score': NULL::DOUBLE}}) AS t FROM p)
SELECT strip, id, t.b0::BIGINT AS p0, t.b1::BIGINT AS p1, CASE WHEN (CASE WHEN blanks THEN t.score ELSE doubt END) IS NOT NULL THEN 'suspicious' END AS flag, CASE WHEN blanks THEN t.score ELSE doubt END AS score
FROM t WHERE n::DOUBLE / (y1 - y0) < 0.95 AND NOT (len(coalesce(cut, [])) > 0 AND t.b1 - t.b0 < least(30, keep))""")
def c17_without_blanks(spark, folder):
    s = spans(spark, folder)
    b0 = F.col("y0") + 60 * (F.col("k") % 4 - 1)
    regions = s.where("k % 3 = 0").select("strip", b0.alias("b0"), (b0 + 90 + F.col("y1") % 900).alias("b1"), (F.col("y0") % 100 / 100.0).alias("score"), F.when(F.col("k") % 5 == 0, "suspicious").otherwise("blank").alias("verdict"))
    return I.without_blanks(s.select("strip", F.col("k").alias("id"), F.col("y0").alias("p0"), F.col("y1").alias("p1")), regions)


@query(f"""WITH s AS (SELECT {_STRIP_SQL} FROM lineitem), f AS (SELECT strip, greatest(y0 - 20, 0) AS f0, y1 + 20 AS f1 FROM s WHERE k % 2 = 0 AND y1 - y0 <= 900)
SELECT strip, k, y0, y1 FROM s WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.strip = s.strip AND f0 < y1 AND y0 < f1)""")
def c07_free_of_bubbles(spark, folder):
    s = spans(spark, folder)
    bubbles = s.where("k % 2 = 0 and y1 - y0 <= 900").select("strip", F.greatest(F.col("y0") - 20, F.lit(0)).alias("f0"), (F.col("y1") + 20).alias("f1"))
    cuts = s.where("k % 2 = 1").drop("text")
    hit = I.overlapping(cuts, bubbles, "strip", ("y0", "y1"), ("f0", "f1")).select("strip", "k").distinct()
    return cuts.join(hit, ["strip", "k"], "left_anti")


@query("""SELECT p_partkey, page, band, row_number() OVER (PARTITION BY page ORDER BY band, x, p_partkey) AS place FROM (
  SELECT *, sum(CASE WHEN top IS NULL OR y >= top THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, p_partkey)::BIGINT AS band FROM (
    SELECT *, max(y + h) OVER (PARTITION BY page ORDER BY y, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
      SELECT p_partkey, p_partkey // 12 AS page, p_partkey * 53 % 400 AS x, p_partkey * 97 % 900 AS y, p_size * 3 AS h FROM part)))""")
def c12_reading_order(spark, folder):
    p = F.col("p_partkey")
    boxes = table(spark, folder, "part").select(p, p.alias("id"), F.floor(p / 12).alias("page"), (p * 53 % 400).alias("x"), (p * 97 % 900).alias("y"), (F.col("p_size") * 2).alias("w"), (F.col("p_size") * 3).alias("h"))
    return I.reading_order(boxes).select("p_partkey", "page", "band", "place")


@query(f"""WITH s AS (SELECT {_STRIP_SQL} FROM lineitem), b AS (SELECT strip, y0 + 30 AS b0, y0 + 330 AS b1, y0 % 100 / 100.0::DOUBLE AS score FROM s WHERE k % 3 = 0),
  c AS (SELECT s.strip, k, sum(least(y1, b1) - greatest(y0, b0)) AS n, count(*) AS regions, max(score) AS score FROM s JOIN b ON b.strip = s.strip AND b0 < y1 AND y0 < b1 GROUP BY s.strip, k)
SELECT s.strip, s.k AS id, round(coalesce(n::DOUBLE / (y1 - y0), 0.0), 6) AS share, coalesce(regions, 0) AS regions, score, coalesce(n::DOUBLE / (y1 - y0), 0.0) >= 0.95 AS dropped FROM s LEFT JOIN c ON c.strip = s.strip AND c.k = s.k""")
def c17_blank_cover(spark, folder):
    s = spans(spark, folder)
    blanks = s.where("k % 3 = 0").select("strip", (F.col("y0") + 30).alias("b0"), (F.col("y0") + 330).alias("b1"), (F.col("y0") % 100 / 100.0).alias("score"))
    out = I.covered(s.select("strip", F.col("k").alias("id"), F.col("y0").alias("p0"), F.col("y1").alias("p1")), blanks)
    return out.select("strip", "id", F.round("share", 6).alias("share"), "regions", "score", "dropped")


@query(f"""WITH s AS (SELECT {_STRIP_SQL} FROM lineitem), p AS (SELECT s.strip, s.k, s.y0, s.y1, o.k AS other, (least(s.y1, o.y1) - greatest(s.y0, o.y0))::DOUBLE / (greatest(s.y1, o.y1) - least(s.y0, o.y0)) AS iou
    FROM s JOIN s o ON o.strip = s.strip AND o.k < s.k AND o.y0 < s.y1 AND s.y0 < o.y1),
  f AS (SELECT * FROM p WHERE iou >= 0.30 QUALIFY row_number() OVER (PARTITION BY strip, k ORDER BY other) = 1)
SELECT s.strip, s.k, s.y0, s.y1, f.other, round(f.iou, 6) AS iou, f.iou >= 0.85 AS duplicate FROM s LEFT JOIN f ON f.strip = s.strip AND f.k = s.k""")
def d04_first_overlap(spark, folder):
    return I.first_overlap(spans(spark, folder).drop("text"))


@query(f"""WITH s AS (SELECT {_STRIP_SQL} FROM lineitem), p AS (SELECT strip, k AS id, y0 AS p0, y1 AS p1 FROM s WHERE k % 2 = 1), e AS (SELECT strip, k, y0 AS e0, y1 AS e1, text FROM s WHERE k % 2 = 0),
  b AS (SELECT p.strip, id, text, least(p1, e1) - greatest(p0, e0) AS overlap FROM p JOIN e ON e.strip = p.strip AND e0 < p1 AND p0 < e1 QUALIFY row_number() OVER (PARTITION BY p.strip, id ORDER BY least(p1, e1) - greatest(p0, e0) DESC, k) = 1)
SELECT p.strip, p.id, b.text, b.overlap FROM p LEFT JOIN b ON b.strip = p.strip AND b.id = p.id""")
def e02_best_overlap(spark, folder):
    s = spans(spark, folder)
    panels = s.where("k % 2 = 1").select("strip", F.col("k").alias("id"), F.col("y0").alias("p0"), F.col("y1").alias("p1"))
    entries = s.where("k % 2 = 0").select("strip", "k", F.col("y0").alias("e0"), F.col("y1").alias("e1"), "text")
    return I.best_overlap(panels, entries).select("strip", "id", "text", "overlap")


@query(f"""WITH RECURSIVE s AS (SELECT strip, y0, y1, text, row_number() OVER (PARTITION BY strip ORDER BY y0, y1, text) AS n FROM (SELECT {_STRIP_SQL} FROM lineitem)),
  f AS (SELECT strip, 1::BIGINT AS n, y0, y1, text, y1 - y0 AS longest, 1::BIGINT AS idx FROM s WHERE n = 1 UNION ALL
    SELECT f.strip, s.n, CASE WHEN same THEN least(f.y0, s.y0) ELSE s.y0 END, CASE WHEN same THEN greatest(f.y1, s.y1) ELSE s.y1 END, CASE WHEN same AND s.y1 - s.y0 <= longest THEN f.text ELSE s.text END,
      CASE WHEN same THEN greatest(longest, s.y1 - s.y0) ELSE s.y1 - s.y0 END, CASE WHEN same THEN idx ELSE idx + 1 END
    FROM f JOIN s ON s.strip = f.strip AND s.n = f.n + 1, LATERAL (SELECT least(f.y1, s.y1) - greatest(f.y0, s.y0) > 0 AND (least(f.y1, s.y1) - greatest(f.y0, s.y0))::DOUBLE / least(f.y1 - f.y0, s.y1 - s.y0) >= 0.5 AS same) l)
SELECT strip, idx, arg_max(y0, n) AS y0, arg_max(y1, n) AS y1, arg_max(text, n) AS text FROM f GROUP BY strip, idx""")
def e03_stitched(spark, folder):
    rows = spans(spark, folder)
    strips = rows.groupBy("strip").agg(F.collect_list(F.struct("y0", "y1", "text")).alias("e")).select("strip", F.posexplode(I.stitched(F.col("e"))).alias("i", "m"))
    return strips.select("strip", (F.col("i") + 1).cast("long").alias("idx"), "m.y0", "m.y1", "m.text")


@query("""WITH b AS (SELECT user_id AS strip, list_sort(list_distinct(list(least(greatest((value * 20)::BIGINT, 0), 2000)))) AS b FROM events GROUP BY user_id)
SELECT strip, i::INTEGER AS slot, b[i + 1] AS y0, b[i + 2] AS y1 FROM (SELECT *, unnest(range(0, len(b) - 1)) AS i FROM b) WHERE b[i + 2] - b[i + 1] >= 30""")
def e17_boundary_ranges(spark, folder):
    rows = table(spark, folder, "events").groupBy(F.col("user_id").alias("strip")).agg(F.collect_list(F.bround(F.col("value") * 20).cast("long")).alias("b"))
    return rows.select("strip", F.explode(I.boundary_ranges(F.col("b"), F.lit(2000).cast("long"))).alias("r")).select("strip", "r.slot", "r.y0", "r.y1")


@query("""SELECT vec_id, kind, count(*) OVER (PARTITION BY label, grp) AS shot_frames FROM (SELECT *, sum((kind = 'cut')::INT) OVER (PARTITION BY label ORDER BY vec_id) AS grp FROM (
  SELECT vec_id, label, CASE WHEN d IS NULL THEN 'first' WHEN d < 0.02 THEN 'static' WHEN d > 0.25 THEN 'cut' ELSE 'motion' END AS kind FROM (
    SELECT vec_id, label, abs(embedding[1]::DOUBLE - lag(embedding[1]::DOUBLE) OVER (PARTITION BY label ORDER BY vec_id)) AS d FROM embeddings)))""")
def c19_motion_grammar(spark, folder):
    w = Window.partitionBy("label").orderBy("vec_id")
    level = F.col("embedding")[0].cast("double")
    d = F.abs(level - F.lag(level).over(w))
    kind = F.when(d.isNull(), "first").when(d < 0.02, "static").when(d > 0.25, "cut").otherwise("motion")
    shots = table(spark, folder, "embeddings").withColumn("kind", kind).withColumn("grp", F.sum((F.col("kind") == "cut").cast("int")).over(w))
    return shots.select("vec_id", "kind", F.count(F.lit(1)).over(Window.partitionBy("label", "grp")).alias("shot_frames"))


_TILED = """SELECT conv_id AS strip, turn AS k, turn * 1800 AS base, length(coalesce(text, '')) AS n, sha256(coalesce(text, '')) AS text FROM conversations"""


@query(f"""WITH RECURSIVE t AS ({_TILED}), raw AS (SELECT strip, base, text, n, 0 AS j FROM t UNION ALL SELECT strip, base, text, n, 1 FROM t),
  e AS (SELECT strip, greatest(base + j * 1700 - n % 300, 0) AS y0, least(base + j * 1700 + 250 + n % 400, 9000) AS y1, text, [{{'x': n % 90, 'y': base + n % 70, 'w': 10::BIGINT, 'h': 20 + j}}] AS boxes FROM raw),
  s AS (SELECT *, row_number() OVER (PARTITION BY strip ORDER BY y0, y1, text) AS n FROM e WHERE y0 < y1),
  f AS (SELECT strip, 1::BIGINT AS n, y0, y1, text, y1 - y0 AS longest, boxes, 1::BIGINT AS idx FROM s WHERE n = 1 UNION ALL
    SELECT f.strip, s.n, CASE WHEN same THEN least(f.y0, s.y0) ELSE s.y0 END, CASE WHEN same THEN greatest(f.y1, s.y1) ELSE s.y1 END, CASE WHEN same AND s.y1 - s.y0 <= longest THEN f.text ELSE s.text END,
      CASE WHEN same THEN greatest(longest, s.y1 - s.y0) ELSE s.y1 - s.y0 END, CASE WHEN same THEN list_concat(f.boxes, s.boxes) ELSE s.boxes END, CASE WHEN same THEN idx ELSE idx + 1 END
    FROM f JOIN s ON s.strip = f.strip AND s.n = f.n + 1, LATERAL (SELECT least(f.y1, s.y1) - greatest(f.y0, s.y0) > 0 AND (least(f.y1, s.y1) - greatest(f.y0, s.y0))::DOUBLE / least(f.y1 - f.y0, s.y1 - s.y0) >= 0.5 AS same) l),
  m AS (SELECT strip, idx, arg_max(y0, n) AS y0, arg_max(y1, n) AS y1, arg_max(text, n) AS text, arg_max(boxes, n) AS boxes FROM f GROUP BY strip, idx)
SELECT strip, idx, y0, y1, text, array_to_string(list_transform(boxes, lambda b: concat_ws(' ', b.x, b.y, b.w, b.h)), ',') AS boxes FROM m""")
def e03_stitched_boxes(spark, folder):
    """Every turn is a tile of 2000 rows with an entry at its top and one at its foot."""
    t = table(spark, folder, "conversations").select(F.col("conv_id").alias("strip"), (F.col("turn") * 1800).alias("base"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    entry = lambda j: F.struct((j * 1700 - F.col("n") % 300).alias("y0"), (j * 1700 + 250 + F.col("n") % 400).alias("y1"), "text", F.array(F.struct((F.col("n") % 90).alias("x"), (F.col("n") % 70).alias("y"), F.lit(10).cast("long").alias("w"), F.lit(20 + j).cast("long").alias("h"))).alias("boxes"))
    moved = t.select("strip", I.on_strip(F.col("base"), F.lit(9000).cast("long"), F.array(entry(0), entry(1))).alias("e"))
    strips = moved.groupBy("strip").agg(F.flatten(F.collect_list("e")).alias("e")).select("strip", F.posexplode(I.stitched(F.col("e"), boxes=True)).alias("i", "m"))
    boxes = F.array_join(F.transform("m.boxes", lambda b: F.concat_ws(" ", b["x"], b["y"], b["w"], b["h"])), ",")
    return strips.select("strip", (F.col("i") + 1).cast("long").alias("idx"), "m.y0", "m.y1", "m.text", boxes.alias("boxes"))


@query("""WITH d AS (SELECT doc_id, 400 + doc_id % 7 * 100 AS w, 1000 + doc_id % 11 * 300 AS h, 800 AS pw, 2000 AS ph, n_chars AS n FROM documents),
  g AS (SELECT *, abs(pw::DOUBLE / ph - w::DOUBLE / h) / (pw::DOUBLE / ph) AS gap FROM d)
SELECT doc_id, CASE WHEN w = pw AND h = ph OR gap <= 0.05 THEN round_even(n * (h::DOUBLE / ph), 0)::BIGINT END AS y0, CASE WHEN w = pw AND h = ph OR gap <= 0.05 THEN round_even(n % 97 * (w::DOUBLE / pw), 0)::BIGINT END AS x,
  NOT (w = pw AND h = ph) AND gap <= 0.05 AS scaled, CASE WHEN NOT (w = pw AND h = ph) AND gap > 0.05 THEN 'aspect' END AS problem FROM g""")
def b34_plan_to_strip(spark, folder):
    from panelframe.functions import geometry as G

    n = F.col("n_chars")
    entries = F.array(F.struct(n.alias("y0"), (n + 10).alias("y1"), F.array(F.struct((n % 97).alias("x"), n.alias("y"), F.lit(1).alias("w"), F.lit(2).alias("h"))).alias("boxes")))
    d = table(spark, folder, "documents").withColumn("r", G.rescaled(entries, (F.lit(800), F.lit(2000)), (400 + F.col("doc_id") % 7 * 100, 1000 + F.col("doc_id") % 11 * 300)))
    return d.select("doc_id", F.get("r.entries", F.lit(0))["y0"].alias("y0"), F.get(F.get("r.entries", F.lit(0))["boxes"], F.lit(0))["x"].alias("x"), "r.scaled", "r.problem")
