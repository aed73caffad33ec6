"""Row-metric and document queries: events of a user stand for the rows of a strip, conversations for files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelframe.operators import folds, intervals
from panelframe.operators import pixels as P
from panelframe.plans import interval_queries as IQ
from panelframe.plans.registry import query, table
from panelframe.sources import documents as D


def metrics(spark, folder):
    """Rows of strips with metrics, from events: quiet where the value is small."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.col("value")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("strip"), (F.row_number().over(w) - 1).cast("int").alias("y"), (v % 24).alias("variance"), (v % 12).alias("edge"), (v % 5).alias("entropy"), (v % 28).alias("saturated"),
        (v % 12).alias("plain_edge"), (v % 24).alias("plain_variance"), (v % 28).alias("spread"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: (b == F.floor(v) % 64).cast("int") * 10).alias("histogram"),
        (v % 3 / 100).alias("foreground"), (v % 9 + 100).alias("mean"), F.round(v).alias("level"), (v < 30).alias("flat"), F.when(v < 60, 0.95).otherwise(0.4).alias("mono"), (v % 7 / 7).alias("white"), (v % 11 / 11).alias("dark"),
    )


_M = """m AS (SELECT user_id AS strip, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS y, value % 24 AS variance, value % 12 AS edge, value % 5 AS entropy, value % 28 AS saturated, value % 28 AS spread, floor(value)::BIGINT % 64 AS bin, value % 3 / 100 AS foreground, value % 9 + 100 AS mean,
  round(value) AS level, value < 30 AS flat, CASE WHEN value < 60 THEN 0.95 ELSE 0.4 END AS mono, value % 7 / 7 AS white, value % 11 / 11 AS dark FROM events)"""


@query(f"""WITH {_M}, e AS (SELECT *, y < 12 OR y > max(y) OVER (PARTITION BY strip) - 12 AS edge_row FROM m)
SELECT strip, coalesce(quantile_cont(level, 0.5) FILTER (edge_row AND flat), (SELECT level FROM m x WHERE x.strip = e.strip AND mono >= 0.9 GROUP BY level ORDER BY count(*) DESC, level LIMIT 1)) AS background FROM e GROUP BY strip""")
def c03_background(spark, folder):
    return P.background(metrics(spark, folder))


@query(f"""WITH {_M}, b AS (SELECT strip, y // 4 AS w, bin, count(*) AS n FROM m GROUP BY ALL), e AS (SELECT strip, w, sum(-n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY strip, w)::DOUBLE AS t FROM b) GROUP BY ALL)
SELECT strip, w, round(avg(variance), 6) AS variance, round(avg(edge), 6) AS edge, round(any_value(e.entropy), 6) AS entropy, round(avg(spread), 6) AS spread, round(avg(mean), 6) AS mean,
  round(avg(variance + mean * mean) FILTER (y % 2 = 0), 6) AS coarse_square FROM (SELECT *, (y // 4)::BIGINT AS w FROM m) JOIN e USING (strip, w) GROUP BY strip, w HAVING count(*) = 4 OR w = 0""")
def c11_windows(spark, folder):
    return P.windows(metrics(spark, folder), 4).select("strip", "w", *[F.round(c, 6).alias(c) for c in ("variance", "edge", "entropy", "spread", "mean", "coarse_square")])


_UNDER = lambda v, t: f"least(greatest(1.0 - {v} / {t}, 0.0), 1.0)"
_SCORE = lambda v, e, n, s, f: f"0.25 * {_UNDER(v, 12.0)} + 0.25 * {_UNDER(e, 6.0)} + 0.20 * {_UNDER(n, 2.2)} + 0.15 * {_UNDER(s, 14.0)} + 0.15 * {_UNDER(f, 0.2)}"


@query(f"SELECT vec_id, round({_SCORE('abs(embedding[1]) * 24', 'abs(embedding[2]) * 12', 'abs(embedding[3]) * 4', 'abs(embedding[4]) * 28', 'abs(embedding[5]) / 4')}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def b24_blank_score(spark, folder):
    e = lambda k, f: F.abs(F.col("embedding")[k].cast("double")) * f
    score = P.blank_score(e(0, 24), e(1, 12), e(2, 4), e(3, 28), e(4, 0.25))
    return table(spark, folder, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query(f"""WITH {_M}, w AS (SELECT strip, y AS w, variance * 0.7 AS variance, edge * 0.7 AS edge, entropy * 0.6 AS entropy, saturated AS spread, foreground, mean, variance * 0.7 + mean * mean AS square, (bin > 24)::INT AS c0, bin % 3 AS c1 FROM m),
  o AS (SELECT *, w - lag(w) OVER (PARTITION BY strip ORDER BY w) AS d FROM w WHERE variance <= 12 AND edge <= 6 AND entropy <= 2.2), r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY strip ORDER BY w) AS run FROM o),
  l AS (SELECT strip, max(w) AS last, (max(w) + 1) * 16 AS height FROM w GROUP BY strip), s AS (SELECT r.strip, min(w) AS w0, CASE WHEN any_value(last) - max(w) <= 2 THEN any_value(last) ELSE max(w) END AS w1, any_value(height) AS height FROM r JOIN l USING (strip) GROUP BY r.strip, run),
  a AS (SELECT s.strip, w0, w1, any_value(height) AS height, avg(variance) AS v, avg(edge) AS e, avg(entropy) AS n, avg(spread) AS sa, avg(foreground) AS f, max(mean) - min(mean) AS drift, avg((foreground >= 0.05)::INT) AS content,
    avg(square) - avg(mean) * avg(mean) AS v2, sum(c0)::DOUBLE AS c0, sum(c1)::DOUBLE AS c1 FROM s JOIN w ON w.strip = s.strip AND w.w BETWEEN w0 AND w1 GROUP BY s.strip, w0, w1),
  b AS (SELECT *, w0 * 16 AS y0, least((w1 + 1) * 16, height) AS y1, {_SCORE('v', 'e', 'n', 'sa', 'f')} AS whole, CASE WHEN c0 > 0 THEN -c0 / (c0 + c1) * log2(c0 / (c0 + c1)) ELSE 0 END + CASE WHEN c1 > 0 THEN -c1 / (c0 + c1) * log2(c1 / (c0 + c1)) ELSE 0 END AS n2 FROM a),
  h AS (SELECT *, CASE WHEN whole >= 0.65 AND (v2 > 24 OR n2 > 2.2) THEN whole / 2 ELSE whole END AS score FROM b),
  c AS (SELECT *, CASE WHEN score >= 0.90 AND content < 0.02 AND drift <= 10 THEN 'blank' WHEN score >= 0.65 THEN 'suspicious' ELSE 'normal' END AS verdict FROM h WHERE y1 - y0 >= greatest(24, (height * 0.04)::DOUBLE - 0.5))
SELECT strip, y0::BIGINT AS y0, y1::BIGINT AS y1, round(score, 3) AS score, verdict FROM c WHERE verdict <> 'normal' AND NOT (verdict = 'blank' AND y1 - y0 <= trunc(height * 0.10))""")
def c13_blank_regions(spark, folder):
    rows = metrics(spark, folder)
    bin_ = F.array_position("histogram", 10) - 1
    w = rows.select(
        "strip", F.col("y").alias("w"), (F.col("variance") * 0.7).alias("variance"), (F.col("edge") * 0.7).alias("edge"), (F.col("entropy") * 0.6).alias("entropy"), "spread", "foreground", "mean",
        F.col("mean").alias("coarse_mean"), (F.col("variance") * 0.7 + F.col("mean") * F.col("mean")).alias("coarse_square"), F.array((bin_ > 24).cast("long"), bin_ % 3).alias("coarse"),
    )
    return P.blank_regions(w, w.groupBy("strip").agg(((F.max("w") + 1) * 16).alias("height")), whole=lambda c: F.ceil(c - 0.5)).drop("reasons")


@query(f"""WITH {_M}, c AS (SELECT strip, y0, y0 + 7 AS y1 FROM (SELECT DISTINCT strip, y - y % 9 AS y0 FROM m) )
SELECT c.strip, c.y0, c.y1, round(avg(variance), 6) AS variance, round(avg(edge), 6) AS edge, round(avg(white) + avg(dark), 6) AS two_tone FROM c JOIN m ON m.strip = c.strip AND y >= y0 AND y < y1 WHERE c.y1 <= (SELECT max(y) + 1 FROM m x WHERE x.strip = c.strip) GROUP BY ALL""")
def c15_crop_scores(spark, folder):
    rows = metrics(spark, folder)
    crops = rows.select("strip", (F.col("y") - F.col("y") % 9).alias("y0")).distinct().withColumn("y1", F.col("y0") + 7).withColumn("id", F.col("y0"))
    s = P.crop_scores(rows, crops).where("method = 'strip'")
    return s.select("strip", "y0", "y1", *[F.round(c, 6).alias(c) for c in ("variance", "edge", "two_tone")])


@query(f"""WITH {_M}, s AS (SELECT strip, min(y) FILTER (NOT flat) AS a, max(y) FILTER (NOT flat) AS b, max(y) + 1 AS h FROM m GROUP BY strip), t AS (SELECT *, least(a, h // 4) AS t, least(h - 1 - b, h // 4) AS f FROM s)
SELECT strip, (CASE WHEN a IS NULL OR h - t - f < 16 OR t + f < 1 THEN 0 ELSE t END)::INTEGER AS top, (CASE WHEN a IS NULL OR h - t - f < 16 OR t + f < 1 THEN h ELSE h - f END)::INTEGER AS bottom FROM t""")
def c16_trimmed(spark, folder):
    return P.trimmed(metrics(spark, folder), keep=16, least=1)


# The first thin panel joins its taller neighbour, the upper one on ties, again and again.
@query(f"""WITH RECURSIVE {IQ._GUTTERS}, hs AS (SELECT strip, max(y) + 1 AS h FROM r GROUP BY strip),
  b AS (SELECT strip, list_concat(list_concat([0::BIGINT], coalesce(list_sort(list(DISTINCT mid) FILTER (mid > 0 AND mid < h)), [])), [max(h)]) AS e FROM hs LEFT JOIN v USING (strip) GROUP BY strip),
  z AS (SELECT strip, e, 0 AS n FROM b UNION ALL
    SELECT strip, list_concat(e[1:gone - 1], e[gone + 1:]), n + 1 FROM (SELECT *, CASE WHEN coalesce(e[i] - e[nullif(i - 1, 0)], -1) >= coalesce(e[i + 2] - e[i + 1], -1) THEN i ELSE i + 1 END AS gone
      FROM (SELECT *, CASE WHEN len(e) > 2 THEN list_min(list_filter(range(1, len(e)), lambda i: e[i + 1] - e[i] < 8)) END AS i FROM z)) WHERE i IS NOT NULL),
  l AS (SELECT strip, arg_max(e, n) AS e FROM z GROUP BY strip)
SELECT strip, k::INTEGER AS k, e[k + 1] AS y0, e[k + 2] AS y1 FROM (SELECT *, unnest(range(0, len(e) - 1)) AS k FROM l)""")
def c09_absorbed(spark, folder):
    rows = IQ.row_metrics(spark, folder)
    heights = rows.groupBy("strip").agg((F.max("y") + 1).alias("height"))
    cuts = heights.join(intervals.gutters(rows, IQ.marks(spark, folder)).select("strip", F.col("mid").alias("cut")), "strip", "left")
    return folds.absorb_thin(cuts, 8)


# The gutter nearest to the middle of what is over so many rows, the upper one on ties, that leaves both sides a quarter and 50 rows.
_split = lambda most: f"""CASE WHEN y1 - y0 > {most} THEN list_sort(list_transform(list_filter(g, lambda m: m BETWEEN y0 + greatest(50, (y1 - y0) // 4) AND y1 - greatest(50, (y1 - y0) // 4)), lambda m: {{'d': abs(m - (y0 + y1) // 2), 'm': m}}))[1].m END"""
_SPLIT = _split(400)


@query(f"""WITH RECURSIVE {IQ._GUTTERS}, mids AS (SELECT strip, list(mid * 40) AS g FROM v GROUP BY strip),
  t AS (SELECT strip, 'p' AS id, 0::BIGINT AS y0, h * 40 AS y1, coalesce(g, []) AS g FROM (SELECT strip, max(y) + 1 AS h FROM r GROUP BY strip) LEFT JOIN mids USING (strip)
    UNION ALL SELECT strip, unnest([id || 'a', id || 'b']), unnest([y0, cut]), unnest([cut, y1]), g FROM (SELECT *, {_split(1600)} AS cut FROM t) WHERE cut IS NOT NULL)
SELECT strip, id, y0, y1 FROM t WHERE {_split(1600)} IS NULL""")
def c10_split(spark, folder):
    rows = IQ.row_metrics(spark, folder)
    panels = rows.groupBy("strip").agg((F.max("y") + 1).alias("y1")).select("strip", F.lit("p").alias("id"), F.lit(0).cast("long").alias("y0"), "y1")
    return folds.split_oversized(panels.withColumn("y1", F.col("y1") * 40), intervals.gutters(rows, IQ.marks(spark, folder)).withColumn("mid", F.col("mid") * 40), 1600)


@query(f"""WITH RECURSIVE {IQ._GUTTERS}, hs AS (SELECT strip, max(y) + 1 AS h FROM r GROUP BY strip),
  o AS (SELECT strip, mid, row_number() OVER (PARTITION BY strip ORDER BY mid) AS n FROM v),
  f AS (SELECT strip, 0::BIGINT AS n, 0::BIGINT AS last, [0::BIGINT] AS cuts FROM hs UNION ALL
    SELECT f.strip, o.n, CASE WHEN mid - last >= 8 THEN mid ELSE last END, CASE WHEN mid - last >= 8 THEN list_append(cuts, mid) ELSE cuts END FROM f JOIN o ON o.strip = f.strip AND o.n = f.n + 1),
  e AS (SELECT strip, h, CASE WHEN cuts[-1] < h - 8 THEN list_append(cuts, h) WHEN cuts[-1] <> h THEN list_append(cuts[1:len(cuts) - 1], h) ELSE cuts END AS c FROM (SELECT strip, arg_max(cuts, n) AS cuts FROM f GROUP BY strip) JOIN hs USING (strip)),
  mids AS (SELECT strip, list(mid * 40) AS g FROM v GROUP BY strip),
  p AS (SELECT strip, c[i] * 40 AS y0, c[i + 1] * 40 AS y1, coalesce(g, []) AS g FROM (SELECT *, unnest(range(1, len(c))) AS i FROM e) LEFT JOIN mids USING (strip)),
  t AS (SELECT strip, y0, y1, g, 0 AS level FROM p WHERE y1 - y0 >= 5
    UNION ALL SELECT strip, unnest([y0, cut]), unnest([cut, y1]), g, level + 1 FROM (SELECT *, {_SPLIT} AS cut FROM t) WHERE cut IS NOT NULL)
SELECT strip, row_number() OVER (PARTITION BY strip ORDER BY y0) AS panel_index, y0, y1, 'unknown' AS panel_type, 0.0::DOUBLE AS confidence FROM t WHERE {_SPLIT} IS NULL""")
def c21_fallback_plan(spark, folder):
    """Each row stands for 40; panels over 400 are split where a gutter leaves both sides enough."""
    rows = IQ.row_metrics(spark, folder)
    found = intervals.gutters(rows, IQ.marks(spark, folder))
    return folds.fallback_plan(rows.select("strip", (F.col("y") * 40 + 39).alias("y")), found.select("strip", (F.col("mid") * 40).alias("mid")), 320, 400)


@query(f"""WITH {_M}, c AS (SELECT strip, y0, y0 + 7 AS y1 FROM (SELECT DISTINCT strip, y - y % 9 AS y0 FROM m)), l AS (SELECT strip, max(y) + 1 AS h FROM m GROUP BY strip),
  s AS (SELECT c.strip, c.y0, avg(variance) AS variance, avg(edge) AS edge FROM c JOIN m ON m.strip = c.strip AND y >= y0 AND y < y1 JOIN l ON l.strip = c.strip AND c.y1 <= h WHERE y0 % 2 = 0 GROUP BY ALL), f AS (SELECT strip, y0, y0 / 2.0::DOUBLE AS variance, 1.0::DOUBLE AS edge FROM c WHERE y0 % 3 = 0)
SELECT c.strip, c.y0 AS id, round(coalesce(s.variance, f.variance), 6) AS variance, round(coalesce(s.edge, f.edge), 6) AS edge, CASE WHEN s.variance IS NOT NULL THEN 'strip_crop' WHEN f.variance IS NOT NULL THEN 'padding_stripped' ELSE 'missing' END AS method
FROM c LEFT JOIN s ON s.strip = c.strip AND s.y0 = c.y0 LEFT JOIN f ON f.strip = c.strip AND f.y0 = c.y0""")
def c23_score_sources(spark, folder):
    """Every second panel has no rows of its own in the strip, every third one a file."""
    rows = metrics(spark, folder)
    panels = rows.select("strip", (F.col("y") - F.col("y") % 9).cast("int").alias("id")).distinct()
    crops = P.crop_scores(rows, panels.select("strip", "id", F.col("id").alias("y0"), (F.col("id") + F.when(F.col("id") % 2 == 0, 7).otherwise(0)).alias("y1")))
    files = panels.where("id % 3 = 0").select("strip", "id", (F.col("id") / 2).alias("variance"), F.lit(1.0).alias("edge"))
    scored = P.source_of_scores(panels, crops, files, ["variance", "edge"])
    return scored.select("strip", "id", F.round("variance", 6).alias("variance"), F.round("edge", 6).alias("edge"), "method")


@query("""SELECT conv_id, turn, h, coalesce(sum(h) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y_offset, max(w) OVER (PARTITION BY conv_id) AS strip_width FROM (SELECT conv_id, turn, 100 + length(coalesce(text, '')) % 900 AS h, 300 + length(coalesce(text, '')) % 500 AS w FROM conversations)""")
def a05_stitched_offsets(spark, folder):
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    pages = table(spark, folder, "conversations").select("conv_id", "turn", (100 + n % 900).alias("h"), (300 + n % 500).alias("w"))
    return D.stitched_offsets(pages, "conv_id", "turn").select("conv_id", "turn", "h", "y_offset", "strip_width")


@query("""SELECT conv_id, array_to_string(list_filter([CASE WHEN sum(n) > 4000 THEN 'bytes' END, CASE WHEN max(n % 500 * (n % 900)) > 150000 THEN 'pixels' END, CASE WHEN count(*) > 5 THEN 'images' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT conv_id, length(coalesce(text, '')) AS n FROM conversations) GROUP BY conv_id""")
def a04_archive_limits(spark, folder):
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    pages = table(spark, folder, "conversations").select("conv_id", n.alias("bytes"), (n % 500).alias("w"), (n % 900).alias("h"))
    return D.archive_limits(pages, "conv_id", 4000, 150_000, 5).select("conv_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT conv_id, turn, turn + 1 AS number, turn * 61.5::DOUBLE AS start, turn * 61.5::DOUBLE + 2.25 AS "end", trim(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', ' ', 'g')) AS caption FROM conversations""")
def a10_srt_parse_whole(spark, folder):
    return parsed(spark, folder, F.coalesce("text", F.lit("")))


def parsed(spark, folder, caption):
    from panelframe.functions.text import srt_time

    t = F.col("turn")
    blocks = F.concat_ws("\n", t + 1, F.concat(srt_time(t * 61.5), F.lit(" --> "), srt_time(t * 61.5 + 2.25)), caption)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", blocks.alias("block"))
    return D.srt_cues(rows).drop("block")


@query("""SELECT event_id, i::INTEGER AS pos, (props::JSON->>'k')::BIGINT AS k FROM (SELECT event_id, props, unnest(range(0, event_id % 4)) AS i FROM events)""")
def b32_salvage(spark, folder):
    lines = F.array_join(F.array_repeat("props", 5), ", ")
    n = (F.col("event_id") % 4).cast("int")
    whole = F.array_join(F.slice(F.array_repeat("props", 5), F.lit(1), n), ", ")
    cut = F.concat(F.lit('note {"lines": ['), whole, F.when(n > 0, ", ").otherwise(""), F.substring(lines, 1, 4))
    rows = table(spark, folder, "events").select("event_id", cut.alias("t"))
    return D.salvaged(rows, "event_id", "t").select("event_id", "pos", F.get_json_object("item", "$.k").cast("bigint").alias("k"))


@query("""SELECT kind, source, row_number() OVER (PARTITION BY kind ORDER BY source) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM (
  SELECT kind, kind || '/' || p_partkey || '.wav' AS source FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'transition' WHEN 1 THEN 'action' ELSE 'default' END AS kind FROM part) WHERE kind <> 'default'
  UNION ALL SELECT 'reveal', 'default/' || p_partkey || '.wav' FROM part WHERE p_size % 4 = 2)""")
def a08_sound_bank(spark, folder):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "transition").when(k == 1, "action").otherwise("default")
    files = table(spark, folder, "part").select(F.concat(name, F.lit("/"), "p_partkey", F.when(k == 3, ".txt").otherwise(".wav")).alias("source"))
    return D.sound_bank(files, ["transition", "action", "reveal"])
