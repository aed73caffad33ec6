"""Timeline queries: conversations stand for chapters, turns for panels, system turns for context-only panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelframe.functions import geometry as G
from panelframe.functions import text as X
from panelframe.operators import timeline as TL
from panelframe.plans import sql as S
from panelframe.plans.registry import query, table


def chapters(spark, folder):
    """Panels of chapters, from conversations."""
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("narration"))
    n = F.length("narration")
    return c.select(
        "chapter", "idx", "role", F.concat_ws(".", "chapter", "idx").alias("panel_id"), "narration", F.lit("").alias("dialogue"), (F.col("role") == "system").alias("context_only"),
        F.lit(False).alias("blank"), (400 + n * 7 % 900).cast("int").alias("width"), (300 + n * 13 % 2200).cast("int").alias("height"), F.lit("p.png").alias("image_file"),
    )


def speech(panels, narration):
    """Audio of the panels that an assistant turn stands for."""
    told = panels.where("role = 'assistant'").select("chapter", "panel_id").join(narration, ["chapter", "panel_id"]).where("text <> ''")
    return told.select("chapter", "panel_id", X.round_ms_up(X.word_count(F.col("text")) / F.lit(150.0) * 60.0).alias("audio_seconds"))


def told(spark, folder):
    panels = chapters(spark, folder)
    narration = TL.build_narration(panels)
    return TL.build_timeline(panels, narration, speech(panels, narration))


def timed(rows):
    """rows with words and their times, evenly spoken, where there is audio."""
    w = F.filter(F.split(X.text(F.col("text")), " "), lambda x: x != "")
    words = F.transform(w, lambda x, i: F.struct((i * 0.4).alias("start"), (i * 0.4 + 0.35).alias("end"), x.alias("text")))
    return rows.withColumn("words", F.when(F.col("audio_seconds").isNotNull(), words))


_SPLIT = f"string_split(regexp_replace(line, {S.lit(f'({X.TERMINAL}){X.SPACE}+')}, '\\1' || chr(1), 'g'), chr(1))"
PANELS = f"""p0 AS (SELECT conv_id AS chapter, turn AS idx, role, conv_id || '.' || turn AS panel_id, coalesce(text, '') AS narration, role = 'system' AS context_only,
    (400 + length(coalesce(text, '')) * 7 % 900)::INTEGER AS width, (300 + length(coalesce(text, '')) * 13 % 2200)::INTEGER AS height FROM conversations),
  p1 AS (SELECT *, CASE WHEN regexp_matches(narration, {S.NON_LEXICAL}) THEN '' ELSE {S.normalise('narration')} END AS line FROM p0),
  s0 AS (SELECT chapter, idx, unnest({_SPLIT}) AS s, generate_subscripts({_SPLIT}, 1) AS i FROM p1 WHERE line <> ''),
  s1 AS (SELECT chapter, idx, i, s, {S.words('s')} AS w FROM s0 WHERE {S.strip('s')} <> ''),
  s2 AS (SELECT *, sum(w) OVER (PARTITION BY chapter, idx ORDER BY i) AS cum, row_number() OVER (PARTITION BY chapter, idx ORDER BY i) AS k FROM s1),
  s3 AS (SELECT chapter, idx, string_agg(s, ' ' ORDER BY i) AS kept, sum(w) AS words FROM s2 WHERE k = 1 OR (cum - w < 9 AND cum <= 9) GROUP BY ALL),
  s4 AS (SELECT chapter, idx, CASE WHEN words > 28 THEN array_to_string(list_filter(regexp_split_to_array(kept, {S.lit(X.SPACE + '+')}), lambda x: x <> '')[1:10], ' ') ELSE kept END AS short FROM s3),
  p2 AS (SELECT p1.*, CASE WHEN line = '' OR {S.words('line')} <= 28 THEN line WHEN regexp_matches({S.normalise('short')}, {S.NON_LEXICAL}) THEN '' ELSE {S.normalise('short')} END AS fitted
    FROM p1 LEFT JOIN s4 USING (chapter, idx)),
  p3 AS (SELECT *, coalesce(last_value(CASE WHEN NOT context_only AND fitted <> '' THEN fitted END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM p2),
  p4 AS (SELECT *, NOT context_only AND fitted <> '' AND fitted = previous AS repeated FROM p3)"""
_LATIN = lambda e: f"CASE WHEN regexp_matches({e}, '[^\\x00-\\x7f]') THEN {S.normalise(S.strip_non_latin(e))} ELSE {e} END"
_PROMO = lambda e: f"(regexp_matches({e}, {S.DOMAIN}) OR regexp_matches({e}, {S.PROMO}))"
NARRATION = f"""{PANELS},
  n0 AS (SELECT *, CASE WHEN context_only THEN {_LATIN('line')} ELSE {_LATIN('fitted')} END AS said0 FROM p4 WHERE NOT repeated),
  n1 AS (SELECT *, CASE WHEN regexp_matches(said0, {S.NON_LEXICAL}) OR {_PROMO('said0')} OR (context_only AND (said0 = previous OR {_PROMO('narration')})) THEN '' ELSE said0 END AS said,
    greatest(sum(CASE WHEN context_only THEN 0 ELSE 1 END) OVER (PARTITION BY chapter ORDER BY idx), 1) AS entry FROM n0),
  n AS (SELECT chapter, max(idx) FILTER (NOT context_only) AS idx, max(panel_id) FILTER (NOT context_only) AS panel_id,
    coalesce(string_agg(said, ' ' ORDER BY idx) FILTER (said <> ''), '') AS text FROM n1 GROUP BY chapter, entry HAVING max(idx) FILTER (NOT context_only) IS NOT NULL)"""
_CLASS = S.panel_class("coalesce(text, '')", "''")
TIMELINE = f"""{NARRATION},
  a AS (SELECT chapter, panel_id, {S.ms_up(f"{S.words('text')} / 150.0::DOUBLE * 60.0")} AS audio_seconds FROM n JOIN p0 USING (chapter, panel_id) WHERE role = 'assistant' AND text <> ''),
  t0 AS (SELECT p0.*, n.text, a.audio_seconds, {_CLASS.replace('text', 'n.text')} AS class FROM p0 LEFT JOIN n USING (chapter, panel_id) LEFT JOIN a USING (chapter, panel_id)),
  t1 AS (SELECT *, CASE WHEN context_only THEN 'context_only' WHEN coalesce(text, '') = '' AND audio_seconds IS NULL THEN 'silent_beat' END AS note,
    CASE class WHEN 'reveal' THEN 1.35 ELSE 1.0 END::DOUBLE AS factor FROM t0),
  t2 AS (SELECT *, CASE WHEN note = 'context_only' THEN NULL WHEN audio_seconds IS NOT NULL
      THEN {S.ms_up("least(greatest(audio_seconds, CASE class WHEN 'action' THEN 0.8 ELSE 2.0 END::DOUBLE) * factor, greatest(4.6::DOUBLE, audio_seconds))")}
      ELSE {S.ms_up(f"least(least(greatest({S.words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} / 160.0::DOUBLE * 60.0, 1.0), 12.0) * factor, 4.6::DOUBLE)")} END AS duration_seconds FROM t1),
  t AS (SELECT *, CASE WHEN duration_seconds IS NOT NULL THEN round(coalesce(sum(duration_seconds) OVER (PARTITION BY chapter ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) END AS start_seconds,
    CASE WHEN duration_seconds IS NOT NULL THEN count(duration_seconds) OVER (PARTITION BY chapter ORDER BY idx) END AS "order" FROM t2)"""


@query(f'WITH {TIMELINE} SELECT chapter, panel_id, note, "order", start_seconds, duration_seconds FROM t')
def f01_timeline(spark, folder):
    return told(spark, folder).select("chapter", "panel_id", "note", "order", "start_seconds", "duration_seconds")


@query(f"WITH {PANELS} SELECT chapter, idx, CASE WHEN context_only THEN NULL ELSE fitted END AS raw, previous, repeated FROM p4")
def f02_repeated_lines(spark, folder):
    return TL.spoken_lines(chapters(spark, folder)).select("chapter", "idx", "raw", "previous", "repeated")


@query(f"WITH {NARRATION} SELECT chapter, idx, panel_id, text FROM n")
def f03_narration(spark, folder):
    return TL.build_narration(chapters(spark, folder))


_W = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"
_CUES = f"""WITH {TIMELINE},
  w AS (SELECT *, {_W} AS w FROM t WHERE coalesce(text, '') <> '' AND start_seconds IS NOT NULL),
  many AS (SELECT *, unnest(range(0, (len(w) - 1) // 9 + 1)) AS cue FROM w WHERE audio_seconds IS NOT NULL AND len(w) >= 2),
  c AS (SELECT chapter, idx, cue, start_seconds + cue * 9 * 0.4::DOUBLE AS s, start_seconds + (least(cue * 9 + 8, len(w) - 1) * 0.4::DOUBLE + 0.35) + 0.15 AS e,
      array_to_string(w[cue * 9 + 1:cue * 9 + 9], ' ') AS caption, start_seconds + duration_seconds AS top FROM many
    UNION ALL SELECT chapter, idx, 0, start_seconds, start_seconds + coalesce(audio_seconds, duration_seconds), text, start_seconds + duration_seconds FROM w WHERE audio_seconds IS NULL OR len(w) < 2),
  cues AS (SELECT chapter, idx, cue, s, least(e, top) AS e, caption FROM c WHERE least(e, top) > s)"""


@query(f"{_CUES} SELECT chapter, idx, cue::INTEGER AS cue, round(s, 6) AS start, round(e, 6) AS \"end\", caption FROM cues")
def f04_caption_cues(spark, folder):
    cues = TL.caption_cues(timed(told(spark, folder)))
    return cues.withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))


_SRT = lambda e: f"(SELECT printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) FROM (SELECT round_even(greatest({e}, 0.0) * 1000, 0)::BIGINT AS ms))"


@query(f"""{_CUES} SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY idx, cue) AS number, {_SRT('s')} || ' --> ' || {_SRT('e')} AS times, caption FROM cues""")
def a11_srt(spark, folder):
    blocks = TL.srt_blocks(TL.caption_cues(timed(told(spark, folder))))
    lines = F.split("block", "\n")
    return blocks.select("chapter", "number", lines[1].alias("times"), lines[2].alias("caption"))


_SEG = "(VALUES " + ", ".join(str(s) for s in G.SEGMENTS) + ") s(seg, seg_dur, zoom, match_score, dx, dy, dxps, dyps)"


@query(f"""WITH {TIMELINE}, u AS (SELECT t.*, seg, seg_dur::DOUBLE AS seg_dur FROM t JOIN {_SEG} ON seg = ("order" - 1) % 8 + 1 WHERE start_seconds IS NOT NULL)
SELECT chapter, panel_id, seg::INTEGER AS seg, round(seg_dur / sum(seg_dur) OVER (PARTITION BY chapter), 6) AS rhythm,
  round(least(CASE WHEN audio_seconds > 0 OR coalesce(text, '') = '' THEN duration_seconds
    ELSE {S.ms_up("greatest(duration_seconds, seg_dur * sum(duration_seconds) OVER (PARTITION BY chapter) / sum(seg_dur) OVER (PARTITION BY chapter))")} END,
    {S.ms_up("greatest(4.6::DOUBLE, coalesce(audio_seconds, 0.0))")}), 3) AS paced_seconds FROM u""")
def f05_cyclic_segments(spark, folder):
    segments = spark.createDataFrame(G.SEGMENTS, G.SEGMENT_COLUMNS)
    paced = TL.cyclic_segments(told(spark, folder), segments)
    return paced.select("chapter", "panel_id", "seg", F.round("rhythm", 6).alias("rhythm"), F.round("paced_seconds", 3).alias("paced_seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND sum((p_size % 3 = 0)::INT) OVER (PARTITION BY p_brand ORDER BY p_partkey) % 2 = 0 THEN -1 ELSE 1 END AS split_dir FROM part""")
def f06_alternating_split(spark, folder):
    parts = table(spark, folder, "part").withColumn("chapter", F.col("p_brand")).withColumn("idx", F.col("p_partkey"))
    return TL.alternating_direction(parts, F.col("p_size") % 3 == 0).select("p_partkey", "split_dir")


def bank(spark, folder):
    """A sound bank: parts by type stand for files of the three kinds."""
    kind = F.element_at(F.array(F.lit("transition"), F.lit("action"), F.lit("reveal")), (F.col("p_size") % 3 + 1).cast("int"))
    parts = table(spark, folder, "part")
    files = parts.select(kind.alias("kind"), F.concat(kind, F.lit("/"), "p_partkey", F.lit(".wav")).alias("source"))
    w = Window.partitionBy("kind")
    return files.withColumn("k", (F.row_number().over(w.orderBy("source")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


_BANK = """bank AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY source) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM (
    SELECT kind, kind || '/' || p_partkey || '.wav' AS source FROM (SELECT p_partkey, ['transition', 'action', 'reveal'][p_size % 3 + 1] AS kind FROM part)))"""
_CUE_SQL = f"""WITH {TIMELINE}, {_BANK},
  r AS (SELECT *, sum(duration_seconds) OVER (PARTITION BY chapter) AS total, lower(regexp_extract(coalesce(text, ''), {S.SFX}, 1)) AS word,
      list_position(list_transform(CASE WHEN audio_seconds IS NULL THEN [] ELSE {_W} END, lambda x: lower(trim(x, '.,!?…"''“”’ '))), lower(regexp_extract(coalesce(text, ''), {S.SFX}, 1))) AS pos FROM t WHERE start_seconds IS NOT NULL),
  e AS (SELECT chapter, idx, panel_id, total, 'transition' AS kind, start_seconds AS moment, 'panel_cut' AS trigger FROM r WHERE "order" > 1 AND audio_seconds IS NOT NULL
    UNION ALL SELECT chapter, idx, panel_id, total, 'action', CASE WHEN word <> '' AND pos > 0 THEN start_seconds + (pos - 1) * 0.4::DOUBLE ELSE start_seconds + 0.15::DOUBLE END,
      CASE WHEN word <> '' AND pos > 0 THEN 'keyword:' || word ELSE 'panel_class:action' END FROM r WHERE class = 'action'
    UNION ALL SELECT chapter, idx, panel_id, total, 'reveal', start_seconds + 0.1::DOUBLE, 'panel_class:reveal' FROM r WHERE class = 'reveal'),
  x AS (SELECT e.*, source FROM e JOIN bank USING (kind) WHERE bank.k = ('0x' || substr(sha256(panel_id || ':' || kind), 1, 8))::BIGINT % n)
SELECT chapter, panel_id, kind, round(least(greatest(round(moment, 3), 0.0), greatest(total - 0.2::DOUBLE, 0.0)), 3) AS at_seconds, source,
  CASE kind WHEN 'transition' THEN 0.45 WHEN 'action' THEN 0.81 ELSE 0.54 END::DOUBLE AS volume, trigger,
  row_number() OVER (PARTITION BY chapter ORDER BY idx, CASE kind WHEN 'transition' THEN 0 ELSE 1 END) AS number FROM x"""


@query(_CUE_SQL)
def f07_sound_cues_whole(spark, folder):
    return TL.sound_cues(timed(told(spark, folder)), bank(spark, folder))


@query(f"SELECT chapter, panel_id, kind, source FROM ({_CUE_SQL}) WHERE source IN (SELECT ['transition', 'action', 'reveal'][p_size % 3 + 1] || '/' || p_partkey || '.wav' FROM part WHERE NOT starts_with(p_type, 'PROMO'))")
def f08_known_cues_whole(spark, folder):
    """Files of all parts are in the bank; those of promoted types are no longer there."""
    there = table(spark, folder, "part").where("not startswith(p_type, 'PROMO')").select(F.col("p_partkey").alias("_part"))
    every = bank(spark, folder)
    found = every.withColumn("_part", F.regexp_extract("source", r"/(\d+)\.", 1).cast("long")).join(there, "_part", "left_semi")
    return TL.known_cues(TL.sound_cues(timed(told(spark, folder)), every), found).select("chapter", "panel_id", "kind", "source")


@query(f"""WITH {TIMELINE}, b AS (SELECT chapter, "order" AS o, panel_id AS from_panel, lead(panel_id) OVER w AS to_panel, sum(duration_seconds) OVER w AS s FROM t WHERE start_seconds IS NOT NULL WINDOW w AS (PARTITION BY chapter ORDER BY idx)),
  c AS (SELECT *, CASE WHEN o % 5 = 2 THEN 'fade' ELSE 'cut' END AS kind, CASE WHEN o % 5 = 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS seconds FROM b WHERE to_panel IS NOT NULL)
SELECT chapter, from_panel, to_panel, kind, seconds, round(s - o * max(seconds) OVER (PARTITION BY chapter), 3) AS "offset" FROM c""")
def f09_crossfades(spark, folder):
    t = told(spark, folder)
    w = Window.partitionBy("chapter").orderBy("idx")
    kept = t.where("start_seconds is not null").select("chapter", "order", F.col("panel_id").alias("from_panel"), F.lead("panel_id").over(w).alias("to_panel")).where("to_panel is not null and `order` % 5 = 2")
    return TL.crossfades(t, kept.select("chapter", "from_panel", "to_panel", F.lit("fade").alias("kind"), F.lit(0.25).alias("seconds")))


@query(f"""WITH {TIMELINE} SELECT chapter, panel_id, ("order" - 1) // 12 AS chunk, CASE WHEN count(*) OVER (PARTITION BY chapter) > 25 OR sum(duration_seconds) OVER (PARTITION BY chapter) > 150 THEN 'chunked' ELSE 'direct' END AS strategy
FROM t WHERE start_seconds IS NOT NULL""")
def f10_render_chunks(spark, folder):
    return TL.render_chunks(told(spark, folder)).select("chapter", "panel_id", "chunk", "strategy")


@query(f"""WITH {TIMELINE} SELECT chapter, count(*) AS panels, count(*) FILTER (coalesce(text, '') <> '') AS spoken, count(*) FILTER (note = 'silent_beat') AS silent, round(coalesce(sum(duration_seconds), 0.0), 3) AS total_seconds
FROM t GROUP BY chapter""")
def g01_run_summary(spark, folder):
    t = told(spark, folder).groupBy("chapter").agg(F.count(F.lit(1)).alias("panels"), F.count_if(X.text(F.col("text")) != "").alias("spoken"), F.count_if(F.col("note") == "silent_beat").alias("silent"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 3).alias("total_seconds"))
    return t


@query(f"""WITH {NARRATION} SELECT chapter, string_agg(text, ' ' ORDER BY idx) FILTER (text <> '') AS script FROM n GROUP BY chapter""")
def g10_script_text(spark, folder):
    n = TL.build_narration(chapters(spark, folder)).groupBy("chapter").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("idx", "text")))).alias("p"))
    return n.select("chapter", F.nullif(F.array_join(F.transform("p", lambda p: p["text"]), " "), F.lit("")).alias("script"))


@query(f"""WITH {TIMELINE} SELECT chapter, panel_id, audio_seconds, round({S.words("coalesce(text, '')")} / audio_seconds * 60.0, 3) AS wpm FROM t WHERE audio_seconds > 0 ORDER BY audio_seconds DESC, panel_id LIMIT 6""")
def g11_longest_clips(spark, folder):
    t = told(spark, folder).where("audio_seconds > 0")
    return t.select("chapter", "panel_id", "audio_seconds", F.round(X.word_count(F.col("text")) / F.col("audio_seconds") * 60.0, 3).alias("wpm")).orderBy(F.desc("audio_seconds"), "panel_id").limit(6)


_W_, _H_ = "(300 + p_partkey * 37 % 1500)", "(200 + p_partkey * 91 % 3000)"


def _sizes():
    return 300 + F.col("p_partkey") * 37 % 1500, 200 + F.col("p_partkey") * 91 % 3000


def _pan_sql(w: str, h: str) -> str:
    down = f"({h} - 1920 > 2 AND {h} - 1920 >= {w} - 1080)"
    return f"CASE WHEN {down} THEN 'pan_down' WHEN {w} - 1080 > 2 THEN 'pan_right' ELSE 'static' END AS kind, {w}::INTEGER AS scaled_w, {h}::INTEGER AS scaled_h, (CASE WHEN {down} THEN {h} - 1920 WHEN {w} - 1080 > 2 THEN {w} - 1080 ELSE 0 END)::INTEGER AS travel_px"


@query(f"SELECT p_partkey, CASE WHEN {_W_}::DOUBLE / {_H_} < 1080 / 1920.0::DOUBLE * 0.85 THEN 'down' WHEN {_W_}::DOUBLE / {_H_} > 1080 / 1920.0::DOUBLE * 1.15 THEN 'right' ELSE 'none' END AS direction FROM part")
def b17_pan_direction(spark, folder):
    return table(spark, folder, "part").select("p_partkey", G.pan_direction(*_sizes()).alias("direction"))


@query(f"""SELECT p_partkey, {_pan_sql('w', 'h')}, fit_w, fit_h FROM (SELECT p_partkey, ceil(pw * scale) AS w, ceil(ph * scale) AS h, greatest(1080, round_even(pw * cover, 0))::INTEGER AS fit_w, greatest(1920, round_even(ph * cover, 0))::INTEGER AS fit_h
  FROM (SELECT *, least(cover, 4.0::DOUBLE) AS scale FROM (SELECT p_partkey, {_W_} AS pw, {_H_} AS ph, greatest(1080::DOUBLE / {_W_}, 1920::DOUBLE / {_H_}) AS cover FROM part)))""")
def b18_compute_pan(spark, folder):
    fit = G.fit_pan(*_sizes())
    return table(spark, folder, "part").select("p_partkey", G.compute_pan(*_sizes()).alias("p"), fit.alias("f")).select("p_partkey", "p.*", F.col("f.scaled_w").alias("fit_w"), F.col("f.scaled_h").alias("fit_h"))


@query(f"""SELECT conv_id, turn, round({S.ms_up("least(greatest(audio, CASE class WHEN 'action' THEN 0.8 ELSE 2.0 END::DOUBLE, travel / 450.0::DOUBLE) * CASE class WHEN 'reveal' THEN 1.35 ELSE 1.0 END::DOUBLE, greatest(4.6::DOUBLE, audio))")}, 3) AS spoken,
  round(least(greatest(words / 160.0::DOUBLE * 60.0, 2.5, travel / 450.0::DOUBLE), 12.0), 6) AS plain
FROM (SELECT conv_id, turn, {S.words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS words, {S.words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} / 150.0::DOUBLE * 60.0 AS audio, length(coalesce(text, '')) * 11 % 2500 AS travel, {S.panel_class("coalesce(text, '')", "''")} AS class FROM conversations)""")
def b20_display_seconds(spark, folder):
    c, t = table(spark, folder, "conversations"), F.col("text")
    words, travel = X.word_count(t), F.length(X.text(t)) * 11 % 2500
    spoken = G.display_seconds(words / F.lit(150.0) * 60.0, words, travel, X.panel_class(t, F.lit("")))
    return c.select("conv_id", "turn", F.round(spoken, 3).alias("spoken"), F.round(G.content_seconds(F.lit(None).cast("double"), words, travel), 6).alias("plain"))


@query("""SELECT p_partkey, (CASE WHEN t > 450 THEN 450 ELSE t END)::INTEGER AS travel_px, CASE WHEN t > 450 THEN round_even(t * (450.0::DOUBLE / t), 3) ELSE t::DOUBLE END AS pan_x_px, CASE WHEN t > 450 THEN round_even(-t / 2.0::DOUBLE * (450.0::DOUBLE / t), 3) ELSE -t / 2.0::DOUBLE END AS pan_y_px
FROM (SELECT p_partkey, p_size * 23 AS t FROM part)""")
def b21_cap_travel(spark, folder):
    t = F.col("p_size") * 23
    return table(spark, folder, "part").select("p_partkey", G.cap_travel(t, t.cast("double"), -t / 2.0).alias("c")).select("p_partkey", "c.*")


@query(f"""SELECT p_partkey, seg::INTEGER AS seg, round(dx / 1312.0::DOUBLE, 9) AS ndx, round(dy / 2332.0::DOUBLE, 9) AS ndy,
  CASE WHEN sqrt(dxps * dxps + dyps * dyps) < 5 THEN CASE WHEN zoom >= 1.1 THEN 'zoom_in' WHEN zoom <= 0.95 THEN 'zoom_out' ELSE 'static' END
    WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN 'pan_down' ELSE 'pan_up' END ELSE CASE WHEN dx > 0 THEN 'pan_right' ELSE 'pan_left' END END AS kind,
  round(least(0.4, greatest(0.0, 0.15::DOUBLE + (zoom::DOUBLE - 1.0) * 0.5)), 9) AS strength, CASE WHEN match_score >= 0.95 THEN 1.0 WHEN match_score >= 0.85 THEN 0.8 ELSE 0.6 END::DOUBLE AS damping
FROM part JOIN {_SEG} ON seg = p_partkey % 8 + 1""")
def b22_segment_math(spark, folder):
    s = spark.createDataFrame(G.SEGMENTS, G.SEGMENT_COLUMNS)
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 8 + 1).cast("int").alias("seg")).join(F.broadcast(s), "seg")
    c = F.col
    return rows.select("p_partkey", "seg", F.round(c("dx") / G.FRAME[0], 9).alias("ndx"), F.round(c("dy") / G.FRAME[1], 9).alias("ndy"), G.segment_kind(c("zoom"), c("dx"), c("dy"), c("dxps"), c("dyps")).alias("kind"), F.round(G.zoom_strength(c("zoom")), 9).alias("strength"), G.damping(c("match_score")).alias("damping"))


_KIND = """CASE WHEN sqrt(dxps * dxps + dyps * dyps) < 5 THEN CASE WHEN zoom >= 1.1 THEN 'zoom_in' WHEN zoom <= 0.95 THEN 'zoom_out' ELSE 'static' END
    WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN 'pan_down' ELSE 'pan_up' END ELSE CASE WHEN dx > 0 THEN 'pan_right' ELSE 'pan_left' END END"""
# Every part is a panel, from wide to very tall ones, with the segment of its number.
_MOVED = f"""WITH s AS (SELECT *, {_KIND} AS k FROM {_SEG}), p AS (SELECT p_partkey, p_size * 9 % 700 + 40 AS w, p_partkey * 37 % 1900 + 60 AS h, p_partkey % 8 + 1 AS seg FROM part),
  c AS (SELECT *, least(1080.0::DOUBLE / w, 1920.0::DOUBLE / h, 4.0) AS fit FROM p JOIN s USING (seg)), n AS (SELECT *, w * fit / 1080 < 0.5 AS tall FROM c), d AS (SELECT *, tall AND h::DOUBLE / w >= 3.0 AS split FROM n),
  m AS (SELECT *, CASE WHEN split THEN 'static' ELSE k END AS kind, CASE WHEN split THEN 1.0 WHEN tall THEN 2.2 ELSE 2.0 END::DOUBLE AS scale, least(1080.0::DOUBLE / (w * 2), 1920.0::DOUBLE / (h / 2), 4.0) AS band FROM d),
  x AS (SELECT *, CASE kind WHEN 'pan_right' THEN round_even(1080 * 0.08::DOUBLE, 0) WHEN 'pan_left' THEN -round_even(1080 * 0.08::DOUBLE, 0) ELSE 0.0 END::DOUBLE AS pan_x_px,
    CASE kind WHEN 'pan_down' THEN round_even((scale - 1.0) * 1920 * 0.35::DOUBLE, 0) WHEN 'pan_up' THEN -round_even((scale - 1.0) * 1920 * 0.35::DOUBLE, 0) ELSE 0.0 END::DOUBLE AS pan_y_px FROM m)"""


@query(f"""{_MOVED} SELECT p_partkey, kind, CASE WHEN split THEN ceil(w * 2 * band) ELSE ceil(w * fit * scale) END::INTEGER AS scaled_w, CASE WHEN split THEN ceil(h / 2 * band) ELSE ceil(h * fit * scale) END::INTEGER AS scaled_h, abs(pan_x_px + pan_y_px)::INTEGER AS travel_px, pan_x_px, pan_y_px, tall,
  scale AS panel_scale, CASE WHEN split THEN 2 ELSE 0 END::INTEGER AS split_columns, CASE WHEN kind = 'static' THEN 0.0 ELSE round(least(0.4, greatest(0.0, 0.15::DOUBLE + (zoom::DOUBLE - 1.0) * 0.5)), 9) END::DOUBLE AS zoom_strength FROM x""")
def b23_panel_motion(spark, folder):
    m = moving_parts(spark, folder).select("p_partkey", G.panel_motion(F.col("width"), F.col("height"), F.struct("zoom", "match_score", "dx", "dy", "dxps", "dyps")).alias("m")).select("p_partkey", "m.*")
    return m.withColumn("zoom_strength", F.round("zoom_strength", 9))


def moving_parts(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", (F.col("p_size") * 9 % 700 + 40).alias("width"), (F.col("p_partkey") * 37 % 1900 + 60).alias("height"), (F.col("p_partkey") % 8 + 1).cast("int").alias("seg"))
    return parts.join(F.broadcast(spark.createDataFrame(G.SEGMENTS, G.SEGMENT_COLUMNS)), "seg")  # eight rows


@query(f"""{_MOVED} SELECT p_brand AS chapter, p_partkey AS "order", p_partkey::VARCHAR AS panel_id, 'reference_v1' AS preset, seg::INTEGER AS seg, p_size / 2.0::DOUBLE AS duration_seconds, seg_dur::DOUBLE AS reference_dur, round(dx / 1312.0::DOUBLE, 9) AS ndx, round(dy / 2332.0::DOUBLE, 9) AS ndy, kind AS pan_kind,
  abs(pan_x_px + pan_y_px)::INTEGER AS travel_px, pan_x_px, pan_y_px, match_score::DOUBLE AS confidence, sqrt(dxps * dxps + dyps * dyps) < 5 AS static FROM x JOIN part USING (p_partkey)""")
def f16_motion_report(spark, folder):
    rows = moving_parts(spark, folder).select(F.col("p_brand").alias("chapter"), F.col("p_partkey").alias("order"), F.col("p_partkey").cast("string").alias("panel_id"), "width", "height", "seg")
    entries = rows.join(table(spark, folder, "part").select(F.col("p_partkey").alias("order"), (F.col("p_size") / 2.0).alias("duration_seconds")), "order")
    report = TL.motion_report(entries, F.broadcast(spark.createDataFrame(G.SEGMENTS, G.SEGMENT_COLUMNS)))  # eight rows
    return report.select("chapter", "order", "panel_id", "preset", "seg", "duration_seconds", "reference_dur", F.round("ndx", 9).alias("ndx"), F.round("ndy", 9).alias("ndy"), "pan_kind", "travel_px", "pan_x_px", "pan_y_px", "confidence", "static")


@query("""SELECT l_orderkey, l_linenumber, least(greatest(round_even(l_quantity * 20 * 3000 / 1000.0::DOUBLE, 0), 0), 3000)::INTEGER AS y, CASE WHEN h > 800 THEN w ELSE 390 END::INTEGER AS out_w, CASE WHEN h > 800 THEN ph ELSE h END::INTEGER AS out_h
FROM (SELECT *, round_even(ph * 390::DOUBLE / w, 0) AS h FROM (SELECT *, (200 + l_partkey % 900) AS w, (100 + l_suppkey * 7 % 2000) AS ph FROM lineitem))""")
def b34_rescale(spark, folder):
    w, h = 200 + F.col("l_partkey") % 900, 100 + F.col("l_suppkey") * 7 % 2000
    size = G.output_size(w, h)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", G.from_thousandths(F.col("l_quantity") * 20, F.lit(3000)).alias("y"), size["w"].alias("out_w"), size["h"].alias("out_h"))


@query(f"""{_CUES}, shown AS (SELECT *, lag(said) OVER w AS before, lead(panel_id) OVER w AS next FROM (SELECT *, {S.strip("coalesce(text, '')")} AS said FROM t WHERE "order" IS NOT NULL) WINDOW w AS (PARTITION BY chapter ORDER BY "order")),
  spoken AS (SELECT chapter FROM t GROUP BY chapter HAVING count(audio_seconds) > 0),
  caps AS (SELECT c.chapter, d.panel_id, row_number() OVER (PARTITION BY c.chapter ORDER BY c.idx, cue) AS n, round(s, 3) AS s, round(e, 3) AS e, caption FROM cues c JOIN shown d ON d.chapter = c.chapter AND d.idx = c.idx SEMI JOIN spoken ON spoken.chapter = c.chapter WHERE said = '' OR before IS NULL OR said <> before)
SELECT chapter, 'panel' AS kind, "order" AS place, panel_id AS id, NULL::VARCHAR AS other, NULL::VARCHAR AS text, start_seconds AS start, duration_seconds AS seconds, start_seconds AS own_start, duration_seconds AS own_seconds FROM shown
UNION ALL SELECT chapter, 'caption', n, printf('cap_%03d', n), panel_id, caption, s, round(e - s, 3), s, round(e - s, 3) FROM caps
UNION ALL SELECT chapter, 'transition', "order", panel_id, next, 'cut', NULL, 0.5::DOUBLE, NULL, NULL FROM shown WHERE next IS NOT NULL
UNION ALL SELECT chapter, 'effect', "order", panel_id, NULL, 'static', NULL, duration_seconds, NULL, NULL FROM shown""")
def f17_bootstrap(spark, folder):
    from panelframe.operators import editor

    return editor.bootstrap(timed(told(spark, folder)))
