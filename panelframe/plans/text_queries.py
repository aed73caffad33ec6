"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelframe.functions import text as X
from panelframe.plans import sql as S
from panelframe.plans.registry import query, table

_DOC = "coalesce(text, '')"


@query(f"SELECT doc_id, round({S.ratio(_DOC)}, 9) AS latin_ratio FROM documents")
def b01_latin_ratio(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(X.latin_ratio(F.col("text")), 9).alias("latin_ratio"))


@query(f"SELECT doc_id, {S.strip_non_latin(_DOC)} AS kept FROM documents")
def b02_strip_non_latin(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.strip_non_latin(F.col("text")).alias("kept"))


_PIECES = f"list_filter(list_transform(string_split({_DOC}, '/'), lambda p: {S.strip('p')}), lambda p: p <> '')"
_GOOD = f"list_filter(pieces, lambda p: {S.count('p', S.LATIN)} >= 2 AND {S.ratio('p')} >= 0.6)"
_KEPT = f"array_to_string(list_filter(list_transform(good, lambda p: {S.strip_non_latin('p')}), lambda p: p <> ''), ' / ')"


@query(f"""SELECT doc_id, {_KEPT} AS kept, len(pieces) - len(good) AS dropped
FROM (SELECT *, {_GOOD} AS good FROM (SELECT doc_id, {_PIECES} AS pieces FROM documents))""")
def b03_english_bubbles(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.english_bubbles(F.col("text")).alias("b")).select("doc_id", "b.kept", "b.dropped")


@query(f"""SELECT doc_id, {S.strip_non_latin(_DOC)} AS narration, {_KEPT} AS dialogue, len(pieces) - len(good) AS dropped
FROM (SELECT *, {_GOOD} AS good FROM (SELECT doc_id, text, {_PIECES} AS pieces FROM documents))""")
def b04_clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.clean_text(F.col("text"), F.col("text")).alias("c")).select("doc_id", "c.narration", "c.dialogue", "c.dropped")


# DuckDB's \\b knows ASCII only: accented letters are put between underscores, which are word characters there.
_ACCENT = r"[\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
_HELD = f"regexp_replace({_DOC}, {S.lit(f'({_ACCENT})')}, '_\\1_', 'g')"
_FOUND = lambda p: f"nullif(regexp_extract({_HELD}, {p}), '')"


@query(f"SELECT doc_id, {S.strip(f'coalesce({_FOUND(S.DOMAIN)}, {_FOUND(S.PROMO)})')} AS reason, regexp_matches({_HELD}, {S.DOMAIN}) OR regexp_matches({_HELD}, {S.PROMO}) AS is_promo FROM documents")
def b05_promo_reason(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.promo_reason(F.col("text")).alias("reason")).withColumn("is_promo", F.col("reason").isNotNull())


_CLEAN = _HELD
for _p in (S.DOMAIN, S.PROMO, S.CALL):
    _CLEAN = f"regexp_replace({_CLEAN}, {_p}, ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, {S.lit(f'_({_ACCENT})_')}, '\\1', 'g')"


@query(f"SELECT doc_id, {S.tidy(_CLEAN)} AS kept FROM documents")
def b06_strip_promo(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.strip_promo(F.col("text")).alias("kept"))


@query(f"""SELECT doc_id, line_no, regexp_matches(line, {S.NON_LEXICAL}) AS non_lexical
FROM (SELECT doc_id, unnest(string_split({_DOC}, chr(10))) AS line, generate_subscripts(string_split({_DOC}, chr(10)), 1) - 1 AS line_no FROM documents)""")
def b07_non_lexical(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split(X.text(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long"), X.is_non_lexical(F.col("line")).alias("non_lexical"))


@query(f"SELECT conv_id, turn, {S.normalise(_DOC)} AS line FROM conversations")
def b08_normalise(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", X.normalise(F.col("text")).alias("line"))


@query(f"SELECT doc_id, {S.words(_DOC)} AS words FROM documents")
def b09_word_count(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id, round(CASE WHEN {S.strip(_DOC)} = '' THEN 0.0 ELSE {S.words(_DOC)} / 140.0 * 60.0 END, 6) AS seconds FROM documents")
def b10_speech_seconds(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(X.speech_seconds(F.col("text")), 6).alias("seconds"))


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace({S.strip(_DOC)}, {S.lit(f'({X.TERMINAL}){X.SPACE}+')}, '\\1' || chr(1), 'g'), chr(1))) AS s,
    generate_subscripts(string_split(regexp_replace({S.strip(_DOC)}, {S.lit(f'({X.TERMINAL}){X.SPACE}+')}, '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
  w AS (SELECT doc_id, i, s, {S.words('s')} AS w FROM s WHERE {S.strip('s')} <> ''),
  c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS cum, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w),
  kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS kept, sum(w) AS words FROM c WHERE k = 1 OR (cum - w < 9 AND cum <= 9) GROUP BY doc_id),
  cut AS (SELECT doc_id, CASE WHEN words > 28 THEN array_to_string(list_filter(regexp_split_to_array(kept, {S.lit(X.SPACE + '+')}), lambda x: x <> '')[1:10], ' ') ELSE kept END AS short FROM kept),
  norm AS (SELECT doc_id, {S.normalise('short')} AS short FROM cut)
SELECT d.doc_id, CASE WHEN {S.strip(_DOC)} = '' OR {S.words(_DOC)} <= 28 THEN {_DOC} WHEN regexp_matches(short, {S.NON_LEXICAL}) THEN '' ELSE short END AS spoken
FROM documents d LEFT JOIN norm USING (doc_id)""")
def b11_fit_speech(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.fit_speech(F.col("text")).alias("spoken"))


_TOK = lambda e: f"list_distinct(regexp_extract_all(lower({e}), {S.lit(f'{X.WORD}|{X.CJK}')}))"
_OVER = lambda a, b: f"coalesce(len(list_intersect({_TOK(a)}, {_TOK(b)}))::DOUBLE / nullif(len({_TOK(a)}), 0), 0.0)"
_TURNS = "(SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS next FROM conversations)"


@query(f"""SELECT conv_id, turn, round({_OVER('d', 'n')}, 9) AS overlap,
  CASE WHEN d = '' OR (n <> '' AND {_OVER('d', 'n')} >= 0.8) THEN n ELSE {S.strip("n || ' ' || d")} END AS line
FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, {S.NON_LEXICAL}) THEN '' ELSE {S.normalise('text')} END AS n,
  CASE WHEN {S.strip('next')} = '' THEN '' ELSE {S.normalise('next')} END AS d FROM {_TURNS})""")
def b12_script_text(spark, folder):
    from pyspark.sql import Window

    turns = table(spark, folder, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    n = F.when(X.is_non_lexical(F.col("text")), "").otherwise(X.normalise(F.col("text")))
    d = F.when(X.strip(X.text(F.col("next"))) == "", "").otherwise(X.normalise(F.col("next")))
    return turns.select("conv_id", "turn", F.round(X.overlap_ratio(d, n), 9).alias("overlap"), X.script_text(F.col("text"), F.col("next")).alias("line"))


@query(f"SELECT conv_id, turn, {S.panel_class(_DOC, chr(39) * 2)} AS narrated, {S.panel_class(chr(39) * 2, _DOC)} AS spoken FROM conversations")
def b16_panel_class(spark, folder):
    none = F.lit("")
    return table(spark, folder, "conversations").select("conv_id", "turn", X.panel_class(F.col("text"), none).alias("narrated"), X.panel_class(none, F.col("text")).alias("spoken"))


@query(f"SELECT l_orderkey, l_linenumber, {S.ms_up('l_extendedprice / (l_quantity * 7)')} AS seconds FROM lineitem")
def b19_round_ms_up(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", X.round_ms_up(F.col("l_extendedprice") / (F.col("l_quantity") * 7)).alias("seconds"))


@query("""SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt
FROM (SELECT event_id, round_even(greatest(value * 37, 0.0) * 1000, 0)::BIGINT AS ms FROM events)""")
def b25_srt_time(spark, folder):
    return table(spark, folder, "events").select("event_id", X.srt_time(F.col("value") * 37).alias("srt"))
