"""Story queries: users' events stand for a series' panels; some open threads, others resolve them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelframe.functions import nested as N
from panelframe.operators import story as S
from panelframe.plans.registry import query, table

# What is said of an event: its kind, its number k and a class of its value.
_SAID = "coalesce(event_type, '') || ' k' || coalesce(cast((props::JSON->>'k')::BIGINT % 12 AS VARCHAR), 'none') || ' v' || coalesce(cast(floor(value / 15)::BIGINT AS VARCHAR), 'none')"


@query(f"""WITH RECURSIVE u AS (
  SELECT user_id AS series, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type IN ('purchase', 'error') AS closes,
    {_SAID} AS said, list_distinct(regexp_extract_all(lower({_SAID}), '[a-z0-9'']+')) AS words FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT DISTINCT series, 0::BIGINT AS n, CAST([] AS STRUCT(said VARCHAR, words VARCHAR[], open BOOLEAN, first_seen BIGINT, last_seen BIGINT)[]) AS t FROM u
  UNION ALL
  SELECT series, n, CASE WHEN closes AND hit IS NOT NULL THEN list_transform(t, lambda x, i: CASE WHEN i = hit THEN {{'said': x.said, 'words': x.words, 'open': false, 'first_seen': x.first_seen, 'last_seen': idx}} ELSE x END)
    WHEN NOT closes AND hit IS NULL THEN list_append(t, {{'said': said, 'words': words, 'open': true, 'first_seen': idx, 'last_seen': NULL::BIGINT}}) ELSE t END
  FROM (SELECT s.series, u.n, u.idx, u.closes, u.said, u.words, s.t,
      list_min(list_filter(list_transform(s.t, lambda x, i: CASE WHEN x.open AND len(u.words) >= 2 AND len(list_intersect(u.words, x.words)) / len(u.words) >= 0.6 THEN i END), lambda i: i IS NOT NULL)) AS hit
    FROM s JOIN u ON u.series = s.series AND u.n = s.n + 1)),
f AS (SELECT series, arg_max(t, n) AS t FROM s GROUP BY series)
SELECT series, pos::BIGINT AS pos, 't' || pos AS name, x.said AS description, CASE WHEN x.open THEN 'active' ELSE 'resolved' END AS status, x.first_seen, x.last_seen
FROM (SELECT series, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS pos FROM f)""")
def g02_threads(spark, folder):
    e = table(spark, folder, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 12
    said = F.concat(F.coalesce("event_type", F.lit("")), F.lit(" k"), F.coalesce(k.cast("string"), F.lit("none")), F.lit(" v"), F.coalesce(F.floor(F.col("value") / 15).cast("string"), F.lit("none")))
    closes = F.coalesce(F.col("event_type").isin("purchase", "error"), F.lit(False))
    updates = e.select(F.col("user_id").alias("series"), F.col("event_id").alias("idx"), F.when(closes, F.array(said)).alias("resolved"), F.when(~closes, F.array(said)).alias("opened"))
    return S.story(updates).where("kind = 'thread'").select("series", "pos", "name", "description", "status", "first_seen", "last_seen")


# Every turn is a panel and six edits of its conversation's timeline, told by a hash.
_EDITS = """c AS (SELECT conv_id AS chapter, turn, 2.0 + length(coalesce(text, '')) % 30 / 10.0::DOUBLE AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  n AS (SELECT chapter, max(turn) + 1 AS many FROM c GROUP BY chapter),
  h AS (SELECT chapter, turn * 6 + j AS seq, many, ('0x' || substr(sha256(chapter || ':' || turn || ':' || j), 1, 8))::BIGINT AS v FROM c JOIN n USING (chapter), (SELECT unnest(range(6)) AS j)),
  e AS (SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS step,
      CASE WHEN v % 97 = 0 THEN 'reset' ELSE ['duration', 'remove', 'add', 'reorder', 'undo', 'undo', 'redo', 'duration'][(v % 8 + 1)::INT] END AS op, 'p' || (v // 8 % many) AS panel,
      CASE WHEN v // 64 % (many + 1) < many THEN 'p' || (v // 64 % (many + 1)) END AS other, greatest(v // 512 % 80 / 10.0::DOUBLE, 0.1::DOUBLE) AS number, list_transform(range(many), lambda x: 'p' || ((many - 1 - x + v // 8) % many)) AS "order" FROM h)"""


@query(f"""WITH RECURSIVE {_EDITS},
  f AS (SELECT chapter, list({{'id': 'p' || turn, 's': s}} ORDER BY turn) AS t FROM c GROUP BY chapter),
  z AS (
    SELECT chapter, 0::BIGINT AS step, t, t AS f, CAST([] AS STRUCT(b STRUCT(id VARCHAR, s DOUBLE)[], a STRUCT(id VARCHAR, s DOUBLE)[])[]) AS hist, 0::BIGINT AS done FROM f
    UNION ALL
    SELECT chapter, step, next, f, CASE WHEN op = 'reset' THEN [] WHEN told THEN list_append(hist[1:done], {{'b': t, 'a': next}})[-200:] ELSE hist END,
      CASE WHEN op = 'reset' THEN 0 WHEN told THEN least(done + 1, 200) WHEN op = 'undo' AND done > 0 THEN done - 1 WHEN op = 'redo' AND done < len(hist) THEN done + 1 ELSE done END
    FROM (SELECT *, CASE WHEN op = 'reset' THEN f
        WHEN op = 'undo' AND done > 0 THEN hist[done].b
        WHEN op = 'redo' AND done < len(hist) THEN hist[done + 1].a
        WHEN op = 'remove' THEN list_filter(t, lambda x: x.id <> panel)
        WHEN op = 'reorder' THEN list_filter(list_transform("order", lambda i: list_filter(t, lambda x: x.id = i)[-1]), lambda x: x IS NOT NULL)
        WHEN op = 'add' AND own IS NOT NULL THEN list_concat(list_concat(t[1:k], [own]), t[k + 1:])
        WHEN op = 'duration' THEN list_transform(t, lambda x, i: CASE WHEN i = at_ THEN {{'id': x.id, 's': number}} ELSE x END)
        ELSE t END AS next, op IN ('remove', 'reorder') OR op = 'add' AND own IS NOT NULL OR op = 'duration' AND at_ > 0 AS told
      FROM (SELECT e.chapter, e.step, e.op, e.panel, e.number, e."order", z.t, z.f, z.hist, z.done, list_filter(z.f, lambda x: x.id = e.panel)[1] AS own,
          coalesce(list_position(list_transform(z.t, lambda x: x.id), e.panel), 0) AS at_,
          CASE WHEN e.other IS NULL THEN len(z.t) ELSE coalesce(list_position(list_transform(z.t, lambda x: x.id), e.other), 0) END AS k
        FROM z JOIN e ON e.chapter = z.chapter AND e.step = z.step + 1))),
  g AS (SELECT chapter, arg_max(t, step) AS t FROM z GROUP BY chapter)
SELECT chapter, place::BIGINT AS place, x.id AS id, round(coalesce(list_sum(list_transform(t[1:place - 1], lambda y: y.s)), 0), 3) AS start, round(x.s, 6) AS seconds
FROM (SELECT chapter, t, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS place FROM g)""")
def f11_editor(spark, folder):
    from panelframe.operators import editor as E

    c = table(spark, folder, "conversations").where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("chapter"), "turn", (2.0 + F.length(F.coalesce("text", F.lit(""))) % 30 / 10.0).alias("seconds"))
    many = c.groupBy("chapter").agg((F.max("turn") + 1).alias("many"))
    panels = c.select("chapter", F.concat(F.lit("p"), "turn").alias("panel"), F.col("turn").alias("position"), "seconds")
    h = c.join(many, "chapter").select("chapter", "turn", "many", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    h = h.withColumn("v", F.conv(F.substring(F.sha2(F.concat_ws(":", "chapter", "turn", "j"), 256), 1, 8), 16, 10).cast("long"))
    op = F.element_at(F.array(*map(F.lit, ["duration", "remove", "add", "reorder", "undo", "undo", "redo", "duration"])), (F.col("v") % 8 + 1).cast("int"))
    place = F.expr("v div 64 % (many + 1)")
    order = F.expr("transform(sequence(0, many - 1), x -> concat('p', (many - 1 - x + v div 8) % many))")
    edits = h.select("chapter", (F.col("turn") * 6 + F.col("j")).alias("seq"), F.when(F.col("v") % 97 == 0, "reset").otherwise(op).alias("op"), F.expr("concat('p', v div 8 % many)").alias("panel"), F.when(place < F.col("many"), F.concat(F.lit("p"), place)).alias("other"), F.lit(None).cast("string").alias("text"), (F.expr("v div 512 % 80") / 10.0).alias("number"), order.alias("order"))
    out = E.edited(panels, None, edits).where("kind = 'panel'")
    return out.select("chapter", "place", "id", "start", F.round("seconds", 6).alias("seconds"))


# A stored memory of each document: five objects deep, some without a version, of one too new, or with one that is no number.
_STORED = """SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN '{"cut":' ELSE json_object('chapter', source, 'characters', json_object('Ann', json_object('role', lang, 'seen', json_object('first', json_object('panel', n_chars, 'word', text)))),
  '_meta', CASE n_chars % 5 WHEN 0 THEN json_object('last_panel', doc_id) WHEN 1 THEN json_object('version', 3) WHEN 2 THEN json_object('version', '9') ELSE json_object('version', 1, 'seed_built', true) END)::VARCHAR END AS stored,
  CASE WHEN n_chars % 11 = 0 THEN 'broken' WHEN n_chars % 5 = 1 THEN 'reset' ELSE 'loaded' END AS state, lang, n_chars, text, source FROM documents"""


@query(f"""SELECT doc_id, state, CASE WHEN state = 'loaded' THEN source END AS chapter, CASE WHEN state = 'loaded' THEN lang END AS role, CASE WHEN state = 'loaded' THEN n_chars END AS panel, CASE WHEN state = 'loaded' THEN sha256(coalesce(text, '')) END AS word,
  CASE WHEN state = 'loaded' AND n_chars % 5 = 0 THEN doc_id ELSE 0 END AS last_panel, state = 'loaded' AND n_chars % 5 NOT IN (0, 2) AS seed_built, 2::BIGINT AS version, '' AS title FROM ({_STORED})""")
def g05_stored_memory(spark, folder):
    """Five levels deep over the scaffold, with the gate on versions."""
    n = F.col("n_chars")
    pack = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    ann = F.struct(F.col("lang").alias("role"), F.struct(F.struct(n.alias("panel"), F.col("text").alias("word")).alias("first")).alias("seen"))
    meta = F.when(n % 5 == 0, pack(last_panel=F.col("doc_id"))).when(n % 5 == 1, F.lit('{"version":3}')).when(n % 5 == 2, F.lit('{"version":"9"}')).otherwise(F.lit('{"version":1,"seed_built":true}'))
    whole = N.merged_json(pack(chapter=F.col("source"), characters=F.struct(ann.alias("Ann"))), F.concat(F.lit('{"_meta":'), meta, F.lit("}")))
    stored = F.when(n % 11 == 0, F.lit('{"cut":')).otherwise(whole)
    docs = table(spark, folder, "documents").select("doc_id", N.loaded_context(stored).alias("c")).select("doc_id", "c.state", F.try_parse_json("c.context").alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    word = F.when(F.col("state") == "loaded", F.sha2(F.coalesce(get("$.characters.Ann.seen.first.word"), F.lit("")), 256))
    return docs.select("doc_id", "state", get("$.chapter").alias("chapter"), get("$.characters.Ann.role").alias("role"), get("$.characters.Ann.seen.first.panel", "bigint").alias("panel"), word.alias("word"), get("$._meta.last_panel", "bigint").alias("last_panel"), get("$._meta.seed_built", "boolean").alias("seed_built"), get("$._meta.version", "bigint").alias("version"), get("$.series_title").alias("title"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS text, CASE WHEN lang = 'en' THEN '***REDACTED***' ELSE source END AS named, source AS author, '***REDACTED***' AS deep, coalesce(lang, '') AS kept, CASE WHEN coalesce(source, '') <> '' THEN '' ELSE coalesce(source, 'none') END AS blanked FROM documents""")
def b27_nested_redaction(spark, folder):
    """Keys within objects within lists; texts under plain keys stay as they are."""
    d = table(spark, folder, "documents")
    inner = F.struct(F.col("lang").alias("kept"), F.struct(F.array(F.struct(F.struct(F.col("text").alias("refreshToken")).alias("of"))).alias("all")).alias("in"))
    packed = F.to_json(F.struct(F.col("text").alias("text"), F.when(F.col("lang") == "en", F.struct(F.col("source").alias("x-api-key"), F.lit(None).cast("string").alias("monkeys"))).alias("a"), F.when(~F.coalesce(F.col("lang") == "en", F.lit(False)), F.struct(F.col("source").alias("monkeys"))).alias("b"), F.struct(F.col("source").alias("author")).alias("c"), F.array(inner).alias("list")))
    config = F.to_json(F.struct(F.coalesce("source", F.lit("none")).alias("authKey"), F.lit("x").alias("title")))
    config = F.when(F.col("source").isNull(), F.lit('{"title":"none"}')).otherwise(config)
    rows = d.select("doc_id", F.try_parse_json(N.redacted_json(packed)).alias("v"), F.try_parse_json(N.blanked_config(config)).alias("w"))
    get = lambda path, of="v": F.try_variant_get(of, path, "string")
    return rows.select("doc_id", F.sha2(F.coalesce(get("$.text"), F.lit("")), 256).alias("text"), F.coalesce(get("$.a['x-api-key']"), get("$.b.monkeys")).alias("named"), get("$.c.author").alias("author"), F.coalesce(get("$.list[0].in.all[0].of.refreshToken"), F.lit("***REDACTED***")).alias("deep"), F.coalesce(get("$.list[0].kept"), F.lit("")).alias("kept"), F.coalesce(get("$.authKey", "w"), get("$.title", "w")).alias("blanked"))


def _measured(rows):
    """Stands for a model: words and vowels of a text."""
    import pandas as pd

    texts = rows["text"].fillna("")
    return pd.DataFrame({"words": texts.str.count(r"[^ \t-\r]+").astype("int64"), "vowels": texts.str.count("[aeiou]").astype("int64")})


@query("""SELECT doc_id, CASE WHEN d.lang <> 'en' AND c.doc_id IS NOT NULL THEN 'cache' ELSE 'model' END AS origin,
  CASE WHEN d.lang <> 'en' AND c.doc_id IS NOT NULL THEN -1 ELSE len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) END::BIGINT AS words,
  CASE WHEN d.lang <> 'en' AND c.doc_id IS NOT NULL THEN -1 ELSE len(regexp_extract_all(coalesce(text, ''), '[aeiou]')) END::BIGINT AS vowels
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) c USING (doc_id)""")
def h05_model_hook(spark, folder):
    """Labelled documents are cached, English ones under another hash."""
    from pyspark.sql import types as T

    from panelframe.operators import recompute as R

    wanted = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "lang", "text")
    cached = wanted.join(table(spark, folder, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", F.when(F.col("lang") == "en", "old").otherwise(F.col("hash")).alias("hash"), F.lit(-1).cast("long").alias("words"), F.lit(-1).cast("long").alias("vowels"))
    answer = T.StructType([T.StructField("words", T.LongType()), T.StructField("vowels", T.LongType())])
    return R.recomputed(wanted.drop("lang"), cached, ["doc_id"], _measured, answer).select("doc_id", "origin", "words", "vowels")


# Users are a conversation's characters, short turns of assistants its places, the others its threads, what the system says its events.
_REMEMBERED = """SELECT conv_id AS series, turn + 1 AS pos, CASE role WHEN 'user' THEN 'character' WHEN 'system' THEN 'event' ELSE CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'place' ELSE 'thread' END END AS kind, role || ' ' || turn AS name,
  left(replace(trim(coalesce(text, '')), chr(10), ' '), 300) AS description, length(coalesce(text, '')) % 5 = 0 AS closed, CASE WHEN length(coalesce(text, '')) % 4 = 0 THEN 0 ELSE turn * 20 END AS last_seen FROM conversations"""


def _block_sql(step: tuple) -> str:
    from panelframe.operators.memory import FOOTER, TITLES

    part = lambda k, n: f"CASE WHEN len({k}s) > 0 AND {n} > 0 THEN '{TITLES[k]}' || chr(10) || array_to_string({k}s[1:{n}], chr(10)) END"
    sections = ", ".join(part(k, n) for k, n in zip(TITLES, step))
    footer = FOOTER.replace("\n", "' || chr(10) || '")
    return f"('[STORY MEMORY -- panel 140]' || chr(10) || array_to_string(list_filter([{sections}], lambda x: x IS NOT NULL), chr(10)) || chr(10) || '{footer}')"


def _memory_sql() -> str:
    from panelframe.operators.memory import STEPS

    pick = " ".join(f"WHEN length({_block_sql(s)}) <= 900 THEN {k + 1}" for k, s in enumerate(STEPS))
    blocks = ", ".join(_block_sql(s) for s in STEPS)
    tag = "CASE WHEN last_seen <= 0 THEN '(pre-read cast, not yet seen)' WHEN 140 - last_seen > 60 THEN '[last seen panel ' || last_seen || ']' ELSE '(panel ' || last_seen || ')' END"
    return f"""WITH r AS ({_REMEMBERED}),
  l AS (SELECT *, CASE kind WHEN 'character' THEN '  - ' || name || ' (also: ' || left(name, 1) || pos || ') [user]' || {tag} || ': ' || left(description, 100) || '.' WHEN 'place' THEN '  - ' || name || ' (panel ' || last_seen || '): ' || left(description, 100)
      WHEN 'thread' THEN '  - ' || description ELSE '  - panel ' || pos || ': ' || left(description, 100) END AS line,
    CASE WHEN kind = 'character' THEN CASE WHEN last_seen = 0 THEN 1 WHEN 140 - last_seen > 60 THEN 2 ELSE 0 END ELSE 0 END AS k, CASE WHEN kind IN ('character', 'place') THEN -last_seen ELSE -pos END AS o FROM r WHERE kind <> 'thread' OR NOT closed),
  g AS (SELECT series, {", ".join(f"coalesce(list(line ORDER BY k, o, pos) FILTER (kind = '{k}'), []) AS {k}s" for k in ("character", "place", "thread", "event"))} FROM l GROUP BY series),
  b AS (SELECT series, CASE {pick} ELSE {len(STEPS)} END::INTEGER AS step, [{blocks}] AS blocks FROM g WHERE len(characters) + len(places) + len(threads) > 0)
SELECT series, step, blocks[step] AS block FROM b"""


@query(_memory_sql())
def f12_memory_block(spark, folder):
    from panelframe.operators import memory as M

    n = F.length(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("role") == "user", "character").when(F.col("role") == "system", "event").when(n % 3 == 0, "place").otherwise("thread")
    name = F.concat_ws(" ", "role", "turn")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("series"), kind.alias("kind"), (F.col("turn") + 1).alias("pos"), name.alias("name"), F.lit("user").alias("role"), F.substring(F.translate(F.trim(F.coalesce("text", F.lit(""))), "\n", " "), 1, 300).alias("description"), F.array(F.concat(F.substring(name, 1, 1), (F.col("turn") + 1).cast("string"))).alias("aliases"), F.when(n % 5 == 0, "resolved").otherwise("active").alias("status"), (F.col("turn") + 1).alias("first_seen"), F.when(n % 4 == 0, 0).otherwise(F.col("turn") * 20).alias("last_seen"))
    return M.memory_block(rows, F.lit(140), 900)
