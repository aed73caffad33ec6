"""Overlay queries: documents by source stand for sessions of panels, labels for edits, customers for chained sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelframe.operators import intervals as I
from panelframe.operators import overlay as O
from panelframe.operators.ranks import numbered
from panelframe.plans.registry import query, table


@query("""SELECT o_orderkey, o_custkey, coalesce(n, 0) AS lines, c_name FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def e01_left_joins(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").join(names, "o_custkey", "left")
    return out.withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))


def turns(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), "role", "text")


@query("""SELECT conv_id AS chapter, turn AS idx, text, CASE WHEN role = 'assistant' THEN 'script' ELSE 'caption' END AS source FROM conversations""")
def e04_coverage_fill_whole(spark, folder):
    t = turns(spark, folder)
    return O.fill_missing(t.where("role = 'assistant'"), t, ["chapter", "idx"], t)[0]


@query("""SELECT conv_id AS chapter, turn AS idx, batch FROM (SELECT conv_id, turn, ceil(row_number() OVER (PARTITION BY conv_id ORDER BY turn) / 2.0)::BIGINT AS batch FROM conversations WHERE role <> 'assistant') WHERE batch <= 3""")
def e04_gap_batches(spark, folder):
    t = turns(spark, folder)
    return O.fill_missing(t.where("role = 'assistant'"), t, ["chapter", "idx"], t, batch=2, most=3)[1]


@query("""SELECT doc_id, doc_id AS benchmark_id, coalesce(part, 'beat') AS part FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'hook' END AS part, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC NULLS LAST) AS n FROM labels)
WHERE n = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def e05_first_lines_whole(spark, folder):
    lines = table(spark, folder, "labels").select("doc_id", F.col("doc_id").alias("benchmark_id"), F.when(F.col("quality") == 1, "hook").alias("part"), F.coalesce(-F.col("quality"), F.lit(1)).alias("seq"))
    return O.first_lines(lines, table(spark, folder, "documents").where("lang = 'en'"), ["doc_id"], "seq").drop("seq")


@query("""SELECT source, bool_and(doc_id % 50 <> 3) AS valid FROM documents GROUP BY source""")
def e06_same_members(spark, folder):
    active = table(spark, folder, "documents").select("source", F.col("doc_id").alias("id"))
    return O.same_members(active.where("id % 50 <> 3"), active, "source")


_EDITS = "SELECT source, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN -doc_id END AS position, toxic = 1 AS deleted, CASE WHEN quality = 1 THEN 'reviewed' END AS review FROM documents JOIN labels USING (doc_id)"
_VIEW = f"""SELECT source, id, CASE WHEN NOT deleted THEN row_number() OVER (PARTITION BY source, deleted ORDER BY position NULLS LAST, c, a, b, id) END AS display_order, deleted, CASE WHEN deleted THEN 'deleted' ELSE coalesce(review, 'needs_review') END AS review_status
FROM (SELECT r.source, r.id, c, a, b, position, coalesce(deleted, false) AS deleted, review FROM (SELECT source, doc_id AS id, 0 AS c, n_chars % 1000 AS a, doc_id AS b FROM documents WHERE doc_id % 9 <> 1 UNION ALL SELECT source, doc_id, 1, doc_id, 0 FROM documents WHERE doc_id % 9 = 1) r LEFT JOIN ({_EDITS}) e ON e.source = r.source AND e.id = r.id)"""


def edits(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    return rows.select("source", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, -F.col("doc_id")).alias("position"), (F.col("toxic") == 1).alias("deleted"), F.when(F.col("quality") == 1, "reviewed").alias("review"))


def view(spark, folder):
    docs = table(spark, folder, "documents").select("source", F.col("doc_id").alias("id"), (F.col("n_chars") % 1000).alias("y_start"), F.col("doc_id").alias("panel_index"), F.col("doc_id").alias("seq"))
    return O.edited_view(docs.where("id % 9 <> 1"), docs.where("id % 9 = 1"), edits(spark, folder), "source")


@query(_VIEW)
def e07_edited_view(spark, folder):
    return view(spark, folder)


_LINKS = "SELECT c_custkey AS session, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey - c_custkey % 7 + (c_custkey + 1) % 7 END AS earlier FROM customer"
_CHAIN = f"""RECURSIVE links AS ({_LINKS}), chain AS (SELECT session, session AS ancestor, 0 AS depth, [session] AS visited FROM links UNION ALL
  SELECT c.session, l.earlier, c.depth + 1, list_append(visited, l.earlier) FROM chain c JOIN links l ON l.session = c.ancestor WHERE l.earlier IS NOT NULL AND NOT list_contains(visited, l.earlier))"""


def chain(spark, folder):
    k = F.col("c_custkey")
    links = table(spark, folder, "customer").select(k.alias("session"), F.when(k % 7 != 0, k - k % 7 + (k + 1) % 7).alias("earlier"))
    return O.chains(links)


@query(f"WITH {_CHAIN} SELECT session, ancestor, depth FROM chain")
def e09_chains(spark, folder):
    return chain(spark, folder)


@query(f"""WITH {_CHAIN}, o AS (SELECT o_custkey AS ancestor, o_orderkey::VARCHAR AS id, o_orderkey AS position FROM orders)
SELECT session, CASE WHEN depth = 0 THEN id ELSE 's' || substr(sha1(ancestor::VARCHAR), 1, 8) || '_' || id END AS id, row_number() OVER (PARTITION BY session ORDER BY depth DESC, position, id) AS display_order FROM chain JOIN o USING (ancestor)""")
def e08_combined_view(spark, folder):
    panels = table(spark, folder, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("position"))
    return O.combined(chain(spark, folder), panels)


@query(f"""WITH {_CHAIN}, o AS (SELECT o_custkey AS ancestor, o_orderkey::VARCHAR AS id, o_orderkey AS position, o_orderstatus AS status FROM orders),
  m AS (SELECT session, id AS raw, status, row_number() OVER (PARTITION BY session ORDER BY depth DESC, position, id) AS number FROM chain JOIN o USING (ancestor))
SELECT session, raw, number, CASE WHEN status <> 'O' THEN round(raw::BIGINT % 97 / 10.0::DOUBLE, 1) END AS audio_seconds FROM m""")
def e10_continuation_whole(spark, folder):
    """All orders are panels; those that are no longer open have audio."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("position"), "o_orderstatus")
    audio = rows.where("o_orderstatus <> 'O'").select(F.col("id").alias("raw"), F.round(F.col("position") % 97 / 10.0, 1).alias("audio_seconds"))
    merged = O.combined(chain(spark, folder), rows).select("session", F.regexp_replace("id", "^s[0-9a-f]{8}_", "").alias("raw"), F.col("display_order").alias("number"))
    return merged.join(audio, "raw", "left")


@query("""WITH n AS (SELECT c_name AS name FROM customer), a AS (SELECT DISTINCT left(c_name, length(c_name) - (c_custkey % 3)::INT) AS q FROM customer)
SELECT q, coalesce((SELECT max(name) FROM n WHERE name = q), (SELECT CASE WHEN count(*) = 1 THEN max(name) END FROM n WHERE starts_with(name, q))) AS name FROM a""")
def e11_prefix(spark, folder):
    c = table(spark, folder, "customer")
    asked = c.select(F.expr("left(c_name, length(c_name) - cast(c_custkey % 3 as int))").alias("q")).distinct()
    return O.resolve_prefix(asked, c.select(F.col("c_name").alias("name")))


_OVER = "SELECT CASE WHEN doc_id % 2 = 0 THEN 's0123abcd_' || doc_id ELSE doc_id::VARCHAR END AS id, left(text, 60) AS narration FROM documents"


def overrides(spark, folder, narration):
    i = F.col("doc_id").cast("string")
    panels = table(spark, folder, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s0123abcd_"), i)).otherwise(i).alias("id"), narration.alias("narration"))
    own = table(spark, folder, "labels").select(i.alias("id"), F.when(F.col("quality") == 1, F.concat(F.lit("edited "), i)).otherwise(" ").alias("text"))
    return O.overridden(panels, own)


@query("""WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 's0123abcd_' || doc_id ELSE doc_id::VARCHAR END AS id, text AS narration FROM documents), o AS (SELECT doc_id::VARCHAR AS id, 'edited ' || doc_id AS text FROM labels WHERE quality = 1)
SELECT p.id, coalesce(a.text, b.text, narration, '') AS text, coalesce(narration, '') AS ai_text, coalesce(a.text, b.text) IS NOT NULL AS edited FROM p LEFT JOIN o a ON a.id = p.id LEFT JOIN o b ON b.id = regexp_replace(p.id, '^s[0-9a-f]{8}_', '')""")
def e12_overrides_whole(spark, folder):
    return overrides(spark, folder, F.col("text"))


@query("""WITH r AS (SELECT source, doc_id, CASE WHEN toxic = 1 AND source IN ('src1', 'src2', 'src3') THEN 0 WHEN quality = 1 AND source IN ('src3', 'src4', 'src5', 'src6') THEN 1 ELSE 2 END AS k, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)),
  u AS (SELECT source, doc_id, 0 AS source_rank FROM r WHERE toxic = 1 AND source IN ('src1', 'src2', 'src3') UNION ALL SELECT source, doc_id, 1 FROM r WHERE quality = 1 AND source IN ('src3', 'src4', 'src5', 'src6') UNION ALL SELECT source, doc_id, 2 FROM r)
SELECT source, doc_id, source_rank FROM u QUALIFY source_rank = min(source_rank) OVER (PARTITION BY source)""")
def e13_precedence(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id", "left")
    pick = lambda c: rows.where(c).select("source", "doc_id")
    return O.precedence([pick("toxic = 1 and source in ('src1', 'src2', 'src3')"), pick("quality = 1 and source in ('src3', 'src4', 'src5', 'src6')"), pick("true")], "source")


@query("""WITH roster AS (SELECT n_regionkey AS series, n_name AS key, n_nationkey AS pos FROM nation), names AS (SELECT series, key, pos, lower(key) AS n FROM roster UNION ALL SELECT series, key, pos, lower(left(key, 4)) FROM roster UNION ALL SELECT series, key, pos, lower('the ' || key) FROM roster),
  f AS (SELECT series, n, arg_min(key, pos) AS entity FROM names GROUP BY ALL), m AS (SELECT c_custkey, n_regionkey AS series, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN ' the ' || n_name || ' ' WHEN 2 THEN left(n_name, 4) ELSE n_name || 'x' END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, m.series, name, entity FROM m LEFT JOIN f ON f.series = m.series AND f.n = lower(trim(name))""")
def e14_entity_keys(spark, folder):
    n = table(spark, folder, "nation")
    roster = n.select(F.col("n_regionkey").alias("series"), F.col("n_name").alias("key"), F.col("n_nationkey").alias("pos"), F.array(F.substring("n_name", 1, 4), F.concat(F.lit("the "), "n_name")).alias("aliases"))
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat(F.lit(" the "), "n_name", F.lit(" "))).when(k == 2, F.substring("n_name", 1, 4)).otherwise(F.concat("n_name", F.lit("x")))
    mentions = table(spark, folder, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_regionkey").alias("series"), name.alias("name"))
    return O.entity_keys(mentions, roster)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 20 OR o_orderkey = 33 OR o_orderkey >= 14000 OR o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def e16_range_spec(spark, folder):
    return O.in_ranges(table(spark, folder, "orders"), "o_orderkey", "10-20, 33, 14000-, last").select("o_orderkey")


@query("SELECT event_id, user_id, batch FROM (SELECT event_id, user_id, event_id // 5 AS batch, bool_and(user_id % 50 <> 7) OVER (PARTITION BY event_id // 5) AS ok FROM events) WHERE ok")
def e20_checked_operations(spark, folder):
    ops = table(spark, folder, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 5).alias("batch"))
    return O.checked_operations(ops, ops.where("user_id % 50 <> 7"), "batch", "user_id")


@query(f"""SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY display_order) AS number, CASE WHEN id % 3 = 0 THEN 'override ' || id ELSE text END AS narration FROM ({_VIEW}) v JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = v.id WHERE NOT deleted AND review_status = 'reviewed'""")
def e21_confirmed_whole(spark, folder):
    return confirmed(spark, folder, F.col("text"))


def confirmed(spark, folder, narration):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), narration.alias("narration"))
    # Numbered on ids alone, before the texts come in.
    rows = numbered(view(spark, folder).where("not deleted and review_status = 'reviewed'"), ["source"], [F.col("display_order")], "number").join(docs, "id")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("override "), F.col("id").cast("string"))).otherwise(F.col("narration"))
    return rows.select("source", "id", "number", text.alias("narration"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')")
def e22_orphans(spark, folder):
    return O.orphans_removed(table(spark, folder, "labels"), table(spark, folder, "documents").where("lang <> 'fr'"), ["doc_id"]).select("doc_id", "quality")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN reverse(text) ELSE text END AS caption, turn % 2 = 0 AND coalesce(reverse(text) <> text, false) AS changed FROM conversations""")
def e23_caption_sync_whole(spark, folder):
    return synced(spark, folder, F.col("text"))


def synced(spark, folder, caption):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", caption.alias("caption"))
    return O.synced_captions(rows, rows.where("turn % 2 = 0").select("conv_id", "turn", F.reverse("caption").alias("text")), ["conv_id", "turn"])


@query("""SELECT p_brand AS strip, p_partkey::VARCHAR AS id, p_partkey AS index, 0::BIGINT AS x, p_size * 10::BIGINT AS y, max(p_size) OVER (PARTITION BY p_brand) * 20::BIGINT AS w, p_size * 5::BIGINT AS h, p_partkey || '.png' AS source_image FROM part""")
def e19_page_panels(spark, folder):
    y0 = (F.col("p_size") * 10).alias("y0")
    width = (F.max("p_size").over(Window.partitionBy("p_brand")) * 20).alias("width")
    cuts = table(spark, folder, "part").select(F.col("p_brand").alias("strip"), width, F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("k"), y0, (y0 + F.col("p_size") * 5).alias("y1"), F.concat("p_partkey", F.lit(".png")).alias("image_file"))
    return I.page_panels(cuts).select("strip", "id", "index", "bbox.x", "bbox.y", "bbox.w", "bbox.h", "source_image")


# Six documents are a strip, four strips a chain, three changes a batch; what a document's own length says is changed at
# another document before it, which may be none of its chain.
_REVIEWS = """RECURSIVE docs AS (SELECT doc_id AS d, doc_id // 6 AS s, coalesce(n_chars, 0) AS n FROM documents),
  ops AS (SELECT o.d AS seq, o.s AS session, o.d // 3 AS batch, o.n % 6 AS k, o.d - o.n % 17 AS target, t.s AS owner,
      CASE o.n % 6 WHEN 2 THEN ['needs_review', 'reviewed', 'edited', 'lost'][(o.d % 4 + 1)::INT] END AS status FROM docs o LEFT JOIN docs t ON t.d = o.d - o.n % 17),
  marked AS (SELECT *, CASE WHEN k < 4 AND (owner IS NULL OR owner // 4 <> session // 4) THEN 'unknown panel' WHEN k = 2 AND status = 'lost' THEN 'invalid status' END AS problem FROM ops),
  good AS (SELECT * FROM marked WHERE batch NOT IN (SELECT batch FROM marked WHERE problem IS NOT NULL)),
  steps AS (SELECT *, row_number() OVER (PARTITION BY strip ORDER BY seq) AS step FROM (
    SELECT owner AS strip, seq, k, target, status FROM good WHERE k < 4
    UNION ALL SELECT c.s, g.seq, g.k, NULL, NULL FROM good g JOIN (SELECT DISTINCT s FROM docs) c ON c.s // 4 = g.session // 4 AND c.s <= g.session WHERE g.k >= 4)),
  state AS (
    SELECT s AS strip, 0::BIGINT AS step, list({'id': d, 'gone': false, 'said': NULL::VARCHAR} ORDER BY n, d::VARCHAR) AS p, []::BIGINT[] AS locked, NULL::BIGINT AS confirmed FROM docs GROUP BY s
    UNION ALL
    SELECT strip, step, CASE WHEN k IN (0, 1, 3) THEN list_transform(p, lambda x: CASE WHEN x.id = target THEN {'id': x.id, 'gone': k = 0, 'said': x.said} ELSE x END)
      WHEN k = 2 THEN list_transform(p, lambda x: CASE WHEN x.id = target THEN {'id': x.id, 'gone': x.gone, 'said': status} ELSE x END)
      WHEN k = 5 THEN list_transform(p, lambda x: CASE WHEN list_contains(next, x.id) THEN {'id': x.id, 'gone': x.gone, 'said': coalesce(x.said, 'reviewed')} ELSE x END) ELSE p END,
      CASE WHEN k >= 4 AND len(next) > 0 THEN next ELSE locked END,
      CASE WHEN k IN (0, 1, 3) THEN NULL WHEN k >= 4 AND len(next) > 0 THEN seq ELSE confirmed END
    FROM (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE live END AS next FROM (
      SELECT t.strip, t.step, t.seq, t.k, t.target, t.status, a.p, a.locked, a.confirmed, list_transform(list_filter(a.p, lambda x: NOT x.gone), lambda x: x.id) AS live,
        list_filter(a.locked, lambda i: list_contains(list_transform(list_filter(a.p, lambda x: NOT x.gone), lambda x: x.id), i)) AS kept
      FROM state a JOIN steps t ON t.strip = a.strip AND t.step = a.step + 1))),
  last AS (SELECT strip, arg_max(struct_pack(p := p, locked := locked, confirmed := confirmed), step) AS z FROM state GROUP BY strip)"""


def _reviews(spark, folder):
    from panelframe.operators import review as R

    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("d"), F.floor(F.col("doc_id") / 6).alias("session"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    panels = docs.select("session", F.col("d").cast("string").alias("id"), F.col("n").alias("y_start"))
    links = docs.select("session").distinct().withColumn("earlier", F.when(F.col("session") % 4 != 0, F.col("session") - 1))
    target = F.col("d") - F.col("n") % 17
    owner = F.floor(target / 6)
    k = (F.col("n") % 6).cast("int")
    op = F.element_at(F.array(*map(F.lit, ["delete", "restore", "status", "restore", "confirm", "confirm_all"])), k + 1)
    name = F.when(owner == F.col("session"), target.cast("string")).otherwise(F.concat(F.lit("s"), F.substring(R.session_name(owner), 1, 8), F.lit("_"), target.cast("string")))
    status = F.when(k == 2, F.element_at(F.array(*map(F.lit, [*R.STATUSES, "lost"])), (F.col("d") % 4 + 1).cast("int")))
    log = docs.select(F.floor(F.col("d") / 3).alias("batch"), F.col("d").alias("seq"), "session", op.alias("op"), F.when(k < 4, name).alias("id"), status.alias("status"))
    return R.review_changes(panels, links, log)


@query(f"""WITH {_REVIEWS}
SELECT strip AS session, x.id::VARCHAR AS id, x.gone AS deleted, coalesce(x.said, 'needs_review') AS review_status, list_position(z.locked, x.id)::BIGINT AS position, z.confirmed AS confirmed
FROM (SELECT strip, z, unnest(z.p) AS x FROM last)""")
def e20_review_changes(spark, folder):
    return _reviews(spark, folder)[0]


@query(f"WITH {_REVIEWS} SELECT batch, arg_min(seq, seq) AS seq, arg_min(problem, seq) AS problem FROM marked WHERE problem IS NOT NULL GROUP BY batch")
def e20_refused_batches(spark, folder):
    return _reviews(spark, folder)[1]


@query("SELECT n::DOUBLE AS number FROM (SELECT unnest([7, 33, 14000, 999999999]) AS n) WHERE n NOT IN (SELECT o_orderkey FROM orders)")
def e16_missing_numbers(spark, folder):
    return O.missing_numbers(table(spark, folder, "orders"), "o_orderkey", "10-20, 7, 33, 14000, 999999999, last, 5-")
