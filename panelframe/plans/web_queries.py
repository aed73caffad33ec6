"""Web and log queries: stored pages, order comments and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelframe.functions import logs as G
from panelframe.functions import text as X
from panelframe.operators import web as W
from panelframe.plans import sql as S
from panelframe.plans.registry import query, table


def reader_pages(spark, folder):
    """Pages whose links are images: every other page has its list in a reader's container."""
    html = F.regexp_replace("html", '<a href="', '<img data-src="')
    html = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(html, "<ul>", '<ul id="readerarea">')).otherwise(F.regexp_replace(html, '(data-src="[^"]*)"', '$1.png"'))
    return table(spark, folder, "pages").select("page_id", F.concat(F.lit("https://example.org/c/"), "page_id", F.lit("/")).alias("url"), html.alias("html"))


@query()
def a14_page_images(spark, folder):
    rows = W.page_images(reader_pages(spark, folder), "page_id", "html")
    return rows.select("page_id", "ord", F.array_join("urls", " ").alias("urls"), "in_container", "is_page_class", "width")


@query()
def e15_page_art(spark, folder):
    pages = reader_pages(spark, folder)
    return W.page_art(W.page_images(pages, "page_id", "html"), pages, "page_id", "url")


_ANCHORS = "regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')"
_HREF = "trim(regexp_extract(a, '(?i)href=[\"'']([^\"'']+)[\"'']', 1))"
_LINKS = f"""SELECT page_id, url, arg_min(label, n) AS label FROM (SELECT page_id, n, 'https://example.org' || CASE WHEN starts_with(h, '/') THEN h ELSE '/' || h END AS url, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), {S.lit(X.SPACE + '+')}, ' ', 'g')) AS label
  FROM (SELECT page_id, n, a, {_HREF} AS h FROM (SELECT page_id, unnest({_ANCHORS}) AS a, generate_subscripts({_ANCHORS}, 1) AS n FROM pages)) WHERE h <> '' AND NOT regexp_matches(lower(h), '/chapter-list|-chapter-list|chapter_page')) GROUP BY page_id, url"""


def site(spark, folder):
    return table(spark, folder, "pages").withColumn("url", F.lit("https://example.org/"))


@query(_LINKS)
def a15_links(spark, folder):
    return W.links(site(spark, folder), "page_id", "url", "html")


@query(f"""SELECT page_id, url, label, nullif(replace(regexp_extract(label, {S.lit(W.NUMBERED)}, 1), ',', '.'), '')::DOUBLE AS number FROM (SELECT page_id, url, 'Chapter ' || page_id || ' ' || label AS label FROM ({_LINKS}))""")
def a15_chapter_links(spark, folder):
    html = F.regexp_replace("html", "(<a href=[^>]*>)", F.concat(F.lit("$1Chapter "), F.col("page_id").cast("string"), F.lit(" ")))
    return W.chapter_links(site(spark, folder).withColumn("html", html), "page_id", "url", "html")


@query("""SELECT page_id % 20 AS batch, count(*) FILTER (s = 'saved') AS saved, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (s = 'failed'), '') AS failed_urls
FROM (SELECT page_id, url, CASE WHEN length(html) < 3000 THEN 'failed' WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'saved' END AS s FROM pages) GROUP BY batch""")
def a16_manifest(spark, folder):
    status = F.when(F.length("html") < 3000, "failed").when(F.col("page_id") % 3 == 0, "skipped").otherwise("saved")
    return W.manifest(table(spark, folder, "pages").select((F.col("page_id") % 20).alias("batch"), "url", status.alias("status")), "batch")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS kind FROM pages""")
def a06_image_kind(spark, folder):
    k = F.col("page_id") % 5
    head = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode(F.substring("html", 1, 20), "UTF-8"))
    kind = F.when(k == 2, "image/gif").when(k == 4, "text/html").otherwise("")
    url = F.when(k == 3, F.concat(F.lit("https://x.org/"), F.col("page_id").cast("string"), F.lit("/p.WEBP?x=1"))).otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", W.image_kind(head, kind, url).alias("kind"))


@query("""SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(length(regexp_replace(p, '^0+(.)', '\\1'))::VARCHAR, 10, '0') || regexp_replace(p, '^0+(.)', '\\1') ELSE p END), '') AS key FROM pages""")
def b28_natural_key(spark, folder):
    return table(spark, folder, "pages").select("page_id", W.natural_key(F.col("url")).alias("key"))


_TITLE = f"trim(regexp_replace(coalesce(text, ''), {S.lit(X.SPACE + '+')}, ' ', 'g'), ' \"''“”')"
_WORD = "regexp_replace(CASE WHEN contains(h, ' ') THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END, '[ ,;:.-]+$', '')"


@query(f"""SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN {_WORD} <> '' THEN {_WORD} ELSE rtrim(h) END AS title, CASE WHEN doc_id % 2 = 0 THEN 'chapter_' || CASE WHEN length((doc_id // 2)::VARCHAR) < 4 THEN lpad((doc_id // 2)::VARCHAR, 4, '0') ELSE (doc_id // 2)::VARCHAR END ELSE 'a_' || doc_id END AS slug
FROM (SELECT doc_id, t, left(t, 80) AS h FROM (SELECT doc_id, {_TITLE} AS t FROM documents))""")
def b29_titles(spark, folder):
    number = F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 2).cast("double"))
    url = F.concat(F.lit("https://x.org/s/A-"), F.col("doc_id").cast("string"), F.lit("/?q=1"))
    return table(spark, folder, "documents").select("doc_id", W.clean_title(F.col("text")).alias("title"), W.slug(number, url).alias("slug"))


@query(f"""SELECT page_id, url, regexp_matches(lower(url), '{"|".join(W.JUNK_PARTS)}') OR len(list_intersect(regexp_split_to_array(lower(url), '[^a-z0-9]+'), {W.JUNK_WORDS})) > 0 AS junk, regexp_matches(lower(url), {S.lit(W.IMAGE_ENDS)}) AS art FROM ({_LINKS})""")
def b30_url_rules(spark, folder):
    return W.links(site(spark, folder), "page_id", "url", "html").select("page_id", "url", W.is_junk(F.col("url")).alias("junk"), W.looks_like_page(F.col("url")).alias("art"))


_MESSAGE = """CASE event_id % 6 WHEN 0 THEN 'HTTP 429: quota, retry in ' || (event_id % 40) || '.5s' WHEN 1 THEN 'Connection reset by peer' WHEN 2 THEN '{"error": {"retryDelay": "' || (event_id % 90) || 's"}}' WHEN 3 THEN 'read timeout' WHEN 4 THEN 'bad value' ELSE 'status 503' END"""


@query(f"""SELECT event_id, regexp_matches(lower(m), '{G.RATE_LIMIT}') AS rate_limit, regexp_matches(lower(m), '{G.TRANSIENT}') AS transient, coalesce(TRY_CAST(regexp_extract(m, '"retryDelay": "(\\d+)s"', 1) AS DOUBLE), TRY_CAST(regexp_extract(m, '[Rr]etry [Ii]n (\\d+(?:\\.\\d+)?)\\s*s', 1) AS DOUBLE)) AS delay FROM (SELECT event_id, {_MESSAGE} AS m FROM events)""")
def b26_error_classes(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.expr(_MESSAGE.replace("(event_id % 40)", "cast(event_id % 40 as string)").replace("(event_id % 90)", "cast(event_id % 90 as string)")).alias("m"))
    m = F.col("m")
    return rows.select("event_id", G.is_rate_limit(m).alias("rate_limit"), G.is_transient(m).alias("transient"), G.retry_delay(m).alias("delay"))


_SHAPES = "coalesce(text, '')"
for _p in G.KEY_SHAPES:
    _SHAPES = f"regexp_replace({_SHAPES}, {S.lit(_p)}, '{G.REDACTED}', 'g')"


@query(f"SELECT doc_id, sha256({_SHAPES}) AS digest, {_SHAPES} <> coalesce(text, '') AS changed FROM documents")
def b27_redaction(spark, folder):
    c = X.text(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.sha2(G.redacted(c), 256).alias("digest"), (G.redacted(c) != c).alias("changed"))


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN '***REDACTED***' ELSE event_type END AS value FROM events""")
def b27_map_redaction(spark, folder):
    key = F.element_at(F.array(F.lit("apiKey"), F.lit("author"), F.lit("x_auth_token"), F.lit("monkey")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", F.map_values(G.redacted_map(F.create_map(key, F.col("event_type"))))[0].alias("value"))


_TW = lambda e: f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9'']+'), lambda w: NOT list_contains({X.STOP_WORDS}, w)))"


@query(f"""SELECT conv_id, turn, len(h) >= 2 AND len(s) > 0 AND len(list_intersect(h, s))::DOUBLE / nullif(len(h), 0) >= 0.6 AS matched FROM (SELECT conv_id, turn, {_TW("coalesce(said, '')")} AS h, {_TW("coalesce(text, '')")} AS s FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations))""")
def b13_thread_match(spark, folder):
    """Whether each turn has enough of the words of the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, folder, "conversations").withColumn("said", before)
    return rows.select("conv_id", "turn", G.thread_match(F.col("said"), F.col("text")).alias("matched"))


@query("""SELECT doc_id, left(trim(regexp_replace(replace(coalesce(text, ''), '```', ''), '[\\r\\n]+', ' ', 'g')), 300) AS line FROM documents""")
def b14_sanitised(spark, folder):
    return table(spark, folder, "documents").select("doc_id", G.sanitised(F.col("text")).alias("line"))


@query("""SELECT event_id, props AS part, (props::JSON->>'k')::BIGINT AS k FROM events""")
def b31_json_part(spark, folder):
    wrapped = F.concat(F.lit("```json\nSure: [1] "), "props", F.lit(" done\n```"))
    rows = table(spark, folder, "events").select("event_id", G.json_part(wrapped).alias("part"))
    return rows.select("event_id", "part", F.try_variant_get(F.try_parse_json("part"), "$.k", "bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'max_tokens' ELSE event_type END AS label, event_id % 2 = 0 AS truncated FROM events""")
def b40_finish_reason(spark, folder):
    reason = F.when(F.col("event_id") % 2 == 0, "FinishReason.MAX_TOKENS").otherwise(F.upper("event_type"))
    return table(spark, folder, "events").select("event_id", G.finish_label(reason).alias("label"), G.is_truncated(reason).alias("truncated"))


@query("""SELECT l_orderkey, l_linenumber, sha256('{"a":"' || l_returnflag || '","n":' || l_linenumber || '}') AS hash, true AS same, l_linenumber = 1 AS as_first FROM lineitem""")
def b35_config_hash(spark, folder):
    """The hash itself; one of the fields in another order and style, and one of another number."""
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    a = G.config_hash({"n": number, "a": flag, "color": F.col("l_tax")}, {"color"})
    b = G.config_hash({"a": flag, "color": F.lit(0), "n": number}, {"color"})
    first = G.config_hash({"n": F.lit(1), "a": flag}, set())
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", a.alias("hash"), (a == b).alias("same"), (a == first).alias("as_first"))


_MODELS = {"model-2.5-large": ["Large 2.5", "2.5"], "model-2.0-small": ["Small 2.0", "2.0"]}


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'model-2.5-large' WHEN 'view' THEN 'model-2.0-small' WHEN 'error' THEN 'model-x' ELSE event_type END AS model FROM events""")
def b36_model_names(spark, folder):
    t = F.col("event_type")
    raw = F.when(t == "click", F.when(F.col("event_id") % 2 == 0, " LARGE-2.5!").otherwise("2_5")).when(t == "view", "small 2 0").when(t == "error", "model-x").otherwise(t)
    return table(spark, folder, "events").select("event_id", G.accepted_name(raw, _MODELS, "model-").alias("model"))


@query("""SELECT conv_id, turn, '#' || turn || ' [' || role || '] ' || coalesce(text, '') AS row, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM conversations""")
def b37_prompt_rows_whole(spark, folder):
    return prompt_rows(spark, folder, X.text(F.col("text")))


def prompt_rows(spark, folder, text):
    from pyspark.sql import Window

    last = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    row = F.concat(F.lit("#"), "turn", F.lit(" ["), "role", F.lit("] "), text)
    return table(spark, folder, "conversations").select("conv_id", "turn", row.alias("row"), F.array_join(last, " | ").alias("context"))


@query("""SELECT event_id, least(greatest(coalesce((props::JSON->>'k')::BIGINT, 10), 5), 80) AS k, 'standard' AS style FROM events""")
def b38_defaults(spark, folder):
    own = F.from_json("props", "map<string,string>")
    base = F.create_map(F.lit("k"), F.lit("10"), F.lit("style"), F.lit("standard"))
    merged = F.map_filter(F.map_zip_with(base, own, lambda k, b, o: F.when(b.isNotNull(), F.coalesce(o, b))), lambda k, v: v.isNotNull())
    rows = table(spark, folder, "events").select("event_id", merged.alias("m"))
    return rows.select("event_id", F.least(F.greatest(F.col("m")["k"].try_cast("bigint"), F.lit(5)), F.lit(80)).alias("k"), F.col("m")["style"].alias("style"))


@query(f"""SELECT conv_id, turn, left({S.strip_non_latin("coalesce(text, '')")}, 120) AS line, regexp_matches(coalesce(text, ''), {S.NON_LEXICAL}) AS placeholder FROM conversations WHERE role <> 'system'""")
def b39_script_input(spark, folder):
    t = F.col("text")
    return table(spark, folder, "conversations").where("role <> 'system'").select("conv_id", "turn", F.substring(X.strip_non_latin(t), 1, 120).alias("line"), X.is_non_lexical(t).alias("placeholder"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'not an image' WHEN strlen(coalesce(html, '')) + 8 < 1500 THEN 'too small' END AS problem FROM pages""")
def a06_fetch_problems(spark, folder):
    """Two pages of three are images by their first bytes."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    content = F.when(F.col("page_id") % 3 == 0, body).otherwise(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), body))
    return table(spark, folder, "pages").select("page_id", W.fetch_problem(content, W.image_kind(content, F.lit("text/html"), F.col("url"))).alias("problem"))


@query("""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN (event_id // 3600) * 3600 + (event_id // 60 % 60) * 60 + round(event_id % 60 + value % 1, 2) END AS seconds FROM events""")
def b25_progress(spark, folder):
    from panelframe.functions.text import progress_seconds

    i = F.col("event_id")
    last = F.format_string("%05.2f", F.round(i % 60 + F.col("value") % 1, 2))
    line = F.concat(F.lit("frame= 7 time="), F.when(i % 4 > 0, F.format_string("%02d:%02d:", F.floor(i / 3600), F.floor(i / 60) % 60)).otherwise("N/A"), F.when(i % 2 == 0, last).otherwise(F.replace(last, F.lit("."), F.lit(","))), F.lit(" bitrate=1"))
    return table(spark, folder, "events").select("event_id", progress_seconds(line).alias("seconds"))
