"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelframe.llm import ann, bpe_codec, divergence, ngram_join, packing, piece_codec, prefix_trie, quality_model, quality_rules, secret_scan, sharding, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    records = warc.read_archives(warc.write_archives(pages), payloads=False)
    kind = pages.schema["page_id"].dataType
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind).alias(c)
    checked = records.where(F.when(F.col("intact"), True).otherwise(F.raise_error(F.concat(F.lit("broken record of page "), F.col("page_id"))).isNull()))
    return checked.select(back("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.train(docs, _table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_narrow(_table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability"]
    return judged.select("doc_id", *(F.col(f"_rules.{n}").alias(n) for n in names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleave(_table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_neighbours, op3_warc, op4_secret_scan, op5_quality_model, op6_quality_rules, op7_packing, op8_ngram_join, op9_bpe_codec, op10_interleave, op11_source_divergence, op12_piece_codec, op13_prefix_trie)
}
# op8: all pairs that share a shingle, then the smallest reachable id. op11: every kept term in every pair of groups.
# op13: every conversation's every prefix, CRC-32 bit by bit.
ORACLE: dict[str, str] = {
    "op8_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
held AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(total)::HUGEINT AS lang_n FROM held GROUP BY 1),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN held USING (lang, term) GROUP BY 1, 2, 3),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS group_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY 1, 2),
shares AS (
  SELECT g.lang, g.source, h.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (g.group_n + v.terms) AS p,
    1 + 1000000000::HUGEINT * (h.total + 1) // (v.lang_n + v.terms) AS q
  FROM groups g JOIN v USING (lang) JOIN held h USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = h.term),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(x.value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3) x
  ON x.lang = g.lang AND x.source = g.source AND x.other = o.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
codes AS (SELECT c, turns, list_concat([4294967295], list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)) AS bytes FROM own),
asks AS (
  SELECT c, turns, xor(list_reduce(bytes, lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM codes),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS p FROM asks a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefix AS (SELECT c, d, p[1:d] AS key, len(p) = d AS ended FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM built)),
nodes AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(key[d].t, '[^\x20\x09-\x0D]+')) END AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends
  FROM prefix GROUP BY key, d),
children AS (SELECT key[1:d - 1] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(c.n, 0) AS children FROM nodes n LEFT JOIN children c ON c.key = n.key),
below AS (SELECT key[1:j] AS key, leaf, saved FROM (SELECT key, children = 0 AS leaf, (n - 1) * words AS saved, unnest(range(0, d + 1)) AS j FROM known)),
sums AS (SELECT key, count(*) FILTER (leaf) AS leaves, sum(saved)::BIGINT AS saved FROM below GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n::BIGINT AS n_convs, k.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN sums s ON s.key = k.key LEFT JOIN nodes p ON k.d > 0 AND p.key = k.key[1:k.d - 1]""",
}
