"""The dealt operators as queries over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import bpe, decontaminate, embedding_dedup, hard_negatives, html_crf, jaccard_join, language_id, piece_bpe, sharding, suffix_dedup, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: links, copies and group of each."""
    return jaccard_join.near_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _bucket(buckets: int) -> Column:
    """crc32 of the doc_id as text, modulo ``buckets``; of a null id that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(buckets))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three of four buckets of ids."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_bucket(4) != 2))
    out = language_id.predict(docs.select("doc_id", "text"), model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (_bucket(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_crf.extract_text(_table(spark, sf_dir, "pages"), html_crf.trained_field())
    return out.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of four of five buckets of ids."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled_sample(docs, labels.where(_bucket(5) != 0)))
    out = toxicity.score(docs.select("doc_id", "text"), model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (_bucket(5) == 0).alias("held_out"), "score", "predicted")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels, cosine 0.93 and above."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 100 bytes cover which start earlier as well."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, equal texts together where quotas allow."""
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def tokenizer_path() -> str:
    """The place of the word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word-level BPE and decoded again."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


#: Rules of the URL filter, as (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The tables have no feed of bad URLs; a list of all sections and numbers of some sites stands in for one.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS, LISTED_SECTIONS, LISTED_NUMBERS = ["com", "net", "org"], ["de", "en", "es", "fr"], 1000


def url_feed(spark: SparkSession) -> DataFrame:
    """The canonical URLs that are listed."""
    explode = lambda texts: F.explode(F.array(*map(F.lit, texts)))
    rows = spark.range(LISTED_NUMBERS).select("id", explode(LISTED_SITES).alias("site")).select("id", "site", explode(LISTED_DOMAINS).alias("domain")).select("*", explode(LISTED_SECTIONS).alias("section"))
    return rows.select(F.concat("site", F.lit(".example."), "domain", F.lit("/"), "section", F.lit("/"), F.col("id").cast("string")).alias("canonical"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_feed(spark), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; where 7 divides the id, the label moves on by one first."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened coordinates of every vector."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def piece_path() -> str:
    """The place of the SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the SentencePiece model and decoded again."""
    return piece_bpe.encode_texts(_table(spark, sf_dir, "documents"), piece_path()).withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, instr(url, '://') AS cut, url FROM pages
), split AS (
  SELECT page_id,
    CASE WHEN cut > 0 THEN translate(regexp_extract(substr(url, cut + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN cut > 0 THEN regexp_extract(substr(url, cut + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
    regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') AS canonical,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM split
), listed AS (
  SELECT site || '.example.' || domain || '/' || section || '/' || n AS canonical
  FROM (SELECT unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS site), (SELECT unnest(['com', 'net', 'org']) AS domain),
    (SELECT unnest(['de', 'en', 'es', 'fr']) AS section), (SELECT unnest(range(1000)) AS n)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.vec_id) AS BIGINT) AS n_links,
  component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.node
"""


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST((SELECT count(*) FROM links WHERE a = doc_id) AS BIGINT) AS n_links, CAST(1 + (SELECT count(*) FROM links WHERE a = doc_id AND same) AS INTEGER) AS n_copies,
  least(doc_id, coalesce((SELECT min(b) FROM links WHERE a = doc_id AND same), doc_id)) AS rep_id, component_id, component_id = doc_id AS kept
FROM documents JOIN least ON doc_id = node
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, hx, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
heads AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS head FROM later),
islands AS (SELECT doc_id, s, sum(head) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM heads),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, island),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM spans),
pieces AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS done, string_agg(substr(hx, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN pieces USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_jaccard_join, op4_html_extraction, op5_toxicity, op6_embedding_dedup, op7_suffix_dedup, op8_sharding, op9_bpe, op10_url_filter, op11_hard_negatives, op12_whitening, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op7_suffix_dedup": OP7_SQL, "op6_embedding_dedup": OP6_SQL, "op10_url_filter": OP10_SQL, "op11_hard_negatives": OP11_SQL}
