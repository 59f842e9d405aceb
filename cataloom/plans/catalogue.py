"""Catalogue queries: the part table as albums, suppliers as artists, line items as credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import catalog, vector_search
from cataloom.plans.registry import Plans
from cataloom.sources.tables import table

plans = Plans()


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows: name tokens as descriptors, brand and type as tags, suppliers as artists, return flags as roles."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    tag = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.lower("l_returnflag"))
    people = line.groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("artists"), F.sort_array(F.collect_set(tag)).alias("credit_tags"))
    out = part.withColumnRenamed("p_partkey", "l_partkey").join(people, "l_partkey", "left")
    out = out.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in ("artists", "credit_tags")})
    return out.select(
        F.col("l_partkey").alias("file_name"), F.col("p_name").alias("name"), "artists", "credit_tags", F.array("p_brand").alias("primary_tags"), F.array("p_type").alias("secondary_tags"),
        F.array_distinct(F.split("p_name", " ")).alias("descriptors"), F.col("p_retailprice").alias("rating"), F.col("p_size").alias("rating_count"),
    ).withColumn("descriptor_count", F.size("descriptors"))


@plans.add("""
SELECT name, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS primary_count,
  CAST(sum(CASE WHEN is_primary THEN 0 ELSE 1 END) AS BIGINT) AS secondary_count, count(*) AS total_count
FROM (SELECT p_brand AS name, true AS is_primary FROM part UNION ALL SELECT p_type, false FROM part) GROUP BY name""")
def tag_rollup_primary_secondary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tags = part.select(F.explode(F.array(F.struct(F.col("p_brand").alias("name"), F.lit(True).alias("is_primary")), F.struct(F.col("p_type").alias("name"), F.lit(False).alias("is_primary")))).alias("t")).select("t.*")
    return catalog.tag_rollup(tags, "name", "is_primary")


@plans.add("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token IS NOT NULL GROUP BY token")
def token_count(spark, sf_dir):
    return catalog.counted(table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")), "token")


@plans.add("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def tag_count_top(spark, sf_dir):
    return catalog.counted(table(spark, sf_dir, "part"), "p_type", 5)


@plans.add("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_rollup(spark, sf_dir):
    return catalog.counted(table(spark, sf_dir, "documents"), "lang")


@plans.add("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


@plans.add("""
SELECT (SELECT count(*) FROM part) AS albums, (SELECT count(*) FROM supplier) AS artists, (SELECT count(DISTINCT p_brand) FROM part) AS genres,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)) AS descriptors,
  (SELECT count(DISTINCT lang) FROM documents) AS languages,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)) AS duplicates,
  (SELECT count(*) FROM part WHERE p_size > 25) AS with_external_id""")
def catalogue_monitor(spark, sf_dir):
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    of_part = part.agg(F.count("*").alias("albums"), F.count_distinct("p_brand").alias("genres"), F.count_if(F.col("p_size") > 25).alias("with_external_id"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("t")).agg(F.count_distinct("t").alias("descriptors"))
    of_docs = docs.agg(F.count_distinct("lang").alias("languages"))
    copies = docs.where("text is not null").groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("artists"))
    # One row each.
    return of_part.crossJoin(suppliers).crossJoin(words).crossJoin(of_docs).crossJoin(copies).select("albums", "artists", "genres", "descriptors", "languages", "duplicates", "with_external_id")


@plans.add("""
WITH a AS (SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS artists,
    count(DISTINCT l_suppkey) AS artist_count, count(DISTINCT CAST(l_suppkey AS VARCHAR) || ':' || lower(l_returnflag)) AS credit_count FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS file_name, coalesce(artists, '') AS artists, CAST(coalesce(artist_count, 0) AS BIGINT) AS artist_count, CAST(coalesce(credit_count, 0) AS BIGINT) AS credit_count,
  CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS descriptor_count
FROM part LEFT JOIN a ON p_partkey = l_partkey""")
def hydrate_nested_counts(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    return c.select("file_name", F.array_join("artists", ",").alias("artists"), F.size("artists").cast("long").alias("artist_count"), F.size("credit_tags").cast("long").alias("credit_count"), F.col("descriptor_count").cast("long").alias("descriptor_count"))


@plans.add("""
WITH keys AS (SELECT 7 * (o_custkey % 200) + 1 AS k, o_orderkey AS ordinal FROM orders)
SELECT p_partkey, p_name, ordinal FROM (SELECT k, min(ordinal) AS ordinal FROM keys GROUP BY k) JOIN part ON p_partkey = k""")
def get_many_in_order(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((7 * F.pmod("o_custkey", F.lit(200)) + 1).alias("p_partkey"), F.col("o_orderkey").alias("ordinal"))
    return catalog.in_key_order(table(spark, sf_dir, "part").select("p_partkey", "p_name"), keys, "p_partkey").orderBy("ordinal").select("p_partkey", "p_name", "ordinal")


@plans.add("SELECT DISTINCT o_custkey * 3 AS p_partkey FROM orders WHERE o_custkey * 3 NOT IN (SELECT p_partkey FROM part)")
def missing_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("p_partkey"))
    return catalog.missing_keys(keys, table(spark, sf_dir, "part"), "p_partkey")


@plans.add("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS found FROM customer")
def existence_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.exists_flags(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@plans.add("""
WITH base AS (SELECT c_custkey, c_name, c_acctbal FROM customer),
changes AS (SELECT o_custkey + 100 AS c_custkey, 'order ' || CAST(o_orderkey AS VARCHAR) AS c_name, o_totalprice AS c_acctbal,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM base WHERE c_custkey NOT IN (SELECT c_custkey FROM changes)
UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 4) FROM changes WHERE r = 1""")
def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    return catalog.upsert(base, changes, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@plans.add("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def delete_by_tombstones(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.delete(table(spark, sf_dir, "part").select("p_partkey", "p_name"), gone, "p_partkey")


@plans.add("SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE name IS NOT NULL")
def dictionary_view(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return catalog.dictionary(part, [F.array("p_brand"), F.array("p_type"), F.split("p_name", " ")])


@plans.add("""
SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem c WHERE NOT EXISTS
  (SELECT 1 FROM lineitem m WHERE m.l_linestatus = 'O' AND m.l_suppkey = c.l_suppkey AND m.l_partkey = c.l_partkey)""")
def credited_not_main(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return catalog.credited_not_main(line, line.where("l_linestatus = 'O'"), "l_suppkey", "l_partkey", "l_returnflag")


@plans.add("SELECT DISTINCT l_suppkey AS artist FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND p_size = 7")
def related_artists(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").where("p_brand = 'Brand#12' and p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    albums = table(spark, sf_dir, "lineitem").join(chosen, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("main"), F.collect_set("l_suppkey").alias("credited"))
    return catalog.related_artists(albums, "main", "credited")


@plans.add("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_joins(spark, sf_dir):
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


@plans.add("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_unseen(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    seen = line.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return line.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct().join(seen, ["l_partkey", "l_suppkey"], "left_anti")


@plans.add("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def semi_join_components(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    touched = catalog.distinct_union([line.where("l_discount >= 0.1"), line.where("l_quantity >= 50")], "l_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@plans.add("""
SELECT k, source FROM (SELECT s_suppkey AS k, 'second' AS source FROM supplier
UNION ALL SELECT c_custkey, 'first' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))""")
def union_by_key(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("first").alias("source"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("second").alias("source"))
    return catalog.union_by_key(first, second, "k")


@plans.add("SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en')")
def uncached_bodies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return docs.join(docs.where("lang = 'en'").select("h"), "h", "left_anti").select("doc_id")


@plans.add("""
WITH made AS (SELECT sha256(coalesce(text, '')) AS h, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS made_at FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT h FROM made WHERE made_at + INTERVAL 14 DAY > TIMESTAMP '2024-01-25')""")
def uncached_bodies_by_age(spark, sf_dir):
    """Documents to make vectors for: no entry of the cache is younger than two weeks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))
    made = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))
    cache = docs.where("doc_id % 3 <> 0").select("cache_key", made.alias("made_at"))
    return vector_search.uncached(docs, cache, F.lit("2024-01-25").cast("timestamp_ntz")).select("doc_id")


@plans.add("""
SELECT l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
UNION ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
  AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')""")
def replace_children(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = line.where(F.col("l_shipdate") < cut).select("l_partkey", "l_suppkey").distinct()
    return catalog.replace_children(old, line.where(F.col("l_shipdate") >= cut).select("l_partkey", "l_suppkey"), "l_partkey")


@plans.add("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def list_segments_added(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    odd = F.col("o_custkey") % 2 == 1
    return catalog.add_segments(orders.where(odd), orders.where(~odd))


@plans.add("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def distinct_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n > 1")


@plans.add("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def artist_scan_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(keys, "s_suppkey", "left_semi")
