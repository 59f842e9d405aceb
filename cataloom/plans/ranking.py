"""Summaries, rankings and recommendations: customers as profiles, parts as albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.operators import profiles as people
from cataloom.operators import ranking, recommend, resolve, summary, tracks, vector_index, vector_search
from cataloom.plans.catalogue import catalogue
from cataloom.plans.registry import Plans
from cataloom.sources.storage import new_folder
from cataloom.sources.tables import table

plans = Plans()


#: Line items that a task keeps at once.
LINES = 200_000


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, file_name, factor): how often each customer bought each part."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = orders.select("o_orderkey", "o_custkey").join(line.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    # A customer's items meet in one of as many tasks as the line items fill.
    bought = bought.select("o_custkey", "l_partkey").repartition(line.count() // LINES + 1, "o_custkey")
    return bought.groupBy(F.col("o_custkey").alias("profile"), F.col("l_partkey").alias("file_name")).agg(F.count("*").alias("factor"))


PROFILES = "profiles AS (SELECT o_custkey AS profile, l_partkey AS file_name, count(*) AS factor FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


@plans.add(f"""
WITH {PROFILES}, items AS (SELECT profile, factor, p_brand, p_type, p_name FROM profiles JOIN part ON file_name = p_partkey WHERE profile = 7)
SELECT facet, item, CAST(sum(factor) AS BIGINT) AS factor FROM (
  SELECT 'primary' AS facet, p_brand AS item, factor FROM items UNION ALL SELECT 'secondary', p_type, factor FROM items
  UNION ALL SELECT 'descriptor', unnest(list_distinct(string_split(p_name, ' '))), factor FROM items) GROUP BY 1, 2""")
def weighted_profile_summary(spark, sf_dir):
    items = recommend.seed_items(catalogue(spark, sf_dir), profiles(spark, sf_dir).where("profile = 7"), recommend.Columns())
    return summary.facet_factors(items, "factor", {"primary": F.col("primary_tags"), "secondary": F.col("secondary_tags"), "descriptor": F.col("descriptors")})


@plans.add(f"WITH {PROFILES} SELECT profile, round(sum(p_retailprice * factor) / sum(factor), 6) AS rating FROM profiles JOIN part ON file_name = p_partkey GROUP BY profile")
def weighted_mean_rating(spark, sf_dir):
    rows = profiles(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("file_name") == F.col("p_partkey"))
    return rows.groupBy("profile").agg(F.round(summary.weighted_mean(F.col("p_retailprice"), F.col("factor")), 6).alias("rating"))


@plans.add("""
WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(round(median(y)) AS INTEGER) AS median_year FROM (SELECT o_custkey, y, unnest(range(n)) FROM f) GROUP BY o_custkey""")
def weighted_median_year(spark, sf_dir):
    factors = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return factors.groupBy("o_custkey").agg(summary.weighted_median_year(F.col("y"), F.col("n")).alias("median_year"))


@plans.add("""
SELECT facet, item, CAST(count(*) AS BIGINT) AS factor FROM (SELECT 'year' AS facet, CAST(year(o_orderdate) AS VARCHAR) AS item FROM orders
UNION ALL SELECT 'decade', CAST(year(o_orderdate) - year(o_orderdate) % 10 AS VARCHAR) FROM orders) GROUP BY 1, 2""")
def decade_factors(spark, sf_dir):
    return summary.facet_factors(table(spark, sf_dir, "orders").withColumn("factor", F.lit(1)), "factor", summary.date_facets(F.col("o_orderdate")))


@plans.add("""
SELECT s_suppkey, count(l_partkey) AS album_count, round(coalesce(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 0), 6) AS rating,
  CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS rating_count, CAST(coalesce(min(year(l_shipdate)), 0) AS INTEGER) AS min_year, CAST(coalesce(max(year(l_shipdate)), 0) AS INTEGER) AS max_year
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def supplier_overview(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = rows.groupBy("s_suppkey").agg(*summary.album_summary(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate")))
    return out.withColumn("rating", F.round("rating", 6))


@plans.add("SELECT l_suppkey, l_returnflag AS role, count(*) AS n FROM lineitem GROUP BY 1, 2")
def credit_role_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("role")).agg(F.count("*").alias("n"))


@plans.add("SELECT item, CAST(sum(factor) AS BIGINT) AS factor FROM (SELECT p_brand AS item, p_size AS factor FROM part UNION ALL SELECT p_type, p_size FROM part) GROUP BY item")
def merged_tag_totals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return summary.merged_factors([part.select(F.col(c).alias("item"), F.col("p_size").alias("factor")) for c in ("p_brand", "p_type")])


@plans.add("SELECT lower(event_type) AS album, lower(CAST(user_id AS VARCHAR)) AS artist, count(*) AS factor FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def import_factors(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").select(F.upper("event_type").alias("album"), F.col("user_id").cast("string").alias("artist"))
    return summary.import_factors(tracks, "album", "artist")


@plans.add("SELECT o_custkey, CAST(coalesce(round(100 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)), 0) AS INTEGER) AS completion FROM orders GROUP BY o_custkey")
def completion_percent(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(summary.completion(F.col("o_orderstatus") == "F").alias("completion"))


@plans.add("SELECT p_partkey, p_brand, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1.0 + (count(*) OVER (PARTITION BY p_brand, p_size)) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS rank FROM part")
def midrank_table(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return ranking.mid_ranks(rows, ["p_brand"], "p_size").select("p_partkey", "p_brand", F.round("rank", 6).alias("rank"))


SCORES = f"""
WITH {PROFILES}, seed AS (SELECT file_name, factor FROM profiles WHERE profile = 7),
cat AS (SELECT p_partkey AS file_name, [p_brand] AS primary_tags, [p_type] AS secondary_tags, list_distinct(string_split(p_name, ' ')) AS descriptors, p_retailprice AS rating, p_size AS rating_count FROM part),
credits AS (SELECT l_partkey AS file_name, list_distinct(list(CAST(l_suppkey AS VARCHAR) || ':' || lower(l_returnflag))) AS credit_tags, list_distinct(list(CAST(l_suppkey AS VARCHAR))) AS artists FROM lineitem GROUP BY 1),
c AS (SELECT cat.*, len(descriptors) AS descriptor_count, coalesce(credit_tags, []) AS credit_tags, coalesce(artists, []) AS artists FROM cat LEFT JOIN credits USING (file_name)),
tall AS (SELECT file_name, 'primary' AS facet, unnest(primary_tags) AS item FROM c UNION ALL SELECT file_name, 'secondary', unnest(secondary_tags) FROM c
  UNION ALL SELECT file_name, 'descriptor', unnest(descriptors) FROM c UNION ALL SELECT file_name, 'credit', unnest(credit_tags) FROM c),
factors AS (SELECT facet, item, sum(factor) AS f FROM tall JOIN seed USING (file_name) GROUP BY 1, 2),
ranks AS (SELECT facet, item, (rank() OVER (PARTITION BY facet ORDER BY f) - 1.0 + (count(*) OVER (PARTITION BY facet, f)) / 2.0) / count(*) OVER (PARTITION BY facet) AS r FROM factors),
means AS (SELECT file_name, facet, avg(CASE WHEN r > 0 THEN r ELSE 0.2 END) AS m FROM tall LEFT JOIN ranks USING (facet, item) GROUP BY 1, 2),
wide AS (SELECT file_name, coalesce(max(CASE WHEN facet = 'primary' THEN m END), 0.2) AS p, coalesce(max(CASE WHEN facet = 'secondary' THEN m END), 0.2) AS s,
  coalesce(max(CASE WHEN facet = 'descriptor' THEN m END), 0.2) AS d, coalesce(max(CASE WHEN facet = 'credit' THEN m END), 0.2) AS k FROM means GROUP BY 1),
items AS (SELECT c.* FROM c JOIN seed USING (file_name)),
numbers AS (SELECT c.file_name,
  (SELECT (count(*) FILTER (WHERE i.rating < c.rating) + count(*) FILTER (WHERE i.rating = c.rating) / 2.0) / count(*) FROM items i) AS rating_rank,
  (SELECT (count(*) FILTER (WHERE i.rating_count < c.rating_count) + count(*) FILTER (WHERE i.rating_count = c.rating_count) / 2.0) / count(*) FROM items i) AS rating_count_rank,
  (SELECT (count(*) FILTER (WHERE i.descriptor_count < c.descriptor_count) + count(*) FILTER (WHERE i.descriptor_count = c.descriptor_count) / 2.0) / count(*) FROM items i) AS descriptor_count_rank FROM c),
scored AS (SELECT *, (4 * p + 2 * s + 7 * d + k + 2 * rating_rank + rating_count_rank + 2 * descriptor_count_rank) / 19.0 AS score FROM wide JOIN numbers USING (file_name))"""


def _assessed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue and the seed of a profile."""
    return catalogue(spark, sf_dir), profiles(spark, sf_dir).where("profile = 7").select("file_name", "factor")


@plans.add(SCORES + """
SELECT file_name, round(score, 6) AS score FROM scored WHERE file_name NOT IN (SELECT file_name FROM seed)
ORDER BY scored.score DESC, file_name LIMIT 10""")
def quantile_recommend_topk(spark, sf_dir):
    """The flagship: the ten parts that suit a customer best."""
    c, seed = _assessed(spark, sf_dir)
    request = recommend.Request(exclude_known_artists=False, least_tags={"primary": 1, "secondary": 1, "descriptor": 1})
    out = recommend.recommend("quantile", catalogue=c, seed=seed, settings=ranking.Settings(), request=request, c=recommend.Columns())
    return out.select("file_name", F.round("score", 6).alias("score"))


@plans.add(SCORES + " SELECT file_name, round(score, 6) AS score FROM scored")
def quantile_assess_all(spark, sf_dir):
    c, seed = _assessed(spark, sf_dir)
    return recommend.quantile_scores(c, c, seed, ranking.Settings(), recommend.Columns()).select("file_name", F.round("score", 6).alias("score"))


@plans.add(SCORES + " SELECT file_name, round(score, 6) AS score FROM scored WHERE file_name = 42")
def quantile_assess_one(spark, sf_dir):
    c, seed = _assessed(spark, sf_dir)
    return recommend.quantile_scores(c.where("file_name = 42"), c, seed, ranking.Settings(), recommend.Columns()).select("file_name", F.round("score", 6).alias("score"))


@plans.add(SCORES + """
SELECT file_name, round(p, 6) AS primary_rank, round(s, 6) AS secondary_rank, round(d, 6) AS descriptor_rank, round(k, 6) AS credit_rank, round(rating_rank, 6) AS rating_rank,
  round(rating_count_rank, 6) AS rating_count_rank, round(descriptor_count_rank, 6) AS descriptor_count_rank FROM scored""")
def quantile_assess_components(spark, sf_dir):
    """What each score is made of."""
    c, seed = _assessed(spark, sf_dir)
    rows = recommend.quantile_scores(c, c, seed, ranking.Settings(), recommend.Columns())
    return rows.select("file_name", *[F.round(f"{n}_rank", 6).alias(f"{n}_rank") for n in ("primary", "secondary", "descriptor", "credit", "rating", "rating_count", "descriptor_count")])


@plans.add("""
WITH own AS (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7)
SELECT p_partkey AS file_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM own) AND len(list_distinct(string_split(p_name, ' '))) >= 2
  AND p_brand || CAST(p_size AS VARCHAR) NOT IN (SELECT p_brand || CAST(p_size AS VARCHAR) FROM part WHERE p_partkey IN (SELECT l_partkey FROM own))""")
def recommendation_candidates(spark, sf_dir):
    # Brand and size stand for the artist.
    c = catalogue(spark, sf_dir).withColumn("artists", F.array(F.concat(F.col("primary_tags")[0], F.col("rating_count").cast("string"))))
    seed = profiles(spark, sf_dir).where("profile = 7").select("file_name", "factor")
    request = recommend.Request(least_tags={"primary": 1, "secondary": 1, "descriptor": 2})
    return recommend.candidates(c, seed, request, recommend.Columns()).select("file_name")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_name"), "embedding", "label")


COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


@plans.add("""
SELECT label, pos, round(sum(w * x) / sum(w), 6) AS x FROM (SELECT label, 1.0 + vec_id % 3 AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos""")
def mean_vector_by_label(spark, sf_dir):
    rows = vector_search.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", 1.0 + F.col("vec_id") % 3, ["label"])
    return rows.select("label", F.posexplode("mean_vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@plans.add(f"""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings WHERE label = 2))
SELECT vec_id, round(1 - {COSINE.format("embedding", "e")}, 6) AS distance, round({COSINE.format("embedding", "e")}, 6) AS similarity FROM embeddings, q WHERE label IN (2, 5)
ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id LIMIT 15""")
def knn_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    query = rows.where("label = 2").agg(F.min_by("embedding", "vec_id").alias("mean_vector"))
    out = vector_search.nearest(rows.where("label in (2, 5)"), query, "embedding", "vec_id", 15)
    return out.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@plans.add(f"""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 10)
SELECT vec_id, round({COSINE.format("embedding", "e")}, 6) AS similarity FROM embeddings, q WHERE vec_id <> 10 ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id LIMIT 10""")
def similar_excluding_self(spark, sf_dir):
    return vector_search.similar_to(table(spark, sf_dir, "embeddings"), 10, "embedding", "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@plans.add(f"""
SELECT src, dst, round(similarity, 6) AS similarity, neighbour FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {COSINE.format("a.embedding", "b.embedding")} AS similarity,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE.format("a.embedding", "b.embedding")} DESC, b.vec_id) AS INTEGER) AS neighbour
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE neighbour <= 10""")
def knn_graph(spark, sf_dir):
    return vector_search.neighbour_graph(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label", 10).withColumn("similarity", F.round("similarity", 6))


@plans.add()
def knn_approximate(spark, sf_dir):
    """About the ten nearest of the same three labels for every hundredth vector, from an index of cells and codes."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.build(rows, "vec_id", "embedding", new_folder(spark, "vector-index"), ["label"])
    found = index.search_many(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10, where=F.col("label").isin(1, 4, 7))
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


#: Line items as tracks of a part, with nine numbers of theirs as features in the place of audio features.
TRACKS_SQL = """tracks AS (SELECT l_orderkey * 10 + l_linenumber AS spotify_id, l_partkey AS album_file_name, [CAST(l_discount AS FLOAT), CAST(l_tax AS FLOAT), CAST(l_discount * l_tax AS FLOAT),
  CAST(l_linenumber / 7.0 AS FLOAT), CAST(l_discount + l_tax AS FLOAT), CAST(-l_quantity AS FLOAT), CAST(l_suppkey % 10 / 10.0 AS FLOAT), CAST(l_extendedprice / 500 AS FLOAT), CAST(l_partkey % 10 / 10.0 AS FLOAT)] AS e FROM lineitem)"""


def tracks_of(spark, sf_dir):
    values = ["l_discount", "l_tax", "l_discount * l_tax", "l_linenumber / 7.0D", "l_discount + l_tax", "-l_quantity", "l_suppkey % 10 / 10.0D", "l_extendedprice / 500", "l_partkey % 10 / 10.0D"]
    features = F.struct(*[F.expr(v).alias(name) for name, v in zip(tracks.FEATURES, values, strict=True)])
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("spotify_id"), F.col("l_partkey").alias("album_file_name"), tracks.feature_vector(features).alias("embedding"))


@plans.add(f"""
WITH {TRACKS_SQL}, q AS (SELECT e AS q FROM tracks ORDER BY spotify_id LIMIT 1)
SELECT spotify_id, album_file_name, round({COSINE.format("e", "q")}, 6) AS similarity FROM tracks, q WHERE album_file_name IN (SELECT p_partkey FROM part WHERE p_size < 20)
ORDER BY 1 - {COSINE.format("e", "q")}, spotify_id LIMIT 50""")
def track_knn_filtered(spark, sf_dir):
    """The tracks of small albums nearest to the first track."""
    rows = tracks_of(spark, sf_dir)
    query = rows.agg(F.min_by("embedding", "spotify_id").alias("mean_vector"))
    albums = table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey")
    out = tracks.similar_tracks(rows, tracks.TrackFilter(albums=albums), query, 50)
    return out.select("spotify_id", "album_file_name", F.round("similarity", 6).alias("similarity"))


@plans.add(f"""
WITH {TRACKS_SQL}, found AS (SELECT * FROM tracks WHERE album_file_name IN (SELECT p_partkey FROM part WHERE p_size < 3))
SELECT spotify_id, album_file_name, round(CAST(e[6] AS DOUBLE), 4) AS loudness, (SELECT count(*) FROM found) AS total FROM found ORDER BY spotify_id LIMIT 30 OFFSET 15""")
def track_page_with_total(spark, sf_dir):
    """A page of the tracks of the smallest albums, with their total."""
    albums = table(spark, sf_dir, "part").where("p_size < 3").select("p_partkey")
    out = tracks.find_tracks(tracks_of(spark, sf_dir), tracks.TrackFilter(albums=albums), offset=15, limit=30)
    return out.select("spotify_id", "album_file_name", F.round(F.col("embedding")[5].cast("double"), 4).alias("loudness"), "total")


@plans.add(f"""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 10)
SELECT vec_id, round({COSINE.format("embedding", "e")}, 6) AS similarity FROM embeddings, q ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id LIMIT 10""")
def similar_including_self(spark, sf_dir):
    """As the artist search has it: the item itself is one of its neighbours."""
    return vector_search.similar_to(table(spark, sf_dir, "embeddings"), 10, "embedding", "vec_id", exclude_self=False).select("vec_id", F.round("similarity", 6).alias("similarity"))


SEED = "seed AS (SELECT vec_id, 1 + vec_id % 3 AS factor FROM embeddings WHERE label = 4 AND embedding[1] > 0)"
MEAN = """mean AS (SELECT list(x ORDER BY pos) AS e FROM (SELECT pos, sum(factor * x) / sum(factor) AS x FROM
  (SELECT factor, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings JOIN seed USING (vec_id)) GROUP BY pos))"""


def _seed(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("label = 4 and embedding[0] > 0")
    return rows.select(F.col("vec_id").alias("file_name"), (1 + F.col("vec_id") % 3).alias("factor"))


@plans.add(f"""
WITH {SEED}, {MEAN} SELECT vec_id AS file_name, round({COSINE.format("embedding", "e")}, 6) AS similarity FROM embeddings, mean
WHERE vec_id NOT IN (SELECT vec_id FROM seed) ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id LIMIT 10""")
def embedding_recommend(spark, sf_dir):
    out = recommend.recommend("embedding", vectors=vectors(spark, sf_dir), vector="embedding", seed=_seed(spark, sf_dir), key="file_name", k=10)
    return out.select("file_name", F.round("similarity", 6).alias("similarity"))


#: The vectors stand for the parts with the number behind theirs.
PART_MEAN = f"""mean AS (SELECT list(x ORDER BY pos) AS e FROM (SELECT pos, sum(factor * x) / sum(factor) AS x FROM
  (SELECT factor, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings JOIN seed ON vec_id + 1 = file_name) GROUP BY pos)),
near AS (SELECT vec_id + 1 AS file_name, {COSINE.format("embedding", "e")} AS similarity FROM embeddings, mean WHERE vec_id + 1 NOT IN (SELECT file_name FROM seed)
  ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id LIMIT 50)"""


@plans.add(SCORES + f""", {PART_MEAN}
SELECT file_name, similarity_rank, round(similarity, 6) AS similarity, round(score, 6) AS score
FROM (SELECT *, CAST(row_number() OVER (ORDER BY 1 - similarity, file_name) - 1 AS INTEGER) AS similarity_rank FROM near) JOIN scored USING (file_name) ORDER BY scored.score DESC, file_name LIMIT 10""")
def reranked_recommend(spark, sf_dir):
    """The parts nearest to a profile's mean vector, ordered by their quantile scores."""
    c, seed = _assessed(spark, sf_dir)
    parts = vectors(spark, sf_dir).withColumn("file_name", F.col("file_name") + 1)
    scores_of = lambda near: recommend.quantile_scores(c.join(near.select("file_name"), "file_name", "left_semi"), c, seed, ranking.Settings(), recommend.Columns()).select("file_name", "score")
    out = recommend.recommend("reranked", vectors=parts, vector="embedding", scores_of=scores_of, seed=seed, key="file_name", k=10)
    return out.select("file_name", "similarity_rank", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@plans.add(f"""
WITH {SEED}, {MEAN} SELECT label, vec_id, round(distance, 6) AS distance FROM (SELECT label, vec_id, 1 - {COSINE.format("embedding", "e")} AS distance,
  row_number() OVER (PARTITION BY label ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id) AS r FROM embeddings, mean) WHERE r = 1""")
def best_track_per_item(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    own = rows.join(_seed(spark, sf_dir).withColumnRenamed("file_name", "vec_id"), "vec_id")
    mean = vector_search.mean_vector(own, "embedding", F.col("factor"))
    return vector_search.best_in_group(rows.select("label").distinct(), rows, "label", mean, "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@plans.add(SCORES + f""",
tracks AS (SELECT vec_id, vec_id % 50 AS album, embedding FROM embeddings),
recommended AS (SELECT DISTINCT file_name % 50 AS album FROM (SELECT file_name FROM scored WHERE file_name NOT IN (SELECT file_name FROM seed) ORDER BY score DESC, file_name LIMIT 10)),
own AS (SELECT file_name % 50 AS album, sum(factor) AS factor FROM seed GROUP BY 1),
mean AS (SELECT list(x ORDER BY pos) AS e FROM (SELECT pos, sum(factor * x) / sum(factor) AS x FROM (SELECT factor, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM tracks JOIN own USING (album)) GROUP BY pos))
SELECT album, vec_id, round(distance, 6) AS distance FROM (SELECT album, vec_id, 1 - {COSINE.format("embedding", "e")} AS distance,
  row_number() OVER (PARTITION BY album ORDER BY 1 - {COSINE.format("embedding", "e")}, vec_id) AS r FROM tracks JOIN recommended USING (album), mean) WHERE r = 1""")
def playlist_draft(spark, sf_dir):
    """For each recommended album its track nearest to the seed's mean track: fifty sets of tracks, dealt to the parts."""
    c, seed = _assessed(spark, sf_dir)
    of = (F.col("file_name") % 50).alias("album")
    tracks = table(spark, sf_dir, "embeddings").withColumn("album", F.col("vec_id") % 50)
    request = recommend.Request(exclude_known_artists=False, least_tags={"primary": 1, "secondary": 1, "descriptor": 1})
    best = recommend.recommend("quantile", catalogue=c, seed=seed, settings=ranking.Settings(), request=request, c=recommend.Columns())
    own = seed.groupBy(of).agg(F.sum("factor").alias("factor"))
    return recommend.playlist_draft(best.select(of).distinct(), tracks, own, "album", "vec_id", "embedding").select("album", "vec_id", F.round("distance", 6).alias("distance"))


LIST_SEED = "seed AS (SELECT DISTINCT l_partkey AS file_name, 1 AS factor FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 11)"


@plans.add(f"""
WITH {LIST_SEED}, parts AS (SELECT vec_id + 1 AS file_name, embedding FROM embeddings), {MEAN.replace("embeddings JOIN seed USING (vec_id)", "parts JOIN seed USING (file_name)")}
SELECT file_name, round({COSINE.format("embedding", "e")}, 6) AS similarity FROM parts, mean WHERE file_name NOT IN (SELECT file_name FROM seed)
  AND file_name IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 40) ORDER BY 1 - {COSINE.format("embedding", "e")}, file_name LIMIT 5""")
def list_recommend_adventurous(spark, sf_dir):
    """From the list of a customer's orders, the parts nearest to it by embedding within a range of years."""
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    segments = both.groupBy(F.col("o_custkey").alias("root_file_name"), "o_orderkey").agg(F.collect_set("l_partkey").alias("albums"))
    rows = catalogue(spark, sf_dir).withColumn("release_year", F.col("rating_count"))
    parts = vectors(spark, sf_dir).withColumn("file_name", F.col("file_name") + 1)
    out = recommend.recommend_for_list(segments, 11, rows, parts, "embedding", "adventurous", (5, 40), recommend.Columns())
    return out.select("file_name", F.round("similarity", 6).alias("similarity"))


@plans.add("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 IN (0, 1) THEN 10 ELSE c_custkey % 5 END AS count,
  CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN false ELSE c_custkey % 4 = 2 END AS exclude_known_artists FROM customer""")
def recommendation_settings(spark, sf_dir):
    """What requests mean that come without settings, with some unset, and with all."""
    k = F.col("c_custkey")
    count = F.when(k % 5 != 1, (k % 5).cast("int"))
    settings = F.when(k % 4 != 0, F.struct(count.alias("count"), F.when(k % 4 != 1, k % 4 == 2).alias("exclude_known_artists")))
    return table(spark, sf_dir, "customer").select("c_custkey", recommend.effective_settings(settings).alias("s")).select("c_custkey", F.col("s.count").cast("long").alias("count"), "s.exclude_known_artists")


@plans.add("""
WITH up AS (SELECT vec_id * 2 AS vec_id, label, embedding FROM embeddings)
SELECT label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, (SELECT count(*) FROM up) AS received FROM (
  SELECT vec_id, label FROM embeddings WHERE (vec_id, label) NOT IN (SELECT (vec_id, label) FROM up) UNION ALL SELECT vec_id, label FROM up) WHERE label <> 3 GROUP BY label""")
def embedding_upload(spark, sf_dir):
    """A bulk upload into the stored vectors, and the delete of one kind."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    up = stored.withColumn("vec_id", F.col("vec_id") * 2)
    kept, received = vector_search.put_embeddings(stored, up, ["vec_id", "label"], "embedding", [F.col("vec_id")])
    kept = vector_search.delete_embeddings(kept, spark.createDataFrame([(3,)], "label int"), ["label"])
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).withColumn("received", received.select("received").scalar())


@plans.add("SELECT DISTINCT label FROM embeddings")
def embedding_keys(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label").distinct()


@plans.add("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def nonzero_vectors(spark, sf_dir):
    return vector_search.without_zero_vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id")


@plans.add("SELECT p_partkey, p_name || ', ' || p_brand || ', ' || p_type AS body, 'embedding_cache:local:' || sha256(p_name || ', ' || p_brand || ', ' || p_type) AS cache_key FROM part")
def embedding_bodies(spark, sf_dir):
    body = vector_search.embedding_body([F.col("p_name"), F.col("p_brand"), F.col("p_type")])
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"), vector_search.cache_key(F.lit("local"), body).alias("cache_key"))


@plans.add("SELECT s_suppkey FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END) AS own, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS credited FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey WHERE own >= 1 OR credited >= 5")
def embedding_eligibility(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("own"), F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("credited"))
    return table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey")).where((F.col("own") >= 1) | (F.col("credited") >= 5)).select("s_suppkey")




@plans.add(f"""
WITH {PROFILES}, gone AS (SELECT DISTINCT o_custkey AS profile, l_partkey AS file_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
put AS (SELECT DISTINCT o_custkey AS profile, l_partkey AS file_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount >= 0.09)
SELECT profile, file_name, CASE WHEN put.profile IS NOT NULL THEN 99 ELSE factor END AS factor FROM profiles LEFT JOIN put USING (profile, file_name)
WHERE (profile, file_name) NOT IN (SELECT (profile, file_name) FROM gone)""")
def profile_put_and_remove(spark, sf_dir):
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("profile")).join(line, "l_orderkey").withColumn("file_name", F.col("l_partkey"))
    changes = bought.where("l_discount >= 0.09").select("profile", "file_name", F.lit(99).cast("long").alias("factor"), "l_shipdate")
    rows = people.put_items(profiles(spark, sf_dir), changes, "profile", "file_name", "l_shipdate")
    return people.remove_items(rows, bought.where("l_returnflag = 'R'"), "profile", "file_name")


@plans.add(f"WITH {PROFILES} SELECT profile, count(*) AS items, CAST(sum(factor) AS BIGINT) AS factors FROM profiles GROUP BY profile")
def profile_maps(spark, sf_dir):
    maps = people.as_maps(profiles(spark, sf_dir), "profile", "file_name", "factor")
    back = people.from_maps(maps, "profile", "file_name", "factor")
    return back.groupBy("profile").agg(F.count("*").alias("items"), F.sum("factor").alias("factors"))


@plans.add(f"""
WITH {PROFILES}, g AS (SELECT p_brand, lower(p_name) AS folded, first(p_partkey ORDER BY p_size DESC, p_partkey) AS original FROM part GROUP BY 1, 2 HAVING count(*) > 1),
d AS (SELECT p_partkey AS file_name, original FROM part JOIN g ON g.p_brand = part.p_brand AND folded = lower(p_name) WHERE p_partkey <> original)
SELECT profile, coalesce(original, file_name) AS file_name, CAST(sum(factor) AS BIGINT) AS factor FROM profiles LEFT JOIN d USING (file_name) GROUP BY 1, 2""")
def profile_on_originals(spark, sf_dir):
    links = resolve.duplicates(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_size")
    return people.on_originals(profiles(spark, sf_dir), links, "file_name", "factor").select("profile", "file_name", "factor")


@plans.add("""
WITH hits AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_acctbal > 0)
SELECT s_suppkey, CAST(rank AS INTEGER) AS rank, s_name, n AS album_count FROM hits JOIN supplier USING (s_suppkey) JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)""")
def hits_with_overviews(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    hits = ranking.row_numbers(supplier.where("s_acctbal > 0").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", descending=True).select("s_suppkey", "rank")
    overviews = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("album_count"))
    return people.with_overviews(hits, supplier.select("s_suppkey", "s_name"), overviews, "s_suppkey", "rank").select("s_suppkey", "rank", "s_name", "album_count")


@plans.add("""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN user_id END AS k, user_id + 5 AS new FROM events)
SELECT event_id, event_type, coalesce(k, new) AS k FROM e WHERE k IS NOT NULL OR NOT EXISTS (SELECT 1 FROM e o WHERE o.event_type = e.event_type AND o.k = e.new)""")
def event_key_backfill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("k"), (F.col("user_id") + 5).alias("new"))
    return people.backfill_keys(e.select("event_id", "event_type", "k"), e.where("k is null").select("event_id", F.col("new").alias("k")), "event_id", "event_type", "k")
