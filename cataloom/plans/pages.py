"""Entity resolution, pages, scalar functions and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import scalars
from cataloom.operators import graph, resolve
from cataloom.plans.registry import Plans
from cataloom.sources import pages
from cataloom.sources.tables import table

plans = Plans()


@plans.add("""
WITH k AS (SELECT doc_id, n_chars, source, lower(replace(strip_accents(text), 'ß', 'ss')) AS folded FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, folded, first(doc_id ORDER BY n_chars DESC, doc_id) AS original FROM k GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id AS duplicate, min(original) AS original FROM k JOIN g USING (source, folded) WHERE doc_id <> original GROUP BY doc_id""")
def duplicates_by_folded_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return resolve.duplicates(docs, "doc_id", "text", "source", "n_chars")


@plans.add("""
WITH g AS (SELECT p_brand, lower(p_name) AS folded, first(p_partkey ORDER BY p_size DESC, p_partkey) AS original FROM part GROUP BY 1, 2 HAVING count(*) > 1)
SELECT original, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS duplicates FROM part JOIN g ON g.p_brand = part.p_brand AND folded = lower(p_name) WHERE p_partkey <> original GROUP BY original""")
def duplicate_lists(spark, sf_dir):
    links = resolve.duplicates(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_size")
    return resolve.duplicate_lists(links).select("original", F.array_join(F.transform("duplicates", lambda d: d.cast("string")), ",").alias("duplicates"))


@plans.add("""
WITH q AS (SELECT DISTINCT p_brand, substr(p_name, 1, len(p_name) - 1) AS query FROM part),
s AS (SELECT query, q.p_brand, p_name, p_partkey, jaro_winkler_similarity(lower(query), lower(p_name)) AS similarity FROM q JOIN part ON q.p_brand = part.p_brand)
SELECT query, p_brand, first(p_partkey ORDER BY similarity DESC, p_partkey) AS p_partkey, round(max(similarity), 6) AS similarity FROM s WHERE similarity >= 0.8 GROUP BY 1, 2""")
def jaro_winkler_best(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select("p_brand", F.expr("substring(p_name, 1, length(p_name) - 1)").alias("query")).distinct()
    return resolve.best_match(queries, part, "query", "p_name", "p_partkey", "p_brand").select("query", "p_brand", "p_partkey", F.round("similarity", 6).alias("similarity"))


@plans.add("""
WITH q AS (SELECT DISTINCT p_brand, substr(p_name, 2) AS query FROM part),
s AS (SELECT query, q.p_brand, p_partkey, p_name, jaro_winkler_similarity(lower(query), lower(p_name)) AS similarity FROM q JOIN part ON q.p_brand = part.p_brand WHERE p_type IS DISTINCT FROM 'PROMO'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, p_brand ORDER BY similarity DESC, p_partkey) AS INTEGER) AS candidate FROM s WHERE similarity >= 0.8)
SELECT query, p_brand, candidate, p_partkey, p_name, round(similarity, 6) AS similarity FROM r WHERE candidate <= 5""")
def fuzzy_candidates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select("p_brand", F.expr("substring(p_name, 2)").alias("query")).distinct()
    return resolve.match_candidates(queries, part, "query", "p_name", "p_partkey", "p_brand", "p_type", skip="PROMO").withColumn("similarity", F.round("similarity", 6))


@plans.add("SELECT p_partkey, base64(encode(lower(p_name) || '␟' || lower(p_brand))) AS identity, 'search?searchterm=' || replace(url_encode(lower(p_brand) || ' ' || lower(p_name)), '%20', '+') || '&searchtype=l' AS address FROM part")
def search_identity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.search_identity(F.col("p_name"), F.col("p_brand")).alias("identity"), scalars.search_address(F.col("p_name"), F.col("p_brand")).alias("address"))


@plans.add("SELECT p_partkey, replace(replace(lower(p_name || ' & ' || p_brand), ' ', '-'), '&', 'and') AS tag, 'charts/top/album/1990-1999/g:' || replace(replace(lower(p_type), ' ', '-'), '&', 'and') AS chart FROM part")
def url_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.url_tag(F.concat("p_name", F.lit(" & "), "p_brand")).alias("tag"), scalars.chart_name("top", (1990, 1999), [F.col("p_type")]).alias("chart"))


#: File names of each form, and near misses of each.
NAMES = """CASE p_partkey % 16 WHEN 0 THEN '/release/album/a/' || p_partkey || '/' WHEN 1 THEN 'charts/top/album/' || p_partkey WHEN 2 THEN 'search?searchterm=' || p_partkey || '&searchtype=l'
  WHEN 3 THEN 'artist/' || p_partkey WHEN 4 THEN '/list/u/' || p_partkey WHEN 5 THEN 'list/u/a-b/3' WHEN 6 THEN 'release/single/a/' || p_partkey WHEN 7 THEN 'release/comp/a/' || p_partkey
  WHEN 8 THEN 'charts/top/song/' || p_partkey WHEN 9 THEN 'search?searchtype=l&searchterm=' || p_partkey WHEN 10 THEN 'search?searchterm=a&b=' || p_partkey || '&searchtype=l' WHEN 11 THEN 'list/u-v/' || p_partkey
  WHEN 12 THEN 'list/u/a.b/' || p_partkey WHEN 13 THEN 'charts/top/ep' WHEN 14 THEN 'charts/2020/mixtape/' || p_partkey ELSE 'search?searchterm=' || p_partkey || '&searchtype=la' END"""


@plans.add(f"""
WITH n AS (SELECT p_partkey, trim({NAMES}, '/') AS bare FROM part),
t AS (SELECT p_partkey, CASE WHEN regexp_matches(bare, '^list/[^/]+/[^/]+$') THEN bare || '/1' ELSE bare END AS f FROM n),
k AS (SELECT p_partkey, f, CASE WHEN regexp_matches(f, '^release/(album|mixtape|ep|comp)/') THEN 'album' WHEN regexp_matches(f, '^charts/(\\w+)/(album|mixtape|ep)/') THEN 'chart'
  WHEN regexp_matches(f, '^search\\?searchterm=[^&]+&searchtype=l$') THEN 'album_search_result' WHEN starts_with(f, 'artist') THEN 'artist' WHEN regexp_matches(f, '^list/(\\w+)/([\\w-]+)/?(\\d*)/?$') THEN 'list_segment' END AS page_type FROM t)
SELECT p_partkey, page_type, CASE WHEN page_type IS NOT NULL THEN f END AS file_name, CASE WHEN page_type = 'list_segment' THEN array_to_string(string_split(f, '/')[1:3], '/') END AS root FROM k""")
def page_types(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAMES.replace("|| p_partkey", "|| cast(p_partkey as string)")).alias("name"))
    rows = rows.select("p_partkey", scalars.normal_file_name(F.col("name")).alias("file_name"))
    kind = scalars.page_type(F.col("file_name"))
    return rows.select("p_partkey", kind.alias("page_type"), "file_name", F.when(kind == "list_segment", scalars.list_root(F.col("file_name"))).alias("root"))


@plans.add("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-01-01') END AS released FROM orders""")
def release_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "d MMMM yyyy")).when(k == 1, F.date_format(d, "MMMM yyyy")).when(k == 2, F.date_format(d, "yyyy")).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.release_date(text).cast("string").alias("released"))


@plans.add("SELECT c_custkey, regexp_matches(replace(c_name, '#', '_'), '^[a-zA-Z][a-zA-Z0-9_-]{2,80}$') AS valid FROM customer")
def profile_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.valid_profile_id(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("valid"))


@plans.add(r"""
WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, ws, 1 AS i, 0 AS line, ws[1] AS cur FROM w WHERE len(ws) > 0
  UNION ALL SELECT conv_id, turn, ws, i + 1, CASE WHEN length(cur) + 1 + length(ws[i + 1]) <= 200 THEN line ELSE line + 1 END,
    CASE WHEN length(cur) + 1 + length(ws[i + 1]) <= 200 THEN cur || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM f WHERE i < len(ws))
SELECT conv_id, turn, line, arg_max(cur, i) AS chunk FROM f GROUP BY conv_id, turn, line""")
def text_chunks(spark, sf_dir):
    chunks = scalars.chunks_of_words(F.col("text"), 200)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(chunks).alias("line", "chunk"))


@plans.add("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, len(string_split(html, '<h1>')) - 1 AS headings, len(string_split(html, '<a href=')) - 1 AS links FROM pages")
def page_outline(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", pages.outline("html").alias("o"))
    return rows.select("page_id", (F.coalesce("o.title", F.lit("")) != "").alias("has_title"), F.size("o.headings").cast("long").alias("headings"), F.size("o.links").cast("long").alias("links"))


@plans.add(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\b.*?</script>', '', 'gis'), '<style\b.*?</style>', '', 'gis'),
  '\s(style|onclick)=("[^"]*"|''[^'']*'')', '', 'gi'), '\s+', ' ', 'g')) AS cleaned FROM pages""")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.clean_html(F.col("html")).alias("cleaned"))


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each type from every part, in the page format: what the extractors read."""
    p = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    link = lambda i: F.concat(F.lit('<a href="/artist/s'), (F.col("p_partkey") % 100 + i).cast("string"), F.lit('">Artist '), (F.col("p_partkey") % 100 + i).cast("string"), F.lit(" &amp;amp;</a>"))
    album = F.concat(
        F.lit('<html><meta itemprop="name" content="'), name, F.lit('"><meta itemprop="ratingValue" content="'), F.col("p_retailprice").cast("string"), F.lit('"><meta itemprop="ratingCount" content="'), F.when(F.col("p_partkey") % 9 == 0, "none").otherwise(F.col("p_size").cast("string")),
        F.lit('"><div id="media_link_button_container_top" data-links="{&quot;spotify&quot;:{&quot;first&quot;:{&quot;default&quot;:false},&quot;id'), key, F.lit('&quot;:{&quot;default&quot;:'), (F.col("p_partkey") % 3 != 0).cast("string"), F.lit('}}}"></div><div class="release_page"><span itemprop="byArtist">'), link(0), link(1), F.lit('</span><div class="release_pri_genres"><a class="genre">'), F.col("p_brand"), F.lit('</a></div><div class="release_sec_genres"><a class="genre">'), F.col("p_type"),
        F.lit('</a></div><table class="album_info"><tr><th>Languages</th><td>English, French</td></tr></table><span class="issue_year ymd" title="3 May '), (F.lit(1950) + F.col("p_size")).cast("string"),
        F.lit('"></span></div><ul id="tracks"><li class="tracklist_line"><span class="tracklist_num">A1</span><span class="rendered_text">One</span><span class="tracklist_duration"><meta data-inseconds="61"></span></li></ul>'
              '<ul id="credits_"><li>'), link(2), F.lit('<span class="role_name">producer<span class="role_tracks"> 1-2</span></span></li></ul></html>'),
    )
    chart = F.concat(
        F.lit('<div class="page_charts_section_charts_item"><a class="page_charts_section_charts_item_link" href="/release/album/a/'), key, F.lit('"></a><div class="page_charts_section_charts_item_title"><span class="ui_name_locale_original">'), name,
        F.lit('</span></div><span class="page_charts_section_charts_item_details_average_num">'), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise("3.5"), F.lit('</span><div class="page_charts_section_charts_item_genres_primary"><a>'), F.col("p_brand"), F.lit("</a></div></div>"),
    )
    listing = F.concat(F.lit('<h1>List</h1><span class="navspan"><a class="navlinknum" href="/list/u/'), key, F.lit('/2">2</a></span><span class="navspan"><a class="navlinknum" href="/list/u/9/9">9</a></span><a class="list_album" href="/release/album/a/'), key, F.lit('">x</a><a class="list_album" href="/bad">y</a>'))
    artist = F.concat(F.lit('<meta itemprop="name" content="A"><div id="disco_type_s"><a class="album" href="/release/album/a/'), key, F.lit('">S</a></div><div id="disco_type_c"><a class="album" href="/release/comp/a/'), key, F.lit('">C</a></div>'))
    search = F.concat(F.lit('<div class="infobox"><a class="searchpage" href="/artist/x">no</a></div><div class="infobox"><a class="searchpage" href="/release/'), F.when(F.col("p_partkey") % 4 == 0, "single").otherwise("album"), F.lit("/a/"), key, F.lit('">hit</a><a class="artist" href="/artist/s1">S1</a></div>'))
    kinds = [("release/album/a/", album, ""), ("charts/top/album/", chart, ""), ("list/u/", listing, "/1"), ("artist/a", artist, ""), ("search?searchterm=", search, "&searchtype=l")]
    return p.select(F.explode(F.array(*[F.struct(F.concat(F.lit(prefix), key, F.lit(end)).alias("file_name"), body.alias("html")) for prefix, body, end in kinds])).alias("x")).select("x.*")


@plans.add("""
SELECT 'release/album/a/' || p_partkey AS file_name, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS rating_count, p_brand AS primary_genres, p_type AS secondary_genres,
  'artist/s' || (p_partkey % 100) || ',artist/s' || (p_partkey % 100 + 1) AS artists, 'Artist ' || (p_partkey % 100) AS first_artist, 'English,French' AS languages, strftime(make_date(1950 + p_size, 5, 3), '%Y-%m-%d') AS release_date,
  61 AS first_duration, 'producer' AS first_role FROM part""")
def parse_album_pages(spark, sf_dir):
    a = pages.albums(pages.read_pages(catalogue_pages(spark, sf_dir), ["album"])).where("error is null")
    return a.select("file_name", "name", "rating_count", F.array_join("primary_genres", ",").alias("primary_genres"), F.array_join("secondary_genres", ",").alias("secondary_genres"), F.array_join("artists.file_name", ",").alias("artists"), F.col("artists")[0]["name"].alias("first_artist"),
                    F.array_join("languages", ",").alias("languages"), F.col("release_date").cast("string").alias("release_date"), F.col("tracks")[0]["duration_seconds"].alias("first_duration"), F.col("credits")[0]["roles"][0].alias("first_role"))


@plans.add("SELECT 'release/album/a/' || p_partkey AS file_name, CASE WHEN p_partkey % 3 <> 0 THEN 'id' || p_partkey END AS spotify_id FROM part")
def parse_streaming_ids(spark, sf_dir):
    """The id that an album page marks as its default."""
    return pages.albums(pages.read_pages(catalogue_pages(spark, sf_dir), ["album"], parts={"album": ["links"]})).select("file_name", "spotify_id")


@plans.add("SELECT 'charts/top/album/' || p_partkey AS chart, 'release/album/a/' || p_partkey AS file_name, p_name AS name, p_brand AS primary_genres FROM part WHERE p_partkey % 7 <> 0")
def parse_chart_pages(spark, sf_dir):
    rows = pages.chart_albums(pages.read_pages(catalogue_pages(spark, sf_dir), ["chart"]))
    return rows.select("chart", "file_name", "name", F.array_join("primary_genres", ",").alias("primary_genres"))


@plans.add("SELECT 'artist/a' || p_partkey AS file_name, 'A' AS name, 'release/album/a/' || p_partkey || ',release/comp/a/' || p_partkey AS albums FROM part")
def parse_artist_pages(spark, sf_dir):
    rows = pages.artists(pages.read_pages(catalogue_pages(spark, sf_dir), ["artist"]))
    return rows.select("file_name", "name", F.array_join("albums.file_name", ",").alias("albums"))


@plans.add("SELECT 'list/u/' || p_partkey || '/1' AS file_name, 'list/u/' || p_partkey AS root_file_name, 'List' AS name, 'list/u/' || p_partkey || '/2' AS other_segments, 'release/album/a/' || p_partkey AS albums FROM part")
def parse_list_pages(spark, sf_dir):
    rows = pages.list_segments(pages.read_pages(catalogue_pages(spark, sf_dir), ["list_segment"]))
    return rows.select("file_name", "root_file_name", "name", F.array_join("other_segments", ",").alias("other_segments"), F.array_join("albums", ",").alias("albums"))


@plans.add("""
SELECT 'search?searchterm=' || p_partkey || '&searchtype=l' AS search, CASE WHEN p_partkey % 4 <> 0 THEN 'hit' END AS name, CASE WHEN p_partkey % 4 <> 0 THEN 'release/album/a/' || p_partkey END AS file_name,
  CASE WHEN p_partkey % 4 <> 0 THEN 'artist/s1' END AS artists, CASE WHEN p_partkey % 4 = 0 THEN 'no album in the search results' END AS error FROM part""")
def parse_search_pages(spark, sf_dir):
    rows = pages.search_results(pages.read_pages(catalogue_pages(spark, sf_dir), ["album_search_result"]))
    return rows.select("search", "name", "file_name", F.array_join("artists.file_name", ",").alias("artists"), "error")


@plans.add("""
SELECT t AS page_type, CASE WHEN t = 'album_search_result' AND p_partkey % 4 = 0 THEN 'FileParseFailed' ELSE 'FileParsed' END AS event, count(*) AS n
FROM part, (SELECT unnest(['album', 'chart', 'artist', 'album_search_result', 'list_segment']) AS t) GROUP BY 1, 2""")
def parse_events(spark, sf_dir):
    raw = pages.read_pages(catalogue_pages(spark, sf_dir), parts=pages.DECIDING)
    return pages.parse_events(raw).groupBy("page_type", "event").agg(F.count("*").alias("n"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with suppliers, credits, tags and words."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    node = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return graph.edges([
        ("ALBUM_ARTIST", line.where("l_linestatus = 'O'"), node("Album", "l_partkey"), node("Artist", "l_suppkey")),
        ("CREDITED", line.where("l_linestatus = 'F'"), node("Album", "l_partkey"), node("Artist", "l_suppkey")),
        ("PRIMARY", part, node("Album", "p_partkey"), node("Genre", "p_brand")),
        ("SECONDARY", part, node("Album", "p_partkey"), node("Genre", "p_type")),
        ("DESCRIPTOR", words, node("Album", "p_partkey"), node("Descriptor", "word")),
    ])


@plans.add("""
SELECT type, count(*) AS n, sum(w) AS weight FROM (
  SELECT DISTINCT 'ALBUM_ARTIST' AS type, l_partkey AS a, CAST(l_suppkey AS VARCHAR) AS b, 4.0::DOUBLE AS w FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT DISTINCT 'CREDITED', l_partkey, CAST(l_suppkey AS VARCHAR), 2.0 FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT DISTINCT 'PRIMARY', p_partkey, p_brand, 3.0 FROM part UNION ALL SELECT DISTINCT 'SECONDARY', p_partkey, p_type, 1.0 FROM part
  UNION ALL SELECT DISTINCT 'DESCRIPTOR', p_partkey, t, 1.0 FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part)) GROUP BY type""")
def graph_edges_weighted(spark, sf_dir):
    return part_graph(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@plans.add("""
SELECT label, count(*) AS n FROM (SELECT 'Album' AS label, CAST(p_partkey AS VARCHAR) AS k FROM part UNION SELECT 'Artist', CAST(s_suppkey AS VARCHAR) FROM supplier
UNION SELECT 'Genre', p_brand FROM part UNION SELECT 'Genre', p_type FROM part UNION SELECT 'Language', lang FROM documents WHERE lang IS NOT NULL) GROUP BY label""")
def graph_nodes(spark, sf_dir):
    part, supplier, docs = (table(spark, sf_dir, t) for t in ("part", "supplier", "documents"))
    parts = [("Album", part, "p_partkey", "p_name"), ("Artist", supplier, "s_suppkey", "s_name"), ("Genre", part, "p_brand", "p_brand"), ("Genre", part, "p_type", "p_type"), ("Language", docs.where("lang is not null"), "lang", "lang")]
    return graph.nodes(parts).groupBy("label").agg(F.count("*").alias("n"))


@plans.add("""
SELECT count(*) AS edges, sum(w) AS weight FROM (SELECT a, b, sum(w) AS w FROM (
  SELECT DISTINCT l_partkey AS a, l_suppkey AS b, 4.0::DOUBLE AS w FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 2.0 FROM lineitem WHERE l_linestatus = 'F') GROUP BY a, b)""")
def graph_projection(spark, sf_dir):
    both = graph.undirected(part_graph(spark, sf_dir).where("type in ('ALBUM_ARTIST', 'CREDITED')"))
    return both.where("src < dst").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@plans.add()
def fastrp_embeddings(spark, sf_dir):
    return graph.fast_rp(graph.undirected(part_graph(spark, sf_dir)), dims=32, wanted=F.col("id").like("Album:%"))
