"""Ranked text search over an inverted index that is kept as tables, and terms within a few edits of each other.

``TextIndex.build`` takes each text apart once and writes postings (term, key, weighted frequency, length), the dictionary of
terms with their document counts, deletion neighbourhoods if asked to, and the corpus' size. Postings are laid out by a shard of the term
and ordered by term, so a search reads the shards of its terms and of those the row groups that hold them; a shard has as
many files as its postings need, by key, so a term that is in very many texts spreads over all of them. Scores are BM25 with field weights, summed by partial
aggregates; no text is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.functions import scalars
from cataloom.sources.storage import written

#: BM25's saturation of frequencies and weight of lengths.
K1, B = 1.2, 0.75
#: Folders of postings, of the dictionary and of neighbourhoods.
SHARDS = 16
#: Words, and pairs of query and text, that a task adds up.
POSTINGS = PAIRS = 1_000_000
#: Deletions are made in so many first characters; that loses no term within two edits.
PREFIX = 7
#: Bytes of a word and what is between it and the next, about.
WORD_BYTES = 6
VOWEL = "([aeiou]|.y)"


def stemmed(rows: DataFrame, term: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the folded term of the column ``term`` without its inflection (plural s, ed, ing and final y,
    by the first step of Porter's algorithm). Terms of two characters stay as they are.

    Most terms have none of these endings: an ending is looked at before an expression searches the term for it."""
    one, bare, two = F.col("__one"), F.col("__bare"), F.col("__two")
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    mended = (
        F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(bare, F.lit(1), F.length(bare) - 1))
        .when(bare.rlike("^[^aeiou]+[aeiouy][^aeiouwxy]$"), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )
    past = F.when(one.rlike(f"{VOWEL}[^aeiouy]+eed$"), cut(one, 1)).otherwise(one)
    inflected = (one.endswith("ed") | one.endswith("ing")) & one.rlike(f"{VOWEL}.*(ed|ing)$")
    # One column a step, so that no expression is repeated in the next.
    singular = F.regexp_replace(F.regexp_replace(term, "(ss|i)es$", "$1"), "(.[^s])s$", "$1")
    out = rows.withColumn("__one", F.when(F.col(term).endswith("s"), singular).otherwise(F.col(term)))
    out = out.withColumn("__bare", F.when(one.endswith("ed"), cut(one, 2)).when(one.endswith("ing"), cut(one, 3)).otherwise(one))
    out = out.withColumn("__two", F.when(one.endswith("eed"), past).when(inflected, mended).otherwise(one))
    last = F.when(two.endswith("y") & two.rlike(f"{VOWEL}.*y$"), F.concat(cut(two, 1), F.lit("i"))).otherwise(two)
    return out.withColumn(name, F.when(F.length(term) <= 2, F.col(term)).otherwise(last)).drop("__one", "__bare", "__two")


def tokens(text: Column) -> Column:
    """The folded terms of a text in order, with repeats; one empty term for a null or blank text."""
    return F.split(F.coalesce(scalars.query_text(text), F.lit("")), " ")


def allowed_edits(term: Column) -> Column:
    """None up to 2 characters, one up to 5, two beyond."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


#: Which characters of a prefix are left out: none, one, two (0: none).
CUTS = [(0, 0), *((0, j) for j in range(1, PREFIX + 1)), *((i, j) for j in range(2, PREFIX + 1) for i in range(1, j))]


def with_deletions(rows: DataFrame, term: str, edits: Column) -> DataFrame:
    """``rows`` with ``deletion``: a row for the first ``PREFIX`` characters of the term and for what is left of them after
    each choice of up to ``edits`` (at most two) deletions. Of equal neighbours only the last is left out."""
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CUTS]))
    out = rows.withColumn("__p", F.substring(term, 1, PREFIX)).select("*", cut.alias("__c"))
    i, j, p = F.col("__c.i"), F.col("__c.j"), F.col("__p")
    at = lambda k: F.substring(p, k, F.lit(1))
    fits = (j <= F.length(p)) & ((i > 0).cast("int") + (j > 0).cast("int") <= edits)
    last = ((j == 0) | (at(j) != at(j + 1))) & ((i == 0) | (at(i) != at(i + 1)) | (j == i + 1))
    left = F.concat(F.substring(p, F.lit(1), F.greatest(i - 1, F.lit(0))), F.substring(p, i + 1, F.greatest(j - i - 1, F.lit(0))), F.substring(p, j + 1, F.lit(PREFIX)))
    return out.where(fits & last).withColumn("deletion", F.when(j == 0, p).otherwise(left)).drop("__p", "__c")


def neighbourhoods(dictionary: DataFrame, term: str = "term") -> DataFrame:
    """(deletion, term): the deletion neighbourhood of each distinct term, at most 29 rows each however long it is."""
    terms = dictionary.select(F.col(term).alias("term")).where("term is not null and term != ''").distinct()
    return with_deletions(terms, "term", F.lit(2)).select("deletion", "term")


def near_terms(asked: DataFrame, near: DataFrame) -> DataFrame:
    """(asked, term, edits) for all terms of ``near`` (see ``neighbourhoods``) within the edits that an asked term allows.

    Two terms within two edits have a deletion in common, so candidates come from a hash join; the distance of each is
    exact. The shorter the asked term the fewer its deletions, and none is shorter than two characters unless it is the
    asked term itself, so no deletion stands for a large part of the dictionary."""
    terms = asked.where("asked is not null and asked != ''").select("asked").distinct().withColumn("k", allowed_edits(F.col("asked")))
    met = with_deletions(terms, "asked", F.col("k")).join(near, "deletion")
    met = met.where(F.abs(F.length("asked") - F.length("term")) <= F.col("k")).select("asked", "k", "term").distinct()
    return met.withColumn("edits", F.levenshtein("asked", "term")).where("edits <= k").select("asked", "term", "edits")


def compared_terms(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The rows of ``near_terms`` for few asked terms and a dictionary of distinct terms: each term is compared with the asked
    ones of about its length where it lies. That reads the dictionary once and needs no neighbourhoods of it."""
    terms = asked.where("asked is not null and asked != ''").select("asked").distinct().withColumn("k", allowed_edits(F.col("asked")))
    met = dictionary.select("term").join(F.broadcast(terms), F.abs(F.length("asked") - F.length("term")) <= F.col("k"))
    # Beyond two edits, the most that any term allows, the distance is -1.
    return met.withColumn("edits", F.levenshtein("asked", "term", 2)).where("edits between 0 and k").select("asked", "term", "edits")


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def _counted(rows: DataFrame, words: str, weight: float) -> DataFrame:
    """``rows`` with the ordered array ``words`` as (word, tf): each word once, with ``weight`` for each time it occurs."""
    here = F.col(words)
    first = F.filter(F.sequence(F.lit(0), F.size(here) - 1), lambda i: (i == 0) | (F.get(here, i) != F.get(here, i - 1)))
    out = rows.withColumn("__first", first)
    ends = lambda j: F.coalesce(F.get(F.col("__first"), j + 1), F.size(here))
    return out.withColumn(words, F.transform("__first", lambda i, j: F.struct(F.get(here, i).alias("word"), ((ends(j) - i) * F.lit(weight)).alias("tf")))).drop("__first")


class TextIndex:
    """An inverted index in a folder. Null texts count as empty; a text without terms is counted in the corpus' size."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.stats = spark.read.parquet(f"{self.path}/stats").first()

    @staticmethod
    def build(rows: DataFrame, key: str, fields: dict[str, float], path: str, fuzzy: bool = True) -> TextIndex:
        """Index the text columns ``fields`` (with their weights) of ``rows``, one row a key; ``fuzzy`` adds deletion
        neighbourhoods, which only fuzzy searches for many queries read."""

        # How much there is tells how postings are laid out; that takes no tokens.
        known = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"b{k}") for k, c in enumerate(fields)]).first()
        n, size = known["n"], sum(known[1:]) // WORD_BYTES
        lists = [tokens(F.col(c)) for c in fields]
        sizes = [F.when(F.get(F.col(f"f{k}"), F.lit(0)) == "", 0).otherwise(F.size(f"f{k}")) for k in range(len(lists))]
        texts = rows.select(F.col(key).alias("key"), *[F.sort_array(terms).alias(f"f{k}") for k, terms in enumerate(lists)])
        length = reduce(lambda a, b: a + b, [size * float(w) for size, w in zip(sizes, fields.values(), strict=True)])
        texts = texts.withColumn("length", length)
        spark = rows.sparkSession
        # A text counts its own words; each goes once to its place, where those of a stem are added up.
        spread = size // (SHARDS * POSTINGS) + 1
        counted = reduce(lambda out, k: _counted(out, f"f{k}", float(list(fields.values())[k])), range(len(lists)), texts)
        words = counted.select("key", "length", F.explode(F.concat(*[f"f{k}" for k in range(len(lists))])).alias("x")).select("key", "length", "x.word", "x.tf").where("word != ''")
        found = stemmed(words, "word", "term").drop("word").withColumn("shard", _shard(F.col("term")))
        place = F.col("shard") * F.lit(spread) + F.pmod(F.xxhash64("key", F.lit(1)), F.lit(spread))
        found = found.withColumn("place", place.cast("int")).repartitionById(SHARDS * spread, "place")
        laid = found.groupBy("place", "shard", "term", "key", "length").agg(F.sum("tf").alias("tf")).sortWithinPartitions("shard", "term", "key")
        laid.select("shard", "term", "key", "tf", "length").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        postings.groupBy("term", "shard").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).repartition("shard").sortWithinPartitions("term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/terms")
        # Each word of a text counts in its length and in one term's frequency, so the frequencies add up to the lengths.
        mean = F.coalesce(F.sum("tf"), F.lit(0.0)) / F.lit(float(max(n, 1)))
        spark.read.parquet(f"{path}/terms").agg(F.lit(n).cast("long").alias("n"), mean.alias("mean"), F.lit(size).cast("long").alias("size")).write.mode("overwrite").parquet(f"{path}/stats")
        if fuzzy:
            near = neighbourhoods(spark.read.parquet(f"{path}/terms")).withColumn("shard", _shard(F.col("deletion")))
            near.repartition("shard").sortWithinPartitions("deletion").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/near")
        return TextIndex(spark, path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def asked_terms(self, queries: DataFrame, fuzzy: bool, few: bool = False) -> DataFrame:
        """(query_id, asked, needed, term, boost): the distinct stems of each query and the indexed terms that stand for
        them; ``few`` queries need no neighbourhoods. A term ``edits`` away counts less by its share of edits in the shorter
        of both."""
        words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).where("word != ''")
        asked = stemmed(words, "word", "asked").groupBy("query_id").agg(F.collect_set("asked").alias("asked"))
        asked = asked.select("query_id", F.size("asked").alias("needed"), F.explode("asked").alias("asked"))
        if not fuzzy:
            return asked.withColumns({"term": F.col("asked"), "boost": F.lit(1.0)})
        near = compared_terms(asked, self._read("terms")) if few else near_terms(asked, self._read("near"))
        return asked.join(near, "asked").withColumn("boost", 1 - F.col("edits") / F.least(F.length("asked"), F.length("term"))).drop("edits")

    def scored(self, postings: DataFrame, known: DataFrame, need_all: bool, fuzzy: bool) -> DataFrame:
        """(query_id, key, score): the sum over a query's terms of the best of what stands for each. Scores are rounded, so
        that the order of sums doesn't decide between equal texts. ``known`` are asked terms with their ``df``."""
        n, mean = self.stats["n"], self.stats["mean"] or 1.0
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        hits = postings.join(known, "term").select("query_id", "needed", "asked", "key", (F.col("boost") * weight).alias("score"))
        # Without edits only a term itself stands for it.
        each = hits.groupBy("query_id", "needed", "key", "asked").agg(F.max("score").alias("score")) if fuzzy else hits
        found = each.groupBy("query_id", "needed", "key").agg(F.round(F.sum("score"), 9).alias("score"), F.count("*").alias("met"))
        return (found.where("met = needed") if need_all else found).select("query_id", "key", "score")

    def search(self, text: str, k: int, need_all: bool = True, fuzzy: bool = False) -> DataFrame:
        """(key, score) of the ``k`` best texts for one query, ties by key. Terms count once; with ``need_all`` each must
        be met. Only the shards and row groups of its terms are read."""
        asked = self.asked_terms(self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(text).alias("text")), fuzzy, few=True)
        # One query's terms, and of a fuzzy one the dictionary's terms near them: literals that prune the scans.
        rows = asked.withColumn("shard", _shard(F.col("term"))).collect()
        wanted, shards = sorted({r["term"] for r in rows}), sorted({r["shard"] for r in rows})
        pruned = lambda name: self._read(name).where(F.col("shard").isin(shards) & F.col("term").isin(wanted))
        known = self.spark.createDataFrame([(0, r["asked"], r["needed"], r["term"], r["boost"]) for r in rows], "query_id int, asked string, needed int, term string, boost double")
        # They go to the postings, so that a term in very many texts stays where its postings lie.
        known = F.broadcast(known.join(pruned("terms").select("term", "df"), "term"))
        return self.scored(pruned("postings"), known, need_all, fuzzy).orderBy(F.desc("score"), "key").limit(k).select("key", "score")

    def search_many(self, queries: DataFrame, k: int, need_all: bool = True, fuzzy: bool = False) -> DataFrame:
        """(query_id, rank, key, score): the ``k`` best texts of each of many queries (query_id, text)."""
        known = written(self.asked_terms(queries, fuzzy).join(self._read("terms").select("term", "df"), "term"), "asked")
        # Only postings are shuffled, by text: a task has all hits of its texts and passes on the best of each query.
        pairs = known.select("query_id").distinct().count() * self.stats["n"]
        postings = self._read("postings").join(known.select("term").distinct(), "term", "left_semi")
        postings = postings.repartition(max(pairs // PAIRS, self.stats["size"] // POSTINGS) + 1, "key")
        found = self.scored(postings, known, need_all, fuzzy)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")
