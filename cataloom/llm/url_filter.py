"""URL filtering with DataFrame functions only: host and path rules, then a blocked Bloom filter
of listed canonical URLs, then an exact hash join that removes the filter's false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.graph import lookup

#: Entries of the list for each 64-bit word of the filter, and most words: 32 MB. A longer list fills the filter further,
#: which only passes more rows on to the exact join.
WORD_ENTRIES, MOST_WORDS = 4, 1 << 22

#: (verdict, host and path): the host part is up to the first "/".
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased. Null or no ``://``: empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"\A([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """A URL without scheme, query and fragment; a leading ``www.`` or ``m.``, a final ``.html`` and final slashes go."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html$", ""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (as text, host then path) that fits: its host is the url's or a parent domain of it, and the
    url's path starts with the rule's. Null if none fits. Rules are looked up by every parent domain in a map literal,
    so the cost for a row follows the labels of its host, not the number of rules."""
    by_host: dict[str, list[str]] = {}
    for _, text in rules:
        name, _, rest = text.partition("/")
        by_host.setdefault(name, []).append("/" + rest)
    if not by_host:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for name, paths in by_host.items() for x in (F.lit(name), F.array(*map(F.lit, paths)))])
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.flatten(F.transform(parents, lambda p: F.transform(F.filter(F.coalesce(table[p], F.array().cast("array<string>")), lambda start: F.startswith(path, start)), lambda start: F.concat(p, start))))
    return F.when(F.size(fits) > 0, F.array_max(F.transform(fits, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"])


def bloom_words(listed: DataFrame, column: str, n_words: int, hashes: int = 6) -> DataFrame:
    """The blocked Bloom filter as rows (block, word): each listed text sets ``hashes`` bits in one 64-bit word."""
    h = F.xxhash64(F.col(column))
    return listed.select(F.pmod(h, F.lit(n_words)).cast("int").alias("block"), bloom_mask(F.col(column), hashes).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def bloom_mask(text: Column, hashes: int = 6) -> Column:
    """The bits of a text: six bits of a second hash choose each."""
    g = F.xxhash64(text, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(hashes):
        bit = F.shiftrightunsigned(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "canonical", n_words: int | None = None) -> DataFrame:
    """``pages`` with host, path, canonical_url, rule, maybe_listed, is_listed and verdict.

    A rule decides where one fits. Elsewhere the verdict is block exactly if the canonical URL is in ``listed``
    (one string column ``listed_url``; nulls and repeats in it are ignored), else allow. The filter has ``n_words`` words,
    by default as the list's count asks (``WORD_ENTRIES``, ``MOST_WORDS``), and reaches tasks as one literal. Rows that it
    stops are done; only possible hits are joined, by their distinct URLs, so a frequent URL is no hot key. Columns of
    ``pages`` keep their values, except those named above, which are replaced. Null urls have an empty host, path and
    canonical URL, match no rule and are never listed. Repeated rows are judged each; an empty table gives an empty result.
    """
    names = ("host", "path", "canonical_url", "rule", "maybe_listed", "is_listed", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in names])
    keys = listed.select(F.col(listed_url).alias("__listed")).where("__listed is not null").distinct()
    if n_words is None:
        n_words = 1 << min(MOST_WORDS.bit_length() - 1, max(10, (keys.count() // WORD_ENTRIES).bit_length()))
    words = bloom_words(keys, "__listed", n_words)
    every = pages.sparkSession.range(n_words).select(F.col("id").cast("int").alias("block"))
    every = every.join(words, "block", "left").select(F.struct("block", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("entry"))
    filter_words = every.agg(F.sort_array(F.collect_list("entry"))["word"].alias("words"))
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn("canonical_url", canonical(F.col("host"), F.col("path"))).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    word = F.element_at(filter_words.scalar(), F.pmod(F.xxhash64("canonical_url"), F.lit(n_words)).cast("int") + 1)
    mask = bloom_mask(F.col("canonical_url"))
    out = out.withColumn("maybe_listed", F.col("rule").isNull() & (F.col("canonical_url") != "") & (word.bitwiseAND(mask) == mask))
    hits = out.where("maybe_listed")
    asked = hits.groupBy("canonical_url").agg(F.count("*").alias("__n"))
    found = asked.join(keys, asked["canonical_url"] == keys["__listed"]).select("canonical_url", "__n", F.lit(True).alias("is_listed"))
    hits = lookup(hits, found, ["canonical_url"], "__n", asked.agg(F.sum("__n")).scalar(), "left").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    out = out.where(~F.col("maybe_listed")).withColumn("is_listed", F.lit(False)).unionByName(hits)
    verdicts = F.lit(None).cast("string")
    if rules:
        verdicts = F.create_map(*[F.lit(x) for verdict, text in rules for x in (text, verdict)])[F.col("rule")]
    return out.withColumn("verdict", F.coalesce(verdicts, F.when(F.col("is_listed"), "block").otherwise("allow")))
