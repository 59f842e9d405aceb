"""Mid-rank quantile scores of candidates against a weighted seed.

The rank of a value among N is (number below + half the number equal) / N. A candidate's score is the weighted mean of
its components: mean ranks of its tags by facet, and ranks of its numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.operators.summary import tagged

#: Ranges that the distinct values of a number are cut into; a window holds one of them.
RANGES = 128
#: The numbers of a seed of at most so many rows are part of the plan; those of a larger one are joined by ranges. A seed of
#: at most ``SEED_ROWS`` rows is kept at hand between steps; a larger one is written.
PLAN_ROWS, SEED_ROWS = 500, 100_000


@dataclass
class Settings:
    """Weights of the components, and the rank of what the seed does not know."""

    tag_weights: dict[str, int] = field(default_factory=lambda: {"primary": 4, "secondary": 2, "descriptor": 7, "credit": 1})
    number_weights: dict[str, int] = field(default_factory=lambda: {"rating": 2, "rating_count": 1, "descriptor_count": 2})
    novelty: float = 0.2


def mid_ranks(values: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """``values`` with the mid-rank of ``value`` inside its group.

    Equal values are counted first and the running sums go over distinct values only."""
    counts = values.groupBy(*group, value).agg(F.count("*").alias("__equal"))
    by = Window.partitionBy(*group)
    below = F.coalesce(F.sum("__equal").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, (below + F.col("__equal") / 2.0) / F.sum("__equal").over(by)).drop("__equal")
    return values.join(ranks, [*group, value])


def tag_ranks(factors: DataFrame) -> DataFrame:
    """(facet, item, factor, rank) from (facet, item, factor)."""
    return mid_ranks(factors, ["facet"], "factor")


def number_ranks(candidates: DataFrame, seed: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, one ``<name>_rank`` a column) of each candidate's numbers among the seed's numbers, which are not weighted.

    All columns go through one pass. Distinct values of seed and candidates are counted together; a value's rank is a sum
    over earlier ranges of values and one inside its range, so neither side is collected or broadcast."""
    if not columns:
        return candidates.select(key).where("false")

    def tall(rows: DataFrame, *keep: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in columns.items()])
        return rows.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.name", "e.v").where("v is not null")

    asked = tall(candidates, key)
    counts = tall(seed).withColumn("n", F.lit(1)).unionByName(asked.select("name", "v").withColumn("n", F.lit(0)))
    counts = counts.groupBy("name", "v").agg(F.sum("n").alias("n"))
    # Ranges of about as many distinct values each: one row of bounds for each of the few columns.
    bounds = counts.groupBy("name").agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)]).alias("bounds"))
    counts = counts.join(F.broadcast(bounds), "name").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    by_name = Window.partitionBy("name")
    earlier = by_name.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("name", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("name", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(by_name).alias("total"))
    inside = Window.partitionBy("name", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, ["name", "range"])
    ranks = ranks.select("name", "v", F.try_divide(F.col("start") + F.col("below") + F.col("n") / 2.0, F.col("total")).alias("rank"))
    found = asked.join(ranks, ["name", "v"])
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("rank"))).alias(f"{n}_rank") for n in columns])


def rank_among(values: list[float], number: Column) -> Column:
    """The mid-rank of a number among a few others; null for a null, or among none."""
    if not values:
        return F.lit(None).cast("double")
    sought = F.array(*[F.lit(v) for v in values])
    below, equal = F.size(F.filter(sought, lambda v: v < number)), F.size(F.filter(sought, lambda v: v == number))
    return F.when(number.isNotNull(), (below + equal / 2.0) / float(len(values)))


def assess(candidates: DataFrame, key: str, tags: dict[str, str], numbers: dict[str, str], ranks: DataFrame, seed: DataFrame, settings: Settings) -> DataFrame:
    """(key, score, one rank a component) of every candidate, one row a key.

    ``tags`` maps facets to array columns, ``numbers`` components to columns. A tag that the seed does not have, or whose
    rank is 0, counts as novel, and so does a candidate without tags. A component of weight 0 drops out; a candidate
    whose score is not a number is left out. Candidates are read once: their numbers stay beside their tags through the
    one aggregation, and are ranked after it.
    """
    used = {f: c for f, c in tags.items() if settings.tag_weights.get(f, 0)}
    counted = {n: c for n, c in numbers.items() if settings.number_weights.get(n, 0)}
    weights = [(f, settings.tag_weights[f]) for f in used] + [(n, settings.number_weights[n]) for n in counted]
    total = sum(w for _, w in weights)
    values = {n: F.col(c).cast("double").alias(f"__{n}") for n, c in counted.items()}
    out = candidates.select(key, *values.values())
    if used:
        entries = tagged({f: F.col(c) for f, c in used.items()})
        tall = candidates.select(key, *values.values(), F.explode_outer(entries).alias("e")).select("*", "e.facet", "e.item").drop("e")
        tall = tall.join(ranks.select("facet", "item", "rank"), ["facet", "item"], "left")
        known = F.when(F.col("rank") > 0, F.col("rank")).otherwise(settings.novelty)
        out = tall.groupBy(key).agg(*[F.coalesce(F.avg(F.when(F.col("facet") == f, known)), F.lit(settings.novelty)).alias(f"{f}_rank") for f in used], *[F.first(f"__{n}").alias(f"__{n}") for n in counted])
    if not total:
        return out.withColumn("score", F.lit(None).cast("double")).where("false")
    if counted:
        own = seed.select(*[F.col(c).cast("double").alias(n) for n, c in counted.items()])
        some = own.limit(PLAN_ROWS + 1).toArrow()
        if some.num_rows <= PLAN_ROWS:
            out = out.withColumns({f"{n}_rank": rank_among(some[n].drop_null().to_pylist(), F.col(f"__{n}")) for n in counted})
        else:
            asked = out.select(key, *[F.col(f"__{n}").alias(n) for n in counted])
            out = out.join(number_ranks(asked, own, key, {n: n for n in counted}), key, "left")
    score: Column = F.lit(0.0)
    for name, w in weights:
        score = score + F.col(f"{name}_rank") * float(w)
    out = out.drop(*[f"__{n}" for n in counted])
    return out.withColumn("score", score / float(total)).where(F.col("score").isNotNull() & ~F.isnan("score"))


def row_numbers(rows: DataFrame, by: str, tie: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3, ... by a column, ties by another. Rows are numbered inside ranges of the column, and
    a range starts where the earlier ones end, so no window holds all rows."""
    bounds = rows.agg(F.percentile_approx(by, [k / RANGES for k in range(1, RANGES)]).alias("__bounds"))  # one row
    placed = rows.withColumn("__bounds", bounds.scalar()).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(by))) * (-1 if descending else 1)).drop("__bounds")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))  # at most RANGES rows
    starts = counts.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(by) if descending else F.asc(by), tie))
    out = placed.withColumn("__place", inside).join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    return out.withColumn(name, (F.col("__start") + F.col("__place")).cast("int")).drop("__range", "__of", "__start", "__place")


def top(rows: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """The ``k`` best by score, ties by key."""
    return rows.orderBy(F.desc(score), key).limit(k)
