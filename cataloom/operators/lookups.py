"""List lookups: components, their states, and the status of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators.eventlog import FILE_STATES


def list_components(segments: DataFrame, root: str, siblings: str, items: str) -> DataFrame:
    """(root, component): the distinct pages that a list needs, its segments and its items."""
    parts = segments.select(root, F.explode(F.array_union(siblings, items)).alias("component"))
    return parts.distinct()


def component_states(components: DataFrame, states: DataFrame, key: str, default: int = 1) -> DataFrame:
    """Components with their state; those without one are enqueued."""
    return components.join(states.select(F.col(key).alias("component"), "state"), "component", "left").withColumn("state", F.coalesce("state", F.lit(default)))


def dormant(components: DataFrame) -> DataFrame:
    """Components to enqueue again."""
    return components.where(F.col("state").isin(FILE_STATES["CrawlEnqueued"], FILE_STATES["CrawlFailed"]))


def list_status(roots: DataFrame, components: DataFrame, root: str, is_segment: str) -> DataFrame:
    """(root, status, completion) of each list.

    Invalid without segments; Started while no segment is parsed; InProgress while some are; Failed if every component
    failed to parse; Completed if all are done for good; InProgress otherwise."""
    parsed = FILE_STATES["FileParsed"], FILE_STATES["FileParseFailed"], FILE_STATES["ReadModelUpdated"]
    terminal = FILE_STATES["FileParseFailed"], FILE_STATES["ReadModelUpdated"]
    segment = F.col(is_segment)
    counts = components.groupBy(root).agg(
        F.count_if(segment).alias("segments"), F.count_if(segment & F.col("state").isin(*parsed)).alias("parsed"), F.count("*").alias("all"),
        F.count_if(F.col("state") == FILE_STATES["FileParseFailed"]).alias("failed"), F.count_if(F.col("state").isin(*terminal)).alias("terminal"),
        F.count_if(F.col("state") == FILE_STATES["ReadModelUpdated"]).alias("updated"),
    )
    out = roots.select(root).join(counts, root, "left").na.fill(0)
    status = (
        F.when(F.col("segments") == 0, "Invalid").when(F.col("parsed") == 0, "Started").when(F.col("parsed") < F.col("segments"), "InProgress")
        .when(F.col("failed") == F.col("all"), "Failed").when(F.col("terminal") == F.col("all"), "Completed").otherwise("InProgress")
    )
    done = F.coalesce(F.round(F.try_divide(100.0 * F.col("updated"), F.col("all").cast("double"))), F.lit(0)).cast("int")
    return out.select(root, status.alias("status"), done.alias("completion"))


def touched(lookups: DataFrame, changed: DataFrame, root: str, siblings: str, items: str) -> DataFrame:
    """The lookups of which a segment or item changed."""
    return list_components(lookups, root, siblings, items).join(changed.select(F.col("key").alias("component")), "component", "left_semi").select(root).distinct()


def album_lookup_step(album_known: str = "known", parsed: str = "parsed") -> Column:
    """The next action of an album lookup: search, use the album at hand, or crawl it."""
    return F.when(~F.col(parsed), "crawl_search").when(F.col(album_known), "use_album").otherwise("crawl_album")


def pending_imports(imports: DataFrame, lookups: DataFrame, identity: str, done: str = "AlbumParsed") -> DataFrame:
    """Imports whose lookup has not ended."""
    return imports.join(lookups, identity).where(F.col("status") != done)


def run_lists(roots: DataFrame, components: DataFrame, root: str, is_segment: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of some lists: (components to enqueue again, status of each list, the event of each list's new status)."""
    statuses = list_status(roots, components, root, is_segment)
    events = statuses.select(F.lit("lookup").alias("topic"), F.concat(F.lit("list/"), F.col(root).cast("string")).alias("key"), F.to_json(F.struct("status", "completion")).alias("event"))
    return dormant(components).select(root, "component").distinct(), statuses, events
