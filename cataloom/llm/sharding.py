"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.graph import lookup, numbered
from cataloom.llm.storage import stored

SHARDS, ROUNDS, ROW_OVERHEAD = 40, 4, 16
#: Rows that one task numbers, where a key has more than 64 times as many.
NUMBERED = 100_000
#: Rows of a group that are kept side by side.
CHUNK = 1000


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null), group_id, group_rows.

    Links are equal texts: a document is linked with every other document of its group through the group's node, so a
    group of any size costs one edge a row and no pairs. Rounds start from a hash assignment. In each, every group
    counts its members by shard, its plurality shard attracts the others, and a shard takes in no more linked rows than
    its quota and the rows that want to leave it allow. A group with more rows than a quota has several targets.
    The last step enforces the quotas exactly: counts of any two shards differ by one at most, and rows without a
    partner are the first to leave an overfull shard.

    Null text counts as empty (size 16, crc32 0). A null id is an ordinary value. Repeated rows are rows of their own;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(text, F.lit("second")).alias("g2"),
    )
    base = stored(base, "shard-input")
    total = base.count()
    buckets = max(64, total // NUMBERED)
    # Rows are told apart by a row number; only rows whose text repeats take part in the propagation.
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("group_rows")).withColumn("weight", F.col("group_rows"))
    base = lookup(base, groups, ["g1", "g2"], "weight", total)
    base = stored(numbered(base, ["g1", "g2"], [F.xxhash64("id"), F.col("id")], "member", buckets), "shard-rows")
    quota = max(1, -(-total // shards))
    # A start by hash of the group and the block of members: members of one block stay together from the start,
    # and a group above the quota is dealt to consecutive shards block by block.
    start = F.pmod(F.xxhash64("id", "member", "g1"), F.lit(shards)).cast("int")
    chunk = F.xxhash64("g1", F.floor(F.col("member") / CHUNK))
    state = base.withColumn("block", F.floor(F.col("member") / quota).cast("long")).withColumn("shard", start)
    for _ in range(rounds):
        linked = state.where("group_rows > 1")
        votes = linked.groupBy("g1", "g2", "block", "shard").agg(F.count("*").alias("votes"))
        wanted = votes.groupBy("g1", "g2", "block").agg(F.max_by("shard", F.struct("votes", F.xxhash64("shard", "g1", "block"))).alias("wanted"), F.sum("votes").alias("weight"))
        moves = lookup(linked, wanted, ["g1", "g2", "block"], "weight", total).where("wanted != shard").select("g1", "g2", "member", "shard", "wanted")
        # A shard takes in linked rows up to its quota, counting those that want to leave it as gone; rows without links
        # make room at the end. Chunks of groups are taken in whole where they fit.
        sizes = linked.groupBy("shard").agg(F.count("*").alias("held"))
        leaving = moves.groupBy("shard").agg(F.count("*").alias("leaving"))
        room = sizes.join(leaving, "shard", "left").select(F.col("shard").alias("wanted"), F.greatest(F.lit(quota) - F.col("held") + F.coalesce("leaving", F.lit(0)), F.lit(0)).alias("room"))
        ranked = numbered(moves, ["wanted"], [chunk, F.col("g1"), F.col("g2"), F.col("member")], "at", buckets)
        ranked = ranked.join(F.broadcast(room), "wanted", "left").where(F.col("at") < F.coalesce("room", F.lit(quota)))
        moved = ranked.select("g1", "g2", "member", F.col("wanted").alias("moved_to"))
        state = state.join(moved, ["g1", "g2", "member"], "left").withColumn("shard", F.coalesce("moved_to", "shard")).drop("moved_to")
        state = stored(state, "shard-round")
    return balanced(state, total, shards, buckets)


def balanced(state: DataFrame, total: int, shards: int, buckets: int) -> DataFrame:
    """Exact quotas: rows beyond a shard's quota fill the free slots of the others; then slots are numbered."""
    spark = state.sparkSession
    # Whole groups sit at the front of a shard and lone rows behind, so that lone rows leave first.
    front = state.where("group_rows > 1").withColumn("late", F.lit(0))
    back = state.where("group_rows = 1").withColumn("late", F.lit(1))
    order = [F.xxhash64("g1", F.floor(F.col("member") / CHUNK)), F.col("g1"), F.col("g2"), F.col("member")]
    ranked = numbered(front, ["shard"], order, "at", buckets).unionByName(numbered(back, ["shard"], order, "at", buckets))
    fronts = front.groupBy("shard").agg(F.count("*").alias("fronts"))
    ranked = ranked.join(F.broadcast(fronts), "shard", "left").withColumn("at", F.col("at") + F.when(F.col("late") == 1, F.coalesce("fronts", F.lit(0))).otherwise(0)).drop("fronts", "late")
    quotas = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("quota"))
    ranked = stored(ranked.join(F.broadcast(quotas), "shard"), "shard-ranked")
    stay = ranked.where("at < quota").select("id", "size", "text_crc32", "g1", "group_rows", "shard", F.col("at").alias("slot"))
    # Free slots as intervals of one running number; every overflowing row has a running number as well.
    held = ranked.groupBy("shard").agg(F.count("*").alias("held"))
    free = quotas.join(held, "shard", "left").select("shard", F.coalesce("held", F.lit(0)).alias("held"), F.greatest(F.col("quota") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("free"))
    slots, reached = [], 0
    for row in free.where("free > 0").orderBy("shard").collect():  # a row a shard at most
        slots.append((reached, reached + row["free"], row["shard"], row["held"]))
        reached += row["free"]
    over = numbered(ranked.where("at >= quota").withColumn("all", F.lit(0)), ["all"], order, "number", buckets).drop("all")
    schema = "from_number long, to_number long, to_shard int, held long"
    target = spark.createDataFrame(slots, schema)
    listing = target.agg(F.collect_list(F.struct("from_number", "to_number", "to_shard", "held")).alias("slots"))
    over = over.withColumn("slots", listing.scalar()).withColumn("slot_of", F.filter("slots", lambda s: (s["from_number"] <= F.col("number")) & (F.col("number") < s["to_number"]))[0])
    moved = over.select("id", "size", "text_crc32", "g1", "group_rows", F.col("slot_of.to_shard").alias("shard"), (F.col("slot_of.held") + F.col("number") - F.col("slot_of.from_number")).alias("slot"))
    return stay.unionByName(moved).select(F.col("id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("g1").alias("group_id"), "group_rows")
