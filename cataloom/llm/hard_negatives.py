"""Hard negatives by full sorts of scores: for each anchor and positive, the best rows of other labels in a window of scores.

Anchors and rows are dealt into blocks of bounded size, and each pair of blocks is one group of a cogrouped join: its task
computes the integer scores of a block of anchors against a block of rows, sorts each anchor's scores whole (by score, then
id), finds each positive's upper limit by binary search and reads the next rows of another label down to the lower limit.
The best of a window over all rows are among the best of each block, so the blocks' few rows are ranked again by a window
whose limit Spark applies before the shuffle. Nothing is sampled, and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.llm.storage import stored

#: Each component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's score.
LOWER, UPPER = 50, 95
#: Rows and anchors of a block at most, in expectation; rows of a block that are worth a task; scores held at a time.
ROW_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK, TILE = 16_384, 8192, 512, 1 << 20


def usable(label_column: str, vector_column: str, id_column: str) -> Column:
    """Whether a row has an id, a label and a vector whose components are all there and finite."""
    finite = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.col(vector_column).isNotNull() & finite


def integers(lists: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Vectors as rows of floor(scale * x), as long integers; shorter vectors end in zeros."""
    lists = lists.combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(counts), int(counts.max(initial=0))), np.int64)
    # Beyond 2**62, where a score can't be a long integer any more, components stay at that bound.
    out[np.arange(out.shape[1]) < counts[:, None]] = np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices, kept within the range of a long integer."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 53:  # each sum is exact in double precision
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_positives(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> list[np.ndarray]:
    """For each anchor, places of its first ``k`` rows of the same label, by falling score and rising id."""
    out = []
    for row, fits in zip(scores, same, strict=True):
        some = np.flatnonzero(fits)
        out.append(some[np.lexsort((ids[some], -row[some]))[:k]])
    return out


def in_window(scores: np.ndarray, ids: np.ndarray, other: np.ndarray, low: list[int], high: list[int], k: int) -> list[np.ndarray]:
    """For one anchor and each of its positives, places of the first ``k`` rows of another label with low <= score <= high.

    All scores are sorted once; the binary search gives where a positive's window starts."""
    order = np.lexsort((ids, -scores))
    order = order[other[order]]
    falling = scores[order]
    starts = np.searchsorted(-falling, [-x for x in high], side="left")
    found = []
    for start, least in zip(starts.tolist(), low, strict=True):
        places = order[start : start + k]
        found.append(places[scores[places] >= least])
    return found


def mine_negatives(
    vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds.

    A row's score is the integer inner product of its vector with the anchor's, after floor(scale * x); higher scores come
    first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of the same label (all, if
    fewer). For each, the first ``negatives`` rows of another label with lower * p <= 100 * score <= upper * p, where p is
    the positive's score, are returned with their rank from 1; a positive without any gives no row.

    Rows take no part where the id, the label or the vector is null or a component is null or not finite. Vectors of unlike
    lengths compare as if the shorter one went on with zeros. Rows of one id aren't compared with each other; a repeated
    row is a row of its own as positive and negative, and a repeated anchor gives its rows once for each. Scores beyond a
    long integer stay at its bounds. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type, label_type = vectors.schema[id_column].dataType, vectors.schema[label_column].dataType
    given = vectors.where(usable(label_column, vector_column, id_column))
    given = given.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    # Written once: the number of a row must not change when a task runs again.
    rows = stored(given.withColumn("row", F.monotonically_increasing_id()), "negative-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("m")).first()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes["n"] // LEAST_BLOCK))
    row_blocks, anchor_blocks = max(1, tasks, -(-sizes["n"] // ROW_BLOCK)), max(1, -(-sizes["m"] // ANCHOR_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keys = ["anchor_block", "row_block"]
    dealt = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "v")], block(row_blocks).alias("row_block"), every(anchor_blocks).alias("anchor_block"))
    asked = rows.where("is_anchor").select("row", "id", "label", "v", block(anchor_blocks).alias("anchor_block"), every(row_blocks).alias("row_block"))

    def scored(left: pa.Table, right: pa.Table):  # noqa: ANN202
        """Tiles of a pair of blocks: first anchor, scores, ids of rows, whether label and id are the same."""
        a, b = integers(left["v"], scale), integers(right["v"], scale)
        a_id, b_id = (t["id"].combine_chunks().to_numpy(zero_copy_only=False) for t in (left, right))
        a_label, b_label = (t["label"].combine_chunks().to_numpy(zero_copy_only=False) for t in (left, right))
        step = max(1, TILE // max(1, len(b)))
        for s in range(0, len(a), step):
            e = s + step
            yield s, products(a[s:e], b), b_id, a_label[s:e, None] == b_label[None], a_id[s:e, None] == b_id[None]

    near = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            number = left["row"].to_pylist()
            for s, scores, ids, same, self_ in scored(left, right):
                for k, places in enumerate(best_positives(scores, ids, same & ~self_, positives)):
                    found += [(number[s + k], int(ids[j]), int(scores[k, j])) for j in places.tolist()]
        return pa.Table.from_pylist([dict(zip(near.names, x, strict=True)) for x in found], schema=near)

    first = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(find_positives, "row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    best = first.withColumn("place", place).where(F.col("place") <= positives)
    best = stored(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("best")), "negative-positives")
    windows = best.select("row", F.col("best.positive_score").alias("p"))
    searched = asked.join(windows, "row")
    hit = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            number, limits = left["row"].to_pylist(), left["p"].to_pylist()
            for s, scores, ids, same, self_ in scored(left, right):
                for k, line in enumerate(scores):
                    p = limits[s + k]
                    low, high = [-(-lower * x // 100) for x in p], [upper * x // 100 for x in p]
                    for q, places in enumerate(in_window(line, ids, ~same[k] & ~self_[k], low, high, negatives)):
                        found += [(number[s + k], q, int(ids[j]), int(line[j])) for j in places.tolist()]
        return pa.Table.from_pylist([dict(zip(hit.names, x, strict=True)) for x in found], schema=hit)

    hits = searched.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(find_negatives, "row long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = rows.where("is_anchor").select("row", F.col("id").alias("anchor_id"))
    pairs = best.select("row", F.posexplode("best").alias("place", "b"))
    out = hits.join(pairs, ["row", "place"]).join(names, "row")
    kind = id_type.simpleString()
    return out.select("anchor_id", F.col("b.positive_id").cast(kind).alias("positive_id"), "rank", F.col("negative_id").cast(kind).alias("negative_id"), F.col("b.positive_score").alias("positive_score"), "negative_score")
