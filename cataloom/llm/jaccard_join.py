"""Similarity join of texts by the Jaccard coefficient of their word shingles, by chosen paths.

A text is the set of its five-word shingles. In each repetition a set follows the shared tokens that a hash of path and
token chooses (two a step in expectation), so similar sets share paths. Buckets of one path that are small are compared
by brute force; larger ones are split again by a further chosen token, unless their sets would keep together: the sketches
of some sets of each bucket tell that beforehand, the size of the bucket above afterwards. Such sets are near copies, which
are compared in blocks, so that nothing is dropped. Every pair is judged in the first of the buckets it shares and nowhere
else, and accepted by its exact coefficient.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.graph import components, lookup
from cataloom.llm.storage import light_batches, settle, stored
from cataloom.llm.text import BASE, blocks, mix, raw_bytes, shingles, words

WIDTH, SIMILARITY = 5, 0.8
#: Tokens that a set follows at each step, in expectation; steps at most; tokens of a set that later steps choose from.
BRANCH, DEPTH, CHOICE = 2.0, 5, 128
#: A bucket that keeps more than this share of the rows of the one above is not split again.
DENSE = 0.5
#: Sets of a large bucket, in expectation, whose sketches tell before a split whether the bucket would keep together. That
#: decides how a bucket is compared and never which pairs are found.
LOOKED_AT = 32
#: Chance to find a pair at the threshold: of the 12.5 million pairs of 5,000 near copies 0.13 are lost in expectation.
TARGET_RECALL = 1 - 1e-8
#: Largest bucket that is compared at once, and rows of a block of a larger one after the last step.
SMALL, BLOCK = 64, 1024
#: Parts of a sketch; sets with at least ``SKETCHED`` tokens whose sketches agree in a share of the parts that is lower by
#: ``SLACK`` than the similarity are not compared (at 0.8 the chance of that is under 1e-7).
PARTS, SKETCHED, SLACK = 64, 128, 0.3


def repetitions(recall: float = TARGET_RECALL, similarity: float = SIMILARITY) -> int:
    """Repetitions until a pair at the threshold shares a path of full depth with this recall; most paths end earlier.

    Of BRANCH chosen tokens a pair shares BRANCH * similarity or more in expectation (Poisson); the chance to share a path
    of each further step follows from the chance of the step before. Later steps choose from the same CHOICE tokens in
    every repetition, so the chance to fail is averaged over how many of those the pair shares."""
    mean, weight, cases = CHOICE * similarity, math.exp(-CHOICE * similarity), []
    for shared in range(2 * CHOICE + 1):
        alive = 1.0
        for _ in range(DEPTH - 1):
            alive = 1 - math.exp(-BRANCH * min(1, shared / CHOICE) * alive)
        cases.append((weight, math.exp(-BRANCH * similarity * alive)))
        weight *= mean / (shared + 1)
    repeats = 1
    while sum(w * fail**repeats for w, fail in cases) > 1 - recall and repeats < 100:
        repeats += 1
    return repeats


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def chance(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A hash in [0, 1) of each token under a salt."""
    return (mix(x ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


SALTS = mix(np.arange(1, 1025, dtype=np.uint64) * BASE)


def token_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of the distinct shingles of each text, in order of row and token."""
    _, _, hashes, row = words(data, offsets)
    token, where = shingles(hashes, row, width)
    order = np.lexsort((token, where))
    token, where = token[order], where[order]
    if len(token):
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (where[1:] != where[:-1])])
        token, where = token[once], where[once]
    return where, token


def signatures(where: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens and two 64-bit sums that tell sets apart."""
    n = np.bincount(where, minlength=rows)
    one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    heads = np.cumsum(n)[full] - n[full]
    if len(full):
        one[full] = np.add.reduceat(mix(token ^ SALTS[1000]), heads)
        two[full] = np.add.reduceat(mix(token ^ SALTS[1001]), heads)
    return n, one.view(np.int64), two.view(np.int64)


def sketch(where: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """One byte of the least hash in each of ``PARTS`` parts of the hash space; 0 for an empty part."""
    h = mix(token ^ SALTS[1002])
    cell = where * PARTS + (h >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    out = np.zeros(rows * PARTS, np.uint8)
    if len(cell):
        head = np.concatenate([[True], cell[1:] != cell[:-1]])
        out[cell[head]] = 1 + mix(h[head]) % np.uint64(255)
    return out.reshape(rows, PARTS)


def chosen_paths(where: np.ndarray, token: np.ndarray, n: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of the first step's paths, in order of rows."""
    share = np.minimum(1.0, BRANCH / np.maximum(n, 1))
    rows, paths = [], []
    for r in range(repeats):
        take = np.flatnonzero(chance(token, SALTS[r]) < share[where])
        rows.append(where[take])
        paths.append(mix(token[take] + SALTS[100 + r]))
    row, path = np.concatenate(rows), np.concatenate(paths)
    order = np.argsort(row, kind="stable")
    return row[order], path[order].view(np.int64)


def chosen_tokens(where: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and half the hash of the tokens that later steps choose from, in order of rows."""
    some = np.flatnonzero(chance(token, SALTS[200]) < np.minimum(1.0, CHOICE / np.maximum(n, 1))[where])
    return where[some], (token[some] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def next_paths(row: np.ndarray, path: np.ndarray, choice: np.ndarray, counts: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Given path (by place) and path one step below it; ``counts`` tells how many tokens of ``choice`` are each row's."""
    starts = np.cumsum(counts) - counts
    again = np.minimum(1.0, BRANCH / np.minimum(np.maximum(n, 1), CHOICE))
    path, parent = path.view(np.uint64), np.repeat(np.arange(len(row)), counts[row])
    t = choice.view(np.uint32).astype(np.uint64)[spread(starts[row], counts[row])]
    hit = np.flatnonzero((mix((t + SALTS[300 + level]) ^ path[parent]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < again[row[parent]])
    parent, t = parent[hit], t[hit]
    return parent, mix(path[parent] * BASE + t).view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables that never split a group of equal keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            value = table[k].to_numpy()
            change[1:] |= value[1:] != value[:-1]
            change[0] |= bool(held) and held[-1][k][-1].as_py() != value[0]
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(table)
            continue
        yield pa.concat_tables([*held, table.slice(0, int(cut[-1]))]).combine_chunks()
        pa.default_memory_pool().release_unused()
        held = [table.slice(int(cut[-1]))]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def alike(marks: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """For all pairs of some rows: whether sizes and sketches allow the similarity."""
    small, large = np.minimum(n[left][:, None], n[right][None]), np.maximum(n[left][:, None], n[right][None])
    out = small >= similarity * large - 1e-9
    x, y = np.ascontiguousarray(marks[left].T), np.ascontiguousarray(marks[right].T)
    equal = np.zeros((len(left), len(right)), np.uint8)
    for k in range(PARTS):
        equal += x[k][:, None] == y[k][None]
    empty = np.rint((x.T == 0).astype(np.float32) @ (y == 0).astype(np.float32))
    out &= (equal - empty >= (similarity - SLACK) * (PARTS - empty)) | (small < SKETCHED)
    return out


def keeps_together(marks: np.ndarray, similarity: float) -> bool:
    """Whether at least half of the pairs of some sketches allow the similarity, so that a split of their bucket is futile."""
    if len(marks) < 2:
        return False
    x, y = marks[:, None], marks[None]
    equal, filled = ((x == y) & (x > 0)).sum(axis=2), ((x | y) > 0).sum(axis=2)
    return bool(np.mean((equal >= (similarity - SLACK) * filled)[np.triu_indices(len(marks), 1)]) >= 0.5)


def in_first_bucket(every: np.ndarray, path: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the first bucket that both rows of a pair are in is the one at hand. ``every`` is in order."""
    out, open_ = np.zeros(len(i), bool), np.arange(len(i))
    for k in range(every.shape[1]):
        mine = every[i[open_], k]
        shared = (every[j[open_]] == mine[:, None]).any(axis=1)
        out[open_[shared]] = mine[shared] == path[i[open_[shared]]]
        open_ = open_[~shared]
        if not len(open_):
            break
    return out


def candidate_pairs(table: pa.Table, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group that sizes and sketches allow, in the first bucket that both rows share."""
    rows = len(table)
    path, low, high, block, n = (table[k].to_numpy() for k in ("path", "low", "high", "block", "n"))
    marks = np.frombuffer(raw_bytes(table["sketch"])[0], np.uint8).reshape(rows, PARTS)
    lists = table["every"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    counts = np.diff(lists.offsets.to_numpy())
    every = np.full((rows, max(1, int(counts.max()))), np.iinfo(np.int64).max, np.int64)
    every[np.repeat(np.arange(rows), counts), spread(np.zeros(rows, np.int64), counts)] = lists.flatten().to_numpy()
    heads = np.flatnonzero(np.diff(group_numbers(table), prepend=-1))
    ends = np.concatenate([heads[1:], [rows]])

    def judged(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            keep = in_first_bucket(every, path, x, y)
            if keep.any():
                yield x[keep], y[keep]

    # Small groups all at once.
    few = ends - heads <= SMALL
    partners = np.zeros(rows, np.int64)
    inside = spread(heads[few], (ends - heads)[few])
    partners[inside] = np.repeat(ends[few], (ends - heads)[few]) - inside - 1
    reach = np.concatenate([[0], np.cumsum(partners)])
    start = 0
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(reach, reach[start] + (1 << 16), side="right")) - 1)
        i = np.repeat(np.arange(start, stop), partners[start:stop])
        j = spread(np.arange(start, stop) + 1, partners[start:stop])
        keep = (low[i] == high[i]) | (block[i] != block[j])
        keep &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[keep], j[keep]
        if len(i):
            x, y = marks[i], marks[j]
            filled = ((x | y) > 0).sum(axis=1)
            keep = (((x == y) & (x > 0)).sum(axis=1) >= (similarity - SLACK) * filled) | (np.minimum(n[i], n[j]) < SKETCHED)
            yield from judged(i[keep], j[keep])
        start = stop
    # Large groups in tiles.
    for head, end in zip(heads[~few].tolist(), ends[~few].tolist(), strict=True):
        members = np.arange(head, end)
        one = low[head] == high[head]
        left, right = (members, members) if one else (members[block[head:end] == low[head]], members[block[head:end] == high[head]])
        for a in range(0, len(left), 256):
            for b in range(0, len(right), 1024):
                x, y = left[a : a + 256], right[b : b + 1024]
                if one and x[0] > y[-1]:
                    continue
                i, j = np.nonzero(alike(marks, n, x, y, similarity))
                i, j = x[i], y[j]
                if one:
                    i, j = i[i < j], j[i < j]
                yield from judged(i, j)


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a group of sets, as products of blocks of the incidence matrix."""
    size = len(sets)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    shared = count[number] > 1
    number, owner = number[shared], owner[shared]
    out = np.zeros((size, size), np.float32)
    if not len(number):
        return out
    names, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    width = max(256, min(len(names), (16 << 20) // (4 * size)))
    for start in range(0, len(names), width):
        a, b = np.searchsorted(number, [start, start + width])
        part = np.zeros((size, min(width, len(names) - start)), np.float32)
        part[owner[a:b], number[a:b] - start] = 1
        out += part @ part.T
    return out


def joined_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the least row of each row's group so far) after joining the groups of each pair."""
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for x in (i, j, root[i], root[j]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def group_numbers(table: pa.Table) -> np.ndarray:
    """The number of each row's group (bucket and pair of blocks), in order."""
    path, low, high = (table[k].to_numpy() for k in ("path", "low", "high"))
    return np.cumsum(np.concatenate([[0], (path[1:] != path[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(cut, [*cut[1:], len(values)], strict=True))


def near_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, n_links, n_copies, rep_id, component_id, kept.

    Two rows are linked if the Jaccard coefficient of their sets of five-word shingles is at least ``similarity``. n_links
    counts the linked rows, copies included; n_copies the rows with the same set, itself included; rep_id is the least id
    of those; component_id the least id that links reach; kept says whether that is the row's own id. A text with fewer
    than five words has one shingle of all its words; a text without words (or null) has none and no links. Rows with a
    null id are returned without links (component_id null, kept true). Rows that repeat an id count as rows in n_links
    and are one node of the components. Other columns are ignored; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    id_type, id_kind = to_arrow_type(kind), kind.simpleString()
    repeats = repetitions(similarity=similarity)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    profile = pa.schema([("id", id_type), ("n", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64())), ("choice", pa.list_(pa.int32()))])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            where, token = token_sets(data, offsets)
            n, one, two = signatures(where, token, rows.num_rows)
            marks = sketch(where, token, rows.num_rows)
            lists = []
            for row, value in (chosen_paths(where, token, n, repeats), chosen_tokens(where, token, n)):
                edge = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(value)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two), pa.array([x.tobytes() for x in marks], pa.binary()), *lists], schema=profile)

    found = stored(texts.mapInArrow(profiles, f"id {id_kind}, n int, one long, two long, sketch binary, paths array<long>, choice array<int>").withColumn("row", F.monotonically_increasing_id()), "profiles")
    usable = found.where("n > 0 and id is not null")
    # The row that stands for its class: the least id, and of rows that repeat it one.
    sizes = usable.groupBy("one", "two", "n").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").cast("int").alias("weight"))
    classes = usable.join(sizes.select(F.col("first.row").alias("row"), "weight"), "row").select(F.col("id").alias("rep"), "weight", "one", "two", "n", "sketch", "paths", "choice")
    classes = stored(classes, "classes")
    settle(docs.sparkSession)
    child = pa.schema([("rep", id_type), ("path", pa.int64()), ("above", pa.int32())])

    def below(level: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    rows = batch.slice(start, 1024)
                    given, choice = rows.column("given"), rows.column("choice")
                    row = np.repeat(np.arange(rows.num_rows), np.diff(given.offsets.to_numpy()))
                    parent, path = next_paths(row, given.flatten().to_numpy(), choice.flatten().to_numpy(), np.diff(choice.offsets.to_numpy()), rows.column("n").to_numpy(), level)
                    yield pa.RecordBatch.from_arrays([rows.column("rep").take(pa.array(row[parent])), pa.array(path), rows.column("above").flatten().take(pa.array(parent))], schema=child)

        return step

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketches")
            marks, edge = raw_bytes(lists.flatten())[0].reshape(-1, PARTS), lists.offsets.to_numpy()
            edge = edge - edge[0]
            kept = [keeps_together(marks[a:b], similarity) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"]).filter(pa.array(kept))

    # Small buckets of each level; a large one goes on with the paths below it, unless those above did not split it. Of
    # buckets with the same rows one is kept.
    here = classes.select("rep", F.explode("paths").alias("path"), F.lit(None).cast("int").alias("above"))
    members = None
    for level in range(1, DEPTH + 1):
        sizes = here.groupBy("path").agg(F.count("*").cast("int").alias("size"), F.min("above").alias("above"), F.bit_xor(F.xxhash64("rep")).alias("rows")).where("size > 1")
        done = (F.col("size") <= SMALL) | F.coalesce(F.col("size") > F.col("above") * DENSE, F.lit(False)) | F.lit(level == DEPTH)
        sizes = stored(sizes.withColumn("done", done), "bucket-sizes")
        large = sizes.where("not done").select("path", "size")
        if large.limit(1).count():
            looked = here.select("rep", "path").join(large, "path").where(F.xxhash64("path", "rep") / F.lit(2.0**64) + 0.5 < F.lit(LOOKED_AT) / F.col("size"))
            looked = classes.select("rep", "sketch").join(looked, "rep").groupBy("path").agg(F.collect_list("sketch").alias("sketches"))
            dense = looked.mapInArrow(together, "path long").withColumn("dense", F.lit(True))
            sizes = sizes.join(dense, "path", "left").withColumn("done", F.col("done") | F.coalesce("dense", F.lit(False))).drop("dense")
            sizes = stored(sizes, "bucket-sizes-told")
        once = sizes.where("done").groupBy("size", "rows").agg(F.min("path").alias("path")).select("path", "size")
        final = here.select("rep", "path").join(once, "path").select("rep", "path", "size")
        members = final if members is None else members.union(final)
        split = sizes.where("not done").select("path", "size")
        if not split.limit(1).count():
            break
        wide = here.select("rep", "path").join(split, "path").groupBy("rep").agg(F.collect_list("path").alias("given"), F.collect_list("size").alias("above"))
        wide = classes.select("rep", "n", "choice").join(wide, "rep")
        here = stored(wide.mapInArrow(below(level + 1), f"rep {id_kind}, path long, above int"), "paths-below")
    by_rep = members.groupBy("rep").agg(F.collect_set(F.struct("path", "size")).alias("buckets"))
    known = classes.select("rep", "weight", "n", "one", "two", "sketch").join(by_rep, "rep").withColumn("every", F.sort_array("buckets.path"))
    placed = known.withColumn("bucket", F.explode("buckets")).select("rep", "n", "sketch", "every", "bucket.path", F.when(F.col("bucket.size") > SMALL, F.ceil(F.col("bucket.size") / BLOCK)).otherwise(1).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("low"), F.greatest(b, F.col("block")).alias("high")))
    keys = ["path", "low", "high"]
    dealt = placed.withColumn("pair", F.explode(pairs)).select("path", "pair.low", "pair.high", "block", "rep", "n", "sketch", "every")

    survivor = pa.schema([("rep", id_type), ("path", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32())])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            hit = np.zeros(len(table), bool)
            for i, j in candidate_pairs(table, similarity):
                hit[i] = hit[j] = True
            kept = table.filter(pa.array(hit)).select(survivor.names).combine_chunks()
            yield from kept.cast(survivor).to_batches()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(survivors, f"rep {id_kind}, path long, low int, high int, block int")
    asked = stored(asked, "survivors").groupBy("rep").agg(F.collect_list(F.struct("path", "low", "high", "block")).alias("asked"))
    asked = known.drop("buckets").join(asked, "rep")

    member = pa.schema([("path", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("rep", id_type), ("weight", pa.int32()), ("n", pa.int32()), ("sketch", pa.binary()), ("every", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            where, token = token_sets(data, offsets)
            n, one, two = signatures(where, token, rows.num_rows)
            # An id may stand for other texts as well; take the text of the class.
            mine = (one == rows.column("one").to_numpy()) & (two == rows.column("two").to_numpy())
            edge = np.cumsum(n) - n
            sets = [token[a : a + k].tobytes() if ok else b"" for a, k, ok in zip(edge.tolist(), n.tolist(), mine.tolist(), strict=True)]
            lists = rows.column("asked")
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(rows.num_rows), counts)
            flat = lists.flatten()
            at = pa.array(row)
            out = [*(flat.field(k) for k in ("path", "low", "high", "block")), *(rows.column(k).take(at) for k in ("rep", "weight", "n", "sketch", "every")), pa.array(sets, pa.binary()).take(at)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, member, strict=True)], schema=member).filter(pa.array(mine[row]))

    whole = texts.join(asked, texts["id"] == asked["rep"]).drop("id")
    whole = whole.mapInArrow(with_tokens, f"path long, low int, high int, block int, rep {id_kind}, weight int, n int, sketch binary, every array<long>, tokens binary")
    link = pa.schema([("rep", id_type), ("links", pa.int64()), ("root", id_type)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            n, weight = table["n"].to_numpy().astype(np.int64), table["weight"].to_numpy().astype(np.int64)
            data, edge = raw_bytes(table["tokens"])
            group = group_numbers(table)
            links, root = np.zeros(len(table), np.int64), np.arange(len(table))
            at, shared = -1, np.zeros((0, 0), np.float32)
            for i, j in candidate_pairs(table, similarity):
                # Pairs come by group, so each group's intersections are made once, when its first pair comes.
                for a, b in runs_of(group[i]):
                    x, y = i[a:b], j[a:b]
                    if group[x[0]] != at:
                        at = int(group[x[0]])
                        first, last = np.searchsorted(group, [at, at + 1])
                        shared = common_tokens([data[edge[k] : edge[k + 1]].view(np.uint64) for k in range(first, last)])
                    common = shared[x - first, y - first].astype(np.int64)
                    good = common >= similarity * (n[x] + n[y] - common) - 1e-9
                    x, y = x[good], y[good]
                    links += np.bincount(x, weight[y], len(table)).astype(np.int64) + np.bincount(y, weight[x], len(table)).astype(np.int64)
                    root = joined_roots(root, x, y)
            some = np.flatnonzero(links)
            rep = table["rep"].combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(some)).cast(id_type), pa.array(links[some]), rep.take(pa.array(root[some])).cast(id_type)], schema=link)

    links = stored(whole.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(verify, f"rep {id_kind}, links long, root {id_kind}"), "links")
    settle(docs.sparkSession)
    joined = components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    by_class = classes.select("one", "two", "n", "rep", "weight", F.col("weight").alias("w")).join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").drop("node")
    out = lookup(found.select("id", "one", "two", "n"), stored(by_class, "groups"), ["one", "two", "n"], "w", found.count(), "left")
    usable = F.col("id").isNotNull()
    component = F.when(usable, F.coalesce("component", "rep", "id"))
    return out.select(
        "id", F.when(usable, F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(usable, F.coalesce("weight", F.lit(1))).otherwise(1).alias("n_copies"), F.when(usable, F.coalesce("rep", "id")).alias("rep_id"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that with the least id.

    Rows that repeat both id and text count as copies. Rows with a null id, and rows that share an id but not the text,
    are kept as they are not told apart by links."""
    gone = near_texts(docs, id_column, text_column).where("not kept").select(F.col("id").alias("__gone")).distinct()
    left = docs.join(gone, docs[id_column] == gone["__gone"], "left_anti")
    if docs.groupBy(id_column).agg(F.count("*").alias("n")).where(F.col(id_column).isNotNull() & (F.col("n") > 1)).limit(1).count():
        left = left.where(F.col(id_column).isNotNull()).dropDuplicates([id_column, text_column]).unionByName(left.where(F.col(id_column).isNull()))
    return left
