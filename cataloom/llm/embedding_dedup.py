"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

The vectors of a label are placed in the cells of their nearest centres and compared within cells. How many cells a
vector takes is measured for the centres on vectors that had no part in fitting them: so many that two vectors exactly at
the threshold share one with the target recall. The number of cells grows with the vectors, that of cells a vector takes
much more slowly, so no step compares all pairs of a label. A label that fits one cell is compared whole, without any loss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.graph import components, lookup
from cataloom.llm.storage import discard, settle, stored
from cataloom.llm.text import raw_bytes

THRESHOLD = 0.93
#: Distinct vectors of a label for each cell, in expectation, and most cells of a label (from 8.4 million vectors on cells
#: grow instead; they are compared in blocks).
CELL_ROWS, MAX_CELLS = 1024, 8192
#: k-means is fitted for each label on at most so many vectors (by least hash), so that a cell gets 16 or more; rounds.
FIT_ROWS, ITERATIONS = 131_072, 8
#: Share of pairs at the threshold that share a cell; pairs that are made to measure it, from vectors left out of fitting.
TARGET_RECALL, TRIAL_PAIRS = 0.999, 4096
#: A cell is compared in blocks of so many vectors, and so many products are held at a time; vectors placed at a time.
BLOCK, TILE, PLACED = 8192, 1 << 20, 16_384


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1; none may be zero."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def slices(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows, so that rows times ``width`` stays within ``TILE``."""
    step = max(1, TILE // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ITERATIONS) -> np.ndarray:
    """k unit centres for unit rows in random order: the first rows, then assign and renormalise."""
    c = x[:k].copy()
    for _ in range(rounds if k > 1 else 1):
        home = np.concatenate([np.argmax(x[s] @ c.T, axis=1) for s in slices(len(x), k)])
        order = np.argsort(home, kind="stable")
        heads = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums = np.add.reduceat(x[order], heads, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        c[home[order][heads[full]]] = sums[full] / norms[full][:, None]
    return c


def cells_needed(x: np.ndarray, c: np.ndarray, threshold: float) -> int:
    """How many of the nearest cells two vectors must take to share one with ``TARGET_RECALL``.

    Measured on pairs at exactly the threshold: the rows of ``x``, none of which the centres may be fitted on (they would
    sit on their own centres), and each turned by that angle in a random direction of their own spread."""
    if len(c) == 1:
        return 1
    rng = np.random.default_rng(len(x))
    a = x
    values, axes = np.linalg.eigh(np.cov(x.T) + 1e-12 * np.eye(x.shape[1]))
    turn = (rng.normal(size=a.shape) * np.sqrt(np.maximum(values, 0))) @ axes.T
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold * threshold)) * turn
    place = np.arange(len(c))
    needed = []
    for s in slices(len(a), 4 * len(c)):
        ranks = []
        for y in (a[s], b[s]):
            order = np.argsort(-(y @ c.T), axis=1)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, place[None], axis=1)
            ranks.append(rank)
        needed.append(np.maximum(*ranks).min(axis=1) + 1)
    return int(np.quantile(np.concatenate(needed), TARGET_RECALL, method="higher"))


def fit_cells(x: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, int]:
    """Centres for ``n`` vectors of which the unit rows ``x`` are a random part, in random order, and how many cells a
    vector takes. Some rows are kept from fitting to measure that."""
    trial = min(TRIAL_PAIRS, len(x) // 2)
    fitted = x[trial:].astype(np.float32)
    c = spherical_kmeans(fitted, int(min(MAX_CELLS, -(-n // CELL_ROWS), max(1, len(fitted) // 8))))
    return c, cells_needed(x[:trial], c, threshold)


def first_shared(cells: np.ndarray, cell: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ``cell`` is the least cell that both rows of a pair are in. Rows of ``cells`` are in order."""
    out = np.ones(len(i), bool)
    for k in range(cells.shape[1]):
        mine = cells[i, k]
        early = np.flatnonzero(mine < cell)
        out[early[(cells[j[early]] == mine[early][:, None]).any(axis=1)]] = False
    return out


def joined_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the least row of each row's group so far) after joining the groups of each pair."""
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for x in (i, j, root[i], root[j]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_in(x: np.ndarray, weight: np.ndarray, cells: np.ndarray, cell: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted) and root of each row, by the pairs of ``left`` and ``right`` (both the same: each pair once)."""
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    same = left is right
    for s in slices(len(left), len(right)):
        rows = left[s]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        i, j = rows[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        keep = first_shared(cells, cell, i, j)
        i, j = i[keep], j[keep]
        links += np.bincount(i, weight[j], len(x)).astype(np.int64) + np.bincount(j, weight[i], len(x)).astype(np.int64)
        # Pairs within one group so far tell nothing new.
        new = root[i] != root[j]
        root = joined_roots(root, i[new], j[new])
    return links, root


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and their cosine in double precision is at least
    ``threshold``; no other pair is. A label with at most ``CELL_ROWS`` distinct vectors is compared whole; in a larger
    one a pair at the threshold is found with about ``TARGET_RECALL``, closer pairs more surely. A vector that is null,
    empty, zero or has a null or non-finite component has no links; vectors of unlike lengths are not compared. Equal
    vectors of a label are one class, compared once with its number of rows. Rows that repeat an id are rows of their own
    in n_links and share a component. n_links counts linked rows; component_id is the least id reachable, itself
    included (null ids count as no id); kept says whether that is the row's own id. Other columns are ignored; an empty
    table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = vectors.sparkSession
    id_type, label_type = vectors.schema[id_column].dataType, vectors.schema[label_column].dataType
    component = getattr(vectors.schema[vector_column].dataType, "elementType", None)
    number = np.dtype(np.float32 if component is not None and component.simpleString() == "float" else np.float64)
    given = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast(f"array<{'float' if number.itemsize == 4 else 'double'}>").alias("v"))
    packed = pa.schema([("id", to_arrow_type(id_type)), ("label", to_arrow_type(label_type)), ("k", pa.binary()), ("dims", pa.int32()), ("v", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that can have links as bytes with a digest."""
        for batch in batches:
            lists = batch.column("v")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(number) + number.type(0)
            ends = np.cumsum(counts)
            good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            usable = (counts > 0) & (good[ends] - good[ends - counts] == counts) & (some[ends] > some[ends - counts]) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            body = [flat[a:b].tobytes() if ok else None for a, b, ok in zip((ends - counts).tolist(), ends.tolist(), usable.tolist(), strict=True)]
            key = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in body]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(key, pa.binary()), pa.array(counts.astype(np.int32)), pa.array(body, pa.binary())], schema=packed)

    id_kind, label_kind = id_type.simpleString(), label_type.simpleString()
    rows = stored(given.mapInArrow(pack, f"id {id_kind}, label {label_kind}, k binary, dims int, v binary"), "vectors")
    # A class: equal vectors of one label, with the least id and the number of rows.
    classes = rows.where("v is not null").groupBy("label", "dims", "k").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    counts = classes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    head = F.conv(F.hex(F.substring("k", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    parts = F.ceil(F.col("n") / PLACED).cast("int")
    known = classes.join(F.broadcast(counts), ["label", "dims"]) if counts.count() <= 100_000 else classes.join(counts, ["label", "dims"])
    known = known.withColumn("part", F.pmod(F.xxhash64("k"), parts).cast("int"))
    wide = known.where(F.col("n") > CELL_ROWS)
    sample = wide.where(head * F.col("n") <= FIT_ROWS + TRIAL_PAIRS)
    centre = pa.schema([("label", to_arrow_type(label_type)), ("dims", pa.int32()), ("part", pa.int32()), ("taken", pa.int32()), ("centres", pa.binary())])

    def fit(table: pa.Table) -> pa.Table:
        """Centres and cells to take of one label, a row for each part of its vectors."""
        table = table.combine_chunks()
        k = pc.sort_indices(table, sort_keys=[("k", "ascending")])[: FIT_ROWS + TRIAL_PAIRS]
        table = table.take(k).combine_chunks()
        n, dims = table["n"][0].as_py(), table["dims"][0].as_py()
        x = unit(np.frombuffer(raw_bytes(table["v"])[0], number).reshape(-1, dims))
        c, taken = fit_cells(x, n, threshold)
        out = -(-n // PLACED)
        label = table["label"].take(pa.array(np.zeros(out, np.int64)))
        return pa.Table.from_arrays([label, pa.array([dims] * out, pa.int32()), pa.array(range(out), pa.int32()), pa.array([taken] * out, pa.int32()), pa.array([c.astype(np.float32).tobytes()] * out, pa.binary())], schema=centre)

    centres = stored(sample.select("label", "dims", "n", "k", "v").groupBy("label", "dims").applyInArrow(fit, f"label {label_kind}, dims int, part int, taken int, centres binary"), "centres")
    placed = pa.schema([("label", to_arrow_type(label_type)), ("dims", pa.int32()), ("cell", pa.int32()), ("cells", pa.list_(pa.int32())), ("cid", pa.int64()), ("weight", pa.int64()), ("v", pa.binary())])

    def place(table: pa.Table, found: pa.Table) -> pa.Table:
        """A row for each cell that a vector takes."""
        if not table.num_rows:
            return placed.empty_table()
        table = table.combine_chunks()
        dims, taken = table["dims"][0].as_py(), found["taken"][0].as_py()
        x = unit(np.frombuffer(raw_bytes(table["v"])[0], number).reshape(-1, dims)).astype(np.float32)
        c = np.frombuffer(found["centres"][0].as_py(), np.float32).reshape(-1, dims)
        nearest = [np.argpartition(-(x[s] @ c.T), taken - 1, axis=1)[:, :taken] if taken < len(c) else np.tile(np.arange(len(c)), (len(x[s]), 1)) for s in slices(len(x), 4 * len(c))]
        cells = np.sort(np.concatenate(nearest).astype(np.int32), axis=1)
        at = pa.array(np.repeat(np.arange(len(x)), taken))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * taken), pa.array(cells.ravel()))
        return pa.Table.from_arrays([table["label"].take(at), table["dims"].take(at), pa.array(cells.ravel()), lists.take(at), *(table[k].take(at) for k in ("cid", "weight", "v"))], schema=placed)

    columns = ["label", "dims", "part", "cid", "weight", "v"]
    keys = ["label", "dims", "part"]
    kinds = f"label {label_kind}, dims int, cell int, cells array<int>, cid long, weight long, v binary"
    many = wide.select(*columns).groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInArrow(place, kinds)
    few = known.where(F.col("n") <= CELL_ROWS).select("label", "dims", F.lit(0).alias("cell"), F.array(F.lit(0)).alias("cells"), "cid", "weight", "v")
    members = stored(few.unionByName(many), "vector-cells")
    settle(spark)
    # Blocks of a cell: a row goes to every pair of blocks that its own block takes part in.
    sizes = members.groupBy("label", "dims", "cell").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "large-cells")
    total = members.count()
    if large.limit(1).count():
        is_large = [members[k].eqNullSafe(large[k]) for k in ("label", "dims", "cell")]
        small = members.join(large, is_large, "left_anti").withColumn("blocks", F.lit(1))
        dealt = small.unionByName(lookup(members, large, ["label", "dims", "cell"], "size", total))
    else:
        dealt = members.withColumn("blocks", F.lit(1))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("low"), F.greatest(b, F.col("block")).alias("high")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("label", "dims", "cell", "pair.low", "pair.high", "block", "cells", "cid", "weight", "v")
    link = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high, dims, cell = (table[k][0].as_py() for k in ("low", "high", "dims", "cell"))
        cid, weight, block = (table[k].to_numpy() for k in ("cid", "weight", "block"))
        order = np.argsort(cid)
        cid, weight, block = cid[order], weight[order], block[order]
        x = unit(np.frombuffer(raw_bytes(table["v"])[0], number).reshape(-1, dims)[order])
        cells = np.array(table["cells"].combine_chunks().flatten()).reshape(len(cid), -1)[order]
        left = np.flatnonzero(block == low)
        links, root = linked_in(x, weight, cells, cell, left, left if low == high else np.flatnonzero(block == high), threshold)
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[root[some]])], schema=link)

    found = stored(dealt.groupBy("label", "dims", "cell", "low", "high").applyInArrow(compare, "cid long, links long, root long"), "vector-links")
    discard(members, large, centres)
    # Classes that share an id are one node.
    shared = classes.groupBy("rep").agg(F.min("cid").alias("least"), F.count("*").alias("n")).where("n > 1 and rep is not null")
    shared = classes.join(shared, "rep").where("cid != least").select("cid", F.col("least").alias("root"))
    joined = stored(components(found.select("cid", "root").union(shared), "cid", "root"), "vector-components")
    least = joined.join(classes.select("cid", "rep"), joined["node"] == F.col("cid")).groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("w"))
    by_node = lookup(joined, least, ["component"], "w", classes.count()).select("node", "component_id")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    by_class = classes.select("label", "dims", "k", "rep", "weight", "cid").join(linked, "cid", "left").join(by_node, F.col("cid") == F.col("node"), "left")
    by_class = stored(by_class.select("label", "dims", "k", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-groups")
    given = rows.select("id", "label", "dims", "k")
    out = lookup(given.where("k is not null"), by_class, ["label", "dims", "k"], "weight", rows.count()).select("id", "n_links", "component_id")
    out = out.unionByName(given.where("k is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select("id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
