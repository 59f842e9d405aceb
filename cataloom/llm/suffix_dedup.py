"""Exact removal of repeated byte strings: anchors, per-shard suffix arrays, cross-shard merging.

A string of ``match`` bytes is assigned to its anchor: the first of its ``GRAM``-byte grams with the least hash. Equal
strings have equal anchors at equal offsets, so only strings of anchors that occur twice can repeat, and all equal
strings meet under one anchor. Consecutive strings with one anchor form a segment. Distinct segments are dealt by
anchor to shards; each shard sorts its suffixes to depth ``match`` by Larsson-Sadakane refinement, takes common prefixes
by Kasai's rule, and finds the first place of every string. Strings of a crowded anchor, one that stands in very many
contexts, get finer anchors: the anchor with nearly all bytes of the string. An anchor that still has very many distinct
segments is dealt to several shards, whose first places are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.llm.graph import lookup
from cataloom.llm.storage import light_batches, settle, stored
from cataloom.llm.text import BASE, BASE_INVERSE, BYTE_VALUES, blocks, mix, powers, raw_bytes, utf8

MATCH, GRAM = 100, 24
#: Distinct segments of one anchor in a shard; bytes sorted at a time, where no anchor has more; bytes of a partition.
SHARD_SEGMENTS, SHARD_BYTES, PARTITION_BYTES = 2048, 1 << 20, 3 << 20
#: One text in so many tells which anchors are hot: those with more than 1/``HOT_SHARE`` of its occurrences; and which are
#: crowded: those with so many distinct segments that a shard may not hold them, and with more than 1/``CROWDED_SHARE`` of
#: the occurrences of such anchors. That only decides how occurrences are dealt, not what is found.
SAMPLED, HOT_SHARE, CROWDED_SHARE = 64, 10_000, 400_000
#: Bytes of segments that are cut out of texts at a time.
PIECE_BYTES = 1 << 20
LOW = np.uint64((1 << 31) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, crowded: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, segment hash, anchor place, first and last string start of every segment, in order.

    Places count from the start of the row. Of segments that repeat inside a row all are given. A segment whose anchor is
    among ``crowded`` (sorted hashes) is cut where strings reach a multiple of some bytes before the anchor. The strings of
    such a piece share all but a few bytes; these, with the anchor, are hashed to its anchor hash."""
    gram = min(GRAM, match)
    n = len(data)
    if n < match:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(n, BASE, "up"), out=total[1:])
    down = powers(n, BASE_INVERSE, "down")
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width, k = match - gram + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: -(width - k)], least[width - k :])
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(least)) + match <= offsets[row + 1])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    row, anchor = row[inside], (least[inside] & LOW).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    first, last = inside[cut], inside[np.concatenate([cut[1:] - 1, [len(inside) - 1]])]
    row, anchor = row[cut], anchor[cut]
    name = grams[anchor]
    if crowded is not None and len(crowded):
        step = max(1, match // 12)
        fine = crowded[np.minimum(np.searchsorted(crowded, name), len(crowded) - 1)] == name
        far, near = (anchor - first) // step, (anchor - last) // step
        count = np.where(fine, far - near + 1, 1)
        of = np.repeat(np.arange(len(count)), count)
        reach = (far[of] - np.arange(len(of)) + np.repeat(np.cumsum(count) - count, count)) * step
        row, anchor, first, last, name, fine = row[of], anchor[of], first[of], last[of], name[of], fine[of]
        first = np.where(fine, np.maximum(first, anchor - reach - step + 1), first)
        last = np.where(fine, np.minimum(last, anchor - reach), last)
        begin = (anchor - reach)[fine]
        shared = (total[begin + match - step + 1] - total[begin]) * down[begin]
        name[fine] = mix(shared + mix(name[fine]) + mix(reach[fine].astype(np.uint64) + np.uint64(1)))
    content = (total[last + match] - total[first]) * down[first]
    segment = mix(content + mix(((last - first) * 256 + (anchor - first)).astype(np.uint64)))
    base = offsets[row]
    return row, name.view(np.int64), segment.view(np.int64), anchor - base, first - base, last - base


def first_in_row(row: np.ndarray, anchor: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """True for the first of the equal segments of a row."""
    out = np.zeros(len(row), bool)
    if not len(row):
        return out
    order = np.lexsort((np.arange(len(row)), segment, row))
    same = (row[order][1:] == row[order][:-1]) & (segment[order][1:] == segment[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    out[order[np.concatenate([[True], ~same])]] = True
    return out


def suffix_order(text: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` at ``wanted``, sorted by their first ``depth`` bytes (Larsson-Sadakane refinement).

    The first sort is by eight bytes; each later round sorts the groups that are not yet single by the group of the
    suffix that starts as many bytes later, which doubles the depth. The last round only orders the wanted suffixes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.zeros(n + 1, np.int64)
    group[order] = np.cumsum(new)
    del key, sorted_key
    if depth <= 8:
        return order[np.isin(order, wanted)]
    h = 8
    heads = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([heads, [n]]))
    active = order[np.repeat(sizes > 1, sizes)]
    group[:n] = (heads + 1)[group[:n] - 1]  # number of a group: one more than the place of its head
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    while h < depth and len(active):
        step = min(h, depth - h)
        if h + step >= depth:
            active = active[is_wanted[active]]
            if not len(active):
                break
        pair = (group[active] << 32) | group[np.minimum(active + step, n)]
        at = np.argsort(pair)
        active, pair = active[at], pair[at]
        old, head = pair >> 32, np.concatenate([[True], pair[1:] != pair[:-1]])
        start = np.concatenate([[True], old[1:] != old[:-1]])
        place = np.arange(len(active))
        group[active] = old + (place[head][np.cumsum(head) - 1] - place[start][np.cumsum(start) - 1])
        sizes = np.diff(np.concatenate([np.flatnonzero(head), [len(active)]]))
        active = active[np.repeat(sizes > 1, sizes)]
        h += step
    return wanted[np.argsort(group[wanted], kind="stable")]


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each suffix in ``order`` with the one before it, by Kasai's rule.

    ``starts`` and ``lengths`` give runs of consecutive suffixes in the text. The runs advance side by side: from one
    suffix of a run to the next a common prefix shrinks by one at most, so it is only extended, not compared afresh."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.full(n + 1, n, np.int64)
    rank[order] = np.arange(len(order))
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    out = np.zeros(n, np.int16)
    run = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[run], lengths[run]
    known = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        p = starts[:live] + t
        q = before[p]
        length = np.maximum(known[:live], 0)
        todo = np.flatnonzero((q >= 0) & (length < depth))
        length[q < 0] = 0
        while len(todo):
            same = padded[p[todo] + length[todo]] == padded[q[todo] + length[todo]]
            todo = todo[same]
            length[todo] += 1
            todo = todo[length[todo] < depth]
        out[p] = length
        # The rule holds where the successor of the earlier suffix is sorted before that of the later one, which ties
        # at the full depth and the last suffix of a run (it has no sorted successor) do not promise.
        known = np.where((q >= 0) & (rank[q + 1] < rank[p + 1]), length - 1, 0)
    return out[order]


def _ids(spark, df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType), df.schema[column].dataType.simpleString()


def _keyed(docs: DataFrame, id_column: str, text_column: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with a unique sortable ``id`` each, and the distinct of them.

    Ids that are null or repeated get a text key from the id and a hash of the text; rows that repeat both are one."""
    rows = docs.select(F.col(id_column).alias("given"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.struct(F.lit(True).alias("given"), *carry).alias("carried"))
    odd = docs.groupBy(id_column).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_column).isNull()).limit(1).count()
    if not odd:
        rows = rows.withColumn("id", F.col("given"))
        return rows, rows.select("id", "text")
    number = F.lpad((F.col("given").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0") if dict(rows.dtypes)["given"] in ("bigint", "int", "smallint", "tinyint") else F.col("given").cast("string")
    rows = rows.withColumn("id", F.concat(F.coalesce(number, F.lit("")), F.lit(" "), F.substring(F.sha2("text", 256), 1, 20)))
    return rows, rows.select("id", "text").dropDuplicates(["id"])


def occurrences(texts: DataFrame, match: int, crowded: np.ndarray | None = None) -> DataFrame:
    """(anchor, segment, id, place) of every segment of rows (id, text); of those that repeat inside a row the first."""
    arrow_id, id_kind = _ids(texts.sparkSession, texts, "id")
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("id", arrow_id), ("place", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            row, anchor, segment, place, first, last = segments(data, offsets, match, crowded)
            keep = np.flatnonzero(first_in_row(row, anchor, segment))
            packed = (place[keep] << 14) | ((place - first)[keep] << 7) | (place - last)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(segment[keep]), rows.column("id").take(pa.array(row[keep])), pa.array(packed)], schema=schema)

    return texts.mapInArrow(found, f"anchor long, segment long, id {id_kind}, place long")


def crowded_anchors(sample: DataFrame, match: int = MATCH) -> np.ndarray:
    """Sorted hashes of the anchors that stand in very many contexts, told from sampled rows (id, text): fewer than
    ``CROWDED_SHARE``. Those whose contexts often repeat, as in near copies, are left: finer anchors would only add rows."""
    by_segment = occurrences(sample, match).groupBy("anchor", "segment").agg(F.count("*").alias("n"))
    by_anchor = by_segment.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
    found = stored(by_anchor.where((F.col("distinct") > SHARD_SEGMENTS * 3 // 4 // SAMPLED) & (F.col("distinct") * 4 > F.col("n") * 3)), "crowded")
    found = found.where(F.col("n") * CROWDED_SHARE > F.lit(found.agg(F.sum("n")).first()[0] or 0))
    return np.sort(found.select("anchor").toArrow()["anchor"].to_numpy().view(np.uint64))


def repeated_ranges(texts: DataFrame, sample: DataFrame, crowded: np.ndarray, match: int = MATCH) -> DataFrame:
    """(id, ranges): for rows (unique id, text), byte ranges [from, to) that are covered by strings of ``match`` bytes
    found earlier in another row or place. Segments that repeat inside one row are left to the reader of the row.
    ``sample`` has some of the rows, ``crowded`` the anchors whose segments are cut into finer ones."""
    spark = texts.sparkSession
    arrow_id, id_kind = _ids(spark, texts, "id")
    every = occurrences(texts, match, crowded)
    sample = occurrences(sample, match, crowded).groupBy("anchor").agg(F.count("*").alias("n"))
    sample = stored(sample.where("n > 3"), "anchors")
    hot = sample.where(F.col("n") * HOT_SHARE > F.lit(sample.agg(F.sum("n")).first()[0] or 0)).select("anchor")
    is_lead = (F.col("lead.id") == F.col("id")) & (F.col("lead.place") == F.col("place"))
    only = lambda c: F.when(F.col("leads"), F.col(c)).alias(c)
    columns = ["id", "place", "leads", only("anchor"), only("segment"), only("distinct")]
    # Anchors with few occurrences meet in one task; hot ones are aggregated by segment first and looked up.
    same, all_ = Window.partitionBy("anchor", "segment"), Window.partitionBy("anchor")
    cold = every.join(F.broadcast(hot), "anchor", "left_anti").repartition("anchor").withColumn("lead", F.min(F.struct("id", "place")).over(same)).withColumn("leads", is_lead).drop("lead")
    cold = cold.withColumn("n", F.count("*").over(all_)).withColumn("distinct", F.sum(F.col("leads").cast("int")).over(all_)).where("n > 1").select(*columns)
    if hot.limit(1).count():
        warm = stored(every.join(F.broadcast(hot), "anchor", "left_semi"), "hot-occurrences")
        by_segment = warm.groupBy("anchor", "segment").agg(F.min(F.struct("id", "place")).alias("lead"), F.count("*").alias("n"))
        by_anchor = by_segment.groupBy("anchor").agg(F.sum("n").alias("of_anchor"), F.count("*").alias("distinct"))
        by_segment = by_segment.join(F.broadcast(by_anchor), "anchor").where("of_anchor > 1").drop("of_anchor")
        cold = cold.unionByName(lookup(warm, by_segment, ["anchor", "segment"], "n", warm.count()).withColumn("leads", is_lead).select(*columns))
    seen = stored(cold, "occurrences")

    # The bytes of the leading segments: one row a distinct segment.
    leads = seen.where("leads")
    per_shard = F.ceil(F.col("distinct") / SHARD_SEGMENTS).cast("int")
    leads = leads.withColumn("part", F.pmod(F.col("segment"), per_shard).cast("int")).withColumn("parts", per_shard)
    asked = leads.groupBy("id").agg(F.collect_list(F.struct("place", "anchor", "part", "parts")).alias("asked"))
    piece = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("id", arrow_id), ("place", pa.int64()), ("bytes", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("asked")
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            place = flat.field("place").to_numpy()
            start = offsets[row] + (place >> 14) - ((place >> 7) & 127)
            size = ((place >> 7) & 127) - (place & 127) + match
            reach = np.concatenate([[0], np.cumsum(size)])
            low = 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(reach, reach[low] + PIECE_BYTES, side="right")) - 1)
                ends = reach[low + 1 : high + 1] - reach[low]
                body = data[np.arange(ends[-1]) + np.repeat(start[low:high] - (ends - size[low:high]), size[low:high])]
                made = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(body)])
                part = flat.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.field("anchor"), part.field("part"), part.field("parts"), batch.column("id").take(pa.array(row[low:high])), part.field("place"), made], schema=piece)
                low = high

    found = texts.join(asked, "id").mapInArrow(pieces, f"anchor long, part int, parts int, id {id_kind}, place long, bytes binary")
    shards = max(8, leads.count() * 140 // PARTITION_BYTES + 1)
    settle(spark)
    found = found.repartition(shards, F.xxhash64("anchor", "part"))
    result = pa.schema([("id", arrow_id), ("from", pa.int32()), ("to", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("part", pa.int32())])

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        key = np.stack([table["anchor"].to_numpy(), table["part"].to_numpy().astype(np.int64)])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        sizes = np.diff(raw_bytes(table["bytes"])[1])[order]
        change = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        # Whole anchors, as many as fit.
        reach = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([change[1:], [len(order)]])
        start = 0
        while start < len(order):
            fit = ends[ends > start]
            end = int(fit[max(0, int(np.searchsorted(reach[fit], reach[start] + SHARD_BYTES, side="right")) - 1)])
            yield one_shard(table.take(pa.array(order[start:end])), match, result)
            pa.default_memory_pool().release_unused()
            start = end

    sorted_ = stored(found.mapInArrow(sort_shard, f"id {id_kind}, from int, to int, w1 long, w2 long, part int"), "suffixes")
    split = sorted_.where("w1 is not null")
    merging = split.limit(1).count() > 0
    settle(spark)
    whole = seen.where("not leads").select("id", (F.shiftright("place", 14) - F.shiftright("place", 7).bitwiseAND(F.lit(127))).cast("int").alias("from"), (F.shiftright("place", 14) - F.col("place").bitwiseAND(F.lit(127)) + match).cast("int").alias("to"))
    ranges = sorted_.where("w1 is null").select("id", "from", "to").union(whole)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield merged(pa.Table.from_batches(held).combine_chunks(), pa.schema([result.field(k) for k in range(3)]))

    if merging:
        ranges = ranges.union(split.repartition("w1").mapInArrow(merge, f"id {id_kind}, from int, to int"))
    return ranges.groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def _rank(ids: pa.Array) -> np.ndarray:
    """Each id's place among the distinct ids in order."""
    values = ids.to_pandas().to_numpy()
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def one_shard(table: pa.Table, match: int, schema: pa.Schema) -> pa.RecordBatch:
    """Ranges of the strings that are not the first of their kind in the shard; for anchors in several shards also the
    first strings themselves, with two hashes."""
    table = table.combine_chunks()
    place, parts, part = (table[c].to_numpy() for c in ("place", "parts", "part"))
    ids = table["id"].combine_chunks()
    text, offsets = raw_bytes(table["bytes"])
    runs = np.diff(offsets) - match + 1
    ends = np.cumsum(runs)
    segment = np.repeat(np.arange(len(runs)), runs)
    shift = np.arange(ends[-1]) - np.repeat(ends - runs, runs)
    wanted = offsets[segment] + shift
    order = suffix_order(text, match, wanted)
    prefix = common_prefixes(text, order, offsets[:-1], runs, match)
    heads = np.flatnonzero(np.concatenate([[True], prefix[1:] < match]))
    number = np.empty(len(text), np.int64)
    number[wanted] = np.arange(len(wanted))
    start = ((place >> 14) - ((place >> 7) & 127))[segment] + shift
    seniority = (_rank(ids)[segment] << 31) | start
    of_order = number[order]
    first = np.minimum.reduceat(seniority[of_order], heads)
    sizes = np.diff(np.concatenate([heads, [len(order)]]))
    later = np.zeros(len(wanted), bool)
    later[of_order] = seniority[of_order] != np.repeat(first, sizes)
    # Runs of removed strings of a segment.
    flag = np.flatnonzero(later)
    cut = np.concatenate([[True], (np.diff(flag) != 1) | (segment[flag][1:] != segment[flag][:-1])]) if len(flag) else np.zeros(0, bool)
    a = flag[cut]
    b = flag[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(flag) - 1]])] if len(flag) else a
    owner, low, high = segment[a], start[a], start[b] + match
    w1, w2, of_part = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), part[segment[a]]
    none = np.ones(len(a), bool)
    share = np.flatnonzero(~later & (parts[segment] > 1))
    if len(share):
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[text] * powers(len(text), BASE, "up"), out=total[1:])
        at = wanted[share]
        value = (total[at + match] - total[at]) * powers(len(text), BASE_INVERSE, "down")[at]
        second = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(BYTE_VALUES)[text] * powers(len(text), BASE, "up"), out=second[1:])
        value2 = (second[at + match] - second[at]) * powers(len(text), BASE_INVERSE, "down")[at]
        owner, low, high = np.concatenate([owner, segment[share]]), np.concatenate([low, start[share]]), np.concatenate([high, start[share] + match])
        w1, w2 = np.concatenate([w1, mix(value).view(np.int64)]), np.concatenate([w2, mix(value2).view(np.int64)])
        of_part, none = np.concatenate([of_part, part[segment[share]]]), np.concatenate([none, np.zeros(len(share), bool)])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(w1, mask=none), pa.array(w2, mask=none), pa.array(of_part.astype(np.int32))], schema=schema)


def merged(table: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """Merge the first strings of several shards, two and two: the sorted hashes of one are searched in those of the
    other, and of two equal strings the later place is removed."""
    w1, w2, part = (table[c].to_numpy() for c in ("w1", "w2", "part"))
    ids = table["id"].combine_chunks()
    seniority = (_rank(ids) << 31) | table["from"].to_numpy().astype(np.int64)
    removed = np.zeros(len(w1), bool)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.searchsorted(w1[a], w1[b])
        # Equal first hashes are rare beyond equal strings; step over those with another second hash.
        while True:
            met = a[np.minimum(at, len(a) - 1)]
            same = (at < len(a)) & (w1[met] == w1[b])
            behind = same & (w2[met] < w2[b])
            if not behind.any():
                break
            at = at + behind
        same &= w2[met] == w2[b]
        old, new = met[same], b[same]
        later = seniority[new] > seniority[old]
        removed[np.where(later, new, old)] = True
        a[at[same]] = np.where(later, old, new)
        return np.insert(a, at[~same], b[~same])

    order = np.lexsort((w2, w1, part))
    runs = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    while len(runs) > 1:
        runs = [joined(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    out = np.flatnonzero(removed)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(out)), table["from"].combine_chunks().take(pa.array(out)), table["to"].combine_chunks().take(pa.array(out))], schema=schema)


def removed_bytes(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """True for each byte inside a range."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, np.minimum(low, size), 1)
    np.add.at(steps, np.minimum(high, size), -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, match: int = MATCH, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the columns ``carry``.

    A byte goes if a string of ``match`` bytes that covers it also starts earlier: in a row with a smaller id, or at a
    smaller place of the same row. ``kept_sha256`` is of the remaining bytes; ``kept_text`` is the remaining text, where
    a character stays whole if any of its bytes stays. Null text counts as empty: no bytes, nothing removed, the hash of
    no bytes. Texts shorter than ``match`` lose nothing. Rows whose id is null (first in order) or repeated are told
    apart by a hash of the text, in that order; rows that repeat id and text count once and each get the result.
    Matching runs on the input texts whole. Other columns are ignored; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    carry = carry or []
    rows, texts = _keyed(docs, id_column, text_column, carry)
    sample = stored(texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0), "sample")
    crowded = crowded_anchors(sample, match)
    ranges = repeated_ranges(texts, sample, crowded, match)
    arrow_given, given_kind = _ids(docs.sparkSession, rows, "given")
    schema = pa.schema([("id", arrow_given), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("carried", to_arrow_type(rows.schema["carried"].dataType))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "text"):
            row, anchor, segment, place, first, last = segments(data, offsets, match, crowded)
            again = ~first_in_row(row, anchor, segment)
            lists = part.column("ranges")
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            base = np.repeat(offsets[:-1], counts)
            low = np.concatenate([flat.field("from").to_numpy() + base, first[again] + offsets[row[again]]])
            high = np.concatenate([flat.field("to").to_numpy() + base, last[again] + match + offsets[row[again]]])
            gone = removed_bytes(len(data), low, high)
            out: list[list] = [[], [], [], [], []]
            inner = (data & 0xC0) == 0x80
            for k in range(part.num_rows):
                s, e = int(offsets[k]), int(offsets[k + 1])
                g = gone[s:e]
                if g.any():
                    kept = data[s:e][~g]
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0])
                    heads = np.cumsum(~inner[s:e]) - 1
                    whole = np.zeros(int(heads[-1]) + 1, bool)
                    whole[heads[~g]] = True
                    text = data[s:e][whole[heads]].tobytes().decode("utf-8", "replace")
                    out[1].append(int(g.sum()))
                    out[2].append(spans)
                    out[3].append(hashlib.sha256(kept.tobytes()).hexdigest())
                else:
                    raw = data[s:e].tobytes()
                    text = raw.decode("utf-8", "replace")
                    out[1].append(0)
                    out[2].append(0)
                    out[3].append(hashlib.sha256(raw).hexdigest())
                out[0].append(e - s)
                out[4].append(text)
            yield pa.RecordBatch.from_arrays([part.column("given"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:6], strict=True)), part.column("carried")], schema=schema)

    empty = F.array().cast("array<struct<from:int,to:int>>")
    joined = rows.join(ranges, "id", "left").select("given", "text", "carried", F.coalesce("ranges", empty).alias("ranges"))
    kinds = f"id {given_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, carried {rows.schema['carried'].dataType.simpleString()}"
    return joined.mapInArrow(apply, kinds).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *(F.col("carried")[c].alias(c) for c in carry))
