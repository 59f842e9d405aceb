"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings. Besides the labels it is fitted on pairs: a labelled
text and the same text with its identity terms swapped for others of their language and kind, or left out. The squared change of the score over a swap is
penalised, and so are differences between the terms themselves, so that a neutral mention of a group moves no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.storage import light_batches, stored
from cataloom.llm.text import BASE, BASE_INVERSE, BYTE_VALUES, blocks, folded, mix, powers, words

#: Labelled texts of each class to fit on, in expectation; features of the model at most, and the log-likelihood ratio
#: of presence and label that a feature needs (chance gives this to one in some thousand).
FIT_ROWS, FEATURES, LEAST_GAIN = 10_000, 4096, 6.0
#: Beginnings of so many bytes are features of a longer word.
BEGINNINGS = (4, 5, 6)
#: Weights of the squared norm, of a swap's squared score change, and of differences between terms.
RIDGE, SWAP_PENALTY, TERM_PENALTY, SWAPS = 1e-5, 3.0, 1e-2, 3

# Identity terms by language and kind; a term is swapped for others of its line.
TERM_LINES = """
women men girls boys
trans gay lesbian straight bisexual queer
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
black white asian african european american mexican arab
blacks whites asians africans europeans americans mexicans arabs
immigrants refugees migrants foreigners natives
disabled deaf blind elderly young old
frauen männer mädchen jungen
schwule lesben
muslime christen juden hindus buddhisten atheisten
schwarze weiße asiaten afrikaner europäer
einwanderer flüchtlinge ausländer
behinderte ältere
mujeres hombres niñas niños
gays lesbianas
musulmanes cristianos judíos hindúes budistas ateos
negros blancos asiáticos africanos europeos
inmigrantes refugiados extranjeros
discapacitados ancianos
femmes hommes filles garçons
musulmans chrétiens juifs hindous bouddhistes athées
noirs blancs asiatiques africains européens
immigrés réfugiés étrangers
handicapés vieux
"""
TERM_KINDS = [line.split() for line in TERM_LINES.strip().splitlines()]
IDENTITY_TERMS = list(dict.fromkeys(term for line in TERM_KINDS for term in line))


def swaps_of(terms: list[str] = IDENTITY_TERMS, kinds: list[list[str]] = TERM_KINDS, count: int = 0) -> list[list[int]]:
    """For each term the numbers of ``count`` (by default ``SWAPS``) others of its kind, those that follow it."""
    number = {term: k for k, term in enumerate(terms)}
    out: list[list[int]] = [[] for _ in terms]
    for line in kinds:
        for at, term in enumerate(line):
            others = [number[x] for x in (line[at + 1 :] + line[:at])[: count or SWAPS]]
            if not out[number[term]]:
                out[number[term]] = others
    return out


@dataclass
class Model:
    """Feature hashes in order with their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.features >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of known features, and their numbers."""
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.searchsorted(self.features, hashes[maybe])
        hit = (at < len(self.features)) & (self.features[np.minimum(at, len(self.features) - 1)] == hashes[maybe]) if len(self.features) else np.zeros(len(maybe), bool)
        return maybe[hit], at[hit]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and word number of every feature of a block: each word, and its beginnings of 4 to 6 bytes."""
    start, end, whole, row = words(data, offsets)
    if not len(start):
        return row, whole, np.zeros(0, np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[folded(data)] * powers(len(data), BASE, "up"), out=total[1:])
    down = powers(len(data), BASE_INVERSE, "down")
    rows, hashes, numbers = [row], [whole], [np.arange(len(start))]
    for size in BEGINNINGS:
        has = np.flatnonzero(end - start > size)
        s = start[has]
        rows.append(row[has])
        hashes.append(mix((total[s + size] - total[s]) * down[s] + np.uint64(size << 32)))
        numbers.append(has)
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(numbers)


def term_features(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return features(data, np.array([0, len(data)]))[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(text, label, weight): about ``FIT_ROWS`` texts of each class, chosen by a hash of the id; all if there are fewer.

    The chosen labels are few whatever the input, so they are broadcast and the texts are read in place. A null label is
    no label; any label above 0 counts as 1."""
    given = labels.select(F.col(id_column).alias("id"), (F.col(label_column) > 0).cast("int").alias("label")).where("id is not null and label is not null")
    sizes = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, FIT_ROWS / max(1, sizes.get(k, 0))))])
    chosen = given.where((F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("label")]).withColumn("weight", 1 / share[F.col("label")])
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label", "weight")


def train(sample: DataFrame) -> Model | None:
    """Fit the model on a bounded sample (id, text, label, weight); None if it is empty."""
    light_batches(sample.sparkSession)
    sample = stored(sample, "labelled")
    sizes = {r["label"]: (r["n"], r["w"]) for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if not sizes:
        return None
    counted = pa.schema([("feature", pa.int64()), ("zero", pa.int64()), ("one", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text", 1 << 20):
            row, hashes, _ = features(data, offsets)
            if not len(row):
                continue
            label = rows.column("label").to_numpy(zero_copy_only=False)
            order = np.lexsort((row, hashes))
            row, hashes = row[order], hashes[order]
            once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
            row, hashes = row[once], hashes[once]
            head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            one = np.add.reduceat(label[row].astype(np.int64), head)
            n = np.diff(np.concatenate([head, [len(hashes)]]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[head].view(np.int64)), pa.array(n - one), pa.array(one)], schema=counted)

    n0, n1 = (max(1, sizes.get(k, (0, 0))[0]) for k in (0, 1))
    counts = sample.mapInArrow(count, "feature long, zero long, one long").groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    # Likelihood ratio of a feature's presence and the label.
    a, b = F.col("one").cast("double"), F.col("zero").cast("double")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    share = (a + b) / float(n0 + n1)
    gain = part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0)
    best = counts.where("one + zero >= 3").withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").toPandas()
    terms = [term_features(t) for t in IDENTITY_TERMS]
    known = np.unique(np.concatenate([best["feature"].to_numpy().astype(np.int64).view(np.uint64), *terms]))
    table = Model(known, np.zeros(len(known)), 0.0)
    term_words = np.array([t[0] for t in terms])
    shared = sample.sparkSession.sparkContext.broadcast((table, np.sort(term_words), np.argsort(term_words), [table.find(t)[1] for t in terms], swaps_of()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sorted_terms, which, numbers, partners = shared.value
        for rows, data, offsets in blocks(batches, "text", 1 << 20):
            row, hashes, word = features(data, offsets)
            at, number = table.find(hashes)
            row, word, hashes = row[at], word[at], hashes[at]
            lists, swaps = [], []
            place = np.minimum(np.searchsorted(sorted_terms, hashes), len(sorted_terms) - 1)
            term = np.where(sorted_terms[place] == hashes, which[place], -1)
            order = np.argsort(row, kind="stable")
            reach = np.searchsorted(row[order], np.arange(rows.num_rows + 1))
            for k in range(rows.num_rows):
                mine = order[reach[k] : reach[k + 1]]
                lists.append(np.unique(number[mine]).astype(np.int32))
                own = mine[term[mine] >= 0]
                changed = []
                if len(own):
                    rest = mine[~np.isin(word[mine], word[own])]
                    # The sentence without its terms is a counterfactual as well: a mention as such moves no score.
                    changed.append(np.unique(number[rest]).astype(np.int32).tolist())
                    for step in range(max(len(partners[t]) for t in term[own])):
                        # A kind with fewer terms gives the same swap again.
                        other = [numbers[partners[t][step % len(partners[t])]] for t in term[own]]
                        changed.append(np.unique(np.concatenate([number[rest], *other])).astype(np.int32).tolist())
                swaps.append(changed)
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("weight"), pa.array(lists, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["label", "weight", "present", "swapped"])

    rows = sample.mapInArrow(vectors, "label int, weight double, present array<int>, swapped array<array<int>>").toArrow()
    weights, intercept = fit(rows, len(known), [table.find(t)[1] for t in terms])
    return Model(known, weights, intercept)


def fit(rows: pa.Table, size: int, terms: list[np.ndarray], rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic model, by gradient steps with momentum (Adam)."""
    y = rows["label"].to_numpy().astype(np.float64)
    share = rows["weight"].to_numpy()
    share = share / share.sum()
    present = rows["present"].to_pylist()
    n = len(present)
    index = np.array([j for p in present for j in p], np.int64)
    owner = np.repeat(np.arange(n), [len(p) for p in present])
    # Pairs: the row, and the row with other terms; only the difference matters.
    pairs = [(k, other) for k, some in enumerate(rows["swapped"].to_pylist()) for other in some]
    change_index = np.array([j for k, other in pairs for j in (*present[k], *other)], np.int64)
    change_sign = np.array([s for k, other in pairs for s in (*[1.0] * len(present[k]), *[-1.0] * len(other))])
    change_owner = np.repeat(np.arange(len(pairs)), [len(present[k]) + len(other) for k, other in pairs]) if pairs else np.zeros(0, np.int64)
    pair_row = np.array([k for k, _ in pairs], np.int64)
    term_matrix = np.zeros((len(terms), size))
    for k, some in enumerate(terms):
        term_matrix[k, some] = 1
    w, bias = np.zeros(size), float(np.log((share @ y + 1e-6) / (1 - share @ y + 1e-6)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[index], n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = share * (p - y)
        gradient = np.bincount(index, slope[owner], size) + 2 * RIDGE * w
        bias_gradient = slope.sum()
        if len(pairs):
            # Score change of a swap: s(x) - s(x').
            delta = np.bincount(change_owner, w[change_index] * change_sign, len(pairs))
            q = 1 / (1 + np.exp(-np.clip(z[pair_row] - delta, -40, 40)))
            gap = 2 * SWAP_PENALTY / len(pairs) * (p[pair_row] - q)
            up, down = gap * p[pair_row] * (1 - p[pair_row]), gap * q * (1 - q)
            coefficient = np.where(change_sign > 0, up[change_owner], -down[change_owner])
            gradient += np.bincount(change_index, coefficient, size)
            bias_gradient += (up - down).sum()
        by_term = term_matrix @ w
        gradient += 2 * TERM_PENALTY / len(terms) * (term_matrix.T @ (by_term - by_term.mean())) + 2 * TERM_PENALTY * by_term.mean() * term_matrix.mean(axis=0)
        full = np.concatenate([gradient, [bias_gradient]])
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, float(bias)


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text of a block."""
    row, hashes, _ = features(data, offsets)
    at, number = model.find(hashes)
    once = np.unique(row[at] * len(model.features) + number)
    z = np.bincount(once // len(model.features), model.weights[once % len(model.features)], len(offsets) - 1) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 if the score is at least 0.5).

    Whole texts are scored. Null and empty texts get the score of a text without features; without a model every score
    is 0. Rows may repeat, null ids are kept, other columns are ignored, an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in blocks(batches, "text"):
            p = probabilities(model, data, offsets) if model else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(apply, f"id {kind.simpleString()}, score double, predicted int")


def keep_accepted(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score is 0.5 or more. Null texts are judged as empty ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    light_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = to_arrow_schema(docs.schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in blocks(batches, text_column):
            if model:
                yield rows.filter(pa.array(probabilities(model, data, offsets) < 0.5)).cast(schema)
            else:
                yield rows.cast(schema)

    return docs.mapInArrow(apply, docs.schema)
