"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded, hash-chosen sample of labelled rows and flattened into arrays of
complete binary trees; a batch of documents goes down all trees at once by array indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size

#: Labelled rows that a fit takes at most: those whose keys have the least hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 4, 0.1, 64, 20, 1.0
FEATURES = (
    "log_words", "word_length", "upper", "digits", "signs", "high_bytes", "spaces", "byte_entropy",
    "distinct_words", "top_word", "distinct_trigrams", "repeated_lines", "line_words", "ended_lines",
    "short_words", "sign_ended_words", "lower_starts", "longest_word",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; of an empty one all are zero."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size = raw.sum()
    kinds = np.bincount(_CLASS, weights=raw, minlength=6) / size
    share = raw[raw > 0] / size
    counts = Counter(words)
    trigrams = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    return [
        float(np.log1p(n)), letters / n, kinds[1], kinds[2], kinds[5], kinds[4], kinds[3], float(-(share * np.log2(share)).sum()),
        len(counts) / n, max(counts.values()) / n, trigrams, 1 - len(set(lines)) / len(lines), n / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        sum(c for w, c in counts.items() if len(w) < 4) / n, sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,") / n,
        sum(c for w, c in counts.items() if w[0].islower()) / n, float(max(map(len, counts))),
    ]


@dataclass(frozen=True)
class Trees:
    """Split features and thresholds of complete trees by level, leaf values, and the base rate's logit."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x; a value above the threshold goes right."""
        total = np.full(len(x), self.base)
        if len(self.leaf):
            tree, row = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(tree)), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees on a sample held in memory; one class or no rows give the base rate alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    none = Trees(np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), base)
    if len(y) < 2 * LEAST or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    width, out = x.shape[1], []
    margin = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            flat = (((node - first)[:, None] * width + np.arange(width)) * BINS + bins).ravel()
            histogram = lambda w: np.bincount(flat, weights=np.repeat(w, width), minlength=many * width * BINS).reshape(many, width, BINS)  # noqa: B023, E731
            g, h, n = histogram(gradient).cumsum(axis=2), histogram(weight).cumsum(axis=2), histogram(np.ones(len(y))).cumsum(axis=2)
            gain = g**2 / (h + RIDGE) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + RIDGE) - g[..., -1:] ** 2 / (h[..., -1:] + RIDGE)
            gain[(n < LEAST) | (n[..., -1:] - n < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            split = gain.reshape(many, -1).max(axis=1) > 1e-6
            feature[first : first + many] = f
            threshold[first : first + many] = [cuts[i][j] if s and j < len(cuts[i]) else np.inf for i, j, s in zip(f, b, split)]
            at = node
            node = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        slot = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(slot, gradient, 2**DEPTH) / (np.bincount(slot, weight, 2**DEPTH) + RIDGE)
        margin += leaf[slot]
        out.append((feature, threshold, leaf))
    return Trees(*(np.stack(parts) for parts in zip(*out)), base)


def held_out(key: str) -> Column:
    """Whether labels of this key are kept from every fit."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> Trees:
    """Trees from at most `most` labelled rows that aren't held out.

    Labels that are null or not 0 or 1, and null keys, teach nothing; a key with several labels has
    the largest; of several documents with the key each distinct text counts. Only statistics reach the
    driver, of `most` texts at most, those with the least hashes."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("label"))
    chosen = rows.orderBy(F.xxhash64(key), key).limit(most)
    taught = docs.select(key, text).join(F.broadcast(chosen), key).select("label", F.col(text).alias("text"), F.xxhash64(key, text).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64())), batch.column("mark")], ["label", "x", "mark"])

    got = taught.mapInArrow(run, "label int, x array<double>, mark long").dropDuplicates(["mark"]).orderBy("mark").limit(most).toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees however the rows come in
    return grow(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column `into`, the probability of label 1 by its text alone.

    Empty, null and very long texts have a score; repeated rows stay; an empty table stays empty. A
    column of docs with the name `into` gives way."""
    kept = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text):
            x = np.array([statistics(t) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(x))], [*batch.schema.names, into])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())]))
