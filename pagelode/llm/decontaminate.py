"""Benchmark decontamination by the q-gram lemma.

Each benchmark item is cut into segments that overlap by half. A segment of m characters that occurs
in a document with k edits shares m + 1 - q - k*q of its q-grams with it, on diagonals that span k + 1
at most. Shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half, the bands that
reach the bound are kept, and banded alignment verifies the segment against the band's region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagelode.llm.arrow_batches import by_size

Q, SEGMENT, EDITS = 8, 96, 0.1
#: Characters of benchmark text in one index; more make more indexes, each with a pass of its own.
INDEX_CHARS = 4_000_000
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x2000):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
for _c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _LOWER[_c] = 32


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters in lower case with each run of white space as one space, and where each stood."""
    codes = _LOWER[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    kept = np.flatnonzero((codes != 32) | (np.r_[np.uint32(0), codes[:-1]] != 32))
    return codes[kept], kept


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return h ^ (h >> np.uint64(29))


def edit_budget(m: int) -> int:
    """Edits allowed in a segment of m characters, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(EDITS * m), (m - Q) // Q if m >= Q else 0))


def segments(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Overlapping segments of an item with their starts; the last ends with the item."""
    m = len(codes)
    if m <= SEGMENT:
        return [(0, codes)] if m >= Q else []
    return [(s, codes[s : s + SEGMENT]) for s in [*range(0, m - SEGMENT, SEGMENT // 2), m - SEGMENT]]


class Index:
    """q-grams of a bounded part of the benchmark: sorted hashes with (segment, place), and a bitmap
    that most q-grams of documents fail."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, self.codes, hashes, where, at = [], [], [], [], []
        for item, text in items:
            for start, codes in segments(normal(text.strip())[0]):
                h = grams(codes)
                hashes.append(h), where.append(np.full(len(h), len(self.codes))), at.append(np.arange(len(h)))
                self.items.append(item), self.codes.append(codes)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.where = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([edit_budget(len(c)) for c in self.codes], dtype=np.int64)
        self.needs = np.maximum(1, self.sizes + 1 - Q - self.edits * Q)
        size = int(np.ceil(np.log2(len(self.hashes) + 1)))
        self.bits = max(16, min(size + 6, max(size + 3, 26)))
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        self.bitmap[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(segment, start, end, edits) of each segment's best region in a document's characters."""
        h = grams(codes)
        if not len(h) or not len(self.hashes):
            return []
        p = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, h[p], "left"), np.searchsorted(self.hashes, h[p], "right")
        n = high - low
        if not n.any():
            return []
        p, hit = np.repeat(p, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        segment, place = self.where[hit], self.at[hit]
        diagonal, width = p - place + self.sizes[segment], self.edits[segment] + 1
        lower = diagonal // width
        segment, place, band = np.r_[segment, segment], np.r_[place, place], np.r_[lower, lower - 1]
        order = np.lexsort((place, band, segment))
        segment, place, band = segment[order], place[order], band[order]
        new = np.r_[True, (segment[1:] != segment[:-1]) | (band[1:] != band[:-1])]
        fresh = new | np.r_[True, place[1:] != place[:-1]]
        group = np.cumsum(new) - 1
        count = np.bincount(group, fresh)
        best: dict[int, tuple[int, int, int, int]] = {}
        for s, b in zip(segment[new][count >= self.needs[segment[new]]].tolist(), band[new][count >= self.needs[segment[new]]].tolist()):
            k, m = int(self.edits[s]), int(self.sizes[s])
            first = b * (k + 1) - m
            found = align(self.codes[s], codes, first, first + 2 * (k + 1), k)
            if found and (s not in best or (found[2], found[0]) < (best[s][3], best[s][1])):
                best[s] = (s, *found)
        return list(best.values())


    def spans(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """For each item of which a segment occurs in the text: its span in code points, fewest edits."""
        out: dict[object, tuple[int, int, int]] = {}
        if text:
            codes, places = normal(text)
            for s, start, end, edits in self.find(codes):
                span = (int(places[start]), int(places[end - 1]) + 1, edits)
                a, b, e = out.get(self.items[s], span)
                out[self.items[s]] = (min(a, span[0]), max(b, span[1]), min(e, edits))
        return out


def align(segment: np.ndarray, codes: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the segment's alignment with fewest edits on diagonals first - most to
    last + most of the document; None above `most`."""
    m = len(segment)
    for d in range(max(0, first), min(last, len(codes) - m + 1)):
        if codes[d] == segment[0] and np.array_equal(codes[d : d + m], segment):
            return d, d + m, 0
    low, width = first - most, last - first + 2 * most + 1
    far = m + width
    # cost[j]: fewest edits that end on diagonal low + j; start[j]: where that alignment began
    at = np.arange(low, low + width)
    cost, start = np.where((at >= 0) & (at <= len(codes)), 0, far), at.copy()
    steps = np.arange(width)
    for i in range(m):
        col = at + i
        inside = (col >= 0) & (col < len(codes))
        same = np.zeros(width, dtype=bool)
        same[inside] = codes[col[inside]] == segment[i]
        diagonal = np.where(inside, cost + ~same, far)
        skip = np.r_[cost[1:] + 1, far]
        up = skip < diagonal
        cost, start = np.where(up, skip, diagonal), np.where(up, np.r_[start[1:], 0], start)
        # running along the document: least of cost[j'] - j' to the left
        key = (cost - steps) * (2 * width) + steps
        source = np.minimum.accumulate(key) % (2 * width)
        cost, start = cost[source] + steps - source, start[source]
    j = int(np.argmin(cost * (2 * width) + np.abs(steps - width // 2)))
    end = low + j + m
    return (int(start[j]), min(end, len(codes)), int(cost[j])) if cost[j] <= most else None


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", chars: int = INDEX_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Bounded parts of the benchmark, read one after another; an item longer than a part is one alone."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    part, size = [], 0
    for row in rows.toLocalIterator():
        if part and size + len(row.text) > chars:
            yield part
            part, size = [], 0
        part.append((row.item, row.text))
        size += len(row.text)
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, start, end, edits): a row for each document and benchmark item of which a segment
    occurs within its edit budget, with the span from the first to the last such segment in code points
    of the text, end exclusive, and the fewest edits of one.

    Null and empty texts hold nothing, items of fewer than Q characters or null ids match nothing;
    repeated documents give repeated rows, repeated items one; an empty table on either side gives an
    empty one. The benchmark goes to executors in parts of bounded size, one pass over docs each."""
    spark, kind = docs.sparkSession, to_arrow_type(benchmark.schema[item].dataType)
    out = T.StructType([docs.schema[key], T.StructField(item, benchmark.schema[item].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])

    def scan(part: list[tuple[object, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in by_size(batches, text):
                found = [(row, own, *at) for row, t in enumerate(batch.column(text).to_pylist()) for own, at in index.spans(t).items()]
                rows, own, start, end, edits = zip(*found) if found else [[]] * 5
                columns = [pa.array(own, kind), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *columns], out.names)

        return docs.select(key, text).mapInArrow(run, out)

    passes = [scan(part) for part in indexes(benchmark, item, text)]
    found = passes[0] if passes else spark.createDataFrame([], out)
    for more in passes[1:]:
        found = found.union(more)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """docs without the rows in which contamination() finds anything; columns and other rows, null and
    empty texts among them, stay as they are, and nothing is shuffled."""
    for part in indexes(benchmark, item, text):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in by_size(batches, text):
                yield batch.filter(pa.array([not index.spans(t) for t in batch.column(text).to_pylist()]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
