"""Packing of token sequences of a fixed size by best fit and a swap-based local search.

Pieces of equal length are interchangeable, so bins of equal contents are one class with a count, and
a plan needs the histogram of lengths alone, of one row a length, however many documents there are.
Best fit in falling length makes the first plan. Then bins that aren't full exchange pieces, one for
one, two for one, one for two, or move one: always so that the sum of squared fills grows and the
emptier of the two gets emptier, until bins are empty, as few are left as a bound allows, or nothing
moves. Pieces get numbers within their length in Spark, and a number names a place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size
from pagelode.llm.bpe import TEXT_BYTES, WordBpe, load, tokenizer_file
from pagelode.llm.components import stored

#: Rows of a bucket in which pieces of a length are numbered, while there are MOST_BUCKETS at most.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16

#: Exchanges in a row that empty no bin, after which the local search ends.
PATIENCE = 500

#: The contents of a bin: (length, pieces of it) in falling order.
Bin = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, path: str, size: int, end: int, key: str, text: str, ids: bool) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32[, ids]), written: each document's token ids and `end`,
    cut where they exceed `size`. `row` tells the pieces apart."""
    held = tokenizer_file(docs, path)
    fields = [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    out = T.StructType([*fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids])
    last = end.to_bytes(4, "little")

    def cut(bpe: WordBpe, batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        words = [bpe.split(t) if t else [] for t in batch.column(text).to_pylist()]
        of = bpe.learn({w for ws in words for w in ws}).__getitem__
        found = []
        for k, ws in enumerate(words):
            packed = b"".join(map(of, ws)) + last
            for at in range(0, len(packed), 4 * size):
                own = packed[at : at + 4 * size]
                found.append((k, at // (4 * size), at // 4, len(own) // 4, zlib.crc32(own), own if ids else b""))
        place, piece, start, length, crc, parts = zip(*found) if found else [()] * 6
        columns = [pa.array(np.arange(number, number + len(place))), batch.column(key).take(pa.array(place, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length], dtype=np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
        return pa.RecordBatch.from_arrays(columns, out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = load(held.value), TaskContext.get().partitionId() << 33
        for batch in by_size(batches, text, TEXT_BYTES):
            rows = cut(bpe, batch, number)
            number += rows.num_rows
            yield rows

    return stored(docs.select(key, text).mapInArrow(run, out))


def filled(b: Bin) -> int:
    return sum(n * k for n, k in b)


def least_bins(lengths: dict[int, int], size: int) -> int:
    """Bins that any packing needs: the best over k of a count of the pieces that can't share a bin with
    one of k or more, and of the room that the small ones of k or more need beyond."""
    n = np.zeros(size + 1, np.int64)
    n[list(lengths)] = list(lengths.values())
    many, sums, half = np.r_[0, n.cumsum()], np.r_[0, (n * np.arange(size + 1)).cumsum()], size // 2
    best = 0
    for k in range(half + 1):
        alone, wide = many[size + 1] - many[size - k + 1], many[size - k + 1] - many[half + 1]
        room = wide * size - (sums[size - k + 1] - sums[half + 1])
        best = max(best, int(alone + wide + max(0, -(-(sums[half + 1] - sums[k] - room) // size))))
    return best


def best_fit(lengths: dict[int, int], size: int) -> dict[Bin, int]:
    """Counts of bins by contents: pieces in falling length, each into the fullest bin that takes it."""
    free: list[int] = []
    open_: dict[int, list[tuple[Bin, int]]] = defaultdict(list)
    done: dict[Bin, int] = defaultdict(int)

    def put(b: Bin, n: int, left: int) -> None:
        if left and n:
            if not open_[left]:
                insort(free, left)
            open_[left].append((b, n))
        elif n:
            done[b] += n

    for length in sorted(lengths, reverse=True):
        c = lengths[length]
        while c:
            at = bisect_left(free, length)
            left = free[at] if at < len(free) else size
            if at < len(free):
                b, n = open_[left].pop()
                if not open_[left]:
                    del free[at]
            else:
                b, n = (), -(-c // (size // length))
            fit = min(left // length, c)
            full = min(n, c // fit)
            put((*b, (length, fit)), full, left - fit * length)
            put(b, n - full if b else 0, left)
            c -= full * fit
    for left in free:
        for b, n in open_[left]:
            done[b] += n
    return dict(done)


def _offers(b: Bin) -> list[tuple[int, ...]]:
    """What a bin can give away: nothing, one piece or two."""
    own = [n for n, _ in b]
    return [(), *[(n,) for n in own], *[(n, m) for i, n in enumerate(own) for m in own[i + (b[i][1] < 2) :]]]


def _changed(b: Bin, out: tuple[int, ...], in_: tuple[int, ...]) -> Bin:
    own = defaultdict(int, dict(b))
    for n in out:
        own[n] -= 1
    for n in in_:
        own[n] += 1
    return tuple(sorted(((n, k) for n, k in own.items() if k), reverse=True))


class Underfull:
    """Bins that aren't full, by contents, with what each can give away, in arrays that grow at the end."""

    def __init__(self, bins: dict[Bin, int], size: int):
        self.size, self.count = size, dict(bins)
        self.offers: list[tuple[Bin, tuple[int, ...]]] = []
        self.own: dict[Bin, slice] = {}
        #: Of each offer: its tokens, its pieces, its bin's fill, and whether its bin is still there.
        self.value, self.pieces, self.fill, self.there = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, np.int64, bool))
        for b in bins:
            self._list(b)

    def _list(self, b: Bin) -> None:
        if filled(b) == self.size:
            return
        if b not in self.own:
            new, start = _offers(b), len(self.offers)
            self.offers += [(b, x) for x in new]
            while len(self.offers) > len(self.value):
                self.value, self.pieces, self.fill, self.there = (np.r_[x, np.zeros_like(x)] for x in (self.value, self.pieces, self.fill, self.there))
            at = self.own[b] = slice(start, len(self.offers))
            self.value[at], self.pieces[at], self.fill[at] = [sum(x) for x in new], [len(x) for x in new], filled(b)
        self.there[self.own[b]] = True

    def add(self, b: Bin, n: int) -> None:
        self.count[b] = self.count.get(b, 0) + n
        if self.count[b]:
            self._list(b)
        else:
            del self.count[b]
            if b in self.own:
                self.there[self.own[b]] = False

    def best(self, p: Bin) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
        """The bin with which p exchanges to the greatest gain in squared fill, what p gives and gets."""
        if self.count[p] == 1:
            self.there[self.own[p]] = False
        at = np.flatnonzero(self.there[: len(self.offers)])
        self.there[self.own[p]] = True
        value, pieces, fill = self.value[at], self.pieces[at], self.fill[at]
        best_gain, found = 0, None
        for out in _offers(p):
            more = sum(out) - value
            good = np.flatnonzero((more > 0) & (more <= self.size - fill) & (len(out) + pieces <= 3))
            if len(good):
                gain = more[good] * (fill[good] - filled(p) + more[good])
                k = int(gain.argmax())
                if gain[k] > best_gain:
                    best_gain, found = int(gain[k]), (at[good[k]], out)
        if found is None:
            return None
        q, in_ = self.offers[found[0]]
        return q, found[1], in_


def exchanged(bins: dict[Bin, int], size: int, least: int, patience: int = PATIENCE) -> dict[Bin, int]:
    """The plan after the local search, which starts at the emptiest bins. The exchange with the greatest
    gain goes first, and for all bins of the two kinds at once. It ends where `least` bins are left, where
    the others lack the room for any bin, or after `patience` exchanges that emptied none."""
    own, many, tried, freed = Underfull(bins, size), sum(bins.values()), 0, True
    room = size * many - sum(filled(b) * n for b, n in bins.items())
    while freed:
        freed = False
        for first in sorted((b for b in own.count if filled(b) < size), key=lambda b: (filled(b), b)):
            p = first
            while p in own.count and many > least and tried < patience and room >= size:
                step, tried = own.best(p), tried + 1
                if step is None:
                    break
                q, out, in_ = step
                n = own.count[p] // 2 if p == q else min(own.count[p], own.count[q])
                left = _changed(p, out, in_)
                own.add(p, -n), own.add(q, -n), own.add(_changed(q, in_, out), n)
                if left:
                    own.add(left, n)
                    p = left
                else:
                    many, room, tried, freed, p = many - n, room - n * size, 0, True, first
    return own.count


def plan(lengths: dict[int, int], size: int) -> dict[Bin, int]:
    return exchanged(best_fit(lengths, size), size, least_bins(lengths, size))


def places(bins: dict[Bin, int]) -> dict[str, np.ndarray]:
    """Places of the pieces of each length: from number `first` on, `each` a sequence, from sequence
    `sequence` and its offset `offset` on."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for b in sorted(bins, reverse=True):
        offset = 0
        for n, k in b:
            rows.append((n, seen[n], k, sequence, offset))
            seen[n] += k * bins[b]
            offset += n * k
        sequence += bins[b]
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), columns))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `number`, from 0 within each length. Numbers count in buckets of a length, so that a
    length that many pieces have is no one task's."""
    buckets = min(MOST_BUCKETS, max(1, rows.count() // BUCKET_ROWS))
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = F.sum("many").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = marked.groupBy("length", "bucket").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(before, F.lit(0))).drop("many")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    return marked.withColumn("own", own).join(sums, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs, in
    sequences of `size` tokens at most; with `ids`, also the piece's token ids, for sequences().

    Null and empty texts are the `end` token alone; very long texts are cut into whole pieces of `size`
    tokens and a rest. Repeated rows and keys are each a document, null keys too; other columns, of any
    name, are left out; an empty table gives an empty one."""
    rows = pieces(docs, path, size, end, key, text, ids)
    lengths = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # `size` rows at most
    held = docs.sparkSession.sparkContext.broadcast(places(plan(lengths, size)))
    into = T.StructType([f for f in rows.schema.fields if f.name in ("row", "id", "piece", "start", "length", "ids_crc32")] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        keys = at["length"] << 48 | at["first"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(keys, length << 48 | number, side="right") - 1
            own, each = number - at["first"][k], at["each"][k]
            found = [pa.array(at["sequence"][k] + own // each), pa.array(at["offset"][k] + own % each * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in into.names[:-2]], *found], into.names)

    placed = numbered(rows.drop("ids")).mapInArrow(run, into)
    if ids:
        placed = placed.join(rows.select("row", "ids"), "row")
    more = ["ids"] * ids
    return placed.select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a table that pack() made with its ids: the pieces of each in their places."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
