"""SimHash near-duplicates under the pigeonring principle.

64 bits are cut into a ring of five segments. Two fingerprints within four bits have a segment from
which every chain of l consecutive segments differs in l * 4/5 bits or fewer: the first segment is
equal, and of the second, which differs in one bit at most, one half is equal. Both together are the
key of the index. Inside a bucket longer chains prune before the full check, and only a spanning
forest of the links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size
from pagelode.llm.components import checkpoint, components

MOST = 4
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS)))
#: Buckets of more distinct fingerprints are linked through common neighbours instead of pairs.
WIDE_BUCKET = 100_000
SHINGLE = 4


def fingerprint(text: str | None) -> int:
    """ASCII letters lower-cased, words between ASCII white space, majority bits of their shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.array([len(w) for w in words]) + 1
    ends = np.cumsum(sizes) - 1
    starts, stops = (ends - sizes + 1).tolist(), ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint) of every row; texts that are null or hold no word have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text):
            fps = pa.array([fingerprint(t) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), fps], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def index_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: each segment with either half of the segment after it."""
    part = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = []
    for k, width in enumerate(WIDTHS):
        n = (k + 1) % len(WIDTHS)
        for half, (at, size) in enumerate(((OFFSETS[n], WIDTHS[n] // 2), (OFFSETS[n] + WIDTHS[n] // 2, WIDTHS[n] - WIDTHS[n] // 2))):
            keys.append(F.lit((2 * k + half) << 32).cast("long") + F.shiftleft(part(OFFSETS[k], width), 8) + part(at, size))
    return F.array(*keys)


def _bits(x: np.ndarray, segment: int) -> np.ndarray:
    return np.bitwise_count((x >> np.uint64(OFFSETS[segment])) & np.uint64((1 << WIDTHS[segment]) - 1)).astype(np.int64)


def _near(x: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which differences keep the budget of every chain that starts at the slot's segment."""
    good = np.ones(len(x), dtype=bool)
    bits = np.stack([_bits(x, k) for k in range(len(WIDTHS))], axis=1)
    spent = np.zeros(len(x), dtype=np.int64)
    for step in range(len(WIDTHS)):
        spent = spent + bits[np.arange(len(x)), (slots + step) % len(WIDTHS)]
        good &= spent <= (step + 1) * MOST // len(WIDTHS)
    return good


def _chained(fps: np.ndarray, slot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket whose chains from the slot's segment keep their budgets: rows meet only those
    whose second segment differs in a bit at most, and of these only those go on whose third keeps the
    budget as well, before all chains are checked."""
    second, third = (slot + 1) % len(WIDTHS), (slot + 2) % len(WIDTHS)
    value = ((fps >> np.uint64(OFFSETS[second])) & np.uint64((1 << WIDTHS[second]) - 1)).astype(np.int64)
    order = np.argsort(value, kind="stable")
    known, starts = np.unique(value[order], return_index=True)
    groups = dict(zip(known.tolist(), np.split(order, starts[1:])))
    for v, own in groups.items():
        for other in (v, *(v ^ 1 << bit for bit in range(WIDTHS[second]))):
            if other < v or other not in groups:
                continue
            beside, spent = groups[other], int(other != v)
            step = max(1, (1 << 20) // len(beside))
            for at in range(0, len(own), step):
                x = fps[own[at : at + step], None] ^ fps[None, beside]
                i, j = np.nonzero(_bits(x, third) + spent <= 3 * MOST // len(WIDTHS))
                if len(i):
                    good = _near(x[i, j], np.full(len(i), slot))
                    yield own[i[good] + at], beside[j[good]]


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i with j in the forest whose roots are kept flat in root."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (flat := root[root]).tobytes() != root.tobytes():
            root[:] = flat


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket; rows come by key."""
    root = np.arange(len(keys))
    slots = (keys >> 32) // 2
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    wide = np.repeat(sizes > 64, sizes)
    for d in range(1, 64):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & ~wide[d:])
        if not len(i):
            break
        i = i[_near(fps[i] ^ fps[i + d], slots[i])]
        _merge(root, i, i + d)
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for i, j in _chained(fps[s : s + n], int(slots[s])):
            _merge(root, i + s, j + s)
    child = np.flatnonzero(root != np.arange(len(keys)))
    return fps[child], fps[root[child]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a sorted partition; the last bucket of a batch waits for the next."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(k, f):
        a, b = bucket_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.r_[keys, batch.column("key").to_numpy()]
        fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
        if len(keys) and (cut := int(np.searchsorted(keys, keys[-1]))):
            yield links(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield links(keys, fps)


def _hubs(rows: DataFrame) -> DataFrame:
    """Links in very wide buckets, without pairs: two fingerprints within four bits have a common
    neighbour within two bits of each, and every neighbour links those around it to the least."""
    masks = [0, *(1 << a for a in range(64)), *(1 << a | 1 << b for a in range(64) for b in range(a))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    around = rows.select("fp", F.explode(F.transform(F.lit(signed), lambda m: F.col("fp").bitwiseXOR(m))).alias("hub"))
    least = around.groupBy("hub").agg(F.min("fp").alias("b"))
    return around.join(least, "hub").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of a table (fp), enough of them that whoever is
    within four bits is connected, and none between others."""
    index = distinct.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    sizes = index.groupBy("key").count()
    wide = checkpoint(sizes.where(F.col("count") > WIDE_BUCKET).select("key"))
    narrow, more = index, None
    if not wide.isEmpty():
        narrow = index.join(wide, "key", "left_anti")
        more = _hubs(index.join(wide, "key", "left_semi").select("fp").distinct())
    found = narrow.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_linked, "a long, b long").distinct()
    return found if more is None else found.union(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row of docs: the least key that a row reaches by links.

    Empty, null and wordless texts share fingerprint 0 and link like any other; very long texts are read
    whole; copies share one
    fingerprint and one node; repeated rows each give a row; null keys don't count as least; an empty
    table gives an empty one. Other columns are left out."""
    rows = checkpoint(fingerprints(docs, key, text))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(key).alias("first")))
    near = components(links(nodes.select("fp")))
    member = nodes.join(near, nodes.fp == near.node)
    least = member.groupBy("component").agg(F.min("first").alias("least"))
    linked = member.select("fp", "component").join(least, "component").select("fp", "least")
    # a table of its own, so that the join can split the rows of a fingerprint that a third of them have
    whole = checkpoint(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return rows.join(whole, "fp").select(key, "fp", "component_id")
