"""Exact top-k search by inner product with a pivot table.

Every vector's distances to a few pivots are computed once. By the triangle inequality the largest
difference of two vectors' pivot distances bounds their own distance from below, and so their inner
product from above. Queries meet all rows in blocks; in a block candidates are evaluated in the order
of their bounds until no bound reaches the k-th score. A query's k-th score in a bounded sample of
the rows bars candidates of lower bounds in every block from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.components import checkpoint

#: Rows among which pivots are chosen, pivots, the least rows of a block and its most components, of rows as of queries.
SAMPLE, PIVOTS = 512, 24
LEAST_BLOCK, MOST_CELLS = 2_048, 1 << 22
SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def quantised(vectors: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """(id, codes array<double>, asked): floor(256 x) of each usable vector; whole numbers held as
    doubles, whose products sum exactly up to 2^53."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.where(usable(F.col("v")) & F.col("id").isNotNull()).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("codes"), "asked")


def bounded_sample(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and codes of SAMPLE rows, by length of vector."""
    sample: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "codes").limit(SAMPLE).collect():
        ids, codes = sample.setdefault(len(r.codes), ([], []))
        ids.append(r.id), codes.append(r.codes)
    return {size: (np.array(ids), np.array(codes).reshape(len(ids), size)) for size, (ids, codes) in sample.items()}


def choose_pivots(x: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Rows of x that lie far from one another."""
    taken, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(taken) < min(pivots, len(x)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[taken[-1]], axis=1))
    return x[taken]


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with `far`, the distances to the pivots of the vector's length (none: an empty list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [np.linalg.norm(pivots[len(c)] - c, axis=1) if len(c) in pivots else [] for c in map(np.asarray, batch.column("codes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64()))], [*batch.schema.names, "far"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("far", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Block:
    """Rows of one length: their numbers, ids, codes, squared lengths and distances to the pivots."""

    row: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    squares: np.ndarray
    far: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Block:
        matrix = lambda c: np.asarray(table.column(c).combine_chunks().flatten()).reshape(table.num_rows, -1)
        x = matrix("codes")
        return Block(table.column("row").to_numpy(), table.column("id").to_numpy(), x, (x * x).sum(axis=1), matrix("far"))

    def best(self, own: int, q: np.ndarray, square: float, q_far: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a query's k best rows but its own, ties to smaller ids; those that score
        less than `floor` may be left out."""
        low = np.abs(self.far - q_far).max(axis=1) if self.far.shape[1] else np.zeros(len(self.x))
        squares = self.squares + square
        bound = (squares - np.maximum(0, low - 1e-6 * (1 + low)) ** 2) / 2 + 1e-9 * squares
        open_ = np.flatnonzero((bound >= floor) & (self.row != own))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        rows, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 64
        while at < len(order):
            if len(rows) >= k and bound[order[at]] < scores[k - 1]:
                break
            new = order[at : at + step]
            at, step = at + step, step * 2
            rows, scores = np.r_[rows, new], np.r_[scores, self.x[new] @ q]
            top = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[top], scores[top]
        return rows, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each row that is_query marks its k highest inner products over
    floor(256 x) among all rows but itself, ties to the smaller id; all of them, if fewer.

    Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors of
    other lengths than the query's are no candidates. Rows that repeat an id are each a candidate, of
    each other too, and each a query with its own ranks; other columns, of any name, are ignored; an
    empty table gives an empty one."""
    rows = quantised(vectors, is_query, key, vector)
    sample = bounded_sample(rows.select("id", "codes"))
    pivots = {size: choose_pivots(x) for size, (_, x) in sample.items()}
    # the rows' numbers are stable once they are written
    table = checkpoint(pivot_table(rows, pivots).withColumns({"n": F.size("codes"), "row": F.monotonically_increasing_id()}))
    many, some, cells = table.agg(F.count("*"), F.count_if("asked"), F.sum("n")).first()
    most = max(1, MOST_CELLS * many // max(cells or 1, 1))
    blocks, groups = max(1, -(-many // min(most, max(LEAST_BLOCK, many // 24)))), max(1, -(-some // most))
    place = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = table.withColumn("block", place(1, blocks)).withColumn("part", every(groups))
    right = table.where("asked").withColumn("part", place(2, groups)).withColumn("block", every(blocks))
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", kind), T.StructField(key, kind), T.StructField("score", T.LongType())])

    def meet(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if candidates.num_rows and asking.num_rows:
            block, queries = Block.of(candidates), Block.of(asking)
            ids, x = sample.get(queries.x.shape[1], (np.zeros(0), np.zeros((0, queries.x.shape[1]))))
            for row, own, q, square, q_far in zip(queries.row, queries.ids, queries.x, queries.squares, queries.far):
                others = np.sort((x @ q)[ids != own])  # rows that are candidates of this query, in whatever block
                floor = others[-k] if len(others) >= k else -np.inf
                hits, scores = block.best(row, q, square, q_far, k, floor)
                for column, values in zip(found, ([row] * len(hits), [own] * len(hits), block.ids[hits].tolist(), scores.astype(np.int64).tolist())):
                    column += values
        id_kind = asking.schema.field("id").type
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), id_kind, id_kind, pa.int64()))], names=["row", "query_id", key, "score"])

    best = left.groupBy("block", "part", "n").cogroup(right.groupBy("block", "part", "n")).applyInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
