"""Ranked lexical search of a table of items over all documents, each bag of item words scored once.

A pass over the documents keeps, of each, its length and the frequencies of the words that items use.
Documents whose frequencies and length norm are equal make one class: a hash deals them out, and the
frequencies themselves, part of the key, verify it. A class is scored once against blocks of items and
expanded to its members by ascending key afterwards; as k rows of an item are asked for, no more than
a class's k least members can be among them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size
from pagelode.llm.components import stored

#: Characters between words: ASCII other than letters and digits.
GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Words of items that are broadcast at once; a larger table of items takes more passes.
MOST_POSTINGS = 500_000
#: Distinct words of a block of items, and cells of the table in which it meets a block of classes.
BLOCK_TERMS, MOST_CELLS = 4_096, 1 << 22

#: Bytes of UTF-8 with A-Z in lower case and a space for each gap; bytes from 128 on are parts of words.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; none for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(f"[^{GAPS}]+"), F.lit(0)), F.array().cast("array<string>"))


def postings(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(no, item, term, uses), written: the words of each row of items, which `no` tells apart."""
    rows = items.select(F.monotonically_increasing_id().alias("no"), F.col(key).alias("item"), terms(F.col(text)).alias("terms"))
    return stored(rows.select("no", "item", F.explode("terms").alias("term")).groupBy("no", "item", "term").agg(F.count("*").alias("uses")))


def bags(docs: DataFrame, words: list[str], key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with a word at all: its words with repeats, the places of
    its words in `words`, ascending, and their frequencies."""
    held = docs.sparkSession.sparkContext.broadcast({w.encode(): k for k, w in enumerate(words)})
    ints = T.ArrayType(T.IntegerType(), False)
    out = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value.get
        for batch in by_size(batches, text):
            sizes, found, kept = [], [], []
            for k, raw in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
                own = raw.translate(_FOLD).split() if raw else ()
                if own:
                    uses = Counter(map(place, own))
                    uses.pop(None, None)
                    kept.append(k), sizes.append(len(own)), found.append(sorted(uses.items()))
            flat = np.array([x for f in found for x in f], dtype=np.int32).reshape(-1, 2)
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[:, c]))) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], out.names)

    return docs.select(key, text).mapInArrow(run, out)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(m, terms, tfs, members): rows equal in all three as one, with the k least ids of it. Of a large
    class each task passes on k rows at most."""
    same = ["h", "m", "terms", "tfs"]
    marked = rows.where(F.size("terms") > 0).withColumns({"h": F.xxhash64("m", "terms", "tfs"), "member": F.struct(F.col("id").isNull().alias("none"), "id")})
    place = F.row_number().over(Window.partitionBy(*same).orderBy("member"))
    least = marked.select(*same, "member").withColumn("place", place).where(F.col("place") <= k)
    return least.groupBy(*same).agg(F.sort_array(F.collect_list("member")).alias("members")).drop("h")


@dataclass(frozen=True)
class Block:
    """Some items: the words they use between them, ascending, and each item's places in these and uses."""

    words: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]


def item_blocks(item: np.ndarray, term: np.ndarray, uses: np.ndarray) -> list[Block]:
    """Items dealt into blocks of about BLOCK_TERMS distinct words at most."""
    order = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
    waiting: list[np.ndarray] = []
    blocks = []

    def close() -> None:
        words = np.unique(term[np.concatenate(waiting)])
        blocks.append(Block(words, [(int(item[w[0]]), np.searchsorted(words, term[w]), uses[w]) for w in waiting]))

    for a, b in zip(cuts, cuts[1:]):
        if waiting and sum(map(len, waiting)) + b - a > 4 * BLOCK_TERMS:
            close()
            waiting = []
        waiting.append(order[a:b])
    if waiting:
        close()
    return blocks


def best_classes(found: DataFrame, weights: np.ndarray, blocks: list[Block], k: int) -> DataFrame:
    """(item, score, members): of each task and item the k best classes, ties to the least member."""
    held = found.sparkSession.sparkContext.broadcast((weights, blocks))
    out = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("score", T.LongType()), found.schema["members"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, parts = held.value
        best: dict[int, list] = {}
        kind = None
        for batch in batches:
            kind, members = batch.schema.field("members").type, batch.column("members")
            n, m = np.asarray(batch.column("terms").value_lengths()), batch.column("m").to_numpy()
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            row = np.repeat(np.arange(len(n)), n)
            value = weight[term] * (1_000_000_000 * tf // (1_000 * tf + 8 * m[row]))
            for part in parts:
                at = np.minimum(np.searchsorted(part.words, term), len(part.words) - 1)
                own = part.words[at] == term
                at, of, worth = at[own], row[own], value[own]
                step = max(1, MOST_CELLS // len(part.words))
                for start in range(0, len(n), step):
                    i, j = np.searchsorted(of, (start, start + step))
                    cells = np.zeros((len(part.words), min(step, len(n) - start)), np.int64)
                    cells[at[i:j], of[i:j] - start] = worth[i:j]
                    for item, places, uses in part.items:
                        scores = (uses[:, None] * cells[places]).sum(axis=0)
                        top = best.setdefault(item, [])
                        hits = np.flatnonzero(scores >= (-top[-1][0] if len(top) == k else 1))
                        if len(hits) > k:  # ties of the k-th stay
                            hits = hits[scores[hits] >= np.partition(scores[hits], -k)[-k]]
                        for h in hits.tolist():
                            own_members = members[start + h].as_py()
                            first = own_members[0]
                            top.append((-int(scores[h]), first["none"], 0 if first["none"] else first["id"], own_members))
                        if len(hits):
                            top.sort(key=lambda x: x[:3])
                            del top[k:]
        rows = [(item, -x[0], x[3]) for item, top in best.items() for x in top]
        if rows:
            places, scores, lists = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(scores, pa.int64()), pa.array(lists, kind)], out.names)

    return found.mapInArrow(run, out)


def _search(docs: DataFrame, asked: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """search() for items whose postings fit a broadcast."""
    spark, own = docs.sparkSession, asked.orderBy("no").toArrow()
    term, words = own.column("term").combine_chunks(), sorted(set(own.column("term").to_pylist()))
    numbers, first, item = np.unique(own.column("no").to_numpy(), return_index=True, return_inverse=True)
    rows = stored(bags(docs, words, key, text))
    many, total = rows.agg(F.count("*"), F.sum("n")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * many + 2)) / (2 * F.col("df") + 1).cast("double")))
    weights = np.zeros(len(words), np.int64)
    for r in df.select("term", weight.cast("long").alias("w")).collect():  # a row for each word of the items at most
        weights[r.term] = r.w
    place = {w: i for i, w in enumerate(words)}
    blocks = item_blocks(item, np.array([place[w] for w in term.to_pylist()], np.int64), own.column("uses").to_numpy())
    m = F.expr(f"100 - 75 + ((75L * n * {many}L) div {total or 1}L)")
    scored = best_classes(classes(rows.withColumn("m", m), k), weights, blocks, k)
    names = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(numbers)), pa.int32()), "item": own.column("item").take(pa.array(first))}))
    ahead = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.element_at("members", 1)))
    kept = scored.withColumn("ahead", ahead).where(F.col("ahead") <= k).select("place", "score", F.explode("members").alias("member"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "member"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(names, "place").select("item", "rank", "member.id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): for each row of items its k best documents with a score above 0,
    ties to the smaller key; all of them, if fewer.

    Null, empty and wordless texts have no words and take no part, as items as well as documents; very
    long texts are read whole. Rows that repeat a key are each a candidate, and rows that repeat an item
    key each an item with ranks of its own; null keys come last among ties. Other columns, of any name,
    are ignored; no documents or no items give an empty table."""
    asked = postings(items, item_key, item_text)
    parts = -(-asked.count() // MOST_POSTINGS)
    part = F.pmod(F.xxhash64("no"), F.lit(max(parts, 1)))
    found = [_search(docs, asked.where(part == p), k, key, text) for p in range(parts)]
    empty = T.StructType([T.StructField("item", items.schema[item_key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", docs.schema[key].dataType), T.StructField("score", T.LongType())])
    out = reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], empty)
    return out.toDF(item_key, "rank", key, "score")
