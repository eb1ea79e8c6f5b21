"""Token counts without token ids.

A pass over the documents gives pre-token frequencies, held as one row per block of documents and
pre-token with its documents and counts. The pieces of each distinct pre-token are counted once,
joined to those rows, and the products are summed per document within its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size
from pagelode.llm.bpe import load, tokenizer_file

#: Bytes of text and rows of a block of documents.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 50_000
#: Rows of blocks and pre-tokens whose products are added up at once.
FOLD_ROWS = 100_000
#: Documents in which frequent pre-tokens are looked for, and the most that are taken.
HEAD_DOCS, HEAD_WORDS = 1_000, 1_000


def _stream(keys: pa.Array, sizes: pa.Array) -> bytes:
    table, sink = pa.RecordBatch.from_arrays([keys, sizes], ["keys", "sizes"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write(table)
    return sink.getvalue().to_pybytes()


def frequencies(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, word, posts): a row for each block and pre-token with three bytes for each of its
    documents, the step from the place before in the block (two bytes) and the frequency (larger ones
    are split); and a row for each block, of a word that starts with a space as none of a text does,
    with its keys and text sizes as an Arrow stream."""
    held = tokenizer_file(docs, path)
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.StringType()), T.StructField("posts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = load(held.value), TaskContext.get().partitionId() << 32
        for whole in by_size(batches, text, BLOCK_BYTES):
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                place: dict[str, int] = {}
                rows = [np.array([place.setdefault(w, len(place)) for w in bpe.split(t)], dtype=np.int64) if t else np.zeros(0, np.int64) for t in batch.column(text).to_pylist()]
                of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                pairs, n = np.unique(np.concatenate(rows) << 16 | of, return_counts=True)
                parts = -(-n // 255)
                freqs = np.full(int(parts.sum()), 255)
                freqs[np.cumsum(parts) - 1] = n - (parts - 1) * 255
                pairs = np.repeat(pairs, parts)
                words, of = pairs >> 16, pairs & 0xFFFF
                starts = np.searchsorted(words, np.arange(len(place) + 1))
                steps = np.diff(of, prepend=0)
                steps[starts[:-1]] = of[starts[:-1]]
                posts = np.stack([steps & 255, steps >> 8, freqs], axis=1).astype(np.uint8)
                sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f" {number}"]), pa.array([_stream(batch.column(key), sizes)], pa.binary())], out.names)
                if place:
                    binary = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((starts * 3).astype(np.int32)), pa.py_buffer(posts.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), number)), pa.array(list(place), pa.string()), binary], out.names)
                number += 1

    return docs.select(key, text).mapInArrow(run, out)


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(word, pieces) for a table of distinct words; those that start with a space are left out."""
    held = tokenizer_file(words, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for batch in batches:
            own = [w for w in batch.column("word").to_pylist() if w[:1] != " "]
            plain = [w for w in own if w not in bpe.special]
            n = dict.fromkeys(own, 1) | {w: len(ids) // 4 for w, ids in zip(plain, bpe.encode_words(plain) if plain else [])}
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([n[w] for w in own], pa.int32())], ["word", "pieces"])

    return words.select("word").mapInArrow(run, "word string, pieces int")


def head_pieces(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """(word, known): pieces of HEAD_WORDS frequent pre-tokens at most. Their rows, one in nearly every
    block, then need not all go to one task; any other list gives the same counts."""
    rows = frequencies(docs.limit(HEAD_DOCS), path, key, text).groupBy("word").agg(F.sum(F.octet_length("posts")).alias("n"))
    return count_pieces(rows.where("word not like ' %'").orderBy(F.desc("n"), "word").limit(HEAD_WORDS), path).withColumnRenamed("pieces", "known")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of docs.

    Null texts count as empty, with no bytes and tokens; very long texts are read whole; repeated rows
    and keys each give a row; an empty table gives an empty one; other columns are left out. docs should give its rows alike each
    time it is read, as a table does."""
    rows = frequencies(docs, path, key, text).join(F.broadcast(head_pieces(docs, path, key, text)), "word", "left")
    # rows of frequent words stay by block, like the rows of keys, under words that no text has
    rows = rows.withColumn("word", F.when(F.col("known").isNull(), F.col("word")).otherwise(F.concat(F.lit(" "), F.col("block")))).repartition("word")
    # every column is counted, so that Spark reads the exchange of rows twice and makes it once
    seen = rows.groupBy("word").agg(*[F.count(c).alias(c) for c in rows.columns if c != "word"])
    pieces = count_pieces(seen.where("block + posts + known >= 0"), path)
    joined = rows.join(pieces, "word", "left").select("block", "posts", F.coalesce("known", "pieces").alias("pieces"))
    sums = T.StructType([rows.schema["block"], *[T.StructField(c, T.BinaryType()) for c in ("docs", "sums", "about")]])
    kind = docs.schema[key]

    def added(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        """A row for each block: the documents that its words here occur in, and their tokens."""
        own = pa.Table.from_batches(tables)
        posts = own.column("posts").combine_chunks()
        n = np.diff(np.asarray(posts.buffers()[1], dtype=np.uint8).view(np.int32)[posts.offset : posts.offset + len(posts) + 1]) // 3
        raw = np.frombuffer(b"".join(posts.to_pylist()), dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        run = np.cumsum(raw[:, 0] | raw[:, 1] << 8)
        starts = np.cumsum(n) - n
        before = np.r_[0, run][starts]
        blocks, block = np.unique(own.column("block").to_numpy(), return_inverse=True)
        pairs, at = np.unique(np.repeat(block, n) << 16 | run - np.repeat(before, n), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, raw[:, 2] * np.repeat(own.column("pieces").to_numpy().astype(np.int64), n))
        cuts = np.searchsorted(pairs >> 16, np.arange(len(blocks) + 1)).tolist()
        docs_of, sums_of = (pairs & 0xFFFF).astype("<u2"), total.astype("<u4")
        split = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(blocks), split(docs_of), split(sums_of), pa.nulls(len(blocks), pa.binary())], sums.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, many = [], 0
        for batch in batches:
            heads = batch.filter(pa.compute.is_null(batch.column("pieces")))
            if heads.num_rows:
                none = pa.nulls(heads.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([heads.column("block"), none, none, heads.column("posts")], sums.names)
            rest = batch.filter(pa.compute.is_valid(batch.column("pieces")))
            waiting, many = [*waiting, rest], many + rest.num_rows
            if many >= FOLD_ROWS:
                yield added(waiting)
                waiting, many = [], 0
        if many:
            yield added(waiting)

    def total(group: pa.Table) -> pa.Table:
        head = pa.ipc.open_stream(group.column("about").drop_null()[0].as_buffer()).read_all()
        keys, sizes = head.column("keys"), head.column("sizes")
        n = np.zeros(len(keys), dtype=np.int64)
        for docs_of, sums_of in zip(group.column("docs").to_pylist(), group.column("sums").to_pylist()):
            if docs_of is not None:
                n[np.frombuffer(docs_of, dtype="<u2")] += np.frombuffer(sums_of, dtype="<u4")
        return pa.table([keys, sizes, pa.array(n)], names=out.names)

    out = T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return joined.mapInArrow(fold, sums).groupBy("block").applyInArrow(total, out)
