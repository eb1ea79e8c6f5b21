"""Stupid-backoff scores of documents by n-gram counts of a whole corpus.

Documents are dealt into blocks. A block's n-grams of every order, hashed to 64 bits, go to the count
table's part that the leading bits of the hash name; a part adds up the counts of all blocks and
answers each with the counts of its own n-grams; these join the block's n-grams again, and the
logarithms are summed per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.components import checkpoint

ORDER, ALPHA, LEAST = 2, 0.4, 2
#: Bytes of text in a block (there are LEAST_BLOCKS at least) and n-grams in a part, about.
BLOCK_BYTES, LEAST_BLOCKS, PART_GRAMS = 16 << 20, 48, 1 << 20


def _planar(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that empty planes cost nothing once compressed."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def gram_hashes(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for each order the hashes of all n-grams and the places of their last
    words among all words. Words stand between ASCII white space, as they are."""
    place: dict[bytes, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in t.encode().split()], dtype=np.int64) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    word = np.array([xxhash.xxh64_intdigest(w, 7) for w in place], dtype=np.uint64)[np.concatenate(rows)] if place else np.zeros(0, np.uint64)
    since = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, ends, h = [word], [np.arange(len(word))], word
    for n in range(1, order):
        h = _mix(h[:-1], word[n:])
        last = np.arange(n, n + len(h))
        inside = since[last] >= n
        hashes.append(h[inside]), ends.append(last[inside])
    return sizes, hashes, ends


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, log_score) for every row of docs: the sum over its words of the natural logarithm
    of S(w | words before) = c(before w) / c(before) if c(before w) reaches `least`, else alpha times S
    with one word fewer before; with none before, c(w) / N. Counts are of `corpus`, by default docs.

    A word that the corpus lacks counts as half a word. Texts that are null or hold no word have
    n_words 0 and log_score 0; repeated rows and keys each count and give a row; other columns are
    left out; an empty table gives an empty one."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.lit(0 if corpus is not None else 2).alias("side"))
    if corpus is not None:
        rows = rows.unionByName(corpus.select(F.lit(None).cast(docs.schema[key].dataType).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.lit(1).alias("side")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    bits = max(4, int(np.ceil(np.log2(1 + size * order / 6 / PART_GRAMS))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "text", "side"), F.lit(blocks)))

    def sorted_grams(table: pa.Table, sides: tuple[int, ...]):
        own = np.isin(table.column("side").to_numpy(), sides)
        part = table.filter(pa.array(own))
        sizes, hashes, ends = gram_hashes(part.column("text").to_pylist(), order)
        return part, sizes, ends, [np.unique(h, return_inverse=True, return_counts=True) for h in hashes]

    def ask(table: pa.Table) -> pa.Table:
        """The block's n-grams by part: for each order the steps between their sorted hashes, and counts."""
        block, out = table.column("block")[0].as_py(), []
        for side in np.unique(table.column("side").to_numpy()).tolist():
            _, _, _, grams = sorted_grams(table, (side,))
            cuts = [np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) for h, _, _ in grams]
            for p in range(1 << bits):
                spans = [(h[c[p] : c[p + 1]], n[c[p] : c[p + 1]]) for (h, _, n), c in zip(grams, cuts)]
                if any(len(h) for h, _ in spans):
                    out.append((p, block, side, [x for h, n in spans for x in (_planar(np.diff(h, prepend=np.uint64(0))), _planar(n))]))
        parts, of, sides, held = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(parts, pa.int32()), pa.array(of, pa.int64()), pa.array(sides, pa.int32()), pa.array(held, pa.list_(pa.binary()))], names=["part", "block", "side", "grams"])

    def answer(table: pa.Table) -> pa.Table:
        """Counts in the whole corpus of each asking block's n-grams in this part."""
        sides, grams = table.column("side").to_numpy(), table.column("grams").to_pylist()
        asking = [k for k, s in enumerate(sides) if s != 1]
        counts: list[list[bytes]] = [[] for _ in asking]
        for n in range(order):
            hashes = [np.cumsum(_whole(g[2 * n])) for g in grams]
            weights = np.concatenate([_whole(g[2 * n + 1]).astype(float) * (s != 0) for g, s in zip(grams, sides)])
            known, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, weights, len(known)).astype(np.uint64)
            ends = np.cumsum([0, *map(len, hashes)])
            for into, k in zip(counts, asking):
                into.append(_planar(total[at[ends[k] : ends[k + 1]]]))
        return pa.table([pa.array(table.column("block").to_numpy()[asking]), pa.array(table.column("part").to_numpy()[asking]), pa.array(counts, pa.list_(pa.binary()))], names=["block", "part", "counts"])

    def sum_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        """n_words, the score less the share of ln N, and how often N takes part, for each document."""
        part, sizes, ends, grams = sorted_grams(table, (0, 2))
        held = [x for _, x in sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist()))]
        words = int(sizes.sum())
        counts = []
        for n in range(order):
            c = np.zeros(words)
            if held:
                c[ends[n]] = np.concatenate([_whole(x[n]) for x in held]).astype(float)[grams[n][1]]
            counts.append(c)
        logs, open_, alphas = np.zeros(words), np.ones(words, dtype=bool), np.zeros(words)
        for n in range(order - 1, 0, -1):
            has = np.zeros(words, dtype=bool)
            has[ends[n]] = True
            seen = open_ & has & (counts[n] >= least)
            at = np.flatnonzero(seen)
            logs[at] = np.log(counts[n][at]) - np.log(counts[n - 1][at - 1]) + alphas[at]
            open_ &= ~seen
            alphas[open_ & has] += np.log(alpha)
        logs[open_] = np.log(np.maximum(counts[0][open_], 0.5)) + alphas[open_]
        of = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda w: pa.array(np.bincount(of, w, len(sizes)).astype(float))
        return pa.table([part.column("key"), pa.array(sizes), add(logs), add(open_.astype(float))], names=["key", "n_words", "part_score", "open"])

    kind = rows.schema["key"].dataType
    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block long, side int, grams array<binary>")
    answers = asked.groupBy("part").applyInArrow(answer, "block long, part int, counts array<binary>")
    out = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("part_score", T.DoubleType()), T.StructField("open", T.DoubleType())])
    scored = checkpoint(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, out))
    if corpus is None:
        n = scored.agg(F.sum("n_words")).first()[0]
    else:
        n = corpus.agg(F.sum(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    return scored.select(F.col("key").alias(key), "n_words", (F.col("part_score") - F.col("open") * float(np.log(max(n or 0, 1)))).alias("log_score"))
