"""Spelling variants: words of a corpus that differ by one edit, found over a distributed trie.

Every prefix of a word is a node, and the edge table has a row for each with its parent, its sign and
the signs that follow it. States (word, position, node, edits) join the edges level by level: they
match the next sign, or, once, take another sign, one more or one less. States with an edit whose next
sign no edge bears aren't made. Those that end on a word are its neighbours. Words go through the trie
forwards for edits in their second half, and backwards for those in the first, so that a state starts
at the node of half a word, where few edges are left, and no level is crowded.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.arrow_batches import by_size
from pagelode.llm.components import checkpoint, shared_folder, stored

#: Signs of a word.
SIGNS = "A-Za-zÀ-ÿ"
#: One occurrence in so many loses a sign; least code points and occurrences of a word; how many times as
#: frequent a form has to be.
LOSES, LEAST_SIGNS, LEAST_USES, TIMES = 199, 6, 5, 5
#: Code points up to which words go through the trie, a level each; longer ones meet by equal halves.
MOST_LEVELS = 64
#: Distinct words that a task counts before it passes them on.
KEPT_WORDS = 500_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", loses: int = LOSES, signs: int = LEAST_SIGNS, uses: int = LEAST_USES) -> DataFrame:
    """(word, n) of the runs of letters, A-Z in lower case, after the runs that a checksum of key and run
    picks have lost a sign; words of `signs` code points and `uses` occurrences at least."""
    find = regex.compile(f"[{SIGNS}]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in by_size(batches, text):
            keys = batch.column(key).to_pylist()
            for k, raw in zip(keys, batch.column(text).cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                start = zlib.crc32(("" if k is None else k).encode() + b":")
                for word, n in Counter(find(raw.lower().decode())).items():  # bytes.lower() changes A-Z alone
                    if len(word) >= signs:
                        h = zlib.crc32(word.encode(), start)
                        if h % loses == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < signs:
                                continue
                        total[word] += n
            if len(total) > KEPT_WORDS:
                yield rows()
                total.clear()
        if total:
            yield rows()

    counted = docs.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= uses)


def directed(words: DataFrame) -> DataFrame:
    """(word, half): each word forwards behind a `>` and backwards behind a `<`, and the place from which
    edits count."""
    half = lambda n: F.expr(f"least(1 + {n} div 2, greatest(1, length(word) - 1))").alias("half")
    ways = F.array(F.struct(F.concat(F.lit(">"), "word").alias("word"), half("length(word)")), F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("word"), half("(length(word) + 1)")))
    return words.where(F.length("word") > 0).select(F.explode(ways).alias("x")).select("x.word", F.col("x.half").cast("int").alias("half"))


def edges(words: DataFrame, first: int) -> DataFrame:
    """(depth, parent, sign, child, after, ends): a row for each distinct prefix of `first` signs or more, with
    the signs that follow it, at most 90, and whether it is a word."""
    size = F.length("word")
    cut = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(first), size)).alias("depth"))
    rows = cut.select("depth", F.expr("left(word, depth)").alias("child"), F.expr("substring(word, depth + 1, 1)").alias("next"), (F.col("depth") == F.col("size")).alias("ends"))
    merged = rows.groupBy("depth", "child").agg(F.array_join(F.collect_set("next"), "").alias("after"), F.max("ends").alias("ends"))
    return merged.select("depth", F.expr("left(child, depth - 1)").alias("parent"), F.expr("right(child, 1)").alias("sign"), "child", "after", "ends")


def trie_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) among words of MOST_LEVELS code points at most: each level's states are written, and the
    ends are read from all of them."""
    spark, words = words.sparkSession, stored(directed(words.select("word")))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    first, deepest = words.agg(F.min("half"), F.max(F.length("word"))).first()
    if deepest is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    edges(words, first + 1).write.partitionBy("depth").parquet(f"{folder}/edges")
    table = spark.read.parquet(f"{folder}/edges")
    start = words.select("word", F.col("half").alias("at"), F.expr("left(word, half)").alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("ends"))
    state = start.schema
    sign = lambda k: F.expr(f"substring(word, at + {k + 1}, 1)")
    before = None
    for depth in range(first + 1, deepest + 2):
        level = table.where(F.col("depth") == depth).drop("depth")
        now = start.where(F.col("at") == depth - 1)
        if before is not None:
            now = now.union(before)
        # without an edit a state goes over all edges of its node, with one over that of its next sign alone
        met = now.where("edits = 0").drop("ends").join(level, F.col("node") == F.col("parent"))
        own, over = F.col("sign") == sign(0), F.col("at") == F.length("word")
        goes_on = lambda n: F.when(F.col("at") + n == F.length("word"), F.col("ends")).otherwise(F.instr("after", sign(n)) > 0)
        step = lambda go, n, edits: F.when(go, F.struct((F.col("at") + n).alias("at"), F.lit(edits).alias("edits")))
        same = F.array(step(F.lit(True), 1, 0))
        other = F.array(step(~over & goes_on(1), 1, 1), step(goes_on(0), 0, 1), step((F.col("sign") == sign(1)) & goes_on(2), 2, 1))
        moved = met.select("word", F.explode(F.array_compact(F.when(own, same).otherwise(other))).alias("s"), F.col("child").alias("node"), "ends").select("word", "s.at", "node", "s.edits", "ends")
        on = now.where("edits = 1").select("word", (F.col("at") + 1).alias("at"), F.concat("node", sign(0)).alias("child"), F.lit(1).alias("edits"))
        went = on.join(level.select("child", "ends", "after"), "child").where(goes_on(0)).select("word", "at", F.col("child").alias("node"), "edits", "ends")
        moved.unionByName(went).write.parquet(f"{folder}/states/level={depth}")
        before = spark.read.schema(state).parquet(f"{folder}/states/level={depth}")
    states = spark.read.schema(state).parquet(f"{folder}/states")
    left = F.length("word") - F.col("at")
    ended = (F.col("edits") == 1) & (left == 0) | (F.col("edits") == 0) & (left == 1)  # the last sign left off
    plain = lambda c: F.when(F.startswith(c, F.lit(">")), F.substring(c, 2, MOST_LEVELS + 1)).otherwise(F.reverse(F.substring(c, 2, MOST_LEVELS + 1)))
    return states.where(ended & F.col("ends")).select(plain("word").alias("word"), plain("node").alias("near")).where("word <> near").distinct()


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) with a word of more than MOST_LEVELS code points among the two. Of two words, the longer
    of m code points, one edit leaves the first or the last (m - 1) / 2 of both as they are."""
    rows = words.where(F.length("word") >= MOST_LEVELS).select("word", F.length("word").alias("size"))
    longer = rows.select("word", "size", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("m")).where(F.col("m") > MOST_LEVELS)
    half = F.expr("(m - 1) div 2").cast("int")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.left("word", half).alias("half")), F.struct(F.lit(1).alias("side"), F.right("word", half).alias("half"))))
    keyed = longer.select("word", "size", "m", halves.alias("x")).select("word", "size", "m", "x.side", F.sha2("x.half", 256).alias("half"))
    a, b = keyed, keyed.select(F.col("word").alias("near"), F.col("size").alias("size_b"), "m", "side", "half")
    met = a.join(b, ["m", "side", "half"]).where((F.greatest("size", "size_b") == F.col("m")) & (F.col("word") != F.col("near")))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): both orders of all pairs of words one inserted, deleted or replaced code point apart."""
    short = trie_neighbours(words.where(F.length("word") <= MOST_LEVELS))
    return short.unionByName(long_neighbours(words)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the last of its chain of forms. Each round takes a root's own
    root, so that chains halve; forms are several times as frequent as their words, so that chains end."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = checkpoint(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if not new.where("moved").take(1):
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus: its most frequent near word, if that
    is `times` as frequent (ties: the least in code-point order), else null; the last of the chain of
    forms, the word itself if there is none; its occurrences, its near words and those of its form.

    Null and empty texts have no words; very long texts are read whole; words of any length count. A null
    key is the empty string in the checksum; repeated rows each count; other columns, of any name, are
    left out; an empty table gives an empty one."""
    words = stored(word_counts(docs, key, text))
    near = neighbours(words).join(words.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    big = -F.col("best.less") >= times * F.col("n")
    rows = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(big, F.col("best.near")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
