"""What the operators make of odd rows, by value: nulls, blanks, a very long text, repeated rows and keys."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagelode.llm import backoff_lm, bag_search, bpe, chat_hmm, decontaminate, packing, pivot_search, quality_trees, secret_ledger, simhash, spelling, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "long words repeat here, token = abcdef123 " * 3000
ROWS = [(1, "Some plain text, as it is."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (6, LONG), (None, "no key here"), (None, None)]
CLASHES = ("score", "ids", "block", "word", "fp", "key", "value", "label", "blob", "doc", "a", "b", "start", "_blob", "path", "row", "id", "n", "m", "item", "rank", "size", "edits")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def by_row(rows):
    return sorted(rows, key=repr)


def test_tokens(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    assert by_row((r.doc_id, r.ids) for r in bpe.encode(docs, PATH).collect()) == by_row((k, x) for (k, _), x in zip(ROWS, ids))
    assert by_row(map(tuple, token_counts.token_counts(docs, PATH).collect())) == by_row((k, len((t or "").encode()), len(x)) for (k, t), x in zip(ROWS, ids))
    packed = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    want = {}
    for (k, _), x in zip(ROWS, ids):
        n, p = want.get(k, (0, 0))
        want[k] = n + len(x) + 1, p + -(-(len(x) + 1) // 4096)
    assert {r.doc_id: (r.n, r.pieces) for r in packed} == want


def test_fingerprints(docs):
    got = by_row((r.doc_id, r.fp == 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    # texts without words share fingerprint zero, null keys among them; the long texts are one group
    assert [x for x in got if x[0] in (2, 3, 4)] == [(2, True, 2), (3, True, 2), (4, True, 2)]
    assert [x for x in got if x[0] in (5, 6)] == [(5, False, 5), (6, False, 5), (6, False, 5)]
    assert [x for x in got if x[0] == 1] == [(1, False, 1)] and len(got) == len(ROWS)


def test_secrets(docs):
    spans = [m.span() for m in re.finditer("token = abcdef123", LONG)]
    digest = hashlib.sha256(",".join(f"assign:{a}:{b}" for a, b in spans).encode()).hexdigest()
    found = secret_ledger.find_secrets(docs).select("path", F.sha2(secret_ledger.span_text(F.col("spans")), 256).alias("s")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert by_row((r.path, r.s) for r in found) == by_row((k, digest if t == LONG else empty) for k, t in ROWS)
    masked = secret_ledger.redact(docs).select("doc_id", "text", "score").collect()
    assert by_row((r.doc_id, r.text) for r in masked if r.doc_id not in (5, 6)) == by_row((k, t) for k, t in ROWS if t != LONG)
    assert all("abcdef123" not in r.text and len(r.text) > 50_000 and r.score == 7 for r in masked if r.doc_id in (5, 6))


def test_scores(docs, spark):
    words = {k: len((t or "").split()) for k, t in ROWS if k is not None}
    scored = backoff_lm.score(docs).collect()
    assert all(r.n_words == words[r.doc_id] and (r.log_score < 0) == (r.n_words > 0) for r in scored if r.doc_id is not None) and len(scored) == len(ROWS)
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    quality = quality_trees.score(docs, quality_trees.fit(docs, labels)).collect()
    assert len(quality) == len(ROWS) and all(0 <= r.score <= 1 for r in quality) and len({r.score for r in quality if r.doc_id in (2, 3)}) == 1


def test_leaks(docs, spark):
    item = "long words repeat here, token = abcdef123 " * 4
    benchmark = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, item, 1), (3, item, 1), (None, item, 1)], "item_id long, text string, start int")
    found = decontaminate.contamination(docs, benchmark).select("doc_id", "item_id", "edits").collect()
    assert by_row(map(tuple, found)) == [(5, 3, 0), (6, 3, 0), (6, 3, 0)]
    kept = decontaminate.clean(docs, benchmark)
    assert by_row((r.doc_id, r.text) for r in kept.collect()) == by_row((k, t) for k, t in ROWS if t != LONG) and kept.columns == docs.columns


def test_words_and_search(docs, spark):
    got = {r.word: r.n for r in spelling.variants(docs).collect()}
    assert set(got) >= {"repeat", "abcdef"} and sum(got.values()) > 17_900
    items = spark.createDataFrame([(1, "plain text"), (2, None), (3, "here key")], "item_id long, text string")
    found = bag_search.search(docs, items).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in found if r.item_id == 1] == [(1, 1, 1)]
    assert [(r.rank, r.doc_id) for r in found if r.item_id == 3][0] == (1, None) and {r.doc_id for r in found if r.item_id == 3} <= {None, 5, 6}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0]), (None, [9.0, 9.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 7) for k, v in rows], "vec_id long, embedding array<double>, score int")
    got = by_row(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()))
    # of equal scores the smaller id goes first; a repeated id is a candidate twice
    assert got == by_row([(0, 1, 2, 65536), (0, 2, 2, 65536), (0, 3, 1, 32768), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)])


def test_conversations(spark):
    rows = [(1, 0, "user", "User: hi there"), (1, 1, "assistant", "Assistant: hello"), (1, 1, "assistant", "Assistant: hello"), (2, None, None, None), (2, 0, None, ""), (None, 0, None, "alone"), (3, 0, "user", "User: " + "word " * 30_000)]
    turns = spark.createDataFrame([(*r, 7, 7) for r in rows], "conv_id long, turn long, role string, text string, part int, content int")
    model = chat_hmm.fit(turns)
    got = chat_hmm.format_chats(turns, model).collect()
    assert by_row((r.conv_id, r.content) for r in got if r.conv_id != 3) == by_row([(1, "hi there"), (1, "hello"), (1, "hello"), (2, ""), (2, ""), (None, "alone")])
    assert [len(r.content.split()) for r in got if r.conv_id == 3] == [30_000] and all(r.rendered == f"<|im_start|>{r.role}\n{r.content}<|im_end|>" for r in got)
