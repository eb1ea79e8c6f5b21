"""Every operator over nulls, empty, blank and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from pagelode.llm import backoff_lm, bpe, chat_hmm, compact_windows, decontaminate, pivot_search, quality_trees, secret_ledger, simhash, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "long words repeat here, token = abcdef123 " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Some plain text, as it is.", 1), (2, None, 2), (3, "", 3), (4, " \n\t ", 4), (5, LONG, 5), (6, LONG, 6), (6, LONG, 6), (None, "no key here", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for name in ("score", "ids", "block", "word", "fp", "key", "value", "label", "blob", "doc", "a", "b", "start", "_blob", "path"):
        df = df.withColumn(name, F.col("n"))
    return df


RUNS = {
    "encode": (lambda d: bpe.encode(d, PATH), 9),
    "round_trip": (lambda d: bpe.decode(bpe.encode(d, PATH), PATH), 9),
    "counts": (lambda d: token_counts.token_counts(d, PATH), 9),
    "simhash": (simhash.near_duplicates, 9),
    "secrets": (secret_ledger.find_secrets, 9),
    "redact": (secret_ledger.redact, 9),
    "lm": (backoff_lm.score, 9),
    "quality": (lambda d: quality_trees.score(d, quality_trees.fit(d, d.sparkSession.createDataFrame([(1, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int"))), 9),
    "clean": (lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, None), (2, "")], "item_id long, text string")), 9),
    "passages": (compact_windows.repeated_passages, None),
}


@pytest.mark.parametrize("name", RUNS)
def test_all_rows_come_back(docs, name):
    run, rows = RUNS[name]
    got = run(docs).collect()
    assert rows is None or len(got) == rows
    if name == "passages":
        assert {(r.doc_id, r.other) for r in got} == {(6, 5)}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, name):
    assert RUNS[name][0](docs.limit(0)).count() == 0


def test_empty_conversations_and_vectors(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_hmm.format_chats(turns, chat_hmm.fit(turns)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(vectors, F.col("vec_id") % 50 == 0).count() == 0
