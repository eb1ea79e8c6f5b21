"""The pipeline against a plain version of its stages."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelode.llm import decontaminate, quality_trees
from tests.llm.test_against_brute_force import PATH, plain_fingerprint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def masked(text):
    text = re.sub(r"""(?ai)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", lambda m: m[1] + ("[SECRET]" if len(m[2]) >= 6 else m[2]), text)
    return re.sub("[0-9a-f]{24,}", "[SECRET]", re.sub("AKIA[A-Z0-9]{16,}", "[SECRET]", text))


def test_pipeline_equals_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trees = quality_trees.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    score = trees.score(np.array([quality_trees.statistics(t) for t in texts.values()]))
    left = [k for k, s in zip(texts, score) if s >= 0.5]
    fps = {k: plain_fingerprint(texts[k]) for k in left}
    root = {k: k for k in left}
    for i in left:
        for j in left:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    left = [k for k in left if root[k] == k]
    as_text = lambda codes: codes.tobytes().decode("utf-32-le")
    parts = [as_text(c) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for _, c in decontaminate.segments(decontaminate.normal(r.text.strip())[0])]
    left = [k for k in left if not any(p in as_text(decontaminate.normal(texts[k])[0]) for p in parts)]
    library = Tokenizer.from_file(PATH)
    want = {k: library.encode(masked(texts[k]), add_special_tokens=False).ids for k in left}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(got) < len(texts)


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "token = abcdef123", None, "s", 3), (None, None, None, None, None), (4, "a b c d e", "en", "s", 9), (4, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs
    for c in ("_hit", "_blob", "blob", "masked", "row", "score", "_score", "_rank", "h1", "key", "fp", "cuts", "ids"):
        odd = odd.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        also = stage(spark, odd, DATA)
        assert also.columns == odd.columns, name
        assert all(set(r[5:]) == {"mine"} for r in also.collect()), name
        assert sorted(map(repr, (tuple(r) for r in also.select(*docs.columns).collect()))) == sorted(map(repr, (tuple(r) for r in out.collect()))), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.secrets(spark, docs, DATA).where("text like '%[SECRET]%' and n_chars = 16").count() == 1
    # rows without words are one component; of the two rows of doc_id 4 each has a text of its own
    assert corpus_pipeline.near_duplicates(spark, docs, DATA).count() == 4
    assert corpus_pipeline.near_duplicates(spark, docs.union(docs), DATA).count() == 4
    assert corpus_pipeline.tokens(spark, docs, DATA).count() == 6
