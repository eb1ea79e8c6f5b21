import random

import numpy as np

from pagelode.llm import decontaminate as d


def brute(segment, codes, most):
    """Fewest edits of a segment against any region of a text, by the full table."""
    row = np.zeros(len(codes) + 1, dtype=int)
    for i, c in enumerate(segment):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(len(codes)):
            new[j + 1] = min(row[j] + (codes[j] != c), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min()) if row.min() <= most else None


def edited(text, n, rng):
    for _ in range(n):
        at = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("xyz q") + text[at:], text[:at] + rng.choice("xyzq") + text[at + 1 :]])
    return text


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_find_equals_brute_force():
    rng = random.Random(5)
    items = [(k, words(rng, rng.choice([4, 12, 30, 60]))) for k in range(12)]
    index = d.Index(items)
    for k in range(40):
        own = items[k % 12][1]
        text = words(rng, rng.randint(0, 40)) + "  " + edited(own, rng.choice([0, 1, 3, 6, 12, 25]), rng) + "\n" + words(rng, rng.randint(0, 30))
        codes, _ = d.normal(text)
        found = {s: e for s, _, _, e in index.find(codes)}
        for s, segment in enumerate(index.codes):
            assert found.get(s) == brute(segment, codes, index.edits[s])


def test_rows(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank at noon today"
    docs = spark.createDataFrame([(1, "É  " + item.upper() + " tail", 9), (2, "clean text", 9), (3, None, 9), (4, "", 9), (5, item.replace("quick", "quik"), 9), (5, item, 9)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "tiny")], "item_id long, text string")
    got = sorted(map(tuple, d.contamination(docs, bench).collect()))
    assert got == [(1, 7, 3, 3 + len(item), 0), (5, 7, 0, len(item) - 1, 1), (5, 7, 0, len(item), 0)]
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [2, 3, 4]
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert d.contamination(docs, bench.limit(0)).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == 6
