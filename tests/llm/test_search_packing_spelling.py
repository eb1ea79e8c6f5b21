"""Packing, spelling variants and lexical search against plain versions, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelode.llm import bag_search, packing, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n int, id int, row int, word string, size int, m int, item string, place int, member int, node string"


def clashing(spark, rows):
    """Rows of (doc_id, text) beside further columns with names that the operators use."""
    return spark.createDataFrame([(k, t, 1, 2, 3, "x", 4, 5, "y", 6, 7, "z") for k, t in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda x: x[0].lower(), text or "")


# lexical search


def plain_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    rows = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    total, df = sum(n for *_, n in rows), Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 25 + 75 * n * len(rows) // total
            s = sum(math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out, key=repr)


def lexical_rows():
    rng = random.Random(5)
    pool = ["alpha", "Beta", "gamma", "delta", "été", "ÉTÉ", "x1", "中文", "the", "THE", "of", "of", "rare", "\x00", "a_b"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    docs = list(enumerate(texts)) + [(200 + k, texts[k % 7]) for k in range(60)]
    docs += [(3, texts[3]), (None, texts[4]), (None, None), (301, ""), (302, " .,; "), (303, "alpha beta " * 20_000)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(6))) for k in range(9)] + [(1, "alpha"), (9, None), (10, ""), (None, "rare beta"), (11, "of of of"), (12, "none here")]
    return docs, items


@pytest.mark.parametrize("most, block", [(500_000, 4096), (12, 4096), (500_000, 1)])
def test_search_equals_plain_scores(spark, monkeypatch, most, block):
    monkeypatch.setattr(bag_search, "MOST_POSTINGS", most)
    monkeypatch.setattr(bag_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(bag_search, "MOST_CELLS", 64)
    docs, items = lexical_rows()
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, rank int, doc_id int")
    for k in (3, 10):
        got = bag_search.search(clashing(spark, docs).repartition(5), asked, k)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_classes_of_equal_bags_keep_their_least_members(spark):
    rows = spark.createDataFrame([(k, 5, [1, 2], [1, 1]) for k in range(50)] + [(None, 5, [1, 2], [1, 1]), (60, 6, [1, 2], [1, 1]), (61, 5, [1], [1]), (62, 5, [], [])], "id long, m long, terms array<int>, tfs array<int>")
    got = {(r.m, tuple(r.terms)): [x.id for x in r.members] for r in bag_search.classes(rows, 3).collect()}
    assert got == {(5, (1, 2)): [0, 1, 2], (6, (1, 2)): [60], (5, (1,)): [61]}


def test_search_without_rows(spark):
    docs, items = clashing(spark, [(1, "alpha")]), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert bag_search.search(docs.limit(0), items).count() == 0
    assert bag_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# packing


def test_pieces_are_the_librarys_and_sequences_whole(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(9)
    docs = [(k, " ".join(rng.choice(["the", "token", "Étude", "xyzzy", "12", "ing"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs += [(None, None), (None, "no key"), (5, docs[5][1]), (900, ""), (901, "long one " * 700), (902, docs[7][1])]
    packed = packing.pack(clashing(spark, docs), PATH, size=64, ids=True).cache()
    rows = packed.collect()
    want = Counter()
    for k, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((k, a // 64, a, tuple(ids[a : a + 64])) for a in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in rows) and max(map(len, whole.values())) <= 64
    assert len(whole) == packing.least_bins(Counter(r.length for r in rows), 64)
    assert packing.pack(clashing(spark, docs).limit(0), PATH).count() == 0


def optimum(lengths, size):
    """Bins of the best packing, by trying each piece in each open bin."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_plans_hold_all_pieces_and_come_near_the_optimum():
    rng, total = random.Random(2), Counter()
    for case in range(150):
        size = rng.choice([10, 20, 60])
        lengths = sorted((rng.randint(1, size) if case % 2 else rng.randint(size // 5, size // 2) for _ in range(rng.randint(1, 11))), reverse=True)
        own, best = Counter(lengths), optimum(lengths, size)
        first = packing.best_fit(own, size)
        last = packing.exchanged(first, size, packing.least_bins(own, size))
        for bins in (first, last):
            held = Counter()
            for b, n in bins.items():
                assert packing.filled(b) <= size and n > 0
                for x, k in b:
                    held[x] += k * n
            assert held == own
        n = {"least": packing.least_bins(own, size), "best": best, "last": sum(last.values()), "first": sum(first.values())}
        assert n["least"] <= n["best"] <= n["last"] <= n["first"]
        total.update(n)
    assert total["last"] <= total["first"] and total["last"] <= 1.01 * total["best"]


def test_exchanges_free_bins():
    lengths = {44: 1000, 24: 2000, 22: 1000, 21: 1000, 17: 2000, 8: 2000, 6: 2000}
    bins, least = packing.best_fit(lengths, 100), packing.least_bins(lengths, 100)
    after = packing.exchanged(bins, 100, least)
    assert sum(bins.values()) > sum(after.values()) >= least
    squares = lambda x: sum(packing.filled(b) ** 2 * n for b, n in x.items())
    assert squares(after) > squares(bins)


def test_a_length_that_all_pieces_have(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = spark.range(400).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5 + 1).cast("long").alias("length"))
    got = packing.numbered(rows).collect()
    for n in {r.length for r in got}:
        own = sorted(r.number for r in got if r.length == n)
        assert own == list(range(len(own)))


# spelling variants


def plain_variants(docs):
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("levels", [64, 8])
def test_variants_equal_a_plain_version(spark, monkeypatch, levels):
    monkeypatch.setattr(spelling, "MOST_LEVELS", levels)
    rng = random.Random(4)
    roots = ["aabbcc", "aabbccd", "garden", "Gärtner", "straße", "aaaaaa", "bananas", "naïveté", "letters" * 4, "q" * 70]
    words = []
    for w in roots:
        words += [w] * 400
        for _ in range(14):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            edited = w[:at] + rng.choice("abcénx") * (kind > 0) + w[at + (kind != 1) :]
            words += [edited] * rng.randint(3, 90)
    rng.shuffle(words)
    docs = [(k, rng.choice([" ", "-", "7", "中"]).join(words[k::40])) for k in range(40)] + [(None, "garden " * 30), (None, None), (90, ""), (91, "gardens " * 20_000), (91, "gardens gardem garden")]
    got = spelling.variants(clashing(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == plain_variants(docs)
    assert got.count() == len(plain_variants(docs))


@pytest.mark.parametrize("levels", [64, 4])
def test_neighbours_of_short_words(spark, monkeypatch, levels):
    monkeypatch.setattr(spelling, "MOST_LEVELS", levels)
    rng = random.Random(6)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(160)} | {"aaaaaa", "aaaaa", "a"}
    cuts = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    near = lambda a, b: a in cuts[b] or b in cuts[a] or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in words for b in words if near(a, b)}


def test_chains_of_forms_and_empty_tables(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [("a", "b")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{k}": "w9" for k in range(9)} | {"a": "b"}
    assert spelling.variants(clashing(spark, [(1, "word")]).limit(0)).count() == 0
    assert spelling.variants(clashing(spark, [(1, "word"), (2, None)])).count() == 0
