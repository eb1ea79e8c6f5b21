"""The registered queries of this subpackage: thin digests of the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import backoff_lm, bag_search, bpe, chat_hmm, compact_windows, decontaminate, packing, pivot_search, quality_trees, secret_ledger, simhash, spelling, token_counts

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by a ledger that starts empty."""
    found = secret_ledger.find_secrets(table(spark, sf_dir, "documents"))
    spans = secret_ledger.span_text(F.col("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


QUERIES["op7_secret_scan"] = op7_secret_scan
_ASSIGN = secret_ledger.RULES[0].pattern.replace("'", "''")
ORACLES["op7_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, 'assign' AS kind, 0 AS o, 6 AS need, regexp_extract_all(t, '{_ASSIGN}', 0) AS m,
         regexp_extract_all(t, '{_ASSIGN}', 2) AS g, string_split_regex(t, '{_ASSIGN}') AS p FROM d
  UNION ALL
  SELECT doc_id, 'access', 1, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT doc_id, 'hex', 2, 24, regexp_extract_all(t, '[0-9a-f]{{24,}}', 0), regexp_extract_all(t, '[0-9a-f]{{24,}}', 0), string_split_regex(t, '[0-9a-f]{{24,}}') FROM d),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
x AS (SELECT doc_id, kind, o, length(m[i]) AS n,
        list_sum([length(y) for y in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) AS st
      FROM s WHERE length(g[i]) >= need),
a AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
        string_agg(kind || ':' || CAST(st AS BIGINT) || ':' || CAST(st + n AS BIGINT), ',' ORDER BY st, o) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoded text, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op5_bpe_round_trip"] = op5_bpe_round_trip


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether they pass a context of 2048."""
    import public_tokenizers

    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES["op8_token_counts"] = op8_token_counts


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op6_simhash"] = op6_simhash


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by trees that the labels outside the held-out third taught."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_trees.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_trees.score(docs, trees)
    return scored.select("doc_id", quality_trees.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op3_quality"] = op3_quality


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op1_decontamination"] = op1_decontamination


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all rows for every fiftieth vector."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op9_top_k"] = op9_top_k
ORACLES["op9_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.n <> v.n AND len(q.c) = len(v.c)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram stupid-backoff score of every document by the counts of all documents."""
    scored = backoff_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


QUERIES["op2_lm_score"] = op2_lm_score
ORACLES["op2_lm_score"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
b AS (SELECT r, w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM t),
c1 AS (SELECT w, count(*) AS c FROM b GROUP BY w),
c2 AS (SELECT p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY p, w),
n AS (SELECT count(*) AS n FROM b),
s AS (
  SELECT b.r, CASE WHEN c2.c >= 2 THEN ln(c2.c) - ln(cp.c) ELSE ln(c1.c) - ln(n.n) + CASE WHEN b.p IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM b CROSS JOIN n JOIN c1 ON b.w = c1.w LEFT JOIN c2 ON b.p = c2.p AND b.w = c2.w LEFT JOIN c1 AS cp ON b.p = cp.w),
g AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score FROM d LEFT JOIN g USING (r)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents nearly share."""
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES["op10_substring_dedup"] = op10_substring_dedup


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of every conversation, roles recovered; a third of them taught nothing."""
    turns = table(spark, sf_dir, "conversations")
    model = chat_hmm.fit(turns.where(~F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))))
    return chat_hmm.format_chats(turns, model)


QUERIES["op4_chat_format"] = op4_chat_format


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op13_lexical_search"] = op13_lexical_search
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{bag_search.GAPS}]+')"
ORACLES["op13_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark),
v AS (SELECT DISTINCT t FROM q),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) JOIN v USING (t) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(s.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY t),
x AS (SELECT i, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * s.n) // s.l)))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (r) CROSS JOIN s GROUP BY i, item_id, r),
k AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 4096."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op11_best_fit_packing"] = op11_best_fit_packing


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of six letters that occurs five times."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """The table of CRC-32 by its polynomial, for the SQL twin."""
    rows = list(range(256))
    for _ in range(8):
        rows = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in rows]
    return rows


QUERIES["op12_spelling_variants"] = op12_spelling_variants
ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS t),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(x, '[{spelling.SIGNS}]+')) AS w FROM d),
c AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS b FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || b[2 * i - 1:2 * i]) AS BIGINT) for i in range(1, length(b) // 2 + 1)]),
         lambda a, y: xor(a >> 8, t.t[(xor(a, y) & 255) + 1]))) AS h FROM c CROSS JOIN t),
o AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:CAST(h % length(w) AS INTEGER)] || w[CAST(h % length(w) AS INTEGER) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(0, length(word))) AS k FROM v),
x AS (SELECT word, n, k, word[1:CAST(k AS INTEGER)] || word[CAST(k AS INTEGER) + 2:] AS cut FROM i),
e AS (
  SELECT a.word, b.word AS near FROM x AS a JOIN x AS b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word FROM x AS a JOIN v AS b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM x AS a JOIN v AS b ON a.cut = b.word),
m AS (SELECT e.word, near, v.n AS m, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, near) AS k, count(*) OVER (PARTITION BY e.word) AS n_near FROM e JOIN v ON e.near = v.word),
f AS (SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.m >= 5 * v.n THEN near END AS form, CASE WHEN m.m >= 5 * v.n THEN m.m END AS form_n FROM v LEFT JOIN m ON v.word = m.word AND m.k = 1),
p(word, stop, next) AS (SELECT word, word, form FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON p.next = f.word)
SELECT f.word, f.form, p.stop AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON f.word = p.word AND p.next IS NULL
"""
