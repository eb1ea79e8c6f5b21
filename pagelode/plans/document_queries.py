"""Queries over documents: near duplicates, weights, screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators import neardup as nd
from pagelode.operators import screens as sc
from pagelode.operators.lineage import stored
from pagelode.plans import duck as d
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_REPS = f"nt AS (SELECT doc_id, {_NORMAL} AS normal FROM documents), rp AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY normal) AS rep, normal FROM nt)"
_PAIRS = f"""{_REPS},
rs AS (SELECT doc_id AS k, string_split(normal, ' ') AS w FROM rp WHERE doc_id = rep),
sh AS (SELECT DISTINCT k, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS s FROM rs WHERE len(w) >= 5),
nn AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
cm AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM sh AS x JOIN sh AS y ON x.s = y.s AND x.k < y.k GROUP BY ALL),
pr AS (SELECT a, b, common, {d.half_up('CAST(common AS DOUBLE) / (p.n + q.n - common)', 4)} AS jaccard FROM cm JOIN nn AS p ON p.k = a JOIN nn AS q ON q.k = b WHERE CAST(common AS DOUBLE) / (p.n + q.n - common) >= 0.8)"""


def pairs(spark, sf):
    return nd.jaccard_pairs(nd.distinct_sets(docs(spark, sf), "doc_id", "text"), "doc_id")


@query(f"WITH {_REPS} SELECT doc_id, rep FROM rp")
def exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    return nd.representatives(docs(spark, sf), "doc_id", "text")


@query(f"WITH {_PAIRS} SELECT * FROM pr")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """D4 by shingles between representatives of exact copies; exact_copies has the members."""
    return pairs(spark, sf)


@query(f"""WITH RECURSIVE {_PAIRS}, g(u, v) AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(u, v) AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u)
SELECT u AS node, least(u, min(v)) AS cluster FROM r GROUP BY u""")
def dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return nd.clusters(pairs(spark, sf))


_TERMS = f"""wd AS (SELECT doc_id, unnest({d.words('lower(text)')}) AS word FROM documents),
tc AS (SELECT doc_id, word, count(*) AS tf FROM wd WHERE length(word) >= 3 AND word NOT IN ({d.names(tx.STOP_WORDS)}) GROUP BY ALL),
dn AS (SELECT count(DISTINCT doc_id) AS n FROM tc), df AS (SELECT word, count(*) AS df FROM tc GROUP BY word),
tw AS (SELECT tc.doc_id, tc.word, tf, tf * (ln((dn.n + 1) / CAST(df.df + 1 AS DOUBLE)) + 1) AS weight FROM tc JOIN df ON tc.word = df.word CROSS JOIN dn)"""


@query(f"WITH {_TERMS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, word) AS rank FROM tw) SELECT doc_id, CAST(rank AS INTEGER) AS rank, word, round(weight, 6) AS weight FROM k WHERE rank <= 3")
def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = nd.tf_idf(nd.term_counts(docs(spark, sf), "doc_id", "text"), "doc_id").withColumn("weight", F.round("weight", 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word"))
    return rows.withColumn("rank", rank).where("rank <= 3").select("doc_id", "rank", "word", "weight")


@query(f"""WITH {_PAIRS}, {_TERMS}, nm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY doc_id),
dt AS (SELECT a, b, sum(x.weight * y.weight) AS dot FROM pr JOIN tw AS x ON x.doc_id = a JOIN tw AS y ON y.doc_id = b AND x.word = y.word GROUP BY a, b)
SELECT a, b, round(dot / (p.norm * q.norm), 6) AS cosine FROM dt JOIN nm AS p ON p.doc_id = a JOIN nm AS q ON q.doc_id = b""")
def near_dup_cosine(spark: SparkSession, sf: str) -> DataFrame:
    found = stored(pairs(spark, sf))
    w = stored(nd.paired_weights(docs(spark, sf), found, "doc_id", "text"))
    return nd.cosines(w, found, "doc_id").withColumn("cosine", F.round("cosine", 6))


_SIM = f"""wd AS (SELECT doc_id, unnest({d.words('lower(text)')}) AS word FROM documents), wc AS (SELECT doc_id, word, count(*) AS n FROM wd GROUP BY ALL), dw AS (SELECT DISTINCT word FROM wc),
hw AS (SELECT word, list_reduce(list_prepend(CAST(0 AS HUGEINT), [CAST(unicode(c) AS HUGEINT) for c in string_split(word, '')]), lambda a, b: (a * 31 + b) % 18446744073709551616) AS h FROM dw),
bt AS (SELECT wc.doc_id, k, sum(CASE WHEN (h // (CAST(1 AS HUGEINT) << k)) % 2 = 1 THEN n ELSE -n END) AS v FROM wc JOIN hw ON wc.word = hw.word CROSS JOIN range(64) AS t(k) GROUP BY ALL),
sg AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 AND k >= 32 THEN CAST(1 AS BIGINT) << (k - 32) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN v > 0 AND k < 32 THEN CAST(1 AS BIGINT) << k ELSE 0 END) AS BIGINT) AS lo FROM bt GROUP BY doc_id)"""


@query(f"WITH {_SIM} SELECT * FROM sg")
def word_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return nd.simhashes(docs(spark, sf), "doc_id", "text")


@query(f"WITH {_PAIRS}, {_SIM} SELECT a, b, bit_count(xor(p.hi, q.hi)) + bit_count(xor(p.lo, q.lo)) AS hamming FROM pr JOIN sg AS p ON p.doc_id = a JOIN sg AS q ON q.doc_id = b")
def near_dup_hamming(spark: SparkSession, sf: str) -> DataFrame:
    found = stored(pairs(spark, sf))
    paired = stored(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    h = stored(nd.simhashes(docs(spark, sf).join(paired, "doc_id", "left_semi"), "doc_id", "text"))
    p, q = (h.toDF(c, f"hi_{c}", f"lo_{c}") for c in "ab")
    bits = F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b"))) + F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b")))
    return found.select("a", "b").join(p, "a").join(q, "b").select("a", "b", bits.alias("hamming"))


_SENT = "[x for x in [trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) for s in (CASE WHEN len(regexp_extract_all(text, '[^.!?]+[.!?]+')) > 0 THEN regexp_extract_all(text, '[^.!?]+[.!?]+') ELSE [text] END)] if length(x) >= 40]"


@query(f"""WITH {_PAIRS}, st AS (SELECT DISTINCT doc_id, unnest({_SENT}) AS s FROM documents)
SELECT a, b, count(*) AS shared FROM pr JOIN st AS x ON x.doc_id = a JOIN st AS y ON y.doc_id = b AND x.s = y.s GROUP BY a, b""")
def shared_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return nd.shared_sentences(docs(spark, sf), pairs(spark, sf), "doc_id", "text")


@query(f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{p}', {h})" for c, p, h in sc.POLICY)}) AS t(category, pattern, least)),
x AS (SELECT doc_id, category, len(regexp_extract_all(text, pattern)) AS hits, least FROM documents CROSS JOIN r)
SELECT doc_id, category, hits, least(95, 50 + 10 * hits) AS confidence FROM x WHERE hits >= least""")
def policy_screen(spark: SparkSession, sf: str) -> DataFrame:
    return sc.policy(docs(spark, sf), "doc_id", "text")


@query("""SELECT doc_id, list_slice(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}')), 1, 0) AS none, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}'))) AS entities FROM documents""".replace("list_slice(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}')), 1, 0) AS none, ", ""))
def named_entities(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.size(sc.entities(F.col("text"))).cast("long").alias("entities"))


@query(f"""SELECT doc_id, array_to_string([x for x in [{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in sc.INTENTS)}] if x IS NOT NULL], ',') AS intents FROM documents""")
def search_intents(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.array_join(sc.intents(F.col("text")), ",").alias("intents"))


@query("""SELECT source, lang, count(*) AS docs, count(*) FILTER (regexp_matches(text, '[\\p{Cyrillic}]')) AS cyrillic, count(*) FILTER (regexp_matches(text, '[\\p{Greek}]')) AS greek, count(*) FILTER (regexp_matches(text, '[àâçéèêëîïôûùüÿœ]')) AS accented FROM documents GROUP BY source, lang""")
def language_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return sc.scripts(docs(spark, sf))


@query("""SELECT doc_id, regexp_matches(text, '(?i)lorem ipsum') AS lorem, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\\+?[0-9][0-9 ()-]{7,}[0-9]')) AS phones FROM documents""")
def contact_signals(spark: SparkSession, sf: str) -> DataFrame:
    return sc.contacts(docs(spark, sf), "doc_id", "text")


@query("""WITH y AS (SELECT doc_id, unnest([CAST(x AS INTEGER) for x in regexp_extract_all(text, '(19[0-9][0-9]|20[0-9][0-9])')]) AS y FROM documents) SELECT doc_id, max(y) AS latest_year, 2025 - max(y) AS age FROM y GROUP BY doc_id""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return sc.freshness(docs(spark, sf), "doc_id", "text", 2025)
