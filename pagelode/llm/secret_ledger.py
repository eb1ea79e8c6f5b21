"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a path is content-addressed by the SHA-256 of its text. A ledger remembers which
(blob, rule, rule version) were scanned and with what findings; a scan runs the patterns over the
unseen pairs alone, once per distinct blob, and joins findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.components import stored


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group `group` has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: Order is that of ties. The last two need no filter: their runs are maximal, so the least length
#: stands in the pattern, which spares the engine the countless shorter runs.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MASK = "[SECRET]"


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text): null texts are empty ones."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def unseen_pairs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): each distinct blob with the kinds whose present version hasn't seen it."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    now = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    seen = ledger.where(F.array_contains(now, F.concat_ws(":", "kind", "rule_version"))).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def _matches(rule: Rule, order: int) -> Column:
    """What one rule matches in `text`: gap since the match before, length, whether it counts; else null."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    held = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), held.alias("g"), F.slice(F.split("text", rule.pattern, -1), 1, F.size(whole)).alias("p")),
        lambda x: F.struct(F.lit(order).alias("rule"), F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("n"), (F.length(x["g"]) >= rule.least).alias("counts")),
    )
    return F.when(F.array_contains("todo", rule.kind) & F.col("text").rlike(rule.pattern), rows)


def scan_pairs(pairs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) of every finding in the pairs; positions in code points, end exclusive.

    Matches are leftmost and don't overlap within a rule: splitting by the pattern gives the gaps
    between them, and running sums of gaps and lengths give their places."""
    empty = F.array().cast("array<struct<rule:int,gap:bigint,n:bigint,counts:boolean>>")
    found = pairs.select("blob", F.concat(*[F.coalesce(_matches(r, k), empty) for k, r in enumerate(rules)]).alias("found")).where(F.size("found") > 0)
    rows = found.select("blob", F.posexplode("found").alias("at", "x")).select("blob", "at", "x.*")
    upto = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return rows.withColumn("end", end).where("counts").select("blob", "rule", (F.col("end") - F.col("n")).alias("start"), "end")


def ledger_entries(pairs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, rule_version, spans) to append to the ledger: a row per pair, clean ones included."""
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.lit(k).alias("rule")) for k, r in enumerate(rules)])
    done = pairs.select("blob", F.explode(F.filter(names, lambda x: F.array_contains("todo", x["kind"]))).alias("x")).select("blob", "x.*")
    spans = findings.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return done.join(spans, ["blob", "rule"], "left").select("blob", "kind", "rule_version", F.coalesce("spans", none).alias("spans"))


def from_ledger(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) that the ledger already holds for the present rule versions."""
    number = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("rule_version") == r.version), k) for k, r in enumerate(rules)])
    return ledger.select("blob", number.alias("rule"), F.explode("spans").alias("s")).where("rule is not null").select("blob", "rule", "s.start", "s.end")


def updated_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger after a scan of docs: the entries it held and, written to the shared folder, those of
    the (blob, rule, version) pairs that it hadn't. A next run takes it as its `ledger`."""
    pairs = unseen_pairs(versions_of(docs, text, text), ledger, rules)
    new = stored(ledger_entries(pairs, scan_pairs(pairs, rules), rules))
    return new if ledger is None else ledger.select(new.columns).unionByName(new)


def _spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the blobs with findings; a table of its own, so that a join can split the paths
    of a blob that a third of them hold."""
    return stored(from_ledger(ledger, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end"))).alias("spans")))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, spans array<struct<start, rule, end>>) for every row of docs, from the ledger after it
    has been brought up to date with docs.

    Null and empty texts have no spans; repeated rows and repeated paths each give their own row;
    an empty table gives an empty one; other columns of docs are ignored. Rows that share a text
    share one scan."""
    by_blob = _spans_by_blob(updated_ledger(docs, ledger, rules, text), rules)
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    return versions_of(docs, path, text).select("path", "blob").join(by_blob, "blob", "left").select("path", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """What to cut from `text` by its `spans`, and the text with these `cuts` replaced by MASK: a rule's
    group where it has one, key words kept. Values that overlap become one mask."""
    held = lambda s, r: F.regexp_extract(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), r.pattern, r.group)

    def value(s: Column) -> Column:
        size = s["end"] - s["start"]
        for k, r in enumerate(rules):
            if r.group:
                size = F.when(s["rule"] == k, F.length(held(s, r)).cast("long")).otherwise(size)
        return F.struct((s["end"] - size).alias("s"), s["end"].alias("e"))

    def merged(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(x["s"] < last["e"], longer).otherwise(F.concat(done, F.array(x)))

    cuts = F.aggregate(F.array_sort(F.transform("spans", value)), F.array().cast("array<struct<s:bigint,e:bigint>>"), merged)
    part = lambda a, b: F.substr("text", (a + 1).cast("int"), (b - a).cast("int"))
    end = lambda k: F.coalesce(F.get("cuts", k)["e"], F.lit(0).cast("long"))
    pieces = F.transform("cuts", lambda x, k: F.concat(part(end(k - 1), x["s"]), F.lit(MASK)))
    return cuts, F.concat(F.array_join(pieces, ""), part(end(F.size("cuts") - 1), F.length("text").cast("long")))


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with every found value replaced by MASK; all rows, columns of any name and null texts stay.

    The ledger's spans are cut once for each distinct text that has any."""
    by_blob = _spans_by_blob(updated_ledger(docs, ledger, rules, text), rules)
    hit = versions_of(docs, text, text).select("blob", "text").join(by_blob, "blob").dropDuplicates(["blob"])
    cuts, masked = _masked(rules)
    clean = stored(hit.withColumn("cuts", cuts).select("blob", masked.alias("masked")))
    whole = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob")).join(clean, "blob", "left")
    own = lambda c: F.col("row").getField(c)
    return whole.select(*[(F.coalesce("masked", own(c)) if c == text else own(c)).alias(c) for c in docs.columns])
