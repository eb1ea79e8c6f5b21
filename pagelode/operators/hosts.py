"""Host names: validity, public suffixes, registrable domains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that are no public suffix.
RESERVED = ("localhost", "local", "lan", "internal", "test", "invalid", "example", "onion", "arpa")
#: Some public suffixes, those of registries and those of hosting services. A full list is a
#: table that suffix_rules() reads.
REGISTRY_SUFFIXES = "com net org info biz edu gov io dev app de fr es it nl uk co.uk org.uk ac.uk gov.uk jp co.jp ne.jp *.kawasaki.jp !city.kawasaki.jp au com.au net.au br com.br in co.in *.ck !www.ck"
SERVICE_SUFFIXES = "github.io gitlab.io pages.dev netlify.app vercel.app web.app firebaseapp.com herokuapp.com blogspot.com cloudfront.net s3.amazonaws.com azurewebsites.net"


def suffix_rules(spark: SparkSession, registry: str = REGISTRY_SUFFIXES, service: str = SERVICE_SUFFIXES) -> DataFrame:
    """(rule, private): suffix rules in the notation of the public list: `*.` for any label, `!` for an
    exception."""
    rows = [(r, False) for r in registry.split()] + [(r, True) for r in service.split()]
    return spark.createDataFrame(rows, "rule string, private boolean")


@F.pandas_udf(T.StringType())
def _punycode(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hosts with other than ASCII letters in their ASCII form; null where there is none."""

    def one(host: str | None) -> str | None:
        try:
            return host and ".".join(label.encode("idna").decode() if label else "" for label in host.split("."))
        except UnicodeError:
            return None

    for batch in hosts:
        yield batch.map(one, na_action="ignore")


def parsed_input(names: DataFrame, column: str = "input") -> DataFrame:
    """names with (host, port, error) as a form takes them: scheme, path, port and a last dot off, ASCII
    form; error says why there is no host. Only names outside ASCII pass through Python."""
    s = F.trim(F.col(column))
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^/*([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    bare = F.regexp_replace(F.lower(F.trim(F.when(port != "", F.regexp_replace(authority, r":\d+$", "")).otherwise(authority))), r"\.$", "")
    rows = names.withColumns({"_s": s, "_scheme": scheme, "_authority": authority, "_port": F.try_to_number(F.nullif(port, F.lit("")), F.lit("9999999999")).cast("long"), "_bare": bare})
    ascii = F.col("_bare").rlike(r"^[\x00-\x7F]*$")
    plain, other = rows.where(ascii | F.col("_bare").isNull()).withColumn("_host", F.col("_bare")), rows.where(~ascii).withColumn("_host", _punycode("_bare"))
    h = F.col("_host")
    labels = F.split(h, r"\.")
    error = (
        F.when(F.col("_s").isNull() | (F.col("_s") == ""), "empty")
        .when(F.length("_s") > 2048, "too long")
        .when(~F.col("_scheme").isin("", "http", "https"), "scheme")
        .when(F.contains("_authority", F.lit("@")), "credentials")
        .when(F.startswith("_authority", F.lit("[")), "address")
        .when(~F.coalesce(F.col("_port").between(1, 65535), F.lit(True)), "port")
        .when(F.col("_bare") == "", "empty")
        .when(F.col("_bare").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains("_bare", F.lit(":")), "address")
        .when(h.isNull() | (F.length(h) > 253) | h.rlike(r"[\x00-\x20\x7f]"), "not a name")
        .when(F.element_at(labels, -1).isin(*RESERVED), "reserved")
        .when(F.size(labels) < 2, "no domain")
        .when(F.exists(labels, lambda x: x == ""), "empty label")
        .when(F.exists(labels, lambda x: F.length(x) > 63), "long label")
        .when(F.exists(labels, lambda x: ~x.rlike("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$")), "characters")
    )
    out = plain.unionByName(other).withColumn("error", error)
    own = lambda c: F.when(F.col("error").isNull(), c)
    return out.withColumns({"host": own(h), "port": own(F.col("_port"))}).drop("_s", "_scheme", "_authority", "_port", "_bare", "_host")


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, suffix, domain, subdomain, private, known) of each distinct host: its public suffix by the
    longest rule, an exception before all; the label before it; what is left. A host under no rule has
    its last label as suffix; one that is a suffix itself has no domain.

    Each name meets the rules by its tails, so that the list may be of any size."""
    names = hosts.select(F.lower(host).alias("host")).where("host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    tail = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    tails = names.select("host", F.size("labels").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(i.alias("at"), tail(i).alias("tail")))).alias("x")).select("host", "n", "x.at", "x.tail")
    kinds = rules.select(
        "private", F.regexp_replace("rule", r"^(!|\*\.)", "").alias("tail"),
        F.when(F.startswith("rule", F.lit("!")), "exception").when(F.startswith("rule", F.lit("*.")), "wild").otherwise("plain").alias("kind"),
    )
    met = tails.join(kinds, "tail")
    # labels of the suffix: a wildcard takes one more than its tail, an exception one less
    size = F.col("n") - F.col("at") + 1 + F.when(F.col("kind") == "wild", 1).when(F.col("kind") == "exception", -1).otherwise(0)
    fits = met.withColumn("size", size).where("size <= n and size > 0")
    best = fits.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("first"), "size", "private")).alias("b"))
    rows = names.join(best, "host", "left").withColumns({"known": F.col("b").isNotNull(), "k": F.coalesce("b.size", F.lit(1)), "n": F.size("labels")})
    from_ = lambda start, length: F.array_join(F.slice("labels", start, length), ".")
    has = F.col("n") > F.col("k")
    return rows.select(
        "host", from_(F.col("n") - F.col("k") + 1, F.col("k")).alias("suffix"), F.when(has, from_(F.greatest(F.col("n") - F.col("k"), F.lit(1)), F.col("k") + 1)).alias("domain"),
        F.when(F.col("n") > F.col("k") + 1, from_(F.lit(1), F.greatest(F.col("n") - F.col("k") - 1, F.lit(0)))).alias("subdomain"), F.coalesce("b.private", F.lit(False)).alias("private"), "known",
    )
