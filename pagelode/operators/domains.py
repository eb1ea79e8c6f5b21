"""Domains: registrations, records, mail, delivery networks, headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (kind, header or empty, pattern, provider) that speak for a delivery network.
EDGE_PATTERNS = (
    ("cname", "", r"(^|\.)cdn\.cloudflare\.net$", "Cloudflare"), ("cname", "", r"(^|\.)cloudfront\.net$", "Amazon CloudFront"), ("cname", "", r"(^|\.)fastly\.net$", "Fastly"),
    ("cname", "", r"(^|\.)edgekey\.net$|(^|\.)edgesuite\.net$|(^|\.)akamaiedge\.net$|(^|\.)akamaitechnologies\.com$", "Akamai"), ("cname", "", r"(^|\.)b-cdn\.net$", "Bunny CDN"),
    ("header", "server", "cloudflare", "Cloudflare"), ("header", "cf-ray", ".+", "Cloudflare"), ("header", "cf-cache-status", ".+", "Cloudflare"),
    ("header", "server", "cloudfront", "Amazon CloudFront"), ("header", "x-amz-cf-id", ".+", "Amazon CloudFront"), ("header", "via", "varnish", "Fastly"), ("header", "x-fastly-request-id", ".+", "Fastly"),
    ("header", "server", "akamaighost", "Akamai"), ("header", "server", "bunnycdn|bunny", "Bunny CDN"), ("header", "x-vercel-id", ".+", "Vercel"), ("header", "server", "netlify", "Netlify"),
)
#: Who runs a domain's mail, by the name of its exchanger.
MAIL_PROVIDERS = (
    (r"(^|\.)google\.com$|(^|\.)googlemail\.com$", "Google Workspace"), (r"(^|\.)mail\.protection\.outlook\.com$", "Microsoft 365"), (r"(^|\.)pphosted\.com$|(^|\.)proofpointessentials\.com$", "Proofpoint"),
    (r"(^|\.)zoho\.(com|eu|in|com\.au|com\.cn)$", "Zoho Mail"), (r"(^|\.)protonmail\.ch$|(^|\.)proton\.me$", "Proton Mail"), (r"(^|\.)fastmail\.com$|(^|\.)fastmailteam\.com$", "Fastmail"),
)
#: Response headers that a site's safety is judged by.
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy")


def cases(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, pair: F.when(pair[0], F.lit(pair[1])).otherwise(rest), reversed(pairs), F.lit(otherwise))


_ENTITY = "array<struct<roles:array<string>,vcardArray:array<string>>>"
#: Labels under which text answers give a fact, in the order in which they are asked.
WHOIS = {
    "registrar": ("Registrar", "Sponsoring Registrar"), "registered": ("Creation Date", "Registered on", "Created on", "Created"), "updated": ("Updated Date", "Last updated"),
    "expires": ("Registry Expiry Date", "Expiration Date", "Expiry date", "Expires on"), "dnssec": ("DNSSEC",),
}


def _card(card: Column, label: str) -> Column:
    """The first text of a label in a vCard, [["fn", {}, "text", "Name"], ...]; of a list its first text."""
    rows = F.from_json(card, "array<array<string>>")
    value = F.get(F.filter(rows, lambda r: F.lower(F.get(r, 0)) == label), 0)
    last = F.get(value, 3)
    return F.nullif(F.trim(F.coalesce(F.get(F.from_json(F.when(F.startswith(last, F.lit("[")), last), "array<string>"), 0), last)), F.lit(""))


def registrations(answers: DataFrame) -> DataFrame:
    """(domain, source, registered, updated, expires, statuses, registrar, nameservers, dnssec) of registry
    answers (domain, rdap, whois): the JSON answer where there is one, its registrar being the name, else
    the organisation, of the entity with that role; else `Label: value` lines of the text answer."""
    events = F.from_json(F.get_json_object("rdap", "$.events"), "array<struct<eventAction:string,eventDate:string>>")
    said = lambda *actions: F.get(F.filter(events, lambda e: F.lower(e["eventAction"]).isin(*actions)), 0)["eventDate"]
    day = lambda text: F.coalesce(F.try_to_date(F.substring(text, 1, 10)), F.try_to_date(text, "d-MMM-yyyy"), F.try_to_date(F.regexp_extract(text, r"^(\d{1,2}-[A-Za-z]{3}-\d{4})", 1), "d-MMM-yyyy"))
    line = lambda label: F.nullif(F.trim(F.regexp_extract("whois", rf"(?im)^\s*{label}:[ \t]*([^\r\n]+)", 1)), F.lit(""))
    first = lambda fact: F.coalesce(*[line(x) for x in WHOIS[fact]])
    every = lambda label: F.regexp_extract_all("whois", F.lit(rf"(?im)^\s*(?:{label})\s*:[ \t]*(\S+)"), F.lit(1))
    entities = F.from_json(F.get_json_object("rdap", "$.entities"), _ENTITY)
    agent = F.get(F.filter(entities, lambda e: F.exists(e["roles"], lambda r: F.lower(r) == "registrar")), 0)
    card = F.get(agent["vcardArray"], 1)
    hosts = F.from_json(F.get_json_object("rdap", "$.nameservers"), "array<struct<ldhName:string,unicodeName:string>>")
    signed = F.get_json_object("rdap", "$.secureDNS.delegationSigned")
    names = lambda hs: F.array_join(F.array_distinct(F.filter(F.transform(hs, F.lower), lambda h: h != "")), ",")
    statuses = F.array_join(F.from_json(F.get_json_object("rdap", "$.status"), "array<string>"), ",")
    text_dnssec = F.lower(first("dnssec"))
    has = F.col("rdap").isNotNull()
    return answers.select(
        "domain", F.when(has, "rdap").when(F.col("whois").isNotNull(), "whois").otherwise("none").alias("source"),
        F.when(has, day(said("registration"))).otherwise(day(first("registered"))).alias("registered"),
        F.when(has, day(said("last changed", "last update"))).otherwise(day(first("updated"))).alias("updated"),
        F.when(has, day(said("expiration"))).otherwise(day(first("expires"))).alias("expires"),
        F.coalesce(F.when(has, statuses).otherwise(F.array_join(every("Domain Status|Status|state"), ",")), F.lit("")).alias("statuses"),
        F.when(has, F.coalesce(_card(card, "fn"), _card(card, "org"))).otherwise(first("registrar")).alias("registrar"),
        F.coalesce(F.when(has, names(F.transform(hosts, lambda h: F.coalesce(h["ldhName"], h["unicodeName"], F.lit(""))))).otherwise(names(every("Name Server"))), F.lit("")).alias("nameservers"),
        F.when(has, F.when(signed == "true", "signed").when(signed == "false", "unsigned")).otherwise(F.when(text_dnssec.rlike("unsigned"), "unsigned").when(text_dnssec.rlike("signed"), "signed")).alias("dnssec"),
    )


def domain_status(known: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """(domain, status): a registry's own answer before what the zone shows."""
    zone = records.where("type in ('NS', 'SOA')").select("domain").distinct().withColumn("zone", F.lit(True))
    says = lambda pattern: F.lower("statuses").rlike(pattern)
    ok, gone = F.col("source") != "none", F.col("expires") < as_of
    status = cases([
        (ok & gone & says("redemption|pendingdelete"), "expired-redemption"), (ok & gone, "expired"), (ok & says("serverhold|clienthold"), "on-hold"),
        (ok & says("pendingdelete|redemption"), "pending-delete"), (ok, "active"), (F.col("zone").isNotNull(), "registered-dns"),
    ], "unknown")
    return known.join(zone, "domain", "left").select("domain", status.alias("status"))


def dnssec(records: DataFrame) -> DataFrame:
    """(domain, status): enabled with DS and DNSKEY, partial with either or signatures, else none."""
    has = lambda t: F.bool_or(F.col("type") == t)
    seen = records.groupBy("domain").agg(has("DS").alias("ds"), has("DNSKEY").alias("key"), has("RRSIG").alias("sig"))
    return seen.select("domain", cases([(F.col("ds") & F.col("key"), "enabled"), (F.col("ds") | F.col("key") | F.col("sig"), "partial")], "not-detected").alias("status"))


def spf_fields(record: Column) -> tuple[Column, Column]:
    """Mechanisms of an SPF record but its all, and the qualifier of that."""
    parts = F.filter(F.split(F.trim(record), r"\s+"), lambda x: ~F.lower(x).startswith("v=spf1") & (x != ""))
    every = F.get(F.filter(parts, lambda x: x.rlike("(?i)^[+~?-]?all$")), 0)
    rule = F.when(every.isNull(), None).when(F.length(every) == 3, "+").otherwise(F.substring(every, 1, 1))
    return F.size(F.filter(parts, lambda x: ~x.rlike("(?i)^[+~?-]?all$"))).cast("long"), rule


def tag(record: Column, name: str) -> Column:
    """The first value of a tag in a `k=v; k=v` record."""
    return F.nullif(F.regexp_extract(record, rf"(?i)(?:^|;)\s*{name}\s*=\s*([^;]*?)\s*(?:;|$)", 1), F.lit(""))


def mail_posture(records: DataFrame) -> DataFrame:
    """(domain, provider, null_mx, spf_mechanisms, spf_all, dmarc_policy, dkim): of the first exchanger in
    order whose name is known, and the domain's policies."""
    of = lambda t: F.when(F.col("type") == t, F.col("value"))
    provider = cases([((F.col("type") == "MX") & F.lower("value").rlike(p), name) for p, name in MAIL_PROVIDERS])
    spf = F.when((F.col("type") == "TXT") & F.lower("value").startswith("v=spf1"), F.col("value"))
    seen = records.withColumn("provider", provider).groupBy("domain").agg(
        F.min_by("provider", F.when(F.col("provider").isNotNull(), F.col("value"))).alias("provider"), F.coalesce(F.bool_or(of("MX").isin("", ".")), F.lit(False)).alias("null_mx"),
        F.min(spf).alias("spf"), F.min(of("DMARC")).alias("dmarc"), F.count(of("DKIM")).alias("dkim"),
    )
    mechanisms, rule = spf_fields(F.col("spf"))
    return seen.select("domain", "provider", "null_mx", F.when(F.col("spf").isNotNull(), mechanisms).alias("spf_mechanisms"), rule.alias("spf_all"), F.lower(tag(F.col("dmarc"), "p")).alias("dmarc_policy"), "dkim")


def zone_checks(records: DataFrame) -> DataFrame:
    """(domain, check, level): what a zone has or lacks."""
    n = lambda t: F.count_if(F.col("type") == t)
    counts = records.groupBy("domain").agg(*[n(t).alias(t) for t in ("A", "AAAA", "CNAME", "MX", "NS", "SOA", "CAA", "DMARC", "DKIM", "DS", "DNSKEY")], F.count_if((F.col("type") == "TXT") & F.lower("value").startswith("v=spf1")).alias("SPF"))
    either = lambda t, good, bad, level: F.when(F.col(t) > 0, F.struct(F.lit(good).alias("check"), F.lit("pass").alias("level"))).otherwise(F.struct(F.lit(bad).alias("check"), F.lit(level).alias("level")))
    one = lambda when, check, level: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(level).alias("level")))
    sec = F.when((F.col("DS") > 0) & (F.col("DNSKEY") > 0), F.struct(F.lit("dnssec-ok").alias("check"), F.lit("pass").alias("level"))).otherwise(one((F.col("DS") > 0) | (F.col("DNSKEY") > 0), "dnssec-partial", "info"))
    rows = F.array_compact(F.array(
        either("A", "a-ok", "a-missing", "warn"), either("AAAA", "aaaa-ok", "aaaa-missing", "info"), one(F.col("CNAME") > 0, "cname-apex", "warn"), either("MX", "mx-ok", "mx-missing", "info"),
        one(F.col("NS") == 1, "ns-single", "warn"), one(F.col("NS") > 1, "ns-ok", "pass"), one(F.col("NS") == 0, "ns-missing", "warn"), one(F.col("SOA") == 0, "soa-missing", "info"),
        either("SPF", "spf-ok", "spf-missing", "warn"), either("DMARC", "dmarc-ok", "dmarc-missing", "info"), either("DKIM", "dkim-ok", "dkim-none", "info"), either("CAA", "caa-ok", "caa-none", "info"),
        F.coalesce(sec, F.struct(F.lit("dnssec-none").alias("check"), F.lit("info").alias("level"))),
    ))
    return counts.select("domain", F.explode(rows).alias("x")).select("domain", "x.*")


def edge_votes(headers: DataFrame, records: DataFrame, addresses: DataFrame) -> DataFrame:
    """(domain, provider, score): 3 for an alias into a delivery network or an address in its ranges,
    1.5 for each header that names it. headers (domain, header, value), addresses (domain, provider, kind)."""
    own = lambda kind: [(h, p, provider) for k, h, p, provider in EDGE_PATTERNS if k == kind]
    spoken = F.array_compact(F.array(*[F.when((F.col("header") == h) & F.col("value").rlike(f"(?i){p}"), provider) for h, p, provider in own("header")]))
    aliased = F.array_compact(F.array(*[F.when(F.col("value").rlike(f"(?i){p}"), provider) for _, p, provider in own("cname")]))
    votes = headers.select("domain", F.explode(spoken).alias("provider"), F.lit(1.5).alias("w"))
    votes = votes.union(records.where("type = 'CNAME'").select("domain", F.explode(aliased), F.lit(3.0)))
    votes = votes.union(addresses.where("kind = 'cdn'").select("domain", "provider", F.lit(3.0)))
    return votes.groupBy("domain", "provider").agg(F.sum("w").alias("score"))


def edge_verdict(votes: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, status, provider, confidence) of each domain: detected from 3 on, possible below."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "provider"))
    best = votes.withColumn("rank", rank).where("rank = 1")
    sure = F.col("score") >= 3
    confidence = F.when(sure, F.least(F.lit(99.0), 55 + F.col("score") * 7)).when(F.col("score") > 0, F.least(F.lit(55.0), 30 + F.col("score") * 6)).otherwise(0.0)
    status = cases([(sure, "detected"), (F.col("score") > 0, "possible")], "not-detected")
    return domains.join(best, "domain", "left").select("domain", status.alias("status"), "provider", confidence.alias("confidence"))


def hosting(addresses: DataFrame) -> DataFrame:
    """(domain, provider, votes, agreed): the commonest owner of a domain's addresses outside delivery
    networks, ties to the first in order."""
    n = addresses.where("kind <> 'cdn' and provider is not null").groupBy("domain", "provider").agg(F.count("*").alias("votes"))
    own = Window.partitionBy("domain")
    ranked = n.withColumns({"r": F.row_number().over(own.orderBy(F.desc("votes"), "provider")), "agreed": F.count("*").over(own) == 1})
    return ranked.where("r = 1").select("domain", "provider", "votes", "agreed")


def subdomains(domains: DataFrame, seen: DataFrame) -> DataFrame:
    """(domain, name, sources): names below a domain among (domain, source, name), from everywhere they were seen."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"^\*\.", ""), r"\.$", "")
    below = seen.select("domain", "source", bare.alias("name")).join(domains.select("domain"), "domain", "left_semi").where(F.endswith("name", F.concat(F.lit("."), "domain")))
    return below.groupBy("domain", "name").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def source_conflicts(claims: DataFrame) -> DataFrame:
    """(subject, field, shown): what sources differ in, of claims (subject, field, source, value)."""
    out = claims.where("value is not null").groupBy("subject", "field").agg(F.array_sort(F.collect_set("value")).alias("shown"))
    return out.where(F.size("shown") > 1).select("subject", "field", F.array_join("shown", " | ").alias("shown"))


def strict_transport(value: Column) -> dict[str, Column]:
    """Presence, age and flags of a Strict-Transport-Security header."""
    seconds = F.regexp_extract(value, r"(?i)max-age\s*=\s*(\d+)", 1)
    has = lambda p: F.coalesce(value.rlike(f"(?i){p}"), F.lit(False))
    return {"present": has(r"max-age\s*="), "max_age": F.when(seconds != "", seconds.cast("long")), "subdomains": has("includeSubDomains"), "preload": has("preload")}


def security_posture(headers: DataFrame) -> DataFrame:
    """(domain, present, missing, edge): counts of the headers that protect a site, and the first header in
    order that names an edge."""
    of = lambda h: F.bool_or(F.col("header") == h)
    edge = cases([(of("cf-ray"), "Cloudflare"), (of("x-vercel-id"), "Vercel"), (F.bool_or((F.col("header") == "x-served-by") & F.col("value").contains("cache-")), "Fastly"), (of("x-amz-cf-id"), "Amazon CloudFront")])
    some = headers.groupBy("domain").agg(F.count_distinct(F.when(F.col("header").isin(*SECURITY_HEADERS), F.col("header"))).alias("present"), edge.alias("edge"))
    return some.select("domain", "present", (len(SECURITY_HEADERS) - F.col("present")).alias("missing"), "edge")


def certificate_state(certs: DataFrame, as_of: Column) -> DataFrame:
    """certs (host, valid_from, valid_to, sans, trusted) with (state, days_left): expired, then not yet valid,
    then another host (a wildcard stands for one label), then a broken chain."""
    wild = F.concat(F.lit("*."), F.regexp_replace("host", r"^[^.]+\.", ""))
    named = F.exists("sans", lambda s: (F.lower(s) == F.lower("host")) | (F.lower(s) == F.lower(wild)))
    state = cases([(F.col("valid_to") < as_of, "expired"), (F.col("valid_from") > as_of, "not-yet-valid"), (~named, "hostname-mismatch"), (~F.col("trusted"), "chain-invalid")], "valid")
    return certs.withColumns({"state": state, "days_left": F.datediff("valid_to", as_of).cast("long")})


def error_class(kind: Column, code: Column, message: Column) -> Column:
    """The class of a name or TLS error by its code and text."""
    m, c = F.lower(F.coalesce(message, F.lit(""))), F.upper(F.coalesce(code, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [m.contains(w) for w in words])
    dns = cases([((c == "NXDOMAIN") | has("nxdomain", "enotfound", "not found"), "NXDOMAIN"), ((c == "SERVFAIL") | has("servfail"), "SERVFAIL"), ((c == "DNS_TIMEOUT") | has("timeout"), "DNS_TIMEOUT")], "DNS_ERROR")
    tls = cases([(has("expired"), "expired"), (has("hostname", "altname", "mismatch"), "hostname_mismatch"), (has("self signed", "unable to verify", "invalid certificate"), "invalid"), (has("handshake", "tls", "ssl"), "handshake_failed")], "tls_error")
    return F.when(kind == "dns", dns).otherwise(tls)


def exposure(probes: DataFrame) -> DataFrame:
    """probes (probe, status, content_type, body, challenge) with `state`: what a probed path gives away."""
    head, s = F.lower(F.substring("body", 1, 400)), F.col("status")
    listing = cases([(head.rlike("<title>index of /|<h1>index of /"), "exposed"), (F.lower("content_type").contains("html") & head.rlike("wp-content|theme|stylesheet"), "unknown")], "not_found")
    git = F.when(F.substring("body", 1, 100).rlike(r"ref:\s*refs/"), "exposed").otherwise("not_found")
    mapped = F.when(F.lower("content_type").contains("json") | F.trim(head).startswith("{"), "exposed").otherwise("not_found")
    read = F.when(F.trim("body") == "", "unknown").otherwise("exposed")
    found = F.when(F.col("probe") == "dirindex", listing).when(F.col("probe") == "devfile", git).when(F.col("probe") == "sourcemap", mapped).otherwise(read)
    return probes.withColumn("state", F.when(s.isNull() | F.col("challenge") | s.isin(401, 403, 429) | (s >= 500), "unknown").when(s == 200, found).otherwise("not_found"))
