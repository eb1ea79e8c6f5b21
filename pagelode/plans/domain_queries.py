"""Queries on domains. The sites of `pages` stand for domains; their records follow from a site's first page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import domains as dm
from pagelode.plans import duck as d
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}
AS_OF = "DATE '2024-06-01'"


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


#: What both engines read in the same words; {si} is (site, n pages, m least page).
RECORDS = """SELECT site AS domain, 'A' AS type, '104.16.' || (m % 200) || '.7' AS value FROM {si} WHERE m % 5 <> 0
UNION ALL SELECT site, 'A', '203.0.113.' || (m % 250) FROM {si} WHERE m % 3 = 0 UNION ALL SELECT site, 'AAAA', '2001:db8::' || m FROM {si} WHERE m % 4 = 0
UNION ALL SELECT site, 'NS', 'ns1.example-dns.net' FROM {si} WHERE m % 8 <> 0 UNION ALL SELECT site, 'NS', 'ns2.example-dns.net' FROM {si} WHERE m % 6 = 0
UNION ALL SELECT site, 'SOA', 'ns1.example-dns.net' FROM {si} WHERE m % 8 > 1 UNION ALL SELECT site, 'CNAME', 'edge' || m || CASE WHEN m % 2 = 0 THEN '.cloudfront.net' ELSE '.edgekey.net' END FROM {si} WHERE m % 9 < 2
UNION ALL SELECT site, 'MX', CASE m % 4 WHEN 0 THEN 'aspmx.l.google.com' WHEN 1 THEN site || '.mail.protection.outlook.com' WHEN 2 THEN '.' ELSE 'mail.' || site END FROM {si} WHERE m % 7 <> 0
UNION ALL SELECT site, 'TXT', 'v=spf1 include:_spf.example.com  ip4:203.0.113.' || (m % 9) || CASE m % 3 WHEN 0 THEN ' -all' WHEN 1 THEN ' all' ELSE '' END FROM {si} WHERE m % 5 < 3
UNION ALL SELECT site, 'TXT', 'site-verification=' || m FROM {si} UNION ALL SELECT site, 'DMARC', 'v=DMARC1; p=' || CASE WHEN m % 2 = 0 THEN 'Reject' ELSE 'none' END || '; pct=50; p=quarantine' FROM {si} WHERE m % 3 <> 1
UNION ALL SELECT site, 'DKIM', 'selector1' FROM {si} WHERE m % 6 < 2 UNION ALL SELECT site, 'CAA', 'letsencrypt.org' FROM {si} WHERE m % 11 = 0
UNION ALL SELECT site, 'DS', '1' FROM {si} WHERE m % 4 = 1 UNION ALL SELECT site, 'DNSKEY', '1' FROM {si} WHERE m % 8 IN (1, 3)"""
HEADERS = """SELECT site AS domain, 'server' AS header, CASE m % 5 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'AkamaiGHost' WHEN 2 THEN 'nginx' WHEN 3 THEN 'CloudFront' ELSE 'BunnyCDN-X' END AS value FROM {si}
UNION ALL SELECT site, 'cf-ray', '8a' || m FROM {si} WHERE m % 5 = 0 UNION ALL SELECT site, 'via', '1.1 varnish' FROM {si} WHERE m % 7 = 2 UNION ALL SELECT site, 'x-served-by', 'cache-fra-' || m FROM {si} WHERE m % 7 = 2
UNION ALL SELECT site, 'strict-transport-security', CASE m % 3 WHEN 0 THEN 'max-age=31536000; includeSubDomains; preload' WHEN 1 THEN 'Max-Age = 600' ELSE 'none' END FROM {si} WHERE m % 4 <> 2
UNION ALL SELECT site, 'x-frame-options', 'DENY' FROM {si} WHERE m % 2 = 0 UNION ALL SELECT site, 'referrer-policy', 'no-referrer' FROM {si} WHERE m % 3 = 0"""
ADDRESSES = """SELECT site AS domain, CASE WHEN m % 6 = 0 THEN 'Cloudflare' ELSE 'Hetzner' END AS provider, CASE WHEN m % 6 = 0 THEN 'cdn' ELSE 'hosting' END AS kind FROM {si}
UNION ALL SELECT site, CASE WHEN m % 4 = 0 THEN 'OVH' ELSE 'Hetzner' END, 'hosting' FROM {si} WHERE m % 3 <> 0 UNION ALL SELECT site, 'OVH', 'hosting' FROM {si} WHERE m % 5 = 0"""
SEEN = """SELECT site AS domain, 'certificate' AS source, '*.' || site AS name FROM {si} UNION ALL SELECT site, 'certificate', 'www.' || site FROM {si} UNION ALL SELECT site, 'link', 'WWW.' || site || '.' FROM {si} WHERE m % 2 = 0
UNION ALL SELECT site, 'mx', 'mail.' || site FROM {si} WHERE m % 3 = 0 UNION ALL SELECT site, 'spf', 'mail.' || site FROM {si} WHERE m % 4 = 0 UNION ALL SELECT site, 'ns', 'ns1.elsewhere.net' FROM {si}"""
_SI = f"{d.PAGE}, si AS (SELECT site, count(*) AS n, min(page_id) AS m FROM h GROUP BY site)"
_RE, _HE, _AD = (f"{name} AS ({text.format(si='si')})" for name, text in (("re", RECORDS), ("he", HEADERS), ("ad", ADDRESSES)))


def sites(spark, sf):
    return read_table(spark, sf, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.min("page_id").alias("m"))


def derived(spark, sf, text):
    return spark.sql(text, si=sites(spark, sf))


_ENTITY = "array<struct<roles:array<string>,handle:string,vcardArray:array<string>>>"
_CARD = '[["version", {}, "text", "4.0"], ["fn", {}, "text", "Registrar One"], ["org", {}, "text", "Another name"]]'
_ENTITIES = json.dumps([{"roles": ["registrant"], "vcardArray": ["vcard", _CARD.replace("Registrar One", "Someone")]}, {"roles": ["abuse", "Registrar"], "handle": "1", "vcardArray": ["vcard", _CARD]}])


def answers(spark, sf):
    """Registry answers: JSON for two thirds of the sites, text for most others."""
    day = lambda c: F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), c.cast("int")), "yyyy-MM-dd")
    first, last = day(F.col("m") % 4000), day(5000 + F.col("m") % 500)
    state = F.expr("CASE m % 5 WHEN 0 THEN 'clientHold' WHEN 1 THEN 'pendingDelete' ELSE 'ok' END")
    event = lambda action, when: F.struct(F.lit(action).alias("eventAction"), F.concat(when, F.lit("T00:00:00Z")).alias("eventDate"))
    rdap = F.to_json(F.struct(F.array(event("expiration", last), event("registration", first)).alias("events"), F.array(state, F.lit("clientTransferProhibited")).alias("status"), F.from_json(F.lit(_ENTITIES), _ENTITY).alias("entities")))
    whois = F.concat(F.lit("Domain Name: X\r\n   Creation Date: "), first, F.lit("T05:00:00Z\r\nRegistry Expiry Date: "), last, F.lit("T05:00:00Z\r\nRegistrar: Registrar Two \r\nDomain Status: "), state, F.lit(" https://example.org\r\nDomain Status: ok\r\n"))
    return sites(spark, sf).select(F.col("site").alias("domain"), F.when(F.col("m") % 3 < 2, rdap).alias("rdap"), F.when(F.col("m") % 6 != 5, whois).alias("whois"))


_REG = f"""{_SI}, rg AS (SELECT site AS domain, m, CASE WHEN m % 3 < 2 THEN 'rdap' WHEN m % 6 <> 5 THEN 'whois' ELSE 'none' END AS source,
 CASE m % 5 WHEN 0 THEN 'clientHold' WHEN 1 THEN 'pendingDelete' ELSE 'ok' END AS state, DATE '2010-01-01' + CAST(m % 4000 AS INTEGER) AS a, DATE '2010-01-01' + CAST(5000 + m % 500 AS INTEGER) AS b FROM si),
rn AS (SELECT domain, m, source, CASE WHEN source <> 'none' THEN a END AS registered, CASE WHEN source <> 'none' THEN b END AS expires,
 CASE source WHEN 'rdap' THEN state || ',clientTransferProhibited' WHEN 'whois' THEN state || ',ok' ELSE '' END AS statuses, CASE source WHEN 'rdap' THEN 'Registrar One' WHEN 'whois' THEN 'Registrar Two' END AS registrar FROM rg)"""


@query(f"WITH {_REG} SELECT domain, source, registered, expires, statuses, registrar FROM rn")
def registrations(spark: SparkSession, sf: str) -> DataFrame:
    return dm.registrations(answers(spark, sf)).select("domain", "source", "registered", "expires", "statuses", "registrar")


@query(f"""WITH {_REG}, {_RE}, z AS (SELECT DISTINCT domain FROM re WHERE type IN ('NS', 'SOA'))
SELECT domain, CASE WHEN source = 'none' THEN CASE WHEN domain IN (SELECT domain FROM z) THEN 'registered-dns' ELSE 'unknown' END
 WHEN expires < {AS_OF} THEN CASE WHEN statuses LIKE '%pendingDelete%' THEN 'expired-redemption' ELSE 'expired' END
 WHEN statuses LIKE '%clientHold%' THEN 'on-hold' WHEN statuses LIKE '%pendingDelete%' THEN 'pending-delete' ELSE 'active' END AS status FROM rn""")
def domain_status(spark: SparkSession, sf: str) -> DataFrame:
    return dm.domain_status(dm.registrations(answers(spark, sf)), derived(spark, sf, RECORDS), F.expr(AS_OF))


@query(f"WITH {_SI} SELECT site AS domain, CASE WHEN m % 8 = 1 THEN 'enabled' WHEN m % 4 = 1 OR m % 8 = 3 THEN 'partial' ELSE 'not-detected' END AS status FROM si")
def dnssec_status(spark: SparkSession, sf: str) -> DataFrame:
    return dm.dnssec(derived(spark, sf, RECORDS))


@query(f"""WITH {_SI} SELECT site AS domain, CASE WHEN m % 7 <> 0 AND m % 4 = 0 THEN 'Google Workspace' WHEN m % 7 <> 0 AND m % 4 = 1 THEN 'Microsoft 365' END AS provider, m % 7 <> 0 AND m % 4 = 2 AS null_mx,
 CASE WHEN m % 5 < 3 THEN CAST(2 AS BIGINT) END AS spf_mechanisms, CASE WHEN m % 5 >= 3 THEN NULL WHEN m % 3 = 0 THEN '-' WHEN m % 3 = 1 THEN '+' END AS spf_all,
 CASE WHEN m % 3 = 1 THEN NULL WHEN m % 2 = 0 THEN 'reject' ELSE 'none' END AS dmarc_policy, CAST(CASE WHEN m % 6 < 2 THEN 1 ELSE 0 END AS BIGINT) AS dkim FROM si""")
def mail_posture(spark: SparkSession, sf: str) -> DataFrame:
    return dm.mail_posture(derived(spark, sf, RECORDS))


def _either(t, good, bad, level):
    return f"SELECT domain, CASE WHEN {t} > 0 THEN '{good}' ELSE '{bad}' END AS \"check\", CASE WHEN {t} > 0 THEN 'pass' ELSE '{level}' END AS level FROM c"


@query(f"""WITH {_SI}, {_RE}, c AS (SELECT domain, {', '.join(f"count(*) FILTER (type = '{t}') AS {t}" for t in ('A', 'AAAA', 'CNAME', 'MX', 'NS', 'SOA', 'CAA', 'DMARC', 'DKIM', 'DS', 'DNSKEY'))}, count(*) FILTER (value LIKE 'v=spf1%') AS SPF FROM re GROUP BY domain)
{' UNION ALL '.join(_either(*x) for x in (('A', 'a-ok', 'a-missing', 'warn'), ('AAAA', 'aaaa-ok', 'aaaa-missing', 'info'), ('MX', 'mx-ok', 'mx-missing', 'info'), ('SPF', 'spf-ok', 'spf-missing', 'warn'), ('DMARC', 'dmarc-ok', 'dmarc-missing', 'info'), ('DKIM', 'dkim-ok', 'dkim-none', 'info'), ('CAA', 'caa-ok', 'caa-none', 'info')))}
UNION ALL SELECT domain, 'cname-apex', 'warn' FROM c WHERE CNAME > 0 UNION ALL SELECT domain, 'soa-missing', 'info' FROM c WHERE SOA = 0
UNION ALL SELECT domain, CASE WHEN NS = 0 THEN 'ns-missing' WHEN NS = 1 THEN 'ns-single' ELSE 'ns-ok' END, CASE WHEN NS > 1 THEN 'pass' ELSE 'warn' END FROM c
UNION ALL SELECT domain, CASE WHEN DS > 0 AND DNSKEY > 0 THEN 'dnssec-ok' WHEN DS + DNSKEY > 0 THEN 'dnssec-partial' ELSE 'dnssec-none' END, CASE WHEN DS > 0 AND DNSKEY > 0 THEN 'pass' ELSE 'info' END FROM c""")
def zone_checks(spark: SparkSession, sf: str) -> DataFrame:
    return dm.zone_checks(derived(spark, sf, RECORDS))


@query(f"""WITH {_SI}, v AS (SELECT site AS domain, CASE m % 5 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'Akamai' WHEN 3 THEN 'Amazon CloudFront' WHEN 4 THEN 'Bunny CDN' END AS p, 1.5 AS w FROM si
 UNION ALL SELECT site, 'Cloudflare', 1.5 FROM si WHERE m % 5 = 0 UNION ALL SELECT site, 'Fastly', 1.5 FROM si WHERE m % 7 = 2 UNION ALL SELECT site, CASE WHEN m % 2 = 0 THEN 'Amazon CloudFront' ELSE 'Akamai' END, 3 FROM si WHERE m % 9 < 2
 UNION ALL SELECT site, 'Cloudflare', 3 FROM si WHERE m % 6 = 0),
s AS (SELECT domain, p, CAST(sum(w) AS DOUBLE) AS s, row_number() OVER (PARTITION BY domain ORDER BY sum(w) DESC, p) AS r FROM v WHERE p IS NOT NULL GROUP BY domain, p)
SELECT site AS domain, CASE WHEN s >= 3 THEN 'detected' WHEN s > 0 THEN 'possible' ELSE 'not-detected' END AS status, p AS provider, CAST(CASE WHEN s >= 3 THEN least(99, 55 + 7 * s) WHEN s > 0 THEN least(55, 30 + 6 * s) ELSE 0 END AS DOUBLE) AS confidence
FROM si LEFT JOIN s ON s.domain = si.site AND r = 1""")
def edge_networks(spark: SparkSession, sf: str) -> DataFrame:
    votes = dm.edge_votes(derived(spark, sf, HEADERS), derived(spark, sf, RECORDS), derived(spark, sf, ADDRESSES))
    return dm.edge_verdict(votes, sites(spark, sf).select(F.col("site").alias("domain")))


@query(f"""WITH {_SI}, {_AD}, n AS (SELECT domain, provider, count(*) AS votes FROM ad WHERE kind <> 'cdn' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY votes DESC, provider) AS r, count(*) OVER (PARTITION BY domain) = 1 AS agreed FROM n)
SELECT domain, provider, votes, agreed FROM k WHERE r = 1""")
def hosting_providers(spark: SparkSession, sf: str) -> DataFrame:
    return dm.hosting(derived(spark, sf, ADDRESSES))


@query(f"""WITH {_SI} SELECT site AS domain, 'www.' || site AS name, CASE WHEN m % 2 = 0 THEN 'certificate,link' ELSE 'certificate' END AS sources FROM si
UNION ALL SELECT site, 'mail.' || site, CASE WHEN m % 3 = 0 AND m % 4 = 0 THEN 'mx,spf' WHEN m % 3 = 0 THEN 'mx' ELSE 'spf' END FROM si WHERE m % 3 = 0 OR m % 4 = 0""")
def subdomains(spark: SparkSession, sf: str) -> DataFrame:
    return dm.subdomains(sites(spark, sf).select(F.col("site").alias("domain")), derived(spark, sf, SEEN))


@query(f"WITH {_SI}, {_AD}, x AS (SELECT domain AS subject, 'provider' AS field, list_sort(list_distinct(list(provider))) AS s FROM ad GROUP BY domain) SELECT subject, field, array_to_string(s, ' | ') AS shown FROM x WHERE len(s) > 1")
def source_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return dm.source_conflicts(derived(spark, sf, ADDRESSES).select(F.col("domain").alias("subject"), F.lit("provider").alias("field"), F.col("kind").alias("source"), F.col("provider").alias("value")))


@query(f"""WITH {_SI} SELECT site AS domain, m % 3 < 2 AS present, CASE m % 3 WHEN 0 THEN CAST(31536000 AS BIGINT) WHEN 1 THEN 600 END AS max_age, m % 3 = 0 AS subdomains, m % 3 = 0 AS preload FROM si WHERE m % 4 <> 2""")
def strict_transport(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, HEADERS).where("header = 'strict-transport-security'")
    return rows.select("domain", *[c.alias(k) for k, c in dm.strict_transport(F.col("value")).items()])


@query(f"""WITH {_SI}, {_HE}, x AS (SELECT domain, count(DISTINCT header) FILTER (header IN ('strict-transport-security', 'content-security-policy', 'x-content-type-options', 'x-frame-options', 'referrer-policy', 'permissions-policy')) AS present,
 bool_or(header = 'cf-ray') AS cf, bool_or(header = 'x-served-by') AS fa FROM he GROUP BY domain) SELECT domain, present, 6 - present AS missing, CASE WHEN cf THEN 'Cloudflare' WHEN fa THEN 'Fastly' END AS edge FROM x""")
def security_posture(spark: SparkSession, sf: str) -> DataFrame:
    return dm.security_posture(derived(spark, sf, HEADERS))


@query(f"""WITH {_SI} SELECT site AS host, CASE WHEN m % 10 = 0 THEN 'expired' WHEN m % 10 = 1 THEN 'not-yet-valid' WHEN m % 10 = 2 THEN 'hostname-mismatch' WHEN m % 4 = 0 THEN 'chain-invalid' ELSE 'valid' END AS state,
 CAST(CASE WHEN m % 10 = 0 THEN -31 ELSE 30 + m % 50 END AS BIGINT) AS days_left FROM si""")
def certificate_states(spark: SparkSession, sf: str) -> DataFrame:
    s, day = sites(spark, sf), F.expr(AS_OF)
    m = F.col("m") % 10
    until = F.when(m == 0, F.date_sub(day, 31)).otherwise(F.date_add(day, (30 + F.col("m") % 50).cast("int")))
    sans = F.when(m == 2, F.array(F.lit("other.example"), F.lit("*.example"))).when(m == 3, F.array(F.concat(F.lit("*."), F.regexp_replace("site", r"^[^.]+\.", "")))).otherwise(F.array(F.upper("site")))
    certs = s.select(F.col("site").alias("host"), F.when(m == 1, F.date_add(day, 5)).otherwise(F.date_sub(day, 60)).alias("valid_from"), until.alias("valid_to"), sans.alias("sans"), (F.col("m") % 4 != 0).alias("trusted"))
    return dm.certificate_state(certs, day).select("host", "state", "days_left")


_ERRORS = """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'dns' ELSE 'tls' END AS kind, CASE event_id % 7 WHEN 0 THEN 'SERVFAIL' WHEN 1 THEN 'dns_timeout' END AS code,
 CASE event_id % 6 WHEN 0 THEN 'getaddrinfo ENOTFOUND' WHEN 1 THEN 'certificate has EXPIRED' WHEN 2 THEN 'altname mismatch' WHEN 3 THEN 'self signed' WHEN 4 THEN 'handshake failure' END AS message FROM {ev} WHERE event_type = 'error'"""


@query(f"""WITH er AS ({_ERRORS.format(ev='events')}) SELECT event_id, CASE WHEN kind = 'dns' THEN CASE WHEN event_id % 6 = 0 THEN 'NXDOMAIN' WHEN event_id % 7 = 0 THEN 'SERVFAIL' WHEN event_id % 7 = 1 THEN 'DNS_TIMEOUT' ELSE 'DNS_ERROR' END
 ELSE CASE event_id % 6 WHEN 1 THEN 'expired' WHEN 2 THEN 'hostname_mismatch' WHEN 3 THEN 'invalid' WHEN 4 THEN 'handshake_failed' ELSE 'tls_error' END END AS class FROM er""")
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_ERRORS, ev=read_table(spark, sf, "events"))
    return rows.select("event_id", dm.error_class(F.col("kind"), F.col("code"), F.col("message")).alias("class"))


_PROBES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dirindex' WHEN 1 THEN 'devfile' WHEN 2 THEN 'sourcemap' ELSE 'readme' END AS probe, CASE user_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status, 'text/html' AS content_type,
 CASE event_id % 7 WHEN 0 THEN '<title>Index of /themes' WHEN 1 THEN 'ref: refs/heads/main' WHEN 2 THEN ' {{"version":3}}' WHEN 3 THEN ' ' ELSE 'wp-content page' END AS body, event_id % 11 = 0 AS challenge FROM {ev}"""


@query(f"""WITH pr AS ({_PROBES.format(ev='events')}), x AS (SELECT *, event_id % 7 AS b FROM pr)
SELECT event_id, CASE WHEN challenge OR status = 503 THEN 'unknown' WHEN status <> 200 THEN 'not_found' WHEN probe = 'dirindex' THEN CASE WHEN b = 0 THEN 'exposed' WHEN b > 3 THEN 'unknown' ELSE 'not_found' END
 WHEN probe = 'devfile' THEN CASE WHEN b = 1 THEN 'exposed' ELSE 'not_found' END WHEN probe = 'sourcemap' THEN CASE WHEN b = 2 THEN 'exposed' ELSE 'not_found' END WHEN b = 3 THEN 'unknown' ELSE 'exposed' END AS state FROM x""")
def exposure_classes(spark: SparkSession, sf: str) -> DataFrame:
    return dm.exposure(spark.sql(_PROBES, ev=read_table(spark, sf, "events"))).select("event_id", "state")
