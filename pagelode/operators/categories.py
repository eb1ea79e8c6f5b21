"""Categories of pages by votes of rules, phases and issues of page loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators.domains import cases

#: Category, path segments, words of breadcrumbs, pattern of titles and headings, pattern of
#: navigation labels.
CATEGORIES = (
    ("Documentation", "docs documentation reference api api-reference developers developer learn", "docs,documentation,reference,api,developer", r"\b(documentation|docs|api reference|developer|reference)\b", r"\b(documentation|docs|developer|reference|api)\b"),
    ("Knowledge Base", "knowledge-base knowledgebase kb help-center helpcentre support help", "knowledge base,help center,helpcentre,support", r"\b(knowledge base|help center|help centre)\b", r"\b(knowledge base|help center|support|help)\b"),
    ("Guides", "guide guides how-to howto", "guide,guides", r"\b(guide|how to|how-to)\b", r"\bguides?\b"),
    ("Tutorials", "tutorial tutorials", "tutorial,tutorials", r"\btutorial\b", r"\btutorials?\b"),
    ("FAQ", "faq faqs frequently-asked-questions", "faq,frequently asked", r"\b(faq|frequently asked questions)\b", r"\bfaq\b"),
    ("Blog", "blog news articles posts updates insights journal", "blog,news,articles,posts", r"\b(blog|news|articles?|posts?)\b", r"\b(blog|news|articles?|posts?)\b"),
    ("Products", "product products item items shop store collection collections pricing plans", "product,products,shop,store", r"\b(product|shop|store|pricing)\b", r"\b(products?|shop|store)\b"),
    ("Services", "services service solutions consulting packages", "services,service,solutions", r"\b(services?|solutions)\b", r"\bservices?\b"),
    ("Resources", "resources resource library downloads whitepapers white-papers case-studies ebooks glossary reports webinars", "resources,library,downloads", r"\b(resources?|library|downloads?)\b", r"\bresources?\b"),
    ("Tools", "tools tool calculator calculators generator generators checker checkers", "tools,calculator,generator,checker", r"\b(tools?|calculator|generator|checker)\b", r"\btools?\b"),
    ("About", "about about-us team company who-we-are history careers jobs", "about,team,company", r"\babout us\b", r"\babout\b"),
    ("Contact", "contact contact-us get-in-touch reach-us", "contact", r"\bcontact us\b", r"\bcontact\b"),
)
#: Categories of structured-data types.
TYPES = {"product": "Products", "service": "Services", "article": "Blog", "newsarticle": "Blog", "blogposting": "Blog", "techarticle": "Blog", "faqpage": "FAQ", "howto": "Guides", "softwareapplication": "Tools", "webapplication": "Tools"}


def categories(pages: DataFrame) -> DataFrame:
    """(page_id, category, votes) of pages (page_id, path, segments, crumbs, types, og_type, headings, title, labels):
    the category with most votes, `Documentation` and then the first to get one among equals; roots are Home."""
    low = lambda values: F.transform(values, F.lower)
    labels = F.array_join(low("labels"), " | ")
    nav = cases([(labels.rlike(pattern), name) for name, _, _, _, pattern in CATEGORIES])
    og = cases([(F.col("og_type").rlike("(?i)^article$"), "Blog"), (F.col("og_type").rlike("(?i)^product"), "Products")])

    def ballot(k: int) -> Column:
        name, segments, crumbs, title, _ = CATEGORIES[k]
        places = lambda values, allowed: F.filter(F.transform(values, lambda v, i: F.when(v.isin(*allowed), i)), lambda i: i.isNotNull())
        by_path, by_type = places("segments", segments.split()), places("types", [t for t, c in TYPES.items() if c == name] or [""])
        crumb = F.exists(low("crumbs"), lambda c: F.lit(False) if not crumbs else c.rlike("|".join(crumbs.split(","))))
        heading, titled = F.col("headings").rlike(f"(?i){title}"), F.col("title").rlike(f"(?i){title}")
        sources = ((F.size(by_path) > 0, 4 * F.size(by_path), F.array_min(by_path)), (crumb, 3, 1000 + k), (F.size(by_type) > 0, 5 * F.size(by_type), 2000 + F.array_min(by_type)), (og == name, 3, 3000), (heading, 2, 4000 + k), (titled, 2, 5000 + k), (nav == name, 4, 6000))
        column = lambda x: x if isinstance(x, Column) else F.lit(x)
        votes = sum((F.when(holds, column(w)).otherwise(0) for holds, w, _ in sources[1:]), F.when(sources[0][0], sources[0][1]).otherwise(0))
        first = F.least(*[F.when(holds, column(at)) for holds, _, at in sources])
        return F.struct(votes.alias("votes"), F.lit(name == "Documentation").alias("preferred"), (-first).alias("early"), F.lit(name).alias("name"))

    best = F.array_max(F.filter(F.array(*[ballot(k) for k in range(len(CATEGORIES))]), lambda b: b["votes"] > 0))
    rows = pages.select("page_id", "path", best.alias("best"))
    home = F.col("path").isin("", "/")
    return rows.select("page_id", F.when(home, "Home").otherwise(F.coalesce("best.name", F.lit("Other"))).alias("category"), F.when(home, 0).otherwise(F.coalesce("best.votes", F.lit(0))).alias("votes"))


def load_phases(loads: DataFrame) -> DataFrame:
    """loads (load_id, paint, ttfb, start, duration) with (load_delay, load_duration, render_delay, bottleneck): the
    parts of a largest paint by the resource that it shows (C31); null where that has no timing, and the first
    of the longest parts where all are known."""
    c = F.col
    timed, floor = c("start").isNotNull(), F.lit(0.0)
    round1 = lambda x: tx.half_up(x, 1)
    rows = loads.withColumns({
        "load_delay": F.when(timed, round1(F.greatest(floor, c("start") - F.coalesce("ttfb", floor)))), "load_duration": F.when(timed, round1(c("duration"))),
        "render_delay": F.when(timed, round1(F.greatest(floor, c("paint") - c("start") - F.coalesce("duration", floor)))),
    })
    parts = (("TTFB", round1(c("ttfb"))), ("Load delay", c("load_delay")), ("Load duration", c("load_duration")), ("Render delay", c("render_delay")))
    most = F.greatest(*[x for _, x in parts])
    known = c("load_delay").isNotNull() & c("load_duration").isNotNull() & c("render_delay").isNotNull()
    return rows.withColumn("bottleneck", F.when(known, cases([(x == most, name) for name, x in parts])))


#: (issue, severity, condition) on the image of a largest paint, on a page's tree and on its main thread.
LOAD_ISSUES = (
    ("lcp-lazy", "critical", "loading = 'lazy' AND in_viewport"), ("lcp-priority", "high", "NOT preloaded AND fetchpriority <> 'high'"), ("lcp-oversized", "high", "natural_w > rendered_w * 2 AND rendered_w > 0"),
    ("lcp-format", "medium", "bytes > 512000 AND format IN ('png', 'jpg', 'jpeg', 'gif')"), ("dom-very-large", "high", "nodes > 5000"), ("dom-large", "medium", "nodes > 1500 AND nodes <= 5000"),
    ("dom-deep", "low", "depth > 40"), ("loaf", "medium", "longest_frame > 200"), ("mainthread-busy", "medium", "long_tasks > 5"),
)


def load_issues(loads: DataFrame) -> DataFrame:
    """(load_id, issue, severity): what LOAD_ISSUES find in loads (C31, C32); unmeasured facts, null, give none."""
    rows = F.array(*[F.when(F.expr(p), F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for i, s, p in LOAD_ISSUES])
    return loads.select("load_id", F.inline(F.array_compact(rows)))
