"""WordPress verdicts and themes on sites worked out by hand."""

from pagelode.operators import wordpress as wp

META = '<meta name="generator" content="WordPress 6.4">'
SITES = [
    # 25 + 15 of assets, 15 of REST, 30 of the generator: three families
    ("full", '<link href="/wp-includes/a.css"><link href="https://x/wp-content/themes/t/style.css"><a href="/wp-json/">' + META, {}, None, None, None, None),
    # generator and a block class: two families, 40
    ("two", META + '<div class="wp-block-x">', {}, None, None, None, None),
    ("alone", META, {}, None, None, None, None),
    ("rest", "<p>", {}, None, None, '{"namespaces": ["oembed/1.0", "wp/v2"]}', None),
    # one family of 25, which settles nothing alone
    ("likely", "<script src='/wp-includes/x.js'></script>", {}, None, None, None, None),
    ("weak", "text of wp-login.php", {}, None, "Disallow: /wp-admin/", None, None),
    ("none", "wordpress in the text alone, /wp-includes/ too", {}, None, None, None, None),
    # 8 + 15 + 6 + 12: pingback, feed, robots, other namespaces
    ("quiet", "", {"x-pingback": "u"}, '<generator>https://wordpress.org/?v=6</generator>', "wp-admin wp-includes", '{"namespaces": ["x"]}', None),
    ("nothing", None, None, None, None, None, None),
]
COLUMNS = "site string, html string, headers map<string, string>, feed string, robots string, rest string, loaded string"


def test_verdicts(spark):
    got = {r.site: (r.families, r.score, r.status, r.confidence) for r in wp.verdicts(spark.createDataFrame(SITES, COLUMNS)).collect()}
    assert got == {
        "full": (3, 85, "detected", 91), "two": (2, 40, "detected", 70), "alone": (1, 30, "detected", 83), "rest": (1, 30, "detected", 88), "likely": (1, 25, "likely", 48), "weak": (1, 6, "not_detected", 92),
        "none": (0, 0, "not_detected", 98), "quiet": (4, 41, "detected", 70), "nothing": (0, 0, "not_detected", 98),
    }


def test_themes(spark):
    html = r"""<link rel="stylesheet" id="kid-style-css" href="/wp-content/themes/kid/main.css"><link rel='stylesheet' href='/wp-content/themes/parent/style.css?ver=1'><script src="/wp-content/themes/parent/x.js"></script>
    {"u": "https:\/\/a\/wp-content\/themes\/kid\/i.png"} /wp-content/themes/late/ <link rel="icon" href="/wp-content/themes/icon/x.ico">"""
    rows = [("a", html, "/wp-content/themes/told/ /wp-content/themes/late/"), ("b", "<p>", None), ("c", "/wp-content/themes/z/ /wp-content/themes/y/", None)]
    got = [(r.site, r.rank, r.slug, r.score, r.references) for r in wp.theme_candidates(spark.createDataFrame(rows, "site string, html string, rest string")).orderBy("site", "rank").collect()]
    assert got == [
        ("a", 1, "parent", 45 + 15 + 6 + 4, 2), ("a", 2, "kid", 45 + 15 + 4, 2), ("a", 3, "late", 4, 1), ("a", 4, "icon", 2, 1), ("a", 5, "told", 2, 0),
        ("c", 1, "z", 2, 1), ("c", 2, "y", 2, 1),
    ]
