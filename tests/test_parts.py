"""Feeds, picks and the parts of page loads on cases worked out by hand."""

from pyspark.sql import functions as F

from pagelode.operators import feed_parts as fp
from pagelode.operators import load_parts as lp

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="d"><channel><title>Ch</title><link>https://a.example/</link>
<item><title><![CDATA[One & <b>two</b>]]></title><link>https://a.example/1?x=1&amp;y=2</link><guid isPermaLink="false">g1</guid><description>Text &lt;i&gt;x&lt;/i&gt;</description><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><dc:creator>Ann</dc:creator><category>A</category><category> B </category><category></category><media:thumbnail url="t.png"/><media:content url="c.png"/></item>
<item><title></title><link>/rel</link><author>x@y</author><enclosure url="a.mp3" type="audio/mpeg"/><enclosure url="i.jpg" type="image/jpeg"/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link rel="self" href="s"/><link href="https://a.example/e"/><link rel="enclosure" href="pic"/><id>urn:1</id><summary>S</summary><updated>2024-01-02T03:04:05Z</updated><author><name>Bo</name></author><category term="T"/></entry>
<entry><id>urn:1</id><content>C</content><published>2024-01-01T00:00:00Z</published><updated>later</updated></entry></feed>"""


def test_feeds(spark):
    feeds = spark.createDataFrame([("r", RSS), ("a", ATOM), ("x", "<feed xmlns='other'><entry><id>1</id></entry></feed>"), ("h", "<html>"), ("n", None)], "source string, body string")
    items = fp.feed_items(feeds)
    got = {(r.source, r.pos): tuple(r)[1:2] + tuple(r)[3:] for r in items.collect()}
    assert got == {
        ("r", 0): ("rss2", "One & <b>two</b>", "https://a.example/1?x=1&y=2", "g1", "Text <i>x</i>", "Mon, 06 May 2024 07:08:09 GMT", "Ann", ["A", "B"], "c.png"),
        ("r", 1): ("rss2", None, "/rel", "/rel", None, None, "x@y", [], "i.jpg"),
        ("a", 0): ("atom", "E", "https://a.example/e", "urn:1", "S", "2024-01-02T03:04:05Z", "Bo", ["T"], "pic"),
        ("a", 1): ("atom", None, None, "urn:1", "C", "2024-01-01T00:00:00Z", None, [], None),
    }
    checks = {r.source: tuple(r)[1:] for r in fp.feed_validation(items).collect()}
    assert checks == {"r": (2, 1, 0, 1, 0, 1), "a": (2, 1, 1, 0, 1, 0)}


def test_feed_links(spark):
    html = """<link rel="alternate" type="application/rss+xml" href="/feed" title="All"><link rel=stylesheet href=x><link href="https://b.example/atom.xml" rel='Alternate' type='application/atom+xml'><link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" type="text/xml">"""
    got = fp.feed_links(spark.createDataFrame([(1, "https://a.example/x/y", html), (2, "https://a.example/", None)], "page_id int, url string, html string"))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(1, 0, "https://a.example/feed", "application/rss+xml", "All"), (1, 2, "https://b.example/atom.xml", "application/atom+xml", "")]


def test_picks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    title = lambda *v: one(fp.picked_title(*[F.lit(x).cast("string") for x in v]))
    assert title(None, " ", "A  page | My Site", "h", "my site") == "A page" and title("Head", "og", "t", "h", "Head") == "Head" and title(None, None, None, "H", None) == "H" and title(None, None, "Mysite", "", "site") == "Mysite"
    assert title(None, None, "Left - right", None, "other") == "Left - right"
    about = lambda *v, n=300: one(fp.picked_description(*[F.lit(x).cast("string") for x in v], n))
    assert about("", None, "<p>First <script>x</script> words. Cookie policy applies here. End") == "First words. . End" and about("m", "o", "p") == "m" and about(None, None, None) == ""
    assert about("one two three four five", None, None, n=16) == "one two three…" and about("x" * 30, None, None, n=10) == "x" * 10 + "…"
    cats = lambda s, c: one(fp.item_categories(F.lit(s).cast("string"), F.array(*map(F.lit, c)) if c else F.lit(None).cast("array<string>")))
    assert cats("Sport", ["Home", "Tennis", "Cup"]) == ["Sport", "Tennis"] and cats(None, ["Home", "Page"]) == [] and cats("", ["A", "B"]) == ["A"] and cats("A", ["A", "B"]) == ["A"] and cats("S", None) == ["S"] and cats(None, ["x" * 41, "B"]) == []
    assert [one(fp.audio_type(F.lit(u))) for u in ("https://a/x.MP3?y", "x.oga", "x.png", "mp3")] == ["audio/mpeg", "audio/ogg", None, None]


def test_load_parts(spark):
    answers = spark.createDataFrame([
        ("a", "x.css", 200, "text/css", "gzip", 50_000, "h2"), ("a", "x.js?1", 200, None, None, 20_000, "h2"), ("a", "y.html", 404, "text/html", "identity", None, "h3"), ("a", "z.txt", 200, "", "", 100, None), ("a", "i.png", 301, "image/png", None, 90_000, "h2"),
    ], "load_id string, url string, status int, content_type string, encoding string, bytes long, protocol string")
    assert [tuple(r) for r in lp.answer_coverage(answers).collect()] == [("a", 5, 3, 1, 1, 4, 1, 2, "h2,h3")]
    files = spark.createDataFrame([
        ("a", "script", "https://a/jquery-3.7.1.min.js", 10, True, "a"), ("a", "script", "https://cdn/jQuery.v2.js?x", None, False, "a.example"), ("a", "script", "https://a/app.js", 5, False, "a"), ("a", "script", "https://a/app.js", 5, False, "a"),
        ("a", "style", "https://a/x.css", 7, True, "a"), ("a", "style", "https://a/x.css", 7, False, "a"), ("a", "style", "https://a/y.css", None, False, "a"),
    ], "load_id string, kind string, url string, bytes long, blocking boolean, page_host string")
    assert {tuple(r) for r in lp.duplicate_parts(files).collect()} == {("a", "script", "jquery", 2), ("a", "style", "https://a/x.css", 2)}
    assert {tuple(r) for r in lp.code_totals(files).collect()} == {("a", "script", 4, 20, 1, 1), ("a", "style", 3, 14, 1, 0)}


def test_font_and_image_issues(spark):
    faces = spark.createDataFrame([("a", "F", w, "block") for w in (300, 400, 500, 700)] + [("a", "G", 400, None), ("b", "F", 400, "swap"), ("c", "F", 400, "block")], "load_id string, family string, weight int, display string")
    resources = spark.createDataFrame([("a", "f.woff2", 100_000), ("a", "g.ttf?x", 60_000), ("c", "f.woff", 150 * 1024), ("c", "big.js", 999_999)], "load_id string, url string, bytes long")
    fonts = lp.font_issues(faces, resources)
    assert {tuple(r) for r in fonts.collect()} == {("a", "many weights", "low", 1), ("a", "invisible text", "medium", 4), ("a", "no display", "low", 1)}
    images = spark.createDataFrame([
        ("a", "1.png", 300_000, 1700, 1000, "lazy", True, True), ("a", "2.webp", 300_000, 1600, 1000, None, True, False), ("a", "3.jpg", None, None, None, "lazy", False, False), ("a", "4.gif", 204_801, 10, 10, "lazy", None, True),
    ], "load_id string, src string, bytes long, natural_w int, rendered_w int, loading string, in_viewport boolean, has_dimensions boolean")
    found = lp.image_issues(images)
    assert {tuple(r) for r in found.collect()} == {("a", "1.png", "lazy above the fold", "high"), ("a", "1.png", "larger than shown", "high"), ("a", "1.png", "old format", "medium"), ("a", "2.webp", "no dimensions", "medium"), ("a", "4.gif", "old format", "medium")}
    every = fonts.unionByName(found.select("load_id", "issue", "severity", F.lit(1).cast("long").alias("affected")))
    assert [(r.rank, r.issue) for r in lp.ranked_issues(every).orderBy("rank").collect()] == [(1, "larger than shown"), (2, "lazy above the fold"), (3, "invisible text"), (4, "old format"), (5, "no dimensions"), (6, "many weights"), (7, "no display")]


def test_category_names_keep_the_digits_of_their_place(spark):
    """A lone trim handed to transform takes an element's index for the signs to trim."""
    got = spark.range(1).select(fp.item_categories(F.lit(""), F.array(F.lit("fr"), F.lit("11111"))).alias("one"), fp.item_categories(F.lit(""), F.array(F.lit(" 0a "), F.lit("x"))).alias("two")).first()
    assert (got.one, got.two) == (["fr"], ["0a"])
