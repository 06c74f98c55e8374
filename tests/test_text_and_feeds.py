"""Text, message, page and feed jobs on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import lifecycle
from newsloom.sources import feeds, pages


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(expression).first()[0]


@pytest.mark.parametrize(
    "html,expected",
    [
        ("<p>One &amp; two</p>\n <b>three</b>", "One & two three"),
        ("&amp;lt;b", "<b"),
        ("A tale. The post A tale first appeared on Site.", "A tale."),
        ("Body text. Read more", "Body text"),
        ("Body text. READ THE FULL STORY.", "Body text"),
        ("Body ПОДРОБНЕЕ В СТАТЬЕ", "Body"),
        ("It is open-source", "It is open-source"),
        ("", ""),
    ],
)
def test_clean_html(spark, html, expected):
    assert one(spark, T.clean_html(F.col("h")), h=html) == expected


def test_older_suffix_rule(spark):
    assert one(spark, T.strip_boilerplate(F.col("h"), whole_words=False), h="It is open-source") == "It is open-"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("One fact. Visit https://x.y now. Another fact!", "One fact. Another fact!"),
        ("Plain. Stay tuned for more! Last…", "Plain. Last…"),
        ("**Read more**", ""),
        ("", ""),
    ],
)
def test_strip_links(spark, text, expected):
    assert one(spark, T.strip_links(F.col("t")), t=text) == expected


def test_post_text(spark):
    assert one(spark, T.format_post_text(F.col("t")), t="A a. B b. C c. D d. E e.") == "A a. B b.\n\nC c. D d.\n\nE e."
    assert one(spark, T.format_post_text(F.col("t")), t="First.\n\nSee www.x.y today.\n\nSecond. Third. Fourth.") == "First.\n\nSecond. Third. Fourth."
    assert one(spark, T.format_post_text(F.col("t")), t=" ") == ""


def test_messages(spark):
    plain = T.message_plain(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, plain, a="*T*", b="body", c="#x") == "T\n\nbody\n\n#x"
    long = one(spark, plain, a="T", b="y" * 5000, c="")
    assert len(long) == 4096 and long.endswith("...")
    html = T.message_html(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, html, a="A<b", b="x & y", c="#t") == "<b>A&lt;b</b>\n\nx &amp; y\n\n#t"
    cut = one(spark, html, a="T", b="z" * 2000, c="#t")
    assert len(cut) == 1024 and cut.endswith("…\n\n#t")


@pytest.mark.parametrize(
    "reply,path,title,text,tags",
    [
        ('{"title":"T","text":"B","hashtags":["a"]}', "strict", "T", "B", ["a"]),
        ('```json\n{"title":"T","text":"B","hashtags":["a"]}\n```', "strict", "T", "B", ["a"]),
        ('{"text":"First part. Second.","hashtags":"x y"}', "partial", "First part.", "First part. Second.", ["x", "y"]),
        ('{"title": "T", "text": "B\\nC", "hashtags": ["a"]', "loose", "T", "B\nC", ["a"]),
        ("nothing", "failed", "", "", []),
    ],
)
def test_replies(spark, reply, path, title, text, tags):
    out = T.parse_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (out.parse_path, out.title, out.text, out.hashtags) == (path, title, text, tags)


def test_rss(spark):
    xml = """<rss><channel><item><title>A</title><link>http://a</link><description>&lt;p&gt;d &lt;img src="i.png"&gt;&lt;/p&gt;</description><category>x</category><category>y</category></item>
    <item><title>B</title><guid>http://b</guid><description>short</description><content:encoded xmlns:content="c">long text</content:encoded><enclosure url="e.jpg" type="image/jpeg"/></item>
    <item><title>no link</title></item></channel></rss>"""
    out = feeds.read_rss(spark.createDataFrame([("f", xml)], "feed string, xml string"), 10).orderBy("position").collect()
    assert [(r.feed, r.title, r.link, r.description, r.image_url, r.categories) for r in out] == [("f", "A", "http://a", "d", "i.png", ["x", "y"]), ("f", "B", "http://b", "long text", "e.jpg", [])]
    assert feeds.read_rss(spark.createDataFrame([("f", xml)], "feed string, xml string"), 1).count() == 1


def test_atom(spark):
    xml = """<feed><entry><title>A</title><link rel="self" href="s"/><link rel="alternate" href="http://a"/><summary>sum</summary><updated>2024</updated><category term="t"/></entry>
    <entry><title>B</title><link rel="self" href="s"/><content type="html">c</content><published>2023</published></entry></feed>"""
    out = feeds.read_atom(spark.createDataFrame([(xml,)], "xml string")).orderBy("position").collect()
    assert [(r.title, r.link, r.description, r.pub_date, r.categories) for r in out] == [("A", "http://a", "sum", "2024", ["t"]), ("B", "s", "c", "2023", [])]


PARAGRAPH = "This is a paragraph with quite enough words to count as text of an article. "


def test_article_candidates(spark):
    body = "".join(f"<p>{i} {PARAGRAPH * 2}</p>" for i in range(4))
    heading = f"<html><h1>T</h1>{body}<footer>x</footer></html>"
    marked = f'<div>menu</div><div class="entry-content">{body}<footer><p>{PARAGRAPH * 30}</p>'
    linked = '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","articleBody":"' + PARAGRAPH * 20 + '"}]}</script><p>One short paragraph only.</p>'
    meta = f'<meta name="description" content="{PARAGRAPH}">'
    frame = spark.createDataFrame([(0, heading), (1, marked), (2, linked), (3, meta), (4, None)], "id long, html string")
    out = {r.id: r.article_text for r in pages.extract_articles(frame).collect()}
    assert out[0].startswith("0 This") and out[0].count("\n\n") == 3
    assert out[1].startswith("0 This") and len(out[1]) < 1000
    assert out[2] == (PARAGRAPH * 20).strip() and out[3] == PARAGRAPH.strip() and out[4] == ""
    short = {r.id: r.article_text for r in pages.extract_articles(frame, pages.Mode(80, 20, 50)).collect()}
    assert len(short[2]) == 51 and short[2].endswith("…")


def test_titles_and_images(spark):
    assert one(spark, pages.page_title(F.col("h")), h='<meta content="O &amp; P" property="og:title"><title>T</title>') == "O & P"
    html = '<img src="https://a.pix.example/2024/x.jpg?w=1"><img src="https://a.pix.example/avatars/2024/y.jpg">'
    assert one(spark, pages.image_urls(F.col("h"), "pix.example", 640), h=html) == ["https://a.pix.example/2024/x.jpg?width=640&format=jpg&auto=webp&quality=85"]
    urls = ["https://a.pix.example/2024/a.jpg?width=100&canvas=1", "https://a.pix.example/2024/a.jpg?canvas=1&width=900", "https://a.pix.example/2024/b.jpg"]
    frame = spark.createDataFrame([(urls, urls[0]), (urls, "https://a.pix.example/2024/c.jpg"), ([], "f")], "image_urls array<string>, feed_image string")
    assert [r.hero_image for r in pages.pick_hero_image(frame, "pix.example").collect()] == [urls[1], urls[0], "f"]


def test_enrich(spark):
    items = spark.createDataFrame([("http://a/?x", "short"), ("http://b", "w " * 60), ("http://c", "")], "link string, description string")
    articles = spark.createDataFrame([("http://A/", PARAGRAPH * 4), ("http://c", "")], "url string, article_text string")
    out = {r.link: r.description for r in pages.enrich(items, articles).collect()}
    assert out == {"http://a/?x": (PARAGRAPH * 4).strip(), "http://b": ("w " * 60).strip(), "http://c": ""}


def test_due_times(spark):
    t = lambda s: datetime.datetime.fromisoformat(s) if s else None
    rows = [
        (True, "2024-05-01T10:00", "minutes", 30, t("2024-05-02T09:00:00"), "2024-05-02T12:30:00"), (True, "2024-05-03T10:00", "minutes", 30, None, "2024-05-03T10:00:00"),
        (True, "", "hours", 2, t("2024-05-02T11:00:00"), "2024-05-02T13:00:00"), (True, "", "days", 1, t("2024-05-01T09:00:00"), "2024-05-02T12:10:00"),
        (True, "2024-05-01T08:00", "days", 2, t("2024-05-01T08:00:00"), "2024-05-03T08:00:00"), (True, "", "minutes", 5, None, "2024-05-02T12:10:00"), (False, "", "minutes", 5, None, None),
    ]
    frame = spark.createDataFrame([r[:5] for r in rows], "enabled boolean, start_at string, repeat_unit string, repeat_every int, last_run timestamp")
    assert [r.next_due for r in lifecycle.due_sources(frame, "2024-05-02 12:10:00").collect()] == [t(r[5]) for r in rows]


def test_reports_bound_their_lists(spark):
    from newsloom.operators import reports

    outcomes = spark.createDataFrame([("r", "error", f"e{i:03}") for i in range(150)] + [("r", "new", None), ("r", "error", "e000")], "run_id string, outcome string, error string")
    line = reports.funnel(outcomes).first()
    assert (line.error, line.new, line.errors) == (151, 1, [f"e{i:03}" for i in range(100)])
    records = spark.range(50).selectExpr("id", "if(id < 40, 1, null) as kept_post_id", "timestamp_seconds(id) as created_at", "'u' as duplicate_url", "'t' as duplicate_title", "'exact' as reason", "100 as ai_confidence")
    groups = {r.kept_post_id: r for r in reports.duplicate_groups(records, most=5).collect()}
    assert groups[1].n == 40 and [x.id for x in groups[1].records] == [39, 38, 37, 36, 35] and groups[None].n == 10


def test_guess_source_finds_hosts_anywhere(spark):
    from newsloom.operators import listing

    sources = spark.createDataFrame([(1, "http://x/feed", 5), (2, "https://news.example.com/rss", None), (3, "https://example.com/rss", None), (4, None, None)], "id long, url string, category_id long")
    posts = spark.createDataFrame([(1, "https://NEWS.example.com/a", None), (2, "https://my-example.com/x", None), (3, "ftp://none", None), (4, "https://n/a", 5), (5, None, None), (6, "", 9)], "id long, source_url string, category_id long")
    got = {r.id: r.guessed_source_url for r in listing.guess_source(posts, sources).collect()}
    # a host counts wherever it stands in the address, the source of least id first
    assert got == {1: "http://x/feed", 2: "http://x/feed", 3: "", 4: "http://x/feed", 5: "", 6: ""}


def test_jsonld_of_any_depth(spark):
    article = '{"@type": "NewsArticle", "articleBody": " Found "}'
    deep = article
    for level in range(60):
        deep = f'{{"@type": "Article", "articleBody": "later", "@graph": [{{"@type": "Thing"}}, {deep}]}}' if level % 2 else f"[1, null, {deep}]"
    cases = [
        (deep, "Found"), ("[" * 90_000, None), ('{"@type": ["Thing", "BLOGPOSTING"], "articleBody": "", "description": "%s"}' % ("d" * 120), "d" * 120), ('{"@type": "Article", "description": "short"}', None),
        ('{"@type": 7, "articleBody": "no"}', None), ('{"@type": "Article", "@graph": {"@type": "Article", "articleBody": "not a list"}, "articleBody": "own"}', "own"), ("no json", None), ("NaN", None), (f'[{article.replace("Found", "first")}, {article}]', "first"),
    ]
    rows = [(i, f"<p>x</p><script type='application/ld+json'>{j}</script>") for i, (j, _) in enumerate(cases)] + [(97, "<p>none</p>"), (98, None), (99, f"<script type='application/ld+json'>oops</script><script type='application/ld+json'>{article}</script>")]
    got = {r.i: r.body for r in spark.createDataFrame(rows, "i int, html string").select("i", pages.jsonld_body(F.col("html")).alias("body")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(cases)} | {97: None, 98: None, 99: "Found"}


def test_binaries_are_stored_once(spark, tmp_path):
    folder, kept = tmp_path / "files", str(tmp_path / "kept")
    (folder / "deep").mkdir(parents=True)
    for name, data in (("a.bin", b"\x00\xff" * 50), ("b.bin", b"\x01"), ("deep/c.bin", b"\x00\xff" * 50), ("skip.txt", b"no")):
        (folder / name).write_bytes(data)
    assert pages.read_binaries(spark, kept).count() == 0
    first = pages.store_binaries(pages.scan_binaries(spark, str(folder), "*.bin"), kept)
    assert len({r.digest for r in first.collect()}) == 2 and first.count() == 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    (folder / "d.bin").write_bytes(b"new")
    pages.store_binaries(pages.scan_binaries(spark, str(folder), "*.bin"), kept)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    assert before.items() <= after.items()
    assert sorted(bytes(r.content) for r in pages.read_binaries(spark, kept).collect()) == [b"\x00\xff" * 50, b"\x01", b"new"]
