"""Queries pass whole texts and all rows to their operators."""

from newsloom.plans import queries_core, queries_text
from newsloom.sources import pages


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn int, role string, text string"


def test_enrich_items_has_whole_descriptions(spark, tmp_path):
    text = "A plain sentence of the page that goes on. " * 40
    written(spark, tmp_path, "pages", [(1, "http://a.example/1", text + "The end.")], PAGES)
    (row,) = queries_text.enrich_items(spark, str(tmp_path)).collect()
    assert row.description.startswith("A plain sentence") and row.description.endswith("The end.")


def test_boilerplate_paragraphs_judges_every_paragraph(spark, tmp_path):
    written(spark, tmp_path, "pages", [(1, "u", "<p> </p><p>short</p>" + "<p>A paragraph of some length here.</p>" * 100)], PAGES)
    rows = queries_text.boilerplate_paragraphs(spark, str(tmp_path)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(102)) and rows[1].stripped == "short"
    assert [r.boilerplate for r in rows] == [True] + [False] * 101


def test_replies_with_quotes_and_backslashes_are_parsed(spark, tmp_path):
    text = 'he said "no" and C:\\new'
    written(spark, tmp_path, "conversations", [(i, 1, "assistant", text) for i in range(4)], TURNS)
    got = {r.conv_id: (r.parse_path, r.text) for r in queries_text.parse_replies(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0] == got[1] == ("strict", text) and got[2] == ("partial", text)


def test_read_rss_reads_every_post_of_a_hot_source(spark, tmp_path):
    written(spark, tmp_path, "documents", [(i, f"Title {i}. " + "word " * 60, "en", "src1", 9) for i in range(70)], DOCS)
    rows = queries_text.read_rss(spark, str(tmp_path)).collect()
    assert sorted(r.title for r in rows) == sorted(f"Title {i}" for i in range(70))


def test_replies_of_any_length_are_parsed(spark, tmp_path):
    text = "a long reply without an end " * 4_000
    written(spark, tmp_path, "conversations", [(i, 1, "assistant", text) for i in range(4)], TURNS)
    got = {r.conv_id: (r.parse_path, r.text) for r in queries_text.parse_replies(spark, str(tmp_path)).collect()}
    assert got == {i: (("strict", "strict", "partial", "loose")[i], text.strip()) for i in range(4)}


def test_loose_fields_are_those_of_the_plain_patterns(spark):
    """Any broken reply gives what patterns that may go back give."""
    import json
    import random
    import re

    from newsloom.functions import text as T

    draw = random.Random(4)
    junk = lambda n: "".join(draw.choice('\\]["a,\n') for _ in range(draw.randrange(n)))
    replies = [f'{{"title": "{junk(6)}", "text": "{junk(9)}, "hashtags": ["b", "c{junk(4)}"{junk(3)}]{junk(4)}' for _ in range(1_500)]
    rows = spark.createDataFrame(list(enumerate(replies)), "id long, reply string")
    clean = lambda s: s.replace("\\n", "\n").replace('\\"', '"').replace("\\\\", "\\").strip()

    def plain(pattern, reply):
        found = re.search(pattern, reply.strip())
        return found[1] if found else ""

    def tags(own):
        try:
            return json.loads(own)
        except ValueError:
            return None

    listings = set()
    for r in T.parse_replies(rows).collect():
        title, body = (clean(plain(p, r.reply)) for p in (r'"title"\s*:\s*"((?:\\.|[^"\\])*)"', r'"text"\s*:\s*"((?:\\.|[^"\\])*)'))
        assert r.parse_path in ("loose", "failed") and (r.parse_path == "loose") == (title != "" or body != "")
        assert r.text == (body or title)
        listed = tags(plain(r'"hashtags"\s*:\s*(\[(?:\\.|[^\]])*\])', r.reply))
        if r.parse_path == "loose" and listed is not None and all(isinstance(x, str) for x in listed):
            assert r.hashtags == listed
            listings.add(tuple(listed))
    assert len(listings) > 10


def test_rewrites_by_replies_of_any_length_are_applied(spark, tmp_path):
    text = "A long reply that goes on and on. " * 4_000
    written(spark, tmp_path, "conversations", [(7, 1, "assistant", text)], TURNS)
    written(spark, tmp_path, "documents", [(7, "Title. And a text.", "en", "src1", 18)], DOCS)
    (row,) = queries_text.apply_rewrites(spark, str(tmp_path)).collect()
    assert (row.status, row.ai_title, row.ai_hashtags) == ("approved", "t", "#a") and len(row.ai_text.split()) == 4_000 * 8


def test_duplicate_groups_list_every_record(spark, tmp_path):
    written(spark, tmp_path, "documents", [(i, f"One title. Text {i}.", "en", "src1", 20) for i in range(1_300)], DOCS)
    got = {r.kept_post_id: (r.n, len(r.urls), len(set(r.urls))) for r in queries_core.duplicate_groups(spark, str(tmp_path)).collect()}
    assert got == {1_299: (1_299, 1_299, 1_299), 1_298: (1, 1, 1)}


#: An article of short capitalised words in two sentences, as a menu has, and another page.
MENU_LIKE = "<html><title>T</title><h1>T</h1><article><p>" + "Word Other small " * 20 + "</p><p>" + "Name thing Place " * 12 + ".</p></article></html>"


def test_articles_like_menus_are_extracted_without_markers(spark, tmp_path):
    written(spark, tmp_path, "pages", [(1, "http://a.example/1", MENU_LIKE)], PAGES)
    (row,) = queries_text.extract_articles(spark, str(tmp_path)).collect()
    assert row.article_text == ("Word Other small " * 20).strip() + "\n\n" + "Name thing Place " * 12 + "."
    (with_rule,) = pages.extract_articles(spark.createDataFrame([(MENU_LIKE,)], "html string")).collect()
    assert with_rule.article_text == ""


def test_items_get_page_texts_like_menus_without_markers(spark, tmp_path):
    written(spark, tmp_path, "pages", [(2, "http://a.example/2", MENU_LIKE), (3, "http://a.example/3", "Word Other " * 30)], PAGES)
    got = {r.page_id: r.description for r in queries_text.enrich_items(spark, str(tmp_path)).collect()}
    assert got[2].startswith("Word Other small") and got[2].endswith("Place .") and got[3] == ("Word Other " * 30).strip()


def test_pages_like_menus_are_read_anew_without_markers(spark, tmp_path):
    written(spark, tmp_path, "pages", [(1, "http://a.example/1", MENU_LIKE)], PAGES)
    (row,) = queries_text.reprocess(spark, str(tmp_path)).collect()
    assert row.raw_title == "T" and row.raw_description.endswith("Place .")
