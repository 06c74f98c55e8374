"""Text and message expressions: HTML to text, boilerplate, post text, messages, prompts and replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What feeds append to texts, cut to the end of the text.
TAIL_PATTERNS = [
    r"\s*the post\b.*?\bfirst appeared on\b.*$",
    r"\s+(?:\S+\s+)?appeared first on\b.*$",
    r"\s*\boriginally published (?:on|at|in)\b.*$",
    r"\s*\bas originally published (?:on|at|in)\b.*$",
    r"\s*\bthis (?:story|article) (?:was )?(?:originally )?published (?:on|at|in)\b.*$",
    r"\s*\bcontinue reading (?:at|on)\b.*$",
    r"\s*\bclick here to (?:read|view)\b.*$",
    r"\s*\bfor more, (?:read|visit|see)\b.*$",
    r"\s*\bподробнее в статье\.?\s*$",
    r"\s*\bподробности в статье\.?\s*$",
    r"\s*\bimage credit\b:.*$",
]
# Phrases cut from the end of texts, each with or without a full stop.
SUFFIX_PHRASES = [
    "read more", "continue reading", "see more", "full story", "read the full story", "view full article", "source",
    "читать далее", "подробнее", "подробнее в статье", "подробности в статье",
]
# Whole paragraphs that are boilerplate.
PARAGRAPH_PATTERNS = [
    r"^the post\b.*\bfirst appeared on\b",
    r"^.*\bappeared first on\b",
    r"^(?:read|view|see) (?:more|full (?:story|article))\.?$",
    r"^continue reading\.?$",
    r"^source\.?$",
    r"^originally published (?:on|at|in)\b",
    r"^this (?:story|article) (?:was )?(?:originally )?published\b",
    r"^читать далее\.?$",
    r"^подробнее\.?$",
]
# Calls to action.
CTA_MARKERS = [
    "подробнее в статье", "подробности в статье", "читайте полностью", "читать полностью", "читайте в источнике",
    "подробности по ссылке", "следите за календар", "следите за релиз", "следите за новост", "следите за обновлен",
    "чтобы ничего не пропустить", "чтобы не пропустить", "не пропустите релиз", "не пропустите выход",
    "осталось следить за", "следим за календар", "read more", "read the full", "read the article",
    "details in the article", "more in the article", "more details in the article", "see the full article",
    "full story", "link in bio", "click here to read", "continue reading", "stay tuned", "don't miss", "don’t miss",
    "keep an eye on", "follow for updates", "watch for updates",
]
CTA_PATTERNS = [
    r"следите за\b.{0,80}\b(?:чтобы )?ничего не пропустить",
    r"следите за\b.{0,80}\b(?:релиз|календар|анонс|обновлен)",
    r"(?:не )?пропустите\b.{0,60}\b(?:релиз|выход|анонс|новост)",
    r"keep an eye on\b.{0,80}\b(?:release )?calendar",
]
# Names of languages in prompts.
LANGUAGES = {"": "русский", "ru": "русский", "rus": "русский", "russian": "русский", "en": "английский", "eng": "английский", "english": "английский"}


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return trimmed(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def cut(c: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def bind(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_boilerplate(c: Column, tails=TAIL_PATTERNS, phrases=SUFFIX_PHRASES, whole_words: bool = True) -> Column:
    """Without what feeds append. whole_words: a phrase has to stand alone, in letters of any case; else (the older rule)
    it may end a longer word, only a-z match A-Z, and of phrases that end alike the shorter goes first."""
    out = trimmed(c)
    for pattern in tails:
        out = F.regexp_replace(out, f"(?isU){pattern}", "")
    own = sorted(phrases, key=lambda p: -len(p)) if whole_words else [p for p in phrases if not any(p != q and p.endswith(q) for q in phrases)]
    either = "|".join(re.escape(p).replace(r"\ ", " ") for p in own)
    pattern = rf"(?iU)(?:(?:^|(?<=[\s.])|\s+|\.+\s*)(?<!\w)(?:{either})\.*\s*)+$" if whole_words else rf"(?i)(?:\s*\.*\s*(?:{either})\.?)+$"
    return trimmed(F.regexp_replace(out, pattern, ""))


def clean_html(c: Column, **options) -> Column:
    """Tags to spaces, four entities decoded, white space compacted, boilerplate stripped; script bodies stay."""
    out = F.regexp_replace(blank(c), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip_boilerplate(compact(out), **options)


def is_boilerplate_par(c: Column, patterns=PARAGRAPH_PATTERNS) -> Column:
    own = trimmed(c)
    found = F.lit(False)
    for p in patterns:
        found = found | own.rlike(f"(?isU){p}")
    return (own == "") | ((F.octet_length(own) <= 280) & found)


def has_url(c: Column) -> Column:
    return blank(c).rlike(r"(?iU)(https?://\S+|www\.\S+)")


def is_cta(c: Column, markers=CTA_MARKERS, patterns=CTA_PATTERNS) -> Column:
    either = "|".join([*(re.escape(m).replace(r"\ ", " ") for m in markers), *patterns]) or "(?!)"
    own = F.lower(trimmed(F.regexp_replace(trimmed(c), r"^\*+|\*+$", "")))
    return own.rlike(f"(?U){either}")


def sentences(c: Column) -> Column:
    """Split after words that end with . ! ? or an ellipsis."""
    return F.filter(F.split(F.regexp_replace(compact(c), r"([.!?…]) ", "$1\u0001"), "\u0001"), lambda s: s != "")


def _without_links(c: Column, **lists) -> Column:
    return F.array_join(F.filter(sentences(c), lambda s: ~(has_url(s) | is_cta(s, **lists))), " ")


def strip_links(c: Column, **lists) -> Column:
    """One line, without sentences that have a link or call to action."""
    return _without_links(c, **lists)


def format_post_text(c: Column, each: int = 2, **lists) -> Column:
    """Paragraphs without link sentences; a single paragraph becomes paragraphs of two sentences."""
    parts = bind(trimmed(c), lambda own: F.when(F.contains(own, F.lit("\n\n")), F.split(own, "\n\n")).otherwise(F.split(own, "\n")))
    kept = F.filter(F.transform(parts, lambda p: _without_links(p, **lists)), lambda p: p != "")

    def grouped(one: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(one) - 1) / each).cast("int")), lambda i: F.array_join(F.slice(one, i * each + 1, F.lit(each)), " "))
        return F.when(F.size(one) <= each, F.array_join(one, " ")).otherwise(F.array_join(groups, "\n\n"))

    return bind(kept, lambda k: F.when(F.size(k) == 0, "").when(F.size(k) > 1, F.array_join(k, "\n\n")).otherwise(bind(sentences(F.get(k, F.lit(0))), grouped)))


def escape_html(c: Column) -> Column:
    out = blank(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def message_plain(title: Column, text: Column, hashtags: Column, most: int = 4096) -> Column:
    """Title, text and hashtags with blank lines between, at most 4096 characters."""
    name = F.replace(F.trim(blank(title)), F.lit("*"), F.lit(""))
    body = F.when(trimmed(text) == "", "").otherwise(F.concat(F.when(name == "", "").otherwise(F.lit("\n\n")), blank(text)))
    head = F.concat(name, body)
    tags = F.when(trimmed(hashtags) == "", "").otherwise(F.concat(F.when(head == "", "\n").otherwise(F.lit("\n\n")), blank(hashtags)))
    out = F.concat(head, tags)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def message_html(title: Column, text: Column, hashtags: Column, most: int = 1024) -> Column:
    """A bold title, the text as far as it fits and the hashtags, escaped."""
    header = F.concat(F.lit("<b>"), escape_html(title), F.lit("</b>"))
    footer = F.when(blank(hashtags) == "", "").otherwise(F.concat(F.lit("\n\n"), escape_html(hashtags)))
    room = F.greatest(F.lit(0), most - F.length(header) - F.length(footer) - F.when(blank(text) == "", 0).otherwise(2))
    own = escape_html(text)
    own = F.when(F.length(own) > room, F.concat(F.substring(own, F.lit(1), F.greatest(room - 1, F.lit(0))), F.lit("…"))).otherwise(own)
    return F.when(own == "", F.concat(header, footer)).otherwise(F.concat(header, F.lit("\n\n"), own, footer))


def format_hashtags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), t))), " ")


def site_origin(url: Column) -> Column:
    found = F.regexp_extract(blank(url), r"^(https?://[^/]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/")))


def truncate_for_ai(c: Column, most: int = 500) -> Column:
    return F.substring(compact(c), 1, most)


def language_label(code: Column) -> Column:
    own = F.lower(F.trim(blank(code)))
    out = own
    for k, v in LANGUAGES.items():
        out = F.when(own == k, v).otherwise(out)
    return out


def build_prompts(posts: DataFrame, template: str, language: Column | str = "en", context: str = "web_context") -> DataFrame:
    """Adds `prompt`: the template with title, description, category, language and web_context filled in."""
    own = language if isinstance(language, Column) else F.lit(language)
    web = blank(F.col(context)) if context in posts.columns else F.lit("")
    values = {"title": F.col("raw_title"), "description": F.col("raw_description"), "category": F.col("category_name"), "language": language_label(own), "web_context": F.when(web == "", "").otherwise(F.concat(F.lit("\nДополнительный контекст из интернета:\n"), web))}
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), blank(value))
    return posts.withColumn("prompt", out)


def strip_fence(c: Column) -> Column:
    own = trimmed(c)
    inner = trimmed(F.regexp_replace(F.regexp_replace(own, r"^(?:```json)*(?:```)*", ""), r"(?:```)+$", ""))
    return F.when(F.startswith(own, F.lit("```")), inner).otherwise(own)


def _title_from(text: Column) -> Column:
    own = compact(text)
    sentence = F.regexp_extract(own, r"^[^.!?]*[.!?]?", 0)
    sentence = F.when(F.trim(sentence) == "", own).otherwise(F.trim(sentence))
    return F.when(F.length(sentence) > 80, F.concat(F.substring(sentence, 1, 79), F.lit("…"))).otherwise(sentence)


def parse_replies(df: DataFrame, column: str = "reply") -> DataFrame:
    """Adds title, text, hashtags (array) and parse_path: strict, partial, loose or failed.

    strict: an object with title, text and a list of hashtags; partial: any JSON object with a title or a text; loose:
    fields found by pattern in broken JSON. A missing title is made from the text's first sentence, a missing text is
    the title.
    """
    body = strip_fence(F.col(column))
    value = F.try_parse_json(body)
    strict = F.from_json(body, "struct<title: string, text: string, hashtags: array<string>>", {"mode": "PERMISSIVE"})
    typed = F.coalesce(F.schema_of_variant(value), F.lit(""))
    get = lambda f: F.try_variant_get(value, f"$.{f}", "string")
    is_text = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")) == "STRING", F.lit(False))
    tag_list = F.coalesce(F.schema_of_variant(F.try_variant_get(value, "$.hashtags", "variant")), F.lit(""))
    string_list = tag_list.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>")
    is_strict = is_text("title") & is_text("text") & string_list
    title = F.when(is_text("title"), trimmed(get("title"))).otherwise("")
    text = F.when(is_text("text"), trimmed(get("text"))).otherwise("")
    tags = F.when(string_list, strict["hashtags"]).when(tag_list == "STRING", F.filter(F.split(get("hashtags"), r"\s+"), lambda t: t != ""))
    loose = lambda pattern: trimmed(F.replace(F.replace(F.replace(F.regexp_extract(body, pattern, 1), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    # Possessive loops: others call themselves for each character, and a long text runs out of stack.
    l_title, l_text = loose(r'"title"\s*:\s*"((?:\\.|[^"\\]++)*+)"'), loose(r'"text"\s*:\s*"((?:\\.|[^"\\]++)*+)')
    l_tags = F.from_json(F.regexp_extract(body, r'"hashtags"\s*:\s*(\[(?:\\.|[^\]\\]++|\\(?!.))*+\]|\[(?s:.*)\])', 1), "array<string>")
    path = (
        F.when(F.startswith(typed, F.lit("OBJECT")) & is_strict, "strict")
        .when(F.startswith(typed, F.lit("OBJECT")) & ((title != "") | (text != "")), "partial")
        .when((l_title != "") | (l_text != ""), "loose")
        .otherwise("failed")
    )
    out = df.withColumn("parse_path", path)
    by_json = F.col("parse_path").isin("strict", "partial")
    out = out.withColumn("_title", F.when(by_json, title).when(F.col("parse_path") == "loose", l_title).otherwise("")).withColumn("_text", F.when(by_json, text).when(F.col("parse_path") == "loose", l_text).otherwise(""))
    none = F.array().cast("array<string>")
    out = out.withColumn("hashtags", F.coalesce(F.when(by_json, tags).when(F.col("parse_path") == "loose", l_tags), none))
    return out.withColumn("title", F.when((F.col("_title") == "") & (F.col("_text") != ""), _title_from(F.col("_text"))).otherwise(F.col("_title"))).withColumn("text", F.when(F.col("_text") == "", F.col("_title")).otherwise(F.col("_text"))).drop("_title", "_text")


def parse_verdicts(df: DataFrame, column: str = "reply") -> DataFrame:
    """Adds is_duplicate, confidence and explanation of a pairwise judgement; all null where the reply is no such JSON."""
    own = F.from_json(strip_fence(F.col(column)), "struct<is_duplicate: boolean, confidence: int, explanation: string>")
    whole = own["is_duplicate"].isNotNull() & own["confidence"].isNotNull() & own["explanation"].isNotNull()
    return df.withColumns({f: F.when(whole, own[f]) for f in ("is_duplicate", "confidence", "explanation")})
