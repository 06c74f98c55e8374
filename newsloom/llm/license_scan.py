"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

Native throughout: DataFrame operations and built-in functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import text_of

#: Phrases that are labels by themselves.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates: a block of text that contains so many of a template's different words is under that license.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Share of a template's different words that a block has to contain.
CONTAINMENT = 0.9
#: A line, and the whole text, of more than twice so many words is cut into blocks of twice so many, one at each so many; a
#: longer template makes longer blocks.
STRIDE = 64
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates travel with the plan and in a broadcast: no more words than this in all.
MAX_TEMPLATE_WORDS = 20_000


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, once A-Z are lower-cased; other letters keep their case."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _places(own: Column, joined: Column, phrase: list[str]) -> Column:
    def here(i: Column) -> Column:
        held = F.get(own, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            held = held & (F.get(own, i + k) == word)
        return held

    found = F.filter(F.sequence(F.lit(0), F.size(own) - len(phrase)), here)
    return F.when(F.contains(joined, F.lit(f" {' '.join(phrase)} ")), found).otherwise(F.array().cast("array<int>"))


def base_labels(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (sorted distinct labels) for the phrases in `text`."""
    out = docs.withColumn("_words", words(text_of())).withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    for i, (phrase, _) in enumerate(phrases):
        out = out.withColumn(f"_at{i}", _places(F.col("_words"), F.col("_joined"), phrase.split(" ")))
    out = out.withColumn("_all", F.concat(*[F.col(f"_at{i}") for i in range(len(phrases))]))
    labels = F.array(*[F.when(F.size(f"_at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
    )


def blocks(docs: DataFrame, *keys: str, stride: int = STRIDE) -> DataFrame:
    """Keys and `words` of every block: the lines of a text and, so that what is wrapped over lines lies in one block too,
    the text as one line; those of more than twice `stride` words cut so that any `stride` words in a row lie in one."""
    split = F.split(text_of(), r"[\r\n]+")
    split = F.when(F.size(split) > 1, F.concat(split, F.array(text_of()))).otherwise(split)
    lines = docs.select(*keys, F.explode(split).alias("_line"))
    lines = lines.select(*keys, words(F.col("_line")).alias("_words")).where(F.size("_words") > 0)
    n = F.size("_words")
    starts = F.when(n <= 2 * stride, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - stride - 1, F.lit(stride)))
    cut = lines.withColumn("_start", F.explode(starts))
    return cut.select(*keys, F.slice("_words", F.col("_start") + 1, 2 * stride).alias("words"))


def stride_of(templates) -> int:
    """Windows overlap by so many words: by the words of the longest template, which then lies whole in one of them."""
    return max([STRIDE, *(len(_template_words(text)) for _, text in templates)])


def template_links(docs: DataFrame, *keys: str, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """keys, label, containment for every block of docs and template whose containment reaches the threshold.

    Blocks are lines and windows of the whole text, as long as the longest template at least. Words are ordered by how many documents have them, rarest first. A block and a template that share enough words
    share one in the first |T| - o + 1 of the template's and the first |B| - o + 1 of the block's (prefix filter; o: words
    that the threshold needs, B: the block's words that any template has, as no others can be shared). Blocks with
    fewer than o such words go (length filter), and pairs whose first shared word stands too late to leave o (positional
    filter); the rest are counted exactly.
    """
    sets = [(label, sorted(set(_template_words(text)))) for label, text in templates]
    sets = [(label, own, max(1, math.ceil(containment * len(own) - 1e-9))) for label, own in sets if own]
    vocabulary = sorted({w for _, own, _ in sets for w in own})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many words in the templates")
    spark = docs.sparkSession
    schema = docs.select(*keys).schema
    if not vocabulary:
        return docs.select(*keys, F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    held = F.array_intersect(F.lit(vocabulary), words(text_of()))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()  # a row for each template word
    counts = {r.word: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for number, (label, own, need) in enumerate(sets):
        own = sorted(own, key=rank.get)
        prefixes += [(word, at, label, own, need) for at, word in enumerate(own[: len(own) - need + 1])]
    least = min(need for _, _, need in sets)
    heads = sorted({p[0] for p in prefixes}, key=rank.get)
    table = spark.createDataFrame(prefixes, "word string, t_at int, label string, t_words array<string>, need int")
    found = blocks(docs, *keys, stride=stride_of(templates)).select(*keys, F.array_intersect(F.lit(order), F.col("words")).alias("b_words")).where(F.size("b_words") >= least)
    prefix = F.slice("b_words", F.lit(1), F.size("b_words") - least + 1)
    found = found.select(*keys, "b_words", F.explode(F.array_intersect(prefix, F.lit(heads))).alias("word"))
    found = found.join(F.broadcast(table), "word")  # bounded by MAX_TEMPLATE_WORDS
    b_at = F.array_position("b_words", F.col("word")).cast("int") - 1
    room = F.least(F.size("b_words") - b_at, F.size("t_words") - F.col("t_at"))
    found = found.where((F.size("b_words") >= F.col("need")) & (b_at <= F.size("b_words") - F.col("need")) & (room >= F.col("need")))
    shared = F.array_intersect("t_words", "b_words")
    found = found.where((F.size(shared) >= F.col("need")) & (F.get(shared, F.lit(0)) == F.col("word")))  # at its first shared word only
    return found.select(*[f.name for f in schema], "label", (F.size(shared) / F.size("t_words")).alias("containment"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    base_labels: of the phrases that stand in the text, word by word; labels: those and the templates'; both distinct,
    sorted, comma-joined, empty if there are none. score: 1 if a phrase is there, else the best containment that reached
    the threshold, else 0. Templates are looked for in lines and across them. A null text is an empty one. Rows that repeat give equal rows; a null doc_id stays null.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_key", F.xxhash64("text"))
    links = template_links(rows, "doc_id", "_key", templates=templates, containment=containment)
    best = links.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash")).agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
    based = base_labels(rows, phrases).drop("text")
    out = based.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("_found", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def oracle(phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same by comparing every block with every template; for DuckDB."""
    stride = stride_of(templates)
    ascii_words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    spots = ", ".join(
        "list_filter(range(0, greatest(0, len(w) - {n} + 1)), lambda i: {test}) as at{k}".format(
            n=len(p.split()), k=k, test=" and ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))
        )
        for k, (p, _) in enumerate(phrases)
    )
    every = " || ".join(f"at{k}" for k in range(len(phrases)))
    base = "list_filter([" + ", ".join(f"case when len(at{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(phrases)) + "], lambda x: x is not null)"
    sets = [(label, sorted(set(_template_words(t)))) for label, t in templates]
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in own)}], {max(1, math.ceil(containment * len(own) - 1e-9))})" for label, own in sets)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, {ascii_words.format('text')} as w from d),
p as (select r, doc_id, w, {spots} from w),
b as (select r, doc_id, len(w) as n_words, list_sort({every}) as places, list_sort(list_distinct({base})) as base from p),
l as (select r, unnest(string_split_regex(text, '[\\r\\n]+')) as line from d union all select r, text from d where regexp_matches(text, '[\\r\\n]')),
lw as (select r, {ascii_words.format('line')} as w from l),
k as (select r, unnest(case when len(w) <= {2 * stride} then [w] else list_transform(range(0, len(w) - {stride}, {stride}), lambda s: w[s + 1 : s + {2 * stride}]) end) as w from lw where len(w) > 0),
t(label, words, need) as (values {values}),
m as (select r, list_distinct(list(label)) as found, max(shared / len(words)) as best
      from (select r, label, words, need, len(list_intersect(words, w)) as shared from k, t) where shared >= need group by r)
select doc_id, n_words::bigint as n_words, len(places)::bigint as n_base, places[1]::bigint as first_word, places[-1]::bigint as last_word,
    array_to_string(base, ',') as base_labels,
    array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') as labels,
    case when len(places) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from b left join m using (r)
"""
