"""Source divergence audit: how far the words of each source of a language are from the other sources', and which words tell.

Tasks count terms with Arrow's own functions (lower-case, split, dictionary codes, hash group-by) and hand out partial
counts; merged counts are cut into shards of terms, each a block of sources by terms, of which numpy sums the divergences.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.arrow_words import words_of
from newsloom.llm.common import slices, stored

#: What parts terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP = 10, 10
SLICE_BYTES = 4 << 20
#: Rows of partial counts that a task merges before it hands them out.
MERGE_ROWS = 200_000
#: Places, sources times terms, of a shard, and sources that one shard holds of a block.
SHARD_CELLS, SOURCE_BLOCK = 1 << 14, 1_024
SCALE = 1_000_000_000


def _partial(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some documents; a group's own row has a null term and its number of documents."""
    groups = pa.table({"lang": lang, "source": source, "row": pa.array(np.arange(len(texts)))})
    words = words_of(texts, BETWEEN)
    seen = pa.table({"row": pa.array(words.rows), "term": pa.array(words.codes)}).group_by(["row", "term"]).aggregate([([], "count_all")])
    at = seen.column("row").combine_chunks()
    named = pa.table({"lang": groups.column("lang").take(at), "source": groups.column("source").take(at), "term": words.different.take(seen.column("term").combine_chunks()), "n": seen.column("count_all")})
    terms = named.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")]).rename_columns({"n_sum": "n", "count_all": "docs"})
    own = groups.group_by(["lang", "source"]).aggregate([([], "count_all")])
    own = pa.table({"lang": own.column("lang"), "source": own.column("source"), "term": pa.nulls(own.num_rows, pa.string()), "n": pa.array(np.zeros(own.num_rows, np.int64)), "docs": own.column("count_all")})
    return pa.concat_tables([terms.select(own.column_names), own])


def _merged(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts)
    return table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns({"n_sum": "n", "docs_sum": "docs"})


def _in_batches(table: pa.Table) -> list[pa.RecordBatch]:
    text = lambda name: table.column(name).cast(pa.string())
    return pa.table({"lang": text("lang"), "source": text("source"), "term": text("term"), "n": table.column("n"), "docs": table.column("docs")}).to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; a row of null term for the group.

    Tasks merge what they count, so a common term costs a task one row a group, and only partial counts are shuffled.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in slices(batches, 2, SLICE_BYTES):
            held.append(_partial(*[c.cast(pa.string()) for c in batch.columns]))
            if sum(t.num_rows for t in held) >= MERGE_ROWS:
                held = [_merged(held)]
                if held[0].num_rows >= MERGE_ROWS // 2:  # mostly different terms: nothing is won by keeping them
                    yield from _in_batches(held.pop())
        if held:
            yield from _in_batches(_merged(held))

    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) of columns by name, in whole numbers of up to 38 digits; where there are
    no terms nothing has a share, and the value is of no account."""
    return F.expr(f"1 + ({SCALE}BD * cast({n} + 2 as decimal(20,0))) div cast(greatest({total} + 2 * {terms}, 1) as decimal(20,0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n): of each language the terms of `least` of its documents or more, where they occur."""
    found = counts.where("term is not null")
    terms = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    return found.drop("docs").join(terms, ["lang", "term"])


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, terms, sources) of every group that occurs, those without terms too."""
    groups = counts.where("term is null").select("lang", "source")
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang")).join(kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    return groups.join(by_group, ["lang", "source"], "left").join(sizes.join(by_lang, "lang", "left"), "lang").fillna(0, ["n_group", "n_lang", "terms"])


def pair_sums(shares: DataFrame, totals: DataFrame, cells: int = SHARD_CELLS, block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, a, b, value), a < b: the divergence of each two sources of a language, summed over all its kept terms.

    shares: lang, term, source, p, where the source has the term. A shard is some terms of a language and two blocks of its
    sources; it starts from the share of a term that a source lacks (p0). Shards are so many that each has about `cells`
    places, and as many places as results at least.
    """
    blocks = F.ceil(F.col("sources") / block).cast("int")
    wide = F.least(F.col("sources"), F.lit(2 * block))
    shards = F.greatest(F.lit(1), F.ceil(F.col("terms") * wide / F.greatest(F.lit(cells), wide * wide))).cast("int")
    plan = totals.select("lang", "source", share("0L", "n_group", "terms").alias("p0"), blocks.alias("blocks"), shards.alias("shards")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    held = shares.join(plan, ["lang", "source"])
    shard = F.pmod(F.xxhash64("term"), F.col("shards").cast("long")).cast("int").alias("shard")
    filled = held.select("lang", "source", "term", "p", "block", shard, F.lit(0).cast("long").alias("terms"), other)
    many = shares.select("lang", "term").distinct().join(plan.select("lang", "shards").distinct(), "lang").groupBy("lang", shard).agg(F.count("*").alias("terms"))
    empty = plan.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "blocks")
    empty = empty.join(many, ["lang", "shard"], "left").select("lang", "source", "term", "p", "block", "shard", F.coalesce("terms", F.lit(0)).alias("terms"), other)
    rows = filled.unionByName(empty).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")

    def sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        own = table.filter(pc.is_null(table.column("term")))
        names, base = own.column("source").to_pylist(), own.column("p").to_numpy()
        home = own.column("block").to_numpy()
        rest = table.filter(pc.is_valid(table.column("term")))
        terms = rest.column("term").combine_chunks().dictionary_encode()
        at = pc.index_in(rest.column("source").combine_chunks(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        p = np.repeat(base[:, None], len(terms.dictionary), axis=1)
        p[at, terms.indices.to_numpy(zero_copy_only=False)] = rest.column("p").to_numpy()
        lacking = int(own.column("terms")[0].as_py()) - len(terms.dictionary)  # terms of the shard that none of these sources has
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        p, base, home, names = p[order], base[order], home[order], [names[i] for i in order]
        first, second, values = [], [], []
        for i in range(len(names) - 1):
            others = np.arange(i + 1, len(names))
            if low != high:
                others = others[home[others] != home[i]]
            first += [names[i]] * len(others)
            second += [names[j] for j in others]
            unseen = (base[others] - base[i]) ** 2 // (base[others] + base[i])
            values += (((p[others] - p[i]) ** 2 // (p[others] + p[i])).sum(axis=1) + lacking * unseen).tolist()
        return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()), "value": pa.array(values, pa.int64())})

    parts = rows.groupBy("lang", "shard", "low", "high").applyInArrow(sums, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, cells: int = SHARD_CELLS, block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of documents of one language and source

    * part `pair`: every other source of the language by its divergence from the group, over all kept terms;
    * part `term`: the `top` kept terms that the group has more often than its language, by their part in the divergence.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; a language keeps those of `least` of its
    documents or more. Shares count two more of each kept term. Ties go to the item that comes first in UTF-8.

    Null text, lang and source count as ''. Rows that repeat are documents each. A group without terms has the shares of
    unseen terms; a language without kept terms has pairs of value 0 and no terms; a lone source has no pairs. Very long
    texts count whole; other columns, whatever their names, are not read. No docs, no rows.
    """
    counts = stored(term_counts(docs), "term-counts")
    kept = stored(kept_terms(counts, least), "kept-terms")
    totals = stored(group_totals(counts, kept), "group-totals")
    shares = kept.join(totals, ["lang", "source"]).withColumns({"p": share("n", "n_group", "terms"), "q": share("lang_n", "n_lang", "terms")})
    pairs = pair_sums(shares.select("lang", "term", "source", "p"), totals, cells, block)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).cast("int")
    best = terms.withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(best)


ORACLE = f"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
words as (select d, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct d) >= {LEAST_DOCS}),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept using (lang, term) group by w.lang, w.source, w.term),
totals as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from groups g left join counts c using (lang, source) group by g.lang, g.source),
shares as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) as p, 1 + ({SCALE}::hugeint * (k.n + 2)) // (l.total + 2 * l.v) as q
    from totals t join langs l using (lang) join kept k using (lang) left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
both_parts as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    union all
    select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from both_parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}
"""
