"""Registered queries: text, page, feed, similarity and near-duplicate jobs over the derived posts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import predicates, similarity
from newsloom.functions import text as T
from newsloom.operators import dedup, lifecycle, listing
from newsloom.plans import views
from newsloom.plans.registry import query
from newsloom.sources import feeds, pages
from newsloom.steps import new_dir

S = views.SQL
NORM_URL = "lower(regexp_replace(regexp_replace({}, '[?#].*', ''), '/+$', ''))"
FAMILY = "e5_base"
STOP = ", ".join(f"'{w}'" for w in similarity.STOPWORDS)

#: DuckDB: each post's title as words and distinctive words, and the same of its rewritten title.
TOKENS = S + f""", tok as (select *, list_filter(string_split(norm, ' '), lambda w: strlen(w) >= 3) as words,
    trim(regexp_replace(lower(coalesce(ai_title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as ai_norm from titles),
feat as (select *, list_distinct(list_filter(words, lambda w: w not in ({STOP}))) as dis,
    list_distinct(list_filter(string_split(ai_norm, ' '), lambda w: strlen(w) >= 3 and w not in ({STOP}))) as ai_dis from tok)
"""
#: DuckDB: pairs of a new and a kept post, and how alike they are; every pair is compared.
PAIRS = TOKENS + """, pair as (select a.id as new_id, b.id as kept_id, coalesce(b.ai_title, b.raw_title) as kept_title, b.created_at, a.norm as an, b.norm as bn, b.ai_norm as bm,
        len(list_intersect(a.dis, b.dis)) as c, len(list_distinct(a.dis || b.dis)) as u, len(list_intersect(a.dis, b.ai_dis)) as c2, len(list_distinct(a.dis || b.ai_dis)) as u2,
        a.words as aw, b.words as bw, a.dis as ad, b.dis as bd from feat a, feat b where a.id <> b.id and a.norm <> '' and (len(list_intersect(a.dis, b.dis)) >= 2 or len(list_intersect(a.dis, b.ai_dis)) >= 2 or a.norm = b.norm or a.norm = b.ai_norm)),
clash as (select *, (list_contains(ad, 'summer') and list_contains(bd, 'winter')) or (list_contains(ad, 'winter') and list_contains(bd, 'summer')) as contra from pair),
cls as (select *, an = bn as equal, an = bn or (not contra and c >= 4 and c::double / greatest(u, 1) >= 0.55) as strong,
        an = bm as equal2, bm <> '' and (an = bm or (c2 >= 4 and c2::double / greatest(u2, 1) >= 0.55)) as strong2,
        len(list_filter(aw, lambda w: list_contains(bw, w))) as w, len(aw) as na, len(bw) as nb,
        case when strlen(an) <= strlen(bn) then strlen(an) >= 24 and contains(bn, an) else strlen(bn) >= 24 and contains(an, bn) end as inside from clash),
sim as (select *, strong or inside or (na > 0 and nb > 0 and ((w >= 2 and w::double / least(na, nb) >= 0.5) or w::double / (na + nb - w) >= 0.65)) as alike from cls),
verdict as (select *, case when equal then 98 when strong then least(88 + c, 98) when equal2 then 98 when strong2 then least(88 + c2, 98) end as confidence,
        case when strong then 3 when alike then 1 else 0 end as lexical from sim)
"""


@query(PAIRS + "select new_id, kept_id, kept_title, confidence from (select *, row_number() over (partition by new_id order by lexical desc, c desc, confidence desc, created_at desc, kept_id desc) as r from verdict where confidence is not null) where r = 1")
def match_lexical(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return dedup.match_lexical(own, own, FAMILY).select("new_id", "kept_id", "kept_title", "confidence")


@query(TOKENS + "select a.id as new_id, b.id as kept_id from feat a, feat b where a.id < b.id and a.norm <> b.norm and (len(list_intersect(a.dis, b.dis)) >= 3 or len(list_intersect(a.dis, b.ai_dis)) >= 3)")
def candidate_pairs(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    norms = own.select(F.col("id"), similarity.norm_title(F.col("raw_title")).alias("n"))
    found = dedup.candidate_pairs(own, own, 3).where("new_id < kept_id")
    found = found.join(norms.withColumnsRenamed({"id": "new_id", "n": "a"}), "new_id").join(norms.withColumnsRenamed({"id": "kept_id", "n": "b"}), "kept_id")
    return found.where("a <> b").select("new_id", "kept_id")


@query(TOKENS + """select a.id, a.dis as distinctive, len(list_intersect(a.dis, b.dis)) as common, case when len(a.dis) > 0 and len(b.dis) > 0 then len(list_intersect(a.dis, b.dis))::double / len(list_distinct(a.dis || b.dis)) else 0 end as jaccard,
    case when len(list_distinct(a.words)) > 0 and len(list_distinct(b.words)) > 0 then len(list_intersect(list_distinct(a.words), list_distinct(b.words)))::double / len(list_distinct(a.words || b.words)) else 0 end as word_jaccard
    from feat a join feat b on b.id = a.id + 1""".replace("a.dis as distinctive", "list_sort(a.dis) as distinctive"))
def title_similarity(spark, sf_dir):
    own = views.posts(spark, sf_dir).select("id", "raw_title")
    other = own.select((F.col("id") - 1).alias("id"), F.col("raw_title").alias("other"))
    a, b = F.col("raw_title"), F.col("other")
    return own.join(other, "id").select("id", F.array_sort(similarity.distinctive(a)).alias("distinctive"), similarity.distinctive_common(a, b).alias("common"), similarity.distinctive_jaccard(a, b).alias("jaccard"), similarity.title_jaccard(a, b).alias("word_jaccard"))


def _vector_pairs(spark, sf_dir):
    own = views.vectors(spark, sf_dir).select("id", "raw_title", "raw_description", "embedding")
    other = own.select((F.col("id") - 1).alias("id"), F.col("raw_title").alias("kept_title"), F.col("raw_description").alias("kept_desc"), F.col("embedding").alias("kept_embedding"))
    named = own.withColumnsRenamed({"raw_title": "new_title", "raw_description": "new_desc", "embedding": "new_embedding"})
    return named.join(other, "id").withColumn("new_title_embedding", F.col("new_embedding")).withColumn("kept_title_embedding", F.col("kept_embedding"))


LOW = dict(similarity.THRESHOLDS["e5_base"], full_strong=0.30, full_with_title=0.25, title=0.25, full_with_lexical=0.2, similar_full=0.15, similar_title=0.2)
V = PAIRS + """, v as (select s.*, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as f from verdict s join embeddings x on x.vec_id = new_id join embeddings y on y.vec_id = kept_id)
"""


@query(V + "select new_id, kept_id, f as full_sim, case when equal then 'equal' when strong then 'strong' else 'none' end as class, greatest(0, least(100, floor(f * 100)))::int as confidence from v where c >= 2 or c2 >= 2")
def dedup_report(spark, sf_dir):
    own = views.vectors(spark, sf_dir)
    return dedup.dedup_report(own, own, FAMILY, LOW).select("new_id", "kept_id", "full_sim", "class", "confidence")


def _alike(a: str, b: str, aw: str, bw: str) -> str:
    """DuckDB: whether two titles are similar, of their normal forms and word lists."""
    shared = f"len(list_filter({aw}, lambda w: list_contains({bw}, w)))"
    inside = f"case when strlen({a}) <= strlen({b}) then strlen({a}) >= 24 and contains({b}, {a}) else strlen({b}) >= 24 and contains({a}, {b}) end"
    some = f"(len({aw}) > 0 and len({bw}) > 0 and (({shared} >= 2 and {shared}::double / least(len({aw}), len({bw})) >= 0.5) or {shared}::double / (len({aw}) + len({bw}) - {shared}) >= 0.65))"
    return f"({a} <> '' and {b} <> '' and ({a} = {b} or {inside} or {some}))"


NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
WORDS = "list_filter(string_split({}, ' '), lambda w: strlen(w) >= 3)"
#: DuckDB: the beginnings of descriptions that are held against each other, and their words.
STARTS = f""", lead as (select id, substr({NORM.format('raw_description')}, 1, 220) as uncut from posts), start as (select id, strlen(uncut) >= 60 as enough, trim(uncut) as s, {WORDS.format('trim(uncut)')} as sw from lead)
"""


@query(TOKENS + STARTS + f""", p as (select a.id, a.dis as ad, b.dis as bd, a.norm as an, b.norm as bn, a.words as aw, b.words as bw, (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described,
        round(list_cosine_similarity(v.embedding::double[], w.embedding::double[]), 6) as f from feat a join feat b on b.id = a.id + 1 join start x on x.id = a.id join start y on y.id = b.id join embeddings v on v.vec_id = a.id join embeddings w on w.vec_id = b.id),
    q as (select *, len(list_intersect(ad, bd)) as c, an <> '' and an = bn as equal, not ((list_contains(ad, 'summer') and list_contains(bd, 'winter')) or (list_contains(ad, 'winter') and list_contains(bd, 'summer')))
        and len(list_intersect(ad, bd)) >= 4 and len(list_intersect(ad, bd))::double / greatest(len(list_distinct(ad || bd)), 1) >= 0.55 as close, {_alike('an', 'bn', 'aw', 'bw')} as alike from p)
    select id, f as full_sim, case when equal then 'equal' when close then 'strong' else 'none' end as class, equal or close or (c >= 2 and (f >= 0.25 or (alike and f >= 0.15) or (c >= 4 and f >= 0.2) or (f >= 0.2 and described))) as is_duplicate,
        greatest(0, least(100, floor(f * 100)))::int as confidence from q""")
def compare_pairs(spark, sf_dir):
    return dedup.compare_pairs(_vector_pairs(spark, sf_dir), FAMILY, LOW).select("id", F.round("full_sim", 6).alias("full_sim"), "class", "is_duplicate", "confidence")


@query(PAIRS + STARTS + f""", j as (select new_id, kept_id, c, case when len(ad) > 0 and len(bd) > 0 then c::double / u else 0 end as j, equal, contra, alike, ad, bd,
        (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described from verdict join start x on x.id = new_id join start y on y.id = kept_id where c >= 2 or c2 >= 2),
    k as (select *, c < 4 or len(list_filter(list_intersect(ad, bd), lambda w: w not in ({', '.join(repr(w) for w in similarity.FRANCHISE_WORDS)}))) > 0 as meaningful from j),
    s as (select *, equal or (not contra and c >= 4 and j >= 0.55) as strong_base, equal or (not contra and (c >= 5 or (c >= 4 and j >= 0.45))) as strong_large, equal or (not contra and (c >= 5 or (c >= 4 and j >= 0.5 and meaningful))) as strong_bge from k)
    select new_id, kept_id, alike as similar, strong_base, strong_large, strong_bge, not strong_large and not contra and alike and c >= 3 and j >= 0.35 as medium_large, not strong_bge and not contra and alike and c >= 3 and j >= 0.30 as medium_bge,
        meaningful, described, alike or described as content from s""")
def title_classes(spark, sf_dir):
    whole = views.posts(spark, sf_dir)
    own = whole.select("id", "raw_title", "raw_description")
    own = similarity.lead_columns(similarity.title_columns(own, "t", F.col("raw_title")), "d", F.col("raw_description")).drop("raw_title", "raw_description")
    a, b = (own.select(*[F.col(c).alias(f"{x}_{c}") for c in own.columns]) for x in ("new", "kept"))
    pairs = dedup.candidate_pairs(whole, whole, 2).join(a, "new_id").join(b, "kept_id")
    pairs = similarity.pair_columns(pairs, "p", similarity.Title.at("new_t"), similarity.Title.at("kept_t"))
    pairs = pairs.withColumn("described", similarity.leads_similar(similarity.Title.at("new_d"), similarity.Title.at("kept_d")))
    p = similarity.Pair.at("p")
    return pairs.select(
        "new_id", "kept_id", p.similar.alias("similar"), *[similarity.pair_strong(p, f).alias(n) for f, n in (("e5_base", "strong_base"), ("e5_large", "strong_large"), ("bge", "strong_bge"))],
        similarity.pair_medium(p, "e5_large").alias("medium_large"), similarity.pair_medium(p, "bge").alias("medium_bge"), p.meaningful.alias("meaningful"), "described", (p.similar | F.col("described")).alias("content"),
    )


@query(V + STARTS + f""", cand as (select v.*, (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described from v join start x on x.id = new_id join start y on y.id = kept_id
        where kept_id in (select id from posts join embeddings on vec_id = id order by created_at desc, id desc limit 200)),
    dup as (select *, greatest(0, least(100, floor(f * 100)))::int as conf, strong or (c >= 2 and (f >= 0.25 or (alike and f >= 0.15) or (c >= 4 and f >= 0.2) or (f >= 0.2 and described))) as dup from cand)
    select new_id, kept_id, conf as confidence from (select *, row_number() over (partition by new_id order by lexical desc, c desc, conf desc, created_at desc, kept_id desc) as r from dup where dup) where r = 1""")
def match_semantic(spark, sf_dir):
    own = views.vectors(spark, sf_dir)
    return dedup.match_semantic(own, own, FAMILY, LOW).select("new_id", "kept_id", "confidence")


def _decided(family: str) -> str:
    """DuckDB: the decision of a family with a rule for weak titles, of posts and the next ones; thresholds as in LOW_OF."""
    t = LOW_OF[family]
    strong = {"e5_large": "(c >= 5 or (c >= 4 and j >= 0.45))", "bge": "(c >= 5 or (c >= 4 and j >= 0.5 and meaningful))"}[family]
    franchise = ", ".join(repr(w) for w in similarity.FRANCHISE_WORDS)
    return TOKENS + STARTS + f""", p as (select a.id, a.dis as ad, b.dis as bd, a.norm as an, b.norm as bn, a.words as aw, b.words as bw, (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described,
        round(list_cosine_similarity(v.embedding::double[], w.embedding::double[]), 6) as f from feat a join feat b on b.id = a.id + 1 join start x on x.id = a.id join start y on y.id = b.id join embeddings v on v.vec_id = a.id join embeddings w on w.vec_id = b.id),
    q as (select *, len(list_intersect(ad, bd)) as c, case when len(ad) > 0 and len(bd) > 0 then len(list_intersect(ad, bd))::double / len(list_distinct(ad || bd)) else 0 end as j, an <> '' and an = bn as equal, {_alike('an', 'bn', 'aw', 'bw')} as alike,
        (list_contains(ad, 'summer') and list_contains(bd, 'winter')) or (list_contains(ad, 'winter') and list_contains(bd, 'summer')) as contra from p),
    r as (select *, c < 4 or len(list_filter(list_intersect(ad, bd), lambda w: w not in ({franchise}))) > 0 as meaningful from q),
    s as (select *, equal or (not contra and {strong}) as strong from r), u as (select *, not strong and not contra and alike and c >= 3 and j >= {similarity.MEDIUM_JACCARD[family]} as medium from s),
    z as (select *, c < 5 and j < 0.35 and not (c >= {t['common_high']} and f >= 0.82 and f >= 0.68 and meaningful) as weak from u)
    select id, case when equal then 'equal' when strong then 'strong' when medium then 'medium' else 'none' end as class, strong or medium or (c >= {t['common']} and not weak and (f >= {t['full_strong']}
        or (f >= {t['full_with_title']} and f >= {t['title']} and c >= {t['common_title']}) or (alike and c >= {t['common_similar']} and (f >= {t['similar_full']} or f >= {t['similar_title']}))
        or (c >= {t['common_high']} and f >= {t['full_with_lexical']} and f >= {round(t['title'] - 0.06, 6)}) or (f >= {t['full_with_lexical']} and f >= {t['title']}) or (f >= {t['full_with_lexical']} and described))) as is_duplicate from z"""


LOW_OF = {f: dict(similarity.THRESHOLDS[f], full_strong=0.30, full_with_title=0.25, title=0.25, full_with_lexical=0.2, similar_full=0.15, similar_title=0.2, common=1, common_title=1, common_similar=1, common_high=3) for f in ("e5_large", "bge")}


@query(_decided("e5_large"))
def compare_pairs_e5_large(spark, sf_dir):
    return dedup.compare_pairs(_vector_pairs(spark, sf_dir), "e5_large", LOW_OF["e5_large"]).select("id", "class", "is_duplicate")


@query(_decided("bge"))
def compare_pairs_bge(spark, sf_dir):
    return dedup.compare_pairs(_vector_pairs(spark, sf_dir), "bge", LOW_OF["bge"]).select("id", "class", "is_duplicate")


@query(S + """select id, case id % 5 when 0 then 'e5_large' when 1 then 'e5_base' when 2 then 'bge' when 3 then 'e5_base' else 'other' end as family from posts""")
def encoder_families(spark, sf_dir):
    names = ["org/multilingual-e5-large-instruct", "org/e5-base", "org/bge-m3", "E5/e5", "org/encoder"]
    model = F.concat(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % 5 + 1).cast("int")), F.lit("/"), F.col("source"))
    return views.posts(spark, sf_dir).select("id", similarity.encoder_family(model).alias("family"))


#: DuckDB: pairs of posts with vectors, all compared, and whether the decision of the low thresholds calls them duplicates.
DUP = V + STARTS + f""", cand as (select v.*, (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described from v join start x on x.id = new_id join start y on y.id = kept_id),
    dup as (select *, greatest(0, least(100, floor(f * 100)))::int as conf, strong or (c >= 2 and (f >= 0.25 or (alike and f >= 0.15) or (c >= 4 and f >= 0.2) or (f >= 0.2 and described))) as dup from cand)
"""


@query(DUP + "select new_id, kept_id, conf as confidence from (select *, row_number() over (partition by new_id order by lexical desc, c desc, conf desc, created_at desc, kept_id desc) as r from dup where dup) where r = 1")
def match_semantic_all(spark, sf_dir):
    """Against all of history, not only its newest posts."""
    own = views.vectors(spark, sf_dir)
    return dedup.match_semantic(own, own, FAMILY, LOW, limit=None).select("new_id", "kept_id", "confidence")


#: DuckDB: rewritten titles with the vector of the next post, which stands for the rewritten text's own.
VARIANTS = PAIRS + STARTS + f""", ai as (select a.vec_id as id, b.embedding from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
    v0 as (select s.*, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 12) as f1, coalesce(round(list_cosine_similarity(x.embedding::double[], z.embedding::double[]), 12), 0) as f2, {WORDS.format('bm')} as mw
        from sim s join embeddings x on x.vec_id = new_id join embeddings y on y.vec_id = kept_id left join ai z on z.id = kept_id),
    v1 as (select *, bm <> '' and f2 > f1 as other, {_alike('an', 'bm', 'aw', 'mw')} as alike2 from v0),
    v2 as (select v1.*, round(case when other then f2 else f1 end, 6) as f, case when other then c2 else c end as k, case when other then strong2 else strong end as s, case when other then alike2 else alike end as like1,
        not other and (x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')}) as described, case when strong then 3 when alike then 1 else 0 end as lexical from v1 join start x on x.id = new_id join start y on y.id = kept_id),
    v3 as (select *, greatest(0, least(100, floor(f * 100)))::int as conf from v2 where s or (k >= 2 and (f >= 0.25 or (like1 and f >= 0.15) or (k >= 4 and f >= 0.2) or (f >= 0.2 and described))))
"""


@query(VARIANTS + "select new_id, kept_id, other as by_rewrite, conf as confidence from (select *, row_number() over (partition by new_id order by lexical desc, c desc, conf desc, created_at desc, kept_id desc) as r from v3) where r = 1")
def match_semantic_variants(spark, sf_dir):
    """Kept posts whose rewritten texts have vectors of their own: the nearer of the two variants is decided on."""
    own = views.vectors(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("ai_embedding"))
    own = own.join(vectors, "id", "left").withColumn("ai_title_embedding", F.col("ai_embedding"))
    best = dedup.match_semantic(own, own, FAMILY, LOW, limit=None).select("new_id", "kept_id", "confidence")
    pairs = dedup.semantic_scores(dedup._attach(best.select("new_id", "kept_id"), own, own, True, True)).select("new_id", "by_rewrite")
    return best.join(pairs, "new_id").select("new_id", "kept_id", "by_rewrite", "confidence")


def _score(norm: str, words: str, dis: str) -> str:
    """DuckDB: the heuristic score of a new post a against a kept title."""
    alike = _alike("a.norm", norm, "a.words", words)
    common = f"len(list_intersect(a.dis, {dis}))"
    clash = f"((list_contains(a.dis, 'summer') and list_contains({dis}, 'winter')) or (list_contains(a.dis, 'winter') and list_contains({dis}, 'summer')))"
    strong = f"(not {clash} and {common} >= 4 and {common}::double / greatest(len(list_distinct(a.dis || {dis})), 1) >= 0.55)"
    described = f"(x.enough and y.enough and {_alike('x.s', 'y.s', 'x.sw', 'y.sw')})"
    return f"(case when a.norm <> '' and a.norm = {norm} then 100 when {strong} then 90 when {alike} then 60 else 0 end + 3 * {common} + case when {described} then 40 when {alike} then 20 else 0 end)"


@query(TOKENS + STARTS + f""", near as (select *, {WORDS.format('ai_norm')} as ai_words from feat order by created_at desc, id desc limit 200),
    s as (select a.id as new_id, b.id as kept_id, b.created_at, greatest({_score('b.norm', 'b.words', 'b.dis')}, case when trim(coalesce(b.ai_title, '')) <> '' then {_score('b.ai_norm', 'b.ai_words', 'b.ai_dis')} end)::int as score
        from feat a join start x on x.id = a.id join near b on b.id <> a.id join start y on y.id = b.id where a.status = 'new'),
    p as (select *, row_number() over (partition by new_id order by score desc, created_at desc, kept_id desc)::int as place from s) select new_id, kept_id, score, place from p where score > 0 or place <= 50""")
def shortlist(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return dedup.shortlist(own.where("status = 'new'"), own, FAMILY, 50)


#: DuckDB: which posts match, every pair compared, and links that connect them: members to the head of their class (equal
#: raw and rewritten titles), heads to the first post of their raw title, and heads of different titles that match.
EDGES = PAIRS + """, class as (select id, norm, min(id) over (partition by norm, ai_norm) as head, min(id) over (partition by norm) as first from tok where norm <> '' union all select id, norm, id, id from tok where norm = ''),
m as (select least(new_id, kept_id) as a, greatest(new_id, kept_id) as b from verdict where confidence is not null group by all),
e as (select m.a, m.b from m join class x on x.id = m.a join class y on y.id = m.b where x.head = x.id and y.head = y.id and (x.norm <> y.norm or x.norm = '')
    union select head, id from class where id <> head union select first, id from class where id = head and id <> first)
"""


@query(EDGES + "select distinct a, b from e")
def match_edges(spark, sf_dir):
    return dedup.match_edges(views.posts(spark, sf_dir), FAMILY)


@query(EDGES + ", pairs2 as (select a, b from m union select b, a from m), swept as (select id from posts where status in ('new', 'processing') and id % 2 = 0), gone as (select distinct a from pairs2 where a in (select id from swept) and (b not in (select id from swept) or b > a)) select id from posts where id not in (select a from gone)")
def sweep(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return dedup.sweep(own, own.where("id % 2 = 0").select("id"), FAMILY).select("id")


def _first_come(posts: str, pairs: str, p: str = "") -> str:
    """DuckDB: posts one after the other in order of (created_at, id), each kept unless a kept one is its neighbour.

    posts and pairs (a, b) name tables; the result is the table {p}done (id, near: ids of neighbours, kept: ids kept).
    """
    return f""", {p}sides as (select a, b from {pairs} union select b, a from {pairs}), {p}adj as (select a as id, list(b) as near from {p}sides group by a),
{p}line as (select id, coalesce(near, []) as near, row_number() over (order by created_at, id) as i from {posts} left join {p}adj using (id)),
{p}walk(i, kept) as (select 0::bigint, []::bigint[] union all select w.i + 1, case when list_has_any(l.near, w.kept) then w.kept else list_append(w.kept, l.id) end from {p}walk w join {p}line l on l.i = w.i + 1),
{p}done as (select id, near, kept from {p}line, (select kept from {p}walk order by i desc limit 1))
"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(_recursive(PAIRS + """, exact as (select t.id, max_by(o.id, (o.created_at, o.id)) as kept_id from titles t join titles o on o.norm = t.norm and o.id % 2 = 0 where t.id % 2 = 1 and t.norm <> '' group by t.id),
    near as (select new_id as id, kept_id from (select *, row_number() over (partition by new_id order by lexical desc, c desc, confidence desc, created_at desc, kept_id desc) as r from verdict
        where confidence is not null and new_id % 2 = 1 and kept_id % 2 = 0 and new_id not in (select id from exact)) where r = 1),
    rest as (select * from posts where id % 2 = 1 and id not in (select id from exact) and id not in (select id from near)),
    inside as (select new_id as a, kept_id as b from verdict where confidence is not null and new_id in (select id from rest) and kept_id in (select id from rest))""" + _first_come("rest", "inside")
    + """ select id, kept_id, 'exact' as reason from exact union all select id, kept_id, 'lexical' from near
    union all select id, case when not list_contains(kept, id) then list_min(list_filter(near, lambda x: list_contains(kept, x))) end, case when not list_contains(kept, id) then 'batch' end from done"""))
def dedup_batch(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    kept, matches = dedup.dedup_batch(own.where("id % 2 = 1"), own.where("id % 2 = 0"), FAMILY, days=0)
    return kept.select("id", F.lit(None).cast("long").alias("kept_id"), F.lit(None).cast("string").alias("reason")).unionByName(matches.select(F.col("new_id").alias("id"), "kept_id", "reason"))


@query(_recursive(DUP + """, own as (select posts.* from posts join embeddings on vec_id = id), exact as (select t.id, max_by(o.id, (o.created_at, o.id)) as kept_id from titles t join titles o on o.norm = t.norm and o.id % 2 = 0 join embeddings on vec_id = o.id where t.id % 2 = 1 and t.norm <> '' group by t.id),
    near as (select new_id as id, kept_id from (select *, row_number() over (partition by new_id order by lexical desc, c desc, confidence desc, created_at desc, kept_id desc) as r from v
        where confidence is not null and new_id % 2 = 1 and kept_id % 2 = 0 and new_id not in (select id from exact)) where r = 1),
    alike as (select new_id as id, kept_id from (select *, row_number() over (partition by new_id order by lexical desc, c desc, conf desc, created_at desc, kept_id desc) as r from dup
        where dup and new_id % 2 = 1 and kept_id % 2 = 0 and new_id not in (select id from exact) and new_id not in (select id from near)) where r = 1),
    rest as (select * from own where id % 2 = 1 and id not in (select id from exact) and id not in (select id from near) and id not in (select id from alike)),
    inside as (select new_id as a, kept_id as b from dup where dup and new_id in (select id from rest) and kept_id in (select id from rest))""" + _first_come("rest", "inside")
    + """ select id, kept_id, 'exact' as reason from exact where id in (select id from own) union all select id, kept_id, 'lexical' from near union all select id, kept_id, 'semantic' from alike
    union all select id, case when not list_contains(kept, id) then list_min(list_filter(near, lambda x: list_contains(kept, x))) end, case when not list_contains(kept, id) then 'batch' end from done"""))
def dedup_batch_semantic(spark, sf_dir):
    """All three stages against all of history, and first come within the batch by the semantic decision."""
    own = views.vectors(spark, sf_dir)
    kept, matches = dedup.dedup_batch(own.where("id % 2 = 1"), own.where("id % 2 = 0"), FAMILY, days=0, semantic=True, thresholds=LOW)
    return kept.select("id", F.lit(None).cast("long").alias("kept_id"), F.lit(None).cast("string").alias("reason")).unionByName(matches.select(F.col("new_id").alias("id"), "kept_id", "reason"))


@query(_recursive(DUP + ", own as (select posts.* from posts join embeddings on vec_id = id), twins as (select new_id as a, kept_id as b from dup where dup)" + _first_come("own", "twins")
    + " select id, case when list_contains(kept, id) then id else list_min(list_filter(near, lambda x: list_contains(kept, x))) end as survivor, list_contains(kept, id) as kept from done"))
def dedup_corpus_semantic(spark, sf_dir):
    return dedup.dedup_corpus(views.vectors(spark, sf_dir), "greedy", FAMILY, True, LOW)


@query(DUP + """, twins as (select new_id as a, kept_id as b from dup where dup union select kept_id, new_id from dup where dup), swept as (select id from posts join embeddings on vec_id = id where status in ('new', 'processing') and id % 2 = 0),
    gone as (select distinct a from twins where a in (select id from swept) and (b not in (select id from swept) or b > a)) select vec_id as id from embeddings join posts on id = vec_id where vec_id not in (select a from gone)""")
def sweep_semantic(spark, sf_dir):
    own = views.vectors(spark, sf_dir)
    return dedup.sweep(own, own.where("id % 2 = 0").select("id"), FAMILY, True, LOW).select("id")


@query(_recursive(EDGES + _first_come("posts", "m") + " select id, case when list_contains(kept, id) then id else list_min(list_filter(near, lambda x: list_contains(kept, x))) end as survivor, list_contains(kept, id) as kept from done"))
def dedup_corpus(spark, sf_dir):
    return dedup.dedup_corpus(views.posts(spark, sf_dir), "greedy", FAMILY)


@query(EDGES + ", up as (select a as id, max(b) as k from (select a, b from m union select b, a from m) where b > a group by a) select id, id not in (select id from up) as kept from posts")
def dedup_corpus_sweep(spark, sf_dir):
    return dedup.dedup_corpus(views.posts(spark, sf_dir), "sweep", FAMILY).select("id", "kept")


#: DuckDB: posts with another post of equal title.
EXACT_OF = ", exact as (select distinct t.id from titles t join titles o on o.norm = t.norm and o.id <> t.id where t.norm <> '')"


def _hint(title: str) -> str:
    """DuckDB: whether title and address are those of puzzle answers, for the puzzle 'thing' and the phrase 'idiot'."""
    both, name = f"lower({title} || ' ' || q.source_url)", f"lower({title})"
    word = lambda w: f"regexp_matches({both}, '\\b{w}s?\\b')"
    today = " or ".join(f"contains({both}, '{t}')" for t in ("today''s ", "todays-", "today-"))
    puzzle = f"(contains({both}, 'thing') and not contains({both}, 'hints at') and not contains({both}, 'hint at') and ({word('hint')} or {word('answer')} or {word('solution')} or {today}))"
    return f"(contains({both}, 'idiot') or ({word('hint')} and {word('answer')}) or (contains({name}, 'подсказ') and contains({name}, 'ответ')) or {puzzle})"


@query(PAIRS + EXACT_OF + f""", near as (select distinct new_id as id from verdict v join posts p on p.id = v.kept_id where v.confidence is not null and p.status = 'published')
    select q.id, case when {_hint('q.raw_title')} or {_hint("coalesce(q.ai_title, '')")} then 'hint' when e.id is not null then 'exact' when n.id is not null then 'lexical' end as block_reason
    from posts q left join exact e on e.id = q.id left join near n on n.id = q.id where q.status in ('ai_processed', 'approved')""")
def publish_gate(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return dedup.publish_gate(own.where(F.col("status").isin("ai_processed", "approved")), own, FAMILY, puzzles=["thing"], phrases=["idiot"]).select("id", "block_reason")


@query(S + "select id, (norm <> '' and (norm = 'that it' or contains(norm, 'worthless') or starts_with(norm, 'the and'))) as roundup from titles")
def link_roundups(spark, sf_dir):
    return views.posts(spark, sf_dir).select("id", predicates.is_link_roundup(F.col("raw_title"), ["that it"], ["worthless"], ["the and"]).alias("roundup"))


@query(S + """, n as (select id, trim(raw_description, ' \n\t\r') as d, raw_title, source_url from posts), w as (select *, list_filter(string_split_regex(d, '\\s+'), lambda x: x <> '') as w, lower(raw_title || ' ' || source_url) as txt from n),
    g as (select *, contains(txt, 'src13') as cat, contains(txt, 'worthless') as hint, d = '' or contains(lower(d), 'idiot') or (len(w) >= 35 and len(regexp_extract_all(d, '[.!?]')) <= 3 and len(list_filter(w, lambda x: length(x) <= 18 and regexp_matches(x, '^\\p{Lu}'))) * 100 >= len(w) * 35) as nav from w)
    select id, case when cat then 'category' when hint then 'hint' when nav then 'navigation' end as reject_reason from g""")
def content_gate(spark, sf_dir):
    own = views.posts(spark, sf_dir).select("id", F.col("raw_title").alias("title"), F.col("source_url").alias("link"), F.col("raw_description").alias("description"), F.array("source").alias("categories"))
    return predicates.content_gate(own, labels=["SRC13"], phrases=["worthless"], puzzles=[], markers=["idiot"]).select("id", "reject_reason")


@query(S + f"select q.id from posts q where q.status <> 'published' and ({_hint('q.raw_title')} or {_hint("coalesce(q.ai_title, '')")})")
def hint_posts(spark, sf_dir):
    return listing.hint_posts(views.posts(spark, sf_dir), phrases=["idiot"], puzzles=["thing"]).select("id")


#: What is appended to pages, by page_id, and what of the text before it goes too: null if nothing is boilerplate.
APPENDED = ((" <p>The post A story first appeared on Some Site.</p>", ""), ("<p>Read more.</p>", "[\\s.]+$"), (" Continue reading at the site", ""), (" <b>Source</b>", "[\\s.]+$"), (" Подробнее в статье.", ""), (" Not a source of bread more or less", None), ("", ""))
TEXT_OF = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"
CASES = " ".join(f"when {i} then " + (TEXT_OF.format(f"html || '{a}'") if gone is None else f"regexp_replace({TEXT_OF.format('html')}, '{gone}', '')" if gone else TEXT_OF.format("html")) for i, (a, gone) in enumerate(APPENDED))


@query(f"select page_id, case page_id % {len(APPENDED)} {CASES} end as text from pages")
def clean_html(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(a) for a, _ in APPENDED]), (F.col("page_id") % len(APPENDED) + 1).cast("int"))
    return views.pages(spark, sf_dir).select("page_id", T.clean_html(F.concat("html", tail)).alias("text"))


@query("""select page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as title from pages""")
def page_titles(spark, sf_dir):
    return views.pages(spark, sf_dir).select("page_id", F.coalesce(pages.page_title(F.col("html")), F.lit("")).alias("title"))


PARAGRAPH = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


@query(f"""with a as (select page_id, regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1) as chunk from pages)
    select page_id, list_filter(list_transform(regexp_extract_all(chunk, '(?is)<(?:p|h2|h3)[^>]*>(.*?)</(?:p|h2|h3)>', 1), lambda x: {PARAGRAPH}), lambda x: strlen(x) >= 20)[:80] as parts from a where chunk <> ''""")
def article_paragraphs(spark, sf_dir):
    chunk = F.regexp_extract("html", r"(?is)<article[^>]*>(.*)</article>", 1)
    return views.pages(spark, sf_dir).withColumn("chunk", chunk).where("chunk <> ''").select("page_id", pages.paragraphs(F.col("chunk")).alias("parts"))


def _cuts(x: str) -> str:
    """DuckDB: the sentences of a text."""
    return f"list_filter(string_split(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '([.!?…]) ', '\\1' || chr(1), 'g'), chr(1)), lambda q: q <> '')"


def _cta(x: str) -> str:
    """DuckDB: whether a text calls to action."""
    own = f"lower(trim(regexp_replace(trim({x}), '^\\*+|\\*+$', '', 'g')))"
    quoted = lambda m: m.replace("'", "''")
    return "(" + " or ".join([f"contains({own}, '{quoted(m)}')" for m in T.CTA_MARKERS] + [f"regexp_matches({own}, '{p}')" for p in T.CTA_PATTERNS]) + ")"


URL = "regexp_matches({}, '(?i)(https?://\\S+|www\\.\\S+)')"


def _unlinked(x: str) -> str:
    """DuckDB: a text without sentences that have a link or call to action."""
    return f"array_to_string(list_filter({_cuts(x)}, lambda z: not ({URL.format('z')} or {_cta('z')})), ' ')"


#: Sentences that are put between those of descriptions, by id, so that there is something to strip.
ADDED = ("See https://x.example/a for it.", "Read more about it!", "Stay tuned.", "Go to www.y.example now.", "Keep an eye on the long release calendar here.", "Nothing of the kind.", "Line one.\n\nRead the full story here.\n\nLine two?")
ADDED_SQL = "case id % 7 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ADDED)) + " end"


@query(S + f""", b as (select id, ai_title, raw_description || ' ' || {ADDED_SQL} || ' The end.' as body from posts), p as (select *, trim(body, ' \n\t\r') as own from b),
    k as (select id, ai_title, list_filter(list_transform(case when contains(own, '\n\n') then string_split(own, '\n\n') else string_split(own, '\n') end, lambda x: {_unlinked('x')}), lambda x: x <> '') as kept from p),
    o as (select *, {_cuts('kept[1]')} as one from k)
    select id, case when ai_title is not null then {_unlinked('ai_title')} end as ai_title, case when len(kept) = 0 then '' when len(kept) > 1 then array_to_string(kept, '\n\n') when len(one) <= 2 then array_to_string(one, ' ')
        else array_to_string(list_transform(range(0, len(one), 2), lambda i: array_to_string(one[i + 1 : i + 2], ' ')), '\n\n') end as ai_text from o""")
def post_text(spark, sf_dir):
    added = F.element_at(F.array(*[F.lit(a) for a in ADDED]), (F.col("id") % 7 + 1).cast("int"))
    own = views.posts(spark, sf_dir).withColumn("ai_text", F.concat("raw_description", F.lit(" "), added, F.lit(" The end.")))
    return listing.sanitize_posts(own).select("id", "ai_title", "ai_text")


#: DuckDB: the text of each page's article: paragraphs after the heading, else those of the article element.
ARTICLES = f"""with raw as (select page_id, url, html, regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1) as title, regexp_extract(html, '(?is)<h1[^>]*>', 0) as tag, regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1) as article from pages),
cut as (select *, case when tag <> '' then left(substr(html, strpos(html, tag) + length(tag)), 180000) end as region, case when article <> '' then article else html end as chunk from raw),
par as (select *, {{}} as after, {{}} as parts from cut),
txt as (select *, case when len(after) >= 2 then array_to_string(after, '\n\n') else '' end as t1, case when len(parts) > 0 then array_to_string(parts, '\n\n') else {TEXT_OF.format('chunk')} end as t2 from par),
art as (select page_id, url, nullif({TEXT_OF.format('title')}, '') as page_title, case when strlen(t2) >= strlen(t1) then t2 else t1 end as best from txt),
articles as (select page_id, url, page_title, case when length(best) > 20000 then left(best, 20000) || '…' else best end as article_text from art)
""".format(*[f"list_filter(list_transform(regexp_extract_all({c}, '(?is)<(?:p|h2|h3)[^>]*>(.*?)</(?:p|h2|h3)>', 1), lambda x: {TEXT_OF.format('x')}), lambda x: strlen(x) >= 20)[:80]" for c in ("region", "chunk")])
CONTEXT = "Полный текст статьи с сайта:"


@query(ARTICLES + f"select page_id, page_title, article_text, case when article_text = '' then '' when length(article_text) + {len(CONTEXT) + 1} > 3000 then left('{CONTEXT}\n' || article_text, 3000) || '…' else '{CONTEXT}\n' || article_text end as web_context from articles")
def extract_articles(spark, sf_dir):
    out = pages.extract_articles(views.pages(spark, sf_dir), markers=[])
    return pages.web_context(out).select("page_id", "page_title", "article_text", "web_context")


@query(ARTICLES + f""", one as (select {NORM_URL.format('url')} as k, max(article_text) as text from articles group by k)
    select p.page_id, case when p.page_id % 2 = 1 then p.html when one.text = '' then 'short' else one.text end as description from pages p join one on one.k = {NORM_URL.format('p.url')}""")
def enrich_items(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    items = own.select("page_id", F.col("url").alias("link"), F.when(F.col("page_id") % 2 == 0, F.lit("short")).otherwise(F.col("html")).alias("description"))
    return pages.enrich(items, pages.extract_articles(own, markers=[]).select("url", "article_text"), markers=[]).select("page_id", "description")


#: Meta tags and data that are put before pages, by page_id.
LONG = "A description that has more than forty bytes, of page "


@query(f"""select page_id, case page_id % 4 when 0 then '{LONG}' || page_id when 1 then 'by name: {LONG}' || page_id end as description, case when page_id % 3 <> 2 then 'https://i.example/' || page_id || '.jpg' end as image,
    case page_id % 5 when 0 then 'Body of ' || page_id when 1 then 'Deep body of ' || page_id when 2 then rpad('About ' || page_id || ' ', 130, 'x') end as body from pages""")
def page_meta(spark, sf_dir):
    n = F.col("page_id").cast("string")
    kind = lambda k, *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (F.col("page_id") % k + 1).cast("int"))
    about = kind(
        4, F.concat(F.lit(f'<meta property="og:description" content="{LONG}'), n, F.lit('">')), F.concat(F.lit("<meta property='og:description' content='too short'><meta content='by name: " + LONG), n, F.lit("' name='description'>")),
        "<meta name='description' content='too short'>", "",
    )
    image = kind(3, F.concat(F.lit('<meta property="og:image" content="https://i.example/'), n, F.lit('.jpg">')), F.concat(F.lit('<meta content="https://i.example/'), n, F.lit('.jpg" property="og:image">')), "")
    data = lambda *j: F.concat(F.lit('<script type="application/ld+json">'), *[x if not isinstance(x, str) else F.lit(x) for x in j], F.lit("</script>"))
    body = kind(
        5, data('{"@type": "NewsArticle", "articleBody": "Body of ', n, '"}'), data('[{"@graph": [[{"@type": ["Thing", "BlogPosting"], "articleBody": " Deep body of ', n, ' "}]]}]'),
        data('{"@type": "article", "description": "', F.rpad(F.concat(F.lit("About "), n, F.lit(" ")), 130, "x"), '"}'), data('{"@type": "Thing", "articleBody": "none"}'), data("{broken"),
    )
    html = F.concat(about, image, body, F.col("html"))
    return views.pages(spark, sf_dir).select("page_id", pages.meta_description(html).alias("description"), pages.og_image(html).alias("image"), pages.jsonld_body(html).alias("body"))


@query(S + """, n as (select id, replace(trim(raw_title), '*', '') as name, raw_description as body from posts), h as (select id, name || case when trim(body, ' \n\t\r') = '' then '' when name = '' then body else '\n\n' || body end as head from n),
    m as (select id, head || case when head = '' then '\n' else '\n\n' end || '#news' as plain from h)
    select id, case when length(plain) > 4096 then left(plain, 4093) || '...' else plain end as plain from m""")
def messages(spark, sf_dir):
    return views.posts(spark, sf_dir).select("id", T.message_plain(F.col("raw_title"), F.col("raw_description"), F.lit("#news")).alias("plain"))


ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(S + f""", e as (select id, '<b>' || {ESCAPED.format('raw_title')} || '</b>' as header, {ESCAPED.format('raw_description')} as own from posts),
    r as (select *, greatest(0, 1024 - length(header) - 4 - case when own = '' then 0 else 2 end) as room from e),
    c as (select *, case when length(own) > room then left(own, greatest(room - 1, 0)) || '…' else own end as body from r)
    select id, header, header || case when body = '' then '' else '\n\n' || body end || '\n\n#a' as caption from c""")
def message_headers(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    caption = T.message_html(F.col("raw_title"), F.col("raw_description"), F.lit("#a"))
    return own.select("id", F.regexp_extract(caption, r"(?s)^<b>.*?</b>", 0).alias("header"), caption.alias("caption"))


@query(S + "select p.id, 'T:' || p.raw_title || '|D:' || p.raw_description || '|C:' || coalesce(c.name, '') || '|L:английский|' as prompt from posts p left join categories c on c.id = p.category_id")
def prompts(spark, sf_dir):
    own = listing.with_category(views.posts(spark, sf_dir), views.categories(spark))
    return T.build_prompts(own, "T:{title}|D:{description}|C:{category}|L:{language}|{web_context}").select("id", "prompt")


#: DuckDB: assistant turns as replies of four kinds, and what parsing them gives.
REPLY = "with a as (select conv_id, turn, text, conv_id % 4 as k from conversations where role = 'assistant')"


def _replies(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    strict = F.to_json(F.struct(F.lit("t").alias("title"), F.col("text").alias("text"), F.array(F.lit("a"), F.lit("#b")).alias("hashtags")))
    partial = F.to_json(F.struct(F.col("text").alias("text"), F.lit("x y").alias("hashtags")))
    broken = F.concat(F.lit('{"title": "t", "text": "'), F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit('", "hashtags": ["a"]'))
    kind = F.col("conv_id") % 4
    reply = F.when(kind == 0, strict).when(kind == 1, F.concat(F.lit("```json\n"), strict, F.lit("\n```"))).when(kind == 2, partial).otherwise(broken)
    return turns.select("conv_id", "turn", "text", reply.alias("reply"))


@query(REPLY + " select conv_id, turn, case when k in (0, 1) then 'strict' when k = 2 then 'partial' else 'loose' end as parse_path, trim(case when k <> 3 then text else replace(replace(replace(regexp_extract(replace(text, '\n', '\\n'), '^((?:\\\\.|[^\"\\\\])*)', 1), '\\n', '\n'), '\\\"', '\"'), '\\\\', '\\') end, ' \n\t') as text, case when k in (0, 1) then 'a,#b' when k = 2 then 'x,y' else 'a' end as tags, case when k <> 2 then 't' end as title from a")
def parse_replies(spark, sf_dir):
    out = T.parse_replies(_replies(spark, sf_dir).drop("text"))
    return out.select("conv_id", "turn", "parse_path", "text", F.array_join("hashtags", ",").alias("tags"), F.when(F.col("conv_id") % 4 != 2, F.col("title")).alias("title"))


@query("select conv_id, turn, turn % 2 = 0 as is_duplicate, (turn * 7)::int as confidence, text as explanation from conversations where conv_id % 3 <> 0 union all select conv_id, turn, null, null, null from conversations where conv_id % 3 = 0")
def parse_verdicts(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    json = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("is_duplicate"), (F.col("turn") * 7).alias("confidence"), F.col("text").alias("explanation")))
    reply = F.when(F.col("conv_id") % 3 == 0, F.lit("no json")).otherwise(F.concat(F.lit("```"), json, F.lit("```")))
    return T.parse_verdicts(own.withColumn("reply", reply)).select("conv_id", "turn", "is_duplicate", "confidence", "explanation")


@query(REPLY + """, b as (select conv_id as id, k, trim(case when k <> 3 then text else replace(replace(replace(regexp_extract(replace(text, '\n', '\\n'), '^((?:\\\\.|[^\"\\\\])*)', 1), '\\n', '\n'), '\\\"', '\"'), '\\\\', '\\') end, ' \n\t') as text from a),
    c as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from b), t as (select *, regexp_extract(flat, '^[^.!?]*[.!?]?') as first from c),
    r as (select id, k, text, case when k <> 2 then 't' else case when trim(first) = '' then flat else trim(first) end end as title, case when k in (0, 1) then '#a #b' when k = 2 then '#x #y' else '#a' end as tags,
        case when k in (0, 1) then 'strict' when k = 2 then 'partial' else 'loose' end as path from t),
    w as (select id, path, tags, text, case when length(title) > 80 then left(title, 79) || '…' else title end as title from r), best as (select id, max((path, title, text, tags)) as m from w group by id), """ + S[5:] + f""",
    k as (select id, tags, title, list_filter(list_transform(case when contains(own, '\n\n') then string_split(own, '\n\n') else string_split(own, '\n') end, lambda x: {_unlinked('x')}), lambda x: x <> '') as kept
        from (select id, m[4] as tags, m[2] as title, m[3] as own from (select id, [m[1], m[2], m[3], m[4]] as m from best))),
    o as (select *, {_cuts('kept[1]')} as one from k)
    select p.id, case when o.id is not null then 'approved' when p.status = 'new' then 'processing' else p.status end as status, case when o.id is not null then {_unlinked('o.title')} else p.ai_title end as ai_title, o.tags as ai_hashtags,
        case when o.id is null then null when len(kept) = 0 then '' when len(kept) > 1 then array_to_string(kept, '\n\n') when len(one) <= 2 then array_to_string(one, ' ')
        else array_to_string(list_transform(range(0, len(one), 2), lambda i: array_to_string(one[i + 1 : i + 2], ' ')), '\n\n') end as ai_text from posts p left join o on o.id = p.id and p.status in ('new', 'processing')""")
def apply_rewrites(spark, sf_dir):
    """New posts are claimed; replies to any others change nothing."""
    replies = T.parse_replies(_replies(spark, sf_dir).drop("text")).withColumnRenamed("conv_id", "id")
    claimed = views.posts(spark, sf_dir).withColumn("status", F.when(F.col("status") == "new", "processing").otherwise(F.col("status")))
    return lifecycle.apply_rewrites(claimed, replies, True).select("id", "status", "ai_title", "ai_hashtags", "ai_text")


@query("select page_id, case when regexp_matches(url, '^https?://[^/]') then regexp_extract(url, '^(https?://[^/]+)', 1) || '/' end as origin, left(trim(regexp_replace(html, '\\s+', ' ', 'g')), 500) as cut from pages")
def url_and_text_cuts(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    return own.select("page_id", T.site_origin(F.col("url")).alias("origin"), T.truncate_for_ai(F.col("html")).alias("cut"))


def _xml(c):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


TITLE = "regexp_replace(raw_title, '[\\x00-\\x1f]', ' ', 'g')"


def _titled(spark, sf_dir):
    """Posts with titles as XML can hold them: control characters are spaces."""
    return views.posts(spark, sf_dir).withColumn("raw_title", F.regexp_replace("raw_title", r"[\x00-\x1f]", " "))


def _feed_docs(spark, sf_dir):
    """RSS documents of at most ten posts of a source each: their size is bounded, however many posts a source has.

    Images are enclosures, of which some are no images, and tags in descriptions.
    """
    own = _titled(spark, sf_dir)
    number = F.col("id").cast("string")
    picture = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<img class='x' src='https://b.example/"), number, F.lit(".png'>"))).otherwise("")
    enclosure = F.concat(F.lit('<enclosure url="https://a.example/'), number, F.lit('.jpg" type="'), F.when(F.col("id") % 2 == 0, "image/jpeg").otherwise("audio/mpeg"), F.lit('"/>'))
    item = F.concat(F.lit("<item><title>"), _xml(F.col("raw_title")), F.lit("</title><link>"), "source_url", F.lit("</link><description>"), _xml(F.concat(picture, F.regexp_replace("raw_description", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))), F.lit("</description><category>"), "source", F.lit("</category>"), enclosure, F.lit("</item>"))
    own = own.select("id", "source", item.alias("x"), F.floor(F.col("id") / 200).alias("part"))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("id", "x"))
    grouped = own.withColumn("doc", F.floor((place - 1) / 10)).groupBy("source", "part", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]), "").alias("items"))
    return grouped.select("source", "part", F.concat(F.lit("<rss version=\"2.0\"><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))


@query(S + f"select source, source_url as link, trim({TITLE}) as title, [source] as categories, case when id % 2 = 0 then 'https://a.example/' || id || '.jpg' when id % 3 = 0 then 'https://b.example/' || id || '.png' end as image_url from posts")
def read_rss(spark, sf_dir):
    return feeds.read_rss(_feed_docs(spark, sf_dir), 10).select("source", "link", F.trim("title").alias("title"), "categories", "image_url")


@query(S + f"select source, source_url as link, trim({TITLE}) as title from posts")
def read_atom(spark, sf_dir):
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), _xml(F.col("raw_title")), F.lit('</title><link rel="self" href="x"/><link rel="alternate" href="'), "source_url", F.lit('"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'))
    return feeds.read_atom(_titled(spark, sf_dir).select("source", entry.alias("xml"))).select("source", "link", F.trim("title").alias("title"))


@query(S + "select id, case when id % 7 = 0 then 'empty document' when id % 5 = 0 then 'malformed document' else 'no rss feed' end as error from posts where id % 7 = 0 or id % 5 = 0 or id % 11 = 0")
def unreadable_feeds(spark, sf_dir):
    """A document for each post: some empty, some cut off in the middle, some of another kind."""
    title = _xml(F.col("raw_title"))
    rss = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), "source_url", F.lit("</link></item></channel></rss>"))
    page = F.concat(F.lit("<html><body>"), title, F.lit("</body></html>"))
    n = F.col("id")
    xml = F.when(n % 7 == 0, F.lit(" ")).when(n % 5 == 0, F.substring(rss, F.lit(1), F.length(rss) - 20)).when(n % 11 == 0, page).otherwise(rss)
    return feeds.unreadable(_titled(spark, sf_dir).select("id", xml.alias("xml")), "rss").select("id", "error")


@query(S + "select source, source_url as link from (select *, row_number() over (partition by source, id // 1000 order by id) as r from posts) where r <= 7")
def limit_per_feed(spark, sf_dir):
    """Of feeds with more items than are wanted the first ones, in the feeds' order."""
    item = F.concat(F.lit("<item><title>t</title><link>"), "source_url", F.lit("</link></item>"))
    own = views.posts(spark, sf_dir).select("source", F.floor(F.col("id") / 1000).alias("part"), "id", item.alias("x"))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("id"))
    items = own.withColumn("place", place).where("place <= 20").groupBy("source", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]), "").alias("items"))
    docs = items.select("source", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))
    return feeds.limit_per_feed(feeds.read_rss(docs, 50), 7).select("source", "link")


@query("select page_id, case when page_id % 3 = 2 then repeat('about ' || page_id || ' ', 30)[:-2] else 'Body of ' || page_id end as body from pages")
def jsonld_depths(spark, sf_dir):
    """Articles in lists and @graph lists inside each other to a depth of twelve, behind things that are no articles."""
    own = views.pages(spark, sf_dir)
    n = F.col("page_id").cast("string")
    long = F.trim(F.repeat(F.concat(F.lit("about "), n, F.lit(" ")), 30))
    article = F.when(F.col("page_id") % 3 == 2, F.to_json(F.struct(F.lit("BlogPosting").alias("@type"), F.lit(" ").alias("articleBody"), long.alias("description"))))
    article = F.coalesce(article, F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"), F.concat(F.lit(" Body of "), n, F.lit(" ")).alias("articleBody"))))
    other = F.lit('{"@type": "Organization", "articleBody": "no"}')
    short = F.lit('{"@type": "Article", "description": "too short"}')
    graph = lambda j: F.concat(F.lit('{"@type": "Article", "articleBody": "later", "@graph": ['), short, F.lit(", "), j, F.lit("]}"))
    line = lambda j: F.concat(F.lit("["), other, F.lit(", "), j, F.lit(", "), short, F.lit("]"))
    levels = F.slice(F.sequence(F.lit(1), F.lit(12)), F.lit(1), (F.col("page_id") % 13).cast("int"))
    json = F.aggregate(levels, article, lambda j, i: F.when(i % 2 == 1, graph(j)).otherwise(line(j)))
    broken = F.lit('<script type="application/ld+json">{"@type": "Article", "articleBody": NaN}</script>')
    html = F.concat(F.col("html"), broken, F.lit('<script type="application/ld+json"> '), json, F.lit(" </script>"))
    return own.select("page_id", pages.jsonld_body(html).alias("body"))


@query("select sha256(html || chr(10)) as digest, strlen(html) + 1 as length, count(*) as copies from pages group by all")
def stored_binaries(spark, sf_dir):
    """A file for each page, scanned and stored by content; once more, and nothing is added."""
    folder, kept = new_dir(spark, "files"), new_dir(spark, "binaries")
    own = views.pages(spark, sf_dir)
    own.select("page_id", F.col("html").alias("value")).repartition(8).write.partitionBy("page_id").text(folder)
    for _ in range(2):
        digests = pages.store_binaries(pages.scan_binaries(spark, folder, "*.txt"), kept)
    return pages.read_binaries(spark, kept).select("digest", "length").join(digests, "digest").groupBy("digest", "length").agg(F.count("*").alias("copies"))


@query("select page_id, 'https://a.media.example/2024/' || page_id || '.jpg?width=1920&format=jpg&auto=webp&quality=85' as hero_image from pages")
def hero_images(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    image = lambda kind, more: F.concat(F.lit(f'<img src="https://a.media.example/{kind}/'), F.col("page_id").cast("string"), F.lit(f'.jpg{more}">'))
    with_images = own.withColumn("html", F.concat("html", image("avatars", ""), image("2024", "?w=1")))
    return pages.pick_hero_image(pages.extract_image_urls(with_images, "media.example").withColumn("feed_image", F.lit(None).cast("string")), "media.example").select("page_id", "hero_image")


@query(ARTICLES + f", best as (select {NORM_URL.format('url')} as k, max((article_text, page_title)) as m from articles group by k) select page_id, 'new' as status, coalesce(m[2], 'old') as raw_title, m[1] as raw_description from pages join best on k = {NORM_URL.format('url')}".replace("m[1]", "m['article_text']").replace("m[2]", "m['page_title']").replace("max((article_text, page_title))", "max({'article_text': article_text, 'page_title': page_title})"))
def reprocess(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    posts = own.select(F.col("page_id").alias("id"), F.col("url").alias("source_url"), F.lit("old").alias("raw_title"), F.lit("").alias("raw_description"), F.lit("failed").alias("status"))
    return pages.reprocess(posts, own, markers=[]).select(F.col("id").alias("page_id"), "status", "raw_title", "raw_description")


def _judged(html: str) -> str:
    """DuckDB: every paragraph of every page, and what is said of it."""
    return f"""with h as (select page_id, {html} as html from pages), e as (select page_id, regexp_extract_all(html, '(?is)<(?:p|h2|h3)[^>]*>(.*?)</(?:p|h2|h3)>', 1) as parts from h),
    u as (select page_id, unnest(range(0, len(parts)))::int as "at", unnest(parts) as x from e), c as (select page_id, "at", {TEXT_OF.format('x')} as p from u)
    select page_id, "at", trim(p) = '' or (strlen(p) <= 280 and ({' or '.join(f"regexp_matches(p, '(?is){x}')" for x in T.PARAGRAPH_PATTERNS)})) as boilerplate, {URL.format('p')} as url, trim(p) <> '' and {_cta('p')} as cta, {_unlinked('p')} as stripped from c"""


def _judge(rows, html, **lists):
    every = F.regexp_extract_all(html, F.lit(r"(?is)<(?:p|h2|h3)[^>]*>(.*?)</(?:p|h2|h3)>"), F.lit(1))
    parts = rows.select("page_id", F.posexplode(F.transform(every, lambda p: T.clean_html(p, **lists))).alias("at", "p"))
    return parts.select("page_id", "at", T.is_boilerplate_par(F.col("p")).alias("boilerplate"), T.has_url(F.col("p")).alias("url"), T.is_cta(F.col("p")).alias("cta"), T.strip_links(F.col("p")).alias("stripped"))


@query(_judged("html"))
def boilerplate_paragraphs(spark, sf_dir):
    return _judge(views.pages(spark, sf_dir), F.col("html"))


#: One more paragraph of each page, by page_id, that is boilerplate, a link or a call.
EXTRA = ("The post X first appeared on Y", "Read more.", "See https://z.example", "**Stay tuned**", "Source", "Continue reading the long story of this and that")


@query(_judged(f"html || '<p>' || case page_id % {len(EXTRA)} " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(EXTRA)) + " end || '</p>'"))
def paragraph_verdicts(spark, sf_dir):
    extra = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), (F.col("page_id") % len(EXTRA) + 1).cast("int"))
    return _judge(views.pages(spark, sf_dir), F.concat("html", F.lit("<p>"), extra, F.lit("</p>")), tails=[], phrases=["no such phrase"])


@query(S + """, b as (select id, trim(raw_title) as t, trim(raw_description) as d from posts), c as (select id, case when d = '' then t when t = '' then left(d, 512) else t || '. ' || left(d, 480) end as base from b)
    select id, 'query: ' || base as input, 'passage: ' || base as e5_passage, 'Represent this sentence for searching relevant passages: ' || base as bge_query, base as bge_passage from c""")
def encoder_inputs(spark, sf_dir):
    t, d = F.col("raw_title"), F.col("raw_description")
    make = lambda family, side: similarity.encoder_input(t, d, family, side)
    return views.posts(spark, sf_dir).select("id", make("e5_base", "query").alias("input"), make("e5_large", "passage").alias("e5_passage"), make("bge", "query").alias("bge_query"), make("bge", "passage").alias("bge_passage"))
