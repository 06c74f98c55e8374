"""Near-duplicate stories: exact, lexical and semantic matches against history, greedy ingest, sweep, whole corpus.

Tables of posts have id, source_url, raw_title, raw_description, ai_title, ai_text, status, created_at, and for the
semantic stage embedding and title_embedding. All pairs come from a token join that loses no verdict: a pair of fewer
shared distinctive words than its verdict asks for can only match by equal titles, which are joined first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.predicates import is_hint_content, is_link_roundup
from newsloom.functions.similarity import (
    LEAST_COMMON,
    LEXICAL_BOUNDS,
    Pair,
    Title,
    cosine,
    decide_duplicate,
    descriptions_similar,
    heuristic_score,
    lead_columns,
    leads_similar,
    least_similarities,
    lexical_verdict,
    match_rank,
    norm,
    norm_title,
    pair_columns,
    semantic_bounds,
    semantic_confidence,
    title_columns,
)
from newsloom.steps import cut_lineage

#: Newest posts that a new one is compared with where comparisons are dear: what a caller who says nothing gets, and the
#: most that a shortlist, which compares each new post with each of them, takes.
HISTORY, MOST_HISTORY = 200, 1_000
#: Bytes of the shortlist's history that are broadcast at most.
BROADCAST_BYTES = 64 << 20
#: What is left to decide, in edges and members of groups, from which on first-come is settled in one task.
SETTLED_IN_A_TASK = 50_000
#: Classes of titles with a word that meet the others with it in a task.
CHUNK = 1_000
#: Meetings of two classes at a word that a task goes through, more or less.
MEETINGS = 5_000_000
#: Members of a group up to which they are plain edges.
SMALL_GROUP = 8
MATCH = ("new_id", "kept_id", "kept_title", "reason", "confidence", "explanation")


def _display(posts: DataFrame) -> DataFrame:
    return posts.withColumn("kept_title", F.coalesce("ai_title", "raw_title"))


def _two_newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the two newest rows; tasks keep two of a key before they shuffle, so a hot key costs no more."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("_place", place).where("_place <= 2").drop("_place")


def match_exact(new: DataFrame, history: DataFrame) -> DataFrame:
    """Equal normalised titles, whatever age or status; the newest kept post other than the new one counts; confidence 100.

    History is reduced to its two newest posts for each title before the join: one of them is another post.
    """
    kept = _display(history).select(norm_title(F.col("raw_title")).alias("norm"), "created_at", "id", "kept_title").where("norm <> ''")
    two = _two_newest(kept, "norm").groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "kept_title")), asc=False).alias("two"))
    own = new.select(F.col("id").alias("new_id"), norm_title(F.col("raw_title")).alias("norm")).where("norm <> ''")
    other = F.get(F.filter("two", lambda k: k["id"] != F.col("new_id")), F.lit(0))
    found = own.join(two, "norm").select("new_id", other.alias("k")).where("k is not null")
    return found.select("new_id", F.col("k.id").alias("kept_id"), F.col("k.kept_title").alias("kept_title"), F.lit("exact").alias("reason"), F.lit(100).alias("confidence"), F.lit("equal normalised titles").alias("explanation"))


def _bounded(history: DataFrame, as_of=None, days: int = 0, limit: int | None = None, status=None) -> DataFrame:
    return dedup_candidates(history, as_of, days, limit, status).where(~is_link_roundup(F.col("raw_title")))


def dedup_candidates(posts: DataFrame, as_of=None, days: int = 30, limit: int | None = 200, status=None, exclude: int | None = None) -> DataFrame:
    """Posts of the last `days` days (0: all), of a status or several, newest first, at most `limit`."""
    out = posts
    if days and as_of is not None:
        out = out.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if status is not None:
        out = out.where(F.col("status").isin([status] if isinstance(status, str) else list(status)))
    if exclude is not None:
        out = out.where(F.col("id") != exclude)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit) if limit else out


def _variants(history: DataFrame) -> DataFrame:
    """(kept_id, norm, words, distinct) of raw and rewritten titles."""
    raw = history.select(F.col("id").alias("kept_id"), F.col("raw_title").alias("title"))
    ai = history.where(F.trim(F.coalesce("ai_title", F.lit(""))) != "").select(F.col("id").alias("kept_id"), F.col("ai_title").alias("title"))
    return title_columns(raw.unionByName(ai), "t", F.col("title"))


def _any_bound(bounds: tuple, test) -> Column:
    """Whether the test holds for one of the bounds (least common words, least Jaccard)."""
    held = F.lit(False)
    for common, jaccard in bounds:
        held = held | test(common, jaccard)
    return held


def candidate_pairs(new: DataFrame, history: DataFrame, bounds: int | tuple) -> DataFrame:
    """(new_id, kept_id), each once, of all pairs whose titles share enough distinctive words.

    bounds: how many, or any of (words, Jaccard). A join in the manner of PPJoin (Xiao et al. 2008): equal sets of words
    are one class on either side, so that a title which many rows share is joined once. Each class puts its rarest words
    first and is looked up by its prefix: by so many words that, if all of them were lacking, no bound could be reached.
    Where two classes meet at a word, their sizes, the word's places and 64 bits of each class's words bound what they can
    share, before the words themselves are compared; and they count where the word is the first that they share, so each
    pair counts once. No task holds more than some CHUNK classes of a word.
    """
    bounds = ((bounds, 0.0),) if isinstance(bounds, int) else tuple(bounds)
    left = title_columns(new.select(F.col("id").alias("new_id"), F.col("raw_title").alias("title")), "t", F.col("title"))
    right = _variants(history)
    signature = lambda df, key: cut_lineage(df.select(key, F.array_sort("t_distinct").alias("words"), F.xxhash64(F.array_sort("t_distinct")).alias("class")))
    left, right = signature(left, "new_id"), signature(right, "kept_id")
    sides = left.select("class", "words", F.lit(1).alias("side")).unionByName(right.select("class", "words", F.lit(2).alias("side")))
    classes = sides.groupBy("class").agg(F.first("words").alias("words"), F.bit_or("side").alias("sides")).where(F.size("words") >= min(c for c, _ in bounds))
    tokens = cut_lineage(classes.select("class", "sides", F.explode("words").alias("word")))
    # Words are numbered from the rarest on, so classes hold sorted numbers.
    rarity = cut_lineage(tokens.groupBy("word").agg(F.count("*").alias("n")).orderBy("n", "word").withColumn("number", F.monotonically_increasing_id()))
    meetings = rarity.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("m")).first().m or 0
    own = tokens.join(rarity, "word").groupBy("class").agg(F.first("sides").alias("sides"), F.array_sort(F.collect_list(F.struct("number", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))).alias("tokens"))
    bits = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))
    ordered = cut_lineage(own.withColumn("words", F.transform("tokens", lambda t: t["number"])).withColumn("bits", bits))
    size = F.size("words")
    # A hair below what is asked for: the verdict itself decides, on the same numbers.
    needed = lambda c, t, n: F.greatest(F.lit(c), F.ceil(n * F.lit(t) - F.lit(1e-9)).cast("int"))
    prefix = F.greatest(*[size - needed(c, t, size) + 1 for c, t in bounds], F.lit(0))
    heads = ordered.withColumn("prefix", prefix).where("prefix > 0").select("class", "words", "bits", "sides", size.alias("n"), F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("at", "token"))
    side = lambda s, x, chunk: heads.where(F.col("sides").bitwiseAND(F.lit(s)) > 0).select(F.col("class").alias(x), F.col("token.number").alias("word"), chunk.alias("chunk"), *[F.col(c).alias(f"{x}_{c}") for c in ("words", "bits", "n", "at")])
    # The classes of a common word are dealt to chunks on one side and meet those of the other in each.
    a = side(1, "a", F.explode(F.sequence(F.lit(0), F.col("token.chunks") - 1)))
    b = side(2, "b", F.pmod(F.col("class"), F.col("token.chunks")).cast("int"))
    both = F.col("a_n") + F.col("b_n")
    can = lambda most: _any_bound(bounds, lambda c, t: most >= needed(c, t / (1 + t), both))
    possible = can(F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")))
    # A bit that the other side lacks stands for one word at least that it lacks.
    lacking = lambda x, y: F.col(f"{x}_n") - F.bit_count(F.col(f"{x}_bits").bitwiseAND(F.bitwise_not(F.col(f"{y}_bits"))))
    shared = F.array_intersect("a_words", "b_words")
    reached = _any_bound(bounds, lambda c, t: (F.size(shared) >= c) & (F.size(shared) >= (both - F.size(shared)) * F.lit(t) - F.lit(1e-9)) if t else F.size(shared) >= c)
    # Few bytes make many pairs, so tasks are dealt by pairs; neither side is broadcast.
    tasks = max(int(meetings // MEETINGS) + 1, new.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda df: df.repartition(tasks, "word", "chunk")
    pairs = dealt(a).hint("merge").join(dealt(b), ["word", "chunk"]).where(possible & can(F.least(lacking("a", "b"), lacking("b", "a"))) & (F.get(shared, F.lit(0)) == F.col("word")) & reached).select("a", "b")
    out = left.select("new_id", F.col("class").alias("a")).join(pairs, "a").join(right.select("kept_id", F.col("class").alias("b")), "b")
    return out.where("new_id <> kept_id").select("new_id", "kept_id").distinct()


def _new_parts(new: DataFrame, vectors: bool = False, leads: bool = False) -> DataFrame:
    """What comparisons need of new posts: new_id, n_created_at and the parts of titles (n) and descriptions (nd)."""
    extra = ["embedding", "title_embedding"] if vectors else []
    n = title_columns(new.select(F.col("id").alias("new_id"), "raw_title", "raw_description", F.col("created_at").alias("n_created_at"), *[F.col(x).alias(f"n_{x}") for x in extra], *[norm(F.col(x)).alias(f"n_{x}_norm") for x in extra]), "n", F.col("raw_title"))
    return (lead_columns(n, "nd", F.col("raw_description")) if leads else n).drop("raw_title", "raw_description")


def _kept_parts(history: DataFrame, vectors: bool = False, leads: bool = False) -> DataFrame:
    """The same of kept posts: kept_id, kept_title, created_at, and raw (r, rd) and rewritten (a, ad) parts."""
    extra = ["embedding", "title_embedding"] if vectors else []
    more = [c for c in ("ai_embedding", "ai_title_embedding") if vectors and c in history.columns]
    k = _display(history).select(
        F.col("id").alias("kept_id"), "kept_title", "raw_title", "raw_description", "ai_title", "ai_text", "created_at",
        *[F.col(x).alias(f"r_{x}") for x in extra], *[F.col(x).alias(x.replace("ai_", "a_", 1)) for x in more],
        *[norm(F.col(x)).alias(f"r_{x}_norm") for x in extra], *[norm(F.col(x)).alias(x.replace("ai_", "a_", 1) + "_norm") for x in more],
    )
    k = title_columns(title_columns(k, "r", F.col("raw_title")), "a", F.col("ai_title"))
    if leads:
        k = lead_columns(lead_columns(k, "rd", F.col("raw_description")), "ad", F.col("ai_text")).withColumn("no_text", F.col("ai_text").isNull())
    return k.withColumn("rewritten", F.trim(F.coalesce("ai_title", F.lit(""))) != "").drop("raw_title", "raw_description", "ai_title", "ai_text")


def _compared(out: DataFrame, leads: bool = False) -> DataFrame:
    """Pairs of new and kept parts with the comparisons: titles (nr, na) and, with leads, whether the new description is
    like the raw (nr_described) and like the rewritten one (na_described; na_either: that, or the raw one where there is none)."""
    out = pair_columns(pair_columns(out, "nr", Title.at("n"), Title.at("r")), "na", Title.at("n"), Title.at("a"))
    if leads:
        out = out.withColumns({"nr_described": leads_similar(Title.at("nd"), Title.at("rd")), "na_described": leads_similar(Title.at("nd"), Title.at("ad"))})
        out = out.withColumn("na_either", F.when(F.col("no_text"), F.col("nr_described")).otherwise(F.col("na_described")))
    gone = [f"{p}_{x}" for p in ("n", "r", "a", "nd", "rd", "ad") for x in ("words", "distinct")] + [f"{p}_norm" for p in ("a", "nd", "rd", "ad")]
    return out.drop(*gone)


def _attach(pairs: DataFrame, new: DataFrame, history: DataFrame, vectors: bool = False, leads: bool = False) -> DataFrame:
    """Pairs with what verdicts need; titles are taken apart once a post and compared once a pair. vectors: the embeddings too."""
    out = pairs.join(_new_parts(new, vectors, leads), "new_id").join(_kept_parts(history, vectors, leads), "kept_id")
    return _compared(out, leads)


#: Columns of posts that the lexical and the semantic comparisons read.
TITLES = ("id", "raw_title", "ai_title", "created_at")
TEXTS = (*TITLES, "raw_description", "ai_text", "embedding", "title_embedding", "ai_embedding", "ai_title_embedding")


def _held(posts: DataFrame, names: tuple) -> DataFrame:
    """The posts as written to the shared folder, with the named columns alone, since they are read several times; columns
    that comparisons name but do not need are null."""
    own = cut_lineage(posts.select(*[c for c in names if c in posts.columns]), "posts")
    return own.withColumns({c: F.lit(None).cast("string") for c in ("raw_description", "ai_text") if c not in own.columns})


def lexical_edges(pairs: DataFrame, family: str) -> DataFrame:
    """Of attached pairs the lexical duplicates, with verdict and rank; the rank uses the kept raw title."""
    raw, ai = Pair.at("nr"), Pair.at("na")
    verdict = F.coalesce(lexical_verdict(raw, family), F.when(F.col("rewritten"), lexical_verdict(ai, family)))
    out = pairs.withColumn("verdict", verdict).where("verdict is not null")
    out = out.withColumn("rank", match_rank(raw, family, F.col("verdict.confidence")))
    return out.drop(*[c for c in pairs.columns if c.startswith(("nr_", "na_"))])


def best_match(matches: DataFrame) -> DataFrame:
    """One row for each new_id: of largest rank, then of the newest kept post, then of the largest id."""
    columns = F.struct(*[c for c in matches.columns if c != "new_id"])
    return matches.groupBy("new_id").agg(F.max_by(columns, F.struct("rank", "created_at", "kept_id")).alias("m")).select("new_id", "m.*")


def _as_matches(best: DataFrame, reason: str, confidence: Column, explanation: Column) -> DataFrame:
    return best.select("new_id", "kept_id", "kept_title", F.lit(reason).alias("reason"), confidence.cast("int").alias("confidence"), explanation.alias("explanation"))


def match_lexical(new: DataFrame, history: DataFrame, family: str = "e5_base", as_of=None, days: int = 0, limit: int | None = None, status=None) -> DataFrame:
    """The best lexical match of each new post; link roundups take no part on either side."""
    own = _held(new.where(~is_link_roundup(F.col("raw_title"))), TITLES)
    kept = _held(_newest_of_title(_bounded(history, as_of, days, limit, status)), TITLES)
    pairs = candidate_pairs(own, kept, LEXICAL_BOUNDS[family]).unionByName(_equal_pairs(own, kept, family)).distinct()
    best = best_match(lexical_edges(_attach(pairs, own, kept), family))
    return _as_matches(best, "lexical", F.col("verdict.confidence"), F.col("verdict.explanation"))


def _newest_of_title(history: DataFrame) -> DataFrame:
    """The two newest posts of each pair of raw and rewritten title: the best lexical match is always one of them."""
    rows = history.withColumn("_raw", norm_title(F.col("raw_title"))).withColumn("_ai", norm_title(F.col("ai_title")))
    return _two_newest(rows, "_raw", "_ai").drop("_raw", "_ai")


def _equal_pairs(new: DataFrame, history: DataFrame, family: str | None) -> DataFrame:
    """New posts with other posts of equal raw or rewritten title: with the two best by rank, then the newest, of each
    title, one of which is another post; without a family with all of them."""
    own = new.select(F.col("id").alias("new_id"), norm_title(F.col("raw_title")).alias("norm")).where("norm <> ''")
    norms = F.array_distinct(F.array(norm_title(F.col("raw_title")), norm_title(F.col("ai_title"))))
    kept = history.select("id", "created_at", "raw_title", F.explode(norms).alias("norm")).where("norm <> ''")
    if family is not None:
        rows = title_columns(title_columns(kept, "n", F.col("norm")), "r", F.col("raw_title"))
        rows = pair_columns(rows, "nr", Title.at("n"), Title.at("r"))
        rank = match_rank(Pair.at("nr"), family, F.coalesce(lexical_verdict(Pair.at("nr"), family)["confidence"], F.lit(98)))
        best = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("rank"), F.desc("created_at"), F.desc("id")))
        kept = rows.select("norm", "id", "created_at", rank.alias("rank")).withColumn("_place", best).where("_place <= 2")
    return own.join(kept.select("norm", F.col("id").alias("kept_id")), "norm").where("new_id <> kept_id").select("new_id", "kept_id")


def _sim(kept: str, vector: str) -> Column:
    """The cosine of a new post's vector and a kept one's, raw (r) or rewritten (a)."""
    return cosine(*[F.col(f"{x}_{vector}") for x in ("n", kept)], *[F.col(f"{x}_{vector}_norm") for x in ("n", kept)])


def _attach_likely(pairs: DataFrame, new: DataFrame, history: DataFrame, family: str, thresholds: dict | None) -> DataFrame:
    """Like `_attach` with vectors and leads, but for pairs that the semantic decision cannot call duplicates: those whose
    similarities are below all of its thresholds and whose titles share too little for a lexical verdict. What is left,
    often a small part, has titles and descriptions compared, which takes most of the time."""
    full, title = least_similarities(family, thresholds)
    least = min(c for c, _ in LEXICAL_BOUNDS[family])
    out = pairs.join(_new_parts(new, True, True), "new_id").join(_kept_parts(history, True, True), "kept_id")
    near = F.lit(False)
    for kept in ("r", "a"):
        near = near | (F.col("n_norm") == F.col(f"{kept}_norm")) | (F.size(F.array_intersect("n_distinct", f"{kept}_distinct")) >= least)
    for kept in ("r", "a") if "a_embedding" in out.columns else ("r",):
        # Rewritten texts without a vector are never the nearer ones.
        near = near | F.coalesce(F.round(_sim(kept, "embedding"), 6) >= full, F.lit(False)) | F.coalesce(F.round(_sim(kept, "title_embedding"), 6) >= title, F.lit(False))
    return _compared(out.where(near), True)


def semantic_scores(pairs: DataFrame) -> DataFrame:
    """Adds full_sim, title_sim and whether the raw or the rewritten variant is nearer (the raw one on ties)."""
    out = pairs.withColumn("raw_full", _sim("r", "embedding")).withColumn("raw_title_sim", _sim("r", "title_embedding"))
    if "a_embedding" in pairs.columns:
        out = out.withColumn("ai_full", _sim("a", "embedding")).withColumn("ai_title_sim", _sim("a", "title_embedding"))
    else:  # rewritten texts without vectors of their own
        out = out.withColumn("ai_full", F.lit(None).cast("double")).withColumn("ai_title_sim", F.lit(None).cast("double"))
    rewritten = F.col("rewritten") & F.coalesce(F.col("ai_full") > F.col("raw_full"), F.lit(False))
    return out.withColumn("by_rewrite", rewritten).withColumn("full_sim", F.when(rewritten, F.col("ai_full")).otherwise(F.col("raw_full"))).withColumn("title_sim", F.when(rewritten, F.col("ai_title_sim")).otherwise(F.col("raw_title_sim")))


def semantic_edges(pairs: DataFrame, family: str, thresholds: dict | None = None) -> DataFrame:
    """Attached pairs with is_duplicate, confidence and rank."""
    decide = lambda p, described: decide_duplicate(Pair.at(p), family, F.col("full_sim"), F.col("title_sim"), F.col(described), thresholds)
    out = semantic_scores(pairs).withColumn("is_duplicate", F.when(F.col("by_rewrite"), decide("na", "na_described")).otherwise(decide("nr", "nr_described")))
    out = out.withColumn("confidence", semantic_confidence(F.col("full_sim")))
    return out.withColumn("rank", match_rank(Pair.at("nr"), family, F.col("confidence"))).drop(*[c for c in pairs.columns if c.endswith(("embedding", "embedding_norm"))])


def _semantic_class(posts: DataFrame) -> Column:
    """Equal for posts that the semantic decision cannot tell apart: by titles, descriptions and vectors."""
    more = [c for c in ("embedding", "title_embedding", "ai_embedding", "ai_title_embedding") if c in posts.columns]
    rewritten = F.trim(F.coalesce("ai_title", F.lit(""))) != ""
    parts = [norm_title(F.col("raw_title")), norm_title(F.col("ai_title")), norm_title(F.col("raw_description")), norm_title(F.col("ai_text")), rewritten.cast("string"), *[F.to_json(F.struct(c)) for c in more]]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def match_semantic(new: DataFrame, history: DataFrame, family: str = "e5_base", thresholds: dict | None = None, as_of=None, days: int = 0, limit: int | None = HISTORY, status=None) -> DataFrame:
    """The best semantic match of each new post, by cosine of full and title embeddings and the decision cascade.

    Of the `limit` newest posts of the window, or, without a limit, of all of them. Posts that are alike in everything the
    decision looks at are one class, of which the two newest are compared: one of them is another post than the new one.
    """
    own, kept = new.where(~is_link_roundup(F.col("raw_title"))), _bounded(history, as_of, days, limit, status)
    if not limit:
        kept = _two_newest(kept.withColumn("_class", _semantic_class(kept)), "_class").drop("_class")
    own, kept = _held(own, TEXTS), _held(kept, TEXTS)
    pairs = candidate_pairs(own, kept, semantic_bounds(family, thresholds)).unionByName(_equal_pairs(own, kept, None)).distinct()
    edges = semantic_edges(_attach_likely(pairs, own, kept, family, thresholds), family, thresholds).where("is_duplicate").select("new_id", "kept_id", "kept_title", "created_at", "title_sim", "confidence", "rank")
    text = F.format_string("semantic similarity %d%% (titles %d%%)", "confidence", F.round(F.col("title_sim") * 100).cast("int"))
    return _as_matches(best_match(edges), "semantic", F.col("confidence"), text)


def shortlist(new: DataFrame, history: DataFrame, family: str = "e5_base", k: int = 50, as_of=None, days: int = 0, limit: int = HISTORY) -> DataFrame:
    """(new_id, kept_id, score, place): pairs of positive heuristic score with the `limit` newest posts of the window, best
    first, ties to the newer post; and, where fewer than k are positive, pairs of score zero up to k in all.

    Every new post is held against each of those few posts, MOST_HISTORY at most, so the work grows with the new posts
    alone and nothing of them is shuffled but the scores. There is no form without a limit: descriptions count as alike
    for a single word that one of them repeats, so of an unbounded history nearly every pair would be in the list.
    """
    if not limit or not 1 <= limit <= MOST_HISTORY:
        raise ValueError(f"a shortlist takes 1 to {MOST_HISTORY} posts of history")
    kept = cut_lineage(_kept_parts(dedup_candidates(history, as_of, days, limit), leads=True).drop("kept_title"))
    held = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*[c for c in kept.columns if c != "created_at"])))).alias("b")).first().b or 0
    pairs = _new_parts(new, leads=True).join(F.broadcast(kept) if held <= BROADCAST_BYTES else kept, F.col("new_id") != F.col("kept_id"))
    own = _compared(pairs, leads=True)
    by_raw = heuristic_score(Pair.at("nr"), F.col("nr_described"), family)
    by_ai = F.when(F.col("rewritten"), heuristic_score(Pair.at("na"), F.col("na_either"), family))
    scored = own.select("new_id", "kept_id", "created_at", F.greatest(by_raw, by_ai).alias("score"))
    place = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("kept_id")))
    return scored.withColumn("place", place).where((F.col("score") > 0) | (F.col("place") <= k)).select("new_id", "kept_id", "score", "place")


def compare_pairs(pairs: DataFrame, family: str = "e5_base", thresholds: dict | None = None) -> DataFrame:
    """Adds class, full_sim, title_sim, is_duplicate and confidence to pairs (new_title, new_desc, kept_title, kept_desc
    and, if there, new_/kept_embedding and new_/kept_title_embedding); nothing is shuffled."""
    own = title_columns(title_columns(pairs, "n", F.col("new_title")), "r", F.col("kept_title"))
    sims = {"full_sim": ("new_embedding", "kept_embedding"), "title_sim": ("new_title_embedding", "kept_title_embedding")}
    for name, (a, b) in sims.items():
        if name not in pairs.columns:
            own = own.withColumn(name, cosine(F.col(a), F.col(b)) if a in pairs.columns else F.lit(0.0))
    own = pair_columns(own, "nr", Title.at("n"), Title.at("r"))
    own = own.withColumn("class", F.coalesce(lexical_verdict(Pair.at("nr"), family)["class"], F.lit("none")))
    described = descriptions_similar(F.col("new_desc"), F.col("kept_desc"))
    own = own.withColumn("is_duplicate", decide_duplicate(Pair.at("nr"), family, F.col("full_sim"), F.col("title_sim"), described, thresholds)).withColumn("confidence", semantic_confidence(F.col("full_sim")))
    return own.drop(*[c for c in own.columns if c not in pairs.columns and c not in ("class", "full_sim", "title_sim", "is_duplicate", "confidence")])


def dedup_report(new: DataFrame, history: DataFrame, family: str = "e5_base", thresholds: dict | None = None) -> DataFrame:
    """(new_id, kept_id, full_sim, title_sim, class, is_duplicate, confidence) of every candidate pair."""
    pairs = candidate_pairs(new, history, LEAST_COMMON[family])
    edges = semantic_edges(_attach(pairs, new, history, True, True), family, thresholds)
    verdict = lexical_verdict(Pair.at("nr"), family)
    return edges.select("new_id", "kept_id", F.round("full_sim", 6).alias("full_sim"), F.round("title_sim", 6).alias("title_sim"), F.coalesce(verdict["class"], F.lit("none")).alias("class"), "is_duplicate", "confidence")


def story_classes(posts: DataFrame, semantic: bool = False) -> DataFrame:
    """(id, at, norm, head) of every post: its place (created_at, id), its normalised title and its class's first place.

    A class holds posts that match the same others: equal raw and rewritten titles, for the semantic decision equal
    descriptions and vectors too. Posts without a title match nothing as new ones, so each is its own class.
    """
    norm = norm_title(F.col("raw_title"))
    key = _semantic_class(posts) if semantic else F.sha2(F.concat_ws("\x00", norm, norm_title(F.col("ai_title"))), 256)
    rows = posts.select("id", F.struct("created_at", "id").alias("at"), norm.alias("norm"), key.alias("key"))
    heads = rows.where("norm <> ''").groupBy("key").agg(F.min("at").alias("head"))
    return rows.join(heads, "key", "left").select("id", "at", "norm", F.coalesce("head", "at").alias("head"))


def class_pairs(posts: DataFrame, classes: DataFrame, family: str, semantic: bool = False, thresholds: dict | None = None) -> DataFrame:
    """(a, b), a < b: heads of classes with different titles of which one is a duplicate of the other."""
    single = posts.join(classes.where("id = head.id").select("id"), "id", "left_semi").where(~is_link_roundup(F.col("raw_title")))
    single = _held(single, TEXTS if semantic else TITLES)
    bounds = semantic_bounds(family, thresholds) if semantic else LEXICAL_BOUNDS[family]
    pairs = candidate_pairs(single, single, bounds).unionByName(_equal_pairs(single, single, None)).distinct()
    attached = _attach_likely(pairs, single, single, family, thresholds) if semantic else _attach(pairs, single, single)
    attached = attached.where("n_norm <> r_norm or n_norm = ''")
    edges = semantic_edges(attached, family, thresholds).where("is_duplicate") if semantic else lexical_edges(attached, family)
    new, kept = F.struct(F.col("n_created_at").alias("created_at"), F.col("new_id").alias("id")), F.struct("created_at", F.col("kept_id").alias("id"))
    return edges.select(F.least(new, kept).alias("a"), F.greatest(new, kept).alias("b")).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def match_edges(posts: DataFrame, family: str = "e5_base", semantic: bool = False, thresholds: dict | None = None) -> DataFrame:
    """Undirected edges (a, b), a < b, that connect whatever posts are duplicates of each other.

    Of equal titles, which would be cliques, each post is linked to its class's head and each head to the first post of
    that title; classes of different titles are linked by their heads.
    """
    classes = cut_lineage(story_classes(posts, semantic))
    first = classes.where("norm <> ''").groupBy("norm").agg(F.min("at.id").alias("first"))
    stars = classes.where("id <> head.id").select(F.col("head.id").alias("a"), F.col("id").alias("b"))
    titles = classes.where("id = head.id").join(first, "norm").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = class_pairs(posts, classes, family, semantic, thresholds).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    every = stars.unionByName(titles).unionByName(pairs)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rank_of(value):
    """A key that orders ids as Spark does, nulls first; structs come as dictionaries."""
    if isinstance(value, dict):
        return tuple(_rank_of(v) for v in value.values())
    return (value is not None, value)


def _settle(rows: list[tuple]) -> set:
    """Ids that go, of rows (kind, id, other, same, group): `need`: id is kept only if other's state (kept) equals same;
    `group`: id is of a group, which keeps one of its members at most; `gone`: id goes. In order of id."""
    needs: dict = {}
    groups: dict = {}
    gone, ids = set(), set()
    for kind, v, other, same, group in rows:
        ids.add(v)
        if kind == "need":
            ids.add(other)
            needs.setdefault(v, []).append((other, same))
        elif kind == "group":
            groups.setdefault(v, []).append(group)
        else:
            gone.add(v)
    taken: set = set()
    for v in sorted(ids):
        own = groups.get(v, ())
        if v in gone or any((r not in gone) != same for r, same in needs.get(v, ())) or any(g in taken for g in own):
            gone.add(v)
        else:
            taken.update(own)
    return gone


def _settled_in_a_task(need: DataFrame, groups: DataFrame, doomed: DataFrame, kind) -> DataFrame:
    """(id) of those that go, of what is left, which is little; one task goes through it in order of id."""
    empty = F.lit(None).cast(kind)
    rows = need.select(F.lit("need").alias("kind"), F.col("v").alias("id"), F.col("r").alias("other"), "s", F.lit(None).cast("string").alias("group"))
    rows = rows.unionByName(groups.select(F.lit("group").alias("kind"), "id", empty.alias("other"), F.lit(False).alias("s"), F.col("group").cast("string").alias("group")))
    rows = rows.unionByName(doomed.select(F.lit("gone").alias("kind"), "id", empty.alias("other"), F.lit(False).alias("s"), F.lit(None).cast("string").alias("group")))

    def settle(batches):
        import pyarrow as pa

        held, values = [], {}
        for batch in batches:
            for k, v, other, s, g in zip(*(c.to_pylist() for c in batch.columns)):
                values[_rank_of(v)] = v
                held.append((k, _rank_of(v), _rank_of(other), s, g))
            form = batch.schema.field(1).type
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([values[r] for r in _settle(held) if r in values], form)], names=["id"])

    return rows.repartition(1).mapInArrow(settle, need.select(F.col("v").alias("id")).schema)


def greedy_kept(nodes: DataFrame, edges: DataFrame, groups: DataFrame | None = None, small: int = SETTLED_IN_A_TASK) -> DataFrame:
    """(id, kept): in order of id a node is kept unless an earlier kept node is its neighbour, or of its group.

    groups: (id, group), all of a group being neighbours; ids may be of any ordered type. What is left to decide are
    needs: v is kept only if r's state is s (at first: if no earlier neighbour is kept). In rounds, nodes without needs
    are kept and those with an unmet one go; and a node with a single need has its state from that of another, the same or
    the opposite, so that chains of such nodes are followed by doubling and drop out of what is left, however long they
    are. When no more than `small` needs are left, one task settles them. Each round is written to the shared folder.
    """
    kind = nodes.schema["id"].dataType
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r"))
    if groups is None:
        groups = nodes.select("id", F.lit(None).cast("string").alias("group")).limit(0)
    own = groups.where("group is not null").select("id", "group").distinct()
    sized = cut_lineage(own.join(own.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group"))
    few = sized.where(F.col("n") <= SMALL_GROUP)
    links = links.unionByName(few.select("group", F.col("id").alias("v")).join(few.select("group", F.col("id").alias("r")), "group").where("r < v").select("v", "r"))
    need = cut_lineage(links.distinct().withColumn("s", F.lit(False)))
    open_groups = cut_lineage(sized.where(F.col("n") > SMALL_GROUP).select("id", "group"))
    doomed = nodes.select("id").limit(0)
    gone: list[DataFrame] = []
    followers: list[DataFrame] = []
    one = lambda df, name: df.select(F.col(name).alias("id"))
    while (left := need.count() + open_groups.count()) > small:
        least = open_groups.groupBy("group").agg(F.min("id").alias("least"))
        waiting = one(need, "v").unionByName(open_groups.join(least, "group").where("id > least").select("id")).unionByName(doomed).distinct()
        free = cut_lineage(one(need, "r").unionByName(one(least, "least")).distinct().join(waiting, "id", "left_anti"))
        fellows = open_groups.join(open_groups.join(free, "id", "left_semi").select("group").distinct(), "group", "left_semi").select("id").join(free, "id", "left_anti")
        unmet = need.join(free.withColumnRenamed("id", "r"), "r", "left_semi").where("not s").select(F.col("v").alias("id"))
        torn = need.groupBy("v", "r").agg(F.count_distinct("s").alias("n")).where("n > 1").select(F.col("v").alias("id"))
        out = cut_lineage(unmet.unionByName(fellows).unionByName(torn).unionByName(doomed).distinct())
        gone.append(out)
        rest = need.join(out.withColumnRenamed("id", "v"), "v", "left_anti").join(free.withColumnRenamed("id", "r"), "r", "left_anti")
        rest = cut_lineage(rest.join(out.select(F.col("id").alias("r"), F.lit(True).alias("lost")), "r", "left"))
        doomed = cut_lineage(rest.where("lost and s").select(F.col("v").alias("id")).distinct())
        need = rest.where("lost is null").select("v", "r", "s")
        open_groups = cut_lineage(open_groups.join(out.unionByName(free), "id", "left_anti"))
        # Nodes with a single need follow the node that it names, and that one what it follows itself.
        single = need.groupBy("v").agg(F.count("*").alias("n"), F.first("r").alias("r"), F.first("s").alias("s")).where("n = 1").drop("n")
        single = single.join(open_groups.select(F.col("id").alias("v")).unionByName(doomed.select(F.col("id").alias("v"))), "v", "left_anti")
        single = cut_lineage(single.withColumn("moved", F.lit(True)))
        while not single.where("moved").isEmpty():
            ahead = single.select(F.col("v").alias("r"), F.col("r").alias("r2"), F.col("s").alias("s2"))
            single = cut_lineage(single.drop("moved").join(ahead, "r", "left").select("v", F.coalesce("r2", "r").alias("r"), F.when(F.col("r2").isNull(), F.col("s")).otherwise(F.col("s") == F.col("s2")).alias("s"), F.col("r2").isNotNull().alias("moved")))
        followers.append(single.select("v", "r", "s"))
        ahead = single.select(F.col("v").alias("r"), F.col("r").alias("r2"), F.col("s").alias("s2"))
        need = need.join(single.select("v"), "v", "left_anti").join(ahead, "r", "left")
        need = cut_lineage(need.select("v", F.coalesce("r2", "r").alias("r"), F.when(F.col("r2").isNull(), F.col("s")).otherwise(F.col("s") == F.col("s2")).alias("s")).distinct())
    if left or gone:
        gone.append(cut_lineage(_settled_in_a_task(need, open_groups, doomed, kind)))
    if not gone:
        return nodes.select("id", F.lit(True).alias("kept"))
    lost = gone[0]
    for more in gone[1:]:
        lost = lost.unionByName(more)
    lost = lost.distinct()
    for single in reversed(followers):  # what a follower follows was settled in a later round than it was set aside
        told = single.join(lost.select(F.col("id").alias("r"), F.lit(True).alias("out")), "r", "left")
        lost = cut_lineage(lost.unionByName(told.where(F.col("out").isNull() != F.col("s")).select(F.col("v").alias("id"))).distinct())
    return nodes.select("id").join(lost.withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNull().alias("kept"))


def _first_come(posts: DataFrame, family: str, semantic: bool, thresholds: dict | None) -> DataFrame:
    """(id, survivor, kept): in order of (created_at, id) a post is kept unless an earlier kept post is its duplicate.

    Of a class only its head can be kept, and of a title one post; so classes are decided, never their members' pairs.
    """
    classes = cut_lineage(story_classes(posts, semantic))
    pairs = cut_lineage(class_pairs(posts, classes, family, semantic, thresholds))
    heads = classes.where("id = head.id").select(F.col("head").alias("id"), F.when(F.col("norm") != "", F.col("norm")).alias("group"))
    live = cut_lineage(greedy_kept(heads.select("id"), pairs, heads).where("kept").select(F.col("id").alias("b")))
    titled = heads.join(live, F.col("id") == F.col("b")).where("group is not null").select("group", "b")
    near = _both(pairs).join(live, "b").select("a", "b").unionByName(heads.join(titled, "group").select(F.col("id").alias("a"), "b"))
    near = near.groupBy(F.col("a").alias("_head")).agg(F.min("b").alias("_near"))
    out = classes.join(near, F.col("head") == F.col("_head"), "left").join(live, F.col("at") == F.col("b"), "left")
    kept = F.col("b").isNotNull()
    return out.select("id", F.when(kept, F.col("id")).otherwise(F.col("_near.id")).alias("survivor"), kept.alias("kept"))


def dedup_batch(new: DataFrame, history: DataFrame, family: str = "e5_base", as_of=None, days: int = 30, limit: int | None = None, semantic: bool = False, thresholds: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(new posts kept, matches of the others): exact, then lexical, then semantic matches with history; then, in order
    of (created_at, id), first come first kept within the batch. Each stage sees only what the stages before left."""
    rest, found = new, None
    for stage in ("exact", "lexical", "semantic")[: 3 if semantic else 2]:
        if stage == "exact":
            hit = match_exact(rest, history)
        elif stage == "lexical":
            hit = match_lexical(rest, history, family, as_of, days, limit)
        else:
            hit = match_semantic(rest, history, family, thresholds, as_of, days, limit)
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select(F.col("new_id").alias("id")), "id", "left_anti")
    rest = cut_lineage(rest)
    decided = cut_lineage(_first_come(rest, family, semantic, thresholds))
    titles = _display(rest).select(F.col("id").alias("kept_id"), "kept_title")
    winner = decided.where("not kept").select(F.col("id").alias("new_id"), F.col("survivor").alias("kept_id"))
    inside = winner.join(titles, "kept_id").select("new_id", "kept_id", "kept_title", F.lit("batch").alias("reason"), F.lit(98).alias("confidence"), F.lit("matches an earlier post of the batch").alias("explanation"))
    return rest.join(decided.where("kept").select("id"), "id", "left_semi"), found.unionByName(inside)


def _by_class(classes: DataFrame, pairs: DataFrame, *aggregates: Column) -> DataFrame:
    """Classes with `own`, the aggregates over all posts of the same title, and `other`, over those of neighbouring classes."""
    own = classes.where("norm <> ''").groupBy("norm").agg(F.struct(*aggregates).alias("own"))
    each = classes.groupBy(F.col("head").alias("b")).agg(*aggregates)
    names = [c for c in each.columns if c != "b"]
    other = _both(pairs).join(each, "b").groupBy(F.col("a").alias("head")).agg(F.struct(*[F.max(c).alias(c) for c in names]).alias("other"))
    return classes.join(own, "norm", "left").join(other, "head", "left")


def sweep(posts: DataFrame, new_ids: DataFrame, family: str = "e5_base", semantic: bool = False, thresholds: dict | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Posts left after the sweep of the new ones (status new or processing), ascending: a post goes if any live post
    matches. For edges that hold either way round that is: it has a match outside the swept set, or a larger one inside.

    Whether a post has one is told by its title's and its neighbouring classes' posts, which are aggregated and never
    paired. edges: pairs of ids to go by instead.
    """
    swept = posts.where(F.col("status").isin("new", "processing")).join(new_ids.select("id").distinct(), "id", "left_semi").select("id")
    if edges is not None:
        mine = _both(edges).join(swept.withColumnRenamed("id", "a"), "a", "left_semi")
        inside = swept.select(F.col("id").alias("b"), F.lit(True).alias("_inside"))
        gone = mine.join(inside, "b", "left").where("_inside is null or b > a").select(F.col("a").alias("id")).distinct()
        return posts.join(gone, "id", "left_anti")
    classes = cut_lineage(story_classes(posts, semantic).join(swept.withColumn("inside", F.lit(True)), "id", "left"))
    pairs = class_pairs(posts, classes, family, semantic, thresholds)
    outside, largest = F.max(F.col("inside").isNull()).alias("outside"), F.max(F.when(F.col("inside"), F.col("id"))).alias("largest")
    told = _by_class(classes, pairs, outside, largest).where("inside")
    larger = F.coalesce(F.greatest("own.largest", "other.largest") > F.col("id"), F.lit(False))
    gone = told.where(F.coalesce("own.outside", F.lit(False)) | F.coalesce("other.outside", F.lit(False)) | larger).select("id")
    return posts.join(gone, "id", "left_anti")


def resolve_survivors(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, survivor) from (id, kept_id): follows kept_id to a post that was not itself removed, doubling each round."""
    out = cut_lineage(links.select("id", F.col("kept_id").alias("survivor")))
    for _ in range(max_rounds):
        step = out.select(F.col("id").alias("_id"), F.col("survivor").alias("_next"))
        moved = cut_lineage(out.join(step, F.col("survivor") == F.col("_id"), "left").select("id", F.coalesce("_next", "survivor").alias("survivor"), F.col("_next").isNotNull().alias("moved")))
        out = moved.select("id", "survivor")
        if moved.where("moved").isEmpty():
            return out
    raise RuntimeError("kept posts lead in a circle")


def dedup_corpus(posts: DataFrame, mode: str = "greedy", family: str = "e5_base", semantic: bool = False, thresholds: dict | None = None) -> DataFrame:
    """(id, survivor, kept) for every post. greedy: in order of (created_at, id), first kept wins; sweep: of all posts,
    those with the largest ids stay."""
    if mode == "greedy":
        return _first_come(posts, family, semantic, thresholds)
    classes = cut_lineage(story_classes(posts, semantic))
    told = _by_class(classes, class_pairs(posts, classes, family, semantic, thresholds), F.max("id").alias("largest"))
    larger = told.select("id", F.greatest("own.largest", "other.largest").alias("kept_id")).where("kept_id > id")
    ends = resolve_survivors(larger)
    return posts.select("id").join(ends, "id", "left").select("id", F.coalesce("survivor", "id").alias("survivor"), F.col("survivor").isNull().alias("kept"))


def publish_gate(queue: DataFrame, posts: DataFrame, family: str = "e5_base", puzzles=None, phrases=None) -> DataFrame:
    """The queue with block_reason: hint, exact (any status) or lexical duplicate of a published post, else null."""
    lists = {k: v for k, v in (("puzzles", puzzles), ("phrases", phrases)) if v is not None}
    hint = is_hint_content(F.col("raw_title"), F.col("source_url"), **lists) | is_hint_content(F.coalesce("ai_title", F.lit("")), F.col("source_url"), **lists)
    exact = match_exact(queue, posts).select(F.col("new_id").alias("id"), F.lit("exact").alias("_exact"))
    near = match_lexical(queue, posts, family, status="published").select(F.col("new_id").alias("id"), F.lit("lexical").alias("_near"))
    out = queue.join(exact, "id", "left").join(near, "id", "left")
    return out.withColumn("block_reason", F.when(hint, "hint").otherwise(F.coalesce("_exact", "_near"))).drop("_exact", "_near")
