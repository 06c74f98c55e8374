"""Titles, gates and the decision cascade on literal rows, and the joins against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import predicates as P
from newsloom.functions import similarity as M
from newsloom.operators import dedup


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normal_forms(spark):
    rows = [("  Hello,  WORLD! ", "hello world"), ("Ёлка №5 — «Да»", "ёлка 5 да"), ("", ""), (None, "")]
    assert values(spark, [r[:1] for r in rows], "t string", M.norm_title(F.col("t"))) == [(r[1],) for r in rows]
    urls = [("https://A.b/C/?q#f", "https://a.b/c"), ("http://x//", "http://x"), ("x#y?z", "x"), (None, "")]
    assert values(spark, [u[:1] for u in urls], "t string", M.norm_url(F.col("t"))) == [(u[1],) for u in urls]


@pytest.mark.parametrize(
    "family,a,b,similar,strong,medium",
    [
        ("e5_base", "Studio reveals orbital mining strategy sequel", "Studio reveals orbital mining strategy sequel!", True, True, False),
        ("e5_base", "Studio reveals orbital mining strategy", "Orbital mining strategy by studio delayed", True, True, False),
        ("e5_large", "Studio reveals orbital mining strategy", "Orbital mining strategy by studio delayed", True, True, False),
        ("e5_large", "Orbital mining strategy delayed", "Orbital mining strategy shown", True, False, True),
        ("bge", "World tour crazy taxi", "Crazy taxi world tour service", True, False, True),
        ("e5_large", "Summer orbital mining strategy showcase", "Winter orbital mining strategy showcase", True, False, False),
        ("e5_base", "One thing", "Another matter", False, False, False),
        ("e5_base", "", "", False, False, False),
    ],
)
def test_title_classes(spark, family, a, b, similar, strong, medium):
    x, y = F.col("a"), F.col("b")
    got = values(spark, [(a, b)], "a string, b string", M.titles_similar(x, y), M.titles_strong(x, y, family), M.titles_medium(x, y, family))
    assert got == [(similar, strong, medium)]


def test_byte_lengths_count_not_characters(spark):
    assert values(spark, [("да и нет",)], "t string", M.distinctive(F.col("t"))) == [(["да", "нет"],)]


def test_similar_is_directed(spark):
    a, b = "mars mars probe lost", "mars rover found water ice"
    x, y = F.col("a"), F.col("b")
    assert values(spark, [(a, b)], "a string, b string", M.titles_similar(x, y), M.titles_similar(y, x)) == [(True, False)]


def test_decision_and_confidence(spark):
    rows = [(0.90, 0.5, True), (0.83, 0.85, True), (0.69, 0.2, True), (0.5, 0.5, False)]
    a, b = M.Title.of(F.lit("orbital mining delayed again")), M.Title.of(F.lit("orbital mining postponed"))
    got = values(spark, [r[:2] for r in rows], "f double, t double", M.classify_duplicate("e5_base", F.col("f"), F.col("t"), a, b, F.lit(""), F.lit("")), M.semantic_confidence(F.col("f")))
    assert got == [(r[2], int(r[0] * 100 + 1e-6)) for r in rows]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], 0.5**0.5), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)]
    got = values(spark, [r[:2] for r in rows], "a array<float>, b array<float>", M.cosine(F.col("a"), F.col("b")))
    assert all(abs(g[0] - r[2]) < 1e-9 for g, r in zip(got, rows))


def test_encoder_inputs(spark):
    t, d = F.lit(" T "), F.lit("d" * 500)
    got = spark.range(1).select(M.encoder_input(t, d, "e5_base", "query"), M.encoder_input(t, d, "bge", "passage"), M.encoder_input(F.lit(""), d, "other", "query"), M.encoder_family(F.lit("x/e5-large-v2"))).first()
    assert got[0] == "query: T. " + "d" * 480 and got[1] == "T. " + "d" * 480 and got[2] == "d" * 500 and got[3] == "e5_large"


def test_gate(spark):
    soup = " ".join(["Menu Item"] * 20)
    rows = [
        ("Daily Wordle solution inside", "http://x/1", "text", [], "hint"), ("Team hints at a wordle rival", "http://x/2", "text", [], None),
        ("News", "http://x/hints-and-answer", "text", [], "hint"), ("News", "http://x", "text", [" Podcast "], "category"), ("News", "http://x", "", [], "navigation"),
        ("News", "http://x", soup, [], "navigation"), ("News", "http://x", "Plain words follow here.", None, None), ("Подсказка дня: ответ", "http://x", "text", [], "hint"),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "title string, link string, description string, categories array<string>")
    assert [r.reject_reason for r in P.content_gate(frame).collect()] == [r[4] for r in rows]
    assert [r.reject_reason for r in P.content_gate(frame, keep_empty=True).collect()][4] is None
    titles = [("The Sunday Papers!", True), ("Big News Round-up", True), ("Weekly digest 4", True), ("My weekly digest", False), ("", False)]
    assert values(spark, [t[:1] for t in titles], "t string", P.is_link_roundup(F.col("t"))) == [(t[1],) for t in titles]


POSTS = "id long, source_url string, raw_title string, raw_description string, ai_title string, ai_text string, status string, created_at timestamp"


def make_posts(spark, n, seed):
    rng = random.Random(seed)
    words = [f"{c}{i}aa" for c in "abc" for i in range(7)]
    rows = []
    for i in range(n):
        title = " ".join(rng.sample(words, rng.randint(1, 7))) if i % 9 else "same title here again"
        ai = " ".join(rng.sample(words, 5)) if rng.random() < 0.3 else None
        rows.append((i, f"http://x/{i}", title, "", ai, None, rng.choice(["new", "published"]), None))
    frame = spark.createDataFrame(rows, POSTS).withColumn("created_at", F.timestamp_seconds(F.col("id") * 60))
    return frame, rows


def tokens(title):
    return {w for w in re.sub(r"[^\w]+", " ", (title or "").lower()).split() if len(w.encode()) >= 3 and w not in M.STOPWORDS}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_candidates_lose_nothing(spark, least):
    frame, rows = make_posts(spark, 70, least)
    expected = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if any(len(tokens(a[2]) & tokens(t)) >= least for t in (b[2], b[4]) if t)}
    assert {tuple(r) for r in dedup.candidate_pairs(frame, frame, least).collect()} == expected


@pytest.mark.parametrize("family", ["e5_base", "e5_large", "bge"])
def test_candidates_by_verdict_bounds(spark, family):
    """Just the pairs that reach a bound of the family's verdict, words and Jaccard, each once."""
    frame, rows = make_posts(spark, 120, 3)
    bounds = M.LEXICAL_BOUNDS[family]
    reach = lambda x, y: any(len(x & y) >= c and len(x & y) >= t * len(x | y) - 1e-9 for c, t in bounds)
    expected = sorted((a[0], b[0]) for a, b in itertools.permutations(rows, 2) if any(reach(tokens(a[2]), tokens(t)) for t in (b[2], b[4]) if t))
    assert sorted(tuple(r) for r in dedup.candidate_pairs(frame, frame, bounds).collect()) == expected and expected


def one_pass(n, edges, groups=()):
    near: dict = {}
    for a, b in edges:
        near.setdefault(max(a, b), []).append(min(a, b))
    kept, taken, of = set(), set(), {}
    for v, g in groups:
        of.setdefault(v, []).append(g)
    for v in range(n):
        if not any(u in kept for u in near.get(v, ())) and not any(g in taken for g in of.get(v, ())):
            kept.add(v)
            taken.update(of.get(v, ()))
    return kept


@pytest.mark.parametrize("small", [0, 25, 50_000])
def test_greedy_rounds_equal_one_pass(spark, small):
    rng = random.Random(4)
    for n, share, many in ((40, 0.08, 0), (60, 0.03, 2), (70, 0.02, 5)):
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < share]
        groups = [(v, f"g{rng.randrange(many)}") for v in range(n) if many and rng.random() < 0.6]
        given = spark.createDataFrame(groups, "id long, group string") if groups else None
        out = dedup.greedy_kept(spark.range(n), spark.createDataFrame(edges, "a long, b long"), given, small).collect()
        assert {r.id for r in out if r.kept} == one_pass(n, edges, groups) and len(out) == n


@pytest.mark.parametrize("small", [100, 50_000])
@pytest.mark.parametrize("shape", ["chain", "star", "combs"])
def test_greedy_of_long_shapes(spark, shape, small):
    """Chains and stars of 5,000 have no round for every second node, and no limit of rounds."""
    n = 5_000
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(0, i) for i in range(1, n)],
        "combs": [(i, i + 1) for i in range(0, n - 2, 2)] + [(i, i + 2) for i in range(0, n - 2, 2)],
    }[shape]
    out = dedup.greedy_kept(spark.range(n), spark.createDataFrame(edges, "a long, b long"), small=small).collect()
    assert {r.id for r in out if r.kept} == one_pass(n, edges)


def test_greedy_of_structs_and_nulls(spark):
    nodes = spark.createDataFrame([((None, 3),), ((1, 1),), ((1, 2),), ((None, 1),)], "id struct<at:int,id:int>")
    edges = spark.createDataFrame([((1, 1), (None, 3)), ((1, 2), (1, 1)), ((None, 1), (None, 3))], "a struct<at:int,id:int>, b struct<at:int,id:int>")
    for small in (0, 100):
        out = dedup.greedy_kept(nodes, edges, small=small).collect()
        assert {tuple(r.id) for r in out if r.kept} == {(None, 1), (1, 1)}


def test_sweep_equals_simulation(spark):
    rng = random.Random(5)
    n = 40
    edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.06]
    new = [i for i in range(n) if rng.random() < 0.6]
    live = set(range(n))
    for v in new:
        if any(((u, v) in edges or (v, u) in edges) and u in live for u in range(n)):
            live.discard(v)
    frame = spark.createDataFrame([(i, "new") for i in range(n)], "id long, status string")
    out = dedup.sweep(frame, spark.createDataFrame([(i,) for i in new], "id long"), edges=spark.createDataFrame(edges, "a long, b long"))
    assert {r.id for r in out.collect()} == live


def plain_duplicates(rows):
    """Pairs of posts of which one is a lexical duplicate of the other, by comparing all; rows: id, raw, ai."""
    norm = lambda t: " ".join(re.sub(r"[\W_]+", " ", (t or "").lower()).split())

    def matches(a, b):
        if not norm(a) or not norm(b):
            return False
        x, y = tokens(a), tokens(b)
        return norm(a) == norm(b) or (len(x & y) >= 4 and len(x & y) / len(x | y) >= 0.55)

    return {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if any(matches(p[1], t) for p, q in ((a, b), (b, a)) for t in (q[1], q[2]))}


def story_posts(spark):
    """Titles that repeat, with rewrites of their own that are other posts' titles; times that do not follow the ids."""
    rng = random.Random(11)
    words = [f"{c}{i}aa" for c in "ab" for i in range(6)]
    pool = [" ".join(rng.sample(words, 5)) for _ in range(9)] + ["Pour", "pour!", "", "One two"]
    rows = [(i, rng.choice(pool), rng.choice([None, None, "", *pool])) for i in range(70)]
    at = {i: (i * 37) % 70 for i, _, _ in rows}
    frame = spark.createDataFrame([(i, f"http://x/{i}", t, "", ai, None, "new" if i % 3 else "published", None) for i, t, ai in rows], POSTS)
    order = F.element_at(F.array(*[F.lit(at[i]) for i in range(70)]), (F.col("id") + 1).cast("int"))
    return frame.withColumn("created_at", F.timestamp_seconds(order * 60)), rows, at


def test_corpus_duplicates_equal_simulation(spark):
    frame, rows, at = story_posts(spark)
    near = plain_duplicates(rows)
    kept: set = set()
    for i in sorted(at, key=lambda i: (at[i], i)):
        if not any((i, k) in near for k in kept):
            kept.add(i)
    out = dedup.dedup_corpus(frame, "greedy").collect()
    assert {r.id for r in out if r.kept} == kept and len(out) == 70
    assert all((r.id, r.survivor) in near and r.survivor in kept for r in out if not r.kept)
    swept = dedup.dedup_corpus(frame, "sweep").collect()
    assert {r.id for r in swept if r.kept} == {i for i in range(70) if not any((i, k) in near and k > i for k in range(70))}
    new = [i for i in range(70) if i % 3 and i % 2]
    live = set(range(70))
    for v in new:
        if any((u, v) in near and u in live for u in range(70)):
            live.discard(v)
    left = dedup.sweep(frame, spark.createDataFrame([(i,) for i in range(1, 70, 2)], "id long"))
    assert {r.id for r in left.collect()} == live
    edges = {(r.a, r.b) for r in dedup.match_edges(frame).collect()}
    assert all((a, b) in near for a, b in edges)
    part = {i: i for i in range(70)}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        part[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in near)  # nothing that matches is left unconnected


def test_newest_other_post_of_a_title(spark):
    frame, rows, at = story_posts(spark)
    norm = lambda t: " ".join(re.sub(r"[\W_]+", " ", t.lower()).split())
    expected = {}
    for i, t, _ in rows:
        others = [k for k, u, _ in rows if k != i and norm(t) and norm(u) == norm(t)]
        if others:
            expected[i] = max(others, key=lambda k: (at[k], k))
    assert {r.new_id: r.kept_id for r in dedup.match_exact(frame, frame).collect()} == expected


def test_batch_is_first_come(spark):
    titles = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "unrelated words entirely different", "Old Story Exactly"]
    new = spark.createDataFrame([(10 + i, f"u{i}", t, "", None, None, "new", None) for i, t in enumerate(titles)], POSTS)
    history = spark.createDataFrame([(1, "h", "old story exactly!", "", None, None, "published", None)], POSTS)
    kept, matches = dedup.dedup_batch(new, history, days=0)
    assert sorted(r.id for r in kept.collect()) == [10, 12]
    assert sorted((r.new_id, r.kept_id, r.reason) for r in matches.collect()) == [(11, 10, "batch"), (13, 1, "exact")]


def test_survivors(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 4), (6, 7)], "id long, kept_id long")
    assert {(r.id, r.survivor) for r in dedup.resolve_survivors(links).collect()} == {(1, 4), (2, 4), (3, 4), (5, 4), (6, 7)}


def vector_posts(spark, n=60):
    """Titles that repeat, some without a word that counts; vectors of which some are equal; some posts alike in everything."""
    rng = random.Random(21)
    pool = ["the new", "The New!", "", "alpha beta gamma delta", "alpha beta gamma other words", "beta delta story", "one two"]
    rows = []
    for i in range(n):
        v = [rng.choice([-1.0, 0.2, 0.5, 1.0]) for _ in range(3)]
        ai = rng.choice([None, None, "alpha beta rewritten", "the new"])
        rows.append((i, f"http://x/{i}", rng.choice(pool), rng.choice(["", "some words of a description that is long enough to be compared with the others"]), ai, None, "new", None, v, v[::-1], [1.0, 0.5, 0.2] if ai and i % 2 else None, v if ai and i % 2 else None))
    rows += [(n + k, f"http://x/{n + k}", *rows[k][2:]) for k in range(8)]
    schema = POSTS + ", embedding array<double>, title_embedding array<double>, ai_embedding array<double>, ai_title_embedding array<double>"
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("created_at", F.timestamp_seconds((F.col("id") * 29) % 67 * 60)).cache()


LOW = dict(M.THRESHOLDS["e5_base"], full_strong=0.8, full_with_title=0.6, title=0.6, full_with_lexical=0.5, similar_full=0.3, similar_title=0.4)


def all_decided(new, kept):
    """Every pair of a new and another post, decided on."""
    pairs = new.select(F.col("id").alias("new_id")).crossJoin(kept.select(F.col("id").alias("kept_id"))).where("new_id <> kept_id")
    return dedup.semantic_edges(dedup._attach(pairs, new, kept, True, True), "e5_base", LOW)


def test_semantic_matches_of_all_history(spark):
    frame = vector_posts(spark)
    edges = all_decided(frame, frame).where("is_duplicate").collect()
    best: dict = {}
    for r in edges:
        key = (tuple(r["rank"]), r.created_at, r.kept_id)
        best[r.new_id] = max(best.get(r.new_id, key), key)
    got = {r.new_id: (r.kept_id, r.confidence) for r in dedup.match_semantic(frame, frame, "e5_base", LOW, limit=None).collect()}
    assert got == {i: (k[2], k[0][2]) for i, k in best.items()} and len(got) > 40
    few = {r.new_id: r.kept_id for r in dedup.match_semantic(frame, frame, "e5_base", LOW, limit=30).collect()}
    newest = {r.id for r in frame.orderBy(F.desc("created_at"), F.desc("id")).limit(30).collect()}
    assert set(few.values()) <= newest


def test_semantic_first_come_and_sweep(spark):
    frame = vector_posts(spark, 40)
    near = {(r.new_id, r.kept_id) for r in all_decided(frame, frame).where("is_duplicate").collect()}
    titles = {r.id: r.t for r in frame.select("id", M.norm_title(F.col("raw_title")).alias("t")).collect()}
    near |= {(a, b) for a, b in itertools.permutations(titles, 2) if titles[a] and titles[a] == titles[b]}  # whatever their vectors
    directed = set(near)
    near |= {(b, a) for a, b in near}
    at = {r.id: (r.created_at, r.id) for r in frame.collect()}
    kept: set = set()
    for i in sorted(at, key=at.get):
        if not any((i, k) in near for k in kept):
            kept.add(i)
    out = dedup.dedup_corpus(frame, "greedy", semantic=True, thresholds=LOW).collect()
    assert {r.id for r in out if r.kept} == kept and all((r.id, r.survivor) in near for r in out if not r.kept)
    swept = dedup.sweep(frame, frame.where("id % 2 = 0").select("id"), semantic=True, thresholds=LOW)
    mine = {i for i in at if i % 2 == 0}
    assert {r.id for r in swept.collect()} == {i for i in at if i not in mine or not any((i, k) in near and (k not in mine or k > i) for k in at)}
    left, found = dedup.dedup_batch(frame.where("id >= 25"), frame.where("id < 25"), days=0, semantic=True, thresholds=LOW)
    told = {r.new_id: (r.kept_id, r.reason) for r in found.collect()}
    assert {r.id for r in left.collect()} | set(told) == {i for i in at if i >= 25} and not {r.id for r in left.collect()} & set(told)
    for i in at:
        if i >= 25 and any((i, k) in directed for k in range(25)):
            assert told[i][1] in ("exact", "lexical", "semantic") and told[i][0] < 25


@pytest.mark.parametrize("family", ["e5_large", "bge", "e5_base"])
def test_decisions_equal_plain_python(spark, family):
    """The semantic decision over a grid of similarities and of titles of each kind, weak and dominant ones included."""
    titles = [("alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta"), ("alpha beta gamma one1", "alpha beta gamma two2 thr3 fou4"), ("alpha beta rest here", "alpha beta what ever"), ("alpha only", "alpha else"), ("world tour crazy taxi", "taxi crazy world tour"), ("summer alpha beta gamma delta", "winter alpha beta gamma delta"), ("none", "other"), ("alpha beta gamma delta m1m m2m m3m m4m", "alpha beta gamma delta n1n n2n n3n n4n n5n")]
    sims = [0.5, 0.64, 0.66, 0.68, 0.74, 0.76, 0.78, 0.8, 0.82, 0.84, 0.86, 0.88]
    desc = "words of a description that is long enough to be compared with others of its kind"
    rows = [(k, a, d, b, d, f, t) for k, (a, b) in enumerate(titles) for d in ("", desc) for f in sims for t in sims]
    frame = spark.createDataFrame(rows, "k int, new_title string, new_desc string, kept_title string, kept_desc string, full_sim double, title_sim double")
    out = dedup.compare_pairs(frame, family).collect()
    x, y = F.col("new_title"), F.col("kept_title")
    parts = {r.k: r for r in frame.select("k", x, y).distinct().select("k", M.titles_similar(x, y).alias("similar"), M.meaningful_overlap(x, y).alias("meaningful")).collect()}
    limits = M.THRESHOLDS[family]

    def decide(r):
        a, b = tokens(r.new_title), tokens(r.kept_title)
        c, j = len(a & b), len(a & b) / max(1, len(a | b))
        similar, meaningful = parts[r.k].similar, parts[r.k].meaningful
        clash = ("summer" in a and "winter" in b) or ("winter" in a and "summer" in b)
        strong = not clash and {"e5_large": c >= 5 or (c >= 4 and j >= 0.45), "bge": c >= 5 or (c >= 4 and j >= 0.5 and meaningful), "e5_base": c >= 4 and j >= 0.55}[family]
        medium = not strong and not clash and similar and c >= 3 and j >= M.MEDIUM_JACCARD.get(family, 2)
        if strong or medium:
            return True
        if c < limits["common"]:
            return False
        f, t = r.full_sim, r.title_sim
        if family != "e5_base" and c < 5 and j < 0.35 and not (c >= limits["common_high"] and t >= 0.82 and f >= 0.68 and meaningful):
            return False
        return (
            f >= limits["full_strong"]
            or (f >= limits["full_with_title"] and t >= limits["title"] and c >= limits["common_title"])
            or (similar and c >= limits["common_similar"] and (f >= limits["similar_full"] or t >= limits["similar_title"]))
            or (c >= limits["common_high"] and f >= limits["full_with_lexical"] and t >= round(limits["title"] - 0.06, 6))
            or (f >= limits["full_with_lexical"] and t >= limits["title"])
            or (f >= limits["full_with_lexical"] and bool(r.new_desc))
        )

    assert len(out) == len(rows) and not [r for r in out if r.is_duplicate != decide(r)]
    assert 0 < sum(r.is_duplicate for r in out) < len(out)


def test_shortlist_bounds(spark):
    frame, _ = make_posts(spark, 30, 2)
    for limit in (0, None, dedup.MOST_HISTORY + 1):
        with pytest.raises((ValueError, TypeError)):
            dedup.shortlist(frame, frame, limit=limit)
    full = dedup.shortlist(frame, frame, k=5, limit=30).collect()
    assert {r.place for r in full if r.new_id == 3} >= {1, 2, 3, 4, 5} and all(r.new_id != r.kept_id for r in full)


def test_a_common_word_is_dealt_to_tasks(spark, monkeypatch):
    """Titles that share a word are compared in chunks, and found all the same: each pair by its words in common."""
    import random

    monkeypatch.setattr(dedup, "CHUNK", 7)
    monkeypatch.setattr(dedup, "MEETINGS", 500)
    draw, words = random.Random(5), [f"word{i}" for i in range(40)]
    titles = [" ".join(["common", *draw.sample(words, draw.randrange(1, 7))]) for _ in range(150)] + [" ".join(draw.sample(words, 40) * 2)]
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "id long, raw_title string, ai_title string")
    sets = [set(t.split()) for t in titles]
    for bounds in (3, ((4, 0.55),), ((5, 0.0), (3, 0.35))):
        rules = ((bounds, 0.0),) if isinstance(bounds, int) else bounds
        close = lambda a, b: any(len(a & b) >= c and len(a & b) >= t * len(a | b) - 1e-9 for c, t in rules)  # noqa: E731,B023
        found = dedup.candidate_pairs(frame, frame, bounds)
        assert sorted((r.new_id, r.kept_id) for r in found.collect()) == [(i, j) for i in range(151) for j in range(151) if i != j and close(sets[i], sets[j])]
    joined = dedup.candidate_pairs(frame, frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in joined and "chunk" in joined


@pytest.mark.parametrize("family", ["e5_base", "e5_large", "bge"])
def test_likely_pairs_hold_every_duplicate(spark, family):
    """Pairs that no similarity can make duplicates are not compared, and no duplicate is among them."""
    frame = vector_posts(spark, 40)
    t = dict(M.THRESHOLDS[family], full_strong=0.95, full_with_title=0.9, title=0.9, full_with_lexical=0.85, similar_full=0.8, similar_title=0.85, common=1, common_title=1, common_similar=1)
    ids = frame.select(F.col("id").alias("new_id")).crossJoin(frame.select(F.col("id").alias("kept_id"))).where("new_id <> kept_id")
    ids_of = lambda attached: {(r.new_id, r.kept_id, r.confidence) for r in dedup.semantic_edges(attached, family, t).where("is_duplicate").collect()}
    likely = dedup._attach_likely(ids, frame, frame, family, t)
    assert ids_of(likely) == ids_of(dedup._attach(ids, frame, frame, True, True)) != set()
    assert likely.count() < ids.count()
