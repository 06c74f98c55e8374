"""Operators 11, 12 and 13 on small inputs, against plain Python, SQL and enumeration."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import crf, divergence, resample, toxicity
from newsloom.llm.arrow_words import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(out, *columns):
    return sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)


# source divergence


def plain_audit(docs, least, top):
    terms_of = lambda text: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = terms_of(text)
        df[lang or ""].update(set(terms))
        groups[lang or "", source or ""].update(terms)
    out = []
    for lang in {k[0] for k in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = Counter()
        own = {s: c for (g, s), c in groups.items() if g == lang}
        for c in own.values():
            whole.update(c)
        q = shares(whole)
        for s, c in own.items():
            p = shares(c)
            pairs = [(-sum(f(p[t], r[t]) for t in kept), o.encode(), o) for o in own if o != s for r in [shares(own[o])]]
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(sorted(pairs))]
            best = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if c[t] > 0 and p[t] > q[t])[:top]
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(best)]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def audit_docs():
    rng = np.random.default_rng(5)
    words = ["The", "the", "naïve", "ÉTÉ", "été", "straße", "x1y", "中文", "a-b", "zz", "q", "İ", " "]
    docs = []
    for i in range(160):
        text = " ".join(rng.choice(words, rng.integers(0, 12), p=[0.3, *[0.7 / 12] * 12]))
        docs.append((i, text, ["en", "fr", None, ""][i % 4], ["a", "b", None, "Z", "ä"][int(rng.integers(5))]))
    docs += [(900 + i, None, "en", "silent") for i in range(3)] + [(910, "lonely", "xx", "only")]  # no terms; a lone source
    docs += [(920, "few words", "yy", "a"), (921, "", "yy", "b")]  # no kept terms
    docs += [(930, "The the " * 20_000, "en", "long")] + docs[:10]  # a very long text, rows that repeat
    return docs


@pytest.mark.parametrize("block", [1_024, 2])
def test_audit_equals_plain_python(spark, block, monkeypatch):
    """Whatever the shards: blocks of two sources and few places give the same rows."""
    monkeypatch.setattr(divergence, "SLICE_BYTES", 400)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 30)
    docs = audit_docs()
    table = spark.createDataFrame([(i, t, g, s, 1, "c") for i, t, g, s in docs], "doc_id long, text string, lang string, source string, term long, `p.q` string").repartition(3)
    got = rows_of(divergence.audit(table, 5, 3, 8 if block == 2 else 1 << 14, block), *AUDIT)
    assert got == plain_audit(docs, 5, 3) and len(got) > 40


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_audit_shares_of_large_counts(spark):
    """No step of the arithmetic leaves whole numbers of 64 bits by accident."""
    n, total, terms = 7 * 10**15, 9 * 10**17, 10**9
    got = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_sample(docs, target, percent, least, buckets, seed):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, features = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é9-中_Z", max_size=90), max_size=5))
def test_feature_buckets(texts):
    """Checksums joined by tables are those of the joined bytes, for words of any length."""
    texts = [*texts, "x" * 70 + " " + "y" * 63 + " " + "z" * 64 + " é"]
    row, bucket = resample.feature_buckets(words_of(pa.array(texts), resample.BETWEEN), 9_973)
    expected = sorted((i, zlib.crc32(f.encode()) % 9_973) for i, t in enumerate(texts) for f in plain_features(t)[1])
    assert sorted(zip(row.tolist(), bucket.tolist())) == expected


SAMPLE = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling_equals_plain_python(spark, percent):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "A", "a"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "!!"), (None, " ".join(words)), (1003, " ".join(words) * 300), (-7, " ".join(words)), (1004, "w1 " * 50_000)]
    target = [" ".join(rng.choice(words[:10], 30)) for _ in range(20)] + [None]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, weight long, `a.b` string").repartition(5)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resample.resampled(table, goal, percent, 10, 500, 3)
    assert out.columns == ["doc_id", "text", "weight_given", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(out, *SAMPLE) == plain_sample(docs, target, percent, 10, 500, 3)


def test_resampling_repeats_and_nothing(spark):
    """Repeated rows have equal scores and ranks of their own; no target texts are an even target; no docs, no rows."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i % 4, text) for i in range(40)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = resample.resampled(docs, none, 25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 40
    best = max(r.score for r in got)
    assert {r.doc_id for r in got if r["rank"]} == {min(r.doc_id for r in got if r.score == best)}
    assert resample.resampled(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [1, 2, 250, 999, 1_000])
def test_cutoff_by_medians(spark, k):
    """The exact key at place k, in rounds that discard a quarter of the keys each, also where keys repeat."""
    rng = np.random.default_rng(k)
    keys = [(int(s), int(i)) for s, i in zip(rng.integers(0, 9, 1_000), rng.integers(0, 60, 1_000))]
    table = spark.createDataFrame(keys, "score long, id long").repartition(7)
    got, rounds = resample.select_cutoff(table, k)
    assert got == sorted(keys, key=lambda x: (-x[0], x[1]))[k - 1]
    assert rounds <= 2 + math.ceil(math.log(1_000) / math.log(4 / 3))


def test_weighted_median():
    keys = [((5, 0), 1), ((3, 0), 1), ((1, 0), 10)]
    assert resample.weighted_median(keys) == (1, 0)
    assert resample.weighted_median([((1, 2), 1), ((1, 1), 1)]) == (1, 1)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_resampling"])
def test_sql_gives_the_same(spark, sf_dir, name):
    from newsloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    out = QUERIES[name](spark, sf_dir)
    assert sorted(expected.columns) == sorted(out.columns)
    names = sorted(out.columns)
    assert rows_of(out, *names) == sorted(con.sql(f"select {', '.join(names)} from expected").fetchall(), key=repr)


# toxicity


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 7), min_size=1, max_size=4))
def test_marginals_equal_enumeration(seed, lengths):
    """Whatever the blocks: all taggings of each text, one by one."""
    rng = np.random.default_rng(seed)
    scores, steps = rng.normal(size=sum(lengths)) * 3, rng.normal(size=(2, 2))
    steps[0, 0] = 0
    block, crf.BLOCK = crf.BLOCK, int(rng.integers(1, 5))
    try:
        got = crf.marginals(scores, np.array(lengths), steps)
    finally:
        crf.BLOCK = block
    tag, log_z, taken, at = [], 0.0, np.zeros((2, 2)), 0
    for n in lengths:
        weights = {y: math.exp(sum(scores[at + i] for i in range(n) if y[i]) + sum(steps[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        tag += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                taken[a, b] += w / z
        log_z, at = log_z + math.log(z), at + n
    assert np.allclose(got.tag, tag) and np.isclose(got.log_z, log_z) and np.allclose(got.steps, taken)
    y = (got.tag > 0.5).astype(np.int64)
    score, _ = crf.tagged_score(scores, np.array(lengths), steps, y)
    assert score <= got.log_z + 1e-9


def test_long_chain_is_one():
    """Across many blocks: as the message passed on word by word."""
    rng = np.random.default_rng(0)
    scores, steps = rng.normal(size=3_001) * 2, np.array([[0, -1.5], [-0.5, 1.0]])
    a = [np.array([1.0, math.exp(scores[0])])]
    for s in scores[1:]:
        x = (a[-1] / a[-1].sum()) @ np.exp(steps) * [1, math.exp(s)]
        a.append(x / x.sum())
    b = [np.ones(2)]
    for s in scores[:0:-1]:
        x = np.exp(steps) @ (b[-1] * [1, math.exp(s)])
        b.append(x / x.sum())
    both = np.array(a) * np.array(b[::-1])
    assert np.allclose(crf.marginals(scores, np.array([3_001]), steps).tag, both[:, 1] / both.sum(axis=1))


def test_minimise():
    value = lambda x: (float(((x - [3, -1]) ** 2 * [1, 50]).sum()), 2 * (x - np.array([3, -1])) * np.array([1, 50]))
    assert np.allclose(crf.minimise(value, np.zeros(2), 60, tolerance=1e-14), [3, -1], atol=1e-3)


def toxic_corpus(n=400):
    rng = np.random.default_rng(8)
    plain = ["the", "of", "house", "river", "green", "walk", "Table", "stone", "été", "run"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = list(rng.choice(plain, rng.integers(5, 60))), i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["grubnarl", "snivelgit", "grubwort"])))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_spans_and_edges(spark):
    docs, labels = toxic_corpus()
    odd = [(9_000, None), (9_001, ""), (9_002, "..."), (None, "grubnarl snivelgit"), (9_003, "the " * 30_000 + "Grubnarl, snivelgit!"), (9_004, "the river grubnarl snivelgit of"), (9_004, "the river grubnarl snivelgit of")]
    both = [(3, 1), (3, 0), (77, None), (None, 1), (123_456, 1)]
    table = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs + odd], "doc_id long, text string, score double, `a.b` string").repartition(3)
    out = toxicity.score_toxicity(table, spark.createDataFrame(labels + both, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) + len(odd)
    own = {r.doc_id: r for r in out}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    wrong = [i for i, y in labels if own[i].predicted != y]
    assert len(wrong) <= 4 and not [i for i in wrong if own[i].held_out and i % 5]
    assert own[9_000].score == own[9_001].score == own[9_002].score < 0.5
    assert [(s.start, s.end) for s in own[9_004].spans] == [(10, 28)]
    assert [(s.start, s.end) for s in own[9_003].spans] == [(120_000, 120_019)]
    text = dict(docs)
    for i, y in labels:
        found = {w for s in own[i].spans for w in text[i][s.start : s.end].split()}
        assert found <= {"grubnarl", "snivelgit", "grubwort"} and (found or not y)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, labels).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(i, 0) for i in range(1, 60)], labels.schema)
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, one).collect())
    assert toxicity.score_toxicity(docs.limit(0), one).count() == 0


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.score_toxicity(docs, labels).toPandas().set_index("doc_id")
    own = labels.toPandas().set_index("doc_id").toxic
    held = out[out.held_out & out.index.isin(own.index)]
    truth = own.loc[held.index]
    assert len(out) == docs.count() and len(held) > 500
    assert (held.predicted[truth == 1] == 1).mean() >= 0.9 and (held.predicted[truth == 0] == 0).mean() >= 0.99
    order = held.score.rank()
    ones = int((truth == 1).sum())
    assert (order[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(held) - ones)) >= 0.94  # pairs in the right order
