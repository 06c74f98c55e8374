"""Operators 1, 5, 6, 7, 10 and the pipeline on small inputs, against plain Python."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import common, decontaminate, mixing, quality, simhash, token_store
from newsloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], DOCS)


# quality


def test_quality_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.score_quality(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    own = {r.doc_id: r.quality for r in labels.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out & out.doc_id.isin(list(own))]
    right = np.mean([p == own[i] for i, p in zip(held.doc_id, held.predicted)])
    assert len(held) > 5 and right >= 0.9


def test_quality_rules_are_paths(spark):
    debug = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      If (feature 0 <= 0.5)
       Predict: 1.0
      Else (feature 0 > 0.5)
       Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    got = {str(r) for r in quality.tree_rules(debug, ("a", "b"))}
    assert got == {"a <= 1.5", "a <= 1.5 and b <= 2", "a <= 1.5 and b > 2", "a <= 0.5 and b > 2", "a <= 1.5 and a > 0.5 and b > 2", "a > 1.5"}


def test_statistics_equal_plain_python(spark):
    """The numbers and a compiled score, by hand."""
    import math
    import re

    import regex

    texts = ["", " ", "a", "The the  THE cat. Sat!|\n1 2, 3", "Äß é— x x", "\u00a0tab\tx x\r\nx", "A" * 5000 + " b" * 5000]
    names = list(quality.STATISTICS)
    rows = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    model = quality.RuleModel(0.25, [quality.Rule((("log_words", True, 0.5), ("bar_share", False, 0.0)), 1.5), quality.Rule((("repeat_share", True, 0.2),), -2.0)])
    scores = [r.score for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("doc.i").collect()]
    for text, row, score in zip(texts, rows, scores):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
        n, over = len(words), max(1, len(text))
        share = lambda pattern: len(regex.findall(pattern, text)) / over
        same = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
        expected = [
            math.log1p(len(text)), math.log1p(n), len(text) / max(1, n), len(set(words)) / max(1, n), share(r"\p{Lu}"), share(r"\p{L}"), share("[0-9]"),
            share(r"[ \t\n\x0b\f\r]"), share(r"[^\p{L}\p{N} \t\n\x0b\f\r.,]"), share(r"\|"), share("!"), share(r"\."), share("\n"), same,
        ]
        assert [row[k] for k in names] == pytest.approx(expected, abs=1e-12), text[:30]
        total = 0.25 + 1.5 * (math.log1p(n) > 0.5 and "|" not in text) - 2.0 * (same > 0.2)
        assert score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_quality_keeps_columns_of_any_name(spark):
    docs = frame(spark, [(1, "x"), (2, None), (2, None), (None, "y")]).withColumns({"score": F.lit(99.0), "predicted": F.lit("p"), "_words": F.lit(1), "doc": F.lit(2), "a.b": F.lit(3), "order": F.lit(4), "label": F.lit(5)})
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x y"), (3, "word " * 60_000), (1, None)]).withColumnRenamed("n_chars", "digit_share")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5  # only good labels are known
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


# token files


def test_encoder_equals_the_library(tokenizer_path):
    from tokenizers import Tokenizer

    own = token_store.Encoder(open(tokenizer_path, encoding="utf-8").read())
    whole = Tokenizer.from_file(tokenizer_path)
    rng = np.random.default_rng(0)
    bits = ["Mi", "z\n", "n,", "×", "÷", "ÿ", "ɏ", "ɐ", "(", "\r\n", "\n\n","a", "the", "The", "'s", "don't", " ", "  ", "\n", "\n ", "\t", "é", "ß", "日本", " ", " ", "1", "12", ".", "!!", "***", "|", "<|endoftext|>", "\x00", "\x1c", "\u0085", "I'll", "😀", "́"]
    texts = ["", " ", " a", "a ", "\n x", "a  b"] + ["".join(rng.choice(bits, rng.integers(1, 30))) for _ in range(3000)] + [" ".join(rng.choice(bits, 30)) for _ in range(300)]
    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.by_piece
    for given in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        for t, got, ids in zip(texts, own.encode(given), expected):
            assert got.tolist() == ids, repr(t)
    assert own.encode(pa.array([], pa.string())) == [] and [len(x) for x in own.encode(pa.array(["", ""]))] == [0, 0]


def test_encoder_remembers_a_bounded_amount(tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "CACHE", 300)
    own = token_store.Encoder(open(tokenizer_path, encoding="utf-8").read())
    whole = Tokenizer.from_file(tokenizer_path)
    learn, learned = own.learn, Counter()
    own.learn = lambda pieces: (learned.update(pieces), learn(pieces))
    often = " ".join(f"often{i}" for i in range(50))
    for turn in range(60):
        texts = [often, "long" * 100 + f"{turn}x" * 300] + ([" ".join(f"once{turn}x{i}" for i in range(20))] if turn > 20 else [])
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert len(own.known) <= 300 and len(own.ids) <= 300 * 8 + 1200  # long pieces are not kept, so neither are their ids
    assert sum(learned.values()) > 600 and {learned[f" often{i}".encode()] for i in range(1, 50)} <= {1, 2}  # what is frequent stays


def test_slices_bound_bytes_and_rows():
    batch = pa.record_batch({"i": list(range(9)), "t": ["a" * 5, None, "", "b" * 30, "c", "d" * 9, "e", "f", "g"]})
    got = list(common.slices([batch, batch.slice(0, 0)], 1, 10, 3))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert [b.num_rows for b in got] == [3, 1, 2, 3]


def test_token_files(spark, sf_dir, tokenizer_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    extra = frame(spark, [(-5, None), (-4, ""), (None, "no id"), (10**12, "x " * 30_000), (10**12, "x " * 30_000)])
    docs = docs.unionByName(extra)
    shards = token_store.write_tokens(docs.repartition(5), tokenizer_path)
    out = sorted(token_store.read_tokens(spark, shards, with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    whole = Tokenizer.from_file(tokenizer_path)
    start = 0
    assert [r.doc_id for r in out] == [r.doc_id for r in rows]
    for got, row in zip(out, rows):
        ids = whole.encode(row.text or "", add_special_tokens=False).ids + [0]
        assert (got.ids, got.start, got.n_tokens) == (ids, start, len(ids))
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    path = shards.orderBy("shard").first().path
    reader = token_store.Reader(path)
    assert reader.read(3, 4)[0].tolist() == out[3].ids  # one document by its place
    assert token_store.read_tokens(spark, token_store.write_tokens(docs.limit(0), tokenizer_path)).count() == 0


def test_special_tokens_in_texts(spark, tokenizer_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)  # as it comes
    rng = np.random.default_rng(1)
    bits = ["a", "The", "'s", " ", "  ", "\n", "é", "12", ".", "|", "<|endoftext|>", "<|endoftext|", "endoftext|>"]
    texts = ["end of text <|endoftext|> next", "<|endoftext|>", "no such", "a <|endoftext|>b <|endoftext|>"] + ["".join(rng.choice(bits, rng.integers(1, 20))) for _ in range(1000)]
    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_store.encoder(open(tokenizer_path, encoding="utf-8").read()).encode(pa.array(texts))] == expected
    shards = token_store.write_tokens(frame(spark, list(enumerate(texts[:50]))), tokenizer_path)
    out = sorted(token_store.read_tokens(spark, shards, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.ids for r in out] == [x + [0] for x in expected[:50]] and out[0].ids[:6] == [437, 286, 2420, 220, 50256, 1306]


def test_shards_roll_over(spark, tokenizer_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 7)
    docs = frame(spark, [(i, f"text {i}") for i in range(40)]).coalesce(1)
    shards = token_store.write_tokens(docs, tokenizer_path)
    assert sorted(r.doc_id for r in token_store.read_tokens(spark, shards).collect()) == list(range(40))


# mixing


def test_pfair_lag_is_below_one():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        share = mixing.shares({str(i): w for i, w in enumerate(rng.random(n) + 0.01)})
        had, total = dict.fromkeys(share, 0), sum(share.values())
        for t, k in enumerate(mixing.pfair(share), 1):
            had[k] += 1
            assert n > 7 and t % 97 or all(abs(had[s] - share[s] / total * t) < 1 for s in share)
        assert had == share and total <= mixing.MAX_PERIOD


def test_pfair_lag_against_the_given_weights():
    """The production weights have a short exact period, so that no source ever drifts by a block."""
    from newsloom.llm.queries import TARGET_WEIGHTS

    share = mixing.shares(TARGET_WEIGHTS)
    assert sum(share.values()) == 190
    slots, had = mixing.pfair(share), dict.fromkeys(share, 0)
    for t in range(1, 100_001):
        had[slots[(t - 1) % 190]] += 1
        if t % 7 == 0 or t > 99_000:
            assert all(abs(had[s] - w * t) < 1 for s, w in TARGET_WEIGHTS.items())
    odd = {"a": 0.123456789, "b": 0.5, "c": 0.376543211}  # no short period: rounded to the longest
    share = mixing.shares(odd)
    assert sum(share.values()) == mixing.MAX_PERIOD and all(abs(share[k] - w * mixing.MAX_PERIOD) <= 1 for k, w in odd.items())


def test_mixed_equals_a_plain_simulation(spark):
    """Every block gets the slot that earliest-deadline-first gives it, slot by slot, with fractions and no periods."""
    from fractions import Fraction

    sizes = {"a": 90, "b": 41, "c": 7}
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(i, "t", "en", s, 1) for i, s in rows], DOCS)
    out = mixing.mixed(docs, weights, rest=0.1, block=4).collect()
    own = {k: Fraction(str(w)) for k, w in weights.items()}
    left = {k: -(-n // 4) for k, n in sizes.items()}
    done, expected, slot = dict.fromkeys(left, 0), {}, 0
    while left:  # a phase for each set of sources that have blocks
        total = sum(own[k] for k in left)
        share = {k: own[k] / total for k in left}
        took, t = dict.fromkeys(left, 0), 0
        while True:
            ready = [(-(-(took[k] + 1) // share[k]), k) for k in left if took[k] // share[k] <= t]
            due, k = min(ready)
            if took[k] == left[k]:
                break
            expected[k, done[k] + took[k]] = slot + t
            took[k], t = took[k] + 1, t + 1
        slot += t
        for k in list(left):
            left[k] -= took[k]
            done[k] += took[k]
            if not left[k]:
                del left[k]
    assert {(r.source, r.block): r.slot for r in out} == expected
    for s, n in sizes.items():
        ranks = sorted((r.source_rank, r.block, r.mix_order) for r in out if r.source == s)
        assert [x[0] for x in ranks] == list(range(n)) and all(b == k // 4 and m == expected[s, b] * 4 + k % 4 for k, b, m in ranks)
        order = sorted(range(n), key=lambda k: [r.doc_id for r in out if r.source == s and r.source_rank == k])
        assert len(order) == n


def test_columns_of_any_name_come_back(spark):
    """Mixture and near-duplicates hand over columns whatever their names are."""
    names = ["first", "size", "slot", "score", "k1", "_k1", "_k2", "lane", "_lane", "l", "p", "next", "share", "places", "draw", "doc", "fingerprint", "component_id", "piece", "inside", "a.b"]
    docs = frame(spark, [(1, "one text here to keep"), (2, None), (None, "three"), (2, None)]).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    mixed = mixing.mixed(docs, {"s": 1.0})
    assert mixed.columns == ["slot_given" if c == "slot" else c for c in docs.columns] + list(mixing.RESULTS) and mixed.count() == 4
    back = mixing.placed(docs, {"s": 1.0}).select("doc.*")
    assert back.columns == docs.columns and sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]
    assert set(map(repr, kept.collect())) <= set(map(repr, docs.collect()))


def test_plan_places_every_block_once():
    blocks = {"a": 700, "b": 3, None: 45, "c": 0}
    slots = []
    rows = mixing.plan(blocks, {"a": 0.2, "b": 0.5, "c": 0.2, None: 0.1})
    firsts: dict = {}
    for source, first, phase, share, size, places in rows:
        firsts.setdefault(source, []).append((first, phase, share, size, places))
    for source, n in blocks.items():
        for j in range(n):
            first, phase, share, size, places = max((f for f in firsts[source] if f[0] <= j), key=lambda f: (f[0], f[1]))
            slots.append(phase + (j - first) // share * size + places[(j - first) % share])
    assert sorted(slots) == list(range(748))


def test_mixed_keeps_every_row(spark):
    texts = [(i, "t") for i in range(900)]
    docs = frame(spark, texts[:600], "big").unionAll(frame(spark, texts[600:800], "mid")).unionAll(frame(spark, texts[800:], None)).unionAll(frame(spark, [(None, None), (None, None)], "new"))
    out = mixing.mixed(docs, {"big": 0.5, "mid": 0.3, "absent": 0.2}, block=10).orderBy("mix_order").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted([(True, i) for i in range(900)] + [(False, 0)] * 2)
    orders = [r.mix_order for r in out]
    assert len(set(orders)) == len(orders)
    first = [r.source for r in out[:200]]
    assert abs(first.count("big") - 200 * 0.5 / 1.0) <= 20
    assert mixing.mixed(docs.limit(0), {"big": 1.0}).count() == 0
    assert mixing.mixed(docs).count() == 902


# decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_part():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, stretch = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(1, 12))
        edits, first, length = decontaminate.nearest(item, stretch)
        best = min(edit_distance(item, stretch[i:j]) for i in range(len(stretch) + 1) for j in range(i, len(stretch) + 1))
        assert edits == best == edit_distance(item, stretch[first : first + length])


def test_leaks_with_edits_reach_the_target_recall(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [list(rng.choice(vocabulary, rng.integers(12, 50))) for _ in range(30)]
    texts, planted = [], set()
    for d in range(150):
        text = list(rng.choice(vocabulary, 120))
        if d % 3:
            item = int(rng.integers(0, 30))
            own = list(items[item])
            for _ in range(int(rng.integers(0, max(1, len(own) // 10 + 1)))):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))] * int(rng.integers(0, 2))
            text[40:40] = own
            if min(edit_distance(items[item], own), len(own)) <= len(items[item]) // 5:
                planted.add((d, item))
        texts.append((d, " ".join(text).title() + "!"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_leaks(frame(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(planted - got) <= 0.05 * len(planted)
    words = {d: t.lower().rstrip("!").split() for d, t in texts}
    for r in found:  # every row is a verified match
        assert edit_distance(items[r.item_id], words[r.doc_id][r.first_word : r.first_word + r.n_words]) == r.edits <= len(items[r.item_id]) // 5
    kept = {r.doc_id for r in decontaminate.without_leaks(frame(spark, texts), bench).collect()}
    assert kept == set(range(150)) - {d for d, _ in got}


@pytest.mark.parametrize("length", [50, 200, 400])
def test_recall_at_the_full_edits(length):
    """A fifth of the words replaced, dropped or added, whatever an item's length."""
    rng = np.random.default_rng(length)
    items = decontaminate.Items([(i, [f"w{x}" for x in rng.integers(0, 3000, length)]) for i in range(8)])
    found = 0
    for trial in range(48):
        own = items.items[trial % 8].tolist()
        for at in sorted(rng.choice(length, length // 5, replace=False).tolist(), reverse=True):
            kind = int(rng.integers(0, 3))
            own[at : at + (kind < 2)] = [-1] * (kind != 1)  # another word, none, or one more
        text = np.array([-1] * int(rng.integers(0, 50)) + own + [-1] * 30, np.int64)
        found += any(m[1] == trial % 8 for m in items.matches(text, np.array([0, len(text)], np.int64)))
    assert found >= 0.95 * 48


def test_leak_edges(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(1, passage), (2, passage.upper()), (3, "beta alpha"), (4, None), (None, "one two three four five six"), (5, "solo")], "item_id long, text string")
    docs = frame(spark, [(1, passage), (1, passage), (2, None), (3, ""), (None, f"x {passage}. y"), (4, "alpha beta"), (5, "the " * 40_000 + passage), (6, "Beta, alpha; beta alpha"), (7, "so a beta"), (8, "alpha SOLO")])
    got = sorted(((r.doc_id or -1, r.item_id, r.first_word, r.edits) for r in decontaminate.find_leaks(docs.withColumn("item_id", docs.n_chars), bench).collect()))
    long = [(-1, 1, 1, 0), (-1, 2, 1, 0), (1, 1, 0, 0), (1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 0, 0), (5, 1, 40_000, 0), (5, 2, 40_000, 0)]
    assert got == [*long, (6, 3, 0, 0), (8, 5, 1, 0)]  # short items as they stand, within one document
    extra = docs.withColumns({"_words": F.lit(1), "words": F.lit(2), "a.b": F.lit(3)})
    kept = decontaminate.without_leaks(extra, bench)
    assert kept.columns == extra.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 10
    assert decontaminate.without_leaks(docs.limit(0), bench).count() == 0


# near-duplicates


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    shingles = [" ".join(words)] if 0 < len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fingerprints):
    group = {i: i for i in range(len(fingerprints))}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(fingerprints)), 2):
        if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 4:
            group[find(i)] = find(j)
    return [find(i) for i in range(len(fingerprints))]


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = np.random.default_rng(8)
    base = rows[3][1].split(" ") * 3
    for i in range(60):  # a chain of near copies
        base[int(rng.integers(0, len(base)))] = f"new{i}"
        rows.append((9000 + i, " ".join(base)))
    rows += [(9100, None), (9101, ""), (9102, " \n"), (9103, "É a\x1fB c"), (9104, "A B"), (9105, "a  b"), (9105, "a b"), (9106, "a b c d " * 20_000)]
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    own = [plain_fingerprint(t) for _, t in rows]
    groups = components_of(own)
    least: dict = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, i), i)
    expected = sorted((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, own, groups))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == expected
    kept = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_anchors_link_every_pair_within_the_threshold(spark):
    rng = np.random.default_rng(9)
    points = set()
    for _ in range(150):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        points.add(x)
        for k in range(7):
            for b in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << b
            points.add(x)
    own = sorted(points)
    signed = [x - (1 << 64) if x >> 63 else x for x in own]
    got = {(r.u, r.v) for r in simhash.linked_pairs(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()}
    assert got == {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}


def test_near_duplicates_edges(spark):
    docs = frame(spark, [(None, "same text here again"), (7, "same text here again"), (None, "all alone in this world of words")])
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs.withColumn("component_id", docs.n_chars)).collect()}
    assert out == {(None, 7), (7, 7), (None, None)}
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == ["all alone in this world of words", "same text here again"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    out = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    groups: dict = {}
    for r in out:
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [301, 401]


# the pipeline


def test_pipeline_on_hard_tables(spark, sf_dir, tmp_path, tokenizer_path):
    """Extra columns with names of the stages' own, null ids, empty and repeated rows; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["first", "size", "slot", "score", "predicted", "_k1", "k1", "doc", "lane", "order_0", "_words", "fingerprint"]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hard = frame(spark, [(None, "no id"), (7001, None), (7002, ""), (7003, "same text twice"), (7003, "same text twice"), (None, None)], None)
    docs = real.unionByName(hard).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        step = spark.read.parquet(f"{folder}/documents.parquet")
        for label, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{label}")
            stage(spark, step, folder).write.parquet(path)
            step = spark.read.parquet(path)
            assert step.columns == docs.columns
            assert all(r[n] == i for r in step.limit(50).collect() for i, n in enumerate(names))
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, step, folder).collect()]
        assert len(ids) == step.count() and ids.count(7003) <= 1 and (len(ids) > 50 or name == "empty")
    assert not ids


def test_pipeline(spark, sf_dir, tokenizer_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    step = quality.accepted(docs, labels)
    assert step.columns == docs.columns
    good = sorted((r.doc_id, r.text) for r in step.collect())
    fingerprints = [plain_fingerprint(t) for _, t in good]
    least: dict = {}
    for (i, _), g in zip(good, components_of(fingerprints)):
        least[g] = min(least.get(g, i), i)
    single = docs.where(docs.doc_id.isin(list(least.values())))
    clean = decontaminate.without_leaks(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    mixture = mixing.mixed(clean, corpus_pipeline.TARGET_WEIGHTS).orderBy("mix_order").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in mixture]  # the files hold the mixture in its order
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()


def test_results_do_not_depend_on_slices(spark, tokenizer_path, monkeypatch):
    """Batches are worked on in slices of bytes; here in slices of one row or two, and in one batch."""
    from tokenizers import Tokenizer

    texts = [f"Text NUMBER {i} é with words {'of its own ' * (i % 5)}and passage one two three four five six {i % 3}" for i in range(60)] + [None, ""]
    rows = list(enumerate(texts))
    docs = frame(spark, rows).coalesce(1)
    bench = spark.createDataFrame([(1, "passage one two three four five six 1")], "item_id long, text string")
    for module, name in ((simhash, "TEXT_BYTES"), (token_store, "TEXT_BYTES"), (decontaminate, "WORD_BYTES")):
        monkeypatch.setattr(module, name, 150)
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows}
    whole = Tokenizer.from_file(tokenizer_path)
    tokens = {r.doc_id: r.ids for r in token_store.read_tokens(spark, token_store.write_tokens(docs, tokenizer_path), with_ids=True).collect()}
    assert tokens == {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    hit = {i for i, t in rows if t and t.endswith(" 1")}
    assert {r.doc_id for r in decontaminate.find_leaks(docs, bench).where("edits = 0").collect()} == hit
    assert not hit & {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
