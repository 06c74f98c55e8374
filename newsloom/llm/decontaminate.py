"""Benchmark decontamination: passages within an edit distance of a benchmark item, found through the CGK embedding.

The CGK embedding (Chakraborty, Goldenberg, Koucky 2016) walks over a sequence and writes the word it stands on at each
step; a random bit, a function of the step and the word, says whether it then moves on. Two sequences of small edit
distance get into step again soon after each edit, so their outputs have a small Hamming distance, and bit sampling
(some random places of the outputs, compared as one key) is a locality-sensitive hash for it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices

#: Similarity that counts as a leak: edits of at most this complement of an item's words.
SIMILARITY = 0.8
#: Items with fewer words allow no edits, so they are looked for exactly.
MIN_WORDS = 5
#: Longer items are looked up by parts of at most so many words: of an item's edits some part has no more than its share.
PART = 48
#: Bytes of words, counted eight a word, that a task works on at a time, unless one text has more.
WORD_BYTES = 4 << 20
#: Walks (independent embeddings), keys for each walk and sampled places for each key.
WALKS, KEYS, PLACES = 6, 5, 3
#: Items that one pass over the documents holds in memory; more items take more passes.
ITEMS_A_PASS = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; a null text has none."""
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def expected_recall(hamming_share: float, walks: int = WALKS, keys: int = KEYS, places: int = PLACES) -> float:
    """Of a pair whose embeddings differ in this share of places."""
    return 1 - (1 - (1 - hamming_share) ** places) ** (walks * keys)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _run_hash(tokens: np.ndarray, q: int) -> np.ndarray:
    """Of each q words in a row."""
    n = max(0, len(tokens) - q + 1)
    value = np.zeros(n, np.uint64)
    for i in range(q):
        value = _hash(value * MIX + tokens[i : i + n].astype(np.uint64))
    return value


class Items:
    """Benchmark items as word numbers, with what the documents are held against: pairs of words, LSH keys, texts.

    Items of up to PART words are looked up whole; longer ones by parts of nearly equal length. Of an item's edits, at
    most a share of its words, some part holds no more than that share of its own words, so the item is found if that
    part is, and then the whole item is verified. Thus recall does not fall with an item's length.
    """

    def __init__(self, rows: list[tuple[int | None, list[str]]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS, seed: int = 7):
        rows = [(i, w) for i, w in rows if w]
        texts: dict[tuple, list] = {}
        for i, w in rows:
            texts.setdefault(tuple(w), []).append(i)
        self.owners = list(texts.values())
        self.vocabulary = sorted({w for t in texts for w in t})
        number = {w: n for n, w in enumerate(self.vocabulary)}
        self.items = [np.array([number[w] for w in t], np.int64) for t in texts]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.floor((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        self.seed = seed
        size = 1 << max(16, (8 * int(self.lengths.sum())).bit_length())
        self.size = size
        #: Short items by length: a hash of the words, and the items of each hash.
        self.short: dict[int, dict[int, list[int]]] = {}
        parts: list[tuple[int, int, np.ndarray]] = []  # item, first word, words
        for i, x in enumerate(self.items):
            if len(x) < min_words and self.edits[i] == 0:
                self.short.setdefault(len(x), {}).setdefault(int(_run_hash(x, len(x))[0]), []).append(i)
                continue
            n = -(-len(x) // PART)
            ends = [len(x) * k // n for k in range(n + 1)]
            parts += [(i, a, x[a:b]) for a, b in itertools.pairwise(ends)]
        self.part_item = np.array([p[0] for p in parts], np.int64)
        self.part_first = np.array([p[1] for p in parts], np.int64)
        lengths = np.array([len(p[2]) for p in parts], np.int64)
        edits = np.floor((1 - similarity) * lengths + 1e-9).astype(np.int64)
        self.kinds = sorted(set(zip(lengths.tolist(), edits.tolist())))
        #: For runs of q words: a bit for the kinds of items (by length, modulo 64) that hold the run.
        self.runs = {q: np.zeros(size, np.uint64) for q in (2, 3)}
        for (_, _, x), n, k in zip(parts, lengths.tolist(), edits.tolist()):
            for q, there in self.runs.items():
                there[self._runs(x, q)] |= np.uint64(1 << self.kinds.index((n, k)) % 64)
        keys, owners = [], []
        for n, _ in self.kinds:
            which = np.flatnonzero(lengths == n)
            tokens = np.concatenate([parts[i][2] for i in which])
            found = self.keys(tokens, np.arange(len(which)) * n, np.full(len(which), n))
            keys.append(found.ravel())
            owners.append(np.repeat(which, found.shape[1]))
        keys, owners = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (owners, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.key_items = keys[order], owners[order]

    def _runs(self, tokens: np.ndarray, q: int) -> np.ndarray:
        """A number below `size` for each q words in a row."""
        return (_run_hash(tokens, q) & np.uint64(self.size - 1)).astype(np.int64)

    def keys(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One row for each window of tokens, WALKS * KEYS keys; a window past the end of tokens goes on with an end mark."""
        longest = int(lengths.max(initial=0))
        out = np.zeros((len(starts), WALKS * KEYS), np.uint64)
        rng = np.random.default_rng(self.seed)
        shares = rng.random((WALKS, KEYS, PLACES))
        padded = np.append(tokens, -1)
        for walk in range(WALKS):
            at = np.zeros(len(starts), np.int64)
            seen = np.empty((2 * longest, len(starts)), np.int64)
            for step in range(2 * longest):
                inside = at < lengths
                token = padded[np.where(inside, np.minimum(starts + at, len(tokens)), len(tokens))]
                seen[step] = token
                mark = np.uint64((self.seed * 1_000_003 + walk * 10_007 + step) * 0x94D049BB133111EB & (1 << 64) - 1)
                at += (_hash((token + 2).astype(np.uint64) * MIX + mark) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
            for k in range(KEYS):
                value = lengths.astype(np.uint64) * np.uint64(1315423911) + np.uint64(walk * KEYS + k)
                for share in shares[walk, k]:
                    place = np.floor(share * 2 * lengths).astype(np.int64)
                    value = _hash(value * MIX + (seen[place, np.arange(len(starts))] + 2).astype(np.uint64))
                out[:, walk * KEYS + k] = value
        return out

    def candidates(self, tokens: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens and parts of items that share an LSH key there.

        Windows of a part's size at every place take part, but for those that hold too few of the benchmark's runs of q
        words to come within the part's edits: k edits leave at least n - q + 1 - qk of a part's n - q + 1 runs whole.
        """
        none = np.zeros(0, np.int64)
        if len(tokens) < 2:
            return none, none
        totals, held = {}, {}
        for q, there in self.runs.items():
            held[q] = there[self._runs(tokens, q)]
            known = held[q] != 0
            for i in range(q):
                known &= tokens[i : i + len(known)] >= 0
            for i in range(1, q):  # runs that would go on from one document to the next
                across = breaks - i
                known[across[(across >= 0) & (across < len(known))]] = False
            held[q] = np.append(np.where(known, held[q], np.uint64(0)), np.zeros(q, np.uint64))
            totals[q] = np.concatenate([[0], np.cumsum(known), np.full(q - 1, known.sum())])[: len(tokens) + 1]
        at, length = [], []
        for kind, (n, k) in enumerate(self.kinds):
            q = 3 if n - 2 - 3 * k >= 2 else 2
            total = totals[q]
            last = len(tokens) - 1
            reach = np.minimum(np.arange(last) + n + k - q + 1, last)
            least = max(1, n - q + 1 - q * k)
            enough = np.flatnonzero(total[reach] - total[:last] >= least)
            own = np.zeros(len(enough), np.uint64)  # the same, counting only runs of items of this length
            for i in range(n + k - q + 1):
                own += held[q][np.minimum(enough + i, last)] >> np.uint64(kind % 64) & np.uint64(1)
            enough = enough[own >= least]
            at.append(enough)
            length.append(np.full(len(enough), n))
        at, length = np.concatenate(at or [none]), np.concatenate(length or [none])
        places, items = [], []
        for k in range(0, len(at), 8192):
            keys = self.keys(tokens, at[k : k + 8192], length[k : k + 8192])
            low = np.searchsorted(self.sorted_keys, keys.ravel(), "left")
            many = np.searchsorted(self.sorted_keys, keys.ravel(), "right") - low
            which = np.repeat(np.arange(keys.size), many)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            items.append(self.key_items[low[which] + inside])
            places.append(at[k + which // keys.shape[1]])
        return (np.concatenate(places), np.concatenate(items)) if places else (none, none)

    def matches(self, tokens: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, edits): the best place of each item within its edits in each document."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, known in self.short.items():
            hashes = _run_hash(tokens, n)
            for place in np.flatnonzero(np.isin(hashes, np.array(list(known), np.uint64))).tolist():
                doc = int(np.searchsorted(offsets, place, "right")) - 1
                for item in known[int(hashes[place])]:
                    if place + n <= offsets[doc + 1] and (tokens[place : place + n] == self.items[item]).all():
                        best.setdefault((doc, item), (0, place - int(offsets[doc]), n))
        places, parts = self.candidates(tokens, offsets[1:-1])
        docs = np.searchsorted(offsets, places, "right") - 1
        items, places = self.part_item[parts], places - self.part_first[parts]
        order = np.lexsort((places, items, docs))
        covered, last = -1, None
        for doc, item, place in zip(docs[order].tolist(), items[order].tolist(), places[order].tolist()):
            slack = int(self.edits[item]) + 1
            if last == (doc, item) and place <= covered:
                continue  # inside the stretch just looked at
            last, covered = (doc, item), place + int(self.lengths[item])
            begin = max(int(offsets[doc]), place - slack)
            end = min(int(offsets[doc + 1]), place + 2 * int(self.lengths[item]) + slack)
            stretch = tokens[begin:end]
            if np.isin(self.items[item], stretch).sum() < self.lengths[item] - self.edits[item]:
                continue  # each word that the stretch lacks costs an edit
            edits, first, length = nearest(self.items[item], stretch)
            if edits <= self.edits[item]:
                found = (edits, begin + first - int(offsets[doc]), length)
                best[doc, item] = min(best.get((doc, item), found), found)
        return [(d, i, f, n, e) for (d, i), (e, f, n) in sorted(best.items())]


def nearest(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, length) of the part of the stretch of least edit distance to the item, the leftmost such end."""
    n = len(stretch)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for i, word in enumerate(item.tolist(), 1):
        swap = np.concatenate([[i], cost[:-1] + (stretch != word)])
        down = cost + 1
        use = swap <= down
        new, origin = np.where(use, swap, down), np.where(use, np.concatenate([[0], start[:-1]]), start)
        reach = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == reach, steps, 0))
        cost, start = new[source] + steps - source, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end - int(start[end])


def _word_numbers(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = pc.index_in(lists.flatten(), value_set=vocabulary)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def _passes(items: DataFrame, id_column: str, text_column: str, **options):
    """The items, ITEMS_A_PASS or about so many at a time: what a task holds is bounded, however many items there are."""
    rows = items.select(F.col(id_column).cast("long").alias("i"), words(F.col(text_column)).alias("w"))
    passes = max(1, math.ceil(rows.count() / ITEMS_A_PASS))
    for p in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("i", "w"), F.lit(passes)) == p)
        yield Items([(r.i, r.w) for r in part.collect()], **options)


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits, similarity): where documents hold a benchmark item, nearly or exactly.

    Words are lower-cased runs of letters and digits. The match is the part of the document of least word edit distance
    to the item; it counts within floor(0.2 * words) edits, so items of under five words have to stand there as they are;
    one row for each document and item. Items without words are in no document; items of equal words each get rows. Null texts have no words; null ids stay null; documents that
    repeat get rows each. No items or no documents, no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long, similarity double"
    found = None
    for known in _passes(items, "item_id", "text", **options):
        held = docs.sparkSession.sparkContext.broadcast(known)

        def match(batches, held=held):
            known = held.value
            vocabulary = pa.array(known.vocabulary, pa.string())
            for batch in slices(batches, 1, WORD_BYTES):
                ids = batch.column(0).to_pylist()
                rows = [
                    (ids[d], owner, f, n, e, 1 - e / int(known.lengths[i]))
                    for d, i, f, n, e in known.matches(*_word_numbers(batch.column(1), vocabulary))
                    for owner in known.owners[i]
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.float64()])], names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"])

        part = given.mapInArrow(match, schema)
        found = part if found is None else found.unionAll(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that hold no benchmark item; a map over documents, so nothing is shuffled.

    Items, nulls and repeats as in `find_leaks`; documents without words are kept; columns may have any names.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words(F.col("text")).alias("words"))
    schema = kept.schema
    for known in _passes(items, "item_id", "text", **options):
        held = docs.sparkSession.sparkContext.broadcast(known)

        def clean(batches, held=held):
            known = held.value
            vocabulary = pa.array(known.vocabulary, pa.string())
            for batch in slices(batches, 1, WORD_BYTES):
                hit = {m[0] for m in known.matches(*_word_numbers(batch.column(1), vocabulary))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(clean, schema)
    return kept.select("doc.*")
