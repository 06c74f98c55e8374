"""Near-duplicate documents by 64-bit SimHash, linked through anchor points of a covering code."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.llm.common import slices, stored, text_of
from newsloom.llm.components import connected_components

#: Covering radius of the code of a key, a perfect Hamming code on its low bits (31, or 15 where there are fewer; the other
#: bits are free), and how many bits of a key two linked fingerprints may differ in.
RADIUS, KEY_THRESHOLD = 1, 1
#: Comparisons of a fingerprint with others that are expected at its anchors at most, of fingerprints spread evenly.
COMPARISONS = 64
#: Bytes of text that are hashed at a time, unless one text is longer.
TEXT_BYTES = 4 << 20


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """Adds `fingerprint` (long; the 64 bits as a signed number) to all columns of docs.

    Words are runs of other than ASCII white space after A-Z are lower-cased; each shingle of so many words, joined by
    a space, is hashed by XXH64 with the seed, repeats included; a bit is set if it is set in over half of the hashes.
    Fewer words than a shingle: the one shingle of them all. No words, or a null text: zero.
    """
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column(at).cast(pa.large_string()).fill_null("")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        result = np.zeros(len(texts), np.uint64)
        for i, own in enumerate(words):
            own = [w for w in own.values.cast(pa.large_binary()).to_pylist() if w]
            if not own:
                continue
            joined = b" ".join(own)
            ends = np.cumsum([len(w) + 1 for w in own]) - 1
            n = max(1, len(own) - shingle + 1)
            first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
            last = ends[len(own) - n :].tolist()
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64)
            result[i] = majority(hashes)
        return result

    def add(batches):
        for batch in slices(batches, at, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of(batch).view(np.int64))], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("fingerprint", LongType())]))


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes, counted in pieces so that a very long text takes little memory."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


@dataclass(frozen=True)
class Keys:
    """Which bits are looked up together: every choice of `chosen` of the bands is a key.

    The bits in which two fingerprints differ, at most `threshold`, leave all but that many bands equal. With
    `threshold + chosen - 1` bands they leave chosen - 1 equal bands at least, and some other band holds one of them at
    most: so in some key they differ in KEY_THRESHOLD = 1 bit at most.
    """

    bands: tuple[tuple[int, int], ...]  # first bit and width
    chosen: int

    @staticmethod
    def of(threshold: int, chosen: int) -> Keys:
        n = threshold + chosen - KEY_THRESHOLD
        ends = [64 * i // n for i in range(n + 1)]
        return Keys(tuple((a, b - a) for a, b in pairwise(ends)), chosen)

    @staticmethod
    def choose(threshold: int, points: int) -> Keys:
        """The fewest bands that make enough anchors for so many fingerprints; the links found are the same with any."""
        options = [Keys.of(threshold, c) for c in range(2, 5)]
        return next((k for k in options if k.expected(points) <= COMPARISONS), options[-1])

    def expected(self, points: int) -> float:
        """Comparisons of each of so many fingerprints, if they are spread evenly."""
        return sum(points * self.visits(w) / 2.0 ** (w - self.checks) for w in map(self.width, self.all()))

    @property
    def checks(self) -> int:
        """Check bits of the code, which 2^checks - 1 bits of every key are words of."""
        return 5 if min(map(self.width, self.all())) >= 31 else 4

    def visits(self, width: int) -> int:
        """Anchors within RADIUS + KEY_THRESHOLD of a key, at most."""
        return 2 ** (self.checks - 1) + width - (2**self.checks - 1)

    def width(self, key: tuple[int, ...]) -> int:
        return sum(self.bands[b][1] for b in key)

    def all(self) -> list[tuple[int, ...]]:
        return list(combinations(range(len(self.bands)), self.chosen))

    def first(self) -> list[int]:
        """The first key with a difference of KEY_THRESHOLD at most, -1 if there is none, by how many bits differ in each band (0, 1,
        or 2 for more), the first band's number counting most."""
        out = []
        for state in product((0, 1, 2), repeat=len(self.bands)):
            out.append(next((i for i, key in enumerate(self.all()) if sum(state[b] for b in key) <= KEY_THRESHOLD), -1))
        return out

    def words(self, fingerprint: Column) -> Column:
        """An array of structs: the number of each key and the key's bits of the fingerprint as a number."""
        out = []
        for i, key in enumerate(self.all()):
            word, at = F.lit(0).cast("long"), 0
            for start, width in (self.bands[b] for b in key):
                word = word.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << width) - 1)), at))
                at += width
            out.append(F.struct(F.lit(i).alias("key"), word.alias("word")))
        return F.array(*out)

    def syndrome(self, word: Column) -> Column:
        """0 for a word of the code; else the number, from 1, of the bit whose flip makes it one."""
        out = F.lit(0)
        for c in range(self.checks):
            mask = sum(1 << i for i in range(2**self.checks - 1) if (i + 1) >> c & 1)
            out = out + F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << c)
        return out

    def home_flips(self) -> list[int]:
        """By syndrome, the flip that leads to the nearest anchor."""
        return [0, *(1 << i for i in range(2**self.checks - 1))]

    def visit_flips(self) -> list[list[int]]:
        """By syndrome, the flips of two coded bits at most that lead to anchors: the nearest, and those by two bits whose
        numbers have the syndrome as their sum."""
        n = 2**self.checks
        out = [[0]]
        for s in range(1, n):
            pairs = [(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, n) if i < i ^ s and i != s]
            out.append([1 << s - 1, *pairs])
        return out


def linked_pairs(points: DataFrame, threshold: int = 4, n_points: int | None = None) -> DataFrame:
    """All pairs (u, v), u < v, of distinct fingerprints in `points` that differ in at most `threshold` bits, each once.

    A fingerprint's home, for each of its keys, is the anchor nearest to it, within the covering radius; and it visits all
    anchors within the covering radius plus the threshold of a key. Where two keys differ within that threshold, either
    fingerprint visits the other's home, so homes and visitors are compared, as whole fingerprints, at each anchor. A pair
    counts at the home of its smaller fingerprint, in the first key that differs within the threshold.
    n_points: how many fingerprints there are, if known; keys get longer with their number, so that anchors stay small.
    """
    keys = Keys.choose(threshold, points.count() if n_points is None else n_points)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    words = points.select("fingerprint", F.explode(keys.words(F.col("fingerprint"))).alias("k")).select("fingerprint", "k.key", "k.word", keys.syndrome(F.col("k.word")).alias("syndrome"))
    at = lambda word: word.bitwiseOR(F.shiftleft(F.col("key").cast("long"), 48))
    near = F.element_at(longs(keys.home_flips()), F.col("syndrome") + 1)
    home = words.select(F.col("fingerprint").alias("u"), at(F.col("word").bitwiseXOR(near)).alias("anchor"))
    coded = F.element_at(F.array(*map(longs, keys.visit_flips())), F.col("syndrome") + 1)
    free = F.element_at(F.array(*[longs(1 << b for b in range(2**keys.checks - 1, keys.width(k))) for k in keys.all()]), F.col("key") + 1)
    flips = F.concat(coded, F.transform(free, lambda f: f.bitwiseXOR(near)))
    visitors = words.select(F.col("fingerprint").alias("v"), "key", "word", F.explode(flips).alias("flip")).select("v", at(F.col("word").bitwiseXOR(F.col("flip"))).alias("anchor"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    state = F.lit(0)
    for start, width in keys.bands:
        state = state * 3 + F.least(F.bit_count(differ.bitwiseAND(F.lit(_signed(((1 << width) - 1) << start)))), F.lit(2))
    own = F.element_at(F.array(*map(F.lit, keys.first())), state + 1) == F.shiftright("anchor", 48)
    near = F.bit_count(differ) <= threshold
    # Spark sizes the sides by the fingerprints that they are made of, and would broadcast what is many times as large.
    return home.join(visitors.hint("merge"), "anchor").where((F.col("u") < F.col("v")) & near & own).select("u", "v")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the smallest doc_id reachable over links, its own included.

    Documents link if their fingerprints differ in at most `threshold` bits. Equal fingerprints are collapsed first, so
    copies cost one row each. One row for each row of docs; rows that share a doc_id each keep theirs. A null doc_id
    takes part, but is never smallest: its component_id is null only if no id is reachable. No rows in, no rows out.
    """
    return _placed(docs.select("doc_id", text_of().alias("text")), threshold, shingle, seed).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _placed(docs: DataFrame, threshold: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The columns of docs but text, the fingerprint as a number, and component_id."""
    marked = stored(fingerprints(docs, shingle, seed).drop("text"), "fingerprints")
    points = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    labels = connected_components(linked_pairs(points, threshold))
    # Only fingerprints with links are relabelled; what a component's least id is, is combined before its shuffle.
    linked = points.join(labels, points["fingerprint"] == labels["node"]).select("fingerprint", "least", "label")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    moved = stored(linked.join(least, "label").select(F.col("fingerprint").alias("point"), "component"), "components")
    own = points.join(moved, points["fingerprint"] == moved["point"], "left")
    own = own.select(F.col("fingerprint").alias("point"), F.when(F.col("point").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return marked.join(own, marked["fingerprint"] == own["point"]).drop("point")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs whose doc_id is the smallest of their component; rows of equal doc_id and text are kept once.

    A document without an id stays unless it is linked to one with an id. Null texts are empty texts, and all of these
    are linked. Rows are told apart by 128 hashed bits of id and text, by which they are shuffled once; each travels as
    one struct, so its columns may have any names.
    """
    key = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key)
    own = docs.select("doc_id", text_of().alias("text"), *key)
    kept = _placed(own, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("k1", "k2").distinct()
    return rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc.*")
