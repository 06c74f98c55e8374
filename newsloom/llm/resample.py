"""Importance resampling towards a target distribution over hashed n-gram features (Xie et al. 2023), in Spark.

Documents get a log importance weight from two histograms of hashed features, a Gumbel draw makes the weights a sample
without replacement, and the cutoff of the sample is found by weighted medians of partition medians.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.llm.arrow_words import Words, words_of
from newsloom.llm.common import slices, stored

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: What parts words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20
#: Bytes of a word, with the space before it, up to which checksums are joined by a table.
JOINED = 64
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def _shift_tables(longest: int) -> np.ndarray:
    """[n, k, b]: the CRC-32 register that n zero bytes make of byte b at place k. CRC is linear, so a register moves
    past n bytes by the sum (xor) of what its four bytes become."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    moved = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    tables = [moved]
    for _ in range(longest):
        moved = (moved >> np.uint32(8)) ^ step[moved & np.uint32(255)]
        tables.append(moved)
    return np.array(tables)


SHIFT = _shift_tables(JOINED)


def pair_checksums(first: np.ndarray, second: np.ndarray, words: list[bytes], alone: np.ndarray) -> np.ndarray:
    """CRC-32 of `first word + space + second word` for each pair of places in `words`; alone: the words' own CRC-32.

    CRC(ab) is CRC(a), moved past the bytes of b, plus CRC(b); so a pair costs four table entries and no bytes are joined.
    """
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    n, crc = length[second], alone[first]
    short = np.minimum(n, JOINED)
    out = SHIFT[short, 0, crc & 255] ^ SHIFT[short, 1, crc >> 8 & 255] ^ SHIFT[short, 2, crc >> 16 & 255] ^ SHIFT[short, 3, crc >> 24] ^ spaced[second]
    for i in np.flatnonzero(n > JOINED):
        out[i] = zlib.crc32(b" " + words[second[i]], int(crc[i]))
    return out


def feature_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all words and of all pairs of neighbours in one text."""
    different = [w.encode() for w in words.different.to_pylist()]
    alone = np.fromiter(map(zlib.crc32, different), np.uint32, len(different))
    near = np.flatnonzero(words.rows[1:] == words.rows[:-1])
    pairs = pair_checksums(words.codes[near], words.codes[near + 1], different, alone) if len(near) else np.zeros(0, np.uint32)
    return np.concatenate([words.rows, words.rows[near]]), (np.concatenate([alone[words.codes], pairs]) % np.uint32(buckets)).astype(np.int64)


def histogram(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task returns its own counts, at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0, SLICE_BYTES):
            total += np.bincount(feature_buckets(words_of(batch.column(0), BETWEEN), buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # a row for each bucket at most
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln(target share / raw share)), shares smoothed by one feature a bucket; in doubles."""
    s, t = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(raw, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """(doc: the carried columns as a struct, n_words, n_features, weight) of each row of docs.

    A text's features look their gains up in an array; their floored mean is its weight, 0 where it has none.
    """
    own = [F.col(f"`{c}`") for c in (carry or docs.columns)]
    rows = docs.select(F.struct(*own).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            words = words_of(batch.column(1), BETWEEN)
            row, bucket = feature_buckets(words, len(gain))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words.per_text(), n, weight))], names=["doc", "n_words", "n_features", "weight"])

    numbers = [StructField(n, LongType()) for n in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(weigh, StructType([rows.schema["doc"], *numbers]))


def gumbel_score(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight + floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(`seed:id`); a null id counts as no text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").cast("double")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


# The order of keys: larger scores first, then smaller ids, null ids last.
LAST_ID = (1 << 63) - 1


def _before(score: np.ndarray, ids: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    return (score > key[0]) | (score == key[0]) & (ids < key[1])


def _median(score: np.ndarray, ids: np.ndarray) -> tuple[int, int] | None:
    """The lower median in the order of keys: half of them, rounded down, do not come after it, and as many not before it."""
    if not len(score):
        return None
    at = np.lexsort((ids, -score))[(len(score) - 1) // 2]
    return int(score[at]), int(ids[at])


def weighted_median(medians: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The first key, in order, at which half of the weight is reached."""
    medians = sorted(medians, key=lambda m: (-m[0][0], m[0][1]))
    half, reached = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        reached += n
        if reached >= half:
            return key
    raise ValueError("no keys")


def select_cutoff(keys: DataFrame, k: int) -> tuple[tuple[int, int], int]:
    """(the key at place k, from 1, in the order of keys; how many rounds it took) of a table (score long, id long).

    Each partition tells the median of what it still holds on either side of the pivot, and how much that is. The next
    pivot is the median of these weighted by the sizes, so at least a quarter of what remains is discarded a round and the
    cutoff is exact. A round brings a few numbers a partition to the driver, and no keys.
    """
    after: tuple[int, int] | None = None  # what remains lies after this key ...
    until: tuple[int, int] | None = None  # ... and before this one
    pivot: tuple[int, int] | None = None
    names = ["n_before", "n_equal", "n_after", "before_score", "before_id", "after_score", "after_id"]
    rounds = 0
    while True:
        rounds += 1
        low, high, middle = after, until, pivot

        def sides(batches: Iterator[pa.RecordBatch], low=low, high=high, middle=middle) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
            if not held:
                return
            score, ids = (np.concatenate(x) for x in zip(*held))
            keep = np.ones(len(score), bool)
            if high is not None:
                keep &= _before(score, ids, high)
            if low is not None:
                keep &= ~_before(score, ids, low) & ~((score == low[0]) & (ids == low[1]))
            score, ids = score[keep], ids[keep]
            first = _before(score, ids, middle) if middle is not None else np.zeros(len(score), bool)
            equal = (score == middle[0]) & (ids == middle[1]) if middle is not None else np.zeros(len(score), bool)
            last = ~first & ~equal
            a, b = _median(score[first], ids[first]), _median(score[last], ids[last])
            values = [int(first.sum()), int(equal.sum()), int(last.sum()), *(a or (None, None)), *(b or (None, None))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=names)

        open_keys = keys
        if low is not None:
            open_keys = open_keys.where(F.col("score") <= low[0])
        if high is not None:
            open_keys = open_keys.where(F.col("score") >= high[0])
        got = open_keys.select("score", "id").mapInArrow(sides, ", ".join(f"{n} long" for n in names)).collect()
        before, equal = sum(r.n_before for r in got), sum(r.n_equal for r in got)
        if pivot is not None and before < k <= before + equal:
            return pivot, rounds
        if pivot is not None and k <= before:
            until = pivot
            pivot = weighted_median([((r.before_score, r.before_id), r.n_before) for r in got if r.n_before])
        else:
            k -= before + equal
            after = pivot
            pivot = weighted_median([((r.after_score, r.after_id), r.n_after) for r in got if r.n_after])


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank: 1, 2, ... by score, descending, and id. Sorted by ranges into files; a row's rank is its place in its
    file plus the rows of the files before, so that no task holds more than a range."""
    sorted_rows = stored(rows.orderBy(F.desc("score"), F.asc("id")), "sorted")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    placed = sorted_rows.select("*", part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = sorted((r["_part"], r["_file"], r["count"]) for r in placed.groupBy("_part", "_file").count().collect())  # a row for each file
    starts, at = [], 0
    for _, name, n in files:
        starts.append((name, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(starts, "_file string, _start long")
    return placed.join(F.broadcast(offsets), "_file").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_file", "_part", "_at", "_start")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """(doc: the carried columns as a struct, n_words, n_features, weight, score, rank) of every row, as in `resampled`."""
    gain = gains(histogram(docs, buckets), histogram(target, buckets))
    rows = weighed(docs, gain, carry).withColumn("score", gumbel_score(F.col("weight"), F.col("doc.doc_id"), seed))
    rows = stored(rows.withColumn("id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LAST_ID))), "weights")
    able = F.col("n_words") >= least_words
    k = percent * rows.where(able).count() // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("id")
    (score, last), _ = select_cutoff(rows.where(able).select("score", "id"), k)
    wins = able & ((F.col("score") > score) | (F.col("score") == score) & (F.col("id") <= last))
    winners = ranked(rows.where(wins)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.where(~wins).withColumn("rank", F.lit(None).cast("long")).unionByName(winners).drop("id")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs, with n_words, n_features, weight, score and rank: the place in the sample, null if not drawn.

    docs: doc_id, text and any other columns; carry: those to return (all). target: a table with a column text, whose
    distribution the sample leans to. Of the rows with `least_words` words or more, `percent` of a hundred (rounded
    down) are drawn, those of largest score, ties to the smaller doc_id.

    Null and empty texts have no features, weight 0, and are never drawn. Null ids draw as the empty text and come last
    among ties. Rows that repeat count as often as they stand there and have equal scores; where the sample ends between
    them, which of them is drawn is open. Very long texts are one row like others. No target texts: its histogram is
    even. No docs, no rows. Columns of docs that have one of the five new names come back as <name>_given.
    """
    names = carry or docs.columns
    back = [F.col(f"doc.`{c}`").alias(f"{c}_given" if c in RESULTS else c) for c in names]
    return drawn(docs, target, percent, least_words, buckets, seed, names).select(*back, *RESULTS)


#: DuckDB has no CRC-32: its table is made by the eight steps of its definition and each feature's bytes are folded over it.
ORACLE = f"""
with recursive register as (select i, i as c, 0 as step from range(256) t(i)
    union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from register where step < 8),
crc as (select list(c order by i) as entries from register where step = 8),
texts as (select row_number() over () as r, true as own, doc_id, text from documents union all select row_number() over (), false, null, text from benchmark),
words as (select r, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
features as (select r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from words),
coded as (select feature, hex(encode(feature)) as h from (select distinct feature from features)),
places as (select feature, list_transform(range(0, len(h) // 2), lambda i:
    (16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint) as bytes from coded),
hashed as (select feature, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from places, crc),
buckets as (select b.bucket, count(own) filter (own) as s, count(own) filter (not own) as t
    from range({BUCKETS}) b(bucket) left join (hashed join features using (feature)) using (bucket) group by b.bucket),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + {BUCKETS})::double / ((s + 1)::double * (sum(t) over () + {BUCKETS})::double)))::bigint as gain from buckets),
weights as (select r, count(*) as n, sum(gain)::double as total from features join hashed using (feature) join gains using (bucket) where own group by r),
weighed as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_features, case when n > 0 then floor(total / n)::bigint else 0 end as weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from words left join weights using (r) where own),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
placed as (select *, n_words >= {LEAST_WORDS} as able, count(*) filter (n_words >= {LEAST_WORDS}) over () as n from scored),
ordered as (select *, case when able then row_number() over (partition by able order by score desc, doc_id) end as place from placed)
select doc_id, n_features, weight, score, case when place <= {PERCENT} * n // 100 then place end as rank from ordered
"""
