"""Token-id files: each document is one zstandard frame made with a shared dictionary, found through an offset index.

A shard, all numbers little-endian:
    b"NLIDS01\\n", id width in bytes (u1), SHA-256 of the dictionary (32 bytes; of no bytes if there is none)
    one zstandard frame for each document: its ids as unsigned integers of that width, the end id included
    index: n doc_ids (i8), n validity bytes (0: the doc_id is null), n + 1 frame offsets (u8), n id counts (u4)
    start of the index (u8), n (u8), b"NLIDSEND"
The dictionary lies beside the shards as dictionary-<first 16 hex digits of its hash>.bin.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import filesystem, new_dir, read_file, slices, text_of, write_file

MAGIC, END = b"NLIDS01\n", b"NLIDSEND"
HEAD = struct.Struct("<8sB32s")
TAIL = struct.Struct("<QQ8s")
#: A shard is closed beyond so many compressed bytes or documents, so that its index and any task reading it stay small.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 50_000
#: Documents used to train the dictionary: at most so many, none longer than so many characters. It serves short documents.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 8_000, 64 << 10
LEVEL = 3

#: A space after one of these characters always starts a new piece of a byte-level tokenizer's split. A piece that begins
#: with a space and ends with one can be told apart again after it was joined with others.
SURE_PIECE = re.compile(rb"(?s) .*(?:[\x21-\x7e]|[\xc3-\xc8][\x80-\xbf])\Z")
#: What a Python worker remembers of pieces that it met: so many, with so many ids for each on average, and none longer than
#: so many bytes. Beyond, it keeps half as many: first those that it met again since it learned them, then the latest.
CACHE, CACHED_IDS, CACHED_BYTES = 250_000, 8, 64
#: The library describes a token by much more than its id, so it gets so many characters at a time, unless one text is longer.
LEARNED_CHARS = 64 << 10
#: Bytes of text that are encoded at a time, unless one text is longer.
TEXT_BYTES = 2 << 20


def sure_starts(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a piece of the byte-level split begins for certain, whatever stands around: a flag each.

    That is at a space or line end after a visible character (ASCII, or U+00C0 to U+023F), at an ASCII mark after a
    letter, and at an ASCII letter after a single line end. Beginnings that are less certain are not flagged.
    """
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    graph = (data >= 0x21) & (data <= 0x7E)
    mark = graph & ~ascii_letter & ~((data >= 0x30) & (data <= 0x39))
    visible, letter = graph, ascii_letter
    if len(data) and data.max() >= 0x80:
        lead = np.concatenate([[np.uint8(0)], data[:-1]])
        second = (data >= 0x80) & (data < 0xC0) & (lead >= 0xC3) & (lead <= 0xC8)
        visible = graph | second
        letter = ascii_letter | second & ~((lead == 0xC3) & ((data == 0x97) | (data == 0xB7)))  # the signs of times and division
    line_end = data == 0x0A
    starts = np.zeros(len(data), bool)
    starts[1:] = ((data[1:] == 0x20) | line_end[1:]) & visible[:-1] | mark[1:] & letter[:-1]
    starts[2:] |= ascii_letter[2:] & line_end[1:-1] & visible[:-2]
    return starts


class Encoder:
    """Whole texts to ids by a tokenizer of the tokenizers library, given as its JSON, as its own encode does by default.

    Where the tokenizer splits texts the byte-level way and has no normalizer, texts are cut at `sure_starts`, and each
    different piece is encoded once and remembered, which gives the ids of the whole text. Texts that hold a special
    token, and other tokenizers' texts, are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        #: Texts to encode whole.
        self.odd = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []) if t["content"])
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not any(not t.get("special") for t in spec.get("added_tokens", []))
        #: A byte-level token is written with one character for each byte that it stands for.
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64) if self.by_piece else None
        #: Places of remembered pieces in the arrays that follow: where their ids start, how many, and the turns (calls of
        #: encode) in which they were learned and last met.
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.learned, self.met, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def whole(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """special: special tokens are read as such where a text holds them."""
        self.tokenizer.encode_special_tokens = not special
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        result: list[np.ndarray] = []
        while (at := len(result)) < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEARNED_CHARS, "right")))
            result += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False)]
        return result

    def forget(self) -> None:
        """Makes room for pieces to come."""
        pieces, at = np.array(list(self.known), object), np.fromiter(self.known.values(), np.int64, len(self.known))
        kept = np.lexsort((-self.met[at], self.met[at] == self.learned[at]))[: CACHE // 2]
        pieces, at = pieces[kept].tolist(), at[kept]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        self.ids = self.ids[np.arange(counts.sum()) + np.repeat(self.starts[at] - ends + counts, counts)]
        self.starts, self.counts, self.learned, self.met = ends - counts, counts, self.learned[at], self.met[at]
        self.known = dict(zip(pieces, range(len(pieces))))

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces not met before. Those that begin and end so that a split between them is certain go as joined
        texts, which the library encodes faster, and are told apart by how many bytes each token stands for."""
        sure = [p for p in pieces if SURE_PIECE.match(p)]
        joint = set(sure)
        alone = [p for p in pieces if p not in joint]
        texts = [b"".join(sure[k : k + 64]).decode() for k in range(0, len(sure), 64)]
        got = np.concatenate([np.zeros(0, np.uint32), *self.whole(texts, special=False)])
        ends = np.cumsum(np.fromiter(map(len, sure), np.int64, len(sure)))
        reached = np.cumsum(self.token_bytes[got])
        last = np.searchsorted(reached, ends, "right")
        if len(sure) and not (reached[last - 1] == ends).all():
            raise AssertionError("a token spans two pieces")
        counts = np.diff(np.concatenate([[0], last]))
        single = self.whole([p.decode() for p in alone], special=False)
        counts = np.concatenate([counts, np.fromiter(map(len, single), np.int64, len(single))])
        got = np.concatenate([got, *single])
        self.known.update(zip(sure + alone, range(len(self.counts), len(self.counts) + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, got])
        self.learned, self.met = (np.concatenate([x, np.full(len(pieces), self.turn)]) for x in (self.learned, self.met))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none may be null."""
        texts = texts.cast(pa.large_string())
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[0] == offsets[-1]:
            return [np.zeros(0, np.uint32) for _ in range(len(texts))]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = sure_starts(data)
        starts[offsets[offsets < len(data)]] = True
        cuts = np.append(np.flatnonzero(starts), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.turn += 1
        found = list(map(self.known.get, own))
        self.met[[at for at in found if at is not None]] = self.turn
        if len(self.known) + found.count(None) > CACHE or len(self.ids) > CACHED_IDS * CACHE:
            self.forget()
            found = list(map(self.known.get, own))
        if None in found:
            new = [p for p, at in zip(own, found) if at is None]
            self.learn(new)
            found = list(map(self.known.get, own))
            for long in [p for p in new if len(p) > CACHED_BYTES]:
                del self.known[long]
        piece = np.array(found, np.int64)[coded.indices.to_numpy()]
        counts = self.counts[piece]
        ends = np.cumsum(counts)
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[piece] - ends + counts, counts)]
        reached = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)].tolist()
        result = [flat[i:j] for i, j in itertools.pairwise(reached)]
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)) if self.odd else []
        for i, ids in zip(odd, self.whole(texts.take(pa.array(odd)).to_pylist()) if len(odd) else []):
            result[i] = ids
        return result


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each Python worker, so that what it remembers outlives a task. A task has one core, so the library gets no
    threads, of which each would keep memory of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


class Shard:
    """Writes one file; `done` is to be called once."""

    def __init__(self, uri: str, width: int, dictionary: bytes):
        self.uri, self.width = uri, width
        target, path = filesystem(uri)
        self.out = target.open_output_stream(path)
        self.out.write(HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True).compress
        self.ids, self.valid, self.offsets, self.counts = [], bytearray(), [HEAD.size], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.counts.append(len(ids))

    def full(self) -> bool:
        return self.offsets[-1] > SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def done(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.ids, "<i8").tobytes() + bytes(self.valid) + np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes())
        self.out.write(TAIL.pack(self.offsets[-1], len(self.ids), END))
        self.out.close()
        return self.uri, len(self.ids), sum(self.counts)


class Reader:
    """Random access to one shard: only the index and the frames asked for are read."""

    def __init__(self, uri: str, dictionaries: dict[bytes, bytes] | None = None):
        source, path = filesystem(uri)
        self.file = source.open_input_file(path)
        size = self.file.size()
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        at, self.n, end = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != END:
            raise ValueError(f"{uri} is no whole token-id file")
        index, n = self.file.read_at(size - TAIL.size - at, at), self.n
        self.ids = np.frombuffer(index, "<i8", n)
        self.valid = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u4", n, 17 * n + 8)
        own = None
        if digest != hashlib.sha256(b"").digest():
            known = {} if dictionaries is None else dictionaries
            if digest not in known:
                data = read_file(f"{uri.rpartition('/')[0]}/dictionary-{digest.hex()[:16]}.bin")
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError("the dictionary is not the one that the shard was made with")
                known[digest] = data
            own = zstandard.ZstdCompressionDict(known[digest])
        self.decompress = zstandard.ZstdDecompressor(dict_data=own).decompress

    def read(self, first: int, last: int) -> list[np.ndarray]:
        """The ids of documents first to last - 1 of the shard, by one read."""
        at = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last]) - at, at)
        return [np.frombuffer(self.decompress(data[int(self.offsets[i]) - at : int(self.offsets[i + 1]) - at]), f"<u{self.width}").astype("<u4") for i in range(first, last)]


def train_dictionary(docs: DataFrame, tokenizer_json, end_id: int) -> tuple[int, bytes]:
    """(id width in bytes, dictionary), made in one task from at most SAMPLE_DOCS short documents, those of least hash.

    The dictionary is empty where there are too few documents to train on. tokenizer_json: a broadcast of the JSON.
    """
    order = F.xxhash64("doc_id", "text")
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(1, docs.count()))
    drawn = docs.select("doc_id", "text").where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    chosen = drawn.where(F.length("text").between(1, SAMPLE_CHARS)).orderBy(order, "doc_id").limit(SAMPLE_DOCS)

    def train(batches):
        own = encoder(tokenizer_json.value)
        samples = [np.append(x, np.uint32(end_id)) for batch in slices(batches, 0, TEXT_BYTES) for x in own.encode(batch.column(0))]
        width = 2 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        samples = [x.astype(f"<u{width}").tobytes() for x in samples]
        total, dictionary = sum(map(len, samples)), b""
        if len(samples) >= 8 and total >= 4096:
            try:
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), samples).as_bytes()
            except zstandard.ZstdError:  # the samples have too little in common
                pass
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([dictionary], pa.binary())], names=["width", "dictionary"])

    # The sample is bounded, so one task holds it; without any documents that task still runs.
    made = chosen.select("text").repartition(1).mapInArrow(train, "width int, dictionary binary").first()
    return (made.width, bytes(made.dictionary)) if made else (4, b"")


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0, order: list | None = None) -> DataFrame:
    """Encodes every text, appends end_id, writes shards in the order given (doc_id, null first), returns their list.

    The list (shard long, path, n_docs, n_tokens, base: ids in all shards before) is itself a table in `out`. Files get
    names of their own for each attempt of a task and count only if the list names them, so lost executors and tasks run
    twice do no harm. Null texts are empty texts. Rows of equal doc_id follow each other, ordered by their text's hash.
    """
    spark = docs.sparkSession
    out = out or new_dir(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keys = order or [F.col("doc_id")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *[k.alias(f"order_{i}") for i, k in enumerate(keys)])
    keys = [f"order_{i}" for i in range(len(keys))]
    width, dictionary = train_dictionary(rows, shared, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    write_file(f"{out}/shards/dictionary-{digest[:16]}.bin", dictionary)

    def write(batches):
        context, made, shard = TaskContext.get(), 0, None
        listed = []
        for batch in slices(batches, 1, TEXT_BYTES):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(shared.value).encode(batch.column(1))):
                if shard is None:
                    shard = Shard(f"{out}/shards/part-{context.partitionId():06d}-{made:04d}-{context.taskAttemptId()}.ids", width, dictionary)
                shard.add(doc_id, np.append(ids, np.uint32(end_id)))
                if shard.full():
                    listed.append((context.partitionId() * 1_000_000 + made, *shard.done()))
                    made, shard = made + 1, None
        if shard is not None:
            listed.append((context.partitionId() * 1_000_000 + made, *shard.done()))
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*listed)], names=["shard", "path", "n_docs", "n_tokens"])

    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).select("doc_id", "text")
    ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long").write.parquet(f"{out}/list")
    listed = spark.read.schema("shard long, path string, n_docs long, n_tokens long").parquet(f"{out}/list")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard of up to 64 MB
    return listed.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked, ids) of each document in the files of `shards`.

    start: how many ids all documents before it have; ids_crc32: of its ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path, known)
                for k in range(0, reader.n, 1024):
                    ids = reader.read(k, last := min(k + 1024, reader.n))
                    counts = np.array([len(x) for x in ids], np.int64)
                    columns = [pa.array(reader.ids[k:last], pa.int64(), mask=~reader.valid[k:last]), pa.array(base + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    base += int(counts.sum())
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    n = shards.count()
    if n:
        shards = shards.select("path", "base").repartition(n)  # a shard a task
    return shards.select("path", "base").mapInArrow(read, schema)
