"""Toxicity: a conditional random field tags toxic spans; its marginals give the score of a document.

Labels are of documents. Those of a bounded sample become labels of tokens: in a toxic document, tokens with a feature that
is surely more frequent among toxic documents. The field learns from these tags, from whole documents, its gradient summed
by Spark; every text is then tagged, and the expected number and share of toxic tokens give a calibrated score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from newsloom.llm.arrow_words import Words, words_of
from newsloom.llm.common import fold, slices, stored
from newsloom.llm.crf import marginals, minimise, tagged_score

#: Labelled rows that are fitted on, those of least hash; features that the field knows, those of most documents.
FIT_ROWS, FEATURES = 8_000, 1 << 15
#: Documents that a feature has to be in; sureness, in standard errors, and least log odds of one that tags.
LEAST_DOCS, SURE, ODDS = 3, 2.5, math.log(2)
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 3
L2, ROUNDS, PARTS = 0.5, 25, 16
SLICE_BYTES = 2 << 20
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHAPES = ("^Aa", "^AA")
MEASURES = ("log_toxic", "log_share", "most")


def feature_columns(different: pa.Array) -> list[pa.Array]:
    """Of each word its features, one array a kind, null where a word has none: itself, its beginnings and end, its shape."""
    lower = pc.utf8_lower(different)
    size = pc.utf8_length(lower)
    columns = [pc.binary_join_element_wise("=", lower, "")]
    for k in PREFIXES:
        columns.append(pc.if_else(pc.greater(size, k), pc.binary_join_element_wise("<", pc.utf8_slice_codeunits(lower, 0, k), ""), None))
    columns.append(pc.if_else(pc.greater(size, SUFFIX), pc.binary_join_element_wise(">", pc.utf8_slice_codeunits(lower, -SUFFIX), ""), None))
    first = pc.utf8_slice_codeunits(different, 0, 1)
    upper = pc.and_(pc.utf8_is_upper(different), pc.greater(size, 1))
    shape = pc.if_else(upper, SHAPES[1], pc.if_else(pc.utf8_is_upper(first), SHAPES[0], None))
    return [*columns, shape]


@dataclass
class Tagger:
    """names: the features it knows; weights: theirs, then the constant; steps: 2 x 2; toxic: of each feature, whether it tags."""

    names: pa.Array
    weights: np.ndarray
    steps: np.ndarray
    toxic: np.ndarray
    #: Of the constant and MEASURES, for the score of a document.
    measure: np.ndarray = field(default_factory=lambda: np.zeros(1 + len(MEASURES)))

    def known(self, different: pa.Array) -> list[np.ndarray]:
        """Of each word the numbers of its features, an array a kind, len(names) where it is unknown."""
        return [pc.fill_null(pc.index_in(c, self.names), len(self.names)).to_numpy(zero_copy_only=False).astype(np.int64) for c in feature_columns(different)]

    def word_scores(self, different: pa.Array) -> np.ndarray:
        padded = np.append(self.weights[:-1], 0.0)
        return self.weights[-1] + sum(padded[c] for c in self.known(different)) if len(different) else np.zeros(0)

    def tags(self, different: pa.Array) -> np.ndarray:
        padded = np.append(self.toxic, False)
        return np.logical_or.reduce([padded[c] for c in self.known(different)]) if len(different) else np.zeros(0, bool)

    def probabilities(self, words: Words) -> np.ndarray:
        """Of each word of the texts, that it is toxic."""
        lengths = words.per_text()
        return marginals(self.word_scores(words.different)[words.codes], lengths[lengths > 0], self.steps).tag

    def measures(self, words: Words, toxic: np.ndarray) -> np.ndarray:
        """MEASURES of each text: log of the expected number of toxic words, of their number in a thousand, and the surest."""
        n, total, most = np.maximum(words.per_text(), 1), words.per_text(toxic), np.zeros(words.texts)
        np.maximum.at(most, words.rows, toxic)
        return np.column_stack([np.log1p(total), np.log1p(1000 * total / n), most])

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.measure[0] + measures @ self.measure[1:])))


def spans(text: str, toxic: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of words of probability `least` or more: where they begin and end in the text, and their largest probability."""
    out: list[dict] = []
    last = -2
    for i, (m, p) in enumerate(zip(WORD.finditer(text), toxic.tolist())):
        if p < least:
            continue
        if last == i - 1:
            out[-1] |= {"end": m.end(), "score": max(p, out[-1]["score"])}
        else:
            out.append({"start": m.start(), "end": m.end(), "score": p})
        last = i
    return out


def chosen(docs: DataFrame, labels: DataFrame, target: str, rows: int, seed: int) -> DataFrame:
    """(text, label) of at most `rows` documents outside the held-out fold whose label is 0 or 1, those of least hash; an
    id with labels of both kinds has none. The ids, so many at most, meet the documents where these lie."""
    known = labels.where(F.col(target).isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.min(target).alias("low"), F.max(target).alias("high")).where("low = high")
    known = known.select("doc_id", F.col("low").cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    met = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    met = stored(met, "labelled")
    if met.count() > rows:  # ids that repeat in docs
        met = met.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").limit(rows)
    return stored(met.select("text", "label").repartition(PARTS), "labelled")


def document_counts(data: DataFrame) -> DataFrame:
    """(feature, clean, toxic): in how many clean and toxic documents each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE_BYTES):
            words = words_of(batch.column(0), BETWEEN, lower=False)
            labels = batch.column(1).to_numpy()
            for column in feature_columns(words.different):
                named = pa.table({"row": pa.array(words.rows), "feature": column.take(pa.array(words.codes))}).drop_null()
                once = named.group_by(["row", "feature"]).aggregate([])
                toxic = labels[once.column("row").to_numpy()] == 1
                found = pa.table({"feature": once.column("feature"), "clean": pa.array((~toxic).astype(np.int64)), "toxic": pa.array(toxic.astype(np.int64))})
                found = found.group_by("feature").aggregate([("clean", "sum"), ("toxic", "sum")])
                yield from found.rename_columns(["feature", "clean", "toxic"]).to_batches()

    found = data.mapInArrow(count, "feature string, clean long, toxic long")
    return found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def surely_toxic(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Whether the log odds of a feature's documents, less SURE standard errors, are above ODDS."""
    cells = [toxic + 0.5, n_toxic - toxic + 0.5, clean + 0.5, n_clean - clean + 0.5]
    odds = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    return odds - SURE * np.sqrt(sum(1 / c for c in cells)) > ODDS


def encoded(data: DataFrame, tagger: Tagger) -> DataFrame:
    """Shards of tagged texts for the gradient: lengths, word codes, tags, and the features of each different word."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE_BYTES):
            words = words_of(batch.column(0), BETWEEN, lower=False)
            toxic = batch.column(1).to_numpy() == 1
            tags = tagger.tags(words.different)[words.codes] & toxic[words.rows]
            known = np.column_stack(tagger.known(words.different)) if len(words.different) else np.zeros((0, 1), np.int64)
            lengths = words.per_text()
            parts = [lengths[lengths > 0].astype(np.int32), words.codes.astype(np.int32), tags.astype(np.int8), known.reshape(-1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["lengths", "codes", "tags", "features"])

    return data.mapInArrow(encode, "lengths binary, codes binary, tags binary, features binary")


def train(shards: DataFrame, tagger: Tagger, l2: float = L2, rounds: int = ROUNDS) -> None:
    """Sets the weights and steps that make the shards' tags likeliest, less l2 / 2 times the squared weights.

    A round is a job: tasks run forward-backward over their shards and return one gradient each, of bounded size.
    """
    n, kinds = len(tagger.names), len(PREFIXES) + 3

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        padded, constant, steps = np.append(x[:n], 0.0), x[n], np.array([[0.0, x[n + 1]], [x[n + 2], x[n + 3]]])

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(n + 4)
            for batch in batches:
                for row in batch.to_pylist():
                    lengths, codes, tags = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("lengths", np.int32), ("codes", np.int32), ("tags", np.int8)))
                    features = np.frombuffer(row["features"], np.int32).reshape(-1, kinds)
                    scores = (padded[features].sum(axis=1) + constant)[codes]
                    m = marginals(scores, lengths, steps)
                    own, taken = tagged_score(scores, lengths, steps, tags)
                    loss += m.log_z - own
                    by_word = np.bincount(codes, m.tag - tags, minlength=len(features))
                    slope[:n] += np.bincount(features.reshape(-1), np.repeat(by_word, kinds), minlength=n + 1)[:n]
                    slope[n] += by_word.sum()
                    slope[n + 1 :] += (m.steps - taken).reshape(-1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

        got = shards.mapInArrow(gradient, "loss double, slope binary").collect()  # a row a task, of FEATURES numbers at most
        total = sum(r.loss for r in got) + l2 / 2 * float(x @ x)
        return total, np.sum([np.frombuffer(r.slope) for r in got], axis=0) + l2 * x

    start = np.zeros(n + 4)
    start[n] = -4.0
    best = minimise(value, start, rounds)
    tagger.weights, tagger.steps = best[: n + 1].copy(), np.array([[0.0, best[n + 1]], [best[n + 2], best[n + 3]]])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = FIT_ROWS, seed: int = 13) -> Tagger:
    """From documents outside the held-out fold. Where one class alone is labelled, every score is that of its share."""
    data = chosen(docs, labels, target, rows, seed)
    counts = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
    n_clean, n_toxic = counts.get(0, 0), counts.get(1, 0)
    prior = (n_toxic + 1) / (n_clean + n_toxic + 2)
    none = Tagger(pa.array([], pa.string()), np.array([-30.0]), np.zeros((2, 2)), np.zeros(0, bool), np.array([math.log(prior / (1 - prior)), 0.0, 0.0, 0.0]))
    if not n_clean or not n_toxic:
        return none
    found = document_counts(data).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    found = found.orderBy(F.desc(F.col("clean") + F.col("toxic")), "feature").limit(FEATURES).toArrow()  # FEATURES rows at most
    clean, toxic = found.column("clean").to_numpy(), found.column("toxic").to_numpy()
    tagger = Tagger(found.column("feature").combine_chunks(), np.zeros(found.num_rows + 1), np.zeros((2, 2)), surely_toxic(clean, toxic, n_clean, n_toxic))
    if not tagger.toxic.any():
        return none
    train(stored(encoded(data, tagger), "shards"), tagger)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE_BYTES):
            words = words_of(batch.column(0), BETWEEN, lower=False)
            m = tagger.measures(words, tagger.probabilities(words))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), *map(pa.array, m.T)], names=["label", *MEASURES])

    measured = data.mapInArrow(measure, "label double, " + ", ".join(f"{m} double" for m in MEASURES))
    measured = stored(VectorAssembler(inputCols=list(MEASURES), outputCol="measures").transform(measured).select("label", "measures"), "measures")
    model = LogisticRegression(featuresCol="measures", labelCol="label", regParam=1e-4, maxIter=50).fit(measured)
    tagger.measure = np.array([model.intercept, *model.coefficients.toArray()])
    return tagger


def scored(docs: DataFrame, tagger: Tagger, carry: list[str] | None = None) -> DataFrame:
    """(doc: the carried columns as a struct, score, toxic_words: their expected number, spans) of every row of docs."""
    own = [F.col(f"`{c}`") for c in (carry or docs.columns)]
    rows = docs.select(F.struct(*own).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            words = words_of(batch.column(1), BETWEEN, lower=False)
            toxic = tagger.probabilities(words)
            ends = np.cumsum(words.per_text())
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in np.unique(words.rows[toxic >= 0.5]):
                found[i] = spans(batch.column(1)[int(i)].as_py(), toxic[ends[i - 1] if i else 0 : ends[i]])
            columns = [tagger.score(tagger.measures(words, toxic)), words.per_text(toxic)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(found, kind)], names=["doc", "score", "toxic_words", "spans"])

    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    result = [rows.schema["doc"], StructField("score", DoubleType()), StructField("toxic_words", DoubleType()), StructField("spans", ArrayType(span))]
    return rows.mapInArrow(tag, StructType(result))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, spans for every row of docs, by a model fitted outside the held-out fold.

    A span is where toxic words begin and end in the text, in characters, and the largest probability of one of them;
    toxic_words is the expected number of toxic words. Null and empty texts have no words and get the score of no toxic
    word; a text of any length is one chain. Null ids stay null; rows that repeat get rows each; labels for ids that docs
    lacks, and ids labelled both ways, are ignored. No usable labels of both kinds: every score is the smoothed share of
    the toxic ones. No docs, no rows. Other columns of docs, whatever their names, are not read.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **options), ["doc_id"])
    return out.select("doc.doc_id", (fold("doc.doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_words", "spans")
