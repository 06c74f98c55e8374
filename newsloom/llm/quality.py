"""Quality classifier: a sparse ensemble of rules over statistics of the text (RuleFit: Friedman, Popescu 2008)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import fold, stored, text_of

#: Labelled rows that the rules and weights are fitted on, those of least hash; the bound is a parameter of `fit`.
FIT_ROWS = 50_000
TREES, DEPTH, LASSO = 12, 3, 0.002
STATISTICS = ("log_chars", "log_words", "word_length", "distinct_words", "upper_share", "letter_share", "digit_share", "space_share", "mark_share", "bar_share", "shout_share", "sentence_rate", "line_rate", "repeat_share")


def words_of(text: Column) -> Column:
    """What stands between white space, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Numbers that describe a text; all are finite, and zero for an empty one. No id, label, language or source enters.

    words: the column of its `words_of`, made in a step before, so that it is not made anew for each number.
    """
    chars = F.length(text)
    over = F.greatest(chars, F.lit(1))
    n = F.size(words)
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / over
    count = lambda mark: (chars - F.length(F.replace(text, F.lit(mark), F.lit("")))) / over
    same = F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1)))
    return {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(n),
        "word_length": chars / F.greatest(n, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        "upper_share": left(r"[^\p{Lu}]+"),
        "letter_share": left(r"[^\p{L}]+"),
        "digit_share": left(r"[^0-9]+"),
        "space_share": left(r"\S+"),
        "mark_share": left(r"[\p{L}\p{N}\s.,]+"),
        "bar_share": count("|"),
        "shout_share": count("!"),
        "sentence_rate": count("."),
        "line_rate": count("\n"),
        "repeat_share": same / F.greatest(n - 1, F.lit(1)),
    }


@dataclass
class Rule:
    """A path of a tree: all of its (statistic, greater, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, greater, threshold in self.tests:
            held = held & ((F.col(name) > threshold) if greater else (F.col(name) <= threshold))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if g else '<='} {t:.6g}" for n, g, t in self.tests)


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """Of a table that has the statistics as columns."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(debug: str, names: tuple[str, ...]) -> list[Rule]:
    """Every path of at least one test, to inner nodes and leaves alike, of the trees that Spark's model describes."""
    found: dict[tuple, Rule] = {}
    path: list[tuple[str, bool, float]] = []
    for line in debug.splitlines():
        if "Tree" in line:
            path = []
        elif m := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", line):
            if m[1] == "Else":  # the tests below the If branch are done with
                while path and not (path[-1][0] == names[int(m[2])] and path[-1][1] is False and path[-1][2] == float(m[4])):
                    path.pop()
                path.pop()
            path.append((names[int(m[2])], m[3] == ">", float(m[4])))
            tests = _tight(path)
            found.setdefault(tests, Rule(tests))
    return list(found.values())


def _tight(path: list[tuple[str, bool, float]]) -> tuple:
    """Without tests that another of the same statistic and direction implies."""
    kept: dict[tuple[str, bool], float] = {}
    for name, greater, threshold in path:
        old = kept.get((name, greater))
        kept[name, greater] = threshold if old is None else max(old, threshold) if greater else min(old, threshold)
    return tuple(sorted((n, g, t) for (n, g), t in kept.items()))


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns STATISTICS; null texts count as empty. `rows` has no columns of these names, nor `_words`."""
    return rows.withColumn("_words", words_of(text_of(text))).withColumns(statistics(text_of(text), F.col("_words"))).drop("_words")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS, seed: int = 5) -> RuleModel:
    """From documents outside the held-out fold that have a label 0 or 1; an id with labels of both kinds has none.

    A forest of shallow trees proposes the rules; a lasso logistic regression over their truth values weighs them, and
    those of weight zero go. Where one class alone is labelled the score is its share, drawn a little towards 1/2.
    """
    known = labels.where(F.col(target).isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.min(target).alias("low"), F.max(target).alias("high")).where("low = high")
    order = F.xxhash64("doc_id", F.lit(seed))
    share = min(1.0, 1.3 * rows / max(1, known.count()))
    known = known.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("doc_id", F.col("low").alias("label"), order.alias("order"))
    if share < 1:
        known = known.orderBy("order", "doc_id").limit(rows)
    # At most about 1.3 * rows ids and labels meet the documents where these lie, so that no text is shuffled.
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")
    data = stored(with_statistics(chosen).select("order", F.col("label").cast("double").alias("label"), *STATISTICS), "statistics")
    if data.count() > rows:  # ids that repeat in docs
        data = stored(data.orderBy("order", *STATISTICS).limit(rows), "statistics")
    counts = {int(r.label): r["count"] for r in data.groupBy("label").count().collect()}
    n = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (n + 2)
    if len(counts) < 2:
        return RuleModel(math.log(prior / (1 - prior)))
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="statistics").transform(data).select("label", "statistics", *STATISTICS).cache()
    forest = RandomForestClassifier(featuresCol="statistics", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=1.0, seed=seed).fit(data)
    rules = tree_rules(forest.toDebugString, STATISTICS)
    if not rules:
        data.unpersist()
        return RuleModel(math.log(prior / (1 - prior)))
    truth = data.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    truth = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(truth).select("label", "rules").cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=True, maxIter=60, tol=1e-5).fit(truth)
    weights = lasso.coefficients.toArray().tolist()
    truth.unpersist()
    data.unpersist()
    return RuleModel(float(lasso.intercept), [Rule(r.tests, w) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def scored(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """(doc: the row as it was given, score 0 to 1, predicted: 1 if the score reaches the threshold, at: 0 or more).

    Null and empty texts get a score like others; rows that repeat get equal scores. The given row travels as one
    struct, so its columns may have any names.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_of().alias("text"))
    # A filter that reads `at` stays above this step. One that Spark moves below it would have every test of every rule
    # compute its statistic of the text anew.
    out = with_statistics(own).select("doc", model.score().alias("score"), F.monotonically_increasing_id().alias("at"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by a model fitted outside the held-out fold.

    Null texts are empty texts, which get a score too; null ids stay null; rows that repeat get rows each; labels for
    ids that docs lacks are ignored. No usable labels: every score is 1/2. No docs, no rows.
    """
    model = fit(docs, labels, **options)
    out = scored(docs.select("doc_id", "text"), model, threshold)
    return out.select("doc.doc_id", (fold("doc.doc_id") == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents, all columns as given, whose score reaches the threshold; a filter, so nothing is shuffled.

    Nulls, repeats and missing labels as in `score_quality`; columns of docs may have any names, `score` included.
    """
    return scored(docs, fit(docs, labels, **options), threshold).where("predicted = 1 and at >= 0").select("doc.*")
