"""Headline similarity as column expressions: normal forms, word sets, verdict classes, confidence, cosine."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell one story from another.
STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "its", "are", "was", "not",
    "announced", "confirmed", "first", "new", "big", "one", "after", "weeks", "about", "how",
    "2026", "2025", "2024", "sale", "discount", "discounts", "game", "games", "video", "film",
]
# Words of franchise names; an overlap of four or more that are all of these says nothing.
FRANCHISE_WORDS = ["world", "tour", "taxi", "crazy", "war", "gears", "day", "game", "live", "service"]
# Words that contradict each other.
CONTRADICTIONS = [("summer", "winter")]
# Encoder families and the thresholds of their semantic decision.
FAMILIES = ("e5_base", "e5_large", "bge", "other")
THRESHOLDS = {
    "e5_large": {"full_strong": 0.86, "full_with_title": 0.80, "title": 0.82, "full_with_lexical": 0.74, "similar_full": 0.64, "similar_title": 0.74, "common": 4, "common_title": 4, "common_similar": 4, "common_high": 4},
    "bge": {"full_strong": 0.86, "full_with_title": 0.80, "title": 0.82, "full_with_lexical": 0.74, "similar_full": 0.66, "similar_title": 0.74, "common": 3, "common_title": 3, "common_similar": 3, "common_high": 4},
    "e5_base": {"full_strong": 0.88, "full_with_title": 0.82, "title": 0.84, "full_with_lexical": 0.76, "similar_full": 0.68, "similar_title": 0.78, "common": 2, "common_title": 2, "common_similar": 2, "common_high": 4},
}
THRESHOLDS["other"] = THRESHOLDS["e5_base"]
MEDIUM_JACCARD = {"e5_large": 0.35, "bge": 0.30}
#: Shared distinctive words without which no verdict but equality is possible.
LEAST_COMMON = {"e5_base": 2, "other": 2, "e5_large": 3, "bge": 3}
#: What titles that are not equal have to share for a strong or medium verdict: any of (distinctive words, Jaccard).
LEXICAL_BOUNDS = {"e5_base": ((4, 0.55),), "other": ((4, 0.55),), "e5_large": ((5, 0.0), (3, MEDIUM_JACCARD["e5_large"])), "bge": ((5, 0.0), (3, MEDIUM_JACCARD["bge"]))}


def semantic_bounds(family: str, thresholds: dict | None = None) -> tuple:
    """What titles that are not equal have to share for the semantic decision to be able to call them duplicates."""
    least = (thresholds or THRESHOLDS[family])["common"]
    if least < 1:
        raise ValueError("without a common word asked for, any two posts could be duplicates, and no join finds them")
    return ((least, 0.0), *LEXICAL_BOUNDS[family])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_title(c: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def norm_url(c: Column) -> Column:
    """Without query, fragment and trailing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(c), r"(?s)[?#].*", ""), r"/+$", ""))


@dataclass(frozen=True)
class Title:
    """What comparisons need of a title; columns of a table if they were computed there once for each row."""

    norm: Column
    words: Column
    distinct: Column

    @staticmethod
    def of(c: Column) -> Title:
        norm = norm_title(c)
        words = F.filter(F.split(norm, " "), lambda w: F.octet_length(w) >= 3)
        return Title(norm, words, F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS))))

    @staticmethod
    def at(prefix: str) -> Title:
        return Title(*(F.col(f"{prefix}_{x}") for x in ("norm", "words", "distinct")))

    def columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}_norm": self.norm, f"{prefix}_words": self.words, f"{prefix}_distinct": self.distinct}


def title_columns(df, prefix: str, column: Column):
    """Adds the parts of a title in two steps, so that the normal form is computed once."""
    df = df.withColumn(f"{prefix}_norm", norm_title(column))
    df = df.withColumn(f"{prefix}_words", F.filter(F.split(f"{prefix}_norm", " "), lambda w: F.octet_length(w) >= 3))
    return df.withColumn(f"{prefix}_distinct", F.array_distinct(F.filter(f"{prefix}_words", lambda w: ~w.isin(STOPWORDS))))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_jaccard(a: Column, b: Column) -> Column:
    """Over the different words of three bytes or more."""
    return _jaccard(F.array_distinct(Title.of(a).words), F.array_distinct(Title.of(b).words))


def distinctive(c: Column) -> Column:
    return Title.of(c).distinct


@dataclass(frozen=True)
class Pair:
    """What verdicts need of two titles; columns of a table if they were computed there once for each pair."""

    equal: Column
    common: Column
    jaccard: Column
    contradict: Column
    meaningful: Column
    similar: Column

    @staticmethod
    def of(a: Title, b: Title) -> Pair:
        return Pair(_match(a, b), F.size(F.array_intersect(a.distinct, b.distinct)), _jaccard(a.distinct, b.distinct), _contradict(a, b), _meaningful(a, b), _similar(a, b))

    @staticmethod
    def at(prefix: str) -> Pair:
        return Pair(*(F.col(f"{prefix}_{f.name}") for f in fields(Pair)))


def pair_columns(df, prefix: str, a: Title, b: Title):
    """Adds the parts of a pair, so that each is computed once, whatever is asked of them."""
    own = Pair.of(a, b)
    return df.withColumns({f"{prefix}_{f.name}": getattr(own, f.name) for f in fields(Pair)})


def distinctive_common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(Title.of(a).distinct, Title.of(b).distinct))


def distinctive_jaccard(a: Column, b: Column) -> Column:
    return _jaccard(Title.of(a).distinct, Title.of(b).distinct)


def _match(a: Title, b: Title) -> Column:
    return (a.norm != "") & (a.norm == b.norm)


def _contradict(a: Title, b: Title) -> Column:
    found = F.lit(False)
    for left, right in CONTRADICTIONS:
        for x, y in ((left, right), (right, left)):
            found = found | (F.array_contains(a.distinct, x) & F.array_contains(b.distinct, y))
    return found


def _meaningful(a: Title, b: Title) -> Column:
    shared = F.array_intersect(a.distinct, b.distinct)
    return (F.size(shared) < 4) | (F.size(F.array_except(shared, F.array(*[F.lit(w) for w in FRANCHISE_WORDS]))) > 0)


def _similar(a: Title, b: Title) -> Column:
    """Not symmetric: words of a, with repeats, that b has are held against the shorter list."""
    common = F.size(F.filter(a.words, lambda w: F.array_contains(b.words, w)))
    na, nb = F.size(a.words), F.size(b.words)
    la, lb = F.octet_length(a.norm), F.octet_length(b.norm)
    inside = F.when(la <= lb, (la >= 24) & F.contains(b.norm, a.norm)).otherwise((lb >= 24) & F.contains(a.norm, b.norm))
    some = (na > 0) & (nb > 0)
    half = (common >= 2) & (common / F.least(na, nb) >= 0.5)
    most = common / (na + nb - common) >= 0.65
    return F.when(_match(a, b), True).when((a.norm == "") | (b.norm == ""), False).when(inside, True).when(~some, False).otherwise(F.coalesce(half | most, F.lit(False)))


def pair_strong(p: Pair, family: str) -> Column:
    if family == "e5_large":
        enough = (p.common >= 5) | ((p.common >= 4) & (p.jaccard >= 0.45))
    elif family == "bge":
        enough = (p.common >= 5) | ((p.common >= 4) & (p.jaccard >= 0.50) & p.meaningful)
    else:
        enough = (p.common >= 4) & (p.jaccard >= 0.55)
    return F.when(p.equal, True).when(p.contradict, False).otherwise(enough)


def pair_medium(p: Pair, family: str) -> Column:
    if family not in MEDIUM_JACCARD:
        return F.lit(False)
    enough = p.similar & (p.common >= 3) & (p.jaccard >= MEDIUM_JACCARD[family])
    return F.when(pair_strong(p, family) | p.contradict, False).otherwise(enough)


def titles_match(a: Column, b: Column) -> Column:
    return _match(Title.of(a), Title.of(b))


def titles_similar(a: Column, b: Column) -> Column:
    return _similar(Title.of(a), Title.of(b))


def titles_strong(a: Column, b: Column, family: str = "e5_base") -> Column:
    return pair_strong(Pair.of(Title.of(a), Title.of(b)), family)


def titles_medium(a: Column, b: Column, family: str) -> Column:
    return pair_medium(Pair.of(Title.of(a), Title.of(b)), family)


def meaningful_overlap(a: Column, b: Column) -> Column:
    return _meaningful(Title.of(a), Title.of(b))


#: Characters of a description's normal form that are compared, and bytes that it needs for that.
LEAD, LEAD_BYTES = 220, 60


def lead_columns(df, prefix: str, column: Column):
    """Adds the beginning of a description as a title's parts; those too short to compare have no normal form."""
    uncut = F.substring(norm_title(column), 1, LEAD)
    df = df.withColumn(f"{prefix}_uncut", uncut)
    df = df.withColumn(f"{prefix}_lead", F.when(F.octet_length(f"{prefix}_uncut") >= LEAD_BYTES, F.col(f"{prefix}_uncut")))
    return title_columns(df, prefix, F.col(f"{prefix}_lead")).drop(f"{prefix}_uncut", f"{prefix}_lead")


def leads_similar(a: Title, b: Title) -> Column:
    return (a.norm != "") & (b.norm != "") & _similar(a, b)


def descriptions_similar(a: Column, b: Column) -> Column:
    """Of the first 220 characters of the normal forms, if both have 60 bytes or more."""
    left, right = (F.substring(norm_title(c), 1, LEAD) for c in (a, b))
    return F.when((F.octet_length(left) < LEAD_BYTES) | (F.octet_length(right) < LEAD_BYTES), False).otherwise(_similar(Title.of(left), Title.of(right)))


def content_matches(new_title: Column, new_desc: Column, old_title: Column, old_desc: Column) -> Column:
    return titles_similar(new_title, old_title) | descriptions_similar(new_desc, old_desc)


def lexical_class(p: Pair, family: str) -> Column:
    """3 equal or strong, 2 medium, 1 similar, 0 otherwise."""
    return F.when(pair_strong(p, family), 3).when(pair_medium(p, family), 2).when(p.similar, 1).otherwise(0)


def match_rank(p: Pair, family: str, confidence: Column) -> Column:
    """A struct that orders matches, best largest."""
    return F.struct(lexical_class(p, family).alias("lexical"), p.common.alias("common"), confidence.alias("confidence"))


def lexical_verdict(p: Pair, family: str) -> Column:
    """struct(class, confidence, explanation), or null where the titles are no duplicates lexically."""
    percent = F.round(p.jaccard * 100).cast("int")
    make = lambda kind, confidence, text: F.struct(F.lit(kind).alias("class"), confidence.cast("int").alias("confidence"), text.alias("explanation"))
    return (
        F.when(p.equal, make("equal", F.lit(98), F.lit("equal normalised titles")))
        .when(pair_strong(p, family), make("strong", F.least(88 + p.common, F.lit(98)), F.format_string("similar titles: %d common words, %d%% of the vocabulary", p.common, percent)))
        .when(pair_medium(p, family), make("medium", F.least(84 + p.common, F.lit(94)), F.format_string("related titles: %d common words", p.common)))
    )


def heuristic_score(p: Pair, described: Column, family: str) -> Column:
    """Of a shortlist: 100 equal, 90 strong, 75 medium, 60 similar; 3 a common word; 40 or 20 for the descriptions.

    described: whether the descriptions are similar.
    """
    titles = F.when(p.equal, 100).when(pair_strong(p, family), 90).when(pair_medium(p, family), 75).when(p.similar, 60).otherwise(0)
    return titles + p.common * 3 + F.when(described, 40).when(p.similar, 20).otherwise(0)


def encoder_family(model_id: Column) -> Column:
    return F.when(F.contains(model_id, F.lit("e5-large")), "e5_large").when(F.contains(model_id, F.lit("e5")), "e5_base").when(F.contains(model_id, F.lit("bge")), "bge").otherwise("other")


def encoder_input(title: Column, description: Column, family: str, side: str) -> Column:
    """What an encoder is given; side is query or passage."""
    t, d = F.trim(_text(title)), F.trim(_text(description))
    base = F.when(d == "", t).when(t == "", F.substring(d, 1, 512)).otherwise(F.concat(t, F.lit(". "), F.substring(d, 1, 480)))
    if family.startswith("e5"):
        return F.concat(F.lit(f"{side}: "), base)
    if family == "bge" and side == "query":
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), base)
    return base


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for vectors that are null, empty, of other lengths or of zero norm; norms: where they have been computed before."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0), dot / (na * nb)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def classify_duplicate(family: str, full: Column, title: Column, a: Title, b: Title, a_desc: Column, b_desc: Column, thresholds: dict | None = None) -> Column:
    """The semantic decision: by title class, or by similarities of enough distinctive words."""
    return decide_duplicate(Pair.of(a, b), family, full, title, descriptions_similar(a_desc, b_desc), thresholds)


def decide_duplicate(p: Pair, family: str, full: Column, title: Column, described: Column, thresholds: dict | None = None) -> Column:
    t = thresholds or THRESHOLDS[family]
    full, title = F.round(full, 6), F.round(title, 6)
    weak = F.lit(False)
    if family in ("e5_large", "bge"):
        dominant = (p.common >= t["common_high"]) & (title >= 0.82) & (full >= 0.68) & p.meaningful
        weak = (p.common < 5) & (p.jaccard < 0.35) & ~dominant
    enough = (
        (full >= t["full_strong"])
        | ((full >= t["full_with_title"]) & (title >= t["title"]) & (p.common >= t["common_title"]))
        | (p.similar & (p.common >= t["common_similar"]) & ((full >= t["similar_full"]) | (title >= t["similar_title"])))
        | ((p.common >= t["common_high"]) & (full >= t["full_with_lexical"]) & (title >= round(t["title"] - 0.06, 6)))
        | ((full >= t["full_with_lexical"]) & (title >= t["title"]))
        | ((full >= t["full_with_lexical"]) & described)
    )
    return F.when(pair_strong(p, family) | pair_medium(p, family), True).when((p.common < t["common"]) | weak, False).otherwise(enough)


def least_similarities(family: str, thresholds: dict | None = None) -> tuple[float, float]:
    """Of full texts and of titles: posts that reach neither are semantic duplicates only if their titles are lexically."""
    t = thresholds or THRESHOLDS[family]
    return min(t[x] for x in ("full_strong", "full_with_title", "similar_full", "full_with_lexical")), t["similar_title"]


def semantic_confidence(full: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(full, 6) * 100))).cast("int")
