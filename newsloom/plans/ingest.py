"""From feed documents and pages to new posts: one batch job over a store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.predicates import content_gate
from newsloom.functions.similarity import norm_url
from newsloom.operators.dedup import dedup_batch, sweep
from newsloom.operators.lifecycle import forget
from newsloom.operators.listing import enabled_sources, hint_posts, unseen
from newsloom.operators.reports import ERRORS, funnel
from newsloom.sources.feeds import read_atom, read_rss, unreadable
from newsloom.sources.pages import enrich, extract_articles
from newsloom.steps import cut_lineage
from newsloom.sources.store import Store, insert_new_posts, post_id, record_duplicates, record_run, record_seen, touch_sources


@dataclass
class Ingested:
    """What a run did: counters as one row, and the posts that it added."""

    funnel: DataFrame
    new_posts: DataFrame
    errors: DataFrame  # feed_url, error: a dead letter for each document that could not be used
    outcomes: DataFrame  # run_id, outcome, error: a row for each item and outcome


def purge_hints(store: Store, **lists) -> None:
    """Forgets unpublished posts of puzzle answers."""
    ids = hint_posts(store.read("posts"), **lists).select("id")
    if not ids.isEmpty():
        forget(store, ids)


def feed_items(docs: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """Items of the documents (feed_url, kind rss or atom, xml) of enabled sources, with source and category."""
    own = docs.join(enabled_sources(sources).select(F.col("url").alias("feed_url"), F.col("id").alias("source_id"), "category_id"), "feed_url")
    rss, atom = (own.where(F.col("kind") == k).drop("kind") for k in ("rss", "atom"))
    return read_rss(rss, limit).unionByName(read_atom(atom, limit))


def feed_errors(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(feed_url, error) of documents that make no items: unreadable ones, those of an unknown kind, and those of an
    address that no enabled source has."""
    enabled = enabled_sources(sources).select(F.col("url").alias("feed_url")).distinct()
    own = docs.join(enabled, "feed_url", "left_semi")
    known = F.coalesce(F.col("kind").isin("rss", "atom"), F.lit(False))
    parts = [
        unreadable(own.where(F.col("kind") == "rss"), "rss").select("feed_url", "error"), unreadable(own.where(F.col("kind") == "atom"), "atom").select("feed_url", "error"),
        own.where(~known).select("feed_url", F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))).alias("error")),
        docs.join(enabled, "feed_url", "left_anti").select("feed_url", F.lit("no enabled source").alias("error")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _first_of_address(items: DataFrame) -> DataFrame:
    """Of items whose normalised addresses are equal the first of its feed; the others count as seen."""
    order = F.struct("position", "link", *[c for c in items.columns if c not in ("position", "link")])
    one = items.groupBy(norm_url(F.col("link")).alias("_url")).agg(F.min(order).alias("item"))
    return one.select(*[F.col(f"item.{c}").alias(c) for c in items.columns])


def swept_ids(posts: DataFrame, kept: DataFrame, family: str) -> DataFrame:
    """Ids that the sweep of the kept posts removes from posts and kept."""
    merged = cut_lineage(posts.unionByName(kept))
    return merged.select("id").join(sweep(merged, kept.select("id"), family).select("id"), "id", "left_anti")


def store_batch(store: Store, kept: DataFrame, matches: DataFrame, gone: DataFrame, as_of) -> None:
    """Records matches, adds kept posts, removes swept ones. To do it again changes nothing."""
    store.append("duplicate_records", record_duplicates(matches, as_of), ["id"])
    there = store.read("posts").join(kept.select("id"), "id", "left_semi").select("id")
    store.update("posts", kept.join(there, "id", "left_anti"), gone)


def ingest(store: Store, docs: DataFrame, pages: DataFrame, as_of, run_id: str, limit: int = 10, family: str = "e5_base", days: int = 30, most_errors: int | None = ERRORS, **lists) -> Ingested:
    """Reads feeds, gates, enriches, gates again, drops what was seen, removes duplicates, stores posts, ledger, records.

    An item with an empty description passes the first gate, since its page may supply the text. Every item ends in one
    outcome, which the funnel counts, and so does every document that makes no items: its error is a row of `errors`. What a run decides is staged under its run_id before the store is changed, and each
    change adds only what is not there: a run that failed anywhere is finished by running it again under the same id. The
    ledger comes after the posts, so that under another id too no item is lost.
    """
    store.roll_forward()
    purge_hints(store, **{k: v for k, v in lists.items() if k in ("puzzles", "phrases")})
    posts, ledger = store.read("posts"), store.read("parsed_items")
    stage = partial(store.stage, run_id)
    items = stage("items", lambda: feed_items(docs, store.read("sources"), limit))
    errors = stage("errors", lambda: feed_errors(docs, store.read("sources")))
    first = content_gate(items, keep_empty=True, **lists)
    passed = first.where("reject_reason is null").drop("reject_reason")
    texts = extract_articles(pages).select("url", "article_text")
    gated = stage("gated", lambda: content_gate(enrich(passed, texts), **lists))
    good = gated.where("reject_reason is null").drop("reject_reason")
    recorded = store.read("duplicate_records").select(norm_url(F.col("duplicate_url")).alias("normalized_url"))
    seen_before = ledger.select("normalized_url").unionByName(recorded)
    fresh = stage("fresh", lambda: _first_of_address(unseen(good, seen_before, posts)))
    existing = stage("existing", lambda: insert_new_posts(posts, fresh, as_of)[1])
    new = stage("new", lambda: insert_new_posts(posts, fresh, as_of)[0])
    decided = cache(lambda: dedup_batch(new, posts, family, as_of, days))
    kept = stage("kept", lambda: decided()[0])
    titles = new.select(F.col("id").alias("new_id"), F.col("source_url").alias("link"), F.col("raw_title").alias("title"), F.col("raw_description").alias("description"))
    matches = stage("matches", lambda: decided()[1].join(titles, "new_id"))
    gone = stage("gone", lambda: swept_ids(posts, kept, family))
    store_batch(store, kept, matches, gone, as_of)
    swept = store.read("posts")
    store.append("parsed_items", record_seen(store.read("parsed_items"), good, as_of))
    runs = record_run(store.read("runs"), run_id, "fetch", as_of, items.select(F.col("source_id").alias("id")).distinct())
    store.append("runs", runs, ["run_id", "kind", "source_id"])
    store.write("sources", touch_sources(store.read("sources"), store.read("runs")))
    added = swept.join(kept.select("id"), "id", "left_semi")
    link = lambda df, outcome: df.select(F.lit(run_id).alias("run_id"), F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("error"))
    rejected = first.where("reject_reason is not null").unionByName(gated.where("reject_reason is not null"))
    seen = good.join(fresh.select("link").distinct(), "link", "left_anti")
    parts = [(items, "scanned"), (rejected, "rejected"), (good, "checked"), (seen, "seen"), (existing, "existing"), (fresh, "eligible"), (matches, "duplicate"), (kept, "new"), (added, "queued")]
    outcomes = errors.select(F.lit(run_id).alias("run_id"), F.lit("error").alias("outcome"), F.concat_ws(": ", "feed_url", "error").alias("error"))
    for df, name in parts:
        outcomes = outcomes.unionByName(link(df, name))
    return Ingested(funnel(outcomes, most=most_errors), added, errors, outcomes)


def with_embeddings(posts: DataFrame, encode) -> DataFrame:
    """Adds embedding and title_embedding by the caller's pandas UDF from texts to arrays of float."""
    from newsloom.functions.similarity import encoder_input

    return posts.withColumn("embedding", encode(encoder_input(F.col("raw_title"), F.col("raw_description"), "other", "passage"))).withColumn("title_embedding", encode(F.col("raw_title")))


__all__ = ["Ingested", "feed_items", "ingest", "post_id", "purge_hints", "store_batch", "swept_ids", "with_embeddings"]
