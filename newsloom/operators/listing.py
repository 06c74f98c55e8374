"""Listings, lookups and joins over posts and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.predicates import is_hint_content
from newsloom.functions.similarity import norm_title, norm_url
from newsloom.functions.text import format_post_text, strip_links

QUEUE = ("new", "processing", "ai_processed", "approved", "failed")
PENDING = ("new", "processing", "ai_processed", "approved")
PUBLISHABLE = ("ai_processed", "approved")


def with_category(posts: DataFrame, categories: DataFrame) -> DataFrame:
    """Posts with category_name; categories are a dimension, which Spark broadcasts while it is small."""
    return posts.join(categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name")), F.col("category_id") == F.col("_cid"), "left").drop("_cid")


def list_posts(posts: DataFrame, categories: DataFrame, status: str | None = None) -> DataFrame:
    own = posts if status is None else posts.where(F.col("status") == status)
    return with_category(own, categories).orderBy(F.desc("created_at"), F.desc("id"))


def next_batch(posts: DataFrame, status: str = "new", n: int = 10) -> DataFrame:
    return posts.where(F.col("status") == status).orderBy("created_at", "id").limit(n)


def queue(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("status").isin(*QUEUE)).orderBy("created_at", "id")


def recent_published(posts: DataFrame, n: int = 5) -> DataFrame:
    return posts.where("status = 'published'").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(n)


def find_by_id(posts: DataFrame, ids: DataFrame) -> DataFrame:
    return posts.join(ids.select("id").distinct(), "id", "left_semi")


def find_by_title(posts: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, id): for each title its newest post of equal normal form; titles that are empty or have none are left out."""
    keyed = titles.select("title", norm_title(F.col("title")).alias("_norm")).where("_norm <> ''")
    newest = posts.groupBy(norm_title(F.col("raw_title")).alias("_norm")).agg(F.max(F.struct("created_at", "id")).alias("_post"))
    return keyed.join(newest, "_norm").select("title", F.col("_post.id").alias("id"))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def preview(posts: DataFrame) -> DataFrame:
    """What is shown of a post: the rewritten title and text, else the raw ones."""
    return posts.select("id", F.coalesce("ai_title", "raw_title").alias("title"), F.coalesce("ai_text", "raw_description").alias("text"), F.coalesce("ai_hashtags", F.lit("")).alias("hashtags"))


def sanitize_posts(posts: DataFrame) -> DataFrame:
    """Stored rewrites without links, in paragraphs; null stays null."""
    return posts.withColumn("ai_title", F.when(F.col("ai_title").isNotNull(), strip_links(F.col("ai_title")))).withColumn("ai_text", F.when(F.col("ai_text").isNotNull(), format_post_text(F.col("ai_text"))))


def hint_posts(posts: DataFrame, **lists) -> DataFrame:
    """Unpublished posts whose raw or rewritten title is one of puzzle answers."""
    own = is_hint_content(F.col("raw_title"), F.col("source_url"), **lists) | is_hint_content(F.coalesce("ai_title", F.lit("")), F.col("source_url"), **lists)
    return posts.where((F.col("status") != "published") & own)


def unseen(items: DataFrame, ledger: DataFrame, posts: DataFrame) -> DataFrame:
    """Items whose address neither the ledger nor a post has, raw or normalised."""
    seen = ledger.select("normalized_url").unionByName(posts.select(norm_url(F.col("source_url")).alias("normalized_url"))).distinct()
    rest = items.withColumn("normalized_url", norm_url(F.col("link"))).join(seen, "normalized_url", "left_anti")
    return rest.join(posts.select(F.col("source_url").alias("link")).distinct(), "link", "left_anti").select(*items.columns)


def attach_kept(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """Groups by kept_post_id with the kept post; null where it is gone."""
    own = posts.select(F.col("id").alias("_id"), F.struct("id", "raw_title", "source_url", "status").alias("kept_post"))
    return groups.join(own, F.col("kept_post_id") == F.col("_id"), "left").drop("_id")


def standalone(posts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Posts that no duplicate record names as kept."""
    return posts.join(duplicates.where("kept_post_id is not null").select(F.col("kept_post_id").alias("id")).distinct(), "id", "left_anti")


def url_host(url: Column) -> Column:
    """The third part between slashes, in lower case."""
    return F.lower(F.get(F.split(url, "/"), F.lit(2)))


#: Characters of a host by which it is looked up in addresses.
GRAM = 4


def guess_source(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Posts with guessed_source_url: the first source of the post's category, else the first whose host stands anywhere
    in the post's address, else empty.

    Hosts meet addresses by an equi-join: each host is looked up by its rarest run of GRAM characters among those that
    the addresses of posts without a category have, and then held against the whole address.
    """
    by_category = sources.where("category_id is not null").groupBy(F.col("category_id").alias("_cat")).agg(F.min_by("url", "id").alias("_by_category"))
    out = posts.join(by_category, F.col("category_id") == F.col("_cat"), "left").drop("_cat")
    hosts = sources.select("id", "url", url_host(F.col("url")).alias("_host")).where("_host is not null and _host <> ''")
    hosts = hosts.groupBy("_host").agg(F.min(F.struct("id", "url")).alias("_source"))
    size = F.least(F.lit(GRAM), F.length("_host"))
    grams = hosts.select("_host", "_source", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_host") - size + 1), lambda i: F.substring("_host", i, size)))).alias("_gram"))
    often = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    keyed = grams.join(often, "_gram").groupBy("_host").agg(F.min_by(F.struct("_gram", "_source"), F.struct("_n", "_gram")).alias("_k")).select("_host", "_k._gram", "_k._source")
    open_posts = out.where("_by_category is null").select("id", F.lower("source_url").alias("_address"))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_address")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("_address", i, n)))))
    found = open_posts.where("_address <> ''").select("id", "_address", F.explode(runs).alias("_gram")).join(keyed, "_gram").where(F.contains("_address", "_host"))
    found = found.groupBy(F.col("id").alias("_id")).agg(F.min("_source").alias("_by_host"))
    out = out.join(found, F.col("id") == F.col("_id"), "left")
    return out.withColumn("guessed_source_url", F.coalesce("_by_category", "_by_host.url", F.lit(""))).drop("_by_category", "_by_host", "_id")
