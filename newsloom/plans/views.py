"""The library's tables derived from the given ones, by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("new", "processing", "ai_processed", "approved", "published", "failed", "new")

#: DuckDB: documents as posts, and what hangs on them.
SQL = """with posts as (
    select doc_id as id, 'https://' || source || '.example.com/doc/' || doc_id as source_url, regexp_extract(text, '^[^.!?\\n]*') as raw_title,
        trim(substr(text, length(regexp_extract(text, '^[^.!?\\n]*')) + 2)) as raw_description,
        case when substr(source, 4)::int % 10 = 9 then null else substr(source, 4)::int % 8 + 1 end::bigint as category_id,
        ['new', 'processing', 'ai_processed', 'approved', 'published', 'failed', 'new'][doc_id % 7 + 1] as status,
        case when doc_id % 7 in (2, 3, 4) then regexp_extract(text, '^[^.!?\\n]*') || ' update' end as ai_title,
        timestamp '2024-01-01' + to_minutes(doc_id) as created_at,
        case when doc_id % 7 = 4 then timestamp '2024-01-01' + to_minutes(doc_id) + interval 1 hour end as published_at, source
    from documents),
titles as (select *, trim(regexp_replace(lower(raw_title), '[^\\p{L}\\p{N}]+', ' ', 'g')) as norm from posts),
sources as (select distinct substr(source, 4)::bigint + 1 as id, 'https://' || source || '.example.com/feed' as url, source as name,
    case when substr(source, 4)::int % 10 = 9 then null else substr(source, 4)::int % 8 + 1 end::bigint as category_id, substr(source, 4)::int % 5 <> 0 as enabled from documents),
categories as (select unnest(range(1, 9))::bigint as id, unnest(['PC', 'Консоли', 'Мобильные', 'Киберспорт', 'Инди', 'Анонсы', 'Обзоры', 'Наука']) as name),
publish_log as (select event_id as id, event_id % (select count(*) from documents) as post_id, case when event_id % 2 = 0 then 'vk' else 'telegram' end as platform,
    event_type <> 'error' as success, ts as created_at, props as response from events),
ledger as (select distinct lower(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', '')) as normalized_url from pages where page_id % 2 = 0)
"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.substring("source", 4, 10).cast("int")
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 60)
    rest = F.col("doc_id") % 7
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), F.col("doc_id").cast("string")).alias("source_url"), title.alias("raw_title"),
        F.trim(F.substring("text", F.length(title) + 2, F.length("text"))).alias("raw_description"), F.lit(None).cast("string").alias("raw_image_url"),
        F.when(rest.isin(2, 3, 4), F.concat(title, F.lit(" update"))).alias("ai_title"), F.lit(None).cast("string").alias("ai_text"), F.lit(None).cast("string").alias("ai_hashtags"),
        F.when(number % 10 != 9, number % 8 + 1).cast("long").alias("category_id"), F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (rest + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("vk_post_id"), F.lit(None).cast("string").alias("telegram_message_id"), at.alias("created_at"),
        F.when(rest == 4, F.timestamp_seconds(F.unix_timestamp(at) + 3600)).alias("published_at"), F.lit(None).cast("string").alias("error_message"), "source",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("source", 4, 10).cast("int")
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    return own.select((number + 1).cast("long").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"), F.col("source").alias("name"), F.when(number % 10 != 9, number % 8 + 1).cast("long").alias("category_id"), (number % 5 != 0).alias("enabled"), F.lit(None).cast("timestamp").alias("last_fetched_at"))


def categories(spark: SparkSession) -> DataFrame:
    from newsloom.sources.store import SCHEMAS, SEED_CATEGORIES

    return spark.createDataFrame([(i, *row, True) for i, row in enumerate(SEED_CATEGORIES, 1)], SCHEMAS["categories"])


def publish_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return events.select(F.col("event_id").alias("id"), (F.col("event_id") % n).alias("post_id"), F.when(F.col("event_id") % 2 == 0, "vk").otherwise("telegram").alias("platform"), (F.col("event_type") != "error").alias("success"), F.col("props").alias("response"), F.col("ts").alias("created_at"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that have an embedding, which also stands for the title's."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return posts(spark, sf_dir).join(own, "id").withColumn("title_embedding", F.col("embedding"))
