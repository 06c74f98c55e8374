"""Registered queries: a store filled from the derived tables, what its jobs leave of it, and the streams over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.similarity import norm_url
from newsloom.operators import lifecycle, reports
from newsloom.plans import views
from newsloom.plans.ingest import ingest as ingest_run
from newsloom.plans.queries_core import EXACT, NORM_URL, _duplicates
from newsloom.plans.queries_text import EDGES, _feed_docs, _first_come, _recursive
from newsloom.plans.registry import ORACLES, query
from newsloom.sources import store as st
from newsloom.steps import new_dir
from newsloom.streaming import jobs

S = views.SQL
AS_OF = "2024-01-01 12:00:00"
TABLES = ("posts", "publish_log", "parsed_items", "duplicate_records", "sources")


def _store(spark) -> st.Store:
    return st.Store(spark, new_dir(spark, "store"))


def _filled(spark, sf_dir) -> st.Store:
    """A store with the derived posts, sources, publish log, ledger and duplicate records."""
    own = _store(spark)
    posts = views.posts(spark, sf_dir)
    own.write("posts", posts)
    own.write("sources", views.sources(spark, sf_dir))
    own.write("publish_log", views.publish_log(spark, sf_dir))
    own.write("parsed_items", st.seen_from_posts(own.read("parsed_items"), posts.withColumn("normalized_title", F.lit(""))))
    own.write("duplicate_records", _duplicates(spark, sf_dir))
    return own


def _sizes(own: st.Store) -> DataFrame:
    """(name, n, total): rows of each table, and the sum of what tells them apart."""
    total = {"posts": F.sum("id"), "publish_log": F.sum(F.col("id") * 7 + F.col("post_id")), "parsed_items": F.sum(F.length("normalized_url")), "duplicate_records": F.sum(F.col("kept_post_id") * 3 + F.length("duplicate_url")), "sources": F.sum("id")}
    parts = [own.read(t).agg(F.count("*").alias("n"), F.coalesce(total[t], F.lit(0)).cast("long").alias("total")).select(F.lit(t).alias("name"), "n", "total") for t in TABLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _left(gone: str) -> str:
    """DuckDB: the sizes of the tables without the posts of a condition, and what hangs on them."""
    sizes = [
        f"select 'posts' as name, count(*) as n, sum(id) as total from posts where not ({gone})", f"select 'publish_log', count(*), sum(id * 7 + post_id) from publish_log where post_id not in (select id from posts where {gone})",
        f"select 'parsed_items', count(*), sum(length(source_url)) from posts where not ({gone})", f"select 'duplicate_records', count(*), sum(kept_id * 3 + length(source_url)) from kept join posts on id = new_id where not ({gone})",
        "select 'sources', count(*), sum(id) from sources",
    ]
    return S + EXACT + "select name, n, coalesce(total, 0)::bigint as total from (" + " union all ".join(sizes) + ")"


@query(_left("id % 5 = 0"))
def forget(spark, sf_dir):
    own = _filled(spark, sf_dir)
    lifecycle.forget(own, own.read("posts").where("id % 5 = 0").select("id"))
    return _sizes(own)


@query(_left("status in ('new', 'processing', 'ai_processed', 'approved', 'failed')"))
def delete_queue(spark, sf_dir):
    own = _filled(spark, sf_dir)
    lifecycle.delete_queue(own)
    return _sizes(own)


@query(_left("false"))
def restore_snapshot(spark, sf_dir):
    """What a snapshot gives back after the tables have been emptied."""
    own, path = _filled(spark, sf_dir), new_dir(spark, "snapshot")
    st.export_snapshot(own, path)
    st.purge(own)
    st.restore_snapshot(own, path)
    return _sizes(own)


@query(S + "select 'sources' as name, count(*) as n, sum(id)::bigint as total from sources union all select unnest(['posts', 'publish_log', 'parsed_items', 'duplicate_records']), 0, 0")
def purge(spark, sf_dir):
    own = _filled(spark, sf_dir)
    st.purge(own)
    return _sizes(own)


@query(S + "select url, name, category_id from sources union all select url, name, (select id from categories c where c.name = p.category) from (values " + ", ".join(f"('{n}', '{u}', '{c}')" for n, u, c, _ in st.PRESET_SOURCES) + ") p(name, url, category)")
def seed_dims(spark, sf_dir):
    own = _store(spark)
    own.write("sources", views.sources(spark, sf_dir))
    st.seed_dims(own)
    st.seed_dims(own)
    return own.read("sources").select("url", "name", "category_id")


@query(
    S + EXACT + """, q as (select count(*) filter (where status in ('new', 'processing', 'ai_processed', 'approved', 'failed')) as queue_size, count(*) filter (where status = 'new') as posts_waiting_ai, count(*) filter (where status = 'published') as posts_published from posts),
    run as (select user_id from events order by ts desc, user_id::varchar desc limit 1), o as (select count(*) filter (where event_type = 'view') as scanned, count(*) filter (where event_type = 'error') as error from events where user_id = (select user_id from run)),
    last as (select coalesce(category_id, -1) as c from posts where status = 'published' order by published_at desc, id desc limit 1)
    select queue_size, posts_waiting_ai, posts_published, (select count(*) from kept) as duplicates_total, scanned, error,
    (select id from posts where status in ('ai_processed', 'approved') order by coalesce(coalesce(category_id, -1) = (select c from last), false), created_at desc, id desc limit 1) as next_post_id from q, o"""
)
def automation_status(spark, sf_dir):
    own = _filled(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("ts").alias("at"))
    own.write("runs", runs.withColumn("kind", F.lit("fetch")).withColumn("source_id", F.lit(None).cast("long")))
    outcome = F.when(F.col("event_type") == "view", "scanned").when(F.col("event_type") == "error", "error").otherwise("new")
    outcomes = events.select(F.col("user_id").cast("string").alias("run_id"), outcome.alias("outcome"), F.lit(None).cast("string").alias("error"))
    return reports.automation_status(own, outcomes, AS_OF).select("queue_size", "posts_waiting_ai", "posts_published", "duplicates_total", "scanned", "error", "next_post_id")


def _feeds(spark, sf_dir) -> tuple[st.Store, DataFrame]:
    """A store that knows the sources, and their feeds; every ninth document is cut off in the middle."""
    own = _store(spark)
    own.write("sources", views.sources(spark, sf_dir))
    docs = _feed_docs(spark, sf_dir)
    cut = F.when(F.col("part") % 9 == 8, F.substring("xml", F.lit(1), F.length("xml") - 12)).otherwise(F.col("xml"))
    return own, docs.select(F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("feed_url"), F.lit("rss").alias("kind"), cut.alias("xml"))


@query(S + """, item as (select *, row_number() over (partition by source, id // 200 order by id) as r from posts), docs as (select source, id // 200 as part, (r - 1) // 10 as doc, count(*) as n from item group by all)
    select case when part % 9 = 8 then 'malformed document' when substr(source, 4)::int % 5 = 0 then 'no enabled source' end as error, count(*) as documents from docs where part % 9 = 8 and substr(source, 4)::int % 5 <> 0 or substr(source, 4)::int % 5 = 0 group by 1""".replace("when part % 9 = 8 then 'malformed document' when substr(source, 4)::int % 5 = 0 then 'no enabled source'", "when substr(source, 4)::int % 5 = 0 then 'no enabled source' else 'malformed document'"))
def feed_errors(spark, sf_dir):
    """Documents that make no items, each with its reason."""
    from newsloom.plans.ingest import feed_errors as errors

    own, docs = _feeds(spark, sf_dir)
    return errors(docs, own.read("sources")).groupBy("error").agg(F.count("*").alias("documents"))


@query()
def ingest(spark, sf_dir):
    """The funnel of one run over all feeds and pages. No SQL: ids by which equal times are ordered are hashes that DuckDB lacks."""
    own, docs = _feeds(spark, sf_dir)
    return ingest_run(own, docs, views.pages(spark, sf_dir), AS_OF, "r1", limit=50, puzzles=["thing"], phrases=["idiot"]).funnel


# streams


def _arriving(spark, df: DataFrame, files: int, by: str) -> DataFrame:
    """The rows as a stream of so many files, one a micro-batch."""
    path = new_dir(spark, "arriving")
    df.repartition(files, by).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(S + f"select distinct {NORM_URL.format('url')} as normalized_url from pages where {NORM_URL.format('url')} not in (select normalized_url from ledger)")
def stream_unseen(spark, sf_dir):
    """Pages that arrive in four micro-batches, against a ledger that has those of even number."""
    own = _store(spark)
    pages = views.pages(spark, sf_dir).select(F.col("url").alias("link"), F.lit("").alias("title"), F.lit(AS_OF).cast("timestamp").alias("seen_at"))
    even = views.pages(spark, sf_dir).where("page_id % 2 = 0").select(F.col("url").alias("link"), F.lit("").alias("title"))
    own.append("parsed_items", st.record_seen(own.read("parsed_items"), even, AS_OF))
    out = new_dir(spark, "unseen")
    jobs.stream_unseen_ledger(_arriving(spark, pages, 4, "link"), own, AS_OF, new_dir(spark, "checkpoint"), out).awaitTermination()
    return spark.read.schema(pages.schema).parquet(out).select(norm_url(F.col("link")).alias("normalized_url"))


@query("select user_id as run_id, event_type as outcome, count(*) as n from events group by all")
def stream_funnel(spark, sf_dir):
    """Events that arrive in three micro-batches; what the counts are after the last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("outcome"), "event_id")
    path = new_dir(spark, "counts")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id:06d}")

    counts = jobs.stream_funnel(_arriving(spark, events, 3, "event_id"))
    run = counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", new_dir(spark, "checkpoint")).trigger(**jobs.trigger(None)).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    return spark.read.parquet(f"{path}/{last:06d}")


@query(_recursive(EDGES + _first_come("posts", "m") + " select id from done where list_contains(kept, id)"))
def stream_dedup(spark, sf_dir):
    """All posts as one micro-batch over an empty store: those kept are what first-come keeps of the corpus."""
    own = _store(spark)
    posts = st.conform(views.posts(spark, sf_dir), "posts").withColumn("status", F.lit("new"))
    jobs.stream_dedup(_arriving(spark, posts, 1, "id"), own, AS_OF, new_dir(spark, "checkpoint"), days=0).awaitTermination()
    return own.read("posts").select("id")


@query("select 'https://' || source || '.example.com/doc/' || doc_id as link, m.kept_id, m.reason from (" + ORACLES["dedup_batch"] + ") m join documents on doc_id = m.id where m.reason is not null")
def stream_dedup_indexed(spark, sf_dir):
    """Posts of odd number as a micro-batch over a store with those of even number, which its index of titles finds; the
    duplicates that are recorded."""
    own = _store(spark)
    posts = st.conform(views.posts(spark, sf_dir), "posts")
    own.write("posts", posts.where("id % 2 = 0"))
    arriving = _arriving(spark, posts.where("id % 2 = 1"), 1, "id")
    jobs.stream_dedup(arriving, own, AS_OF, new_dir(spark, "checkpoint"), days=0).awaitTermination()
    return own.read("duplicate_records").select(F.col("duplicate_url").alias("link"), F.col("kept_post_id").alias("kept_id"), "reason")


@query(S + "select id, case when id in (select id from posts where status = 'new' order by created_at, id limit 60) then 'processing' else status end as status from posts")
def stream_queue(spark, sf_dir):
    """Three ticks, each of which claims the twenty oldest new posts."""
    own = _store(spark)
    own.write("posts", views.posts(spark, sf_dir))
    ticks = _arriving(spark, spark.range(3).select(F.col("id").alias("value")), 3, "value")
    jobs.stream_queue(spark, own, "{title}", new_dir(spark, "prompts"), new_dir(spark, "checkpoint"), 20, ticks=ticks).awaitTermination()
    return own.read("posts").select("id", "status")


@query()
def stream_ingest(spark, sf_dir):
    """The same feeds as `ingest`, as they arrive; the posts that the store ends with."""
    own, docs = _feeds(spark, sf_dir)
    path = new_dir(spark, "feeds")
    docs.repartition(2, "feed_url").write.parquet(path)
    jobs.stream_ingest(spark, path, own, views.pages(spark, sf_dir), AS_OF, new_dir(spark, "checkpoint"), limit=50).awaitTermination()
    return own.read("posts").select("source_url", "raw_title", "status")
