"""Registered queries: listings, lookups, joins, counters, lifecycle and store writes over the derived posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.similarity import norm_title, norm_url
from newsloom.operators import dedup, lifecycle, listing, reports
from newsloom.plans import views
from newsloom.plans.registry import query
from newsloom.sources import pages as page_jobs
from newsloom.sources import store

S = views.SQL
AS_OF = "2024-01-01 12:00:00"
NORM_URL = "lower(regexp_replace(regexp_replace({}, '[?#].*', ''), '/+$', ''))"


@query(S + "select norm as title, count(*) as n, min(id) as first_id, max(id) as last_id from titles where norm <> '' group by norm")
def duplicate_title_groups(spark, sf_dir):
    own = views.posts(spark, sf_dir).select("id", norm_title(F.col("raw_title")).alias("title")).where("title <> ''")
    return own.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(S + f"select page_id, {NORM_URL.format('url')} as normalized_url from pages")
def normalized_urls(spark, sf_dir):
    return views.pages(spark, sf_dir).select("page_id", norm_url(F.col("url")).alias("normalized_url"))


@query(S + "select id, norm as normalized_title from titles")
def normalized_titles(spark, sf_dir):
    return views.posts(spark, sf_dir).select("id", norm_title(F.col("raw_title")).alias("normalized_title"))


@query(S + "select p.id, p.status, c.name as category_name from posts p left join categories c on c.id = p.category_id where p.status = 'approved'")
def list_posts(spark, sf_dir):
    return listing.list_posts(views.posts(spark, sf_dir), views.categories(spark), "approved").select("id", "status", "category_name")


@query(S + "select p.id, c.name as category_name from posts p left join categories c on c.id = p.category_id")
def posts_with_category(spark, sf_dir):
    return listing.with_category(views.posts(spark, sf_dir), views.categories(spark)).select("id", "category_name")


@query(S + "select id from posts where status = 'new' order by created_at, id limit 10")
def next_batch(spark, sf_dir):
    return listing.next_batch(views.posts(spark, sf_dir)).select("id")


@query(S + "select id, status from posts where status in ('new', 'processing', 'ai_processed', 'approved', 'failed')")
def queue(spark, sf_dir):
    return listing.queue(views.posts(spark, sf_dir)).select("id", "status")


@query(S + "select id, published_at from posts where status = 'published' order by published_at desc, id desc limit 5")
def recent_published(spark, sf_dir):
    return listing.recent_published(views.posts(spark, sf_dir)).select("id", "published_at")


@query(S + "select distinct p.raw_title as title, max(q.id) over (partition by q.norm) as id from posts p join titles q on q.norm = trim(regexp_replace(lower(p.raw_title), '[^\\p{L}\\p{N}]+', ' ', 'g')) where q.norm <> ''")
def find_by_title(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return listing.find_by_title(own, own.select(F.col("raw_title").alias("title")).distinct())


@query(S + "select p.id, p.raw_title from posts p where exists (select 1 from events e where e.event_type = 'error' and e.event_id = p.id)")
def find_by_id(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return listing.find_by_id(views.posts(spark, sf_dir), ids).select("id", "raw_title")


@query(S + "select id, created_at from posts where created_at >= timestamp '2024-01-01 12:00:00' - interval 30 day order by created_at desc, id desc limit 200")
def dedup_candidates(spark, sf_dir):
    return dedup.dedup_candidates(views.posts(spark, sf_dir), AS_OF).select("id", "created_at")


@query(S + "select id, url, category_id from sources where enabled")
def enabled_sources(spark, sf_dir):
    return listing.enabled_sources(views.sources(spark, sf_dir)).select("id", "url", "category_id")


@query(S + "select id, coalesce(ai_title, raw_title) as title, raw_description as text, '' as hashtags from posts")
def preview(spark, sf_dir):
    return listing.preview(views.posts(spark, sf_dir))


@query(S + f"select page_id as id, url as link from pages where page_id % 2 = 1 and {NORM_URL.format('url')} not in (select normalized_url from ledger)")
def unseen_items(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    ledger = own.where("page_id % 2 = 0").select(norm_url(F.col("url")).alias("normalized_url")).distinct()
    return listing.unseen(own.where("page_id % 2 = 1").select(F.col("page_id").alias("id"), F.col("url").alias("link")), ledger, views.posts(spark, sf_dir))


@query(S + "select id, (select coalesce(min_by(s.url, s.id) filter (where s.category_id = p.category_id), '') from sources s) as guessed_source_url from posts p where category_id is not null union all select id, (select coalesce(min_by(s.url, s.id) filter (where contains(lower(p.source_url), split_part(lower(s.url), '/', 3))), '') from sources s) from posts p where category_id is null")
def guess_source(spark, sf_dir):
    return listing.guess_source(views.posts(spark, sf_dir), views.sources(spark, sf_dir)).select("id", "guessed_source_url")


#: DuckDB: of each post the newest other post of equal normalised title.
EXACT = """, twin as (select t.id as new_id, max_by(o.id, (o.created_at, o.id)) as kept_id from titles t join titles o on o.norm = t.norm and o.id <> t.id where t.norm <> '' group by t.id),
kept as (select new_id, kept_id, coalesce(ai_title, raw_title) as kept_title from twin join posts on id = kept_id)
"""


@query(S + EXACT + "select new_id, kept_id, kept_title, 100 as confidence from kept")
def match_exact(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return dedup.match_exact(own, own).select("new_id", "kept_id", "kept_title", "confidence")


def _duplicates(spark, sf_dir):
    """Duplicate records: exact matches of the corpus with itself."""
    own = views.posts(spark, sf_dir)
    links = own.select(F.col("id").alias("new_id"), F.col("source_url").alias("link"), F.col("raw_title").alias("title"), F.col("raw_description").alias("description"), "created_at")
    matches = dedup.match_exact(own, own).join(links, "new_id")
    return store.record_duplicates(matches, AS_OF).withColumn("id", F.xxhash64("duplicate_url"))


@query(S + EXACT + "select t.source_url as duplicate_url, t.raw_title as duplicate_title, k.kept_id as kept_post_id, k.kept_title, 'exact' as reason, 100 as ai_confidence, true as ai_is_duplicate from kept k join posts t on t.id = k.new_id")
def record_duplicates(spark, sf_dir):
    return _duplicates(spark, sf_dir).select("duplicate_url", "duplicate_title", "kept_post_id", "kept_title", "reason", "ai_confidence", "ai_is_duplicate")


@query(S + EXACT + "select k.kept_id as kept_post_id, count(*) as n, list_sort(list(t.source_url)) as urls from kept k join posts t on t.id = k.new_id group by k.kept_id")
def duplicate_groups(spark, sf_dir):
    return reports.duplicate_groups(_duplicates(spark, sf_dir), columns=("duplicate_url",)).select("kept_post_id", "n", F.array_sort("records.duplicate_url").alias("urls"))


@query(S + EXACT + "select count(distinct kept_id) as kept, count(*) as duplicates from kept")
def duplicates_overview_counts(spark, sf_dir):
    return reports.duplicates_overview(views.posts(spark, sf_dir), _duplicates(spark, sf_dir))[0]


@query(S + EXACT + "select id from posts where id not in (select kept_id from kept)")
def duplicates_overview_standalone(spark, sf_dir):
    return listing.standalone(views.posts(spark, sf_dir), _duplicates(spark, sf_dir)).select("id")


@query(S + EXACT + ", d as (select kept_id, count(*) as n from kept group by kept_id) select d.kept_id as kept_post_id, d.n, p.raw_title as kept_raw_title, p.status as kept_status from d join posts p on p.id = d.kept_id")
def duplicate_groups_with_kept(spark, sf_dir):
    groups = listing.attach_kept(reports.duplicate_groups(_duplicates(spark, sf_dir)), views.posts(spark, sf_dir))
    return groups.select("kept_post_id", "n", F.col("kept_post.raw_title").alias("kept_raw_title"), F.col("kept_post.status").alias("kept_status"))


@query(S + "select status, count(*) as posts from posts group by status")
def count_by_status(spark, sf_dir):
    return reports.count_by_status(views.posts(spark, sf_dir))


@query(
    S + EXACT + """select count(*) filter (where created_at::date = date '2024-01-01') as posts_today, count(*) filter (where status in ('new', 'processing', 'ai_processed', 'approved')) as posts_pending,
    count(*) filter (where status = 'published') as posts_published, count(*) filter (where status = 'new') as posts_waiting_ai, count(*) filter (where status = 'processing') as posts_processing_ai,
    count(*) filter (where status = 'ai_processed') as posts_ai_processed, count(*) filter (where status = 'approved') as posts_approved, (select count(*) from sources where enabled) as sources_active,
    (select count(*) from kept) as duplicates_total, (select max(ts) from events) as last_fetch_at from posts"""
)
def dashboard(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("fetch").alias("kind"), F.col("ts").alias("at"))
    return reports.dashboard_of(views.posts(spark, sf_dir), views.sources(spark, sf_dir), _duplicates(spark, sf_dir), runs, AS_OF)


@query("select user_id as run_id, count(*) filter (where event_type = 'view') as scanned, count(*) filter (where event_type = 'error') as error, count(*) as n from events group by user_id")
def funnel(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    outcome = F.when(F.col("event_type") == "view", "scanned").when(F.col("event_type") == "error", "error").otherwise("new")
    own = events.select(F.col("user_id").alias("run_id"), outcome.alias("outcome"), F.lit(None).cast("string").alias("error"))
    return reports.funnel(own).select("run_id", "scanned", "error", (F.col("scanned") + F.col("error") + F.col("new")).alias("n"))


@query(S + "select id, platform, success from publish_log order by created_at desc, id desc limit 100")
def publish_history(spark, sf_dir):
    return reports.publish_history(views.publish_log(spark, sf_dir)).select("id", "platform", "success")


@query(S + "select platform, success, count(*) as n, max(created_at) as latest from publish_log group by all")
def publish_outcomes(spark, sf_dir):
    return reports.publish_outcomes(views.publish_log(spark, sf_dir))


@query(S + ", last as (select coalesce(category_id, -1) as c from posts where status = 'published' order by published_at desc, id desc limit 1) select id, category_id from posts where status in ('ai_processed', 'approved') order by coalesce(coalesce(category_id, -1) = (select c from last), false), created_at desc, id desc limit 1")
def next_publishable(spark, sf_dir):
    return lifecycle.next_publishable(views.posts(spark, sf_dir)).select("id", "category_id")


#: What the seed 3 draws for the six slots, in seconds.
JITTER = (5, 295, 131, 33, 122, 52)


@query(S + f""", w as (select *, row_number() over (partition by source order by created_at desc, id desc)::int as slot from posts where status in ('ai_processed', 'approved')),
    j as (select unnest(range(1, 7))::int as slot, unnest({list(JITTER)}) as more) -- a source has one category, so nothing alternates
    select source, slot, id, timestamp '{AS_OF}' + to_seconds(sum(1800 + more) over (partition by source order by slot)) as publish_at from w join j using (slot)""")
def publish_plan(spark, sf_dir):
    return lifecycle.publish_plan(views.posts(spark, sf_dir), 6, 30, (0, 300), AS_OF, seed=3, channel="source")


@query((S + f""", w as (select id, coalesce(category_id, -1) as cat, created_at, 'c' || (id % 3) as channel from posts where status in ('ai_processed', 'approved')),
    last as (select 'c' || (id % 3) as channel, max_by(coalesce(category_id, -1), (published_at, id)) as cat from posts where status = 'published' group by 1),
    walk(channel, slot, used, cat) as (select c.channel, 0, []::bigint[], l.cat from (select distinct channel from w) c left join last l using (channel)
        union all select k.channel, k.slot + 1, list_append(any_value(k.used), max_by(w.id, (coalesce(w.cat <> k.cat, true), w.created_at, w.id))), max_by(w.cat, (coalesce(w.cat <> k.cat, true), w.created_at, w.id))
        from walk k join w on w.channel = k.channel and not list_contains(k.used, w.id) where k.slot < 6 group by k.channel, k.slot),
    j as (select unnest(range(1, 7))::int as slot, unnest({list(JITTER)}) as more)
    select channel, walk.slot, used[walk.slot] as id, timestamp '{AS_OF}' + to_seconds(sum(1800 + more) over (partition by channel order by slot)) as publish_at from walk join j using (slot)""").replace("with ", "with recursive ", 1))
def publish_plan_alternating(spark, sf_dir):
    """Channels of several categories, which take turns."""
    own = views.posts(spark, sf_dir).withColumn("channel", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")))
    return lifecycle.publish_plan(own, 6, 30, (0, 300), AS_OF, seed=3)


@query(S + "select id, case when id in (select id from posts where status = 'new' order by created_at, id limit 10) then 'processing' else status end as status from posts")
def claim(spark, sf_dir):
    return lifecycle.claim(views.posts(spark, sf_dir))[0].select("id", "status")


@query(S + "select id, case when status = 'processing' and id % 2 = 0 then 'new' else status end as status from posts")
def release(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return lifecycle.release(own, own.where("id % 2 = 0").select("id")).select("id", "status")


@query(S + "select id, case when status = 'processing' then 'new' else status end as status from posts")
def recover(spark, sf_dir):
    return lifecycle.recover(views.posts(spark, sf_dir)).select("id", "status")


@query(S + "select id, case when id % 3 = 0 and status in ('new', 'ai_processed') then 'approved' else status end as status from posts")
def approve(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return lifecycle.approve(own, own.where("id % 3 = 0").select("id")).select("id", "status")


@query(S + "select id, case when id % 3 = 0 then 'again: ' || raw_title else raw_title end as raw_title, case when id % 3 = 0 then null else ai_title end as ai_title, case when id % 3 = 0 then null else published_at end as published_at, case when id % 3 = 0 then 'new' else status end as status from posts")
def reset_raw(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return lifecycle.reset_raw(own, own.where("id % 3 = 0").select("id", F.concat(F.lit("again: "), "raw_title").alias("raw_title"), "raw_description")).select("id", "raw_title", "ai_title", "published_at", "status")


@query(S + "select id, case when id % 5 = 0 then 'http://img/' || id end as raw_image_url, case when id % 10 = 0 then 'edited' else ai_title end as ai_title from posts")
def update_posts(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    edits = own.where("id % 5 = 0").select("id", F.concat(F.lit("http://img/"), F.col("id").cast("string")).alias("raw_image_url"), F.when(F.col("id") % 10 == 0, "edited").alias("ai_title"))
    return lifecycle.update_posts(own, edits).select("id", "raw_image_url", "ai_title")


@query(S + "select id, case when status <> 'published' then status when ai_title is not null then 'approved' else 'new' end as status, null::timestamp as published_at from posts")
def apply_unpublish(spark, sf_dir):
    own = views.posts(spark, sf_dir)
    return lifecycle.apply_unpublish(own, own.where("status = 'published'").select("id")).select("id", "status", "published_at")


OUTCOME = """, o as (select post_id, bool_or(success) filter (where platform = 'vk') as vk, bool_or(success) filter (where platform = 'telegram') as tg from publish_log group by post_id)
"""


@query(S + OUTCOME + """select id, case when o.post_id is null then status when coalesce(vk, false) or coalesce(tg, false) then 'published' else 'failed' end as status,
    case when o.post_id is null or (coalesce(vk, false) and coalesce(tg, false)) then null when coalesce(tg, false) then 'VK: r' when coalesce(vk, false) then 'Telegram: r' else 'VK: r; TG: r' end as error_message
    from posts left join o on o.post_id = id""")
def apply_publish(spark, sf_dir):
    log = views.publish_log(spark, sf_dir).groupBy("post_id", "platform").agg(F.bool_or("success").alias("success"))
    platforms = log.select("post_id").distinct().withColumn("platform", F.explode(F.array(F.lit("vk"), F.lit("telegram"))))
    own = platforms.join(log, ["post_id", "platform"], "left").withColumn("response", F.lit("r")).withColumn("message_id", F.col("post_id").cast("string"))
    return lifecycle.apply_publish(views.posts(spark, sf_dir), own.withColumn("success", F.coalesce("success", F.lit(False))), AS_OF).select("id", "status", "error_message")


@query(S + "select lower(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', '')) as normalized_url, min(url) as source_url from pages where lower(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', '')) not in (select normalized_url from ledger) group by 1")
def record_seen(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    ledger = own.where("page_id % 2 = 0").select(norm_url(F.col("url")).alias("normalized_url")).distinct()
    return store.record_seen(ledger, own.select(F.col("url").alias("link"), F.lit("").alias("title")), AS_OF).select("normalized_url", "source_url")


@query(S + "select lower(source_url) as normalized_url, source_url from posts")
def seen_from_posts(spark, sf_dir):
    own = views.posts(spark, sf_dir).withColumn("normalized_title", norm_title(F.col("raw_title")))
    return store.seen_from_posts(spark.createDataFrame([], store.SCHEMAS["parsed_items"]), own).select("normalized_url", "source_url")


@query("select url as source_url, min(html) as raw_title, 'new' as status from pages where page_id % 2 = 1 and url not in (select url from pages where page_id % 2 = 0) group by url")
def insert_new_posts(spark, sf_dir):
    own = views.pages(spark, sf_dir)
    there = own.where("page_id % 2 = 0").select(F.col("url").alias("source_url"))
    items = own.where("page_id % 2 = 1").select(F.col("html").alias("title"), F.lit("").alias("description"), F.col("url").alias("link"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("long").alias("category_id"))
    return store.insert_new_posts(there, items, AS_OF)[0].select("source_url", "raw_title", "status")


@query(S + "select post_id, platform, success from publish_log")
def record_publish(spark, sf_dir):
    return store.record_publish(views.publish_log(spark, sf_dir), AS_OF).select("post_id", "platform", "success")


@query("select user_id as source_id, max(ts) as at from events group by user_id")
def last_source_runs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.lit("r").alias("run_id"), F.lit("fetch").alias("kind"), F.col("user_id").alias("source_id"), F.col("ts").alias("at"))
    sources = events.select(F.col("user_id").alias("id")).distinct().withColumn("last_fetched_at", F.lit(None).cast("timestamp"))
    return store.touch_sources(sources, runs).select(F.col("id").alias("source_id"), F.col("last_fetched_at").alias("at"))


@query("select event_type as kind, max(event_id)::varchar as run_id, max(ts) as at from (select event_type, ts, event_id, row_number() over (partition by event_type order by ts desc, event_id::varchar desc) as r from events) where r = 1 group by event_type")
def last_run(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return store.last_run(events.select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("run_id"), F.lit(None).cast("long").alias("source_id"), F.col("ts").alias("at")))


@query("with f as (select sha256(html) as digest, count(*) as copies, min(page_id) as first_page from pages group by 1) select * from f")
def dedup_binaries(spark, sf_dir):
    own = views.pages(spark, sf_dir).select(F.col("html").cast("binary").alias("content"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), F.octet_length("html").alias("length"))
    return page_jobs.dedup_binaries(own).select("digest", "copies", F.col("path").cast("long").alias("first_page"))


@query(S + "select id, case when id % 4 = 0 then upper(name) else name end as name from sources union all select 1000 + id, 'added' from sources where id % 4 = 1")
def upsert_sources(spark, sf_dir):
    own = views.sources(spark, sf_dir)
    rows = own.where("id % 4 = 0").withColumn("name", F.upper("name")).unionByName(own.where("id % 4 = 1").withColumn("id", F.col("id") + 1000).withColumn("name", F.lit("added")))
    return store.upsert_dim(own, rows).select("id", "name")


@query(S + "select url || '/2' as url, (select id from categories where name = 'PC') as category_id from sources where id % 2 = 0")
def add_presets(spark, sf_dir):
    own = views.sources(spark, sf_dir)
    presets = own.where("id % 2 = 0").select(F.concat("url", F.lit("/2")).alias("url"), "name", F.lit("PC").alias("category")).unionByName(own.select("url", "name", F.lit("PC").alias("category")))
    return store.add_presets(own, presets, views.categories(spark)).select("url", "category_id")


@query(S + "select 's' || (id % 3) as kind, case when id % 3 = 0 then 'x/' || url else url end as url from sources")
def feed_aliases(spark, sf_dir):
    from newsloom.sources.feeds import apply_feed_aliases

    own = views.sources(spark, sf_dir)
    aliases = own.where("id % 3 = 0").select("url", F.concat(F.lit("x/"), "url").alias("target"))
    return apply_feed_aliases(own.withColumn("kind", F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))), aliases).select("kind", "url")


#: DuckDB: events as schedules of three units, with and without a start, some disabled, some never run, some yet to start.
SCHEDULES = """with s as (select event_id as id, event_id % 5 <> 0 as enabled, case when event_id % 17 <> 0 then ts end as last_run,
    case event_id % 4 when 0 then 'minutes' when 2 then 'days' else 'hours' end as unit, case when event_id % 4 = 0 then 30 else 1 end * (event_id % 7 + 1) as every,
    case when event_id % 4 >= 2 then date_trunc('minute', ts + to_hours(case when event_id % 13 = 0 then 2000 else -50 end)) end as start, timestamp '2024-01-15 06:30:00' as now from events),
t as (select *, every * case unit when 'hours' then 3600 when 'minutes' then 60 end as seconds from s),
d as (select *, case when unit = 'days' then start + to_days(((floor(greatest(date_diff('day', start::date, now::date), 0) / every) + 1) * every)::int)
        else start + to_seconds((floor(greatest(epoch(now) - epoch(start), 0) / seconds) + 1) * seconds) end as anchored,
    case when unit = 'days' then last_run + to_days(every::int) else last_run + to_seconds(seconds) end as after from t)
"""


@query(SCHEDULES + "select id, case when not enabled then null when start is not null and now < start then start when last_run is null then now when start is not null then greatest(anchored, now) else greatest(after, now) end as next_due from d")
def due_sources(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    start = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.when(n % 13 == 0, 2000).otherwise(-50)), "yyyy-MM-dd'T'HH:mm")
    own = events.select(
        n.alias("id"), (n % 5 != 0).alias("enabled"), F.when(n % 4 >= 2, start).otherwise("").alias("start_at"), F.when(n % 4 == 0, "minutes").when(n % 4 == 2, "days").otherwise("hours").alias("repeat_unit"),
        (F.when(n % 4 == 0, 30).otherwise(1) * (n % 7 + 1)).cast("int").alias("repeat_every"), F.when(n % 17 != 0, F.col("ts")).alias("last_run"),
    )
    return lifecycle.due_sources(own, "2024-01-15 06:30:00").select("id", "next_due")
