"""The life of a post: claim, rewrite, approve, publish, forget; the publish order and plan; due times of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.similarity import norm_url
from newsloom.functions.text import format_hashtags, format_post_text, strip_links
from newsloom.operators.listing import PUBLISHABLE, QUEUE, next_batch
from newsloom.sources.store import Store
from newsloom.steps import cut_lineage


#: States from which a post can be approved.
APPROVABLE = ("new", "ai_processed")


def _null(posts: DataFrame, *names: str) -> dict:
    return {n: F.lit(None).cast(posts.schema[n].dataType) for n in names if n in posts.columns}


def _where(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts with `_hit`: whether ids has them."""
    own = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return posts.join(own, F.col("id") == F.col("_id"), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).drop("_id")


def _set(posts: DataFrame, test, values: dict) -> DataFrame:
    return posts.withColumns({k: F.when(test, v).otherwise(F.col(k)) for k, v in values.items()})


def claim(posts: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(posts with the n oldest new ones processing, those)."""
    batch = next_batch(posts, "new", n)
    marked = _where(posts, batch)
    return _set(marked, F.col("_hit") & (F.col("status") == "new"), {"status": F.lit("processing")}).drop("_hit"), batch


def release(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Claimed posts among ids are new again."""
    return _set(_where(posts, ids), F.col("_hit") & (F.col("status") == "processing"), {"status": F.lit("new")}).drop("_hit")


def recover(posts: DataFrame) -> DataFrame:
    """After a crash: whatever was processing is new."""
    return _set(posts, F.col("status") == "processing", {"status": F.lit("new")})


def apply_rewrites(posts: DataFrame, replies: DataFrame, auto_approve: bool = False) -> DataFrame:
    """Claimed posts (status processing) get their rewrite (id, title, text, hashtags, parse_path), cleaned; failed replies
    release them. A reply that comes when its post is no longer claimed changes nothing."""
    own = replies.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct("parse_path", "title", "text", "hashtags")).alias("_reply"))
    out = posts.join(own, F.col("id") == F.col("_id"), "left")
    claimed = F.col("_reply").isNotNull() & F.coalesce(F.col("status") == "processing", F.lit(False))
    good = claimed & (F.col("_reply.parse_path") != "failed")
    failed = claimed & (F.col("_reply.parse_path") == "failed")
    values = {"ai_title": strip_links(F.col("_reply.title")), "ai_text": format_post_text(F.col("_reply.text")), "ai_hashtags": format_hashtags(F.col("_reply.hashtags"))}
    out = _set(out, good, values)
    status = F.when(good, F.lit("approved" if auto_approve else "ai_processed")).when(failed, F.lit("new")).otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_id", "_reply")


def apply_publish(posts: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Posts after publishing: any success publishes, the other platform's failure stays as message; none fails.

    outcomes: post_id, platform (vk or telegram), success, response, message_id; one row for each post and platform.
    """
    wide = outcomes.groupBy(F.col("post_id").alias("_id")).agg(*[
        F.max(F.when(F.col("platform") == p, F.struct("success", "response", "message_id"))).alias(p) for p in ("vk", "telegram")
    ])
    out = posts.join(wide, F.col("id") == F.col("_id"), "left")
    vk, tg = (F.coalesce(F.col(f"{p}.success"), F.lit(False)) for p in ("vk", "telegram"))
    said = {p: F.coalesce(F.col(f"{p}.response"), F.lit("")) for p in ("vk", "telegram")}
    tried = F.col("_id").isNotNull()
    error = F.when(vk & tg, F.lit(None)).when(tg, F.concat(F.lit("VK: "), said["vk"])).when(vk, F.concat(F.lit("Telegram: "), said["telegram"])).otherwise(F.concat(F.lit("VK: "), said["vk"], F.lit("; TG: "), said["telegram"]))
    at = F.when(vk | tg, F.lit(as_of).cast("timestamp")).otherwise(F.col("published_at"))
    out = _set(out, tried, {"status": F.when(vk | tg, "published").otherwise("failed"), "error_message": error, "published_at": at})
    out = out.withColumn("vk_post_id", F.when(tried & vk, F.col("vk.message_id")).otherwise(F.col("vk_post_id"))).withColumn("telegram_message_id", F.when(tried & tg, F.col("telegram.message_id")).otherwise(F.col("telegram_message_id")))
    return out.drop("_id", "vk", "telegram")


def approve(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts among ids that wait for it, new or rewritten, are approved; those in any other state stay as they are."""
    return _set(_where(posts, ids), F.col("_hit") & F.col("status").isin(*APPROVABLE), {"status": F.lit("approved")}).drop("_hit")


def reset_raw(posts: DataFrame, updates: DataFrame) -> DataFrame:
    """Posts in updates (id, raw_title, raw_description) start anew: rewrite, errors and publication are cleared."""
    own = updates.select(F.col("id").alias("_id"), F.col("raw_title").alias("_t"), F.col("raw_description").alias("_d"))
    out = posts.join(own, F.col("id") == F.col("_id"), "left")
    values = {"raw_title": F.col("_t"), "raw_description": F.col("_d"), "status": F.lit("new")}
    return _set(out, F.col("_id").isNotNull(), values | _null(posts, "ai_title", "ai_text", "ai_hashtags", "error_message", "published_at", "vk_post_id", "telegram_message_id")).drop("_id", "_t", "_d")


def update_posts(posts: DataFrame, updates: DataFrame) -> DataFrame:
    """Non-null values of updates (id and any columns of posts) replace those of posts."""
    names = [c for c in updates.columns if c != "id"]
    own = updates.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in names])
    out = posts.join(own, F.col("id") == F.col("_id"), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in names}).drop("_id", *[f"_new_{c}" for c in names])


def apply_unpublish(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Withdrawn posts are approved again if they have a rewrite, else new."""
    values = {"status": F.when(F.col("ai_title").isNotNull(), "approved").otherwise("new")}
    return _set(_where(posts, ids), F.col("_hit"), values | _null(posts, "vk_post_id", "telegram_message_id", "published_at", "error_message")).drop("_hit")


def forget(store: Store, ids: DataFrame, run_id: str | None = None) -> None:
    """Deletes posts with their log rows, ledger rows (by normalised or raw address) and duplicate records (raw address).

    All of it or nothing (`Store.change`); of the posts only the buckets that lose some are written.
    """
    store.roll_forward()
    gone = cut_lineage(store.read("posts").join(ids.select("id").distinct(), "id", "left_semi").select("id", "source_url"))
    urls = gone.select(norm_url(F.col("source_url")).alias("normalized_url")).unionByName(gone.select(F.col("source_url").alias("normalized_url"))).distinct()
    kept = {
        "publish_log": store.read("publish_log").join(gone.select(F.col("id").alias("post_id")), "post_id", "left_anti"),
        "parsed_items": store.read("parsed_items").join(urls, "normalized_url", "left_anti"),
        "duplicate_records": store.read("duplicate_records").join(gone.select(F.col("source_url").alias("duplicate_url")).distinct(), "duplicate_url", "left_anti"),
    }
    store.change(run_id or f"forget-{uuid.uuid4().hex}", kept, {"posts": gone})


def delete_queue(store: Store, run_id: str | None = None) -> None:
    """Forgets every post of the queue."""
    forget(store, store.read("posts").where(F.col("status").isin(*QUEUE)).select("id"), run_id)


def next_publishable(posts: DataFrame) -> DataFrame:
    """One post: the newest publishable of another category than the last published; else the newest."""
    last = posts.where("status = 'published'").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(1).select(F.coalesce("category_id", F.lit(-1)).alias("_last"))
    own = posts.where(F.col("status").isin(*PUBLISHABLE))
    # A right join with one row: no row where nothing is published yet.
    ranked = own.join(F.broadcast(last), F.lit(True), "left")
    same = F.coalesce(F.coalesce("category_id", F.lit(-1)) == F.col("_last"), F.lit(False))
    return ranked.orderBy(same, F.desc("created_at"), F.desc("id")).limit(1).select(*posts.columns)


def publish_plan(posts: DataFrame, n: int, interval_minutes: int, jitter_seconds: tuple[int, int], start, seed: int = 0, channel: str = "channel") -> DataFrame:
    """(channel, slot, id, publish_at): n slots of each channel, each the next publishable post of what is left.

    A channel's order only depends on the n newest posts of each of its categories, so that is all that a task holds.
    publish_at: the interval and a jitter, drawn from seed and slot, after the slot before.
    """
    own = posts.where(F.col("status").isin(*PUBLISHABLE, "published")).withColumn("_cat", F.coalesce("category_id", F.lit(-1)))
    if channel not in posts.columns:
        own = own.withColumn(channel, F.lit("all"))
    newest = Window.partitionBy(channel, "_cat").orderBy(F.desc("created_at"), F.desc("id"))
    waiting = own.where("status <> 'published'").withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n)
    last = own.where("status = 'published'").groupBy(channel).agg(F.max_by("_cat", F.struct("published_at", "id")).alias("_last"))
    rows = waiting.join(last, channel, "left").select(channel, "id", "_cat", "created_at", "_last")
    low, high = min(jitter_seconds), max(jitter_seconds)
    kind = dict(rows.dtypes)[channel]

    def order(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["created_at", "id"], ascending=False, kind="stable")
        lines: dict = {}
        for row in pdf.itertuples(index=False):
            lines.setdefault(row[2], []).append((row[3], row[1]))
        last = pdf.iloc[0, 4]
        out = []
        while lines and len(out) < n:
            choice = [c for c in lines if pd.isna(last) or c != last] or list(lines)
            cat = max(choice, key=lambda c: lines[c][0])
            out.append((pdf.iloc[0, 0], len(out) + 1, lines[cat].pop(0)[1]))
            if not lines[cat]:
                del lines[cat]
            last = cat
        return pd.DataFrame(out, columns=[channel, "slot", "id"])

    plan = rows.groupBy(channel).applyInPandas(order, f"{channel} {kind}, slot int, id long")
    jitter = low + F.pmod(F.xxhash64(F.lit(seed), F.col("slot")), F.lit(high - low + 1))
    total = F.sum(max(1, interval_minutes) * 60 + jitter).over(Window.partitionBy(channel).orderBy("slot"))
    return plan.withColumn("publish_at", F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + total))


def due_sources(schedules: DataFrame, as_of) -> DataFrame:
    """Adds next_due to schedules (enabled, start_at text, repeat_unit, repeat_every, last_run).

    Before the start: the start. Never run: now. With a start: its next multiple of the period after now; without: the
    last run plus the period, or now if that is past. Days move on the calendar of the session's time zone. Disabled: null.
    """
    now = F.lit(as_of).cast("timestamp")
    every = F.greatest(F.coalesce("repeat_every", F.lit(1)), F.lit(1)).cast("int")
    text = F.trim(F.coalesce("start_at", F.lit("")))
    start = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d$"), F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")))
    seconds = every * F.when(F.col("repeat_unit") == "hours", 3600).otherwise(60)
    by_days = F.col("repeat_unit") == "days"
    periods = F.floor(F.greatest(F.unix_timestamp(now) - F.unix_timestamp(start), F.lit(0)) / seconds) + 1
    linear = F.timestamp_seconds(F.unix_timestamp(start) + periods * seconds)
    days = (F.floor(F.greatest(F.date_diff(F.to_date(now), F.to_date(start)), F.lit(0)) / every) + 1) * every
    daily = start + F.make_interval(days=days.cast("int"))
    anchored = F.when(by_days, daily).otherwise(linear)
    after = F.when(by_days, F.col("last_run") + F.make_interval(days=every)).otherwise(F.col("last_run") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    due = F.when(start.isNotNull() & (now < start), start).when(F.col("last_run").isNull(), now).when(start.isNotNull(), F.greatest(anchored, now)).otherwise(F.greatest(after, now))
    return schedules.withColumn("next_due", F.when(F.col("enabled"), due))
