"""The store, lifecycle, ingest and the streams, end to end on a few rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.operators import lifecycle, listing, reports
from newsloom.plans.ingest import ingest
from newsloom.sources import store as st
from newsloom.streaming import jobs

AS_OF = "2024-06-01 12:00:00"
TEXT = "Some plain sentence about the story that is long enough to be kept by the gate of items, number "


@pytest.fixture()
def store(spark, tmp_path):
    own = st.Store(spark, str(tmp_path / "store"))
    st.seed_dims(own)
    return own


def rss(*items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><description>{d}</description></item>" for t, u, d in items)
    return f"<rss><channel>{body}</channel></rss>"


FEED = "https://www.pcgamer.com/rss/"


def docs(spark, *items):
    return spark.createDataFrame([(FEED, "rss", rss(*items))], jobs.FEED_DOCS)


def pages(spark):
    return spark.createDataFrame([("http://x/none", "<p></p>")], "url string, html string")


def test_seeds_once(store):
    st.seed_dims(store)
    assert store.read("categories").count() == 8 and store.read("sources").count() == 11
    assert store.read("sources").where("category_id is null").count() == 0


def test_ingest_and_lifecycle(spark, store, tmp_path):
    items = [
        ("Rocket launch delayed after engine fault", "http://n/1", TEXT + "1."),
        ("Rocket launch delayed after engine fault today", "http://n/2", TEXT + "2."),
        ("Quiet day at the market", "http://n/3/", TEXT + "3."),
        ("Daily wordle answer", "http://n/4", TEXT + "4."),
        ("Quiet day at the market", "http://n/3?x", TEXT + "5."),
    ]
    run = ingest(store, docs(spark, *items), pages(spark), AS_OF, "r1")
    line = run.funnel.first().asDict()
    assert (line["scanned"], line["rejected"], line["duplicate"], line["new"], line["seen"]) == (5, 1, 1, 2, 1)
    posts = store.read("posts")
    assert posts.count() == 2 and {r.status for r in posts.collect()} == {"new"}
    again = ingest(store, docs(spark, *items), pages(spark), AS_OF, "r2").funnel.first()
    assert again.new == 0 and again.seen == 4
    assert store.read("duplicate_records").count() == 1 and store.read("parsed_items").count() == 3
    status = reports.automation_status(store, spark.createDataFrame([("r2", "seen", None)], "run_id string, outcome string, error string"), AS_OF).first()
    assert status.queue_size == 2 and status.posts_today == 2 and status.seen == 1

    marked, batch = lifecycle.claim(store.read("posts"), 5)
    store.write("posts", marked)
    assert batch.count() == 2
    ids = [r.id for r in store.read("posts").orderBy("id").collect()]
    replies = spark.createDataFrame([(ids[0], "strict", "New title", "Fresh text. Read more", ["a"]), (ids[1], "failed", "", "", [])], "id long, parse_path string, title string, text string, hashtags array<string>")
    store.write("posts", lifecycle.apply_rewrites(store.read("posts"), replies, True))
    got = {r.id: (r.status, r.ai_title, r.ai_text, r.ai_hashtags) for r in store.read("posts").collect()}
    assert got == {ids[0]: ("approved", "New title", "Fresh text.", "#a"), ids[1]: ("new", None, None, None)}
    assert lifecycle.next_publishable(store.read("posts")).first().id == ids[0]
    outcomes = spark.createDataFrame([(ids[0], "vk", True, "ok", "7"), (ids[0], "telegram", False, "down", None)], "post_id long, platform string, success boolean, response string, message_id string")
    store.write("posts", lifecycle.apply_publish(store.read("posts"), outcomes, AS_OF))
    store.append("publish_log", st.record_publish(outcomes, AS_OF))
    done = store.read("posts").where(F.col("id") == ids[0]).first()
    assert (done.status, done.error_message, done.vk_post_id) == ("published", "Telegram: down", "7")

    st.export_snapshot(store, str(tmp_path / "snap"))
    lifecycle.forget(store, spark.createDataFrame([(ids[0],)], "id long"))
    assert [r.id for r in store.read("posts").collect()] == [ids[1]] and store.read("publish_log").count() == 0
    lifecycle.delete_queue(store)
    assert store.read("posts").count() == 0
    st.restore_snapshot(store, str(tmp_path / "snap"))
    assert store.read("posts").count() == 2 and store.read("publish_log").count() == 2
    st.purge(store)
    assert store.read("posts").count() == 0 and store.read("sources").count() == 11
    with pytest.raises(Exception):
        st.restore_snapshot(store, str(tmp_path / "nowhere"))


def state(store):
    """What a store holds, but for the order of rows."""
    return {name: sorted(map(repr, store.read(name).drop("ai_checked_at").collect())) for name in st.SCHEMAS}


class Failing(st.Store):
    """Fails at the n-th change of a table, after or before it."""

    def __init__(self, spark, path, n, after):
        super().__init__(spark, path)
        self.left, self.after = n, after

    def _count(self, change):
        self.left -= 1
        if self.left == 0 and not self.after:
            raise OSError("lost")
        out = change()
        if self.left == 0:
            raise OSError("lost")
        return out

    def write(self, name, df):
        return self._count(lambda: super(Failing, self).write(name, df))

    def append(self, name, df, key=None):
        if name in st.BUCKETS:  # an update, which is counted itself
            return super().append(name, df, key)
        return self._count(lambda: super(Failing, self).append(name, df, key))

    def update(self, name, changed=None, gone=None):
        return self._count(lambda: super(Failing, self).update(name, changed, gone))


ITEMS = [("Rocket launch delayed after engine fault", "http://n/1", TEXT + "1."), ("Rocket launch delayed after engine fault today", "http://n/2", TEXT + "2."), ("Quiet day at the market", "http://n/3/", TEXT + "3.")]


def test_ingest_that_failed_is_finished_by_running_it_again(spark, store, tmp_path):
    ingest(store, docs(spark, *ITEMS), pages(spark), AS_OF, "r1")
    clean = state(store)
    for n, after in [(2, False), (3, False), (4, False), (5, False)]:  # that is, after each of the first four changes
        path = str(tmp_path / f"s{n}{after}")
        st.seed_dims(st.Store(spark, path))
        with pytest.raises(OSError):
            ingest(Failing(spark, path, n, after), docs(spark, *ITEMS), pages(spark), AS_OF, "r1")
        ingest(st.Store(spark, path), docs(spark, *ITEMS), pages(spark), AS_OF, "r1")
        assert state(st.Store(spark, path)) == clean
    lost = str(tmp_path / "s3False")  # under another id nothing is lost or doubled either
    st.seed_dims(st.Store(spark, lost + "x"))
    with pytest.raises(OSError):
        ingest(Failing(spark, lost + "x", 3, False), docs(spark, *ITEMS), pages(spark), AS_OF, "r1")
    ingest(st.Store(spark, lost + "x"), docs(spark, *ITEMS), pages(spark), AS_OF, "r2")
    got = state(st.Store(spark, lost + "x"))
    assert {k: got[k] for k in ("posts", "duplicate_records", "parsed_items")} == {k: clean[k] for k in ("posts", "duplicate_records", "parsed_items")}


def test_store_appends_and_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "COMPACT_AFTER", 2)
    own = st.Store(spark, str(tmp_path / "s"))
    run = lambda i: spark.createDataFrame([(f"r{i}", "fetch", None, None)], st.SCHEMAS["runs"])
    for i in range(6):
        own.append("runs", run(i), ["run_id", "kind", "source_id"])
        own.append("runs", run(i), ["run_id", "kind", "source_id"])
    assert sorted(r.run_id for r in own.read("runs").collect()) == [f"r{i}" for i in range(6)]
    own.write("runs", own.read("runs").where("run_id <> 'r0'"))
    own.append("runs", run(7))
    own.vacuum(1)
    assert sorted(r.run_id for r in own.read("runs").collect()) == ["r1", "r2", "r3", "r4", "r5", "r7"]
    assert len({v for v, _ in own._folders("runs")}) == 1


def test_streams_run_again_after_a_failure(spark, store, tmp_path):
    """Every stream is stopped by a failure midway, started again, and ends as if it had not been."""
    at = datetime.datetime(2024, 6, 1)
    posts = spark.createDataFrame([(i, f"http://p/{i}", t, "d", at) for i, t in enumerate(["One story about the river flood", "One story about the river flood", "Something else entirely today"])], "id long, source_url string, raw_title string, raw_description string, created_at timestamp")
    posts = posts.withColumn("status", F.lit("new"))
    rows = st.conform(posts, "posts")
    rows.write.parquet(str(tmp_path / "posts"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "posts"))

    def again(start, failing):
        query = start(failing)
        with pytest.raises(Exception):
            query.awaitTermination(120)
        start(st.Store(spark, failing.path)).awaitTermination(120)
        return st.Store(spark, failing.path)

    for n in (1, 2):
        done = again(lambda s: jobs.stream_dedup(stream, s, AS_OF, str(tmp_path / f"d{n}"), days=0), Failing(spark, str(tmp_path / f"dedup{n}"), n, True))
        assert sorted(r.id for r in done.read("posts").collect()) == [0, 2] and done.read("duplicate_records").count() == 1
    items = spark.createDataFrame([("http://s/1", "t", at), ("http://s/2", "t", at)], "link string, title string, seen_at timestamp")
    items.write.parquet(str(tmp_path / "items"))
    arriving = spark.readStream.schema(items.schema).parquet(str(tmp_path / "items"))
    done = again(lambda s: jobs.stream_unseen_ledger(arriving, s, AS_OF, str(tmp_path / "u"), str(tmp_path / "fresh")), Failing(spark, str(tmp_path / "ledger"), 1, True))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 2 and done.read("parsed_items").count() == 2
    queue = Failing(spark, str(tmp_path / "dedup1"), 1, True)
    spark.range(1).select(F.col("id").alias("value")).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("value long").parquet(str(tmp_path / "ticks"))
    done = again(lambda s: jobs.stream_queue(spark, s, "{title}", str(tmp_path / "prompts"), str(tmp_path / "q"), 1, ticks=ticks), queue)
    claimed = [r.id for r in spark.read.parquet(str(tmp_path / "prompts")).collect()]
    assert [r.id for r in done.read("posts").where("status = 'processing'").collect()] == claimed == [0]


def files_of(store, name):
    import pathlib

    return {p: p.stat().st_mtime_ns for p in pathlib.Path(store.path, name).rglob("*.parquet")}


def test_updates_leave_other_files_alone(spark, tmp_path):
    """Only the buckets of the ids are written; what they held else stays; emptied buckets are empty; older versions go."""
    own = st.Store(spark, str(tmp_path / "s"))
    n = st.BUCKETS["posts"]
    rows = spark.range(4 * n).select("id", F.lit("new").alias("status"))
    own.write("posts", rows)
    before = files_of(own, "posts")
    own.update("posts", spark.createDataFrame([(5, "approved"), (4 * n + 5, "added")], "id long, status string"), spark.createDataFrame([(n + 6,)], "id long"))
    after = files_of(own, "posts")
    assert before.items() <= after.items()
    written = {p.parent.name for p in set(after) - set(before)}
    assert written == {"bucket=5", "bucket=6"}
    got = {r.id: r.status for r in own.read("posts").collect()}
    assert got == {i: "new" for i in range(4 * n) if i != n + 6} | {5: "approved", 4 * n + 5: "added"}
    own.update("posts", gone=spark.createDataFrame([(7 + i * n,) for i in range(4)], "id long"))
    assert {r.id for r in own.read("posts").collect()} == set(got) - {7 + i * n for i in range(4)}
    own.update("posts", gone=spark.createDataFrame([], "id long"))
    assert own._newest("posts")[0] == 3
    here = sorted(map(repr, own.read("posts").collect()))
    own.vacuum(1)
    assert sorted(map(repr, own.read("posts").collect())) == here
    assert {p.parent.name for p in files_of(own, "posts") if "/v1/" in str(p)} == {f"bucket={b}" for b in range(n) if b not in (5, 6, 7)}
    own.write("posts", rows.limit(0))
    assert own.read("posts").count() == 0


def test_changes_of_several_tables_are_whole(spark, store, tmp_path):
    """Forgetting, restoring and emptying, stopped at any point, have changed nothing or are finished when next asked."""
    at = datetime.datetime(2024, 6, 1)
    posts = spark.createDataFrame([(i, f"http://p/{i}", at) for i in range(6)], "id long, source_url string, created_at timestamp").withColumn("status", F.lit("new"))
    log = spark.createDataFrame([(i, i % 6) for i in range(12)], "id long, post_id long")
    seen = posts.select(F.col("source_url").alias("normalized_url"))

    def filled(path):
        own = st.Store(spark, str(tmp_path / path))
        for name, rows in (("posts", posts), ("publish_log", log), ("parsed_items", seen)):
            own.write(name, rows)
        return own

    gone = posts.where("id < 2").select("id")
    clean = filled("clean")
    untouched = state(clean)
    st.export_snapshot(clean, str(tmp_path / "snap"))
    lifecycle.forget(clean, gone)
    forgotten = state(clean)
    assert clean.read("posts").count() == 4 and clean.read("publish_log").count() == 8 and clean.read("parsed_items").count() == 4
    for n in (1, 2, 3, 4):
        own = filled(f"f{n}")
        with pytest.raises(OSError):
            lifecycle.forget(Failing(spark, own.path, n, False), gone)
        assert own.roll_forward() == 1 and state(own) == forgotten and own.roll_forward() == 0
    own = filled("unstaged")  # a failure before all is staged leaves everything as it is
    broken = posts.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception):
        own.change("x", {"publish_log": log.limit(0)}, {"posts": broken})
    assert own.roll_forward() == 0 and state(own) == untouched
    for n in (1, 4, 7):
        own = st.Store(spark, str(tmp_path / f"f{n % 4 + 1}"))
        with pytest.raises(OSError):
            st.restore_snapshot(Failing(spark, own.path, n, False), str(tmp_path / "snap"), f"again-{n}")
        st.restore_snapshot(own, str(tmp_path / "snap"), f"again-{n}")
        assert state(own) == untouched


def test_every_document_ends_in_an_outcome(spark, store):
    good = rss(("Rocket launch delayed after engine fault", "http://n/1", TEXT + "1."))
    rows = [(FEED, "rss", good), (FEED, "rss", good[:-20]), (FEED, "rss", ""), (FEED, "rss", None), (FEED, "atom", good), (FEED, "gopher", good), ("http://unknown/feed", "rss", good), (FEED, "atom", "<feed><title>none yet</title></feed>"), (FEED, "rss", "<rss><channel/></rss>")]
    run = ingest(store, spark.createDataFrame(rows, jobs.FEED_DOCS), pages(spark), AS_OF, "r1", most_errors=None)
    found = sorted((r.feed_url, r.error) for r in run.errors.collect())
    assert found == sorted([(FEED, "malformed document"), (FEED, "empty document"), (FEED, "empty document"), (FEED, "no atom feed"), (FEED, "unknown kind gopher"), ("http://unknown/feed", "no enabled source")])
    line = run.funnel.first()
    assert (line.scanned, line.new, line.error) == (1, 1, 6) and line.errors == sorted({f"{u}: {e}" for u, e in found})
    assert run.outcomes.where("outcome = 'error'").count() == 6
    again = ingest(store, spark.createDataFrame(rows, jobs.FEED_DOCS), pages(spark), AS_OF, "r2", most_errors=2).funnel.first()
    assert (again.error, len(again.errors), again.seen) == (6, 2, 1)


def test_guards_of_states(spark):
    every = ("new", "processing", "ai_processed", "approved", "published", "failed")
    posts = spark.createDataFrame([(i, s, None, None, None) for i, s in enumerate(every)], "id long, status string, ai_title string, ai_text string, ai_hashtags string")
    ids = posts.select("id")
    assert [r.status for r in lifecycle.approve(posts, ids).orderBy("id").collect()] == ["approved", "processing", "approved", "approved", "published", "failed"]
    replies = ids.select("id", F.when(F.col("id") < 9, "strict").alias("parse_path"), F.lit("T").alias("title"), F.lit("Text.").alias("text"), F.array(F.lit("a")).alias("hashtags"))
    out = lifecycle.apply_rewrites(posts, replies).orderBy("id").collect()
    assert [r.status for r in out] == ["new", "ai_processed", "ai_processed", "approved", "published", "failed"]
    assert [r.ai_title for r in out] == [None, "T", None, None, None, None]


def test_late_items_are_set_aside(spark, store, tmp_path):
    kind = "link string, title string, seen_at timestamp"
    day = lambda d: datetime.datetime(2024, 6, d)
    path, out, late = (str(tmp_path / x) for x in ("items", "fresh", "late"))
    for rows in ([("http://a", "t", day(10)), ("http://b", "t", day(1))], [("http://c", "t", day(9)), ("http://d", "t", day(2)), ("http://e", "t", None)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kind).parquet(path)
        jobs.stream_unseen_ledger(stream, store, AS_OF, str(tmp_path / "c"), out, delay="3 days", late=late).awaitTermination(120)
    assert sorted(r.link for r in spark.read.parquet(out).collect()) == ["http://a", "http://b", "http://c", "http://e"]
    assert [r.link for r in spark.read.parquet(late).collect()] == ["http://d"]
    assert store.read("parsed_items").count() == 4


def test_plan_alternates_categories(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "approved", 1 if i < 4 else 2, at + datetime.timedelta(minutes=i), None) for i in range(6)] + [(9, "published", 2, at, at)]
    frame = spark.createDataFrame(rows, "id long, status string, category_id long, created_at timestamp, published_at timestamp")
    plan = lifecycle.publish_plan(frame, 5, 30, (10, 10), AS_OF).orderBy("slot").collect()
    assert [r.id for r in plan] == [3, 5, 2, 4, 1]
    assert [r.publish_at for r in plan][:2] == [datetime.datetime(2024, 6, 1, 12, 30, 10), datetime.datetime(2024, 6, 1, 13, 0, 20)]
    assert lifecycle.next_publishable(frame).first().id == 3
    assert lifecycle.next_publishable(frame.where("status <> 'published'")).first().id == 5


def test_streams_equal_batch(spark, store, tmp_path):
    path = str(tmp_path / "feeds")
    docs(spark, ("First story of the day arrives", "http://s/1", TEXT + "1.")).write.mode("append").parquet(path)
    first = jobs.stream_ingest(spark, path, store, pages(spark), AS_OF, str(tmp_path / "c1"))
    first.awaitTermination(120)
    docs(spark, ("First story of the day arrives", "http://s/2", TEXT + "2."), ("Second tale altogether different", "http://s/3", TEXT + "3.")).write.mode("append").parquet(path)
    jobs.stream_ingest(spark, path, store, pages(spark), AS_OF, str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(r.source_url for r in store.read("posts").collect()) == ["http://s/1", "http://s/3"]
    assert store.read("duplicate_records").count() == 1

    items = str(tmp_path / "items")
    frame = spark.createDataFrame([("http://s/1", "t", at) for at in [datetime.datetime(2024, 6, 1)] * 2] + [("http://s/9#a", "t", datetime.datetime(2024, 6, 1)), ("http://S/9", "t", datetime.datetime(2024, 6, 1))], "link string, title string, seen_at timestamp")
    frame.write.parquet(items)
    stream = spark.readStream.schema(frame.schema).parquet(items)
    out = str(tmp_path / "fresh")
    jobs.stream_unseen_ledger(stream, store, AS_OF, str(tmp_path / "c2"), out).awaitTermination(120)
    assert spark.read.parquet(out).count() == 1
    bounded = jobs.stream_unseen(stream, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "bounded")).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    bounded.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "bounded")).count() == 2

    spark.range(1).select(F.col("id").alias("value")).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("value long").parquet(str(tmp_path / "ticks"))
    jobs.stream_queue(spark, store, "{title}", str(tmp_path / "prompts"), str(tmp_path / "c4"), 10, ticks=ticks).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "prompts")).count() == 2
    assert {r.status for r in store.read("posts").collect()} == {"processing"}


def test_funnel_stream(spark, tmp_path):
    frame = spark.createDataFrame([("r", "new"), ("r", "new"), ("r", "seen")], "run_id string, outcome string")
    frame.write.parquet(str(tmp_path / "o"))
    counts = jobs.stream_funnel(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "o")))
    query = counts.writeStream.format("memory").queryName("funnel_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.outcome, r.n) for r in spark.table("funnel_counts").collect()} == {("new", 2), ("seen", 1)}


def test_unseen_by_raw_and_normal_address(spark):
    items = spark.createDataFrame([("http://A/1?x",), ("http://b/2",), ("http://c/3/",)], "link string")
    ledger = spark.createDataFrame([("http://a/1",)], "normalized_url string")
    posts = spark.createDataFrame([("http://c/3",)], "source_url string")
    assert [r.link for r in listing.unseen(items, ledger, posts).collect()] == ["http://b/2"]


def test_embeddings_hook(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from newsloom.plans.ingest import with_embeddings

    @pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    posts = spark.createDataFrame([(1, "Title", "Some text"), (2, "Alone", None)], "id long, raw_title string, raw_description string")
    got = {r.id: (r.embedding, r.title_embedding) for r in with_embeddings(posts, encode).collect()}
    assert got == {1: ([16.0, 1.0], [5.0, 1.0]), 2: ([5.0, 1.0], [5.0, 1.0])}


def test_title_index_finds_what_all_of_history_gives(spark, tmp_path, monkeypatch):
    """Posts added, rewritten, changed back and deleted between batches; every batch by the index and by all of history."""
    import random

    from newsloom.functions.similarity import LEXICAL_BOUNDS
    from newsloom.operators import dedup, title_index
    from newsloom.plans.ingest import swept_ids

    monkeypatch.setattr(title_index, "COMPACT_AFTER", 2)
    rng, at = random.Random(5), datetime.datetime(2024, 5, 1)
    title = lambda: " ".join(rng.sample(["river", "flood", "mayor", "bridge", "council", "storm", "harbour", "railway", "museum", "orchard"], rng.randint(4, 7)))

    def some(first, n, rewritten=0.3):
        rows = [(first + i, f"http://p/{first + i}", rng.choice(["", None]) if rng.random() < 0.05 else title(), "d", title() if rng.random() < rewritten else None, "new", at + datetime.timedelta(hours=rng.randint(0, 40))) for i in range(n)]
        return st.conform(spark.createDataFrame(rows, "id long, source_url string, raw_title string, raw_description string, ai_title string, status string, created_at timestamp"), "posts")

    own = st.Store(spark, str(tmp_path / "indexed"))
    index = title_index.TitleIndex(own)
    own.write("posts", some(0, 60))
    sizes = []
    for k, family in enumerate(("e5_base", "bge", "e5_large")):
        new = some(1000 + 100 * k, 12)
        history = own.read("posts")
        index.sync(history)
        near = index.near(new, history, LEXICAL_BOUNDS[family])
        sizes.append(near.count())
        matches = [sorted((r.new_id, r.kept_id, r.reason, r.confidence) for r in dedup.match_exact(new, posts).unionByName(dedup.match_lexical(new, posts, family)).collect()) for posts in (near, history)]
        assert matches[0] == matches[1] and matches[0]
        if k == 1:
            gone = [sorted(r.id for r in swept_ids(posts, new, family).collect()) for posts in (near, history)]
            assert gone[0] == gone[1] and gone[0]
        rewritten = history.where(f"id % 4 = {k % 4}").withColumn("ai_title", F.when(F.lit(k % 2 == 0), F.reverse("raw_title")))
        own.update("posts", new.unionByName(rewritten), history.where(f"id % 9 = {k}").select("id"))
    assert min(sizes) < 60 and index._parts()[0] == (3, True)
    before = index._parts()
    index.sync(own.read("posts"))
    index.sync(own.read("posts"))
    assert len(index._parts()) <= len(before) + 1  # nothing new, no part


def test_title_index_of_nothing(spark, tmp_path):
    from newsloom.operators.title_index import TitleIndex

    own = st.Store(spark, str(tmp_path / "empty"))
    index, none = TitleIndex(own), own.read("posts")
    index.sync(none)
    assert index.near(none, none).count() == 0
    one = st.conform(spark.createDataFrame([(1, "A tale of the river flood", None)], "id long, raw_title string, ai_title string"), "posts")
    assert index.near(one, none).count() == 0
    index.sync(one)
    assert [r.id for r in index.near(one.withColumn("id", F.lit(2)), one).collect()] == [1] and index.near(none, one).count() == 0
