"""Tables of a curation store: fixed schemas in Parquet, and the writes that keep their keys unique."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions.similarity import norm_title, norm_url

SCHEMAS = {
    "categories": "id long, name string, hashtags string, keywords string, enabled boolean",
    "sources": "id long, url string, name string, category_id long, enabled boolean, last_fetched_at timestamp",
    "posts": "id long, source_url string, raw_title string, raw_description string, raw_image_url string, ai_title string, ai_text string, ai_hashtags string, category_id long, status string, vk_post_id string, telegram_message_id string, created_at timestamp, published_at timestamp, error_message string, normalized_title string, normalized_url string",
    "publish_log": "id long, post_id long, platform string, success boolean, response string, created_at timestamp",
    "runs": "run_id string, kind string, source_id long, at timestamp",
    "parsed_items": "normalized_url string, normalized_title string, source_url string, seen_at timestamp",
    "duplicate_records": "id long, duplicate_url string, duplicate_title string, duplicate_description string, kept_post_id long, kept_title string, reason string, created_at timestamp, ai_is_duplicate boolean, ai_confidence int, ai_explanation string, ai_checked_at timestamp",
}
FACTS = ("posts", "publish_log", "parsed_items", "duplicate_records")
SNAPSHOT_VERSION = 1
#: Appended folders after which a table is written anew as one.
COMPACT_AFTER = 16
#: Tables whose rows change by id, and how many buckets of ids a new version can replace one by one unless a store is made
#: with more; a store keeps the number that it began with.
BUCKETS = {"posts": 16}
# The categories of a new store.
SEED_CATEGORIES = [
    ("PC", "#игры #PC #гейминг", "steam, pc, nvidia, amd"),
    ("Консоли", "#игры #консоли #PS5 #Xbox", "playstation, xbox, nintendo, switch"),
    ("Мобильные", "#игры #мобильные", "mobile, android, ios, gacha"),
    ("Киберспорт", "#киберспорт #esports", "esports, tournament, cs2, dota"),
    ("Инди", "#игры #инди", "indie, pixel, roguelike"),
    ("Анонсы", "#игры #анонс #релиз", "announce, release, trailer, reveal"),
    ("Обзоры", "#игры #обзор", "review, score, rating, gameplay"),
    ("Наука", "#наука #science", "science, research, physics, technology"),
]
# Feeds offered to a new store: name, address, category, group.
PRESET_SOURCES = [
    ("IGN", "https://feeds.feedburner.com/ign/all", "Обзоры", "General Gaming News"),
    ("GameSpot", "https://www.gamespot.com/feeds/news/", "Обзоры", "General Gaming News"),
    ("Eurogamer", "https://www.eurogamer.net/feed", "Обзоры", "General Gaming News"),
    ("PC Gamer", "https://www.pcgamer.com/rss/", "PC", "General Gaming News"),
    ("Rock Paper Shotgun", "https://www.rockpapershotgun.com/feed", "Инди", "General Gaming News"),
    ("GamesIndustry.biz", "https://www.gamesindustry.biz/feed", "Анонсы", "Industry & Business"),
    ("VGC (Video Games Chronicle)", "https://www.videogameschronicle.com/feed/", "Анонсы", "Industry & Business"),
    ("Insider Gaming", "https://insider-gaming.com/feed/", "Анонсы", "Leaks & Rumors"),
    ("RB.RU Cybersport", "https://rb.ru/feeds/tag/cybersport/", "Киберспорт", "Cybersport"),
    ("Ars Technica", "https://arstechnica.com/feed/", "Наука", "Science"),
    ("Quanta Magazine", "https://www.quantamagazine.org/feed/", "Наука", "Science"),
]


def conform(df: DataFrame, name: str) -> DataFrame:
    """To a table's columns and types; columns that are missing are null, others go."""
    fields = StructType.fromDDL(SCHEMAS[name]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


class Store:
    """A folder with one Parquet table for each name in SCHEMAS.

    A write makes a new version, a folder v<n>; an append adds a folder v<n>-<k> to the newest, and after COMPACT_AFTER of
    them a new version holds all. Tables in BUCKETS are laid out by the id's bucket: an update writes a version with the
    buckets that it touches, and of every bucket the newest counts (`buckets`: more of them for more rows). Folders count once Spark has committed them (their
    _SUCCESS file), so readers of older versions and writes that fail midway do no harm. One writer at a time; `vacuum`
    deletes old versions.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = {name: buckets or n for name, n in BUCKETS.items()}

    def _fs(self, path: str):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, path: str) -> bool:
        done, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(done)

    def _listed(self, path: str) -> list[str]:
        root, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def committed(self, path: str) -> list[str]:
        """Names of the folders in path that Spark has committed."""
        return [n for n in self._listed(path) if self._committed(f"{path}/{n}")]

    def _folders(self, name: str) -> list[tuple[int, int]]:
        """(version, part) of all that is committed; part 0 is the version itself."""
        found = [re.fullmatch(r"v(\d+)(?:-(\d+))?", n) for n in self._listed(f"{self.path}/{name}")]
        return sorted((int(m[1]), int(m[2] or 0)) for m in found if m and self._committed(f"{self.path}/{name}/{m[0]}"))

    def _newest(self, name: str) -> tuple[int, list[int]]:
        """The newest version (0 if there is none) and its parts."""
        folders = self._folders(name)
        version = max((v for v, k in folders if k == 0), default=0)
        return version, [k for v, k in folders if v == version]

    def _path(self, name: str, version: int, part: int) -> str:
        return f"{self.path}/{name}/v{version}" + (f"-{part}" if part else "")

    def _buckets(self, name: str) -> dict[int, list[int]]:
        """Of each bucket the versions that have it, oldest first."""
        out: dict[int, list[int]] = {}
        for version, _ in self._folders(name):
            for n in self._listed(self._path(name, version, 0)):
                if m := re.fullmatch(r"bucket=(\d+)", n):
                    out.setdefault(int(m[1]), []).append(version)
        return out

    def _read_buckets(self, name: str, only=None) -> DataFrame:
        paths = [f"{self._path(name, v[-1], 0)}/bucket={b}" for b, v in sorted(self._buckets(name).items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths).where("id is not null")

    def read(self, name: str) -> DataFrame:
        if name in BUCKETS:
            return self._read_buckets(name)
        version, parts = self._newest(name)
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[self._path(name, version, k) for k in parts])

    def _number(self, name: str) -> int:
        """Buckets of a table: those of its first version, which has all, else what the store was made with."""
        return len(self._buckets(name)) or self.buckets[name]

    def _write_buckets(self, name: str, rows: DataFrame, buckets) -> None:
        """A version with these buckets; a row without id stands in each, so that one that lost its rows is replaced too."""
        own = conform(rows, name).where("id is not null").withColumn("bucket", F.pmod("id", F.lit(self._number(name))).cast("int"))
        marks = self.spark.createDataFrame([(int(b),) for b in buckets], "bucket int")
        held = own.unionByName(marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema if f.name != "bucket"], "bucket"))
        held.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(self._path(name, self._newest(name)[0] + 1, 0))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces the table; df may be made from it. Rows without id are no rows of a table that is updated by id."""
        if name in BUCKETS:
            self._write_buckets(name, df, range(self._number(name)))
        else:
            conform(df, name).write.mode("overwrite").parquet(self._path(name, self._newest(name)[0] + 1, 0))
        return self.read(name)

    def update(self, name: str, changed: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
        """Rows of `changed` replace those of their id or are added, those of the ids in `gone` go; one row for each id.

        Only the buckets of these ids are read and written; all other files stay as they are. To do it again changes nothing.
        """
        rows = self.spark.createDataFrame([], SCHEMAS[name]) if changed is None else conform(changed, name)
        lost = rows.select("id").limit(0) if gone is None else gone.select(F.col("id").cast("long").alias("id"))
        number = self._number(name)
        ids = rows.select("id").unionByName(lost).where("id is not null").select(F.pmod("id", F.lit(number)).cast("int").alias("b")).distinct()
        touched = sorted(r.b for r in ids.collect())  # at most as many as there are buckets
        if not self._newest(name)[0]:
            touched = list(range(number))
        if touched:
            there = self._read_buckets(name, touched).join(rows.select("id").unionByName(lost), "id", "left_anti")
            self._write_buckets(name, there.select(*rows.columns).unionByName(rows.join(lost, "id", "left_anti").select(*rows.columns)), touched)
        return self.read(name)

    def append(self, name: str, df: DataFrame, key: list[str] | None = None) -> DataFrame:
        """Adds rows; with a key only those whose key, nulls included, the table lacks, so that a repeated append adds nothing."""
        rows = conform(df, name)
        if name in BUCKETS:
            return self.update(name, rows.join(self.read(name).select("id"), "id", "left_anti").select(*rows.columns))
        version, parts = self._newest(name)
        if key and parts:
            there = self.read(name).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
            rows = rows.join(there, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
        rows.write.mode("overwrite").parquet(self._path(name, version, max(parts, default=0) + 1))
        return self.write(name, self.read(name)) if len(parts) >= COMPACT_AFTER else self.read(name)

    def _run(self, run_id: str) -> str:
        return f"{self.path}/_runs/{hashlib.sha256(run_id.encode()).hexdigest()[:32]}"

    def stage(self, run_id: str, name: str, make) -> DataFrame:
        """What make() gives, written once for a run: a run that is repeated under its id reads what it had decided."""
        path = f"{self._run(run_id)}/{name}"
        if not self._committed(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _mark(self, path: str) -> None:
        root, fs = self._fs(path)
        fs.mkdirs(root)

    def _finish(self, run: str) -> None:
        for n in sorted(self._listed(run)):
            how, _, name = n.partition("-")
            if how == "rows":
                self.write(name, self.spark.read.schema(SCHEMAS[name]).parquet(f"{run}/{n}"))
            elif how == "gone":
                self.update(name, gone=self.spark.read.parquet(f"{run}/{n}"))
        self._mark(f"{run}/_DONE")

    def change(self, run_id: str, rows: dict | None = None, gone: dict | None = None) -> None:
        """A change of several tables that is made wholly or not at all: rows replaces tables, gone deletes ids of tables.

        All of it is staged before the first table is replaced. What fails before that has changed nothing; what fails
        after it is finished by `roll_forward`, or by the same change under the same run_id.
        """
        run = self._run(run_id)
        if "_READY" not in self._listed(run):
            for how, tables in (("rows", rows or {}), ("gone", gone or {})):
                for name, df in tables.items():
                    (conform(df, name) if how == "rows" else df.select("id").distinct()).write.mode("overwrite").parquet(f"{run}/{how}-{name}")
            self._mark(f"{run}/_READY")
        if "_DONE" not in self._listed(run):
            self._finish(run)

    def roll_forward(self) -> int:
        """Finishes changes that were staged in full and failed later; how many they were."""
        runs = [f"{self.path}/_runs/{n}" for n in self._listed(f"{self.path}/_runs")]
        open_runs = [r for r in runs if "_READY" in (own := self._listed(r)) and "_DONE" not in own]
        for run in open_runs:
            self._finish(run)
        return len(open_runs)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what the newest `keep` versions of each table do not read; readers of older ones have to be done."""
        for name in SCHEMAS:
            versions = sorted({v for v, _ in self._folders(name)})
            oldest = versions[-keep] if len(versions) >= keep else None
            if oldest is None:
                continue
            if name in BUCKETS:
                for bucket, own in self._buckets(name).items():
                    read = max((v for v in own if v <= oldest), default=0)
                    for version in own:
                        if version < read:
                            path, fs = self._fs(f"{self._path(name, version, 0)}/bucket={bucket}")
                            fs.delete(path, True)
                continue
            newest = self._newest(name)[0]
            for version, part in self._folders(name):
                if version < oldest and version < newest:
                    path, fs = self._fs(self._path(name, version, part))
                    fs.delete(path, True)


def with_keys(items: DataFrame, url: str = "link", title: str = "title") -> DataFrame:
    return items.withColumn("normalized_url", norm_url(F.col(url))).withColumn("normalized_title", norm_title(F.col(title)))


def post_id(url) -> F.Column:
    """An id that only depends on the address."""
    return F.xxhash64(norm_url(url))


def insert_new_posts(posts: DataFrame, items: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(new rows for posts, items skipped): an address gets one post; of items with equal addresses the first title counts.

    items: title, description, link, image_url, category_id. The choice is an aggregate, combined before its shuffle.
    """
    own = F.struct("title", "description", "image_url", "category_id")
    first = items.groupBy("link").agg(F.min(own).alias("item"))
    there = posts.select(F.col("source_url").alias("link")).distinct()
    new = first.join(there, "link", "left_anti").select(
        post_id(F.col("link")).alias("id"), F.col("link").alias("source_url"), F.col("item.title").alias("raw_title"),
        F.coalesce("item.description", F.lit("")).alias("raw_description"), F.col("item.image_url").alias("raw_image_url"),
        F.col("item.category_id").alias("category_id"), F.lit("new").alias("status"), F.lit(as_of).cast("timestamp").alias("created_at"),
        norm_title(F.col("item.title")).alias("normalized_title"), norm_url(F.col("link")).alias("normalized_url"),
    )
    return conform(new, "posts"), items.join(there, "link", "left_semi")


def record_seen(ledger: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """New ledger rows: addresses not seen before, the first title of each."""
    keyed = with_keys(items).groupBy("normalized_url").agg(F.min(F.struct("normalized_title", "link")).alias("item"))
    new = keyed.join(ledger.select("normalized_url"), "normalized_url", "left_anti")
    return conform(new.select("normalized_url", "item.normalized_title", F.col("item.link").alias("source_url"), F.lit(as_of).cast("timestamp").alias("seen_at")), "parsed_items")


def seen_from_posts(ledger: DataFrame, posts: DataFrame) -> DataFrame:
    """Ledger rows for posts that it lacks."""
    keyed = posts.groupBy(norm_url(F.col("source_url")).alias("normalized_url")).agg(F.min(F.struct("created_at", "normalized_title", "source_url")).alias("p"))
    new = keyed.join(ledger.select("normalized_url"), "normalized_url", "left_anti")
    return conform(new.select("normalized_url", "p.normalized_title", "p.source_url", F.col("p.created_at").alias("seen_at")), "parsed_items")


def record_duplicates(matches: DataFrame, as_of) -> DataFrame:
    """Duplicate records of matches (link, title, description, kept_id, kept_title, reason, confidence, explanation)."""
    return conform(
        matches.select(
            F.xxhash64("link", "kept_id").alias("id"), F.col("link").alias("duplicate_url"), F.col("title").alias("duplicate_title"), F.col("description").alias("duplicate_description"),
            F.col("kept_id").alias("kept_post_id"), "kept_title", "reason", F.lit(as_of).cast("timestamp").alias("created_at"), F.lit(True).alias("ai_is_duplicate"),
            F.col("confidence").alias("ai_confidence"), F.col("explanation").alias("ai_explanation"), F.lit(as_of).cast("timestamp").alias("ai_checked_at"),
        ),
        "duplicate_records",
    )


def record_publish(outcomes: DataFrame, as_of) -> DataFrame:
    """Publish-log rows of outcomes (post_id, platform, success, response)."""
    return conform(outcomes.select(F.xxhash64("post_id", "platform", F.lit(str(as_of))).alias("id"), "post_id", "platform", "success", "response", F.lit(as_of).cast("timestamp").alias("created_at")), "publish_log")


def record_run(runs: DataFrame, run_id: str, kind: str, as_of, source_ids: DataFrame | None = None) -> DataFrame:
    """Run rows: one for the run, and one for each source that it read."""
    spark = runs.sparkSession
    own = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("source_id"), F.lit(as_of).cast("timestamp").alias("at"))
    if source_ids is not None:
        own = own.unionByName(source_ids.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.col("id").alias("source_id"), F.lit(as_of).cast("timestamp").alias("at")))
    return conform(own, "runs")


def last_run(runs: DataFrame) -> DataFrame:
    """(kind, run_id, at) of each kind's newest run."""
    return runs.where("source_id is null").groupBy("kind").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"), F.max("at").alias("at"))


def touch_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with last_fetched_at from the runs."""
    newest = runs.where("source_id is not null").groupBy(F.col("source_id").alias("_id")).agg(F.max("at").alias("_at"))
    return sources.join(newest, F.col("id") == F.col("_id"), "left").withColumn("last_fetched_at", F.greatest("last_fetched_at", "_at")).drop("_id", "_at")


def export_snapshot(store: Store, path: str) -> DataFrame:
    """Copies every table into `path` with a manifest (version, table, rows); returns the manifest."""
    rows = []
    for name in SCHEMAS:
        own = store.read(name)
        own.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((SNAPSHOT_VERSION, name, store.spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").count()))
    manifest = store.spark.createDataFrame(rows, "version int, table string, rows long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def restore_snapshot(store: Store, path: str, run_id: str | None = None) -> DataFrame:
    """Overwrites the store's tables, all or none; refuses another version, and tables that are missing or have lost rows."""
    manifest = store.spark.read.parquet(f"{path}/manifest")
    known = {r.table: (r.version, r.rows) for r in manifest.collect()}
    if set(known) != set(SCHEMAS) or any(v != SNAPSHOT_VERSION for v, _ in known.values()):
        raise ValueError(f"no snapshot of version {SNAPSHOT_VERSION} with all tables")
    tables = {name: store.spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in SCHEMAS}
    for name, own in tables.items():
        if own.count() != known[name][1]:
            raise ValueError(f"{name} is not the table that the manifest describes")
    store.change(run_id or f"restore-{uuid.uuid4().hex}", tables)
    return manifest


def upsert_dim(old: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `rows` replace those of equal key; the others stay."""
    return old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True).select(*old.columns)


def seed_dims(store: Store) -> None:
    """Categories and preset sources that the store lacks."""
    spark = store.spark
    categories = spark.createDataFrame([(i, *row, True) for i, row in enumerate(SEED_CATEGORIES, 1)], SCHEMAS["categories"])
    have = store.read("categories")
    store.append("categories", categories.join(have.select("name"), "name", "left_anti"))
    presets = spark.createDataFrame(PRESET_SOURCES, "name string, url string, category string, group string")
    store.append("sources", add_presets(store.read("sources"), presets, store.read("categories")))


def add_presets(sources: DataFrame, presets: DataFrame, categories: DataFrame) -> DataFrame:
    """New source rows for presets whose address is unknown, with the id of the category of that name."""
    named = categories.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("category_id"))
    new = presets.join(sources.select("url"), "url", "left_anti").join(named, "category", "left")
    return conform(new.select(F.xxhash64("url").alias("id"), "url", "name", "category_id", F.lit(True).alias("enabled")), "sources")


def purge(store: Store, run_id: str | None = None) -> None:
    """Empties the fact tables and forgets when sources were read, all or nothing; dimensions stay."""
    empty = {name: store.read(name).limit(0) for name in FACTS}
    sources = store.read("sources").withColumn("last_fetched_at", F.lit(None).cast("timestamp"))
    store.change(run_id or f"purge-{uuid.uuid4().hex}", empty | {"sources": sources})
