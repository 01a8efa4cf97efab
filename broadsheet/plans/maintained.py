"""Registered queries over stored tables that change: counts kept up by deltas, re-tagging and search by an index, versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import local_date, verified
from ..functions.textclean import clean_text
from ..operators import graph, judgment, postings, rollups
from ..sources.adapters import AS_OF, Tables
from ..sources.store import Store
from ..sources.tables import ensure_checkpoints, scratch
from .prelude import query

_KEYS = {"news": "id", "tags": ["news_id", "entity_id"]}
_LEFT = "id % 30 <> 7"


def _shifted(tags: DataFrame) -> DataFrame:
    return tags.where("news_id % 20 = 5").select("news_id", (F.col("entity_id") + 1).alias("entity_id"))


def _store(t: Tables, tags: DataFrame) -> Store:
    """Articles, of which some aren't verified yet, with tags, of which some are wrong."""
    ensure_checkpoints(t.spark)
    store = Store(t.spark, scratch(t.spark))
    early = t.news.withColumn("status", F.when(F.col("id") % 10 == 3, S.UNVERIFIED).otherwise(F.col("status"))).select("id", "title", "status", "published_at", "verified_at")
    wrong = tags.where("news_id % 20 <> 5").select("news_id", "entity_id").union(_shifted(tags))
    store.commit(keyed={"news": ("id", early), "tags": (_KEYS["tags"], wrong)}, digits=1)
    return store


def _change(t: Tables, store: Store, tags: DataFrame) -> None:
    """The batch is verified, tags are corrected, articles deleted: a commit each."""
    batch = t.news.where((F.col("id") % 10 == 3) & (F.col("status") == S.VERIFIED)).select(F.col("id").alias("news_id"))
    waiting = store.read("news", among=batch.withColumnRenamed("news_id", "id")).join(store.keys(batch.withColumnRenamed("news_id", "id")), "id", "left_semi")
    store.commit({"news": ("id", judgment.verify_batch(waiting, store.keys(batch), dt.datetime(2001, 8, 1)))})
    store.commit({"tags": (_KEYS["tags"], tags.where("news_id % 20 = 5").select("news_id", "entity_id"))}, delete={"tags": (_KEYS["tags"], _shifted(tags))})
    gone = t.news.where("id % 30 = 7").select("id")
    lost = tags.join(store.keys(gone.withColumnRenamed("id", "news_id")), "news_id", "left_semi")
    store.commit(delete={"news": ("id", gone), "tags": (_KEYS["tags"], lost)})


def _maintained(t: Tables, tags: DataFrame, rows: rollups.Contributions, dims: list[str]) -> DataFrame:
    """A rollup that was counted before the changes and brought up to date after them. The tags are derived once."""
    path = scratch(t.spark)
    tags.write.parquet(path)
    tags = t.spark.read.parquet(path)
    store = _store(t, tags)
    rollups.refresh(store, "counts", _KEYS, rows, dims)
    _change(t, store, tags)
    rollups.refresh(store, "counts", _KEYS, rows, dims)
    return store.read("counts")


def tagged_days(frames: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, day) of each tag of a verified article: counts for any period are sums of these."""
    news = verified(frames["news"]).select(F.col("id").alias("news_id"), local_date(F.col("published_at"), S.SEOUL).alias("day"))
    return frames["tags"].join(news, "news_id").select("entity_id", "day")


def tagged_pairs(frames: dict[str, DataFrame]) -> DataFrame:
    """(org_a, org_b) of each pair of tags of a verified article."""
    news = verified(frames["news"]).select(F.col("id").alias("news_id"))
    return graph.pair_rows(frames["tags"].join(news, "news_id")).select("org_a", "org_b")


@query("ok orgs news_orgs", f"SELECT o.id, o.name, count(*) AS count FROM orgs o JOIN news_orgs ON entity_id = o.id JOIN ok ON ok.id = news_id WHERE is_active AND ok.{_LEFT} GROUP BY o.id, o.name")
def a5_maintained_org_counts(t: Tables):
    days = _maintained(t, t.news_orgs, tagged_days, ["entity_id", "day"])
    counts = days.groupBy("entity_id").agg(F.sum("count").alias("count"))
    return t.orgs.where("is_active").join(counts, F.col("id") == F.col("entity_id")).select("id", "name", "count")


@query("ok topics news_topics", f"SELECT o.id, o.name, count(*) AS count FROM topics o JOIN news_topics ON entity_id = o.id JOIN ok ON ok.id = news_id WHERE is_active AND ok.{_LEFT} AND day BETWEEN DATE '2001-07-03' AND DATE '2001-08-01' GROUP BY o.id, o.name")
def a6_maintained_topic_counts(t: Tables):
    days = _maintained(t, t.news_topics, tagged_days, ["entity_id", "day"])
    recent = days.where(F.col("day").between(F.date_sub(F.lit(AS_OF), 29), F.lit(AS_OF)))
    counts = recent.groupBy("entity_id").agg(F.sum("count").alias("count"))
    return t.topics.where("is_active").join(counts, F.col("id") == F.col("entity_id")).select("id", "name", "count")


@query("pairs", "SELECT org_a, org_b, count(*) AS weight FROM pairs WHERE news_id % 30 <> 7 GROUP BY ALL")
def g2_maintained_pairs(t: Tables):
    return _maintained(t, t.news_orgs, tagged_pairs, ["org_a", "org_b"]).withColumnRenamed("count", "weight")


@query("news", "SELECT id, CASE WHEN id % 30 = 7 THEN 'delete' ELSE 'update' END AS change, status FROM news WHERE id % 30 = 7 OR (id % 10 = 3 AND status = '검증됨')")
def x1_changes_between_versions(t: Tables):
    """What the stored articles' versions differ by, with the status at the end (of the deleted, at the beginning)."""
    store = _store(t, t.news_orgs)
    first = store.versions()[-1]
    _change(t, store, t.news_orgs)
    diff = store.changes("news", "id", first)
    return diff.select("id", "change", F.coalesce("after.status", "before.status").alias("status"))


@query("tags", "SELECT * FROM tags")
def u4_delta_remap(t: Tables):
    """Tags of an older dictionary, brought to the new one through the index alone."""
    ensure_checkpoints(t.spark)
    store = Store(t.spark, scratch(t.spark))
    none = F.array().cast("array<string>")
    old = t.dictionary.withColumn("aliases", F.when(F.col("id").isin(2, 4), none).otherwise(F.col("aliases"))).withColumn("is_active", F.col("is_active") & (F.col("id") != 7)).withColumn("name", F.when(F.col("id") == 5, "Apache").otherwise(F.col("name")))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), clean_text(F.col("body")))
    postings.begin_tagging(store, t.articles.select("id", text.alias("text")), old, digits=1)
    postings.retag(store, old, t.dictionary)
    return store.read("tags")


@query("articles", "SELECT id, title FROM articles WHERE contains(upper(title), upper('tion L'))")
def f4_indexed_search(t: Tables):
    """Titles that hold a string, letter case aside, by the index of their substrings."""
    ensure_checkpoints(t.spark)
    store = Store(t.spark, scratch(t.spark))
    postings.begin(store, t.articles.select("id", F.upper("title").alias("text")), digits=1)
    found = postings.search(store, "tion L".upper()).select(F.col("id").alias("_id"))
    return t.articles.join(found, F.col("id") == F.col("_id"), "left_semi").select("id", "title")
