"""Registered queries: the streaming jobs, run to their end; each equals its batch twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as P
from ..operators import graph
from ..sources.adapters import AS_OF, Tables
from ..sources.tables import Store, ensure_checkpoints, scratch
from ..streaming import jobs
from .prelude import ORACLE, query


class StreamTables(Tables):
    """The adapted tables over streams of the raw ones named."""

    def __init__(self, t: Tables, *streamed: str):
        super().__init__(t.spark, t.dir)
        self.streamed = streamed

    def raw(self, name: str):
        return jobs.read_stream(self.spark, self.dir, name) if name in self.streamed else super().raw(name)


@query()
def z1_stream_collect(t: Tables):
    ensure_checkpoints(t.spark)
    path = scratch(t.spark)
    store = Store(t.spark, path)
    text = lambda c: F.lit(None).cast("string").alias(c)
    known = t.known.select("url_hash", text("url"), text("title"), text("body"), F.lit("stored").alias("source_type"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("검증됨").alias("status"), "matched_keywords")
    store.commit(keyed={"news": ("url_hash", known), "excluded": ("url_hash", t.excluded)}, digits=1)
    jobs.stream_collect(StreamTables(t, "events").hits, store, t.keywords, f"{path}-state").awaitTermination()
    return store.read("news", "url_hash").select("url_hash", "matched_keywords")


ORACLE["z1_stream_collect"] = ORACLE["c2_merge_matched_keywords"]


@query("hits", "SELECT DISTINCT sha256(url) AS url_hash FROM hits WHERE url IS NOT NULL")
def z2_stream_dedup(t: Tables):
    hits = StreamTables(t, "events").hits
    dated = hits.select(P.url_hash(P.pick_url(F.col("originallink"), F.col("link"))).alias("url_hash"), F.coalesce(P.parse_pub_date(F.col("pubDate")), F.lit("2024-01-01").cast("timestamp")).alias("published_at")).where("url_hash is not null")
    return jobs.run_to_table(jobs.stream_dedup(dated, "1000 days"), scratch(t.spark)).select("url_hash")


@query("ok", "SELECT day, count(*) AS count FROM ok GROUP BY 1")
def z3_stream_daily_counts(t: Tables):
    counts = jobs.stream_daily_counts(StreamTables(t, "orders").news, "10000 days")
    return jobs.run_to_table(counts, scratch(t.spark), "complete")


@query("tags", "SELECT * FROM tags")
def z4_stream_tagging(t: Tables):
    docs = StreamTables(t, "documents").raw("documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return jobs.run_to_table(jobs.stream_tagging(docs, t.dictionary), scratch(t.spark))


@query("news", "SELECT count(*) AS unverified_count, 'stale' AS unverified_tier FROM news WHERE status <> '검증됨'")
def z5_stream_gap_alert(t: Tables):
    path = scratch(t.spark)
    orphans = graph.orphan_relations(t.news, t.news_orgs, t.ruled)
    jobs.stream_gap_alert(StreamTables(t, "orders").news, orphans, AS_OF, path, f"{path}-state").awaitTermination()
    return t.spark.read.parquet(path).select("unverified_count", "unverified_tier")


_STEP = "CASE WHEN status <> '검증됨' THEN 1 WHEN id % 3 = 1 THEN -1 ELSE 0 END"


@query("news", f"SELECT source_type AS queue, sum({_STEP})::BIGINT AS waiting FROM news GROUP BY 1 HAVING sum({_STEP}) > 0")
def z5_queue_alerts(t: Tables):
    """Queues that a timer finds waiting. One in three verified articles was in its queue; the others come verified."""
    seen = lambda news: news.withColumn("status", F.when((F.col("status") == S.VERIFIED) & (F.col("id") % 3 != 1), "none").otherwise(F.col("status")))
    waiting = seen(t.news).groupBy("source_type").agg(F.sum(F.when(F.col("status") == S.UNVERIFIED, 1).when(F.col("status") == S.VERIFIED, -1)).alias("w")).where("w > 0").count()
    return jobs.run_until(jobs.stream_queue_alerts(seen(StreamTables(t, "orders").news), dt.timedelta(seconds=1)), scratch(t.spark), waiting)


@query("news", "SELECT id, day FROM news WHERE day = DATE '2001-07-31'")
def s2_write_and_read_table(t: Tables):
    """News written by publication month and read back: the filter prunes all folders but one."""
    from ..sources.tables import read_table, write_news

    path = scratch(t.spark)
    write_news(t.news, path, by="month")
    return read_table(t.spark, path).where("published_part = date'2001-07-01' and published_date = date'2001-07-31'").select("id", F.col("published_date").alias("day"))
