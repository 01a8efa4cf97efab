"""Incremental versions of collection, counting and tagging. On the same input they equal the batch jobs."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas as S
from ..functions import matching
from ..functions.scalars import local_date
from ..functions.textclean import clean_text
from ..operators import collect, metrics
from ..sources.tables import Store, ensure_checkpoints


def collect_batch(hits: DataFrame, batch_id: int, store: Store, keywords: DataFrame) -> None:
    """Folds one micro-batch into the stored articles. Only the buckets of the batch's urls are read of keyed tables,
    and only new and changed articles are written. The batch's number is committed with them, so a
    replayed batch changes nothing."""
    done = store.mark("batch")
    if done is not None and done >= batch_id:
        return
    ensure_checkpoints(hits.sparkSession)
    hits = collect.normalize_hits(hits, keywords).checkpoint()
    urls = hits.where("url is not null").select("url_hash").distinct()
    news = store.read("news", "url_hash", among=urls)
    folded = collect.fold_normalized(hits, news, store.read("excluded", "url_hash", among=urls))
    merged = collect.merge_keywords(folded, news, reached_only=True)
    new = collect.new_articles(folded, merged).select(*news.columns)
    changed = news.withColumnRenamed("matched_keywords", "_had").join(merged, "url_hash").where(~F.col("_had").eqNullSafe(F.col("matched_keywords"))).select(*news.columns)
    store.commit({"news": ("url_hash", changed.unionByName(new))}, marks={"batch": batch_id})


def stream_collect(hits: DataFrame, store: Store, keywords: DataFrame, checkpoint: str) -> StreamingQuery:
    return hits.writeStream.foreachBatch(lambda df, n: collect_batch(df, n, store, keywords)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(hits: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first sighting of each url hash within the lateness; the stored table stays the truth."""
    return hits.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["url_hash"])


def stream_daily_counts(news: DataFrame, lateness: str = "3 days", tz: str = S.SEOUL, day_starts: str = "15 hours") -> DataFrame:
    """(day, count) of verified news by the days of ``tz``, which start at ``day_starts`` of UTC (a zone
    without summer time); late articles change old days until the watermark."""
    day = F.window("published_at", "1 day", startTime=day_starts)
    counts = news.where(F.col("status") == S.VERIFIED).withWatermark("published_at", lateness).groupBy(day).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(local_date(F.col("window.start"), tz).alias("day"), "count")


def stream_tagging(news: DataFrame, entities: DataFrame) -> DataFrame:
    """(news_id, entity_id) on a stream with a static dictionary; stateless."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), clean_text(F.col("body")))
    return matching.mentions(news.select(F.col("id").alias("news_id"), text.alias("text")), entities)


def gap_alerts(news: DataFrame, orphans: DataFrame, as_of: dt.date) -> DataFrame:
    """The verification state, if it calls for an alert."""
    return metrics.verification_status(news, orphans, as_of).where("unverified_tier = 'stale'")


def stream_gap_alert(news: DataFrame, orphans: DataFrame, as_of: dt.date, path: str, checkpoint: str) -> StreamingQuery:
    """Appends an alert for each trigger whose queue is stale."""
    run = lambda df, n: gap_alerts(df, orphans, as_of).withColumn("batch_id", F.lit(n)).write.mode("append").parquet(path)
    return news.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_queue_alerts(changes: DataFrame, patience: dt.timedelta, by: str = "source_type") -> DataFrame:
    """(queue, waiting): an alert for each verification queue that hasn't been empty for ``patience`` of real time, once
    until it has been empty again. ``changes``: a stream of articles with their status: an unverified one joins its queue, a
    verified one leaves it.

    The alert needs no arrival: each queue holds a timer of processing time, and a stream without data still runs
    batches for due timers (start it with a trigger by time). Counts are added up in each task before they
    meet, so a queue of a third of all articles sends a row for each task."""
    step = F.when(F.col("status") == S.UNVERIFIED, 1).when(F.col("status") == S.VERIFIED, -1).otherwise(0)
    rows = changes.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("queue"), step.cast("long").alias("delta"))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.groupby("queue", as_index=False).delta.sum()

    limit = int(patience.total_seconds() * 1000)

    def advance(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, since, told = state.get if state.exists else (0, 0, False)
        if state.hasTimedOut:
            state.update((waiting, since, True))
            yield pd.DataFrame({"queue": [key[0]], "waiting": [waiting]})
            return
        waiting = max(0, waiting + sum(int(pdf.delta.sum()) for pdf in frames))
        if not waiting:
            if state.exists:
                state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        since = since or now
        state.update((waiting, since, told))
        if not told:
            state.setTimeoutDuration(max(1, since + limit - now))

    deltas = rows.mapInPandas(summed, "queue string, delta long")
    return deltas.groupBy("queue").applyInPandasWithState(advance, "queue string, waiting long", "waiting long, since long, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_until(df: DataFrame, path: str, rows: int, seconds: float = 120.0, every: str = "500 milliseconds") -> DataFrame:
    """Drives a stream whose rows come by timers: until ``rows`` rows are in ``path``, or the time is over."""
    spark, schema = df.sparkSession, df.schema
    q = df.writeStream.foreachBatch(lambda out, n: out.write.mode("append").parquet(path)).option("checkpointLocation", f"{path}-state").trigger(processingTime=every).start()
    read = lambda: spark.read.schema(schema).parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    try:
        end = time.time() + seconds
        while time.time() < end and q.exception() is None and read().count() < rows:
            time.sleep(0.5)
        if q.exception() is not None:
            raise q.exception()
    finally:
        q.stop()
    return read()


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drives a stream to its end into Parquet; in update or complete mode the last batch's rows stay."""
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(path)).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(path)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
