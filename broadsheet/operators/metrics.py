"""Dashboard metrics, rankings and lists over the gated, period-filtered news."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.tables import ensure_checkpoints
from ..functions.scalars import in_period, local_date, pct, verified


def daily_counts(news: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    return in_period(verified(news), period, as_of, tz).groupBy(local_date(F.col("published_at"), tz).alias("day")).agg(F.count(F.lit(1)).alias("count"))


def day_buckets(news: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """(bucket, start, end, count): every day of 7d or 30d, zero days too."""
    days = {"7d": 7, "30d": 30}[period]
    counts = daily_counts(news, period, as_of, tz)
    dense = news.sparkSession.range(days).select(F.col("id").cast("int").alias("bucket"), F.date_add(F.lit(as_of), (F.col("id") - (days - 1)).cast("int")).alias("start"))
    return dense.join(F.broadcast(counts), dense["start"] == counts["day"], "left").select("bucket", "start", F.col("start").alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def rolling_buckets(news: DataFrame, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """(bucket, start, end, count): buckets of 7 or 30 days that roll back from ``as_of`` over all verified
    news, with one empty leading bucket; news dated later fall in none. Only counts by day are joined."""
    counts = daily_counts(news, "all", as_of, tz)
    span = counts.agg(F.coalesce(F.datediff(F.lit(as_of), F.min("day")), F.lit(0)).alias("d")).withColumn("s", F.when(F.col("d") + 1 <= 364, 7).otherwise(30))
    n = F.when(F.col("d") < 0, 1).otherwise(F.floor(F.col("d") / F.col("s")).cast("int") + 2)
    dense = span.select("s", n.alias("n")).select("s", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    by_bucket = counts.where(F.col("day") <= F.lit(as_of)).crossJoin(F.broadcast(span.select("s"))).groupBy(F.floor(F.datediff(F.lit(as_of), "day") / F.col("s")).cast("int").alias("_i")).agg(F.sum("count").alias("count"))
    end = F.date_sub(F.lit(as_of), (F.col("i") * F.col("s")).cast("int"))
    return dense.join(by_bucket, dense["i"] == by_bucket["_i"], "left").select((F.col("n") - 1 - F.col("i")).alias("bucket"), F.date_sub(end, (F.col("s") - 1).cast("int")).alias("start"), end.alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def trend_points(buckets: DataFrame) -> DataFrame:
    """Buckets with pct, is_current, show_label, labels and has_trend_data. A few hundred rows at most."""
    whole = Window.partitionBy()
    n, top = F.count(F.lit(1)).over(whole), F.max("count").over(whole)
    interval = F.greatest(F.lit(1), F.bround(n / 6).cast("int"))
    mm = lambda c: F.date_format(c, "MM/dd")
    label = F.when(F.col("start") == F.col("end"), mm("start")).otherwise(F.concat(mm("start"), F.lit("~"), mm("end")))
    last = F.col("bucket") == n - 1
    return buckets.select("bucket", "start", "end", "count", pct(F.col("count"), top).alias("pct"), last.alias("is_current"), ((F.col("bucket") % interval == 0) | last).alias("show_label"), mm("start").alias("label"), label.alias("range_label"), (top > 0).alias("has_trend_data"))


def entity_counts(news: DataFrame, bridge: DataFrame, entities: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """(id, name, count) of the active entities with verified news in the period. The bridge has a pair
    once; counts are partial before they are shuffled, so a very common entity is no hot key."""
    chosen = in_period(verified(news), period, as_of, tz).select(F.col("id").alias("news_id"))
    counts = bridge.dropDuplicates(["news_id", "entity_id"]).join(chosen, "news_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("count"))
    return entities.where("is_active").join(counts, F.col("id") == F.col("entity_id")).drop("entity_id")


def ranking(news: DataFrame, bridge: DataFrame, entities: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL, top: int = 10, titles: int = 5) -> DataFrame:
    """(rank, id, name, count, pct, recent_titles, more_count): the top entities with their newest news.
    News are listed for the top entities alone."""
    counts = entity_counts(news, bridge, entities, period, as_of, tz)
    best = counts.orderBy(F.desc("count"), "name").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "name"))).withColumn("pct", pct(F.col("count"), F.max("count").over(Window.partitionBy())))
    chosen = in_period(verified(news), period, as_of, tz).select(F.col("id").alias("news_id"), "title", "published_at")
    theirs = bridge.dropDuplicates(["news_id", "entity_id"]).join(F.broadcast(best.select(F.col("id").alias("entity_id"))), "entity_id").join(chosen, "news_id")
    newest = Window.partitionBy("entity_id").orderBy(F.desc("published_at"), F.desc("news_id"))
    listed = theirs.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= titles).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("n", "title"))).alias("t"))
    shown = F.coalesce(F.size("t"), F.lit(0))
    return best.join(listed, F.col("id") == F.col("entity_id"), "left").select("rank", "id", "name", "count", "pct", F.col("t.title").alias("recent_titles"), F.greatest(F.col("count") - shown, F.lit(0)).alias("more_count"))


def topic_news_counts_all(bridge: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, name, count) of every topic, zero and inactive too, without gate or period."""
    counts = bridge.groupBy("entity_id").agg(F.count_distinct("news_id").alias("n"))
    return topics.join(counts, F.col("id") == F.col("entity_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("count"))


def orgs_by_type(orgs: DataFrame) -> DataFrame:
    """(org_type, count) for each type, none left out, and a total under null."""
    types = orgs.sparkSession.createDataFrame([(x,) for x in S.ORG_TYPES], "org_type string")
    counts = orgs.groupBy("org_type").agg(F.count(F.lit(1)).alias("n"))
    by_type = types.join(counts, "org_type", "left").select("org_type", F.coalesce("n", F.lit(0)).alias("count"))
    return by_type.union(orgs.agg(F.lit(None).cast("string"), F.count(F.lit(1))))


def insight_summary(insights: DataFrame, insight_news: DataFrame, news: DataFrame) -> DataFrame:
    """Insights with news_count and latest_news_at over all their news, gated or not."""
    linked = insight_news.join(news.select(F.col("id").alias("news_id"), "published_at"), "news_id").groupBy("insight_id").agg(F.count(F.lit(1)).alias("news_count"), F.max("published_at").alias("latest_news_at"))
    out = insights.join(linked, insights["id"] == linked["insight_id"], "left").drop("insight_id")
    return out.withColumn("news_count", F.coalesce("news_count", F.lit(0)))


def headliners(summary: DataFrame, n: int = 2) -> DataFrame:
    return summary.where("headliner_order is not null").orderBy("headliner_order").limit(n)


def top_issues(summary: DataFrame, n: int = 20) -> DataFrame:
    """Insights that are no headliners, by their newest news, those without news last."""
    return summary.where("headliner_order is null").orderBy(F.desc_nulls_last("latest_news_at"), F.desc("id")).limit(n)


def latest_news(news: DataFrame, n: int = 30) -> DataFrame:
    return verified(news).orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def verification_status(news: DataFrame, orphan_count: DataFrame, as_of: dt.date, tz: str = S.SEOUL, stale_days: int = 2) -> DataFrame:
    waits = F.col("status") == S.UNVERIFIED
    row = news.agg(F.count(F.when(waits, 1)).alias("unverified_count"), local_date(F.min(F.when(waits, F.col("collected_at"))), tz).alias("oldest_unverified_at"), F.max(F.when(F.col("status") == S.VERIFIED, F.col("verified_at"))).alias("last_verified_at"))
    days = F.datediff(F.lit(as_of), "oldest_unverified_at")
    tier = F.when(F.col("unverified_count") == 0, "clear").when(days >= stale_days, "stale").otherwise("pending")
    return row.withColumn("unverified_days", days).withColumn("unverified_tier", tier).crossJoin(orphan_count.agg(F.count(F.lit(1)).alias("orphan_relation_count")))


def last_collected_at(news: DataFrame) -> DataFrame:
    return news.agg(F.max("collected_at").alias("last_collected_at"))


def search_news(news: DataFrame, q: str = "", date_from: dt.date | None = None, date_to: dt.date | None = None, source: str = "", org_type: str = "", bridge: DataFrame | None = None, orgs: DataFrame | None = None, tz: str = S.SEOUL) -> DataFrame:
    out, day = verified(news), local_date(F.col("published_at"), tz)
    if q.strip():
        out = out.where(F.contains(F.upper("title"), F.upper(F.lit(q.strip()))))
    if date_from:
        out = out.where(day >= F.lit(date_from))
    if date_to:
        out = out.where(day <= F.lit(date_to))
    if source:
        out = out.where(F.col("source_type") == source)
    if org_type == "기타":
        return news_without_org(out, bridge)
    return news_of_org_type(out, bridge, orgs, org_type) if org_type else out


def news_of_org_type(news: DataFrame, bridge: DataFrame, orgs: DataFrame, org_type: str) -> DataFrame:
    """News with an active organisation of the type."""
    of_type = orgs.where(F.col("is_active") & (F.col("org_type") == org_type)).select(F.col("id").alias("entity_id"))
    tagged = bridge.join(of_type, "entity_id", "left_semi").select(F.col("news_id").alias("id"))
    return news.join(tagged, "id", "left_semi")


def news_without_org(news: DataFrame, bridge: DataFrame) -> DataFrame:
    return news.join(bridge.select(F.col("news_id").alias("id")), "id", "left_anti")


#: Rows that one task may order for a page.
DEEP = 10_000


def ranked(df: DataFrame, order: list[Column], name: str = "n", tiles: int | None = None) -> DataFrame:
    """Adds the 1-based place of each row in a global order without sorting in one task: rows are dealt
    by ranges, numbered in each, and offset by the counts of the ranges before, a few numbers."""
    spark = df.sparkSession
    tiles = tiles or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tiles, *order).withColumn("_tile", F.spark_partition_id())
    ensure_checkpoints(spark)
    dealt = dealt.checkpoint()  # range bounds are sampled: fix the tiles for both uses
    within = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_tile").orderBy(*order)))
    before = Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_tile").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_tile", "_o")
    return within.join(F.broadcast(offsets), "_tile").withColumn(name, F.col("_o") + F.col("_r")).drop("_tile", "_r", "_o")


def list_page(news: DataFrame, page: object = 1, size: int = 20, order: str = "newest") -> DataFrame:
    """One page of the verified list with total_count; a page that is no number is the first, one out of
    range the last. Pages near the front take the best rows alone; deep ones number the rows by ranges."""
    rows = verified(news)
    total = rows.count()
    last = max(1, -(-total // size))
    try:
        n = int(page)
    except (TypeError, ValueError):
        n = 1
    n = n if 1 <= n <= last else last
    by = [F.col("published_at"), F.col("id")] if order == "oldest" else [F.desc("published_at"), F.desc("id")]
    first = (n - 1) * size
    if first + size <= DEEP:
        out = rows.orderBy(*by).offset(first).limit(size)
    else:
        out = ranked(rows, by, "_place").where(F.col("_place").between(first + 1, first + size)).orderBy("_place").drop("_place")
    return out.withColumn("total_count", F.lit(total).cast("long"))


def adjacent_news(news: DataFrame) -> DataFrame:
    """(id, prev_id, next_id) for every article, gated or not: the next newer and older verified one.

    Days are the tiles: within a day a window sees its own rows; across days only each day's first and
    last verified article are carried, one row a day. What follows a row is what precedes it in the other order,
    since Spark reads a frame that ends with the partition anew for each row.
    """
    ok = F.col("status") == S.VERIFIED
    rows = news.select("id", "published_at", ok.alias("ok"), F.to_date("published_at").alias("day"), F.when(ok, F.col("id")).alias("v"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("day")
    below, above = before(day.orderBy("published_at", "id")), before(day.orderBy(F.desc("published_at"), F.desc("id")))
    inner = rows.withColumn("older", F.last("v", True).over(below)).withColumn("newer", F.last("v", True).over(above))
    ends = rows.groupBy("day").agg(F.min(F.when(F.col("ok"), F.struct("published_at", "id"))).alias("lo"), F.max(F.when(F.col("ok"), F.struct("published_at", "id"))).alias("hi"))
    ends = ends.select("day", F.last("hi.id", True).over(before(Window.orderBy("day"))).alias("b"), F.last("lo.id", True).over(before(Window.orderBy(F.desc("day")))).alias("a"))
    return inner.join(ends, inner["day"].eqNullSafe(ends["day"])).select("id", F.coalesce("newer", "a").alias("prev_id"), F.coalesce("older", "b").alias("next_id"))


def latest_per_entity(news: DataFrame, bridge: DataFrame, period: str, as_of: dt.date, k: int = 10, tz: str = S.SEOUL) -> DataFrame:
    """(entity_id, place, news_id, total_count): the newest verified news of each entity, and how many there are."""
    chosen = in_period(verified(news), period, as_of, tz).select(F.col("id").alias("news_id"), "published_at")
    rows = bridge.dropDuplicates(["news_id", "entity_id"]).join(chosen, "news_id")
    newest = Window.partitionBy("entity_id").orderBy(F.desc("published_at"), F.desc("news_id"))
    top = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)
    totals = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_count"))
    return top.join(totals, "entity_id").select("entity_id", "place", "news_id", "total_count")


def list_by_day(news: DataFrame, tz: str = S.SEOUL) -> DataFrame:
    """The verified list with its local date and the place in the day."""
    day = local_date(F.col("published_at"), tz)
    rows = verified(news).withColumn("local_date", day)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("local_date").orderBy(F.desc("published_at"), F.desc("id"))))


#: Rows that a task lists, about.
LISTED = 32_000_000


def article_links(news_ids: DataFrame, insight_news: DataFrame, bridge: DataFrame, orgs: DataFrame) -> DataFrame:
    """(news_id, kind, target_id) for the requested articles: insight, linked_org and unlinked_org. Unlinked organisations
    are listed for each article, so the rows are articles by organisations. An article's tags are few and stand beside it,
    so these rows are made in as many tasks as their number needs and never shuffled; the active organisations are
    a dictionary that each task holds."""
    ids, active = news_ids.select("news_id").distinct(), orgs.where("is_active").select(F.col("id").alias("target_id"))
    own = bridge.join(ids, "news_id", "left_semi")
    linked = own.select("news_id", F.lit("linked_org").alias("kind"), F.col("entity_id").alias("target_id"))
    tags = own.groupBy("news_id").agg(F.collect_set("entity_id").alias("_tags"))
    tasks = max(ids.sparkSession.sparkContext.defaultParallelism, ids.count() * active.count() // LISTED + 1)
    pairs = ids.join(tags, "news_id", "left").repartition(tasks).crossJoin(F.broadcast(active))
    rest = pairs.where(~F.coalesce(F.array_contains("_tags", F.col("target_id")), F.lit(False))).select("news_id", F.lit("unlinked_org").alias("kind"), "target_id")
    return insight_news.join(ids, "news_id", "left_semi").select("news_id", F.lit("insight").alias("kind"), F.col("insight_id").alias("target_id")).union(linked).union(rest)


def recent_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    return logs.orderBy(F.desc("started_at")).limit(n)


def report_list(reports: DataFrame) -> DataFrame:
    """Reports by year, newest first in each."""
    place = F.row_number().over(Window.partitionBy(F.year("date_from")).orderBy(F.desc("date_from"), F.desc("id")))
    return reports.select(F.year("date_from").alias("year"), place.alias("place"), "id", "date_from")


def recent_sent(reports: DataFrame, n: int = 10) -> DataFrame:
    return reports.where("slack_sent_at is not null").orderBy(F.desc("slack_sent_at"), F.desc("id")).limit(n)
