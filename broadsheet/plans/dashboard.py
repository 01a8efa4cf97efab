"""Registered queries: metrics, rankings, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import local_date, verified
from ..operators import graph, metrics
from ..sources.adapters import AS_OF, Tables
from .prelude import query

_7, _30 = "day BETWEEN DATE '2001-07-26' AND DATE '2001-08-01'", "day BETWEEN DATE '2001-07-03' AND DATE '2001-08-01'"


def _ranking_sql(bridge: str, entities: str, where: str) -> str:
    return f"""
SELECT CAST(rank AS INTEGER) AS rank, c.id, name, count, CAST(round_even(count / max(count) OVER () * 100, 0) AS INTEGER) AS pct, titles AS recent_titles, greatest(count - least(count, 5), 0) AS more_count
FROM (SELECT row_number() OVER (ORDER BY count DESC, name) AS rank, * FROM (
  SELECT e.id, e.name, count(*) AS count FROM {entities} e JOIN {bridge} b ON b.entity_id = e.id JOIN ok ON ok.id = b.news_id WHERE e.is_active AND {where} GROUP BY e.id, e.name) ORDER BY rank LIMIT 10) c
JOIN (SELECT entity_id, list(title ORDER BY n) AS titles FROM (
  SELECT entity_id, title, row_number() OVER (PARTITION BY entity_id ORDER BY published_at DESC, id DESC) AS n FROM {bridge} b JOIN ok ON ok.id = b.news_id WHERE {where}) WHERE n <= 5 GROUP BY entity_id) t ON t.entity_id = c.id"""


@query("ok orgs news_orgs", _ranking_sql("news_orgs", "orgs", _30))
def w1_org_ranking(t: Tables):
    return metrics.ranking(t.news, t.news_orgs, t.orgs, "30d", AS_OF)


@query("ok topics news_topics", _ranking_sql("news_topics", "topics", "true"))
def w1_topic_ranking(t: Tables):
    return metrics.ranking(t.news, t.news_topics, t.topics, "all", AS_OF)


@query("ok", f"SELECT day, count(*) AS count FROM ok WHERE {_30} GROUP BY day")
def a1_daily_counts(t: Tables):
    return metrics.daily_counts(t.news, "30d", AS_OF)


@query("ok", f"SELECT CAST(i AS INTEGER) AS bucket, d AS start, d AS \"end\", count(id) AS count FROM (SELECT i, CAST(DATE '2001-07-26' + to_days(CAST(i AS INTEGER)) AS DATE) AS d FROM (SELECT unnest(range(7)) AS i)) LEFT JOIN ok ON day = d GROUP BY ALL")
def a2_day_buckets(t: Tables):
    return metrics.day_buckets(t.news, "7d", AS_OF)


@query("ok rolling", "SELECT * FROM rolling")
def a3_rolling_buckets(t: Tables):
    return metrics.rolling_buckets(t.news, AS_OF)


@query(
    "ok rolling",
    """SELECT bucket, start, "end", count, CAST(CASE WHEN m = 0 THEN 0 ELSE round_even(count / m * 100, 0) END AS INTEGER) AS pct, bucket = n - 1 AS is_current, bucket % greatest(1, CAST(round_even(n / 6, 0) AS INTEGER)) = 0 OR bucket = n - 1 AS show_label,
  strftime(start, '%m/%d') AS label, strftime(start, '%m/%d') || '~' || strftime("end", '%m/%d') AS range_label, m > 0 AS has_trend_data FROM (SELECT *, count(*) OVER () AS n, max(count) OVER () AS m FROM rolling)""",
)
def a4_trend_points(t: Tables):
    return metrics.trend_points(metrics.rolling_buckets(t.news, AS_OF))


@query("ok orgs news_orgs", "SELECT o.id, o.name, count(*) AS count FROM orgs o JOIN news_orgs ON entity_id = o.id JOIN ok ON ok.id = news_id WHERE is_active GROUP BY o.id, o.name")
def a5_org_counts(t: Tables):
    return metrics.entity_counts(t.news, t.news_orgs, t.orgs, "all", AS_OF).select("id", "name", "count")


@query("ok topics news_topics", f"SELECT o.id, o.name, count(DISTINCT news_id) AS count FROM topics o JOIN news_topics ON entity_id = o.id JOIN ok ON ok.id = news_id WHERE is_active AND {_30} GROUP BY o.id, o.name")
def a6_topic_counts(t: Tables):
    return metrics.entity_counts(t.news, t.news_topics, t.topics, "30d", AS_OF).select("id", "name", "count")


@query("topics news_topics", "SELECT id, name, count(DISTINCT news_id) AS count FROM topics LEFT JOIN news_topics ON entity_id = id GROUP BY id, name")
def a7_topic_news_counts_all(t: Tables):
    return metrics.topic_news_counts_all(t.news_topics, t.topics)


@query("orgs", "SELECT org_type, count(*) AS count FROM orgs GROUP BY ROLLUP (org_type)")
def a8_orgs_by_type(t: Tables):
    return metrics.orgs_by_type(t.orgs)


_SUMMARY = "SELECT i.id, i.title, i.headliner_order, count(n.id) AS news_count, CAST(max(published_at) AS DATE) AS latest FROM insights i LEFT JOIN insight_news ON insight_id = i.id LEFT JOIN news n ON n.id = news_id GROUP BY ALL"


def _summary(t: Tables):
    return metrics.insight_summary(t.insights, t.insight_news, t.news)


@query("insights insight_news news", _SUMMARY)
def a9_insight_summary(t: Tables):
    return _summary(t).select("id", "title", "headliner_order", "news_count", F.to_date("latest_news_at").alias("latest"))


@query("insights insight_news news", f"SELECT id, news_count, headliner_order FROM ({_SUMMARY}) WHERE headliner_order IS NOT NULL ORDER BY headliner_order LIMIT 2")
def k3_headliners(t: Tables):
    return metrics.headliners(_summary(t)).select("id", "news_count", "headliner_order")


@query("insights insight_news news", f"SELECT id, news_count, latest FROM ({_SUMMARY}) WHERE headliner_order IS NULL ORDER BY latest DESC NULLS LAST, id DESC LIMIT 20")
def k4_top_issues(t: Tables):
    return metrics.top_issues(_summary(t)).select("id", "news_count", F.to_date("latest_news_at").alias("latest"))


@query("ok", "SELECT id, title FROM ok ORDER BY published_at DESC, id DESC LIMIT 30")
def k2_latest_news(t: Tables):
    return metrics.latest_news(t.news).select("id", "title")


@query("news relations pairs", """
SELECT *, CASE WHEN unverified_count = 0 THEN 'clear' WHEN unverified_days >= 2 THEN 'stale' ELSE 'pending' END AS unverified_tier FROM (
  SELECT unverified_count, oldest_unverified_at, CAST(DATE '2001-08-01' - oldest_unverified_at AS INTEGER) AS unverified_days, last_verified, (SELECT count(*) FROM relations r WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.org_a = r.org_a AND p.org_b = r.org_b)) AS orphan_relation_count
  FROM (SELECT count(*) FILTER (status <> '검증됨') AS unverified_count, CAST(min(collected_at) FILTER (status <> '검증됨') + INTERVAL 9 HOUR AS DATE) AS oldest_unverified_at, CAST(max(verified_at) AS DATE) AS last_verified FROM news))""")  # fmt: skip
def a10_verification_status(t: Tables):
    status = metrics.verification_status(t.news, graph.orphan_relations(t.news, t.news_orgs, t.ruled), AS_OF)
    return status.withColumn("last_verified", F.to_date("last_verified_at")).drop("last_verified_at")


@query("news", "SELECT CAST(max(collected_at) AS DATE) AS last_collected FROM news")
def a11_last_collected_at(t: Tables):
    return metrics.last_collected_at(t.news).select(F.to_date("last_collected_at").alias("last_collected"))


@query("ok", "SELECT id, total_count FROM (SELECT id, count(*) OVER () AS total_count, row_number() OVER (ORDER BY published_at DESC, id DESC) AS n FROM ok) WHERE n BETWEEN 41 AND 60")
def k1_list_page(t: Tables):
    return metrics.list_page(t.news, 3).select("id", "total_count")


@query("ok", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY published_at, id) AS n, count(*) OVER () AS c FROM ok) WHERE n > (c - 1) // 20 * 20")
def k1_list_last_page_oldest(t: Tables):
    return metrics.list_page(t.news, 10**9, order="oldest").select("id")


@query("news", """
SELECT id, first_value(v IGNORE NULLS) OVER (ORDER BY published_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS prev_id, last_value(v IGNORE NULLS) OVER (ORDER BY published_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_id
FROM (SELECT id, published_at, CASE WHEN status = '검증됨' THEN id END AS v FROM news)""")  # fmt: skip
def w2_adjacent_news(t: Tables):
    return metrics.adjacent_news(t.news)


@query("ok news_orgs", f"SELECT entity_id, CAST(place AS INTEGER) AS place, news_id, total_count FROM (SELECT entity_id, news_id, row_number() OVER (PARTITION BY entity_id ORDER BY published_at DESC, news_id DESC) AS place, count(*) OVER (PARTITION BY entity_id) AS total_count FROM news_orgs JOIN ok ON id = news_id WHERE {_30}) WHERE place <= 10")
def w3_latest_per_entity(t: Tables):
    return metrics.latest_per_entity(t.news, t.news_orgs, "30d", AS_OF)


@query("ok", "SELECT id, day AS local_date, CAST(row_number() OVER (PARTITION BY day ORDER BY published_at DESC, id DESC) AS INTEGER) AS place FROM ok")
def w4_list_by_day(t: Tables):
    return metrics.list_by_day(t.news).select("id", "local_date", "place")


@query("ok orgs news_orgs", "SELECT id, title FROM ok WHERE contains(upper(title), 'ORDER 1') AND day >= DATE '1999-01-01' AND day <= DATE '2000-12-31' AND source_type = '2-HIGH' AND id IN (SELECT news_id FROM news_orgs JOIN orgs o ON o.id = entity_id WHERE is_active AND org_type = 'AI')")
def f4_search_news(t: Tables):
    import datetime as dt

    found = metrics.search_news(t.news, " order 1 ", dt.date(1999, 1, 1), dt.date(2000, 12, 31), "2-HIGH", "AI", t.news_orgs, t.orgs)
    return found.select("id", "title")


@query("ok orgs news_orgs", "SELECT id FROM ok WHERE id IN (SELECT news_id FROM news_orgs JOIN orgs o ON o.id = entity_id WHERE is_active AND org_type = '보험사')")
def j3_news_of_org_type(t: Tables):
    return metrics.news_of_org_type(verified(t.news), t.news_orgs, t.orgs, "보험사").select("id")


@query("news orgs news_orgs", "SELECT id FROM news WHERE id NOT IN (SELECT news_id FROM news_orgs JOIN orgs o ON o.id = entity_id WHERE org_type <> 'AI')")
def j4_news_without_org(t: Tables):
    others = t.news_orgs.join(t.orgs.where("org_type <> 'AI'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return metrics.news_without_org(t.news, others).select("id")


@query("news orgs news_orgs insight_news", """
SELECT news_id, 'insight' AS kind, insight_id AS target_id FROM insight_news WHERE news_id % 50 = 0 UNION ALL SELECT news_id, 'linked_org', entity_id FROM news_orgs WHERE news_id % 50 = 0
UNION ALL SELECT n.id, 'unlinked_org', o.id FROM news n, orgs o WHERE n.id % 50 = 0 AND is_active AND NOT EXISTS (SELECT 1 FROM news_orgs b WHERE b.news_id = n.id AND b.entity_id = o.id)""")  # fmt: skip
def j14_article_links(t: Tables):
    """The links of requested articles: those whose id is divisible by 50."""
    return metrics.article_links(t.news.where("id % 50 = 0").select(F.col("id").alias("news_id")), t.insight_news, t.news_orgs, t.orgs)


@query("ok", f"SELECT id FROM ok WHERE {_7}")
def f3_period_filter(t: Tables):
    from ..functions.scalars import in_period

    return in_period(verified(t.news), "7d", AS_OF).select("id")


@query("news", "SELECT id, CAST((row_number() OVER (ORDER BY published_at DESC, id DESC) - 1) // 128 AS BIGINT) AS batch FROM news WHERE id % 4 <> 0")
def j7_missing_embeddings(t: Tables):
    from ..operators.judgment import missing_embeddings

    return missing_embeddings(t.news, t.news.where("id % 4 = 0").select(F.col("id").alias("news_id")))


@query("news", "SELECT id, day FROM news")
def p10_local_date(t: Tables):
    return t.news.select("id", local_date(F.col("published_at")).alias("day"))
