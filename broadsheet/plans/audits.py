"""Registered queries: audits of batches, keywords, tags and insights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import verified
from ..operators import audit, similarity
from ..sources.adapters import Tables
from .prelude import query

_BATCH = "CAST(collected_at + INTERVAL 9 HOUR AS DATE)"


def _effect(t: Tables):
    gone = t.news.where("id % 9 = 0")
    return audit.batch_effect(t.news.where("id % 9 <> 0"), gone)


_EFFECT = f"""effect AS (SELECT batch, keyword, count(*) AS collected, CAST(sum(gone) AS BIGINT) AS deleted, CAST(grouping(batch, keyword) AS INTEGER) AS level, count(*) - CAST(sum(gone) AS BIGINT) AS kept, sum(gone) / count(*) AS deletion_rate
FROM (SELECT {_BATCH} AS batch, unnest(matched_keywords) AS keyword, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS gone FROM news) GROUP BY CUBE (batch, keyword))"""


@query("news", f"SELECT * FROM (WITH {_EFFECT} SELECT * FROM effect)")
def a12_batch_effect(t: Tables):
    return _effect(t)


@query("news", f"SELECT * FROM (WITH {_EFFECT} SELECT batch, deletion_rate, deletion_rate - lag(deletion_rate) OVER (ORDER BY batch) AS change FROM effect WHERE level = 1)")
def w7_batch_over_batch(t: Tables):
    return audit.batch_over_batch(_effect(t))


def _records(t: Tables):
    n = F.col("id")
    return t.news.where(n % 9 == 0).select(F.concat(F.lit("c"), n % 4).alias("criterion_code"), F.when(n % 2 == 0, S.RA).otherwise(S.USER_DELETE).alias("judged_by"), "collected_at", F.when(n % 5 == 0, F.col("collected_at")).otherwise(F.expr("collected_at + interval 3 days")).alias("judged_at"))


_RECORDS = "(SELECT 'c' || (id % 4) AS criterion_code, CASE WHEN id % 2 = 0 THEN 'RA' ELSE '사용자(화면 삭제)' END AS judged_by, id % 5 = 0 AS same FROM news WHERE id % 9 = 0)"


@query("news", f"SELECT criterion_code, judged_by, count(*) AS deletions, CAST(grouping(criterion_code, judged_by) AS INTEGER) AS level FROM {_RECORDS} GROUP BY ROLLUP (criterion_code, judged_by)")
def a13_criterion_counts(t: Tables):
    return audit.criterion_counts(_records(t))


@query("news", f"SELECT criterion_code, count(*) FILTER (same) AS new, count(*) FILTER (NOT same) AS retroactive FROM {_RECORDS} GROUP BY criterion_code")
def a13_retroactive_split(t: Tables):
    return audit.retroactive_split(_records(t))


@query("news keywords", """
SELECT keyword, count(*) AS matched, count(*) FILTER (n = 1) AS sole, count(*) FILTER (n > 1) AS shared FROM (
  SELECT keyword, count(*) OVER (PARTITION BY n.id) AS n FROM news n JOIN keywords k ON collects AND k.is_active AND contains(lower(title || ' ' || body), keyword)) GROUP BY keyword""")  # fmt: skip
def a14_keyword_attribution(t: Tables):
    return audit.keyword_attribution(t.news, t.keywords)


@query("news", "SELECT CAST(len(matched_keywords) AS INTEGER) AS keywords, count(*) AS articles FROM news GROUP BY 1")
def a15_multi_keyword_histogram(t: Tables):
    return audit.multi_keyword_histogram(t.news)


@query("hits", """
SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, size_a, size_a - c AS missing FROM (
  SELECT x.keyword, y.keyword AS kb, count(*) AS c FROM (SELECT DISTINCT keyword, url FROM hits WHERE url IS NOT NULL) x JOIN (SELECT DISTINCT keyword, url FROM hits WHERE url IS NOT NULL) y ON x.url = y.url AND x.keyword <> y.keyword GROUP BY ALL) p
JOIN (SELECT keyword, count(DISTINCT url) AS size_a FROM hits GROUP BY keyword) a ON a.keyword = p.keyword JOIN (SELECT DISTINCT keyword FROM hits) b ON b.keyword = kb""")  # fmt: skip
def a16_keyword_redundancy(t: Tables):
    from ..functions.scalars import pick_url

    return audit.keyword_redundancy(t.hits.select("keyword", pick_url(F.col("originallink"), F.col("link")).alias("url_hash")).where("url_hash is not null"))


@query("news", f"""
SELECT *, coalesce(sum(CAST(over AS INTEGER)) OVER (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3, false) AS alarm FROM (
  SELECT batch, articles, absent, gone AS absent_deleted, absent > 0.15 * articles AND gone >= 0.9 * absent AS over FROM (
    SELECT {_BATCH} AS batch, count(*) AS articles, count(*) FILTER (absent) AS absent, count(*) FILTER (absent AND id % 3 = 0) AS gone FROM (SELECT *, NOT contains(lower(title), CASE WHEN id % 2 = 0 THEN 'order' ELSE 'brief' END) AS absent FROM news) GROUP BY 1))""")  # fmt: skip
def a17_subject_not_in_title(t: Tables):
    rows = t.news.select("collected_at", "title", F.when(F.col("id") % 2 == 0, "Order").otherwise("Brief").alias("subject"), (F.col("id") % 3 == 0).alias("deleted"))
    return audit.subject_not_in_title(rows)


@query("ok topics news_topics", """
SELECT name, coalesce(n, 0) AS count, coalesce(n, 0) / total AS share, coalesce(n, 0) / total > 0.3 AND total >= 100 AS flagged FROM topics
LEFT JOIN (SELECT entity_id, count(DISTINCT news_id) AS n FROM news_topics JOIN ok ON ok.id = news_id GROUP BY entity_id) ON entity_id = topics.id, (SELECT count(*) AS total FROM ok) WHERE is_active""")  # fmt: skip
def a18_topic_share_review(t: Tables):
    return audit.topic_share_review(t.news, t.news_topics, t.topics)


@query("ok news_orgs news_topics", "SELECT count(*) AS news, count(*) FILTER (id IN (SELECT news_id FROM news_orgs)) AS with_org, count(*) FILTER (id IN (SELECT news_id FROM news_topics)) AS with_topic FROM ok")
def a19_tag_coverage(t: Tables):
    return audit.tag_coverage(t.news, t.news_orgs, t.news_topics)


@query("orgs news_orgs", "SELECT id, name FROM orgs WHERE id NOT IN (SELECT entity_id FROM news_orgs)")
def a19_unlinked_entities(t: Tables):
    return audit.unlinked_entities(t.orgs, t.news_orgs)


def _regraded(t: Tables):
    n = F.col("id")
    return t.insights.select(n, F.when(n % 5 == 0, "1").when(n % 7 == 0, "unspecified").otherwise(F.col("grade")).alias("grade"))


_MOVED = "(SELECT id, grade AS old, CASE WHEN id % 5 = 0 THEN '1' WHEN id % 7 = 0 THEN 'unspecified' ELSE grade END AS new FROM insights)"


@query("insights", "SELECT grade, count(*) AS insights FROM insights GROUP BY grade")
def a22_grade_distribution(t: Tables):
    return audit.grade_distribution(t.insights)


@query("insights", f"""SELECT old, {", ".join(f"count(*) FILTER (new = '{g}') AS \"{g}\"" for g in audit.GRADES)} FROM {_MOVED} GROUP BY old""")
def a22_grade_crosstab(t: Tables):
    return audit.grade_crosstab(t.insights, _regraded(t))


@query("insights", f"SELECT id, old, new, CASE WHEN old = 'unspecified' OR new = 'unspecified' THEN 'unspecified' WHEN new < old THEN 'up' ELSE 'down' END AS move FROM {_MOVED} WHERE old <> new")
def a22_grade_moves(t: Tables):
    return audit.grade_moves(t.insights, _regraded(t))


@query("insights insight_news", "SELECT evidence, count(*) AS insights, evidence >= 6 AS flagged FROM (SELECT i.id, count(news_id) AS evidence FROM insights i LEFT JOIN insight_news ON insight_id = i.id GROUP BY i.id) GROUP BY evidence")
def a23_insight_evidence_dist(t: Tables):
    return audit.insight_evidence_dist(t.insights, t.insight_news)


@query("ok insight_news", "SELECT count(*) AS news, count(n) AS tied, count(*) FILTER (n > 1) AS tied_to_several FROM ok LEFT JOIN (SELECT news_id, count(DISTINCT insight_id) AS n FROM insight_news GROUP BY news_id) ON news_id = id")
def a23_news_in_insights(t: Tables):
    return audit.news_in_insights(t.news, t.insight_news)


@query("news insights relations excluded", """
SELECT *, after - before AS change FROM (SELECT 'news ' || status AS "table", count(*) AS before, count(*) FILTER (id % 9 <> 0) AS after FROM news GROUP BY status
UNION ALL SELECT 'excluded', count(*), count(*) FROM excluded UNION ALL SELECT 'insight', count(*), count(*) FROM insights UNION ALL SELECT 'relations', count(*), count(*) FROM relations)""")  # fmt: skip
def a24_corpus_counts(t: Tables):
    tables = {"excluded": t.excluded, "insight": t.insights, "relations": t.relations}
    return audit.count_changes(audit.corpus_counts(t.news, **tables), audit.corpus_counts(t.news.where("id % 9 <> 0"), **tables))


def _logs(t: Tables):
    e = t.raw("events")
    return e.select(F.col("ts").cast("timestamp").alias("started_at"), (F.col("event_id") % 7).cast("int").alias("collected_count"), F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("status"), F.when(F.col("user_id") % 2 == 0, "auto").otherwise("manual").alias("actor"), F.col("event_id").alias("log_id"))


@query("", """SELECT day, actor, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(c) AS BIGINT) AS collected, CAST(grouping(day, actor) AS INTEGER) AS level
FROM (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CASE WHEN user_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS actor, event_type, event_id % 7 AS c FROM events) GROUP BY ROLLUP (day, actor)""")  # fmt: skip
def a26_log_summary(t: Tables):
    return audit.log_summary(_logs(t))


@query("", "SELECT event_id AS log_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def k5_recent_logs(t: Tables):
    from ..operators.metrics import recent_logs

    return recent_logs(_logs(t)).select("log_id")


@query("corrections", "SELECT op_ord, news_id FROM corrections WHERE news_id % 5 = 0")
def a27_correction_loss(t: Tables):
    gone = t.raw("documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("news_id"))
    return audit.correction_loss(t.corrections, gone).select("op_ord", "news_id")


@query("ok", "SELECT day, count(*) AS count, CAST(day - lag(day) OVER (ORDER BY day) - 1 AS INTEGER) AS gap_days FROM ok GROUP BY day")
def w8_series_gaps(t: Tables):
    return audit.series_gaps(verified(t.news))


@query("news", "SELECT id, CAST((row_number() OVER (ORDER BY published_at DESC, id DESC) - 1) // 128 AS BIGINT) AS batch FROM news")
def w5_assign_batches(t: Tables):
    from ..operators.judgment import assign_batches
    from ..operators.metrics import ranked

    return assign_batches(ranked(t.news.select("id", "published_at"), [F.desc("published_at"), F.desc("id")]), 128).select("id", "batch")


@query("", """
SELECT strftime(check_at, '%Y-%m-%d %H:%M') AS check_at, CASE WHEN last_fire IS NULL OR last_run >= last_fire THEN 'clear' WHEN check_at >= last_fire + INTERVAL 15 HOUR THEN 'stale' ELSE 'pending' END AS state FROM (
  SELECT check_at, (SELECT max(ts) FROM events WHERE event_type = 'error' AND ts <= check_at) AS last_run, (SELECT max(f) FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS f) WHERE dayofweek(f) BETWEEN 1 AND 5 AND f <= check_at) AS last_fire
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 03:30:00', TIMESTAMP '2024-03-30', INTERVAL 7 HOUR)) AS check_at))""")  # fmt: skip
def j11_missed_runs(t: Tables):
    """Checks every seven hours against runs that are the error events; fires at 09:00 in Seoul."""
    checks = t.spark.sql("select explode(sequence(timestamp'2024-01-02 03:30:00', timestamp'2024-03-30 00:00:00', interval 7 hours)) as check_at")
    runs = t.raw("events").where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("started_at"))
    out = audit.missed_runs(checks, runs, dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    return out.select(F.date_format("check_at", "yyyy-MM-dd HH:mm").alias("check_at"), "state")


_UNIT = "(SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"


_SIMILAR = f"""m AS (SELECT id, u, min(id) OVER (PARTITION BY u) AS rep FROM {_UNIT}), reps AS (SELECT id, u FROM m WHERE id = rep),
links AS (SELECT a.id AS a, b.id AS b FROM reps a JOIN reps b ON a.id < b.id WHERE list_dot_product(a.u, b.u) >= 0.82)"""


@query("", f"WITH {_SIMILAR} SELECT id AS news_id, rep AS class_id, (SELECT count(*) FROM links WHERE a = rep OR b = rep) AS links FROM m")
def j12_similar_pairs(t: Tables):
    """Each article's class of equal vectors and its number of related classes."""
    return similarity.similar_counts(t.embeddings)


@query("", f"""SELECT query_id, CAST(place AS INTEGER) AS place, news_id FROM (SELECT q.id AS query_id, b.id AS news_id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.u, b.u), 9) DESC, b.id) AS place FROM {_UNIT} q JOIN {_UNIT} b ON q.id <> b.id WHERE q.id % 50 = 0) WHERE place <= 5""")
def j13_similar_topk(t: Tables):
    queries = t.embeddings.where("news_id % 50 = 0")
    return similarity.similar_topk(t.embeddings, queries).select("query_id", "place", "news_id")


@query("articles", rf"""SELECT * FROM (WITH RECURSIVE {_SIMILAR},
keyed AS (SELECT id, regexp_replace(lower(regexp_replace(title, '^\s*\[[^\]]+\]', '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+', '', 'g') AS k FROM articles),
edges AS (SELECT id AS a, min(id) OVER (PARTITION BY k) AS b FROM keyed WHERE k <> '' UNION SELECT a, b FROM links UNION SELECT id, rep FROM m),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS g FROM reach GROUP BY a)
SELECT id, group_id, id = first_value(id) OVER (PARTITION BY group_id ORDER BY published_at, id) AS is_representative FROM (SELECT id, published_at, coalesce(g, id) AS group_id FROM articles LEFT JOIN least ON a = id))""")  # fmt: skip
def a25_criterion_duplicates(t: Tables):
    """Candidate groups from equal urls and titles and from related embeddings."""
    return similarity.duplicate_groups(t.articles, similarity.similar_links(t.embeddings))
