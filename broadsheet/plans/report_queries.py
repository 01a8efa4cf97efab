"""Registered queries: reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, reports
from ..sources.adapters import Tables
from ..sources.tables import report_markdown
from .prelude import query


def _refs(t: Tables):
    return reports.report_refs(t.reports, t.news, canonical=False)


@query("reports", "SELECT id, 'Title ' || id AS body, regexp_extract(title, '^(.*) — ', 1) AS period, regexp_extract(title, '년 (.*)\\(', 1) AS short FROM reports")
def r1_split_report_title(t: Tables):
    c = F.col("title")
    return t.reports.select("id", reports.title_body(c).alias("body"), reports.title_period(c).alias("period"), reports.short_period(c).alias("short"))


_REFS = "['uid-' || (id + 1), 'bad', 'uid-' || (id + 1), 'uid-' || (id + 7)]"


@query("reports", f"""SELECT id AS report_id, 0 AS issue_no, 'First ' || id AS title, 'Body one.' || chr(10) || chr(10) || 'Implication.' AS body, {_REFS} AS refs FROM reports
UNION ALL SELECT id, 1, 'Second', 'Body two.' || chr(10) || '#### no issue' || chr(10) || '참고: not last' || chr(10) || 'End.', [] FROM reports""")
def r2_report_issues(t: Tables):
    return reports.report_issues(t.reports)


@query("reports", f"SELECT id AS report_id, unnest({_REFS}) AS token, CAST(generate_subscripts({_REFS}, 1) - 1 AS INTEGER) AS pos FROM reports")
def r3_split_ref_line(t: Tables):
    return reports.report_issues(t.reports).select("report_id", F.posexplode("refs").alias("pos", "token"))


@query("refs", "SELECT * FROM refs")
def r4_report_refs(t: Tables):
    return _refs(t)


@query("refs", "SELECT report_id, min(news_id) AS first_news, count(*) AS n FROM refs GROUP BY report_id")
def j8_resolve_refs(t: Tables):
    found = reports.resolve_refs(reports.report_issues(t.reports), t.news, canonical=False)
    return found.groupBy("report_id").agg(F.min_by("news_id", "ref_pos").alias("first_news"), F.count(F.lit(1)).alias("n"))


@query("refs", "SELECT report_id, issue_no, news_id, CAST(published_at AS DATE) BETWEEN date_from AND date_to AS in_period FROM refs JOIN news ON news.id = news_id JOIN reports ON reports.id = report_id")
def r5_out_of_period_refs(t: Tables):
    return reports.out_of_period_refs(_refs(t), t.reports, t.news, F.to_date("published_at"))


_DIFF = "(SELECT report_id, news_id, 'text' AS only_in FROM (SELECT report_id, news_id FROM refs EXCEPT SELECT * FROM report_news) UNION ALL SELECT report_id, news_id, 'link' FROM (SELECT * FROM report_news EXCEPT SELECT report_id, news_id FROM refs))"


@query("refs report_news", f"SELECT * FROM {_DIFF}")
def x3_ref_union_equals_report_news(t: Tables):
    return reports.ref_link_diff(_refs(t), t.report_news)


@query("refs report_news", f"""SELECT id AS report_id, 2::BIGINT AS issues, 1 + CAST(n = 0 AS BIGINT) AS issues_without_refs, 3 - n AS unresolved, 0::BIGINT AS long_blocks, false AS count_ok, id NOT IN (SELECT report_id FROM {_DIFF}) AS links_equal, status <> 'done' AS unfinished
FROM (SELECT r.*, (SELECT count(*) FROM refs WHERE report_id = r.id) AS n FROM reports r)""")
def r6_report_integrity(t: Tables):
    return reports.report_integrity(t.reports, reports.report_issues(t.reports), _refs(t), t.report_news)


@query("insights", "SELECT id, 0 AS foreign_sentences, CAST(length(coalesce(nullif(content_short, ''), content)) AS INTEGER) AS effective_length, length(coalesce(nullif(content_short, ''), content)) > 25 AS too_long FROM insights")
def r7_abridgement_check(t: Tables):
    return reports.abridgement_check(t.insights, 25, 25)


@query("insights", "SELECT id, 'Long text ' || id || '. Last.' AS short FROM insights")
def r8_extractive_short(t: Tables):
    return t.insights.select("id", reports.extractive_short(F.col("content"), F.array(F.lit(0), F.lit(2))).alias("short"))


@query("insight_news", "SELECT news_id, 1::BIGINT AS before, CASE WHEN news_id % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS after FROM insight_news WHERE news_id % 10 = 0 OR news_id % 11 = 0")
def r9_insight_split_check(t: Tables):
    """A split that loses every tenth article and repeats every eleventh."""
    after = t.insight_news.where("news_id % 10 <> 0")
    return reports.insight_split_check(t.insight_news, after.union(after.where("news_id % 11 = 0")))


@query("reports", "SELECT CAST(year(date_from) AS INTEGER) AS year, CAST(row_number() OVER (PARTITION BY year(date_from) ORDER BY date_from DESC, id DESC) AS INTEGER) AS place, id FROM reports")
def k6_report_list(t: Tables):
    return metrics.report_list(t.reports).select("year", "place", "id")


@query("reports", "SELECT id FROM reports WHERE sent ORDER BY date_from DESC, id DESC LIMIT 10")
def k6_recent_sent(t: Tables):
    return metrics.recent_sent(t.reports).select("id")


@query("news report_news", """
SELECT r.id AS report_id, concat_ws(chr(10) || chr(10), '# ' || r.title, 'Overview.', 'Head ' || r.id || chr(10) || '### First ' || r.id || chr(10) || 'Body one.' || chr(10) || chr(10) || 'Implication.' || chr(10) || '참고: uid-' || (r.id + 1) || ', bad, uid-' || (r.id + 1) || ',, uid-' || (r.id + 7) || ', ' || chr(10) || '### Second' || chr(10) || 'Body two.' || chr(10) || '#### no issue' || chr(10) || '참고: not last' || chr(10) || 'End.', lines) AS document
FROM reports r LEFT JOIN (SELECT report_id, string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY published_at DESC, id DESC) AS lines FROM report_news JOIN news ON id = news_id GROUP BY report_id) ON report_id = r.id""")  # fmt: skip
def s4_snapshot_report(t: Tables):
    return report_markdown(t.reports, t.report_news, t.news)
