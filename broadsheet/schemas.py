"""Explicit schemas and fixed values of the news tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Stored texts of the data model.
UNVERIFIED, VERIFIED = "미검증", "검증됨"
COLLECT, EXCLUDE = "수집", "제외"
FINANCE, INSURANCE, AI = "금융사", "보험사", "AI"
ORG_TYPES = (FINANCE, INSURANCE, AI)
ALLOWED_TYPES = ((FINANCE, AI), (INSURANCE, AI))
RA, USER_DELETE = "RA", "사용자(화면 삭제)"
AXES, ACTIONS = ("organization", "tech_topic"), ("add", "remove")
NEWS_SOURCE = "naver_news"
PORTAL_DOMAINS = ("news.naver.com", "n.news.naver.com")
MAX_LABEL = 50
SEOUL = "Asia/Seoul"

_s, _l, _ts, _b, _i, _d = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType(), T.IntegerType(), T.DateType()
_strings, _vector = T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


HIT_ITEM = _schema(title=_s, description=_s, originallink=_s, link=_s, pubDate=_s)
HIT = _schema(keyword_ord=_i, keyword=_s, item_pos=_i, title=_s, description=_s, originallink=_s, link=_s, pubDate=_s)
PAYLOAD = _schema(keyword_ord=_i, keyword=_s, items=T.ArrayType(HIT_ITEM))
KEYWORD = _schema(id=_l, keyword=_s, keyword_type=_s, sort=_s, is_active=_b)
DATA_SOURCE = _schema(name=_s, is_active=_b)
NEWS = _schema(id=_l, uid=_s, title=_s, url=_s, url_hash=_s, body=_s, image_url=_s, source_type=_s, published_at=_ts, collected_at=_ts, status=_s, verified_at=_ts, matched_keywords=_strings)
BRIDGE = _schema(news_id=_l, entity_id=_l)
ORGANIZATION = _schema(id=_l, name=_s, org_type=_s, aliases=_strings, is_active=_b)
TECH_TOPIC = _schema(id=_l, name=_s, aliases=_strings, is_active=_b)
RELATION = _schema(org_a=_l, org_b=_l, label=_s, description=_s)
EXCLUDED_URL = _schema(url_hash=_s, deleted_at=_ts)
JUDGMENT = _schema(news_id=_l, criterion_code=_s, reason=_s, judged_by=_s)
CORRECTION = _schema(op_ord=_l, news_id=_l, axis=_s, action=_s, target_name=_s, reason=_s, judged_by=_s, corrected_at=_ts)
INSIGHT = _schema(id=_l, title=_s, content=_s, implication=_s, content_short=_s, implication_short=_s, grade=_s, headliner_order=_i, created_at=_ts)
INSIGHT_NEWS = _schema(insight_id=_l, news_id=_l)
REPORT = _schema(id=_l, uid=_s, period_type=_s, date_from=_d, date_to=_d, title=_s, overview=_s, content=_s, content_short=_s, status=_s, slack_sent_at=_ts)
REPORT_NEWS = _schema(report_id=_l, news_id=_l)
EMBEDDING = _schema(news_id=_l, vector=_vector, model=_s)
COLLECTION_LOG = _schema(started_at=_ts, collected_count=_i, status=_s, error_message=_s, actor=_s)
