"""The registry of queries, and the SQL twins of the adapters' rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import RESIDUE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES_SQL = {
    "news": """SELECT o_orderkey AS id, 'uid-' || o_orderkey AS uid, CASE WHEN o_orderkey % 11 = 0 THEN '[brief' || (o_orderkey % 4) || '] ' ELSE '' END || 'Order ' || o_orderkey AS title,
  'https://news.example/' || o_orderkey AS url, sha256('https://news.example/' || o_orderkey) AS url_hash, 'body ' || o_orderpriority || ' kw' || (o_orderkey % 5) || ' part' || (o_orderkey % 13) AS body,
  o_orderpriority AS source_type, o_orderdate AS published_at, o_orderdate + INTERVAL 1 DAY AS collected_at, CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) AS day,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN '검증됨' ELSE '미검증' END AS status, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL 2 DAY END AS verified_at,
  CASE WHEN o_custkey % 7 = o_orderkey % 5 THEN ['kw' || (o_custkey % 7)] ELSE ['kw' || (o_custkey % 7), 'kw' || (o_orderkey % 5)] END AS matched_keywords FROM orders""",
    "ok": "SELECT * FROM news WHERE status = '검증됨'",
    "orgs": "SELECT s_suppkey AS id, s_name AS name, ['금융사', '보험사', 'AI'][s_nationkey % 3 + 1] AS org_type, s_acctbal >= 0 AS is_active FROM supplier",
    "topics": "SELECT *, id % 7 <> 0 AS is_active FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name FROM part)",
    "news_orgs": "SELECT DISTINCT l_orderkey AS news_id, l_suppkey AS entity_id FROM lineitem",
    "news_topics": "SELECT DISTINCT l_orderkey AS news_id, CAST(substr(p_brand, 7) AS BIGINT) AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "relations": "SELECT a.s_suppkey AS org_a, b.s_suppkey AS org_b, ['partner', 'supplier', 'investor'][(a.s_suppkey + b.s_suppkey) % 3 + 1] AS label FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (7 * a.s_suppkey + b.s_suppkey) % 5 = 0",
    "pairs": "SELECT a.entity_id AS org_a, b.entity_id AS org_b, a.news_id, day FROM news_orgs a JOIN news_orgs b ON a.news_id = b.news_id AND a.entity_id < b.entity_id JOIN ok ON ok.id = a.news_id",
    "insights": """SELECT id, 'Insight ' || id AS title, 'Long text ' || id || '. More. Last.' AS content, CASE WHEN id % 4 = 0 THEN 'Long text ' || id || '.' ELSE '' END AS content_short,
  ['1', '2', '3', 'unspecified'][id % 4 + 1] AS grade, CASE WHEN id IN (7, 8, 9) THEN CAST(id - 6 AS INTEGER) END AS headliner_order FROM (SELECT DISTINCT o_custkey % 200 AS id FROM orders UNION SELECT unnest(range(200, 205)))""",
    "insight_news": "SELECT o_custkey % 200 AS insight_id, o_orderkey AS news_id FROM orders WHERE o_orderkey % 3 = 0",
    "keywords": "SELECT id, CASE WHEN id < 20 THEN 'kw' || id WHEN id = 21 THEN 'error 3' ELSE 'error' END AS keyword, id < 20 AS collects, CASE WHEN id % 2 = 0 THEN 'date' ELSE 'sim' END AS sort, id <> 5 AS is_active FROM (SELECT unnest(range(22)) AS id)",
    "hits": """SELECT CAST(user_id % 20 AS INTEGER) AS keyword_ord, 'kw' || (user_id % 20) AS keyword, CAST(event_id AS INTEGER) AS item_pos, event_type || ' ' || (event_id % 10) AS title, 'about ' || (event_id % 17) AS description,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'https://hits.example/' || (event_id // 3) END AS url, event_id % 31 <> 0 AS dated, date_trunc('second', ts) AS published_at FROM events""",
    "known": "SELECT sha256('https://hits.example/' || n) AS url_hash, ['kw' || (n % 3)] AS matched_keywords FROM (SELECT DISTINCT event_id // 3 AS n FROM events) WHERE n % 10 = 0",
    "excluded": "SELECT sha256('https://hits.example/' || n) AS url_hash FROM (SELECT DISTINCT event_id // 3 AS n FROM events) WHERE n % 7 = 0",
    "gated": """SELECT *, CASE WHEN url IS NULL THEN 'no_url' WHEN contains(title || ' ' || description, 'error') THEN 'skipped_filter'
  WHEN url_hash IN (SELECT url_hash FROM known) THEN 'skipped_dup' WHEN url_hash IN (SELECT url_hash FROM excluded) THEN 'skipped_excluded' END AS gate FROM (SELECT *, sha256(url) AS url_hash FROM hits)""",
    "folded": """SELECT * EXCLUDE (gate, won), coalesce(gate, CASE WHEN won IS NULL OR (keyword_ord, item_pos) < won THEN 'no_date' WHEN (keyword_ord, item_pos) = won THEN 'collected' ELSE 'skipped_dup' END) AS outcome
  FROM (SELECT *, min(CASE WHEN gate IS NULL AND dated THEN (keyword_ord, item_pos) END) OVER (PARTITION BY url_hash) AS won FROM gated)""",
    "articles": """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, source AS source_type, 'https://' || source || '/' || doc_id AS url, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 37 % 400 AS INTEGER)) AS published_at,
  CASE WHEN coalesce(quality = 1, doc_id % 3 <> 0) THEN '검증됨' ELSE '미검증' END AS status FROM documents LEFT JOIN labels USING (doc_id)""",
    "dictionary": "SELECT * FROM (VALUES (0, 'the', ''), (1, 'tion', 'tions'), (2, 'License', 'Apache License'), (3, 'der', ''), (4, 'que', 'qué'), (5, 'MIT', ''), (6, 'and', ''), (7, 'GNU', 'General Public'), (8, 'rights reserved', ''), (9, 'é', '')) v(id, name, alias)",
    "names": "SELECT id, lower(name) AS needle FROM dictionary WHERE id <> 6 UNION SELECT id, lower(alias) FROM dictionary WHERE alias <> '' AND id <> 6",
    "corrections": "SELECT doc_id AS op_ord, doc_id AS news_id, CASE WHEN doc_id % 3 = 0 THEN 'add' ELSE 'remove' END AS action, doc_id % 10 AS entity_id FROM documents WHERE doc_id % 2 = 0",
    "lines": r"""SELECT id, title, source_type, status, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM articles""",
    "cut": r"""SELECT id, title, source_type, status, CASE WHEN sentence IS NOT NULL AND len(l) - greatest(coalesce(prose, 0), sentence) >= 2 THEN l[1:greatest(coalesce(prose, 0), sentence)] ELSE l END AS l FROM (
  SELECT *, list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(regexp_replace(regexp_replace(l[i], '["''“”‘’()\[\]『』「」《》]+$', ''), '\s+$', ''), '[.!?다요]$'))) AS sentence, list_max(list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '^[-–—]'))) AS prose FROM lines)""",
    "cleaned": r"""SELECT id, title, source_type, status, list_filter(l, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+') AND NOT regexp_matches(x, '^(?i:advertisement)$|^[-–—]{1,3}$|(?i:copyright.*reserved)|(?i:Tel\s*[:：].*Fax\s*[:：])')) AS l FROM cut""",
    "tags": """SELECT DISTINCT c.id AS news_id, n.id AS entity_id FROM (SELECT id, lower(coalesce(title, '') || ' ' || array_to_string(l, chr(10))) AS t FROM cleaned) c JOIN names n
  ON regexp_matches(t, CASE WHEN regexp_matches(needle, '^[0-9a-z]') THEN '(^|[^0-9a-z])' ELSE '' END || needle || CASE WHEN regexp_matches(needle, '[0-9a-z]$') THEN '($|[^0-9a-z])' ELSE '' END)""",
    "old_tags": "SELECT DISTINCT doc_id AS news_id, doc_id % 10 AS entity_id FROM documents UNION SELECT doc_id, (doc_id + 3) % 10 FROM documents",
    "reports": """SELECT id, year(d) || '년 ' || month(d) || '월 1주차(7.25~7.31) — Title ' || id AS title, CASE WHEN id % 100 = 0 THEN 'done' ELSE 'draft' END AS status, CAST(d - 200 AS DATE) AS date_from, CAST(d + 200 AS DATE) AS date_to, id % 150 = 0 AS sent
  FROM (SELECT id, CAST(published_at AS DATE) AS d FROM news) WHERE id % 50 = 0""",
    "refs": "SELECT r.id AS report_id, 0 AS issue_no, CAST(pos AS INTEGER) AS ref_pos, n.id AS news_id FROM reports r, (VALUES (0, 1), (3, 7)) v(pos, step) JOIN news n ON n.id = r.id + step",
    "report_news": "SELECT id AS report_id, unnest([id + 1, id + CASE WHEN id % 100 = 0 THEN 7 ELSE 9 END]) AS news_id FROM reports",
    "span": "SELECT d, CASE WHEN d + 1 <= 364 THEN 7 ELSE 30 END AS s FROM (SELECT coalesce(DATE '2001-08-01' - min(day), 0) AS d FROM ok)",
    "buckets": "SELECT i, s, n, CAST(DATE '2001-08-01' - CAST(i * s AS INTEGER) AS DATE) AS e FROM (SELECT s, CAST(CASE WHEN d < 0 THEN 1 ELSE d // s + 2 END AS INTEGER) AS n, unnest(range(CASE WHEN d < 0 THEN 1 ELSE d // s + 2 END)) AS i FROM span)",
    "rolling": """SELECT CAST(n - 1 - i AS INTEGER) AS bucket, CAST(e - CAST(s - 1 AS INTEGER) AS DATE) AS start, e AS "end", CAST(count(id) AS BIGINT) AS count FROM buckets LEFT JOIN ok ON day BETWEEN e - CAST(s - 1 AS INTEGER) AND e GROUP BY ALL""",
}

# The residue rules once more, in their order, for the planted lines.
_WORD = r"[\p{L}\p{N}\p{M}_"
_DROPPED = {
    "email": rf"{_WORD}.+-]+@{_WORD}-]+\.{_WORD}.-]+", "byline": r"^(\S{1,15}\s+)?[가-힣]{2,4}\s*기자$", "timestamp": r"^(입력|수정)\s*[:：]?\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}(:\d{2})?$", "ad": "^(?i:advertisement)$", "dash": "^[-–—]{1,3}$",
    "photo_credit": r"^[가-힣A-Za-z0-9]{1,10}\s*제공$", "series": r"^\[[^\[\]]*[①②③④⑤⑥⑦⑧⑨⑩][^\[\]]*\]", "copyright": r"무단\s*전재|재배포|재판매|(?i:copyright.*reserved)",
    "caption": r"사진\s*제공\s*=|사진\s*=|그래픽\s*=|\[[^\[\]]{0,30}제공\]\s*$|ⓒ\s*\S+\s+[가-힣]{2,4}\s*(기자|디자이너)\s*$", "comment_ui": r"^댓글\s*\(\d+\)$|자\s*이내로\s*써주세요|댓글은\s*표시가\s*제한",
    "promo": r"^\[제보\]|^\[구독\]|구독해주세요|제보를\s*기다립니다|^▶(카카오톡|뉴스\s*홈페이지|이메일)\s*[:：]", "masthead": r"(인터넷신문|사업자|신문사업)\s*등록번호|청소년\s*보호\s*책임자|(?i:Tel\s*[:：].*Fax\s*[:：])|읽는\s*\[[^\[\]]{1,20}\]\s*$",
}
_TRIMMED = {"byline_prefix": r"^(\S{1,15}\s+)?[가-힣]{2,4}\s*기자\s*[|·]\s*", "outlet_prefix": r"^\[[^\[\]]{1,20}=[^\[\]]{1,20}(기자|특파원)\]\s*", "image_button": r"^이미지\s*확대보기"}
RULE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{name}'" for name, p in (_DROPPED | _TRIMMED).items()) + " END"
_trimmed = "x"
for _p in _TRIMMED.values():
    _trimmed = f"regexp_replace({_trimmed}, '{_p}', '')"
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = ", ".join(f"'{x}'" for x in RESIDUE)
TABLES_SQL |= {
    "planted": f"SELECT id, source_type, list_filter(list_transform(list_concat(string_split(coalesce(body, ''), chr(10)), ['은행이 밝혔다.'], list_transform([id % {len(RESIDUE)}, (3 * id + 11) % {len(RESIDUE)}, (5 * id + 23) % {len(RESIDUE)}, (7 * id + 31) % {len(RESIDUE)}], lambda k: [{_LINES}][k + 1]), ['끝으로 덧붙였다.']), lambda x: {_STRIPPED.format('x')}), lambda x: x <> '') AS l FROM articles",
    "planted_rules": f"SELECT id, source_type, {RULE_SQL} AS rule FROM (SELECT id, source_type, unnest(l) AS x FROM planted)",
    "planted_cut": r"""SELECT id, source_type, CASE WHEN sentence IS NOT NULL AND len(l) - greatest(coalesce(prose, 0), sentence) >= 2 THEN l[1:greatest(coalesce(prose, 0), sentence)] ELSE l END AS l FROM (
  SELECT *, list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(regexp_replace(regexp_replace(l[i], '["''“”‘’()\[\]『』「」《》]+$', ''), '\s+$', ''), '[.!?다요]$'))) AS sentence, list_max(list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '^[-–—]'))) AS prose
  FROM (SELECT id, source_type, CASE WHEN marker IS NULL THEN l ELSE l[1:marker - 1] END AS l FROM (SELECT *, list_min(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ('관련기사', '추천 뉴스'))) AS marker FROM planted)))""",
    "planted_clean": f"SELECT id, list_filter(list_transform(list_filter(l, lambda x: NOT ({' OR '.join(f"regexp_matches(x, '{p}')" for p in _DROPPED.values())})), lambda x: {_STRIPPED.format(_trimmed)}), lambda x: x <> '') AS l FROM planted_cut",
}
_NEEDS = {"planted": ["articles"], "planted_rules": ["planted"], "planted_cut": ["planted"], "planted_clean": ["planted_cut"], "lines": ["articles"], "cut": ["lines"], "cleaned": ["cut"], "names": ["dictionary"], "tags": ["cleaned", "names"], "reports": ["news"], "refs": ["reports"], "report_news": ["reports"], "span": ["ok"], "buckets": ["span"], "rolling": ["buckets"], "ok": ["news"], "pairs": ["news_orgs", "ok"], "gated": ["hits", "known", "excluded"], "folded": ["gated"]}


def with_tables(names: str, sql: str) -> str:
    """The SQL with the named tables, and those they need, in front of it."""
    listed: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in listed:
            listed.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES_SQL[n]})" for n in listed) + "\n" + sql if listed else sql


def query(tables: str = "", sql: str | None = None):
    """Registers a function of the adapted tables under its name, with its SQL over the named tables."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_tables(tables, sql)
        return f

    return register
