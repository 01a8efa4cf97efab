"""Metrics, graph, judgments, reports and similarity on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet import schemas as S
from broadsheet.operators import audit, graph, judgment, metrics, reports, similarity

DAY = dt.date(2026, 8, 6)


def news(spark, rows):
    """rows: (id, days before DAY, verified)"""
    base = dt.datetime(2026, 8, 6, 3)
    out = [(i, f"n{i}", base - dt.timedelta(days=d), base, S.VERIFIED if v else S.UNVERIFIED, None) for i, d, v in rows]
    return spark.createDataFrame(out, "id long, title string, published_at timestamp, collected_at timestamp, status string, verified_at timestamp")


def bridge(spark, tags):
    return spark.createDataFrame([(n, e) for n, es in tags.items() for e in es], S.BRIDGE)


ORGS = [(1, "A", S.FINANCE, [], True), (2, "B", S.AI, [], True), (3, "C", S.AI, [], False), (4, "D", S.INSURANCE, [], True)]


def test_rolling_buckets(spark):
    rows = metrics.rolling_buckets(news(spark, [(1, 10, True), (2, 0, True), (3, -1, True)]), DAY).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [0, 1, 1] and rows[-1].end == DAY
    for days, size in ((363, 7), (364, 30)):
        r = metrics.rolling_buckets(news(spark, [(1, days, True)]), DAY).orderBy("bucket").first()
        assert (r.end - r.start).days + 1 == size
    assert metrics.rolling_buckets(news(spark, []), DAY).count() == 2
    assert metrics.rolling_buckets(news(spark, [(1, -3, True)]), DAY).count() == 1


def test_graph(spark):
    n = news(spark, [(1, 0, True), (2, 0, True), (3, 0, False)])
    b = bridge(spark, {1: [1, 2], 2: [1, 2, 4], 3: [2, 4]})
    orgs = spark.createDataFrame(ORGS, S.ORGANIZATION)
    rel = spark.createDataFrame([(x, y, "l", "") for x, y in ((1, 2), (1, 3), (1, 4), (2, 4))], S.RELATION)
    edges = graph.edges(n, b, orgs, rel, "7d", DAY)
    nodes = graph.nodes(n, b, orgs, "7d", DAY)
    assert {(r.org_a, r.org_b, r.weight) for r in edges.collect()} == {(1, 2, 2), (2, 4, 1)}
    assert {(r.id, r["count"]) for r in nodes.collect()} == {(1, 2), (2, 2), (4, 1)}
    assert [(r.org_a, r.org_b) for r in graph.orphan_relations(n, b, rel).collect()] == [(1, 3)]
    assert graph.edge_invariants(edges, nodes, graph.all_evidence(n, b, rel)).count() == 0
    bad = edges.withColumn("weight", F.col("weight") + 1)
    assert graph.edge_invariants(bad, nodes.where("id <> 4"), graph.all_evidence(n, b, rel)).count() == 3


def test_ranking_and_lists(spark):
    n = news(spark, [(i, i, True) for i in range(7)])
    b = bridge(spark, {i: [1, 2] if i < 6 else [1] for i in range(7)} | {5: [2, 4, 1]})
    top = metrics.ranking(n, b, spark.createDataFrame(ORGS, S.ORGANIZATION), "all", DAY).orderBy("rank").collect()
    assert [(r.name, r["count"], len(r.recent_titles), r.more_count) for r in top] == [("A", 7, 5, 2), ("B", 6, 5, 1), ("D", 1, 1, 0)]
    assert top[0].recent_titles[0] == "n0" and [r.pct for r in top] == [100, 86, 14]
    ins = spark.createDataFrame([(i, o) for i, o in ((1, 1), (2, 2), (3, 3), (4, None), (5, None))], "id long, headliner_order int")
    summary = metrics.insight_summary(ins, spark.createDataFrame([(5, 0)], S.INSIGHT_NEWS), n)
    assert [r.id for r in metrics.headliners(summary).collect()] == [1, 2] and [r.id for r in metrics.top_issues(summary).collect()] == [5, 4]
    assert [r.id for r in metrics.list_page(n, "x", 3).collect()] == [0, 1, 2] and [r.id for r in metrics.list_page(n, 99, 3).collect()] == [6] == [r.id for r in metrics.list_page(n, 0, 3).collect()]


def test_deep_pages(spark, monkeypatch):
    n = news(spark, [(i, i % 5, i % 4 != 0) for i in range(60)])
    near = [[r.id for r in metrics.list_page(n, p, 7, o).collect()] for o in ("newest", "oldest") for p in (1, 4, 7)]
    monkeypatch.setattr(metrics, "DEEP", 0)
    assert [[r.id for r in metrics.list_page(n, p, 7, o).collect()] for o in ("newest", "oldest") for p in (1, 4, 7)] == near


def test_adjacent_news_outside_the_gate(spark):
    got = {r.id: (r.prev_id, r.next_id) for r in metrics.adjacent_news(news(spark, [(1, 0, True), (2, 0, False), (3, 0, True), (4, 2, True), (5, 1, False)])).collect()}
    assert got == {1: (3, 4), 2: (3, 1), 3: (None, 1), 4: (1, None), 5: (1, 4)}


@pytest.fixture
def deletion(spark):
    n = news(spark, [(1, 0, True), (2, 0, True)]).withColumns({"url": F.concat(F.lit("u"), "id"), "url_hash": F.concat(F.lit("h"), "id"), "body": F.lit("b"), "source_type": F.lit("s"), "matched_keywords": F.when(F.col("id") == 1, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array().cast("array<string>"))})
    b = bridge(spark, {1: [2, 1], 2: [1]})
    orgs = spark.createDataFrame(ORGS, S.ORGANIZATION)
    judged = spark.createDataFrame([(1, "1-b", None, None)], S.JUDGMENT)
    return judgment.delete_with_records(judged, n, spark.createDataFrame([("h9",)], "url_hash string"), {"organizations": (b, orgs)}, {"links": spark.createDataFrame([(7, 1), (7, 2)], S.INSIGHT_NEWS)}, dt.datetime(2026, 8, 6))


def test_delete_with_records(deletion):
    r = deletion["records"].first()
    assert (r.criterion_code, r.reason, r.judged_by, r.organizations_snapshot, r.matched_keywords_snapshot) == ("1-b", "", S.RA, ["A", "B"], ["B", "A"])
    assert [x.id for x in deletion["news"].collect()] == [2] and {x.url_hash for x in deletion["excluded"].collect()} == {"h1", "h9"}
    assert deletion["organizations"].count() == 1 == deletion["links"].count()


def test_corrections(spark):
    orgs, b = spark.createDataFrame(ORGS, S.ORGANIZATION), bridge(spark, {1: [1]})
    ops = spark.createDataFrame([(1, 1, "organization", "remove", "A"), (2, 1, "organization", "add", "A"), (3, 1, "organization", "add", "B"), (4, 1, "organization", "remove", "B"), (5, 1, "planet", "add", "D"), (6, 1, "organization", "eat", "D"), (7, 2, "organization", "add", "D")], "op_ord long, news_id long, axis string, action string, target_name string")
    assert {(r.news_id, r.entity_id) for r in judgment.apply_corrections(ops, b, orgs, "organization").collect()} == {(1, 1), (2, 4)}
    assert judgment.valid_ops(ops).count() == 5


def test_tagging_removes_what_no_longer_matches(spark):
    orgs = spark.createDataFrame([(1, "RAG", "AI", None, True), (2, "은행", "AI", ["뱅크"], True), (3, "없음", "AI", [], False)], S.ORGANIZATION)
    n = spark.createDataFrame([(1, "storage", "뱅크다.\n관련기사\nRAG"), (2, "RAG", None), (3, None, "없음")], "id long, title string, body string")
    got = judgment.remap(n, orgs)
    assert {(r.news_id, r.entity_id) for r in got.collect()} == {(1, 2), (2, 1)}
    assert judgment.changed_news(bridge(spark, {1: [2], 2: [2]}), got).first()[0] == 1


def test_reports(spark):
    uid = "123e4567-e89b-12d3-a456-426614174000"
    content = f"머리\n### A\n본문\n\n시사점\n참고: {uid.upper()}, bad, {uid},\n### B\n참고: x\n본문\n#### x\n"
    rep = spark.createDataFrame([(1, content), (2, "### \n"), (3, "none"), (4, None)], "id long, content string")
    rows = reports.report_issues(rep).orderBy("report_id", "issue_no").collect()
    assert [(r.report_id, r.title, r.body, len(r.refs)) for r in rows[:2]] == [(1, "A", "본문\n\n시사점", 3), (1, "B", "참고: x\n본문\n#### x", 0)]
    assert {r.report_id for r in rows} <= {1, 2}
    n = spark.createDataFrame([(9, uid)], "id long, uid string")
    assert [(r.issue_no, r.ref_pos, r.news_id) for r in reports.report_refs(rep, n).collect()] == [(0, 0, 9)]
    assert [r.p for r in rep.select(reports.preamble(F.col("content")).alias("p")).collect()][0] == "머리\n"
    titles = spark.createDataFrame([("2026년 7월 5주차(7.25~7.31) — 제목",), ("가-나",), ("7월 - ",), (None,)], "t string")
    got = titles.select(reports.short_period(F.col("t")).alias("p"), reports.title_body(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("7월 5주차", "제목"), ("", "가-나"), ("", "7월 -"), ("", "")]


def test_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base, base + 0.2 * rng.standard_normal((40, 16)), base[:3]])
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16)], "news_id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] >= 0.82}
    assert {(r.a, r.b) for r in similarity.similar_pairs(e, 16).collect()} == want and len(want) > 40
    top = similarity.similar_topk(e, e.where("news_id % 50 = 0"), 3).orderBy("query_id", "place").collect()
    assert [r.news_id for r in top if r.query_id == 50][0] == 10 and len(top) == 6


def test_duplicate_groups(spark):
    n = spark.createDataFrame([(1, "[속보] 은행, 합병", "u1", 3), (2, "은행 합병", "u2", 1), (3, "다른", "u2", 2), (4, "", "u4", 1)], "id long, title string, url string, published_at int")
    assert {r.id: (r.group_id, r.is_representative) for r in similarity.duplicate_groups(n).collect()} == {1: (1, False), 2: (1, True), 3: (1, False), 4: (4, True)}


def test_missed_runs(spark):
    t = lambda *x: dt.datetime(2026, 8, *x)
    checks = spark.createDataFrame([(t(6, 1),), (t(6, 14),), (t(6, 16),), (t(9, 1),)], "check_at timestamp")  # Thursday; Sunday
    runs = spark.createDataFrame([(t(5, 0, 30),), (t(7, 0, 10),)], "started_at timestamp")
    assert [r.state for r in audit.missed_runs(checks, runs, dt.date(2026, 8, 3), dt.date(2026, 8, 12)).orderBy("check_at").collect()] == ["pending", "pending", "stale", "clear"]


def test_nearest_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(60, 102)] + [(500, [1.0, 2.0, 0.5]), (3, [2.0, -1.0, 0.0])]
    e = spark.createDataFrame(rows[::-1], "news_id long, vector array<float>").repartition(3)
    top = similarity.similar_topk(e, e.where("news_id = 500"), 5).orderBy("place").collect()
    assert [r.news_id for r in top] == [60, 61, 62, 63, 64]
    counts = {r.news_id: (r.class_id, r.links) for r in similarity.similar_counts(e, 3).collect()}
    assert counts[500] == (60, 0) and counts[3] == (3, 0) and len(counts) == 44


def test_table_plan_keeps_recall_as_rows_grow():
    import math

    for rows in (10, 10**4, 10**6, 10**9):
        tables, bits = similarity.table_plan(rows, 0.82)
        assert rows / 2**bits <= max(similarity.MET, rows / 256) and (1 - (1 - math.acos(0.82) / math.pi) ** bits) ** tables <= 1e-4


def test_changed_relations_replace_their_evidence(spark):
    news = spark.createDataFrame([(i, S.VERIFIED if i != 3 else S.UNVERIFIED, f"2026-08-{d:02d} 03:00:00") for i, d in ((1, 10), (2, 11), (3, 11), (4, 1))], "id long, status string, p string").withColumn("published_at", F.col("p").cast("timestamp"))
    bridge = spark.createDataFrame([(n, o) for n in (1, 2, 3, 4) for o in (7, 8)] + [(2, 9)], "news_id long, entity_id long")
    old = spark.createDataFrame([(7, 8, 99), (8, 9, 98)], "org_a long, org_b long, news_id long")
    changes = spark.createDataFrame([(8, 7, "partner", "", 1), (8, 9, "  ", "", 2)], "org_a long, org_b long, label string, description string, op_ord int")
    got = {tuple(r) for r in graph.replace_evidence(old, changes, news, bridge, "7d", dt.date(2026, 8, 12)).collect()}
    assert got == {(7, 8, 1), (7, 8, 2), (8, 9, 98)}


def test_article_links_of_many_organisations(spark, monkeypatch):
    monkeypatch.setattr(metrics, "LISTED", 2)
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "news_id long")
    bridge = spark.createDataFrame([(1, 10), (1, 13), (2, None), (4, 10)], "news_id long, entity_id long")
    orgs = spark.createDataFrame([(10, True), (11, True), (12, True), (13, False)], "id long, is_active boolean")
    found = metrics.article_links(ids, spark.createDataFrame([(1, 7), (5, 8)], "news_id long, insight_id long"), bridge, orgs)
    want = {(1, "insight", 7), (1, "linked_org", 10), (1, "linked_org", 13), (2, "linked_org", None), (1, "unlinked_org", 11), (1, "unlinked_org", 12)} | {(n, "unlinked_org", o) for n in (2, 3) for o in (10, 11, 12)}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_adjacent_news_reads_a_day_once(spark):
    plan = metrics.adjacent_news(news(spark, [(1, 0, True)]))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_title_keys_keep_all_numbers(spark):
    n = spark.createDataFrame([(1, "GrÃ¼n ½", "u1", 3), (2, "grã ", "u2", 1), (3, "[x] GRÃ¼n, ½!", "u3", 2)], "id long, title string, url string, published_at int")
    assert {r.id: r.group_id for r in similarity.duplicate_groups(n).collect()} == {1: 1, 2: 2, 3: 1}
    assert spark.createDataFrame([("a‿b",), ("a²b_",)], "t string").select(similarity.title_key(F.col("t"))).collect() == [("ab",), ("a²b_",)]
