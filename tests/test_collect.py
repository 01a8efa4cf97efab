"""Collection fold, merging of keywords, batch and stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from broadsheet import schemas as S
from broadsheet.operators import collect
from broadsheet.sources.tables import Store, explode_payloads, log_rows
from broadsheet.streaming import jobs

GOOD = "Thu, 06 Aug 2026 09:00:00 +0900"
KEYWORDS = [(0, "k1", S.COLLECT, "date", True), (1, "k2", S.COLLECT, "sim", True), (2, "off", S.COLLECT, "sim", False), (3, "Bad", S.EXCLUDE, None, True)]
NEWS = "url_hash string, url string, title string, body string, source_type string, published_at timestamp, status string, matched_keywords array<string>"


def hit(k, pos, url, title="t", date=GOOD, link=""):
    return (k, f"k{k + 1}", pos, title, "d", url, link, date)


def frames(spark, hits, news=(), excluded=()):
    return (
        spark.createDataFrame(hits, S.HIT), spark.createDataFrame(KEYWORDS, S.KEYWORD),
        spark.createDataFrame([(u, list(k)) for u, k in news], "url string, matched_keywords array<string>").select(F.sha2("url", 256).alias("url_hash"), "matched_keywords"),
        spark.createDataFrame([(u,) for u in excluded], "url string").select(F.sha2("url", 256).alias("url_hash")),
    )


def outcomes(spark, *args):
    return [r.outcome for r in collect.fold(*frames(spark, *args)).orderBy("keyword_ord", "item_pos").collect()]


def test_shared_url_of_two_keywords(spark):
    h, k, n, x = frames(spark, [hit(0, 0, "shared"), hit(1, 0, "shared"), hit(1, 1, "only2")])
    folded = collect.fold(h, k, n, x)
    merged = {r.url: r.matched_keywords for r in collect.new_articles(folded, collect.merge_keywords(folded, n)).collect()}
    assert merged == {"shared": ["k1", "k2"], "only2": ["k2"]}
    assert collect.collection_stats(folded).first().asDict() == {"collected": 2, "skipped_dup": 1, "skipped_filter": 0, "skipped_excluded": 0}


def test_second_run_changes_nothing(spark):
    h, k, n, x = frames(spark, [hit(0, 0, "shared"), hit(1, 0, "shared")], news=[("shared", ["k1", "k2"])])
    assert collect.merge_keywords(collect.fold(h, k, n, x), n).first().matched_keywords == ["k1", "k2"]


def test_precedence(spark):
    rows = [hit(0, 0, "known", title="a BAD one"), hit(0, 1, "gone"), hit(0, 2, ""), hit(0, 3, "new", date="nonsense"), hit(0, 4, "known"), hit(0, 5, "", link="portal")]
    assert outcomes(spark, rows, [("known", ["z"])], ["gone", "known"]) == ["skipped_filter", "skipped_excluded", "no_url", "no_date", "skipped_dup", "collected"]


def test_undated_hit_before_and_after(spark):
    assert outcomes(spark, [hit(0, 0, "u", date="x"), hit(0, 1, "u"), hit(0, 2, "u", date="x")]) == ["no_date", "collected", "skipped_dup"]


def test_date_is_read_in_utc(spark):
    h, k, _, _ = frames(spark, [hit(0, 0, "u"), hit(0, 1, "v", date="6 Aug 2026 00:00:00 GMT")])
    assert {str(r.published_at) for r in collect.normalize_hits(h, k).select(F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at")).collect()} == {"2026-08-06 00:00"}


def test_against_a_plain_loop(spark):
    rng = random.Random(3)
    hits = [hit(k, p, rng.choice(["", "a", "b", "c", "e", "n"]), rng.choice(["t", "bad t"]), rng.choice([GOOD, "x"])) for k in (0, 1) for p in range(40)]
    news, excluded, expected = {"n": ["z"]}, {"e"}, []
    for k, word, _, title, _, url, _, date in hits:
        if not url:
            expected.append("no_url")
        elif "bad" in title:
            expected.append("skipped_filter")
        elif url in news:
            expected.append("skipped_dup")
            news[url] = news[url] + [word] * (word not in news[url])
        elif url in excluded:
            expected.append("skipped_excluded")
        elif date != GOOD:
            expected.append("no_date")
        else:
            expected.append("collected")
            news[url] = [word]
    h, k, n, x = frames(spark, hits, [("n", ["z"])], ["e"])
    folded = collect.fold(h, k, n, x)
    assert [r.outcome for r in folded.orderBy("keyword_ord", "item_pos").collect()] == expected
    urls = spark.createDataFrame([(u,) for u in news], "url string").withColumn("url_hash", F.sha2("url", 256))
    assert {r.url: r.matched_keywords for r in collect.merge_keywords(folded, n).join(urls, "url_hash").collect()} == news


def test_request_plan_and_payloads(spark):
    k = spark.createDataFrame(KEYWORDS, S.KEYWORD)
    assert [r.keyword for r in collect.request_plan(k).orderBy("keyword_ord").collect()] == ["k1", "k2"]
    off = spark.createDataFrame([("a", True), ("b", False)], S.DATA_SOURCE)
    assert collect.request_plan(k, off).count() == 0 == collect.request_plan(k, off.where("false")).count()
    payloads = spark.createDataFrame([(0, "k1", [("t", "d", "", "", "")]), (1, "k2", None)], S.PAYLOAD)
    assert explode_payloads(payloads).count() == 1


def test_log_rows(spark):
    runs = spark.createDataFrame([(1, 5, [], "a"), (2, 0, ["x", "y"], "a")], "started_at int, collected_count int, errors array<string>, actor string")
    assert [(r.status, r.error_message) for r in log_rows(runs).orderBy("started_at").collect()] == [("success", None), ("fail", "x\ny")]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    h, k, n, x = frames(spark, [hit(0, 0, "a"), hit(1, 0, "a"), hit(1, 1, "b"), hit(1, 2, "e")], [("a", ["z"])], ["e"])
    store = Store(spark, str(tmp_path / "store"))
    news = n.select("url_hash", *[F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("title", "string"), ("body", "string"), ("source_type", "string"), ("published_at", "timestamp"), ("status", "string"))], "matched_keywords")
    store.commit(news=news, excluded=x)
    h.write.parquet(str(tmp_path / "hits.parquet"))
    for n_file in range(2):  # the second run finds the batch done
        jobs.stream_collect(jobs.read_stream(spark, str(tmp_path), "hits"), store, k, str(tmp_path / f"state{n_file}")).awaitTermination()
    got = {tuple(r.matched_keywords) for r in store.read("news", "url_hash").collect()}
    assert got == {("z", "k1", "k2"), ("k2",)} and store.read("news", "url_hash").count() == 2
    parts = store.manifest()["news"]
    assert len(parts) == 2 and spark.read.parquet(f"{store.root}/{parts[1]}").count() == 2  # what changed, no more


def test_failed_commit_keeps_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(a=spark.range(2))
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))
    try:
        store.commit(a=spark.range(9), b=broken)
    except Exception:
        pass
    assert store.read("a").count() == 2 and "b" not in store.manifest()


def test_commit_that_dies_before_its_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(a=spark.range(2))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", dies)
        try:
            store.commit(a=spark.range(9))
        except OSError:
            pass
    assert store.read("a").count() == 2
    try:
        store._publish(1, "late", "{}")  # a commit whose number is taken
        raise AssertionError
    except RuntimeError:
        pass
    store.commit(a=spark.range(3))
    assert Store(spark, store.root).read("a").count() == 3


def test_upserts_replace_rows_and_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "PARTS", 3)
    store = Store(spark, str(tmp_path / "u"))
    store.commit(a=spark.range(4).selectExpr("id", "0 as v"))
    for v in range(1, 6):
        store.commit({"a": ("id", spark.range(v, v + 2).selectExpr("id", f"{v} as v"))})
    assert {r.id: r.v for r in store.read("a", "id").collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5} and len(store.manifest()["a"]) <= 3


def test_days_of_a_stream_are_those_of_seoul(spark, tmp_path):
    rows = [("2026-08-05 14:59:59", "검증됨"), ("2026-08-05 20:00:00", "검증됨"), ("2026-08-06 03:00:00", "검증됨"), ("2026-08-06 03:00:00", "미검증")]
    spark.createDataFrame(rows, "published_at string, status string").withColumn("published_at", F.col("published_at").cast("timestamp")).write.parquet(str(tmp_path / "n.parquet"))
    out = jobs.run_to_table(jobs.stream_daily_counts(jobs.read_stream(spark, str(tmp_path), "n")), str(tmp_path / "out"), "complete")
    assert {str(r.day): r["count"] for r in out.collect()} == {"2026-08-05": 1, "2026-08-06": 2}


def test_periods_reach_the_scan(spark, tmp_path):
    import datetime as dt

    from broadsheet.functions.scalars import in_period

    times = ["2026-08-05 14:59:59", "2026-08-05 15:00:00", "2026-08-12 14:59:59", "2026-08-12 15:00:00"]
    spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("published_at")).write.parquet(str(tmp_path / "p"))
    found = in_period(spark.read.parquet(str(tmp_path / "p")), "7d", dt.date(2026, 8, 12))
    assert sorted(str(r.published_at) for r in found.collect()) == times[1:3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan and "LessThan(publis" in plan


def test_jdbc_options_reach_the_reader(spark):
    from broadsheet.sources.tables import read_jdbc, write_jdbc

    for call in (lambda: read_jdbc(spark, "jdbc:none:x", "news", driver="no.such.Driver"), lambda: write_jdbc(spark.range(1), "jdbc:none:x", "news", driver="no.such.Driver")):
        try:
            call()
            raise AssertionError
        except Exception as e:  # the box has no database: the driver class asked for is what is missing
            assert "no.such.Driver" in str(e)
