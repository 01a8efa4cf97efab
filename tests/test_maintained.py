"""Substring index, delta re-tagging and maintained counts against whole recomputation."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from broadsheet.functions import matching
from broadsheet.operators import postings, rollups
from broadsheet.plans import maintained
from broadsheet.sources.store import BUCKET, Store

TEXTS = ["storage average fragment", "rag는 좋다", "nh농협캐피탈 농협", "xnh", "메타데이터", "", "a", "aa", "x😀y rag", None, "aba abab", "the end. the rag"]
ENTITIES = "id long, name string, aliases array<string>, is_active boolean"


def texts(spark, listed):
    return spark.createDataFrame(list(enumerate(listed)), "id long, text string")


def test_search_is_contains(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    postings.begin(store, texts(spark, TEXTS), digits=1)
    for needle in ["rag", "a", "aa", "농협", "농", "😀y", "the rag", "zzz", "abab", "t", ""]:
        assert {r.id for r in postings.search(store, needle).collect()} == {i for i, t in enumerate(TEXTS) if not needle or needle in (t or "")}, needle
    postings.add(store, spark.createDataFrame([(0, "nothing"), (50, "new rag")], "id long, text string"))
    assert {r.id for r in postings.search(store, "rag").collect()} == {1, 8, 11, 50}
    assert {r.id for r in postings.search(store, "storage").collect()} == set() and {r.id for r in postings.search(store, "noth").collect()} == {0}


def test_search_opens_the_needles_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    postings.begin(store, texts(spark, [" ".join(random.Random(i).choices("abcdefghijklmnop", k=30)) for i in range(60)]), digits=2)
    read = store.read("texts_grams", among=spark.createDataFrame([("a b",), ("b c",)], "gram string"))
    assert len({re.search(f"{BUCKET}=(..)", f)[1] for f in read.inputFiles()}) <= 2


def test_delta_remap_is_a_full_remap(spark, tmp_path):
    rng = random.Random(2)
    words = ["rag", "storage", "농협", "nh농협캐피탈", "메타", "메타데이터", "the", "end.", "x-ray", "ray"]
    listed = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)] + TEXTS
    store = Store(spark, str(tmp_path / "s"))
    old = spark.createDataFrame([(1, "RAG", ["ray"], True), (2, "농협", [], True), (3, "메타", None, True), (4, "the", ["end"], False), (5, "storage", ["rag"], True)], ENTITIES)
    new = spark.createDataFrame([(1, "RAG", [], True), (2, "농협", ["메타"], True), (3, "메타", None, False), (4, "the", ["end"], True), (5, "storage", ["rag"], True), (6, "e", [None, ""], True)], ENTITIES)
    postings.begin_tagging(store, texts(spark, listed), old, digits=1)
    read = postings.retag(store, old, new)
    want = matching.mentions(texts(spark, [t and t.lower() for t in listed]).withColumnRenamed("id", "news_id"), new)
    assert {tuple(r) for r in store.read("tags").collect()} == {tuple(r) for r in want.collect()} and read <= len(listed)
    assert postings.retag(store, new, new) == 0  # nothing changed: no text is read
    few = new.where("id <> 6").union(spark.createDataFrame([(6, "abab", [], True)], ENTITIES))
    assert postings.retag(store, few.where("id <> 6"), few) == 1  # one text holds it


def test_rollups_follow_random_changes(spark, tmp_path):
    rng = random.Random(3)
    store = Store(spark, str(tmp_path / "s"))
    day = "2026-08-05 03:00:00"
    news = lambda rows: spark.createDataFrame(rows, "id long, status string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    tags = lambda rows: spark.createDataFrame(rows, "news_id long, entity_id long")
    ids = list(range(60))
    keys = {"news": "id", "tags": ["news_id", "entity_id"]}
    store.commit(keyed={"news": ("id", news([(i, rng.choice(["검증됨", "미검증"]), day) for i in ids])), "tags": (keys["tags"], tags([(i, e) for i in ids for e in rng.sample(range(6), 3)]))}, digits=1)
    steps = [lambda: None] + [
        lambda: store.commit({"news": ("id", news([(i, rng.choice(["검증됨", "미검증"]), day) for i in rng.sample(ids, 8)]))}),
        lambda: store.commit({"tags": (keys["tags"], tags([(i, rng.randrange(6)) for i in rng.sample(ids, 8)]))}, delete={"tags": (keys["tags"], tags([(i, e) for i in rng.sample(ids, 8) for e in range(3)]))}),
        lambda: store.commit(delete={"news": ("id", news([(i, "", day) for i in rng.sample(ids, 6)]))}),
    ]
    for step in steps:
        step()
        for name, rows, dims in (("orgs", maintained.tagged_days, ["entity_id", "day"]), ("pairs", maintained.tagged_pairs, ["org_a", "org_b"])):
            rollups.refresh(store, name, keys, rows, dims)
            now = rows({k: store.read(k) for k in keys}).groupBy(*dims).agg(F.count(F.lit(1)).alias("count"))
            assert {tuple(r) for r in store.read(name).select(*dims, "count").collect()} == {tuple(r) for r in now.collect()}
    before = store.read("orgs").collect()
    rollups.refresh(store, "orgs", keys, maintained.tagged_days, ["entity_id", "day"])
    assert sorted(store.read("orgs").collect()) == sorted(before)


def test_many_keys_are_shuffled_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "SENT", 10, raising=False)
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(1000).select("id", F.lit("a").alias("x"))
    store.commit(keyed={"t": ("id", rows)}, digits=1)
    first = store.commit({"t": ("id", rows.where("id < 100").withColumn("x", F.lit("b")))}, delete={"t": ("id", rows.where("id >= 900").select("id"))})
    store.commit({"t": ("id", rows.where("id < 5").withColumn("x", F.lit("c")))})
    diff, few = store.changes("t", "id", 1, first), store.changes("t", "id", first)
    assert {tuple(r) for r in diff.groupBy("change").count().collect()} == {("update", 100), ("delete", 100)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(diff) and few.count() == 5 and "BroadcastHashJoin" in plan(few)
    rollups.refresh(store, "n", {"t": "id"}, lambda frames: frames["t"].select("x"), ["x"])
    assert {tuple(r) for r in store.read("n").collect()} == {("a", 800), ("b", 95), ("c", 5)}
