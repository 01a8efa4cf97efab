"""Keyed tables: buckets, merges, deletions, changes between versions, retention; collection against a large store."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_collect import KEYWORDS, NEWS, hit

from broadsheet import schemas as S
from broadsheet.operators import collect
from broadsheet.sources.store import BUCKET, Store
from broadsheet.streaming import jobs

ROWS = "id long, v long"


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def state(store, version=None):
    return {r.id: r.v for r in store.read("a", version=version).collect()}


def test_random_upserts_and_deletes_equal_a_dictionary(spark, tmp_path):
    store, want, rng = Store(spark, str(tmp_path / "s")), {i: 0 for i in range(300)}, random.Random(1)
    numbers = {store.commit(keyed={"a": ("id", rows(spark, want.items()))}, digits=1): dict(want)}
    for step in range(1, 9):
        new = {rng.randrange(400): step for _ in range(rng.choice([1, 5, 60]))}
        dead = [rng.randrange(400) for _ in range(rng.choice([1, 20]))]
        number = store.commit({"a": ("id", rows(spark, new.items()))}, delete={"a": ("id", spark.createDataFrame([(i,) for i in dead], "id long"))})
        want = {i: v for i, v in want.items() if i not in dead} | new
        numbers[number] = dict(want)
    assert all(state(store, n) == w for n, w in numbers.items())
    parts = [store._entries()["parts"][p]["rows"] for p in store.manifest()["a"]]
    assert all(a >= 2 * b for a, b in zip(parts, parts[1:], strict=False))  # merged by size
    few = rows(spark, [(i, 0) for i in (3, 7, 399)])
    assert {r.id for r in store.read("a", among=few).join(few.select("id"), "id", "left_semi").collect()} == {3, 7, 399} & set(want)
    for old, new in ((1, 9), (4, 6), (8, 9), (5, 5)):
        a, b = numbers[old], numbers[new]
        got = {r.id: (r.change, r.before and r.before.v, r.after and r.after.v) for r in store.changes("a", "id", old, new).collect()}
        assert got == {i: ("insert" if i not in a else "delete" if i not in b else "update", a.get(i), b.get(i)) for i in {*a, *b} if a.get(i) != b.get(i)}


def test_changes_read_only_what_differs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = store.commit(keyed={"a": ("id", spark.range(5000).selectExpr("id", "id as v"))}, digits=2)
    two = store.commit({"a": ("id", rows(spark, [(5, 1), (6000, 2)]))})
    diff = store.changes("a", "id", one, two)
    assert {r.id: r.change for r in diff.collect()} == {5: "update", 6000: "insert"}
    read = {re.search(f"{BUCKET}=(..)", f)[1] for f in diff.inputFiles()}
    assert len(read) <= 2


def test_retention_leaves_the_versions_that_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for v in range(4):
        store.commit(a=rows(spark, [(1, v)]))
    reader = store.read("a", version=3)  # planned before, run after
    assert store.vacuum(keep=2) == []  # all is young
    store._fs.create(store._path(f"{store.root}/.manifest-dead")).close()
    gone = store.vacuum(keep=2, grace=-60)
    assert len(gone) == 3 and ".manifest-dead" in gone and store.versions() == [3, 4]
    assert reader.first().v == 2 and state(store) == {1: 3}
    with pytest.raises(ValueError):
        store.read("a", version=1)


def test_empty_keyed_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(keyed={"a": ("id", rows(spark, []))})
    assert store.read("a").columns == ["id", "v"] and store.read("a").count() == 0
    store.commit({"a": ("id", rows(spark, [(1, 2)]))})
    store.commit(delete={"a": ("id", rows(spark, [(1, 0)]))})
    assert state(store) == {} and store.read("a", among=rows(spark, [(1, 0)])).count() == 0


def test_a_batch_reads_the_buckets_of_its_urls_alone(spark, tmp_path):
    """Two batches of 1,000 hits against 1,000,000 stored urls."""
    store, n = Store(spark, str(tmp_path / "s")), 1_000_000
    url = F.sha2(F.concat(F.lit("https://n.example/"), F.col("id")), 256).alias("url_hash")
    columns = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in NEWS.split(", ")) if c not in ("url_hash", "matched_keywords")]
    known = spark.range(n).select(url, *columns, F.array(F.lit("z")).alias("matched_keywords"))
    excluded = spark.range(n, n + 1000).select(url)
    store.commit(keyed={"news": ("url_hash", known.repartition(4)), "excluded": ("url_hash", excluded)}, digits=2)
    keywords = spark.createDataFrame(KEYWORDS, S.KEYWORD)
    hits = [spark.createDataFrame([hit(0, k, f"https://n.example/{(k % 40) * 9_999 + b * 500}") for k in range(1000)], S.HIT) for b in (0, 1)]
    seen = []
    read = store.read

    def watched(name, key=None, among=None, version=None):
        out = read(name, key, among, version)
        seen.append((name, out.inputFiles(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    store.read = watched
    folded = [collect.merge_keywords(collect.fold(h, keywords, known, excluded), known, reached_only=True) for h in hits]
    for b, h in enumerate(hits):
        jobs.collect_batch(h, b, store, keywords)
        jobs.collect_batch(h, b, store, keywords)  # replayed: nothing is read
    assert [name for name, _, _ in seen] == ["news", "excluded"] * 2
    for name, files, plan in seen:
        assert name == "excluded" or 0 < len({re.search(f"{BUCKET}=(..)", f)[1] for f in files}) <= 40
    store.read = read
    rows_of = {r.url_hash: r.matched_keywords for f in folded for r in f.collect()}
    got = {r.url_hash: r.matched_keywords for r in store.read("news", among=folded[0].union(folded[1]).select("url_hash")).collect()}
    assert len(rows_of) == 80 and all(got[h] == k for h, k in rows_of.items()) and read("news").count() == n
