"""Relational reads by key ranges and staged loads, against the embedded database that comes with Spark."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from broadsheet.sources import tables

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture
def url(spark, tmp_path):
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    if not any(j.startswith("derby-") for j in os.listdir(jars)):
        pytest.skip("no embedded database")
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_key_ranges_part_all_keys():
    for low, high, rows, each in ((1, 100, 1000, 100), (-7, 3, 50, 5), (5, 5, 10, 1), (0, 10**15, 7, 2), (None, None, 0, 10)):
        ranges = tables.key_ranges("k", low, high, rows, each)
        assert len(ranges) <= max(1, -(-rows // each))
        for k in {None, low, high, *(x for x in range(-10, 110))} | {10**14 * i for i in range(11)}:
            met = 0
            for r in ranges:
                python = r.replace("IS NULL", "is None").replace("OR", "or").replace("AND", "and").replace("1 = 1", "True")
                parts = [eval(p, {"k": k}) if k is not None or "is None" in p or p == "True" else False for p in python.split(" or ")] if "is None" in python else [k is not None and eval(python, {"k": k}) or python == "True"]
                met += any(parts)
            assert met == 1, (k, ranges)


def test_read_by_ranges_is_the_whole_table(spark, url):
    rows = spark.range(1000).select(F.when(F.col("id") % 100 != 7, F.col("id") * 3).alias("id"), F.concat(F.lit("t"), "id").alias("title"))
    tables.write_jdbc(rows, url, "news", driver=DERBY)
    read = tables.read_jdbc_by_key(spark, url, "news", "id", each=150, driver=DERBY)
    assert read.rdd.getNumPartitions() == 7 and sorted(r.title for r in read.collect()) == sorted(f"t{i}" for i in range(1000))
    sizes = [len(p) for p in read.rdd.glom().collect()]
    assert max(sizes) < 200 and min(sizes) > 100
    tables.write_jdbc(rows.limit(0), url, "nothing", driver=DERBY)
    assert tables.read_jdbc_by_key(spark, url, "nothing", "id", driver=DERBY).count() == 0


def test_a_repeated_attempt_is_loaded_once(spark, url):
    rows = spark.range(40).repartition(4).select("id", F.concat(F.lit("t"), "id").alias("title"))
    tables.write_jdbc(rows.limit(0), url, "news", driver=DERBY)
    assert tables.load_jdbc(rows, url, "news", key="id", driver=DERBY) == 40
    assert tables.load_jdbc(rows.union(spark.createDataFrame([(99, "new")], "id long, title string")), url, "news", key="id", driver=DERBY) == 1
    # A task whose first attempt was lost after its commit: its rows stand in the staging table twice.
    tables.stage_jdbc(rows.withColumn("id", F.col("id") + 1000), url, "staged", driver=DERBY)
    again = tables.read_jdbc(spark, url, "staged", driver=DERBY).where("load_task = 2").withColumn("load_attempt", F.col("load_attempt") + 500)
    tables.write_jdbc(spark.createDataFrame(again.collect(), again.schema), url, "staged", driver=DERBY)
    assert tables.publish_jdbc(spark, url, "staged", "news", ["id", "title"], driver=DERBY) == 40
    read = tables.read_jdbc(spark, url, "news", driver=DERBY)
    assert read.count() == 81 == read.select("id").distinct().count()


def test_a_failed_load_leaves_the_table(spark, url):
    rows = spark.range(5).select("id")
    tables.write_jdbc(rows, url, "news", driver=DERBY)
    broken = spark.range(10).repartition(3).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id") + 100).alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.load_jdbc(broken, url, "news", driver=DERBY)
    assert tables.read_jdbc(spark, url, "news", driver=DERBY).count() == 5
