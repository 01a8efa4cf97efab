"""Related articles by cosine similarity of embeddings, and same-event groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ensure_checkpoints
from . import cells

#: Of the pairs at the threshold this share may be missed; vectors that meet in a bucket on average.
MISSED, MET, SEED = 1e-4, 32, 7


def table_plan(rows: int, threshold: float) -> tuple[int, int]:
    """(tables, bits): bits grow with the rows, so that buckets don't; tables keep the share that is missed."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 1) / MET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits  # of two vectors at the threshold, in one table
    return math.ceil(math.log(MISSED) / math.log1p(-same)), bits


def hyperplane_keys(vector: Column, dims: int, tables: int, bits: int) -> Column:
    """array<int>: the sign pattern of a vector in each table."""
    planes = np.random.default_rng(SEED).standard_normal((dims, tables * bits))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        signs = (np.stack(vectors.to_list()).astype(np.float64) @ planes > 0).reshape(len(vectors), tables, bits)
        return pd.Series(list((signs @ weights).astype(np.int32)))

    return keys(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def _units(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, u) of the distinct unit vectors, and (news_id, rep)."""
    rows = embeddings.where("vector is not null").select("news_id", unit(F.col("vector")).alias("u")).where("u is not null")
    reps = rows.groupBy("u").agg(F.min("news_id").alias("rep"))
    return reps, rows.join(reps, "u").select("news_id", "rep")


def likely_classes(embeddings: DataFrame, dims: int, threshold: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """(a, b, cosine) with a < b between distinct vectors, and (news_id, rep): their members; all but a share of
    ``MISSED`` of the pairs at the threshold. A quicker way than ``cells.join`` for vectors without structure, of
    which that rules out few; no query rests on it. Candidates meet in a hyperplane bucket; only ids
    travel there, and each candidate pair is checked exactly once."""
    reps, members = _units(embeddings)
    buckets = reps.select("rep", F.posexplode(hyperplane_keys(F.col("u"), dims, *table_plan(reps.count(), threshold))).alias("table", "key"))
    pairs = buckets.withColumnRenamed("rep", "a").join(buckets.withColumnRenamed("rep", "b"), ["table", "key"]).where("a < b").select("a", "b").distinct()
    u = reps.select("rep", "u")
    scored = pairs.join(u.withColumnsRenamed({"rep": "a", "u": "_a"}), "a").join(u.withColumnsRenamed({"rep": "b", "u": "_b"}), "b").withColumn("cosine", dot(F.col("_a"), F.col("_b")))
    return scored.where(F.col("cosine") >= threshold).select("a", "b", "cosine"), members


def similar_pairs(embeddings: DataFrame, dims: int | None = None, threshold: float = 0.82) -> DataFrame:
    """(a, b, cosine) of all related articles a < b, copies of a vector among them. Exact. ``dims`` isn't needed."""
    reps, m = _units(embeddings)
    pairs = cells.join(reps.withColumnRenamed("rep", "id"), threshold)
    across = pairs.join(m.withColumnsRenamed({"news_id": "x", "rep": "a"}), "a").join(m.withColumnsRenamed({"news_id": "y", "rep": "b"}), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
    within = m.withColumnRenamed("news_id", "a").join(m.withColumnRenamed("news_id", "b"), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    return across.union(within)


def similar_links(embeddings: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(a, b): related articles, as many pairs as connect all that are related, directly or by others: copies to
    the least of them, and the rest without a pair for each two near copies."""
    reps, m = _units(embeddings)
    return cells.join(reps.withColumnRenamed("rep", "id"), threshold, "forest").union(m.where("news_id <> rep").select("news_id", "rep"))


def similar_counts(embeddings: DataFrame, dims: int | None = None, threshold: float = 0.82) -> DataFrame:
    """(news_id, class_id, links) for each row with a vector: the least id with an equal vector, and how
    many other classes are related to it. Copies aren't expanded into pairs. Exact. ``dims`` isn't needed."""
    reps, members = _units(embeddings)
    links = cells.join(reps.withColumnRenamed("rep", "id"), threshold, "counts").withColumnRenamed("id", "rep")
    return members.join(links, "rep", "left").select("news_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_topk(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, place, news_id, cosine): exact nearest neighbours of a stated query set against all rows, by
    cosine to nine digits and then by id."""
    rows = embeddings.where("vector is not null").select(F.col("news_id").alias("id"), unit(F.col("vector")).alias("u")).where("u is not null")
    found = cells.nearest(rows, queries.select(F.col("news_id").alias("id")), k)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", F.col("id").alias("news_id"), "cosine")


def title_key(title: Column) -> Column:
    """A title without a leading label, punctuation and case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s*\[[^\]]+\]", "")), r"[^\p{L}\p{N}\p{M}_]+", "")


def connected(edges: DataFrame) -> DataFrame:
    """(node, group) by least-label propagation with pointer jumping; checkpointed, until nothing changes."""
    ensure_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = both.checkpoint()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("group")).checkpoint()
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "group": "g"}), "b").groupBy("a").agg(F.min("g").alias("g"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("group", "g").alias("group"))
        jump = step.withColumnsRenamed({"node": "_n", "group": "_g"})
        new = step.join(jump, step["group"] == jump["_n"], "left").select("node", F.coalesce("_g", "group").alias("group")).checkpoint()
        if new.join(labels.withColumnRenamed("group", "old"), "node").where("group <> old").isEmpty():
            return new
        labels = new


def duplicate_groups(news: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(id, group_id, is_representative): candidate groups of one event, from equal url or title keys and
    related articles (a, b). Each key links its articles to their least id, so keys make stars, not all
    pairs; the earliest article of a group, then the least id, represents it. The decision is a human's."""
    rows = news.select("id", "published_at", F.col("url").alias("u"), title_key(F.col("title")).alias("t"))
    keys = rows.select("id", F.explode(F.array(F.concat(F.lit("u"), "u"), F.when(F.col("t") != "", F.concat(F.lit("t"), "t")))).alias("key")).where("key is not null")
    least = keys.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = keys.join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    groups = connected(edges if related is None else edges.union(related.select("a", "b")))
    out = rows.join(groups, rows["id"] == groups["node"], "left").select("id", "published_at", F.coalesce("group", "id").alias("group_id"))
    best = out.groupBy("group_id").agg(F.min(F.struct("published_at", "id")).alias("m")).select(F.col("group_id").alias("_g"), F.col("m.id").alias("_best"))
    return out.join(best, F.col("group_id") == F.col("_g")).select("id", "group_id", (F.col("id") == F.col("_best")).alias("is_representative"))
