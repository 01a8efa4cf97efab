"""Batch updates: deletions with records, tag corrections, verification, re-tagging, upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import matching
from ..functions.textclean import clean_text


def _names(ids: DataFrame, bridge: DataFrame, entities: DataFrame, out: str) -> DataFrame:
    named = bridge.join(ids, "news_id", "left_semi").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return named.groupBy("news_id").agg(F.array_sort(F.collect_list("name")).alias(out))


def delete_with_records(judgments: DataFrame, news: DataFrame, excluded: DataFrame, bridges: dict[str, tuple[DataFrame, DataFrame]], links: dict[str, DataFrame], judged_at: dt.datetime) -> dict[str, DataFrame]:
    """Deletes the judged articles. Returns the new state of each table: ``records`` (rows to append),
    ``news``, ``excluded``, and each bridge and link table without the articles. Commit them together.

    bridges: organizations and tech_topics -> (bridge, entities); links: further tables with news_id.
    """
    none = F.array().cast("array<string>")
    ids = judgments.select("news_id").distinct()
    rows = judgments.dropDuplicates(["news_id"]).join(news, F.col("news_id") == F.col("id"))
    for axis, (bridge, entities) in bridges.items():
        names = _names(ids, bridge, entities, f"{axis}_snapshot")
        rows = rows.join(names, "news_id", "left").withColumn(f"{axis}_snapshot", F.coalesce(f"{axis}_snapshot", none))
    copied = [c for c in ("title", "url", "url_hash", "body", "source_type", "published_at", "collected_at") if c in news.columns]
    records = rows.select(
        *copied, F.coalesce("criterion_code", F.lit("")).alias("criterion_code"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("judged_by", F.lit(S.RA)).alias("judged_by"),
        *[f"{axis}_snapshot" for axis in bridges], F.coalesce("matched_keywords", none).alias("matched_keywords_snapshot"), F.lit(judged_at).alias("judged_at"),
    )
    out = {"records": records, "news": news.join(ids.select(F.col("news_id").alias("id")), "id", "left_anti"), "excluded": excluded.select("url_hash").union(records.select("url_hash")).distinct()}
    out |= {axis: bridge.join(ids, "news_id", "left_anti") for axis, (bridge, _) in bridges.items()}
    return out | {name: df.join(ids, "news_id", "left_anti") for name, df in links.items()}


def valid_ops(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("axis").isin(*S.AXES) & F.col("action").isin(*S.ACTIONS))


def latest_correction(records: DataFrame, order: Column | None = None) -> DataFrame:
    """The last valid correction of each (news, axis, target)."""
    by = order if order is not None else F.desc("op_ord")
    w = Window.partitionBy("news_id", "axis", "target_name").orderBy(by)
    return valid_ops(records).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_corrections(ops: DataFrame, bridge: DataFrame, entities: DataFrame, axis: str) -> DataFrame:
    """The bridge of one axis after the ops: the last op of a tag decides; both actions are idempotent.
    Bad axes and actions are refused; the records to append are ``valid_ops(ops)``."""
    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("target_name"))
    last = latest_correction(ops).where(F.col("axis") == axis).join(named, "target_name").select("news_id", "entity_id", "action")
    kept = bridge.select("news_id", "entity_id").join(last, ["news_id", "entity_id"], "left_anti")
    return kept.union(last.where("action = 'add'").select("news_id", "entity_id")).distinct()


def verify_batch(news: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """News with the batch's articles verified; write it as one commit."""
    batch = ids.select(F.col("news_id").alias("_id")).distinct()
    j = news.join(batch, news["id"] == batch["_id"], "left")
    hit = F.col("_id").isNotNull()
    return j.withColumn("status", F.when(hit, S.VERIFIED).otherwise(F.col("status"))).withColumn("verified_at", F.when(hit, F.lit(now)).otherwise(F.col("verified_at"))).drop("_id")


def tag_entities(news: DataFrame, entities: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """(news_id, entity_id): active entities that the title or the cleaned body mentions."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), clean_text(F.col(body)))
    return matching.mentions(news.select(F.col("id").alias("news_id"), text.alias("text")), entities)


def remap(news: DataFrame, entities: DataFrame) -> DataFrame:
    """The tag set that replaces the old one."""
    return tag_entities(news, entities)


def remap_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(news_id, entity_id, change): tags that a remap adds and loses."""
    b, a = before.select("news_id", "entity_id").distinct(), after.select("news_id", "entity_id").distinct()
    added = a.join(b, ["news_id", "entity_id"], "left_anti").withColumn("change", F.lit("added"))
    return added.union(b.join(a, ["news_id", "entity_id"], "left_anti").withColumn("change", F.lit("lost")))


def changed_news(before: DataFrame, after: DataFrame) -> DataFrame:
    return remap_changes(before, after).agg(F.count_distinct("news_id").alias("changed_news"))


def remap_preview(news: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, change, pairs): what another dictionary would add and lose, without writing."""
    return remap_changes(tag_entities(news, old), tag_entities(news, new)).groupBy("entity_id", "change").agg(F.count(F.lit(1)).alias("pairs"))


def remap_with_corrections(news: DataFrame, entities: DataFrame, records: DataFrame, axis: str) -> DataFrame:
    """A remap after which the latest corrections hold again."""
    return apply_corrections(records, remap(news, entities), entities, axis)


def missing_embeddings(news: DataFrame, embeddings: DataFrame, size: int = 128) -> DataFrame:
    """(id, batch) of articles with a body and no embedding, newest first, in batches."""
    from .metrics import ranked

    waiting = news.where(F.coalesce("body", F.lit("")) != "").join(embeddings.select(F.col("news_id").alias("id")), "id", "left_anti").select("id", "published_at")
    return assign_batches(ranked(waiting, [F.desc("published_at"), F.desc("id")]), size).select("id", "batch")


def assign_batches(placed: DataFrame, size: int, place: str = "n") -> DataFrame:
    return placed.withColumn("batch", F.floor((F.col(place) - 1) / size).cast("long"))


def insert_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that are there stay as they are."""
    fresh = new.dropDuplicates(["news_id"]).join(embeddings, "news_id", "left_anti")
    return embeddings.unionByName(fresh.select(*embeddings.columns))


def overwrite_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    return embeddings.join(new, "news_id", "left_anti").unionByName(new.dropDuplicates(["news_id"]).select(*embeddings.columns))


def seed_get_or_create(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """The dictionary with the seeds whose names it lacks, under new ids."""
    fresh = seeds.dropDuplicates(["name"]).join(existing, "name", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m"))
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("_m") + F.row_number().over(Window.orderBy("name"))).drop("_m")
    return existing.unionByName(numbered.select(*existing.columns))
