"""The co-mention graph of organisations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import in_period, node_category, node_size, strip, verified
from ..sources.tables import scratch
from .metrics import entity_counts

VOCABULARY = ("partner", "supplier", "customer")


def allowed_pair(a: Column, b: Column) -> Column:
    """Finance or insurance with AI, in either order."""
    pair = F.lit(False)
    for x, y in S.ALLOWED_TYPES:
        pair = pair | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return pair


def nodes(news: DataFrame, bridge: DataFrame, orgs: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    counts = entity_counts(news, bridge, orgs, period, as_of, tz)
    return counts.select("id", "name", "count", node_size(F.col("count")).alias("size"), node_category(F.col("org_type")).alias("category"))


def _tagged(news: DataFrame, bridge: DataFrame, period: str, as_of: dt.date | None, tz: str) -> DataFrame:
    chosen = in_period(verified(news), period, as_of, tz).select(F.col("id").alias("news_id"))
    return bridge.dropDuplicates(["news_id", "entity_id"]).join(chosen, "news_id", "left_semi")


def pair_rows(tagged: DataFrame) -> DataFrame:
    """(org_a, org_b, news_id): the unordered pairs of each article, one row each; an article's tags are few."""
    a, b = tagged.select("news_id", F.col("entity_id").alias("org_a")), tagged.select("news_id", F.col("entity_id").alias("org_b"))
    return a.join(b, "news_id").where("org_a < org_b").select("org_a", "org_b", "news_id")


def co_mention_pairs(news: DataFrame, bridge: DataFrame, period: str = "all", as_of: dt.date | None = None, orgs: DataFrame | None = None, tz: str = S.SEOUL) -> DataFrame:
    """(org_a, org_b, weight) of all pairs; with ``orgs``, of pairs of allowed types alone."""
    pairs = pair_rows(_tagged(news, bridge, period, as_of, tz)).groupBy("org_a", "org_b").agg(F.count(F.lit(1)).alias("weight"))
    if orgs is None:
        return pairs
    t = orgs.select("id", "org_type")
    pairs = pairs.join(t.withColumnsRenamed({"id": "org_a", "org_type": "_ta"}), "org_a").join(t.withColumnsRenamed({"id": "org_b", "org_type": "_tb"}), "org_b")
    return pairs.where(allowed_pair(F.col("_ta"), F.col("_tb"))).select("org_a", "org_b", "weight")


def shown_relations(relations: DataFrame, orgs: DataFrame) -> DataFrame:
    """Labelled relations whose ends are active and of allowed types."""
    t = orgs.where("is_active").select("id", "org_type")
    r = relations.join(t.withColumnsRenamed({"id": "org_a", "org_type": "_ta"}), "org_a").join(t.withColumnsRenamed({"id": "org_b", "org_type": "_tb"}), "org_b")
    return r.where(allowed_pair(F.col("_ta"), F.col("_tb"))).select("org_a", "org_b", *[c for c in relations.columns if c in ("label", "weight")])


def edges(news: DataFrame, bridge: DataFrame, orgs: DataFrame, relations: Relations, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """(org_a, org_b, label, weight); only tags of labelled organisations are paired."""
    if not isinstance(relations, DataFrame):
        active = bridge.join(orgs.where("is_active").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        weights = relations.among(pair_rows(_tagged(news, active, period, as_of, tz)).groupBy("org_a", "org_b").agg(F.count(F.lit(1)).alias("weight")))
        return shown_relations(weights, orgs).select("org_a", "org_b", "label", "weight")
    shown = shown_relations(relations, orgs)
    tagged = _tagged(news, _of_relations(bridge, shown), period, as_of, tz)
    weights = pair_rows(tagged).groupBy("org_a", "org_b").agg(F.count(F.lit(1)).alias("weight"))
    return shown.join(weights, ["org_a", "org_b"]).select("org_a", "org_b", "label", "weight")


def pair_evidence(news: DataFrame, bridge: DataFrame, a: int, b: int, period: str = "all", as_of: dt.date | None = None, tz: str = S.SEOUL) -> DataFrame:
    """Verified news tagged with both organisations, newest first."""
    both = _tagged(news, bridge.where(F.col("entity_id").isin(a, b)), period, as_of, tz).groupBy("news_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    found = news.join(both.select(F.col("news_id").alias("id")), "id", "left_semi")
    return found.select("id", "title", "published_at").orderBy(F.desc("published_at"), F.desc("id"))


class Ruled(Protocol):
    """Relations that follow from a rule, which may be too many to be a table that is joined: whether a pair is one is known
    from the pair."""

    def among(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (org_a, org_b, ...) that are relations, with their label."""

    def labels(self, pairs: DataFrame) -> DataFrame:
        """All the pairs, with their label; null where a pair is no relation."""

    def without(self, pairs: DataFrame) -> DataFrame:
        """(org_a, org_b, label) of the relations that aren't among the pairs."""


@dataclass(frozen=True)
class Listed:
    """The same of relations that are a table."""

    rows: DataFrame

    def among(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.rows.select("org_a", "org_b", "label"), ["org_a", "org_b"])

    def labels(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.rows.select("org_a", "org_b", "label"), ["org_a", "org_b"], "left")

    def without(self, pairs: DataFrame) -> DataFrame:
        return self.rows.join(pairs, ["org_a", "org_b"], "left_anti").select("org_a", "org_b", "label")


Relations = DataFrame | Ruled


def _of_relations(bridge: DataFrame, relations: Relations) -> DataFrame:
    """The tags of organisations that some relation names; no others are worth pairing. A rule is asked for the pairs."""
    if not isinstance(relations, DataFrame):
        return bridge
    ends = relations.select(F.col("org_a").alias("entity_id")).union(relations.select("org_b")).distinct()
    return bridge.join(ends, "entity_id", "left_semi")


def all_evidence(news: DataFrame, bridge: DataFrame, relations: Relations, period: str = "all", as_of: dt.date | None = None, tz: str = S.SEOUL) -> DataFrame:
    """(org_a, org_b, news_id) of every labelled pair, as rows, not lists."""
    found = pair_rows(_tagged(news, _of_relations(bridge, relations), period, as_of, tz))
    if not isinstance(relations, DataFrame):
        return relations.among(found).select("org_a", "org_b", "news_id")
    return found.join(relations.select("org_a", "org_b"), ["org_a", "org_b"], "left_semi")


def _asked(relations: Relations) -> Ruled:
    return Listed(relations) if isinstance(relations, DataFrame) else relations


def orphan_relations(news: DataFrame, bridge: DataFrame, relations: Relations) -> DataFrame:
    """Labelled pairs that no verified article mentions together, at any time, whatever their types."""
    return _asked(relations).without(co_mention_pairs(news, _of_relations(bridge, relations)))


def edge_invariants(edge_rows: DataFrame, node_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(org_a, org_b, problem): edges with an end that is no node, or another weight than their evidence; none if all is well.
    The edges are derived once."""
    path = scratch(edge_rows.sparkSession)
    edge_rows.write.parquet(path)
    edge_rows, ids = edge_rows.sparkSession.read.parquet(path), node_rows.select("id")
    lost = lambda c: edge_rows.join(ids, edge_rows[c] == ids["id"], "left_anti").select("org_a", "org_b", F.lit(f"{c} is no node").alias("problem"))
    counted = evidence.groupBy("org_a", "org_b").agg(F.count(F.lit(1)).alias("n"))
    other = edge_rows.join(counted, ["org_a", "org_b"], "left").where(F.col("weight") != F.coalesce("n", F.lit(0))).select("org_a", "org_b", F.lit("weight").alias("problem"))
    return lost("org_a").union(lost("org_b")).union(other)


def pair_blowup(news: DataFrame, bridge: DataFrame) -> DataFrame:
    """(news_id, tags, pairs): how many pairs each verified article makes, from its count alone."""
    return _tagged(news, bridge, "all", None, S.SEOUL).groupBy("news_id").agg(F.count(F.lit(1)).alias("tags")).where("tags > 1").withColumn("pairs", (F.col("tags") * (F.col("tags") - 1) / 2).cast("long"))


def pair_support(pairs: DataFrame, relations: Relations) -> DataFrame:
    """One row: pairs, those of a single article, and those without a label."""
    if isinstance(relations, DataFrame):
        relations = Listed(relations.withColumn("label", F.lit("")))  # one without text is a relation, too
    j = relations.labels(pairs)
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("weight") == 1, 1)).alias("single"), F.count(F.when(F.col("label").isNull(), 1)).alias("unlabelled"))


def relation_label_counts(relations: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    return relations.groupBy("label").agg(F.count(F.lit(1)).alias("count")).withColumn("recommended", F.col("label").isin(*vocabulary))


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(org_a, org_b, change, before, after): new, lost and re-weighted pairs."""
    b, a = before.withColumnRenamed("weight", "before"), after.withColumnRenamed("weight", "after")
    j = b.join(a, ["org_a", "org_b"], "full").where("not before <=> after")
    return j.select("org_a", "org_b", F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "lost").otherwise("weight").alias("change"), "before", "after")


def _last_changes(changes: DataFrame) -> DataFrame:
    """(org_a, org_b, n): the last valid change of each pair by ``op_ord``. Pairs are ordered, labels trimmed;
    an empty or too long label and an organisation with itself change nothing."""
    label = strip(F.coalesce("label", F.lit("")))
    new = changes.where("org_a <> org_b").withColumn("_l", label).where((F.col("_l") != "") & (F.char_length("_l") <= S.MAX_LABEL))
    new = new.select(F.least("org_a", "org_b").alias("org_a"), F.greatest("org_a", "org_b").alias("org_b"), "op_ord", F.col("_l").alias("label"), strip(F.coalesce("description", F.lit(""))).alias("description"))
    return new.groupBy("org_a", "org_b").agg(F.max_by(F.struct("label", "description"), "op_ord").alias("n"))


def upsert_relation(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Relations after changes (org_a, org_b, label, description), of which a pair's last valid one wins."""
    j = relations.join(_last_changes(changes), ["org_a", "org_b"], "full")
    return j.select("org_a", "org_b", F.coalesce("n.label", "label").alias("label"), F.when(F.col("n").isNull(), F.col("description")).otherwise(F.col("n.description")).alias("description"))


def replace_evidence(evidence: DataFrame, changes: DataFrame, news: DataFrame, bridge: DataFrame, period: str, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """(org_a, org_b, news_id) after the same changes: a changed pair's evidence becomes the verified news of
    the period that mention both; other pairs keep theirs. Commit it with the relations in one step."""
    changed = _last_changes(changes).select("org_a", "org_b")
    kept = evidence.select("org_a", "org_b", "news_id").join(changed, ["org_a", "org_b"], "left_anti")
    return kept.unionByName(all_evidence(news, bridge, changed, period, as_of, tz))
