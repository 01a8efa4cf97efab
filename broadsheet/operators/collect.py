"""The collection fold: search hits into a de-duplicated article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import matching
from ..functions import scalars as P


def request_plan(keywords: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(keyword_ord, keyword, sort) of the active collect keywords; none if a data source is inactive or
    there is none."""
    plan = keywords.where((F.col("keyword_type") == S.COLLECT) & F.col("is_active"))
    if sources is not None:
        plan = plan.join(sources.agg(F.coalesce(F.min("is_active"), F.lit(False)).alias("_on")).where("_on").select(F.lit(1).alias("_")), how="left_semi")
    return plan.select(F.col("id").cast("int").alias("keyword_ord"), "keyword", "sort")


def normalize_hits(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hits with clean title and description, url, hash, date, snippet and the exclude words in them."""
    words = keywords.where((F.col("keyword_type") == S.EXCLUDE) & F.col("is_active"))
    clean = hits.withColumn("title", P.strip_html(F.col("title"))).withColumn("description", P.strip_html(F.col("description")))
    clean = clean.withColumn("url", P.pick_url(F.col("originallink"), F.col("link"))).withColumn("body", P.snippet_body(F.col("title"), F.col("description")))
    return clean.withColumn("blocked", matching.matched_words(F.col("body"), words)).withColumn("url_hash", P.url_hash(F.col("url"))).withColumn("published_at", P.parse_pub_date(F.col("pubDate")))


def known_flags(hits: DataFrame, news: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds is_known and is_excluded by url hash; large tables meet on the hash, nothing is collected."""
    k = news.select(F.col("url_hash").alias("_k")).distinct()
    x = excluded.select(F.col("url_hash").alias("_x")).distinct()
    joined = hits.join(k, hits["url_hash"] == k["_k"], "left").join(x, hits["url_hash"] == x["_x"], "left")
    return joined.withColumn("is_known", F.col("_k").isNotNull()).withColumn("is_excluded", F.col("_x").isNotNull()).drop("_k", "_x")


def drop_known_urls(hits: DataFrame, news: DataFrame, excluded: DataFrame) -> DataFrame:
    """Hits that are neither stored nor excluded."""
    return known_flags(hits, news, excluded).where("not is_known and not is_excluded").drop("is_known", "is_excluded")


def fold(hits: DataFrame, keywords: DataFrame, news: DataFrame, excluded: DataFrame) -> DataFrame:
    """The hits with their outcome: no_url, skipped_filter, skipped_dup, skipped_excluded, no_date or collected.

    In order of keyword and position, the first dated hit of a new url is collected; later hits of it
    are duplicates; undated ones before it are dropped. One window over the url hash decides; hits
    without a url take no part in it.
    """
    return fold_normalized(normalize_hits(hits, keywords), news, excluded)


def fold_normalized(hits: DataFrame, news: DataFrame, excluded: DataFrame) -> DataFrame:
    """``fold`` of hits that are normalized already; ``news`` and ``excluded`` need no rows but those of their urls."""
    flagged = known_flags(hits.where("url is not null"), news, excluded)
    gate = F.when(F.size("blocked") > 0, "skipped_filter").when(F.col("is_known"), "skipped_dup").when(F.col("is_excluded"), "skipped_excluded")
    order = F.struct("keyword_ord", "item_pos")
    first = F.min(F.when(F.col("gate").isNull() & F.col("published_at").isNotNull(), F.col("ord"))).over(Window.partitionBy("url_hash"))
    rows = flagged.withColumn("gate", gate).withColumn("ord", order).withColumn("first", first)
    new = F.when(F.col("first").isNull() | (F.col("ord") < F.col("first")), "no_date").when(F.col("ord") == F.col("first"), "collected").otherwise("skipped_dup")
    decided = rows.withColumn("outcome", F.coalesce("gate", new)).drop("gate", "first", "ord")
    none = hits.where("url is null").withColumns({"is_known": F.lit(False), "is_excluded": F.lit(False), "outcome": F.lit("no_url")})
    return decided.unionByName(none)


def merge_keywords(folded: DataFrame, news: DataFrame, reached_only: bool = False) -> DataFrame:
    """(url_hash, matched_keywords): the ordered keywords of each article whose hits were collected or
    duplicates, after those it had. All other stored articles keep theirs; ``reached_only`` leaves them out."""
    reached = folded.where(F.col("outcome").isin("collected", "skipped_dup"))
    new = reached.groupBy("url_hash").agg(F.array_sort(F.collect_list(F.struct("keyword_ord", "item_pos", "keyword"))).alias("k")).select(F.col("url_hash").alias("_h"), F.col("k.keyword").alias("k"))
    old = news.select("url_hash", F.col("matched_keywords").alias("o"))
    none = F.array().cast("array<string>")
    both = old.join(new, F.col("url_hash") == F.col("_h"), "right" if reached_only else "full")
    return both.select(F.coalesce("url_hash", "_h").alias("url_hash"), F.array_distinct(F.concat(F.coalesce("o", none), F.coalesce("k", none))).alias("matched_keywords"))


def new_articles(folded: DataFrame, merged: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The collected articles. texts: (url_hash, portal_text, generic_text, original_portal_text) of landed pages."""
    won = folded.where("outcome = 'collected'")
    if texts is not None:
        body = P.coalesce_body(F.col("originallink"), F.col("link"), F.col("portal_text"), F.col("generic_text"), F.col("original_portal_text"))
        won = won.join(texts, "url_hash", "left").withColumn("full", body)
    else:
        won = won.withColumn("full", F.lit(None).cast("string"))
    out = won.join(merged, "url_hash")
    return out.select("url_hash", "url", "title", F.coalesce("full", "body").alias("body"), "description", F.lit(S.NEWS_SOURCE).alias("source_type"), "published_at", F.lit(S.UNVERIFIED).alias("status"), "matched_keywords", F.col("full").isNotNull().alias("crawled"))


def collection_stats(folded: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """One row of counts by outcome; crawled and crawl_failed from the new articles."""
    count = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o)
    stats = folded.agg(*[count(o) for o in ("collected", "skipped_dup", "skipped_filter", "skipped_excluded")])
    if articles is None:
        return stats
    n = F.coalesce(F.sum(F.col("crawled").cast("long")), F.lit(0))
    return stats.crossJoin(articles.agg(n.alias("crawled"), (F.count(F.lit(1)) - n).alias("crawl_failed")))


def slot_usage(folded: DataFrame) -> DataFrame:
    """(keyword, slots, filtered, used): what became of each keyword's result slots."""
    filtered = F.sum((F.col("outcome") == "skipped_filter").cast("long"))
    return folded.groupBy("keyword").agg(F.count(F.lit(1)).alias("slots"), filtered.alias("filtered"), (F.count(F.lit(1)) - filtered).alias("used"))


def blocked_words(folded: DataFrame) -> DataFrame:
    """(word, blocked): hits that each exclude word holds back."""
    return folded.where(F.col("url").isNotNull()).select(F.explode("blocked").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("blocked"))


def exclude_union(excluded: DataFrame, more: DataFrame) -> DataFrame:
    return excluded.select("url_hash").union(more.select("url_hash")).distinct()
