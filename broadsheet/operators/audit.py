"""Audits of collection, keywords, tags and batches."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.matching import bundle_label, entity_names, in_blocks, tokens_in
from ..functions.scalars import local_date, verified
from .judgment import latest_correction, tag_entities


def batch_effect(survivors: DataFrame, deleted: DataFrame, tz: str = S.SEOUL) -> DataFrame:
    """(batch, keyword, collected, kept, deleted, deletion_rate) with totals under null, from (collected_at,
    matched_keywords); an article without keywords counts under the keyword ''."""
    rows = survivors.select("collected_at", "matched_keywords", F.lit(0).alias("gone")).union(deleted.select("collected_at", "matched_keywords", F.lit(1)))
    word = F.explode_outer("matched_keywords").alias("k")
    each = rows.select(local_date(F.col("collected_at"), tz).alias("batch"), word, "gone").select("batch", F.coalesce("k", F.lit("")).alias("keyword"), "gone")
    out = each.cube("batch", "keyword").agg(F.count(F.lit(1)).alias("collected"), F.sum("gone").alias("deleted"), F.grouping_id().cast("int").alias("level"))
    return out.withColumn("kept", F.col("collected") - F.col("deleted")).withColumn("deletion_rate", F.col("deleted") / F.col("collected"))


def batch_over_batch(effect: DataFrame) -> DataFrame:
    """(batch, deletion_rate, change) of the batch totals against the batch before."""
    by_batch = effect.where("level = 1").select("batch", "deletion_rate")
    return by_batch.withColumn("change", F.col("deletion_rate") - F.lag("deletion_rate").over(Window.orderBy("batch")))


def criterion_counts(records: DataFrame) -> DataFrame:
    """(criterion_code, judged_by, deletions) with totals under null."""
    return records.rollup("criterion_code", "judged_by").agg(F.count(F.lit(1)).alias("deletions"), F.grouping_id().cast("int").alias("level"))


def retroactive_split(records: DataFrame, tz: str = S.SEOUL) -> DataFrame:
    """(criterion_code, new, retroactive): deletions on the day of collection and later ones."""
    same = local_date(F.col("judged_at"), tz) == local_date(F.col("collected_at"), tz)
    return records.groupBy("criterion_code").agg(F.count(F.when(same, 1)).alias("new"), F.count(F.when(~same, 1)).alias("retroactive"))


def keyword_matches(news: DataFrame, keywords: DataFrame, block: int = 200_000) -> DataFrame:
    """(news_id, keyword): each active collect keyword all of whose tokens stand in title or body. One automaton of the
    tokens of ``block`` keywords goes over each text once, whatever their number."""
    words = keywords.where((F.col("keyword_type") == S.COLLECT) & F.col("is_active")).select("keyword").distinct()
    words = words.withColumn("tokens", F.filter(F.split(F.lower("keyword"), r"(?U)\s+"), lambda t: t != ""))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))
    rows = news.select(F.col("id").alias("news_id"), text.alias("text"))
    return reduce(DataFrame.union, [tokens_in(rows, part) for part in in_blocks(words, block, "keyword")])


def keyword_attribution(news: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, matched, sole, shared): articles that a keyword finds, and finds alone."""
    m = keyword_matches(news, keywords)
    n = m.groupBy("news_id").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "news_id").groupBy("keyword").agg(F.count(F.lit(1)).alias("matched"), F.count(F.when(F.col("n") == 1, 1)).alias("sole"), F.count(F.when(F.col("n") > 1, 1)).alias("shared"))


def multi_keyword_histogram(news: DataFrame) -> DataFrame:
    return news.select(F.size("matched_keywords").alias("keywords")).groupBy("keywords").agg(F.count(F.lit(1)).alias("articles"))


def keyword_redundancy(results: DataFrame) -> DataFrame:
    """(keyword_a, keyword_b, size_a, missing): for pairs with a common result, how much of a's is not in b's.
    results: (keyword, url_hash); subset when missing is 0."""
    r = results.select("keyword", "url_hash").distinct()
    sizes = r.groupBy("keyword").agg(F.count(F.lit(1)).alias("size_a"))
    a, b = r.withColumnRenamed("keyword", "keyword_a"), r.withColumnRenamed("keyword", "keyword_b")
    common = a.join(b, "url_hash").where("keyword_a <> keyword_b").groupBy("keyword_a", "keyword_b").agg(F.count(F.lit(1)).alias("c"))
    return common.join(sizes, common["keyword_a"] == sizes["keyword"]).select("keyword_a", "keyword_b", "size_a", (F.col("size_a") - F.col("c")).alias("missing"))


def subject_not_in_title(rows: DataFrame, tz: str = S.SEOUL, share: float = 0.15, gone_share: float = 0.9, in_a_row: int = 3) -> DataFrame:
    """(batch, articles, absent, absent_deleted, over, alarm) from (collected_at, title, subject, deleted): how often
    the keyword's subject is missing from the title; alarm after ``in_a_row`` batches over both thresholds."""
    absent = ~F.contains(F.lower("title"), F.lower("subject"))
    by = rows.groupBy(local_date(F.col("collected_at"), tz).alias("batch")).agg(F.count(F.lit(1)).alias("articles"), F.count(F.when(absent, 1)).alias("absent"), F.count(F.when(absent & F.col("deleted"), 1)).alias("absent_deleted"))
    over = (F.col("absent") > share * F.col("articles")) & (F.col("absent_deleted") >= gone_share * F.col("absent"))
    by = by.withColumn("over", over)
    last = Window.orderBy("batch").rowsBetween(1 - in_a_row, 0)
    return by.withColumn("alarm", (F.sum(F.col("over").cast("int")).over(last) == in_a_row))


def topic_share_review(news: DataFrame, bridge: DataFrame, topics: DataFrame, most: float = 0.3, least_total: int = 100) -> DataFrame:
    """(name, count, share, flagged) of the active topics among all verified news; no flags in a small corpus."""
    ok = verified(news).select(F.col("id").alias("news_id"))
    total = ok.agg(F.count(F.lit(1)).alias("total"))
    counts = bridge.join(ok, "news_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("news_id").alias("n"))
    rows = topics.where("is_active").join(counts, F.col("id") == F.col("entity_id"), "left").crossJoin(F.broadcast(total))
    share = F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("name", F.coalesce("n", F.lit(0)).alias("count"), share.alias("share"), ((share > most) & (F.col("total") >= least_total)).alias("flagged"))


def tag_coverage(news: DataFrame, news_orgs: DataFrame, news_topics: DataFrame) -> DataFrame:
    """One row: verified news, those with an organisation, those with a topic."""
    ok = verified(news).select(F.col("id").alias("news_id"))
    o, t = news_orgs.select("news_id", F.lit(1).alias("_o")).distinct(), news_topics.select("news_id", F.lit(1).alias("_t")).distinct()
    return ok.join(o, "news_id", "left").join(t, "news_id", "left").agg(F.count(F.lit(1)).alias("news"), F.count("_o").alias("with_org"), F.count("_t").alias("with_topic"))


def unlinked_entities(entities: DataFrame, bridge: DataFrame) -> DataFrame:
    return entities.join(bridge, entities["id"] == bridge["entity_id"], "left_anti").select("id", "name")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w]+)"), 1))


def term_candidates(news: DataFrame, *dictionaries: DataFrame, least: int = 5, body: str = "body") -> DataFrame:
    """(term, docs): terms of at least ``least`` verified articles that no dictionary names."""
    docs = verified(news).select(F.explode(tokens(F.concat_ws(" ", "title", body))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    for d in dictionaries:
        docs = docs.join(entity_names(d).select(F.lower("alias").alias("term")), "term", "left_anti")
    return docs


def prefix_variants(news: DataFrame, prefix: str, body: str = "body") -> DataFrame:
    """(token, docs): every token that starts with the prefix."""
    terms = news.select(F.explode(tokens(F.concat_ws(" ", "title", body))).alias("token"))
    return terms.where(F.col("token").startswith(prefix.lower())).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


GRADES = ("1", "2", "3", "unspecified")


def grade_distribution(insights: DataFrame) -> DataFrame:
    return insights.groupBy("grade").agg(F.count(F.lit(1)).alias("insights"))


def grade_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, old, new, move): up is towards grade 1; moves from or to unspecified are set apart."""
    b, a = before.select("id", F.col("grade").alias("old")), after.select("id", F.col("grade").alias("new"))
    either = (F.col("old") == "unspecified") | (F.col("new") == "unspecified")
    return b.join(a, "id").where("old <> new").withColumn("move", F.when(either, "unspecified").when(F.col("new") < F.col("old"), "up").otherwise("down"))


def grade_crosstab(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("id", F.col("grade").alias("old")), after.select("id", F.col("grade").alias("new"))
    return b.join(a, "id").groupBy("old").pivot("new", list(GRADES)).count().na.fill(0)


def insight_evidence_dist(insights: DataFrame, insight_news: DataFrame, many: int = 6) -> DataFrame:
    """(evidence, insights, flagged): insights by their number of news."""
    n = insight_news.groupBy("insight_id").agg(F.count(F.lit(1)).alias("n"))
    per = insights.join(n, F.col("id") == F.col("insight_id"), "left").select(F.coalesce("n", F.lit(0)).alias("evidence"))
    return per.groupBy("evidence").agg(F.count(F.lit(1)).alias("insights")).withColumn("flagged", F.col("evidence") >= many)


def news_in_insights(news: DataFrame, insight_news: DataFrame) -> DataFrame:
    """One row: verified news, those tied to an insight, those tied to several."""
    ok = verified(news).select(F.col("id").alias("news_id"))
    n = insight_news.groupBy("news_id").agg(F.count_distinct("insight_id").alias("n"))
    return ok.join(n, "news_id", "left").agg(F.count(F.lit(1)).alias("news"), F.count("n").alias("tied"), F.count(F.when(F.col("n") > 1, 1)).alias("tied_to_several"))


def corpus_counts(news: DataFrame, **tables: DataFrame) -> DataFrame:
    """(table, rows), news by status."""
    out = news.groupBy(F.concat(F.lit("news "), "status").alias("table")).agg(F.count(F.lit(1)).alias("rows"))
    for name, df in tables.items():
        out = out.union(df.agg(F.lit(name), F.count(F.lit(1))))
    return out


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.withColumnRenamed("rows", "before").join(after.withColumnRenamed("rows", "after"), "table", "full")
    return j.select("table", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("change", F.col("after") - F.col("before"))


def log_summary(logs: DataFrame, tz: str = S.SEOUL) -> DataFrame:
    """(day, actor, runs, failures, collected) with totals by day and over all under null."""
    rows = logs.withColumn("day", local_date(F.col("started_at"), tz))
    return rows.rollup("day", "actor").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("status") == "fail", 1)).alias("failures"), F.sum("collected_count").alias("collected"), F.grouping_id().cast("int").alias("level"))


def correction_loss(records: DataFrame, deletions: DataFrame) -> DataFrame:
    """Correction records that go with the deleted articles."""
    return records.join(deletions.select("news_id").distinct(), "news_id", "left_semi")


def series_gaps(news: DataFrame, tz: str = S.SEOUL) -> DataFrame:
    """(day, count, gap_days): days with news, and the days without between one and the one before."""
    by_day = news.groupBy(local_date(F.col("published_at"), tz).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    return by_day.withColumn("gap_days", F.datediff("day", F.lag("day").over(Window.orderBy("day"))) - 1)


def bundle_labels(news: DataFrame, repeats: int = 3) -> DataFrame:
    """(label, count, candidate): labels of bundled briefs; one that is repeated may be blocked."""
    labelled = news.select(bundle_label(F.col("title")).alias("label")).where("label is not null")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count")).withColumn("candidate", F.col("count") >= repeats)


def alias_gap(news: DataFrame, entities: DataFrame, bridge: DataFrame, records: DataFrame, axis: str) -> DataFrame:
    """(news_id, entity_id, reason): matches that aren't tagged, removed by the latest correction or never tagged."""
    missing = tag_entities(news, entities).join(bridge, ["news_id", "entity_id"], "left_anti")
    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("target_name"))
    removed = latest_correction(records).where((F.col("axis") == axis) & (F.col("action") == "remove")).join(named, "target_name").select("news_id", "entity_id", F.lit(1).alias("_r"))
    return missing.join(removed, ["news_id", "entity_id"], "left").select("news_id", "entity_id", F.when(F.col("_r").isNull(), "never_tagged").otherwise("removed").alias("reason"))


def alias_containment(entities: DataFrame) -> DataFrame:
    """(entity_a, alias_a, entity_b, alias_b): an alias inside another entity's longer one. Aliases meet by
    their substrings, so the dictionary isn't joined with itself in full."""
    names = entity_names(entities).select("entity_id", F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    n = F.char_length("alias")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col("alias"), i, k))))
    parts = names.select(F.col("entity_id").alias("entity_b"), F.col("alias").alias("alias_b"), F.explode(F.array_distinct(spans)).alias("alias_a")).where("alias_a <> alias_b")
    return parts.join(names.select(F.col("entity_id").alias("entity_a"), F.col("alias").alias("alias_a")), "alias_a").where("entity_a <> entity_b").select("entity_a", "alias_a", "entity_b", "alias_b")


def missed_runs(checks: DataFrame, runs: DataFrame, first: dt.date, last: dt.date, tz: str = S.SEOUL, hour: int = 9, grace_hours: int = 15, registered: bool = True) -> DataFrame:
    """(check_at, last_run, last_fire, state) for each check time: clear if a run came at or after the latest
    expected fire (weekdays at ``hour``), pending within the grace after it, else stale. As-of within
    each day by an ordered union of the three series, across days by one row a day."""
    spark = checks.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d")).where(F.dayofweek("d").between(2, 6))
    fires = days.select(F.to_utc_timestamp(F.col("d").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour)), tz).alias("t"))
    series = checks.select(F.col("check_at").alias("t"), F.lit(2).alias("o")).union(runs.select("started_at", F.lit(1))).union(fires.select("t", F.lit(0)))
    run, fire = F.when(F.col("o") == 1, F.col("t")), F.when(F.col("o") == 0, F.col("t"))
    series = series.withColumn("day", F.to_date("t"))
    by_day = series.groupBy("day").agg(F.max(run).alias("run"), F.max(fire).alias("fire"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    carried = by_day.select("day", F.max("run").over(earlier).alias("_run"), F.max("fire").over(earlier).alias("_fire"))
    before = Window.partitionBy("day").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = series.withColumn("last_run", F.max(run).over(before)).withColumn("last_fire", F.max(fire).over(before)).where("o = 2").join(carried, "day")
    seen = seen.withColumn("last_run", F.coalesce("last_run", "_run")).withColumn("last_fire", F.coalesce("last_fire", "_fire"))
    clear = F.col("last_fire").isNull() | F.coalesce(F.col("last_run") >= F.col("last_fire"), F.lit(False))
    late = F.col("t") >= F.col("last_fire") + F.make_dt_interval(F.lit(0), F.lit(grace_hours))
    state = F.when(clear, "clear").when(late | F.lit(not registered), "stale").otherwise("pending")
    return seen.select(F.col("t").alias("check_at"), "last_run", "last_fire", state.alias("state"))
