"""Report parsing and integrity: titles, issue blocks, references, abridgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import display_text, strip

# Fixed values of the report format.
SEPARATORS = ("—", "–", "-")
PERIOD_WORDS = ("주차", "월")
ISSUE_HEADER = r"(?m)^###[ \t]+(?!#)"
REFERENCE_LINE = r"^[ \t]*참고[ \t]*[:：][ \t]*(.*)\z"
UUID = r"(?i)^\{?(?:urn:uuid:)?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"


def title_period(title: Column) -> Column:
    """What stands before the first separator that splits off a period; empty if none does."""
    out = F.lit("")
    for sep in reversed(SEPARATORS):
        head, tail = strip(F.substring_index(title, sep, 1)), F.substring(title, F.instr(title, sep) + 1, F.length(title))
        fits = (F.instr(title, sep) > 0) & (strip(tail) != "") & (head.contains(PERIOD_WORDS[0]) | head.contains(PERIOD_WORDS[1]))
        out = F.when(fits, head).otherwise(out)
    return F.when(title.isNull(), "").otherwise(out)


def title_body(title: Column) -> Column:
    out = strip(title)
    for sep in reversed(SEPARATORS):
        head, tail = strip(F.substring_index(title, sep, 1)), F.substring(title, F.instr(title, sep) + 1, F.length(title))
        fits = (F.instr(title, sep) > 0) & (strip(tail) != "") & (head.contains(PERIOD_WORDS[0]) | head.contains(PERIOD_WORDS[1]))
        out = F.when(fits, strip(tail)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def short_period(title: Column) -> Column:
    """The period without the dates in brackets and a leading year."""
    head = strip(F.substring_index(title_period(title), "(", 1))
    return strip(F.regexp_replace(head, r"(?U)^\d{4}\s*년\s*", ""))


def preamble(content: Column) -> Column:
    """The text before the first issue header; all of it if there is none."""
    return F.element_at(F.split(F.coalesce(content, F.lit("")), ISSUE_HEADER, -1), 1)


def report_issues(reports: DataFrame, content: str = "content") -> DataFrame:
    """(report_id, issue_no, title, body, refs): the issue blocks of each report, without their reference
    lines; ``refs`` are its tokens in order. A reference line counts only as a block's last one."""
    blocks = F.split(F.coalesce(content, F.lit("")), ISSUE_HEADER, -1)
    rows = reports.select(F.col("id").alias("report_id"), F.posexplode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("issue_no", "block"))
    first = F.substring_index("block", "\n", 1)
    rest = F.substring(F.col("block"), F.length(first) + 2, F.length("block"))
    trim = lambda c: F.regexp_replace(c, r"\A\n+|\n+\z", "")
    rows = rows.select("report_id", "issue_no", strip(first).alias("title"), trim(rest).alias("raw")).withColumn("lines", F.split("raw", "\n", -1))
    last = F.array_max(F.filter(F.transform("lines", lambda x, i: F.when(strip(x) != "", i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("last", last).withColumn("line", strip(F.element_at("lines", F.coalesce(F.col("last"), F.lit(0)) + 1)))
    marked = F.col("last").isNotNull() & F.col("line").rlike(REFERENCE_LINE)
    tokens = F.filter(F.transform(F.split(F.regexp_extract("line", REFERENCE_LINE, 1), ","), strip), lambda t: t != "")
    body = F.when(marked, trim(F.array_join(F.slice("lines", 1, F.coalesce("last", F.lit(0))), "\n"))).otherwise(F.col("raw"))
    return rows.select("report_id", "issue_no", "title", body.alias("body"), F.when(marked, tokens).otherwise(F.array().cast("array<string>")).alias("refs"))


def canonical_uid(token: Column) -> Column:
    """A token as lower-case UUID text; null if it is none."""
    bare = F.lower(F.regexp_replace(token, UUID, "$1-$2-$3-$4-$5"))
    return F.when(token.rlike(UUID), bare)


def resolve_refs(issues: DataFrame, news: DataFrame, canonical: bool = True) -> DataFrame:
    """(report_id, issue_no, ref_pos, news_id): the tokens that are articles, once each, in order; others
    are passed over. Not gated. ``canonical=False`` takes tokens as they are, for stores with other uids."""
    rows = issues.select("report_id", "issue_no", F.posexplode("refs").alias("pos", "token"))
    rows = rows.withColumn("uid", canonical_uid(F.col("token")) if canonical else F.col("token")).where("uid is not null")
    first = rows.groupBy("report_id", "issue_no", "uid").agg(F.min("pos").alias("ref_pos"))
    return first.join(news.select("uid", F.col("id").alias("news_id")), "uid").select("report_id", "issue_no", "ref_pos", "news_id")


def report_refs(reports: DataFrame, news: DataFrame, canonical: bool = True) -> DataFrame:
    return resolve_refs(report_issues(reports), news, canonical)


def ref_link_diff(refs: DataFrame, report_news: DataFrame) -> DataFrame:
    """(report_id, news_id, only_in): where the texts' references and the links differ."""
    text = refs.select("report_id", "news_id").distinct()
    link = report_news.select("report_id", "news_id").distinct()
    a = text.join(link, ["report_id", "news_id"], "left_anti").withColumn("only_in", F.lit("text"))
    return a.union(link.join(text, ["report_id", "news_id"], "left_anti").withColumn("only_in", F.lit("link")))


def out_of_period_refs(refs: DataFrame, reports: DataFrame, news: DataFrame, day: Column) -> DataFrame:
    """(report_id, issue_no, news_id, in_period): each reference against its report's dates."""
    j = refs.join(news.select(F.col("id").alias("news_id"), day.alias("day")), "news_id").join(reports.select(F.col("id").alias("report_id"), "date_from", "date_to"), "report_id")
    return j.select("report_id", "issue_no", "news_id", F.col("day").between(F.col("date_from"), F.col("date_to")).alias("in_period"))


def report_integrity(reports: DataFrame, issues: DataFrame, refs: DataFrame, report_news: DataFrame, fewest: int = 3, most: int = 5, longest: int = 1000) -> DataFrame:
    """One row a report: issues, issues without references, tokens that resolve to nothing, long blocks,
    whether the number of issues, the links and the status are as they should be."""
    per_issue = refs.groupBy("report_id", "issue_no").agg(F.count(F.lit(1)).alias("resolved"))
    i = issues.join(per_issue, ["report_id", "issue_no"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(0)))
    by = i.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("issues"), F.count(F.when(F.col("resolved") == 0, 1)).alias("issues_without_refs"), F.sum(F.size(F.array_distinct("refs")) - F.col("resolved")).alias("unresolved"), F.count(F.when(F.char_length("body") > longest, 1)).alias("long_blocks")
    )
    diff = ref_link_diff(refs, report_news).groupBy("report_id").agg(F.count(F.lit(1)).alias("diffs"))
    j = reports.select(F.col("id").alias("report_id"), "status").join(by, "report_id", "left").join(diff, "report_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(
        "report_id", zero("issues"), zero("issues_without_refs"), zero("unresolved"), zero("long_blocks"), F.coalesce(F.col("issues").between(fewest, most), F.lit(False)).alias("count_ok"), F.col("diffs").isNull().alias("links_equal"), (F.col("status") != "done").alias("unfinished")
    )


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+", -1), strip), lambda s: s != "")


def abridgement_check(rows: DataFrame, limit: int = 300, headliner_limit: int = 500) -> DataFrame:
    """(id, foreign_sentences, effective_length, too_long) from (id, content, content_short, headliner_order)."""
    foreign = F.size(F.filter(sentences(F.col("content_short")), lambda s: ~F.contains(F.coalesce("content", F.lit("")), s)))
    length = F.coalesce(F.char_length(display_text(F.col("content_short"), F.col("content"))), F.lit(0))
    return rows.select("id", foreign.alias("foreign_sentences"), length.alias("effective_length"), (length > F.when(F.col("headliner_order").isNull(), limit).otherwise(headliner_limit)).alias("too_long"))


def extractive_short(content: Column, chosen: Column) -> Column:
    """The chosen 0-based sentences of a text, in the text's order."""
    return F.array_join(F.filter(sentences(content), lambda _, i: F.array_contains(chosen, i)), " ")


def insight_split_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(news_id, before, after) of evidence that a split lost or added; none if the multisets agree."""
    count = lambda d, n: d.groupBy("news_id").agg(F.count(F.lit(1)).alias(n))
    j = count(before, "before").join(count(after, "after"), "news_id", "full")
    return j.select("news_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).where("before <> after")
