"""Registered queries: line cleaning, tagging, alias audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching, textclean
from ..functions import scalars as P
from ..operators import audit, judgment
from ..sources.adapters import Tables
from .prelude import RULE_SQL, query


@query("cleaned", "SELECT id, l AS lines FROM cleaned")
def t1_clean_lines(t: Tables):
    return t.articles.select("id", textclean.clean_lines(F.col("body")).alias("lines"))


@query("cut", "SELECT id, len(l) AS n FROM cut")
def t2_trailing_widget_cut(t: Tables):
    return t.articles.select("id", F.size(textclean.cut_widgets(textclean.raw_lines(F.col("body")))).cast("long").alias("n"))


@query("lines", r"SELECT source_type, count(*) FILTER (regexp_matches(x, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+')) AS emails, count(*) AS lines FROM (SELECT source_type, unnest(l) AS x FROM lines) GROUP BY source_type")
def t3_residue_rules(t: Tables):
    rows = t.articles.select("source_type", F.explode(textclean.raw_lines(F.col("body"))).alias("x"))
    return rows.groupBy("source_type").agg(F.count(F.when(textclean.rule_of(F.col("x")) == "email", 1)).alias("emails"), F.count(F.lit(1)).alias("lines"))


@query("planted_rules", "SELECT source_type, rule, count(*) AS lines FROM planted_rules WHERE rule IS NOT NULL GROUP BY ALL")
def t3_all_residue_rules(t: Tables):
    """Lines that each of the fifteen rules takes or trims, Korean ones planted by id among them."""
    rows = t.planted.select("source_type", F.explode(textclean.raw_lines(F.col("body"))).alias("x"))
    return rows.withColumn("rule", textclean.rule_of(F.col("x"))).where("rule is not null").groupBy("source_type", "rule").agg(F.count(F.lit(1)).alias("lines"))


@query("planted_clean", "SELECT id, array_to_string(l, chr(10)) AS text FROM planted_clean")
def t5_clean_planted_text(t: Tables):
    """Widget cuts, drops and trims of all rules over bodies with planted residue."""
    return t.planted.select("id", textclean.clean_text(F.col("body")).alias("text"))


@query("lines", r"""SELECT id, count(*) FILTER (regexp_matches(regexp_replace(regexp_replace(x, '["''“”‘’()\[\]『』「」《》]+$', ''), '\s+$', ''), '[.!?다요]$')) AS terminal FROM (SELECT id, unnest(l) AS x FROM lines) GROUP BY id""")
def t4_ends_with_terminal(t: Tables):
    rows = t.articles.select("id", F.explode(textclean.raw_lines(F.col("body"))).alias("x"))
    return rows.groupBy("id").agg(F.count(F.when(textclean.ends_with_terminal(F.col("x")), 1)).alias("terminal"))


@query("cleaned", "SELECT id, array_to_string(l, chr(10)) AS text FROM cleaned")
def t5_clean_text_for_matching(t: Tables):
    return t.articles.select("id", textclean.clean_text(F.col("body")).alias("text"))


@query("cleaned", r"""
SELECT news_id, para_no, p AS text, started IS NOT NULL AND para_no > started AND NOT regexp_matches(p, '^[-–—]') AND length(p) <= 45 AND NOT done AND (contains(p, '…') OR contains(p, '..') OR contains(p, ',')) AS is_subtitle
FROM (SELECT *, min(CASE WHEN done THEN para_no END) OVER (PARTITION BY news_id) AS started FROM (
  SELECT *, regexp_matches(regexp_replace(regexp_replace(p, '["''“”‘’()\[\]『』「」《》]+$', ''), '\s+$', ''), '[.!?다요]$') AS done
  FROM (SELECT id AS news_id, unnest(l) AS p, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS para_no FROM cleaned)))""")  # fmt: skip
def t6_classify_paragraphs(t: Tables):
    return textclean.classify_paragraphs(t.articles)


@query("cut", r"SELECT source_type, 'email' AS rule, count(*) AS lines FROM (SELECT source_type, unnest(l) AS x FROM cut) WHERE regexp_matches(x, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+') GROUP BY source_type")
def t7_residue_stats(t: Tables):
    return textclean.residue_stats(t.articles)


@query("planted_cut", f"SELECT source_type, rule, count(*) AS lines FROM (SELECT source_type, {RULE_SQL} AS rule FROM (SELECT source_type, unnest(l) AS x FROM planted_cut)) WHERE rule IS NOT NULL GROUP BY ALL")
def t7_all_residue_stats(t: Tables):
    return textclean.residue_stats(t.planted)


@query("articles", "SELECT id FROM articles WHERE status = '검증됨'")
def f2_verified(t: Tables):
    return P.verified(t.articles).select("id")


@query("news", "SELECT id FROM news WHERE contains(lower(title || ' ' || body), 'kw3') AND contains(lower(title || ' ' || body), 'order')")
def f5_token_and_match(t: Tables):
    text = F.concat("title", F.lit(" "), "body")
    return t.news.where(matching.token_and_match(text, F.lit(" KW3  order "))).select("id")


@query("articles", "SELECT id, regexp_matches(lower(body), '(^|[^0-9a-z])the($|[^0-9a-z])') AS has_the, contains(lower(body), 'é') AS has_e, regexp_matches(lower(body), '(^|[^0-9a-z])mit($|[^0-9a-z])') AS has_mit FROM articles")
def f6_contains_alias(t: Tables):
    has = lambda a: matching.contains_alias(F.col("body"), a)
    return t.articles.select("id", has("The").alias("has_the"), has("é").alias("has_e"), has("MIT").alias("has_mit"))


@query("relations orgs", "SELECT r.org_a, r.org_b FROM relations r JOIN orgs a ON a.id = org_a JOIN orgs b ON b.id = org_b WHERE (a.org_type = 'AI') <> (b.org_type = 'AI')")
def f7_allowed_pair(t: Tables):
    from ..operators.graph import allowed_pair

    o = t.orgs.select("id", "org_type")
    r = t.relations.join(o.withColumnsRenamed({"id": "org_a", "org_type": "ta"}), "org_a").join(o.withColumnsRenamed({"id": "org_b", "org_type": "tb"}), "org_b")
    return r.where(allowed_pair(F.col("ta"), F.col("tb"))).select("org_a", "org_b")


@query("news", r"SELECT label, count(*) AS count, count(*) >= 3 AS candidate FROM (SELECT nullif(regexp_extract(title, '^\s*\[([^\]]+)\]', 1), '') AS label FROM news) WHERE label IS NOT NULL GROUP BY label")
def f8_bundle_label(t: Tables):
    return audit.bundle_labels(t.news)


@query("tags", "SELECT * FROM tags")
def j2_tag_entities(t: Tables):
    return judgment.tag_entities(t.articles, t.dictionary)


def _old_tags(t: Tables):
    n = F.col("doc_id")
    return t.raw("documents").select(n.alias("news_id"), F.explode(F.array_distinct(F.array(n % 10, (n + 3) % 10))).alias("entity_id")).distinct()


_CHANGES = """changes AS (SELECT news_id, entity_id, 'added' AS change FROM (SELECT * FROM tags EXCEPT SELECT * FROM old_tags) UNION ALL SELECT news_id, entity_id, 'lost' FROM (SELECT * FROM old_tags EXCEPT SELECT * FROM tags))"""


@query("tags old_tags", f"SELECT count(DISTINCT news_id) AS changed_news FROM (WITH {_CHANGES} SELECT * FROM changes)")
def u4_remap(t: Tables):
    return judgment.changed_news(_old_tags(t), judgment.remap(t.articles, t.dictionary))


@query("tags old_tags", f"WITH {_CHANGES} SELECT * FROM changes".replace("WITH", "SELECT * FROM (WITH", 1) + ")")
def u4_remap_changes(t: Tables):
    return judgment.remap_changes(_old_tags(t), judgment.remap(t.articles, t.dictionary))


@query("tags", "SELECT entity_id, 'lost' AS change, count(*) AS pairs FROM tags WHERE entity_id IN (3, 9) GROUP BY entity_id")
def u5_remap_preview(t: Tables):
    """What goes if two entities leave the dictionary."""
    return judgment.remap_preview(t.articles, t.dictionary, t.dictionary.where("id not in (3, 9)"))


@query("tags corrections", "SELECT news_id, entity_id FROM tags t WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.news_id = t.news_id AND c.entity_id = t.entity_id AND action = 'remove') UNION SELECT news_id, entity_id FROM corrections WHERE action = 'add'")
def u6_remap_with_corrections(t: Tables):
    return judgment.remap_with_corrections(t.articles, t.dictionary, t.corrections, "tech_topic")


@query("tags old_tags corrections", "SELECT news_id, entity_id, CASE WHEN EXISTS (SELECT 1 FROM corrections c WHERE c.news_id = m.news_id AND c.entity_id = m.entity_id AND action = 'remove') THEN 'removed' ELSE 'never_tagged' END AS reason FROM (SELECT * FROM tags EXCEPT SELECT * FROM old_tags WHERE entity_id % 2 = 0) m")
def j9_alias_gap(t: Tables):
    return audit.alias_gap(t.articles, t.dictionary, _old_tags(t).where("entity_id % 2 = 0"), t.corrections, "tech_topic")


@query("orgs topics", """
SELECT a.id AS entity_a, lower(a.name) AS alias_a, b.id AS entity_b, lower(b.name) AS alias_b FROM topics a JOIN topics b ON a.id <> b.id AND a.name <> b.name AND contains(lower(b.name), lower(a.name)) WHERE a.is_active AND b.is_active""")  # fmt: skip
def j10_alias_containment(t: Tables):
    return audit.alias_containment(t.topics)


@query("articles", r"""
SELECT term, docs FROM (SELECT term, count(DISTINCT id) AS docs FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}\p{M}_]+')) AS term FROM articles WHERE status = '검증됨') GROUP BY term) WHERE docs >= 5 AND term NOT IN ('the', 'tion', 'tions', 'license', 'der', 'que', 'qué', 'mit', 'gnu', 'é')""")  # fmt: skip
def a20_term_candidates(t: Tables):
    return audit.term_candidates(t.articles, t.dictionary)


@query("articles", r"SELECT token, count(DISTINCT id) AS docs FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}\p{M}_]+')) AS token FROM articles) WHERE starts_with(token, 'tion') GROUP BY token")
def a21_prefix_variants(t: Tables):
    return audit.prefix_variants(t.articles, "Tion")
