"""URL filters with redirect equivalence.

Allow and block rules judge urls by host and path. Redirect and canonical-link edges make urls
aliases of each other; a block decision reaches every alias that has no rule of its own, unless the
same class of aliases holds an explicit allow. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable
from .graph import components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. A rule fits its host and all
    subdomains if the path starts with the rule's. The rules are a list of the call."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first, so it comes last
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def node(url: Column) -> Column:
    """A url as an alias node: without its fragment, which no server sees, and with a lower-case host."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    prefix = F.regexp_extract(bare, r"(?s)^(.*?://)", 1)
    rest = F.substring(bare, F.length(prefix) + F.length(host_of(bare)) + 1, F.length(bare))
    return F.when(bare.contains("://"), F.concat(ascii_lower(prefix), host_of(bare), rest)).otherwise(bare)


def _folded(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def _absolute(base: Column, link: Column) -> Column:
    """Resolves a link against a base url: absolute ones stay; ``//h/p``, ``/p``, ``p``, ``./p``, ``../p``,
    ``?q`` and ``#f`` take the base's scheme, host, folder or path. Null if the base has no ``://``."""
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit("://"), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1))
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path_of(base), r"(?s)^(.*)/[^/]*$", 1), F.lit("/"))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(~base.contains("://") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, _folded(path), rest))
        .when(path == "", F.concat(origin, path_of(base), F.when(link.startswith("?"), rest).otherwise(F.concat(query, rest))))
        .otherwise(F.concat(origin, _folded(F.concat(folder, path)), rest))
    )


# The character references that stand in urls.
_REFERENCES = (("&#x2F;", "/"), ("&#47;", "/"), ("&#x3A;", ":"), ("&#58;", ":"), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it stands, empty if it has none."""
    found = F.regexp_extract(tag, r"(?is)[\s\"']" + name + r"""\s*=\s*("[^"]*|'[^']*|[^"'\s>]+)""", 1)
    return F.trim(F.regexp_replace(found, "^[\"']", ""))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), 0)


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) edges that the pages state: ``<link rel=canonical href=...>`` (canonical may be one of
    several words) and ``<meta http-equiv=refresh content="0; url=...">``, attributes in any order and
    quoting, resolved against the page or its ``<base href>``."""
    html = F.col("html")
    canonical = F.transform(F.filter(_tags(html, "link"), lambda t: _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: _attribute(t, "href"))
    target = lambda c: F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)\burl\s*=\s*(.*)$", 1), "^[\"']|[\"']\\s*$", ""))
    refresh = F.transform(F.filter(_tags(html, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: target(_attribute(t, "content")))
    linked = pages.where(F.col("url").isNotNull() & html.rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")).select(F.col("url").alias("src"), "html")
    stated = linked.select("src", F.get(F.transform(_tags(html, "base"), lambda t: _attribute(t, "href")), F.lit(0)).alias("base"), F.explode(F.concat(canonical, refresh)).alias("link"))
    plain = F.col("link")
    for reference, char in _REFERENCES:
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    links = stated.where("link <> ''").withColumn("link", plain)
    links = links.withColumn("base", F.when(F.coalesce("base", F.lit("")) == "", F.col("src")).otherwise(F.coalesce(_absolute(F.col("src"), F.col("base")), F.col("src"))))
    return links.select("src", _absolute(F.col("base"), F.col("link")).alias("dst")).where("dst is not null")


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, alias_class) for each row of ``pages`` (key, url, html).

    edges: further redirects (src, dst), such as a crawl log's; those of the pages come on top.
    Verdict: the rule's where one fits; else allow if an alias has an explicit allow; else block if
    an alias is blocked; else allow. ``alias_class`` is the least url of the class, null for a url
    without aliases. A null url has empty host and path, no alias, and is allowed; repeated rows get
    equal results; a null or empty html states no links; other columns are ignored.
    """
    links = page_links(pages).select("src", "dst")
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    links = durable(links)  # few and slim; else each use of an edge's end would resolve the link anew
    classes = components(links.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")))
    decided = classes.withColumn("_verdict", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1])
    by_class = decided.groupBy("component").agg(F.max(F.col("_verdict") == "allow").alias("_allows"), F.max(F.col("_verdict") == "block").alias("_blocks"))
    aliases = classes.join(by_class, "component")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select(F.col(key), "url", host.alias("host"), path.alias("path")).withColumn("node", node(F.col("url")))
    own = own.withColumn("node", F.coalesce("node", F.concat(F.lit(" "), F.xxhash64(key))))  # so that null urls don't meet; no url node starts so
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.coalesce("_allows", F.lit(False)), "allow").when(F.coalesce("_blocks", F.lit(False)), "block").otherwise("allow")
    return own.join(aliases, "node", "left").select(key, "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("component").alias("alias_class"))
