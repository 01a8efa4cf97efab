"""Projections and scalar normalisation of articles and search hits."""

from __future__ import annotations

import datetime as dt
import html
import re
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

#: The white space of Python's str.strip; Java's own class lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"
MIN_BODY = 200


#: The same white space as single characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Removes Unicode white space from both ends."""
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_AMPERSAND = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def closed_references(text: str) -> str:
    """HTML in which each ampersand that begins no whole reference is escaped. ``html.unescape``, like a browser, also resolves
    a hundred old names without a semicolon, and so the ``&amp`` of a text that was cut within a reference."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 or m[0].startswith("&#") else "&amp;" + m[0][1:], text)


@F.pandas_udf(T.StringType())
def _closed(texts: pd.Series) -> pd.Series:
    return texts.map(closed_references, na_action="ignore")


def strip_html(c: Column, closed: bool = False) -> Column:
    """Tags go first, then entities are resolved, so an escaped tag stays as text. ``closed``: only those that a
    semicolon ends."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    return strip(html_unescape(_closed(bare) if closed else bare))


def pick_url(original: Column, link: Column) -> Column:
    """The original link if there is one, else the portal's; null if neither is."""
    return F.coalesce(F.nullif(original, F.lit("")), F.nullif(link, F.lit("")))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def parse_pub_date(c: Column) -> Column:
    """An RFC 2822 date; null if it can't be read."""
    bare = F.regexp_replace(strip(c), r"^\w{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UTC|UT)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z")])


def snippet_body(title: Column, description: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def is_portal(url: Column) -> Column:
    return F.coalesce(url.contains(S.PORTAL_DOMAINS[0]) | url.contains(S.PORTAL_DOMAINS[1]), F.lit(False))


def coalesce_body(original: Column, link: Column, portal_text: Column, generic_text: Column, original_portal_text: Column) -> Column:
    """The article's body by priority; null if no candidate has MIN_BODY characters."""
    long = lambda c: F.when(F.length(c) >= MIN_BODY, c)
    has = F.coalesce(original != "", F.lit(False))
    return F.coalesce(F.when(is_portal(link), long(portal_text)), F.when(has, long(generic_text)), F.when(has & is_portal(original), long(original_portal_text)))


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset(["script", "style"])
_BOILERPLATE = frozenset("nav header footer aside form table noscript iframe".split())
#: Tags that end a block of text; a block mostly of links is a menu, whatever its tags, unless it is a heading.
_BLOCKS = frozenset("address article blockquote body center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section ul".split())
_HEADINGS = frozenset("h1 h2 h3".split())
LINKED = 0.5


class _Text(HTMLParser):
    """Text nodes below the first element with an id; with none wanted, of the main part of a page: without boilerplate
    elements, and without blocks of which over ``LINKED`` is the text of links."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.skip, self.parts, self.done, self.open = wanted, 0, 0, [], False, []
        self.block, self.links = [], 0  # (text, whether it is a link's) of the block so far; open links

    def end_block(self):
        """Keeps the block's text, if it isn't a menu."""
        linked, total = (sum(len(t.strip()) for t, of_link in self.block if of_link or whole) for whole in (False, True))
        if linked <= LINKED * total or not _HEADINGS.isdisjoint(self.open):
            self.parts += [t for t, _ in self.block]
        self.block = []

    def close(self):
        super().close()
        self.end_block()

    def handle_starttag(self, tag, attrs):
        if self.wanted is None and tag in _BLOCKS:
            self.end_block()
        if tag in _VOID:
            return
        self.links += tag == "a"
        if self.wanted is not None:
            if self.depth:
                self.depth += 1
            elif not self.done and dict(attrs).get("id") == self.wanted:
                self.depth = 1
        self.open.append(tag)
        if tag in _SKIPPED or self.wanted is None and (tag in _BOILERPLATE or tag in ("title", "head")):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        if self.wanted is None and tag in _BLOCKS:
            self.end_block()
        while self.open:
            top = self.open.pop()
            self.links -= top == "a"
            if top in _SKIPPED or self.wanted is None and (top in _BOILERPLATE or top in ("title", "head")):
                self.skip -= 1
            if self.depth:
                self.depth -= 1
                self.done |= self.depth == 0
            if top == tag:
                break

    def handle_data(self, data):
        if not self.skip and (self.wanted is None or self.depth):
            if self.wanted is None:
                self.block.append((data, self.links > 0))
            else:
                self.parts.append(data)


def article_text(page: str | None, ids: tuple[str, ...] = ("dic_area", "articleBodyContents"), generic: bool = True) -> str | None:
    """The text of the article's container; else, if ``generic``, of the page's main part. Null under MIN_BODY."""
    if not page:
        return None
    for wanted in ids:
        parser = _Text(wanted)
        parser.feed(page)
        parser.close()
        if parser.done or parser.depth:
            text = "\n".join(parser.parts).strip()
            return text if len(text) >= MIN_BODY else None
    if not generic:
        return None
    parser = _Text(None)
    parser.feed(page)
    parser.close()
    text = "\n".join(p.strip() for p in parser.parts if p.strip())
    return text if len(text) >= MIN_BODY else None


@F.pandas_udf(T.StringType())
def _article_text(pages: pd.Series) -> pd.Series:
    return pages.map(article_text)


def extract_article_text(page: Column, closed: bool = False) -> Column:
    """``closed``: only references that a semicolon ends are resolved."""
    return _article_text(_closed(page) if closed else page)


def display_text(short: Column, full: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), full)


def normalize_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def local_date(ts: Column, tz: str = S.SEOUL) -> Column:
    """The date in ``tz`` of a time kept as UTC."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def pct(value: Column, most: Column) -> Column:
    """Whole percent of ``most``, halves to even; 0 if ``most`` is 0 or null."""
    return F.when(F.coalesce(most, F.lit(0)) == 0, F.lit(0)).otherwise(F.bround(value / most * 100).cast("int"))


def embedding_text(title: Column, body: Column) -> Column:
    """What is embedded; null if blank."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return F.when(strip(text) != "", text)


def node_size(count: Column) -> Column:
    return F.greatest(F.lit(14), F.least(F.lit(40), 14 + 2 * count)).cast("int")


def node_category(org_type: Column) -> Column:
    return F.when(org_type == S.INSURANCE, 1).when(org_type == S.AI, 2).otherwise(0)


def verified(news: DataFrame) -> DataFrame:
    return news.where(F.col("status") == S.VERIFIED)


def period_start(period: str | None, as_of: dt.date) -> dt.date | None:
    """The first day of 7d or 30d; None for ``all``, which any other value is."""
    days = {"7d": 6, "30d": 29}.get(period or "")
    return None if days is None else as_of - dt.timedelta(days=days)


def in_period(news: DataFrame, period: str | None, as_of: dt.date, tz: str = S.SEOUL) -> DataFrame:
    """Rows published in the period; ``all`` has no bound on either side. The bounds are constants on the
    stored time, so they reach the scan and prune files and row groups."""
    start = period_start(period, as_of)
    if start is None:
        return news
    first, end = (F.to_utc_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp"), tz) for day in (start, as_of + dt.timedelta(days=1)))
    return news.where((F.col("published_at") >= first) & (F.col("published_at") < end))
