"""Matching of words and aliases in texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_words(text: Column, words: DataFrame, word: str = "keyword") -> Column:
    """The distinct words, lower-cased, that stand anywhere in the text. The list is a dimension of a few
    words and goes along as a literal."""
    listed = sorted({r[0].lower() for r in words.select(word).where(F.col(word).isNotNull()).toLocalIterator()})
    if not listed:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(w) for w in listed]), lambda w: F.contains(F.lower(text), w))


def token_and_match(text: Column, keyword: Column) -> Column:
    """Every token of the keyword stands in the text, in any place; letter case aside."""
    tokens = F.filter(F.split(F.lower(keyword), r"(?U)\s+"), lambda t: t != "")
    return F.forall(tokens, lambda t: F.contains(F.lower(text), t))


def tokens_in(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(news_id, text) and (keyword, tokens), lower-cased -> (news_id, keyword) where the text holds all tokens. A
    keyword without tokens stands everywhere."""
    shared = rows.sparkSession.sparkContext.broadcast([(r.keyword, sorted(set(r.tokens))) for r in words.where("tokens is not null").toLocalIterator()])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        always = [k for k, tokens in shared.value if not tokens]
        holders: dict[str, list[tuple[str, int]]] = {}
        for keyword, tokens in shared.value:
            for t in tokens:
                holders.setdefault(t, []).append((keyword, len(tokens)))
        automaton = ahocorasick.Automaton()
        for t in holders:
            automaton.add_word(t, t)
        automaton.make_automaton()

        def found(text: str) -> list[str]:
            met: dict[str, int] = {}
            out = list(always)
            for t in {t for _, t in automaton.iter(text)} if holders else ():
                for keyword, needs in holders[t]:
                    met[keyword] = met.get(keyword, 0) + 1
                    if met[keyword] == needs:
                        out.append(keyword)
            return out

        for pdf in frames:
            yield pd.DataFrame({"news_id": pdf.news_id, "keyword": pdf.text.map(found)}).explode("keyword").dropna()

    return rows.where("news_id is not null and text is not null").mapInPandas(match, "news_id long, keyword string")


#: Aliases in one broadcast automaton.
ALIASES = 200_000
_WORD_CHARS = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def alias_pattern(alias: str) -> str | None:
    """A regular expression for an alias: bounded on a side where the alias has an ASCII letter or digit."""
    needle = alias.lower()
    if not needle:
        return None
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~/" else c for c in needle)
    return ("(?<![0-9a-zA-Z])" if needle[0] in _WORD_CHARS else "") + quoted + ("(?![0-9a-zA-Z])" if needle[-1] in _WORD_CHARS else "")


def contains_alias(text: Column, alias: str) -> Column:
    """Whether the text holds the alias, letter case aside."""
    pattern = alias_pattern(alias)
    return F.lit(False) if pattern is None else F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


class AliasMatcher:
    """All entities of a dictionary that a text mentions, in one pass over the text."""

    def __init__(self, names: list[tuple[int, str]]):
        listed: dict[str, set[int]] = {}
        for entity, alias in names:
            if alias and alias.lower():
                listed.setdefault(alias.lower(), set()).add(entity)
        self.words = ahocorasick.Automaton()
        for needle, entities in listed.items():
            self.words.add_word(needle, (len(needle), needle[0] in _WORD_CHARS, needle[-1] in _WORD_CHARS, entities))
        self.empty = not listed
        self.words.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        if self.empty or not text:
            return []
        text, found = text.lower(), set()
        for end, (length, opens, closes, entities) in self.words.iter(text):
            before, after = end - length, end + 1
            if not (opens and before >= 0 and text[before] in _WORD_CHARS) and not (closes and after < len(text) and text[after] in _WORD_CHARS):
                found |= entities
        return sorted(found)


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity_id, alias): names and aliases of the active entities."""
    active = entities.where("is_active")
    return active.select(F.col("id").alias("entity_id"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))


def in_blocks(df: DataFrame, rows: int, *by: str) -> list[DataFrame]:
    """A dimension table cut by hash into parts of about ``rows`` rows, each small enough to broadcast."""
    parts = max(1, -(-df.count() // rows))
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(*(by or df.columns)), F.lit(parts)) == n) for n in range(parts)]


def mentions(texts: DataFrame, entities: DataFrame, block: int = ALIASES) -> DataFrame:
    """(news_id, text) -> (news_id, entity_id): the active entities that each text mentions, batch or stream.
    Some ``block`` aliases of the dictionary are broadcast at a time, an entity's all together, and matched
    by an automaton of their own; most dictionaries are one block. Null news ids are passed over."""
    names = entity_names(entities).where("alias is not null").distinct()
    rows = texts.where("news_id is not null").select("news_id", "text")
    return reduce(DataFrame.union, [_matched(rows, part) for part in in_blocks(names, block, "entity_id")])


def _matched(rows: DataFrame, names: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([(r.entity_id, r.alias) for r in names.toLocalIterator()])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = AliasMatcher(shared.value)
        for pdf in frames:
            found = pdf.text.map(matcher)
            yield pd.DataFrame({"news_id": pdf.news_id, "entity_id": found}).explode("entity_id").dropna().astype("int64")

    return rows.mapInPandas(match, "news_id long, entity_id long")


def bundle_label(title: Column) -> Column:
    """The bracketed label at the front of a title, else null."""
    return F.nullif(F.regexp_extract(title, r"^\s*\[([^\]]+)\]", 1), F.lit(""))
