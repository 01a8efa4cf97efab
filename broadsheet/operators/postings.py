"""An inverted index of the short substrings of texts, kept in a store: substring search, and re-tagging of what a
changed dictionary can reach.

The index holds each text's distinct substrings of one, two and three characters, a row each, in buckets by the
substring. A needle of three characters or more stands only in texts that hold all of its three-character
substrings; a shorter one is a row itself. So only the needles' buckets are read, and candidates are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..sources.store import Store

#: The longest substrings in the index; hexadecimal digits of its buckets.
GRAM, DIGITS = 3, 2


def grams_of(text: str | None) -> set[str]:
    """All substrings of up to ``GRAM`` characters."""
    return {text[i : i + n] for n in range(1, GRAM + 1) for i in range(len(text) - n + 1)} if text else set()


def needle_grams(needle: str | None) -> set[str]:
    """The substrings that a text must hold to hold the needle."""
    if not needle:
        return set()
    return {needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)} or {needle}


def _exploded(rows: DataFrame, of: Callable[[str | None], set[str]], kind: str) -> DataFrame:
    """(gram, id) of rows (id, text); a batch goes out when it is large, since texts may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ids = [], []
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = of(text)
                grams += found
                ids += [id] * len(found)
                if len(grams) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(ids, batch.column(0).type)], ["gram", "id"])
                    grams, ids = [], []
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(ids, batch.column(0).type)], ["gram", "id"])

    return rows.select("id", "text").mapInArrow(run, f"gram string, id {kind}")


def index(texts: DataFrame) -> DataFrame:
    """(gram, id) of texts (id, text), whose case is folded already."""
    return _exploded(texts.where("id is not null").select(F.col("id").cast("long").alias("id"), "text"), grams_of, "long")


def begin(store: Store, texts: DataFrame, name: str = "texts", digits: int = DIGITS) -> int:
    """Commits texts (id, text) and their index to a store, in one step. Later texts go in by ``add``."""
    rows = texts.where("id is not null").select(F.col("id").cast("long").alias("id"), "text").checkpoint()
    return store.commit(keyed={name: ("id", rows), f"{name}_grams": (["gram", "id"], index(rows))}, digits=digits)


def add(store: Store, texts: DataFrame, name: str = "texts") -> int:
    """Adds texts, or puts them in the place of those with the same id, whose substrings go."""
    rows = texts.where("id is not null").select(F.col("id").cast("long").alias("id"), "text").checkpoint()
    old = index(store.read(name, among=rows).join(rows.select("id"), "id", "left_semi"))
    return store.commit({name: ("id", rows), f"{name}_grams": (["gram", "id"], index(rows))}, delete={f"{name}_grams": (["gram", "id"], old)})


def candidates(store: Store, needles: DataFrame, name: str = "texts") -> DataFrame:
    """(needle, id): texts that hold all that the needle needs. Of the index, only the needles' buckets are read. A
    frequent substring's rows are counted before they meet, so none is gathered."""
    distinct = needles.select("needle").where("needle <> ''").distinct()
    wanted = _exploded(distinct.select(F.col("needle").alias("id"), F.col("needle").alias("text")), needle_grams, "string").withColumnRenamed("id", "needle")
    needs = wanted.groupBy("needle").agg(F.count(F.lit(1)).alias("_needs"))
    met = store.read(f"{name}_grams", among=wanted).join(wanted, "gram").groupBy("needle", "id").agg(F.count(F.lit(1)).alias("_has"))
    return met.join(needs, "needle").where("_has = _needs").select("needle", "id")


def search(store: Store, needle: str, name: str = "texts") -> DataFrame:
    """(id, text) of the texts that hold the needle, whose case is folded like theirs; an empty needle finds all."""
    if not needle:
        return store.read(name)
    ids = candidates(store, store.spark.createDataFrame([(needle,)], "needle string"), name).select("id").checkpoint()
    return store.read(name, among=ids).join(ids, "id", "left_semi").where(F.contains("text", F.lit(needle)))


def begin_tagging(store: Store, texts: DataFrame, entities: DataFrame, digits: int = DIGITS) -> int:
    """Texts (id, text) with their index and their tags by a dictionary."""
    begin(store, texts.select("id", F.lower("text").alias("text")), digits=digits)
    return store.commit(keyed={"tags": (["news_id", "entity_id"], matching.mentions(store.read("texts").withColumnRenamed("id", "news_id"), entities))}, digits=digits)


def retag(store: Store, before: DataFrame, after: DataFrame) -> int:
    """Brings the tags of a store from one dictionary to another; returns how many texts were read for it.

    A tag can change only where the text holds an alias that its entity gains or loses. Those texts are found by the
    index, matched anew for the changed entities alone, and only tags that differ are written. The outcome is
    that of matching all texts by the new dictionary."""
    named = lambda e: matching.entity_names(e).where("alias is not null").select("entity_id", F.lower("alias").alias("needle")).where("needle <> ''").distinct()
    old, new = named(before), named(after)
    changed = old.exceptAll(new).union(new.exceptAll(old)).checkpoint()
    reached = candidates(store, changed).join(changed, "needle").select(F.col("id").alias("news_id"), "entity_id").distinct().checkpoint()
    ids = reached.select(F.col("news_id").alias("id")).distinct().checkpoint()
    texts = store.read("texts", among=ids).join(ids, "id", "left_semi").withColumnRenamed("id", "news_id")
    entities = after.join(changed.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    on = ["news_id", "entity_id"]
    now = matching.mentions(texts, entities).join(reached, on, "left_semi").checkpoint()
    had = store.read("tags", among=reached).join(reached, on, "left_semi").checkpoint()
    store.commit({"tags": (on, now.join(had, on, "left_anti"))}, delete={"tags": (on, had.join(now, on, "left_anti"))})
    return ids.count()
