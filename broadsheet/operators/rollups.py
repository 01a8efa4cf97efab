"""Counts that are kept up to date by what changed: signed deltas between two versions of a store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Key, Store

#: Rows that each count as one, from the tables by name.
Contributions = Callable[[dict[str, DataFrame]], DataFrame]


def _first(key: Key) -> str:
    return key if isinstance(key, str) else key[0]


def deltas(store: Store, tables: dict[str, Key], rows: Contributions, dims: list[str], old: int | None, new: int) -> DataFrame:
    """(dims, delta): what the counts gain and lose from one version to another; ``old`` None: all of ``new``.

    ``tables``: keyed tables and their keys, the first column of which is the same thing in all, such as the article.
    Only that of changed rows can count otherwise: its rows of the old version count minus one, those of the
    new one plus one. So inserts, deletions, re-tagging and verification are all one case, and only the buckets of
    what changed are read."""
    if old is None:
        counted = rows({name: store.keys(store.read(name, key, version=new), store.rows(name, new)) for name, key in tables.items()})
        return counted.groupBy(*dims).agg(F.count(F.lit(1)).alias("delta"))
    changed = [store.changes(name, key, old, new).select(F.col(_first(key)).alias("_id")) for name, key in tables.items()]
    ids = reduce(DataFrame.union, changed).distinct().checkpoint()
    n, sides = ids.count(), []
    for version, sign in ((old, -1), (new, 1)):
        frames = {}
        for name, key in tables.items():
            own = ids.withColumnRenamed("_id", _first(key))
            frames[name] = store.keys(store.read(name, key, own, version).join(store.keys(own, n), _first(key), "left_semi"), n)
        sides.append(rows(frames).groupBy(*dims).agg((sign * F.count(F.lit(1))).alias("_n")))
    return sides[0].union(sides[1]).groupBy(*dims).agg(F.sum("_n").alias("delta")).where("delta <> 0")


def refresh(store: Store, rollup: str, tables: dict[str, Key], rows: Contributions, dims: list[str]) -> int:
    """Brings a stored rollup (dims, count) up to the store's last version, and returns the number of its own commit. The
    version it was counted at is committed with it, so a second refresh of the same state changes nothing."""
    last, seen = store.versions()[-1], store.mark(rollup)
    found = deltas(store, tables, rows, dims, seen, last).checkpoint()
    if seen is None:
        return store.commit(keyed={rollup: (dims, found.withColumnRenamed("delta", "count"))}, marks={rollup: last}, digits=1)
    now = found.join(store.keys(store.read(rollup, among=found), store.rows(rollup)), dims, "left").select(*dims, (F.coalesce("count", F.lit(0)) + F.col("delta")).alias("count"))
    return store.commit({rollup: (dims, now.where("count <> 0"))}, delete={rollup: (dims, now.where("count = 0"))}, marks={rollup: last})
