"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some of a window's tokens and ignore the others, so a changed token under an
ignored place doesn't hide a match. Hashes of the benchmark's windows are joined with those of the
documents; around each hit the two texts are laid side by side and the overlap is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Ones are compared, zeros ignored. Each mask looks at six tokens. Every accepted pattern of changes in a
#: window of 8 to 13 tokens leaves some mask a hit; a test enumerates them.
MASKS = ("1111011", "1110111", "11011011", "101110101", "111000111", "111111", "1011111")
#: An overlap is this many tokens, at least this share of them equal; items of fewer than LEAST
#: tokens match as a whole and exactly, if the caller takes them.
OVERLAP, SHARE, LEAST = 13, 0.8, 8
#: Bytes of benchmark text in one broadcast index, and of document text scanned at once, and hits
#: that are laid out at once.
BLOCK_BYTES, CHUNK_BYTES, HITS = 8 << 20, 2 << 20, 1 << 19

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it loses nothing


def tokens(text: str) -> list[bytes]:
    """Words lower-cased in ASCII, ASCII punctuation taken as white space."""
    return text.encode().lower().translate(_PUNCTUATION).split()


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows without an unknown token (0) in a compared place, and their hashes."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids > 0
    whole = np.ones(n, bool)
    for i in _places(mask):
        whole &= known[i : i + n]
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in _places(mask):
            h = (h ^ (h >> np.uint64(29))) * _FACTOR + ids[at + i].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return at, h


class SeedIndex:
    """The spaced seeds of some benchmark items, and what verifies their hits."""

    def __init__(self, item_ids: list[int], texts: list[str], least: int = LEAST):
        lists = [(i, t) for i, t in ((i, tokens(t or "")) for i, t in zip(item_ids, texts)) if len(t) >= max(least, 1)]
        self.vocab: dict[bytes, int] = {}
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in t], np.int32) for _, t in lists]
        self.items = np.array([i for i, _ in lists], np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        self.ids = np.concatenate([np.empty(0, np.int32), *ids])
        self.tables = []
        short = sorted({len(x) for x in ids if len(x) < LEAST})
        for mask, whole in (*((m, False) for m in MASKS), *(("1" * n, True) for n in short)):  # a short item's seed is all of it
            parts = [(_seeds(x, mask), n) for n, x in enumerate(ids) if (len(x) == len(mask) if whole else len(x) >= LEAST)]
            h = np.concatenate([np.empty(0, np.uint64), *(p[1] for p, _ in parts)])
            at = np.concatenate([np.empty(0, np.int64), *(p[0] for p, _ in parts)])
            item = np.concatenate([np.empty(0, np.int64), *(np.full(len(p[0]), n) for p, n in parts)])
            order = np.argsort(h, kind="stable")
            self.tables.append((mask, h[order], at[order], item[order]))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the items that overlap it: (item_id, tokens in the overlap, equal ones)."""
        get, parts = self.vocab.get, [tokens(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        ids = np.fromiter((get(w, 0) for p in parts for w in p), np.int32, starts[-1])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        whole: set[int] = set()  # pairs of document and item whose overlap is the whole item
        for pair, shift in self._diagonals(ids, starts, whole):
            doc, item = divmod(pair, len(self.items))
            got = self._overlap(ids, starts[doc], starts[doc + 1], item, shift)
            if got and got > best.get((doc, item), (0, 0)):
                best[doc, item] = got
                n = int(self.first[item + 1] - self.first[item])
                if got == (n, n):
                    whole.add(pair)
        for (doc, item), (length, equal) in sorted(best.items()):
            out[doc].append((int(self.items[item]), length, equal))
        return out

    def _diagonals(self, ids: np.ndarray, starts: np.ndarray, whole: set[int]) -> Iterator[tuple[int, int]]:
        """(document and item as one number, shift) of the seeds' hits, without those of ``whole``. HITS of
        them are laid out and 8 HITS remembered at a time, so that words that repeat take no room."""
        codes: dict[int, int] = {}
        seen = np.empty(0, np.int64)
        for mask, h, at, item in self.tables:
            pos, seed = _seeds(ids, mask)
            lo = np.searchsorted(h, seed)
            n = np.searchsorted(h, seed, "right") - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(starts, pos, "right") - 1
            inside = pos + len(mask) <= starts[doc + 1]
            pos, lo, n, doc = pos[inside], lo[inside], n[inside], doc[inside]
            ends, k = np.concatenate(([0], np.cumsum(n))), 0
            while k < len(n):
                upto = max(k + 1, int(np.searchsorted(ends, ends[k] + HITS, "right")) - 1)
                m = n[k:upto]
                entry = np.repeat(lo[k:upto], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                pair = np.repeat(doc[k:upto], m) * len(self.items) + item[entry]
                shift = np.repeat(pos[k:upto], m) - at[entry]
                k = upto
                if whole:
                    open_ = ~np.isin(pair, np.fromiter(whole, np.int64, len(whole)))
                    pair, shift = pair[open_], shift[open_]
                pairs, which = np.unique(pair, return_inverse=True)
                code = np.array([codes.setdefault(p, len(codes)) for p in pairs.tolist()], np.int64)
                each, first = np.unique((code[which] << 32) + shift + (1 << 31), return_index=True)
                new = ~np.isin(each, seen, assume_unique=True)
                seen = np.concatenate((seen, each[new])) if len(seen) < 8 * HITS else each
                yield from ((p, s) for p, s in zip(pair[first[new]].tolist(), shift[first[new]].tolist()) if p not in whole)

    def _overlap(self, ids: np.ndarray, start: int, end: int, item: int, shift: int) -> tuple[int, int] | None:
        """The union of the windows on a diagonal in which enough tokens agree."""
        own = self.ids[self.first[item] : self.first[item + 1]]
        lo, hi = max(start, shift), min(end, shift + len(own))
        window = min(OVERLAP, len(own))
        share = SHARE if len(own) >= LEAST else 1
        if hi - lo < window:
            return None
        same = ids[lo:hi] == own[lo - shift : hi - shift]
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[window:] - total[:-window] >= share * window)
        if not len(good):
            return None
        inside = np.zeros(hi - lo + 1, np.int64)
        np.add.at(inside, good, 1)
        np.add.at(inside, good + window, -1)
        inside = np.cumsum(inside)[:-1] > 0
        return int(inside.sum()), int((inside & same).sum())


def seed_indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", least: int = LEAST) -> tuple[int, Iterator[SeedIndex]]:
    """How many indexes the benchmark takes, each over about BLOCK_BYTES of text, and one after the other.
    Null texts and ids match nothing; repeated rows count once."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)

    def index(n: int) -> SeedIndex:
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).orderBy("i", "t").toPandas()
        return SeedIndex(part.i.tolist(), part.t.tolist(), least)

    return blocks, map(index, range(blocks))


_KIND = "array<struct<item_id: long, overlap: int, equal: int>>"


def _scanner(index, text: Column) -> Column:
    """The leaks that a broadcast index finds."""

    @F.pandas_udf(_KIND)
    def scan(texts: pd.Series) -> pd.Series:
        out: list[list[tuple[int, int, int]]] = []
        chunk, size = [], 0
        for t in texts:
            chunk.append(t)
            size += len(t)
            if size > CHUNK_BYTES:
                out += index.value.scan(chunk)
                chunk, size = [], 0
        out += index.value.scan(chunk)
        return pd.Series([[{"item_id": i, "overlap": n, "equal": e} for i, n, e in x] for x in out])

    return scan(F.coalesce(text, F.lit("")))


def with_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST, out: str = "leaks") -> DataFrame:
    """``df`` with column ``out``, array<struct<item_id, overlap, equal>>: the benchmark items of which a
    row's text holds an overlap, by item; a column of that name is replaced.

    All of the text is scanned against all items. A benchmark of one block is broadcast, and nothing is
    shuffled. A larger one is taken block by block, so that driver and executors hold one at a time;
    what a block finds is written, by the text's digest, and joined to the rows in the end.
    Items of fewer than ``least`` tokens are left out. A null or empty text, or an empty
    benchmark, gives none; repeated rows get equal results; an empty table stays empty.
    """
    context = df.sparkSession.sparkContext
    blocks, indexes = seed_indexes(benchmark, least=least)
    if blocks < 2:
        return df.withColumn(out, F.array_sort(_scanner(context.broadcast(next(indexes)), df[text])) if blocks else F.array().cast(_KIND))
    digest = F.md5(F.coalesce(df[text], F.lit("")))
    found = None
    for index in indexes:
        shared = context.broadcast(index)
        part = written(df.select(digest.alias("digest"), _scanner(shared, df[text]).alias("leaks")).where(F.size("leaks") > 0).distinct())
        shared.destroy()
        found = part if found is None else found.union(part)
    mark = fresh(df, "_digest")
    by_text = found.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("_leaks")).select(F.col("digest").alias(mark), "_leaks")
    return df.drop(out).join(by_text, digest == F.col(mark), "left").withColumn(out, F.coalesce("_leaks", F.array().cast(_KIND))).drop(mark, "_leaks")


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` without an overlap with the benchmark, all columns as they are."""
    out = fresh(df, "_leaks_found")
    return with_leaks(df, benchmark, text, least, out).where(F.size(out) == 0).drop(out)
