"""Exact substring dedup by suffix arrays that are sorted in two stages.

A byte goes if a ``SPAN``-byte string over it also starts in a document with a smaller id. Strings
can't be shipped one by one, so each is known by its minimizer: the least hash among its
``GRAM``-byte grams, which equal strings share. Grams that minimize strings of one document only are
let go; for the others, the stretches of text whose strings they minimize meet by gram. There a
suffix array of the stretches is built in two stages (Itoh and Tanaka, 1999): suffixes smaller than
their successors are sorted directly, the rest are induced by a scan of the buckets, and adjacent
common prefixes of at least ``SPAN`` bytes show the equal strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked

SPAN, GRAM = 50, 20
#: Bytes of text that are hashed, and of stretches that are sorted, at once.
CHUNK, BATCH = 1 << 20, 4 << 20
#: A gram that more rows than this share sends each string by itself, to meet by the string, so
#: that however many rows meet, the distinct strings among them stay few.
CROWDED = 20_000
#: Bits of a gram's hash that are shipped: at 10^13 grams a few in a hundred look shared by chance, which
#: costs a comparison and no more.
SHIPPED_BITS = 48
#: Texts whose grams are looked up together.
TEXTS = 8192
_NONE = np.empty(0, np.int64)
_PAD = b"\0" * 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(buf: bytes | np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of n places, as a number; the buffer is longer by 8 at least."""
    return np.ndarray((n,), "<u8", buf, 0, (1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    return h ^ (h >> np.uint64(29))


def _gram_hashes(buf: bytes, n: int) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes (8 at least) from each of n places, taken 8 bytes at a time; the
    last 8 may overlap those before."""
    w, h = _words(buf, n + GRAM - 8), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in (*range(0, GRAM - 8, 8), GRAM - 8):
            h = _mix((h ^ w[at : at + n]) * _B)
        return h * _A


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each stretch of strings with one minimizer: (text, first start, last start, gram's place, gram's hash),
    as arrays. Texts are hashed many at a time; long ones in pieces that overlap by SPAN - 1."""
    pieces = [(i, at, t[at : at + CHUNK // 2]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - SPAN + 1), CHUNK // 2 - SPAN + 1) if len(t) >= SPAN]
    k = 0
    while k < len(pieces):
        size, first = 0, k
        while k < len(pieces) and (k == first or size + len(pieces[k][2]) <= CHUNK - len(_PAD)):
            size += len(pieces[k][2])
            k += 1
        part = pieces[first:k]
        buf = b"".join(p for _, _, p in part) + _PAD
        ends = np.cumsum([len(p) for _, _, p in part])
        n = size - GRAM + 1
        h = _gram_hashes(buf, n)
        # The hash's upper bits and the place: the least is the leftmost of the least hashes.
        key = (h & ~np.uint64(CHUNK - 1)) | np.arange(n, dtype=np.uint64)
        wide, width = key, 1
        while width * 2 <= SPAN - GRAM + 1:
            wide, width = np.minimum(wide[:-width], wide[width:]), width * 2
        rest = SPAN - GRAM + 1 - width
        least = np.minimum(wide[: len(wide) - rest], wide[rest:]) if rest else wide
        gram = (least & np.uint64(CHUNK - 1)).astype(np.int64)
        start = np.arange(len(gram))
        piece = np.searchsorted(ends, start, "right")
        inside = start + SPAN <= ends[piece]
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | ~inside[:-1])) & inside
        last = np.concatenate((new[1:], [True])) | ~np.concatenate((inside[1:], [False]))
        a, b = np.flatnonzero(new), np.flatnonzero(inside & last)
        of = piece[a]
        shift = np.array([at for _, at, _ in part])[of] - (ends - [len(p) for _, _, p in part])[of]
        yield np.array([i for i, _, _ in part])[of], a + shift, b + shift, gram[a] + shift, (h[gram[a]] >> np.uint64(64 - SHIPPED_BITS)).view(np.int64)


def two_stage_order(t: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted places of t in order of their suffixes, told apart by SPAN bytes at least.

    t: bytes, followed by 64 zero bytes that aren't counted; a suffix that runs into them ends there."""
    n = len(t) - len(_PAD)
    places = np.arange(n + 1)
    change = np.concatenate((t[: n] != t[1 : n + 1], [True]))
    change[n - 1] = True
    turn = np.minimum.accumulate(np.where(change, places, n)[::-1])[::-1] + 1  # the next other byte
    turn = np.minimum(turn, n)
    smaller = np.concatenate((t[:n] < t[turn[:n]], [True]))  # than its successor; the end is the least
    smaller[:n] &= turn[:n] < n
    need = np.zeros(n + 1, bool)  # the wanted, and what they are induced from
    front = wanted
    while len(front):
        need[front] = True
        front = turn[front[~smaller[front]]]
        front = np.unique(front[~need[front]])
    need[n] = False
    direct = np.flatnonzero(need[:n] & smaller[:n])
    view = np.ndarray((n,), f"S{len(_PAD) - 8}", t.tobytes(), 0, (1,))[direct]
    by = np.argsort(view)
    direct, view = direct[by], view[by]
    new = np.concatenate(([False], view[1:] != view[:-1]))
    rank = np.zeros(n + 1, np.int64)
    induced = np.flatnonzero(need[:n] & ~smaller[:n])
    induced = induced[np.argsort(t[induced], kind="stable")]
    classes = np.cumsum(new)
    order, used = [], 1
    first_direct = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    first_induced = np.searchsorted(t[induced], np.arange(257)) if len(induced) else np.zeros(257, np.int64)
    for c in range(256):  # the buckets: what is larger than its successor stands first
        own = induced[first_induced[c] : first_induced[c + 1]]
        if len(own):
            run, then = turn[own] - own, rank[turn[own]]
            by = np.lexsort((then, run))
            own, run, then = own[by], run[by], then[by]
            step = np.concatenate(([0], (run[1:] != run[:-1]) | (then[1:] != then[:-1])))
            rank[own] = used + np.cumsum(step)
            used = rank[own[-1]] + 1
            order.append(own)
        lo, hi = first_direct[c], first_direct[c + 1]
        if lo < hi:
            rank[direct[lo:hi]] = used + classes[lo:hi] - classes[lo]
            used = rank[direct[hi - 1]] + 1
            order.append(direct[lo:hi])
    out = np.concatenate(order) if order else np.empty(0, np.int64)
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return out[keep[out]]


def adjacent_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bytes, up to 56, that each place's suffix shares with that before it in the order."""
    w = _words(t.tobytes(), len(t) - 8)
    shared, live = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(0, len(_PAD) - 8, 8):
        x = w[np.minimum(order[live] + k, len(w) - 1)] ^ w[np.minimum(order[live - 1] + k, len(w) - 1)]
        low = x & (~x + np.uint64(1))
        shared[live] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        live = live[x == 0]
    return shared


def least_docs(parts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[], list[tuple[int, bytes]]]]:
    """parts: distinct stretches, of documents ``docs`` at least. -> where the strings of each part begin in
    a list of all, the least document of each of these strings, and what tells (document, string) once each."""
    strings = np.array([len(p) - SPAN + 1 for p in parts], np.int64)
    t = np.frombuffer(b"\xff".join(parts) + _PAD, np.uint8)
    first = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    begin = np.cumsum(strings) - strings
    part = np.repeat(np.arange(len(parts)), strings)
    wanted = first[part] + np.arange(len(part)) - begin[part]
    of = np.zeros(len(t), np.int64)
    of[wanted] = np.arange(len(wanted))
    order = two_stage_order(t, wanted)
    cut = np.flatnonzero(adjacent_prefixes(t, order) < SPAN)
    string = of[order]
    least = np.minimum.reduceat(docs[part[string]], cut)
    out = np.empty(len(wanted), np.int64)
    out[string] = np.repeat(least, np.diff(np.concatenate((cut, [len(order)]))))
    return begin, out, lambda: [(int(d), t[p : p + SPAN].tobytes()) for d, p in zip(least, order[cut])]


#: What stretches meet by: their gram, or, for a crowded gram (place -1), the one string itself.
_MEET = f"case when place < 0 then part else substring(part, place + 1, {GRAM}) end"


def _sort_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc, row, start, more, place, part) come sorted by what they meet by and doc; whole runs are
    sorted together, equal stretches as one. A run that doesn't fit is taken in pieces, each with the
    strings of those before it."""
    held: list[pd.DataFrame] = []
    size, carry_key, carry = 0, None, []

    def sort(pdf: pd.DataFrame, whole: bool) -> pd.DataFrame:
        nonlocal carry_key, carry
        early = carry if carry_key is not None and pdf.key.iloc[0] == carry_key else []
        codes, parts = pd.factorize(np.array([s for _, s in early] + pdf.part.tolist(), object))
        docs = np.concatenate((np.array([d for d, _ in early], np.int64), pdf.doc.to_numpy(np.int64)))
        first_doc = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(first_doc, codes, docs)
        begin, least, firsts = least_docs(parts.tolist(), first_doc)
        carry_key, carry = (None, []) if whole else (pdf.key.iloc[-1], firsts())
        codes, docs, start = codes[len(early) :], docs[len(early) :], pdf.start.to_numpy(np.int64)
        # A stretch stands at each of its places in the text.
        again = [np.frombuffer(m, np.int64) if m else _NONE for m in pdf.more]
        places = np.array([len(m) for m in again]) + 1
        at = np.repeat(start, places)
        at[np.arange(len(at)) != np.repeat(np.cumsum(places) - places, places)] = np.concatenate([_NONE, *(m for m in again if len(m))])
        each = np.repeat(np.arange(len(pdf)), places)
        n = np.diff(np.concatenate((begin, [len(least)])))[codes[each]]
        which = np.repeat(np.arange(len(each)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        gone = least[begin[codes[each[which]]] + offset] < docs[each[which]]
        which, at = which[gone], at[which[gone]] + offset[gone]
        new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else _NONE
        end = np.concatenate((new[1:], [len(at)]))[: len(new)] - 1
        return pd.DataFrame({"row": pdf.row.to_numpy()[each[which[new]]], "lo": at[new], "hi": at[end] + SPAN})

    for pdf in frames:
        held.append(pdf.assign(key=[p if o < 0 else p[o : o + GRAM] for p, o in zip(pdf.part, pdf.place)]))
        size += int(pdf.part.str.len().sum())
        if size < BATCH:
            continue
        both = pd.concat(held, ignore_index=True)
        last = (both.key == both.key.iloc[-1]).to_numpy()
        if last.all():
            yield sort(both, False)  # one run, and it may go on
            held, size = [], 0
        else:
            yield sort(both[~last], True)
            held = [both[last]]
            size = int(held[0].part.str.len().sum())
    if held and sum(map(len, held)):
        yield sort(pd.concat(held, ignore_index=True), True)


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for each row; ``kept``: the remaining bytes.

    Strings are judged on the input, over all documents. A null text is empty; texts under SPAN bytes
    stay; a null key counts as the largest; rows of one key don't remove each other's bytes; an empty
    table gives none; other columns are ignored. Exact copies of a text meet first by digest: all but
    the least key's lose everything and take no further part, which changes no other row's result.
    """
    raw = F.encode(F.coalesce(df[text], F.lit("")), "UTF-8")
    doc = F.coalesce(df[key].cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(df[key].cast("string").alias("key"), doc.alias("doc"), raw.alias("raw")).withColumn("digest", F.unhex(F.md5("raw")))
    rows = rows.withColumn("row", F.xxhash64("doc", "digest"))

    slim = rows.select("row", "doc", "digest")
    groups = slim.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    copies = slim.join(groups, "digest").where("doc > least").select("row").distinct()
    # The texts are shuffled once, packed: all three steps that read them ask for these very columns.
    body = rows.select("key", "row", "doc", packed(F.col("raw")).alias("body"))
    own = body.join(copies, "row", "left_anti").select(*body.columns)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            row = pdf.row.to_numpy()
            for i, _, _, _, h in stretches(unpacked(pdf.body)):
                by = np.lexsort((h, i))  # a text that repeats itself names each gram once in a while
                i, h = i[by], h[by]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]))) if len(i) else np.empty(0, bool)
                yield pd.DataFrame({"h": h[new], "row": row[i[new]]})

    found = own.mapInPandas(grams, "h long, row long")
    same_gram = Window.partitionBy("h")
    spread = found.withColumn("low", F.min("row").over(same_gram)).withColumn("high", F.max("row").over(same_gram)).withColumn("n", F.count(F.lit(1)).over(same_gram))
    shared = spread.where("low < high").groupBy("row").agg(F.collect_list(F.col("h") * 2 + (F.col("n") > CROWDED).cast("long")).alias("grams"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in frames for _, part in whole.groupby(np.arange(len(whole)) // TEXTS)):
            bodies, row, doc = unpacked(pdf.body), pdf.row.to_numpy(), pdf.doc.to_numpy()
            # A text's place in the batch, a gram's hash and whether it is crowded, in one number each.
            marked = np.unique(np.concatenate([np.empty(0, np.int64), *(np.asarray(g, np.int64) + (k << SHIPPED_BITS + 1) for k, g in enumerate(pdf.grams))]))
            marked, hot = marked >> 1, marked & 1 == 1
            for i, lo, hi, place, h in stretches(bodies):
                mine = (i << SHIPPED_BITS) + h
                at = np.minimum(np.searchsorted(marked, mine), len(marked) - 1)
                met = np.flatnonzero(marked[at] == mine) if len(marked) else []
                out: dict[tuple[int, bytes], list[int]] = {}  # a text that repeats itself tells a stretch once
                for k, crowded in zip(met, hot[at[met]] if len(marked) else []):
                    a, b, body = int(lo[k]), int(hi[k]), bodies[i[k]]
                    for a, b in ((q, q) for q in range(a, b + 1)) if crowded else ((a, b),):
                        part = body[a : b + SPAN]
                        told = out.get((i[k], part))
                        if told:
                            told.append(a)
                        else:
                            out[i[k], part] = [-1 if crowded else int(place[k]) - a, a]
                if out:
                    which = np.array([i for i, _ in out])
                    at_gram, starts, more = zip(*((x[0], x[1], np.array(x[2:], np.int64).tobytes() if len(x) > 2 else None) for x in out.values()))
                    yield pd.DataFrame({"doc": doc[which], "row": row[which], "start": np.array(starts, np.int64), "more": pd.Series(more, dtype=object), "place": np.array(at_gram, np.int32), "part": [p for _, p in out]})

    parts = own.join(shared, "row").mapInPandas(cut, "doc long, row long, start long, more binary, place int, part binary")
    gone = parts.repartition(F.expr(_MEET)).sortWithinPartitions(F.expr(_MEET), "doc").mapInPandas(_sort_batches, "row long, lo long, hi long")
    spans = gone.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select("row", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    marks = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("row", F.lit(None).cast("array<bigint>").alias("lo"), F.lit(None).cast("array<bigint>").alias("hi"), F.lit(True).alias("copy")))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [_kept(*x) for x in zip(unpacked(pdf.body), pdf.lo, pdf.hi, pdf["copy"])]
            yield pd.concat([pdf[["key"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])], axis=1)

    kept = body.join(marks, "row", "left").mapInPandas(keep, "key string, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.select(F.col("key").cast(df.schema[key].dataType).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def _kept(body: bytes, lo, hi, copy) -> tuple[int, int, int, bytes]:
    n = len(body)
    if copy is True and n >= SPAN:
        return n, n, 1, b""
    if lo is None or isinstance(lo, float) or not len(lo):
        return n, 0, 0, body
    lo, hi = np.sort(lo), np.sort(hi)
    reach = np.maximum.accumulate(hi)
    first = np.concatenate(([True], lo[1:] > reach[:-1]))
    a, b = lo[first], reach[np.concatenate((first[1:], [True]))]
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(body[at:x])
        at = y
    kept.append(body[at:])
    return n, int((b - a).sum()), len(a), b"".join(kept)
