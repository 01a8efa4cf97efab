"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints within ``max_bits`` differing bits are linked. Of ``max_bits + m`` blocks of bits m
agree in any such pair, so fingerprints meet under each choice of m blocks (m is two, and more only
for so many fingerprints that the groups would grow); there a binary trie over the sorted
fingerprints is joined with itself: pairs of nodes go down together, add up the bits in which they
differ, and end when the error budget is spent or only a few leaves are left to compare. Groups above ``GROUP`` fingerprints are
dealt out as pairs of slices, each a join of its own, so that no task gets an unbounded group. A
join returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, packed, tidy, unpacked, written
from .graph import components

#: Fingerprints that one trie holds at most, node pairs that are expanded at once, and pairs of
#: leaves below a node pair that are compared without going further down.
GROUP, PAIRS, LEAVES = 4096, 1 << 18, 16
#: Mean fingerprints under one choice of blocks up to which m stays as it is.
CROWDED = 64
#: One of how many sets is looked at for common shingles, how many of these are told to all tasks, and
#: the expected sets from which on a shingle isn't gathered in one window.
SAMPLE, COMMON, HOT = 16, 1 << 18, 20_000
#: Sets under a shingle above which they meet by size; the ratio of the sizes of one band.
BANDED, BAND = 64, 1.05
#: Shingles of the sets that a task remembers while it compares.
HELD = 1 << 22
#: Rows of two numbers up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST = 1 << 20


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of a text's ``words``-word shingles, repeats included; a shorter text is one shingle."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[n - 1 :].tolist())), np.uint64, len(tokens) - n + 1)


def simhash(text: str, words: int) -> int:
    """The signed 64-bit fingerprint of a text's ``words``-word shingles, repeats included."""
    return _print_of(shingles(text, words))


def _print_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Null texts count as empty; a text without words has fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")))


def trie_links(v: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints. v: unsigned and sorted within each root. left, right: first
    and end of each root's rows; a pair of equal roots is a self-join. All roots go down at once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, *(np.asarray(x, np.int32) for x in (*left, *right)), np.zeros(len(left[0]), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a, a_end, b, b_end, bits = stack.pop()
        if not len(a):
            continue
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, a_end, b, b_end, bits))), (depth, *(x[:half] for x in (a, a_end, b, b_end, bits)))]
            continue
        few = (a_end - a).astype(np.int64) * (b_end - b) <= LEAVES if depth < 64 else np.ones(len(a), bool)
        if few.any():
            found.append(_leaf_links(v, *(x[few] for x in (a, a_end, b, b_end)), budget))
            a, a_end, b, b_end, bits = (x[~few] for x in (a, a_end, b, b_end, bits))
            if not len(a):
                continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)))
        c = ones[depth]
        a_mid, b_mid = a_end - (c[a_end] - c[a]), b_end - (c[b_end] - c[b])
        own = a == b
        kids = [(a, a_mid, b, b_mid, bits), (a_mid, a_end, b_mid, b_end, bits), (a, a_mid, b_mid, b_end, bits + 1)]
        other = ~own
        kids.append(tuple(x[other] for x in (a_mid, a_end, b, b_mid, bits + 1)))
        merged = [np.concatenate(x).astype(x[0].dtype) for x in zip(*kids)]
        a, a_end, b, b_end, bits = merged
        live = (a < a_end) & (b < b_end) & (bits <= budget) & ((a != b) | (a_end - a > 1))
        stack.append((depth + 1, *(x[live] for x in merged)))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _leaf_links(v: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of leaves below small node pairs."""
    wide = (b_end - b).astype(np.int64)
    n = (a_end - a) * wide
    pair = np.repeat(np.arange(len(a)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = a[pair] + nth // wide[pair], b[pair] + nth % wide[pair]
    near = (np.bitwise_count(v[i] ^ v[j]) <= budget) & ((i < j) | (a[pair] != b[pair]))
    return i[near], j[near]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _join_tasks(frames: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Rows (task, fp) come sorted by task, side and unsigned fp; whole tasks are joined, some at a time."""
    rest = None
    for pdf in frames:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        whole = rest.task.to_numpy() != rest.task.iloc[-1] if len(rest) else np.empty(0, bool)
        if whole.any():
            yield _forest(rest[whole], budget)
            rest = rest[~whole]
    if rest is not None and len(rest):
        yield _forest(rest, budget)


def _forest(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    task, side = pdf.task.to_numpy(), pdf.side.to_numpy()
    v = pdf.fp.to_numpy().view(np.uint64)
    cut = np.flatnonzero((task[1:] != task[:-1]) | (side[1:] != side[:-1])) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(v)]))
    second = np.concatenate(([False], task[lo[1:]] == task[lo[:-1]]))  # the other side of the run before
    crossed = np.concatenate((second[1:], [False]))
    alone = ~second & ~crossed & (side[lo] == 0)
    a = np.concatenate((lo[alone], lo[crossed])), np.concatenate((hi[alone], hi[crossed]))
    b = np.concatenate((lo[alone], lo[second])), np.concatenate((hi[alone], hi[second]))
    i, j = trie_links(v, a, b, budget)
    label = least_labels(len(v), i, j)
    linked = np.flatnonzero(label != np.arange(len(v)))
    fp = pdf.fp.to_numpy()
    return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})


def _dealt(met: DataFrame, size: str, item: str, columns: list[str]) -> DataFrame:
    """Deals groups (key) of ``size`` rows to tasks, those above GROUP as pairs of slices: (task, side,
    columns). Side 0 is to be joined with itself, side 1 with side 2 of its task."""
    met = met.withColumn("slices", F.ceil(F.col(size) / GROUP).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(item), F.col("slices")).cast("int"))
    # the pairs of slices that hold this one; in a pair of two, the lower slice is side 0
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (k < F.col("own")).cast("int").alias("side")),
    )
    dealt = met.select("key", *columns, F.explode(pairs).alias("p"))
    return dealt.select(F.xxhash64("key", "p.i", "p.j").alias("task"), F.when(F.col("p.i") == F.col("p.j"), 0).otherwise(F.col("p.side") + 1).alias("side"), *columns)


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp long) -> a spanning set (a, b) of the links between them."""
    with tidy(prints.sparkSession):
        count, m = prints.count(), 2
    while m < 5 and count / 2 ** (64 * m // (max_bits + m)) > CROWDED:
        m += 1
    blocks = max_bits + m
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), m))
    # One expression for every choice: the places of its blocks are looked up in two short lists.
    low, wide = (F.lit([f(i) for chosen in choices for i in chosen]) for f in (lambda i: cuts[i], lambda i: cuts[i + 1] - cuts[i]))
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1))).alias("n"))
    rows = rows.select("fp", F.col("n").cast("long").alias("key"), *(f(F.col("n") * m + k + 1).alias(f"{name}{k}") for k in range(m) for name, f in (("low", lambda i: F.element_at(low, i)), ("wide", lambda i: F.element_at(wide, i)))))
    for k in range(m):
        rows = rows.withColumn("key", F.expr(f"shiftleft(key, wide{k}) | (shiftrightunsigned(fp, low{k}) & (shiftleft(1L, wide{k}) - 1))"))
    rows = rows.select("fp", "key")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = _dealt(rows.join(sizes, "key"), "n", "fp", ["fp"])
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = dealt.repartition("task").sortWithinPartitions("task", "side", unsigned)
    return dealt.mapInPandas(lambda frames: _join_tasks(frames, max_bits), "a long, b long").distinct()


def near_duplicates(df: DataFrame, words: int = 4, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row: ``component_id`` is the least key that the row reaches by
    links between fingerprints, itself included.

    Equal fingerprints are one node, so exact copies and texts without words (fingerprint zero) cost
    nothing more; null texts count as empty; a null key never is a component's id unless all are null;
    repeated rows each return; an empty table gives none; other columns are ignored.
    """
    rows = durable(df.select(F.col(key), fingerprint(F.col(text), words).alias("fp")))
    node = F.struct(F.min(key).isNull().alias("none"), F.min(key).alias("least"), F.col("fp"))
    prints = durable(rows.groupBy("fp").agg(node.alias("node")))
    ends = links(prints.select("fp"), max_bits)
    for end in "ab":  # a node is named by its least key first, so a component's least node bears its id
        named = prints.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}"))
        ends = ends.join(named, end)
    classes = components(ends.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).select("node.fp", F.col("component.least").alias("component_id"))
    named = prints.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "node.least").alias("component_id"))
    return rows.join(named, "fp").select(key, "fp", "component_id")


def _set_of(text: str, words: int) -> np.ndarray:
    """The set of a text's shingles, in order of their hashes."""
    return np.unique(shingles(text, words)).view(np.int64)


def _parity(s: np.ndarray) -> bytes:
    """A set's parity bits, between two and four for each element: as many bits of two sets differ as
    their difference has elements, or fewer. Halves laid over each other give the bits of half the size."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def _may_be_alike(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Whether parity bits leave a Jaccard of 4/5 possible: a difference of a ninth of both sizes."""
    x, y = (np.frombuffer(z, np.uint64) for z in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n_a + n_b


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """(k, digest, text) -> (k, digest, fp, sig, n, bits, z): the fingerprint, a hash of the set of shingles
    (null if there are none), their number, the set's parity bits and the packed text."""

    @F.pandas_udf("fp long, sig long, n int, bits binary")
    def of(part: pd.Series) -> pd.DataFrame:
        hashes = [shingles(t, words) for t in part]
        sets = [np.unique(h).view(np.int64) for h in hashes]
        sig = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
        return pd.DataFrame({"fp": np.array([_print_of(h) for h in hashes], np.int64), "sig": pd.Series(sig, dtype="Int64"), "n": np.array([len(s) for s in sets], np.int32), "bits": [_parity(s) for s in sets]})

    return texts.select("k", "digest", of(F.col("text")).alias("x"), packed(F.encode("text", "UTF-8")).alias("z")).select("k", "digest", "x.*", "z")


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, by rising count in a sample of the sets, and how many sets hold them presumably. This
    only shapes the order in which shingles are taken, and any one order finds all pairs."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for z in pdf.z:
                yield pd.DataFrame({"x": _set_of(unpacked([z])[0].decode(), words)})

    sample = rows.where(F.pmod("sig", F.lit(SAMPLE)) == 0).dropDuplicates(["sig"]).select("z").mapInPandas(sets, "x long")
    with tidy(rows.sparkSession):
        found = sample.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "x").limit(COMMON).toPandas()[::-1]
    return found.x.to_numpy(np.int64), found.n.to_numpy(np.int64) * SAMPLE


def _postings(rows: DataFrame, words: int) -> DataFrame:
    """(key, sig, at, hot): the rarest shingles of each set. Two sets of a Jaccard of 4/5 share one of the
    first n - ceil(4n / 5) + 1 of either in any order common to all. ``at`` holds the set's size and the
    shingle's place; hot: too common to be gathered by one window. A task names a set once."""
    common, counts = _common(rows, words)
    order = np.argsort(common)
    shared = rows.sparkSession.sparkContext.broadcast((common[order], order, counts))

    def first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, ranks, times = shared.value
        rank = np.full(len(x), -1)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            rank = np.where(keys[at] == x, ranks[at], -1)
        by = np.lexsort((x, rank))[: len(x) - (4 * len(x) + 4) // 5 + 1]
        return x[by], np.where(rank[by] < 0, False, times[rank[by]] > HOT) if len(keys) else np.zeros(len(by), bool)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named: set[int] = set()
        for pdf in frames:
            out, size = [], 0
            for sig, z in zip(pdf.sig.tolist(), pdf.z):
                if sig in named:
                    continue
                named.add(sig)
                x = _set_of(unpacked([z])[0].decode(), words)
                key, hot = first(x)
                out.append(pd.DataFrame({"key": key, "sig": sig, "at": (len(x) << 32) + np.arange(len(key)), "hot": hot}))
                size += len(key)
                if size > PAIRS:
                    yield pd.concat(out)
                    out, size = [], 0
            if out:
                yield pd.concat(out)

    return rows.where("sig is not null").select("sig", "z").mapInPandas(post, "key long, sig long, at long, hot boolean")


def _contested(postings: DataFrame) -> DataFrame:
    """(key, sig, at) of the shingles that two sets hold at least, each once."""
    group = Window.partitionBy("key")
    cold = postings.where("not hot").select("key", "sig", "at", F.min("sig").over(group).alias("low"), F.max("sig").over(group).alias("high")).where("low < high")
    return cold.select("key", "sig", "at").union(postings.where("hot").select("key", "sig", "at")).distinct()


def _stars(members: DataFrame, by: str = "place") -> DataFrame:
    """(key, sig, at, class) -> pairs (a, b): under each key, one set with those of other classes and a like size. By
    ``place``: the set in which the key comes first. In an edited copy the shingles of its own edits, which nobody shares, come
    before; so this is the text that the others were made from, where it is there. By ``sig``: the last by hash."""
    n, place = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    rank = place if by == "place" else F.bitwise_not("sig")
    firsts = members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "sig", n.alias("n"), "class")).alias("head"))
    met = members.join(firsts, "key").where((F.col("class") != F.col("head.class")) & (5 * F.least(n, "head.n") >= 4 * F.greatest(n, "head.n")))
    return met.select(F.least("sig", "head.sig").alias("a"), F.greatest("sig", "head.sig").alias("b")).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """(key, sig, at, class) -> all pairs (a, b) of two classes that meet under a key and whose sizes and
    places leave a Jaccard of 4/5 possible. Under a frequent key, sets meet by what these leave."""
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "members")
    slim = members.select("key", "sig", "class", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")).join(open_keys, "key")
    left = _dealt(slim.where(F.col("members") <= BANDED), "members", "sig", ["sig", "n", "pos", "class"])
    right = left.withColumnsRenamed({c: f"{c}_" for c in left.columns if c != "task"})
    both = left.join(right, "task").where("class <> class_ and (side = 0 and side_ = 0 and sig < sig_ or side = 1 and side_ = 2)")
    both = both.where("5 * least(n, n_) >= 4 * greatest(n, n_) and 9 * least(n - pos, n_ - pos_) >= 4 * (n + n_)")
    pairs = both.select(F.least("sig", "sig_").alias("a"), F.greatest("sig", "sig_").alias("b"))
    return pairs.union(_by_size(slim.where(F.col("members") > BANDED))).distinct()


def _by_size(slim: DataFrame) -> DataFrame:
    """(key, sig, class, n, pos) of frequent keys -> their pairs (a, b).

    Of a pair, the larger set visits and the smaller is visited. What follows the shingle in a set of size n bounds the
    sizes of its partners: 9 (n - pos) >= 4 (n + partner). So a set is visited only if that leaves room for one of
    its own size, and visits only the bands of sizes between 4/5 of its own and the most that it leaves. Texts
    of one template, whose own shingles come before those they share, neither visit nor are visited, and no pair of
    them is formed. What may still meet in a band is dealt out by slices of both sides."""
    band = lambda n: F.floor(F.log(n) / math.log(BAND)).cast("int")
    slim = written(slim)
    homes = slim.where("9 * (n - pos) >= 8 * n").select("key", band(F.col("n")).alias("band"), "sig", "class", "n", "pos")
    most = F.least("n", F.floor((9 * (F.col("n") - F.col("pos")) - 4 * F.col("n")) / 4))
    least = F.ceil(4 * F.col("n") / 5)
    visits = slim.where(most >= least).select("key", F.explode(F.sequence(band(least), band(most))).alias("band"), "sig", "class", "n", "pos")
    sizes = homes.groupBy("key", "band").agg(F.count(F.lit(1)).alias("h")).join(visits.groupBy("key", "band").agg(F.count(F.lit(1)).alias("v")), ["key", "band"])
    sizes = written(sizes.select("key", "band", F.ceil(F.col("h") / GROUP).cast("int").alias("h"), F.ceil(F.col("v") / GROUP).cast("int").alias("v")))
    slice_of = lambda count: F.pmod(F.xxhash64("sig"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    on = ["key", "band", "i", "j"]
    left = visits.join(sizes, ["key", "band"]).withColumn("j", slice_of("v")).select("key", "band", every("h").alias("i"), "j", "sig", "class", "n", "pos")
    right = homes.join(sizes, ["key", "band"]).withColumn("i", slice_of("h")).select("key", "band", "i", every("v").alias("j"), "sig", "class", "n", "pos")
    right = right.withColumnsRenamed({c: f"{c}_" for c in ("sig", "class", "n", "pos")})
    both = left.join(right, on).where("class <> class_ and (n > n_ or n = n_ and sig < sig_) and 5 * n_ >= 4 * n and 9 * least(n - pos, n_ - pos_) >= 4 * (n + n_)")
    return both.select(F.least("sig", "sig_").alias("a"), F.greatest("sig", "sig_").alias("b"))


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    df = written(df)
    with tidy(df.sparkSession):
        return F.broadcast(df) if df.count() <= BROADCAST else df


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard is at least 4/5, as a written table. Parity bits rule most of
    the others out; of what they leave, the packed texts meet."""

    def may(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.loc[[_may_be_alike(*x) for x in zip(pdf.bits_a, pdf.bits_b, pdf.n_a, pdf.n_b)], ["a", "b"]]

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def of(sig: int, z: bytes) -> np.ndarray:
            nonlocal size
            if sig not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[sig] = _set_of(unpacked([z])[0].decode(), words)
                size += len(held[sig])
            return held[sig]

        for pdf in frames:
            near = []
            for a, b, za, zb in zip(pdf.a.tolist(), pdf.b.tolist(), pdf.za, pdf.zb):
                x, y = of(a, za), of(b, zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pdf.loc[near, ["a", "b"]]

    met = pairs
    for x in "ab":
        met = met.join(nodes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    left = written(met.mapInPandas(may, "a long, b long"))
    ends = _few(left.select(F.col("a").alias("sig")).union(left.select("b")).distinct().join(nodes, "sig").select("sig", "least.*"))
    bodies = written(rows.join(ends, ["sig", "k", "digest"]).select("sig", "z").dropDuplicates(["sig"]))
    a, b = (bodies.select(F.col("sig").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")
    return written(left.join(a, "a").join(b, "b").select("a", "b", "za", "zb").mapInPandas(check, "a long, b long"))


def similar_sets(rows: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(node, component) over the links of Jaccard 4/5 between sets of shingles; rows: as ``_sketches`` tells.

    The trie join's links come first, and with them, under each of the sets' rarest shingles, the first
    set with the others; then the last set with those of other classes. What holds is one class. At
    last all pairs of two classes that share one of their rarest shingles are checked, so no link is
    lost and none is by chance: ``max_bits`` and the stars only say how many pairs that step is spared.
    """
    nodes = rows.where("sig is not null").groupBy("sig").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("k", "digest")).alias("least"))
    nodes = written(nodes)
    contested = written(_contested(_postings(rows, words)))
    prints = nodes.select("sig", "fp")
    least = prints.groupBy("fp").agg(F.min("sig").alias("least_sig"))
    near = links(least.select("fp"), max_bits)
    for fp, sig in (("a", "x"), ("b", "y")):
        near = near.join(least.select(F.col("fp").alias(fp), F.col("least_sig").alias(sig)), fp)
    same = prints.join(least, "fp").select(F.col("sig").alias("x"), F.col("least_sig").alias("y"))
    near = near.select("x", "y").union(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    tried = written(near.union(_stars(contested.withColumn("class", F.col("sig")))).distinct())
    classes = components(_alike(tried, nodes, rows, words))
    for next_pairs in (lambda m: _stars(m, "sig"), _pairs):
        members = contested.join(classes, F.col("sig") == F.col("node"), "left").select("key", "sig", "at", F.coalesce("component", "sig").alias("class"))
        rest = written(next_pairs(members).join(tried, ["a", "b"], "left_anti"))
        # Classes are stars already, so few rounds join them by the new links.
        stars = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes, tried = components(stars.union(_alike(rest, nodes, rows, words))), tried.union(rest)
    return classes


def keep_one(df: DataFrame, words: int = 5, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the least key; all columns.

    Two texts are linked if the Jaccard of their sets of ``words``-word shingles is at least 4/5, or if
    neither has a word; groups are what the links join. Rows with null keys stay: they can't be told to
    be anybody's copy. Repeated rows of a key and text become one; a key's different texts are judged apart.
    """
    content, own = F.coalesce(F.col(text), F.lit("")), F.struct("k", "digest")
    digest, k, d, goes = (fresh(df, x) for x in ("_digest", "_k", "_d", "_goes"))
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(content).alias("digest"), content.alias("text"))
    rows = written(_sketches(texts, words))
    slim = rows.groupBy("k", "digest").agg(F.min(F.coalesce("sig", F.lit(0))).alias("sig"), F.count(F.lit(1)).alias("times"))
    classes = durable(similar_sets(rows, words, max_bits))
    named = slim.join(classes, F.col("sig") == F.col("node"), "left").select("k", "digest", "times", F.coalesce("component", "sig").alias("component"))
    firsts = named.groupBy("component").agg(F.min(own).alias("first")).select("first.*", F.lit(True).alias("stays"))
    marks = named.join(firsts, ["k", "digest"], "left").where("stays is null or times > 1").select(F.col("k").alias(k), F.col("digest").alias(d), F.col("stays").isNull().alias(goes))
    df = df.withColumn(digest, F.xxhash64(content))
    met = df.join(_few(marks), (df[key] == F.col(k)) & (df[digest] == F.col(d)), "left")
    once = met.where(F.col(goes).isNull())
    return once.unionByName(met.where(~F.col(goes)).dropDuplicates([key, digest])).drop(digest, k, d, goes)
