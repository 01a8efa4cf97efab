"""Exact cosine joins and searches of unit vectors over pivot cells.

The pivots are of a bounded sample of the vectors, each the farthest from those before it; each vector lives in the cell of the pivot with the least angle, and a
cell of many vectors is split into blocks of a bounded size by a hash. A vector can be within an angle ``a`` of
one that lives in another cell only if both bounds allow it:

* its angle to that cell's pivot is at most ``a`` beyond the cell's widest angle, and at most ``a`` short of its narrowest;
* its angle to the plane half way between both pivots is at most ``a``.

It visits the blocks of those cells and no others, so no pair is lost, whatever the data. Blocks are matrices, so
the check of visitors against residents is a product of two; its results are made exact at the threshold. Clustered
vectors visit few cells; vectors without any structure visit most of them, and then each pair is met once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ensure_checkpoints

#: Pivots at most, of a sample of so many vectors; vectors of a block, about; visitors that are held against a block
#: at once. None changes a result.
PIVOTS, SAMPLE, BLOCK, VISITORS = 256, 4096, 8192, 512
#: Room for rounding in angles and cosines; whatever lies within it is decided exactly.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Pivots by row, and for each the rows of its cell, its narrowest and widest angle; the rows of a block."""

    pivots: np.ndarray
    rows: np.ndarray
    narrow: np.ndarray
    wide: np.ndarray
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // self.block))

    def angles(self, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u @ self.pivots.T, -1.0, 1.0))

    def reached(self, u: np.ndarray, home: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Whether each vector can have one within its angle ``within`` in each cell."""
        a = within[:, None] + SLACK
        angles = self.angles(u)
        own = angles[np.arange(len(u)), home][:, None]
        gap = np.linalg.norm(self.pivots[home][:, None] - self.pivots[None], axis=2)
        # The plane half way: all of the other cell lie beyond it. Its distance is the sine of the angle to it.
        beyond = (np.cos(own) - np.cos(angles)) / np.maximum(gap, 1e-300)
        out = (angles <= self.wide + a) & (angles >= self.narrow - a) & ((a >= math.pi / 2) | (beyond <= np.sin(np.minimum(a, math.pi / 2)) + SLACK))
        out &= self.rows > 0
        out[np.arange(len(u)), home] = True
        return out


def farthest(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` different rows of a sample, each the one with the widest angle to those before it."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < k and near.min() < 1 - 1e-12:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def placed(units: DataFrame) -> tuple[DataFrame, Cells | None]:
    """(id, u, cell) of unit vectors (id, u), checkpointed, and their cells; the sample is the rows of the least hashes."""
    ensure_checkpoints(units.sparkSession)
    units = units.checkpoint()
    n = units.count()
    if not n:
        return units.withColumn("cell", F.lit(0)), None
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("u").collect()
    pivots = farthest(np.array([r.u for r in sample]), min(PIVOTS, max(1, 2 * math.isqrt(n))))
    start = Cells(pivots, *(np.zeros(len(pivots)) for _ in range(3)), BLOCK)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                angles = start.angles(np.stack(pdf.u.to_list()))
                pdf["cell"] = angles.argmin(axis=1).astype(np.int32)
                pdf["angle"] = angles.min(axis=1)
                yield pdf

    homes = units.mapInPandas(assign, "id long, u array<double>, cell int, angle double").checkpoint()
    rows, narrow, wide = np.zeros(len(pivots), np.int64), np.full(len(pivots), math.pi), np.zeros(len(pivots))
    for r in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).collect():
        rows[r.cell], narrow[r.cell], wide[r.cell] = r.n, r.a, r.b
    return homes.drop("angle"), Cells(pivots, rows, narrow, wide, BLOCK)


def _first(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Of two cells or blocks, whether the first visits the second: one of both, as often the lower as the higher."""
    return (a < b) == ((a + b) % 2 == 1)


def _met(visits: DataFrame, homes: DataFrame, cells: Cells, meet: Callable, schema: str) -> DataFrame:
    """Brings visitors (key, id, u, bound) to their blocks. In a task, a block's residents come first, then its visitors
    in batches; ``meet(resident ids, residents, visitor ids, visitors, bounds)`` yields rows. Without visitors in the
    stream a block meets itself: ``meet(ids, residents, None, None, None)``."""
    shared = homes.sparkSession.sparkContext.broadcast(cells.blocks)

    def block(cell: pd.Series, id: pd.Series) -> pd.Series:
        return pd.Series((cell.to_numpy(np.int64) << 32) | (id.to_numpy(np.int64) % shared.value[cell.to_numpy()]))

    home = F.pandas_udf(block, "long")
    residents = homes.select(home("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 31))).alias("key"), F.lit(0).alias("kind"), "id", "u", F.lit(0.0).alias("bound"))
    stream = residents.unionByName(visits.withColumn("kind", F.lit(1)).select("key", "kind", "id", "u", "bound")).repartition("key").sortWithinPartitions("key", "kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, vectors, closed = None, [], [], True

        def residents() -> tuple[np.ndarray, np.ndarray]:
            nonlocal ids, vectors
            if len(ids) != 1:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
            return ids[0], vectors[0]

        for pdf in frames:
            keys, kinds = pdf.key.to_numpy(), pdf.kind.to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1), len(pdf)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                u, own = np.stack(pdf.u.iloc[a:b].to_list()), pdf.id.to_numpy(np.int64)[a:b]
                if keys[a] != key:
                    if not closed:
                        yield from meet(*residents(), None, None, None)
                    key, ids, vectors, closed = keys[a], [], [], True
                if kinds[a] == 0:
                    ids.append(own)
                    vectors.append(u)
                    closed = False
                elif ids:
                    if not closed:
                        yield from meet(*residents(), None, None, None)
                        closed = True
                    for at in range(0, b - a, VISITORS):
                        to = at + VISITORS
                        yield from meet(*residents(), own[at:to], u[at:to], pdf.bound.to_numpy()[a:b][at:to])
        if not closed:
            yield from meet(*residents(), None, None, None)

    return stream.mapInPandas(run, schema)


def _visits(rows: DataFrame, cells: Cells, bound: str, both: bool) -> DataFrame:
    """(key, id, u, bound) of rows (id, u, cell, bound): a row for each block to visit. ``bound``: what the cosine must
    reach. ``both``: all blocks but the home cell's; else one side of each pair of cells and of a cell's blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def keys(u: pd.Series, cell: pd.Series, id: pd.Series, least: pd.Series) -> pd.Series:
        c = shared.value
        if not len(u):
            return pd.Series([], dtype=object)
        out, blocks, numbers = [], c.blocks, np.arange(len(c.rows), dtype=np.int64)
        for at in range(0, len(u), 1024):
            home, hashed = cell.to_numpy(np.int64)[at : at + 1024], id.to_numpy(np.int64)[at : at + 1024]
            reached = c.reached(np.stack(u.iloc[at : at + 1024].to_list()), home, np.arccos(np.clip(least.to_numpy()[at : at + 1024], -1.0, 1.0)))
            for seen, h, x in zip(reached, home, hashed, strict=True):
                seen[h] = False
                to = numbers[seen if both else seen & _first(h, numbers)]
                n = blocks[to]
                key = np.repeat(to << 32, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if not both and blocks[h] > 1:
                    mine, others = x % blocks[h], np.arange(blocks[h])
                    key = np.concatenate((key, (h << 32) + others[(others != mine) & _first(mine, others)]))
                out.append(key)
        return pd.Series(out)

    at = F.pandas_udf(keys, "array<long>")("u", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 31)), bound)
    return rows.withColumn("bound", F.col(bound)).select(F.explode(at).alias("key"), "id", "u", "bound")


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, added from the first dimension to the last, as an expression over arrays does."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.empty(0)


def _links(threshold: float) -> Callable:
    """(a index, b index, exact cosine) of residents and visitors, or of residents among themselves, at the threshold."""

    def found(u: np.ndarray, v: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(u if v is None else v), VISITORS):
            part = (u if v is None else v)[at : at + VISITORS]
            product = part @ u.T
            i, j = np.nonzero(product >= threshold - SLACK)
            if v is None:
                i, j = i[i + at < j], j[i + at < j]
            for k in range(0, len(i), 1 << 16):  # a block of near copies is taken in pieces
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                cosine = np.where(np.abs(product[x, y] - threshold) <= SLACK, dots(part[x], u[y]), product[x, y])
                ok = cosine >= threshold
                yield x[ok] + at, y[ok], dots(part[x[ok]], u[y[ok]])

    return found


def join(units: DataFrame, threshold: float, what: str = "pairs") -> DataFrame:
    """All pairs of different vectors (id, u) whose cosine is at least ``threshold``, each met once.

    ``what``: "pairs" gives (a, b, cosine) with a < b; "counts" (id, links), added up before it is shuffled, so a
    group of near copies costs no row for each pair; "forest" (a, b), links enough to connect what is connected."""
    rows, cells = placed(units)
    schema = {"pairs": "a long, b long, cosine double", "counts": "id long, links long", "forest": "a long, b long"}[what]
    if cells is None:
        return units.sparkSession.createDataFrame([], schema)
    found = _links(threshold)

    def meet(ids: np.ndarray, u: np.ndarray, visitors: np.ndarray | None, v: np.ndarray | None, _: np.ndarray | None) -> Iterator[pd.DataFrame]:
        left = ids if visitors is None else visitors
        counts = np.zeros(len(left), np.int64), np.zeros(len(ids), np.int64)
        tops: dict[int, int] = {}

        def top(x: int) -> int:
            while tops.setdefault(x, x) != x:
                tops[x] = x = tops[tops[x]]
            return x

        for i, j, cosine in found(u, v):
            if what == "pairs" and len(i):
                yield pd.DataFrame({"a": np.minimum(left[i], ids[j]), "b": np.maximum(left[i], ids[j]), "cosine": cosine})
            elif what == "counts":
                counts[0][:] += np.bincount(i, minlength=len(left))
                counts[1][:] += np.bincount(j, minlength=len(ids))
            elif what == "forest":
                edges = []
                for a, b in zip(left[i].tolist(), ids[j].tolist(), strict=True):
                    x, y = top(a), top(b)
                    if x != y:
                        tops[x] = y
                        edges.append((a, b))
                if edges:
                    yield pd.DataFrame(edges, columns=["a", "b"])
        if what == "counts":
            for own, n in zip((left, ids), counts, strict=True):
                if n.any():
                    yield pd.DataFrame({"id": own[n > 0], "links": n[n > 0]})

    out = _met(_visits(rows.withColumn("least", F.lit(float(threshold))), cells, "least", both=False), rows, cells, meet, schema)
    return out.groupBy("id").agg(F.sum("links").alias("links")) if what == "counts" else out


def candidates(units: DataFrame, threshold: float) -> int:
    """How many pairs the join holds against each other: a measure of what the bounds leave."""
    rows, cells = placed(units)
    if cells is None:
        return 0

    def meet(ids: np.ndarray, u: np.ndarray, visitors: np.ndarray | None, v: np.ndarray | None, _: np.ndarray | None) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [len(ids) * (len(ids) - 1) // 2 if visitors is None else len(ids) * len(visitors)]})

    return _met(_visits(rows.withColumn("least", F.lit(float(threshold))), cells, "least", both=False), rows, cells, meet, "n long").agg(F.sum("n")).first()[0]


def nearest(units: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, id, cosine): the ``k`` nearest others of each query (id) among all rows (id, u), by cosine rounded to
    ``digits`` and then by id; more rows than ``k`` for a query, the best of each block it met.

    A query first meets its own cell; the k-th cosine there is what any other must reach, so it goes on
    to the blocks of those cells alone that its bounds leave. Rows are read and sent to their blocks once for
    each of both steps, however many queries there are, and no row comes to the driver."""
    rows, cells = placed(units)
    schema = "query_id long, id long, cosine double"
    if cells is None:
        return units.sparkSession.createDataFrame([], schema)

    def meet(ids: np.ndarray, u: np.ndarray, visitors: np.ndarray | None, v: np.ndarray | None, bounds: np.ndarray | None) -> Iterator[pd.DataFrame]:
        if visitors is None:
            return
        cosine = v @ u.T
        # What may be among the k best of this block and reaches the bound; then exact sums decide.
        kth = np.partition(cosine, max(0, len(ids) - k - 1), axis=1)[:, max(0, len(ids) - k - 1)] if len(ids) > k + 1 else np.full(len(v), -2.0)
        i, j = np.nonzero(cosine >= np.maximum(np.minimum(kth, 2.0), bounds)[:, None] - 10.0**-digits - SLACK)
        keep = visitors[i] != ids[j]
        i, j = i[keep], j[keep]
        exact = np.concatenate([dots(v[i[a : a + 65_536]], u[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)] or [np.empty(0)])
        order = np.lexsort((ids[j], -np.round(exact, digits), i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        ok = place < k
        if ok.any():
            yield pd.DataFrame({"query_id": visitors[i[ok]], "id": ids[j[ok]], "cosine": exact[ok]})

    asked = rows.join(queries.select("id").distinct(), "id", "left_semi").checkpoint()
    blocks = F.array(*[F.lit(int(n)) for n in cells.blocks])
    near = asked.select(F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)).alias("_b"), "id", "u", "cell").select((F.shiftleft(F.col("cell").cast("long"), 32) + F.col("_b")).alias("key"), "id", "u", F.lit(-2.0).alias("bound"))
    first = _met(near, rows, cells, meet, schema).checkpoint()
    # The k-th of a query's own cell: of the sorted cosines of its blocks' bests, of which there are k for each block.
    reached = first.groupBy("query_id").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c")).select(F.col("query_id").alias("_q"), F.get("c", F.lit(k - 1)).alias("least"))
    bounded = asked.join(reached, F.col("id") == F.col("_q"), "left").select("id", "u", "cell", F.coalesce("least", F.lit(-2.0)).alias("least"))
    return first.union(_met(_visits(bounded, cells, "least", both=True), rows, cells, meet, schema))
