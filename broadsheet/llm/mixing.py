"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word target. Whole passes over the source fill it as far as they fit; for the
rest, documents are counted by exact length, every length gives its even share, and a bounded
knapsack over the lengths closes the remaining gap. A seeded order picks the documents of a length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, split_rank

#: The knapsack's budget in words; the gap is brought below it before.
KNAPSACK_WORDS = 16384
#: Documents of each length, of those taken, that the knapsack may give back.
OPEN = 8


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources in order of their code points, null last, take the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
    weight until none is above. In closed form: with sources ordered by the level at which each
    fills up, a source is full if the level that the ones before it leave is not below its own.
    The table has one row for each source, so it is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    w = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_w", weight)
    w = w.withColumn("_most", (F.col("source_size") * most).cast("double")).withColumn("_full", F.col("_most") / F.col("_w"))
    by_level = Window.orderBy("_full", "_n")
    before, here_on, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = w.withColumn("_level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_w").over(here_on))
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", F.first(F.when(F.col("_level") < F.col("_full"), F.col("_level")), ignorenulls=True).over(whole))
    target = F.least(F.col("_most"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_most")))
    return w.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as
    found. lengths: distinct and positive. Even shares first, then the longest that still fit until
    the gap is under KNAPSACK_WORDS, then an exact bounded knapsack for the gap."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    gap = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if gap <= KNAPSACK_WORDS:
            break
        extra = min(int(counts[i] - take[i]), (gap - KNAPSACK_WORDS + int(lengths[i]) - 1) // int(lengths[i]), gap // int(lengths[i]))
        take[i] += extra
        gap -= extra * int(lengths[i])
    for i in order[::-1]:  # some of what is taken is open again, so that the knapsack has a choice at every length
        free = max(0, min(int(take[i]), OPEN, (KNAPSACK_WORDS - gap) // int(lengths[i])))
        take[i] -= free
        gap += free * int(lengths[i])
    left = counts - take
    mask, reach, steps = (1 << (min(gap, KNAPSACK_WORDS) + 1)) - 1, 1, []
    goal = min(gap, KNAPSACK_WORDS)
    for i in order[::-1]:
        length, free, part = int(lengths[i]), min(int(left[i]), goal // int(lengths[i])), 1
        while free > 0 and not reach >> goal & 1:  # a multiplicity in powers of two
            n = min(part, free)
            steps.append((i, n, reach))
            reach |= reach << (n * length) & mask
            free, part = free - n, part * 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    for i, n, was in reversed(steps):
        if not was >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def mix(df: DataFrame, size: Column | None = None, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """(key, source, size, source_size, target, passes, taken) for each row.

    ``size``: the row's words unless given; a null counts as 0. A document is taken ``passes`` times,
    at most ``most`` times, whole each time, so a source stays under its target by less than its
    shortest spare document, and by nothing where the knapsack closes the gap. Rows without words
    take no part (passes 0). A null source is a source of its own. Reruns agree: the order within a
    length is that of a seeded hash of the key. Only counts by (source, length) meet in a task.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) if size is None else F.coalesce(size, F.lit(0))
    rows = df.select(F.col(key), F.col(source).alias("source"), words.cast("long").alias("size"))
    classes = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        full = min(most, int(target // total)) if total else 0
        pdf = pdf.sort_values("size", ignore_index=True)
        some = pdf["size"].to_numpy() > 0
        extra = np.zeros(len(pdf), np.int64)
        extra[some] = fit_budget(pdf["size"].to_numpy()[some], pdf.n.to_numpy()[some], round(target) - full * total if full < most else 0)
        return pdf.assign(full=np.where(some, full, 0), extra=extra)[["source", "size", "source_size", "target", "full", "extra"]]

    t = targets.withColumnRenamed("source", "_source")
    per_class = classes.join(t, classes["source"].eqNullSafe(t["_source"])).drop("_source")
    plans = per_class.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, full long, extra long")
    plans = plans.withColumnsRenamed({"source": "_source", "size": "_size"})
    ranked = split_rank(rows, ["source", "size"], F.xxhash64(F.lit(seed), F.col(key)), [key], "_place")
    out = ranked.join(plans, ranked["source"].eqNullSafe(plans["_source"]) & (ranked["size"] == plans["_size"]))
    passes = (F.col("full") + (F.col("_place") < F.col("extra")).cast("long")).alias("passes")
    return out.select(key, "source", "size", "source_size", "target", passes, (passes * F.col("size")).alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of ``df``, all columns, as often as it is taken. Rows that agree in key,
    source and text share their passes. Names of further columns don't matter."""
    row, again, time = (fresh(df, n) for n in ("_row", "_again", "_time"))
    rows = df.withColumn(row, F.xxhash64(key, "source", "text"))
    planned = mix(rows.select(F.col(row).alias("row"), "source", "text"), key="row", **options)
    times = planned.groupBy("row").agg(F.sum("passes").cast("int").alias(again)).where(F.col(again) > 0).withColumnRenamed("row", time)
    met = rows.dropDuplicates([row]).join(times, F.col(row) == F.col(time))
    return met.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(again)))).select(*df.columns)
