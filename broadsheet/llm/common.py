"""What several operators of the pipeline share: words, tables, checkpoints, split ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: With it, Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Only a local master may do without: it gets a folder of its own. On a cluster that folder would be
    on the driver's disk, so there a missing setting is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="broadsheet-")
        context.setCheckpointDir(named)
    return named


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files. Else these stay until the driver happens to
    collect its garbage, which with little work of its own it may not do before the disks are full."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, since a query's cleanup is settled when it is made


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_rank(df: DataFrame, keys: list[str], by: Column, ties: list[str], name: str) -> DataFrame:
    """Adds ``name``: the gapless rank from 0 of each row within ``keys``, in order of ``by``.

    ``by`` is a 64-bit hash. A group is ranked in 256 slices of its hash range, so that a key
    that holds a third of all rows is still sorted by many tasks; the slices' counts, added up
    before the shuffle, give each slice its offset. Rows that agree in ``by`` and ``ties`` may
    swap ranks, but then nothing tells them apart.
    """
    df = df.withColumn("_by", by).withColumn("_slice", F.shiftrightunsigned("_by", 56))
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: f"_{i}_key" for i, k in enumerate([*keys, "_slice"])}
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").withColumnsRenamed(renamed)
    within = Window.partitionBy(*keys, "_slice").orderBy("_by", *ties)
    ranked = df.withColumn("_rank", F.row_number().over(within) - 1)
    cond = F.lit(True)
    for k, r in renamed.items():
        cond = cond & ranked[k].eqNullSafe(offsets[r])
    return (
        ranked.join(offsets, cond)
        .withColumn(name, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_by", "_slice", "_rank", "_before", *renamed.values())
    )


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; compressed, so for large tables."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(raw: Column) -> Column:
    """Binary values, compressed for the way through a shuffle."""

    @F.pandas_udf("binary")
    def pack(bodies: pd.Series) -> pd.Series:
        return bodies.map(zstandard.ZstdCompressor(3).compress)

    return pack(raw)


def unpacked(bodies: pd.Series) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in bodies]
