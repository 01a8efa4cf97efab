"""Sources and sinks: search hits, news tables, versioned commits of several tables, logs and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.scalars import local_date
from .store import Store  # noqa: F401


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search hits from landed JSON payloads {keyword_ord, keyword, items: [...]}; no list means no hits."""
    return explode_payloads(spark.read.schema(S.PAYLOAD).json(path, multiLine=True))


def explode_payloads(payloads: DataFrame) -> DataFrame:
    """One hit for each item; a payload may be a page, whose ``first_pos`` is its first item's place."""
    first = F.col("first_pos") if "first_pos" in payloads.columns else F.lit(0)
    rows = payloads.select("keyword_ord", "keyword", first.cast("int").alias("first"), F.posexplode(F.coalesce("items", F.array().cast(S.PAYLOAD["items"].dataType))).alias("item_pos", "item"))
    return rows.select("keyword_ord", "keyword", (F.col("first") + F.col("item_pos")).alias("item_pos"), "item.*")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_news(news: DataFrame, path: str, tz: str = S.SEOUL, by: str = "day") -> None:
    """Parquet in folders by the publication day, or month, so that period filters prune them. Rows are
    rebalanced by the folder, so a large day is written by many tasks and small days share one."""
    day = local_date(F.col("published_at"), tz)
    dated = news.withColumn("published_date", day).withColumn("published_part", F.to_date(F.trunc(day, "month")) if by == "month" else day)
    dated.hint("rebalance", "published_part").write.mode("overwrite").partitionBy("published_part").parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def key_ranges(key: str, low: int | None, high: int | None, rows: int, each: int) -> list[str]:
    """Conditions on a whole-number key that part a table into ranges of about ``each`` rows if keys are spread
    evenly; the first is open below and takes null keys, the last is open above, so rows that come meanwhile are read once."""
    parts = 1 if low is None else max(1, min(-(-rows // each), high - low + 1))
    cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)] if parts > 1 else []
    if not cuts:
        return ["1 = 1"]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{key} >= {cuts[-1]}"]


def _quoted(spark: SparkSession, url: str, *names: str) -> list[str]:
    """Column names as the database quotes them."""
    dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return [dialect.quoteIdentifier(n) for n in names]


def read_jdbc_by_key(spark: SparkSession, url: str, name: str, key: str, each: int = 100_000, **options: str) -> DataFrame:
    """A table read by many connections, each a range of the key; bounds and count come from one query first."""
    (key,) = _quoted(spark, url, key)
    bounds = f"(SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT(*) AS n FROM {name}) b"
    low, high, n = (None if v is None else int(v) for v in read_jdbc(spark, url, bounds, **options).first())
    return spark.read.jdbc(url, name, predicates=key_ranges(key, low, high, n, each), properties=dict(options))


#: What tells a staged row's task and its attempt.
TASK, ATTEMPT = "load_task", "load_attempt"


def stage_jdbc(df: DataFrame, url: str, stage: str, **options: str) -> None:
    """Writes rows into a staging table of their own, with the task and the attempt that wrote them. A task's rows are
    one transaction, so each attempt is there in whole or not at all; a repeated one is there twice."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        for b in batches:
            more = [pa.array([v] * b.num_rows, pa.int64()) for v in (at.partitionId(), at.taskAttemptId())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, TASK, ATTEMPT])

    schema = T.StructType([*df.schema.fields, T.StructField(TASK, T.LongType()), T.StructField(ATTEMPT, T.LongType())])
    write_jdbc(df.mapInArrow(marked, schema), url, stage, "overwrite", **options)


def publish_jdbc(spark: SparkSession, url: str, stage: str, name: str, columns: list[str], key: str | None = None, **options: str) -> int:
    """Moves one attempt of each task from the staging table to the table, in one transaction, and drops the staging
    table. ``key``: rows whose key is there already stay out, so a load that is run again adds nothing. Returns
    the rows added."""
    jvm, cols = spark.sparkContext._jvm, ", ".join(_quoted(spark, url, *columns))
    task, attempt, own = _quoted(spark, url, TASK, ATTEMPT, key or "")
    known = f" AND NOT EXISTS (SELECT 1 FROM {name} t WHERE t.{own} = s.{own})" if key else ""
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        once = f"s.{attempt} = (SELECT MIN(m.{attempt}) FROM {stage} m WHERE m.{task} = s.{task})"
        added = statement.executeUpdate(f"INSERT INTO {name} ({cols}) SELECT {cols} FROM {stage} s WHERE {once}{known}")
        connection.commit()
        statement.executeUpdate(f"DROP TABLE {stage}")
        connection.commit()
        return added
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def load_jdbc(df: DataFrame, url: str, name: str, key: str | None = None, **options: str) -> int:
    """Appends rows to a table in one transaction, by way of a staging table: a retried task, or a second run with a
    key, doubles nothing, and readers see all rows or none."""
    stage = f"{name}_load_{uuid.uuid4().hex[:8]}"
    stage_jdbc(df, url, stage, **options)
    return publish_jdbc(df.sparkSession, url, stage, name, df.columns, key, **options)


def log_rows(runs: DataFrame) -> DataFrame:
    """Collection-log rows from runs (started_at, collected_count, errors array<string>, actor)."""
    message = F.nullif(F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "\n"), F.lit(""))
    failed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    return runs.select("started_at", F.col("collected_count").cast("int").alias("collected_count"), F.when(failed, "fail").otherwise("success").alias("status"), message.alias("error_message"), "actor")


def append_log(runs: DataFrame, path: str) -> None:
    log_rows(runs).write.mode("append").parquet(path)


def report_markdown(reports: DataFrame, report_news: DataFrame, news: DataFrame) -> DataFrame:
    """(report_id, document): each report with its news list, newest first, as Markdown."""
    listed = report_news.join(news.select(F.col("id").alias("news_id"), "title", "url", "published_at"), "news_id")
    item = F.struct((-F.unix_seconds("published_at")).alias("o"), (-F.col("news_id")).alias("n"), F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")).alias("line"))
    lines = listed.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("lines"))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.col("overview"), F.col("content"), F.col("lines"))
    return reports.join(lines, reports["id"] == lines["report_id"], "left").select(reports["id"].alias("report_id"), text.alias("document"))


def snapshot_report(reports: DataFrame, report_news: DataFrame, news: DataFrame, path: str) -> None:
    report_markdown(reports, report_news, news).select(F.col("document").alias("value"), "report_id").write.mode("overwrite").partitionBy("report_id").text(path)


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names. Only a local master may do without:
    it gets a folder of its own. On a cluster that folder would be on the driver's disk, so there a
    missing setting is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="broadsheet-")
    return named


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where the session has none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared(spark))
