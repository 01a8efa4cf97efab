"""Alerts by timers on a stream that has gone quiet."""

from __future__ import annotations

import datetime as dt
import time

from broadsheet import schemas as S
from broadsheet.streaming import jobs

ROWS = "id long, source_type string, status string"


def test_a_quiet_stream_alerts_once_until_the_queue_was_empty(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "in.parquet"))
    land = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    land([(i, "a", S.UNVERIFIED) for i in range(3)] + [(9, "b", S.UNVERIFIED), (9, "b", S.VERIFIED), (10, None, S.UNVERIFIED)])
    df = jobs.stream_queue_alerts(jobs.read_stream(spark, str(tmp_path), "in"), dt.timedelta(seconds=2))
    out = str(tmp_path / "out")
    spark.createDataFrame([], df.schema).write.parquet(out)
    q = df.writeStream.foreachBatch(lambda rows, n: rows.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    alerts = lambda: sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect())

    def wait(n):
        end = time.time() + 60
        while time.time() < end and len(alerts()) < n and q.exception() is None:
            time.sleep(0.3)
        time.sleep(4)  # more than the patience: no second alert
        return alerts()

    try:
        assert wait(1) == [("a", 3)]
        land([(7, "a", S.UNVERIFIED)])  # still waiting and told: quiet
        time.sleep(4)
        assert alerts() == [("a", 3)]
        land([(i, "a", S.VERIFIED) for i in (0, 1, 2, 7)])
        time.sleep(3)
        land([(11, "a", S.UNVERIFIED)])
        assert wait(2) == [("a", 1), ("a", 3)]
    finally:
        q.stop()
