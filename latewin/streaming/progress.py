"""What a running query reports about itself."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from latewin.session import scratch_dir

SCHEMA = (
    "query string, batch_id long, received long, throughput double,"
    " event_time map<string,string>, state_rows long, state_bytes long"
)


class ProgressLog(StreamingQueryListener):
    """Keeps the reports of all queries of a session; add with
    ``spark.streams.addListener``.

    Every report is appended to a table in the shared folder, which :meth:`table` reads.
    ``reports`` is a view of the latest ``keep`` in memory.
    """

    def __init__(self, keep: int = 256, spark: SparkSession | None = None, path: str | None = None):
        self.session = spark or SparkSession.builder.getOrCreate()
        self.path = path or scratch_dir(self.session, "progress")
        self.reports: deque[dict] = deque(maxlen=keep)
        # The table exists before the first report too.
        self.session.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        report = {
            "query": str(p.id),
            "batch_id": p.batchId,
            "received": p.numInputRows,
            "throughput": p.processedRowsPerSecond,
            "event_time": dict(p.eventTime or {}),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "state_bytes": sum(s.memoryUsedBytes for s in p.stateOperators),
        }
        self._append(report)
        self.reports.append(report)

    def _append(self, report: dict) -> None:
        row = self.session.createDataFrame([report], SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """All reports so far."""
        return self.session.read.schema(SCHEMA).parquet(self.path)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
