"""Documents as they arrive: the same scan on a stream of rows, and a sink for its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import findings as fd
from ..plans.scan import scan_documents


def scan_stream(docs: DataFrame, layers=None) -> DataFrame:
    """docs is a streaming DataFrame with doc_id and text. The scan has no state: rows are judged one by one."""
    return scan_documents(docs, layers)


def write_stream(results: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own files
        fd.explode_findings(rows).write.mode("overwrite").parquet(f"{folder}/findings/batch={number}")
        fd.file_scores(rows).write.mode("overwrite").parquet(f"{folder}/file_scores/batch={number}")

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
