"""The scan: documents -> findings -> scores, alarms and summaries."""

from __future__ import annotations

import os
import resource
from collections import deque
from collections.abc import Callable
from datetime import date
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims
from ..operators import alarm, verify
from ..operators import findings as fd
from ..sources import discover
from ..sources import files as src

EXTRA = ("path", "ext", "text", "scan_status", "failure_reason", "metadata", "faces_detected", "ocr_attempted", "ocr_confidence")


def scan_documents(docs: DataFrame, layers=None, as_of: date | None = None, ner=None, failing=(), keep=("doc_id",), gates=None) -> DataFrame:
    """keep columns, findings, failed_layers and the scan's record: one row per document. Nothing is shuffled."""
    extra = [c for c in EXTRA if c in docs.columns]
    found = fd.merge(fd.detect(docs.select(*dict.fromkeys([*keep, *extra])), layers, as_of, ner, failing, gates=gates))
    return fd.with_metadata(found, layers)


def tables_of(docs: DataFrame, skipped: DataFrame, layers=None, as_of=None, ner=None, judge: verify.Judge | None = None, gates=None) -> dict[str, DataFrame]:
    """The tables of a scan: results, findings, file_scores, scan_summary, skipped_files, failed_files, mismatch_alarms and, with a judge,
    verdicts, which results and scores follow."""
    results, out = scan_documents(docs, layers, as_of, ner, gates=gates), {}
    if judge is not None:
        out["verdicts"] = verify.ask(fd.explode_findings(results), results, judge)
        results = verify.rescored(results, out["verdicts"])
    scores = fd.file_scores(results)
    return out | {
        "results": results,
        "findings": fd.explode_findings(results),
        "file_scores": scores,
        "scan_summary": fd.scan_summary(scores, skipped),
        "skipped_files": skipped,
        "failed_files": docs.where("scan_status = 'extraction_failed'").select("path", "failure_reason"),
        "mismatch_alarms": alarm.alarms(results),
    }


def scan_folder(spark: SparkSession, root: str, layers=None, extensions=None, max_mb: float = src.MAX_MB, as_of: date | None = None, backends=None, ner=None, judge: verify.Judge | None = None, excluded: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of a scan of a folder. A local one is walked by the driver and read file by file where tasks run (all of them have to see
    it); another one is read by Spark."""
    if "://" not in root:
        good, skipped, _ = discover.discover(spark, root, extensions, max_mb, excluded)
        docs = discover.read_local(good, backends)
    else:
        good, skipped = src.split_files(src.scan_files(spark, root), extensions, max_mb)
        docs = src.read_texts(good, backends)
    return tables_of(docs, skipped, layers, as_of, ner, judge)


def scan_file(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """A folder's scan of one file."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return scan_folder(spark, path, **options)


def scan_path(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    return scan_file(spark, path, **options) if os.path.isfile(path) else scan_folder(spark, path, **options)


def scan_options(layers: str | None = None, extensions: str | None = None, max_mb: float | None = None, verify_findings: bool = False) -> dict:
    """Options of a scan from what a form or a command line says."""
    out: dict = {}
    if layers and layers != "all":
        chosen = frozenset(x.strip() for x in layers.split(",") if x.strip())
        if not chosen or chosen - set(dims.LAYERS):
            raise ValueError(f"layers are {', '.join(dims.LAYERS)}")
        out["layers"] = chosen
    if extensions:
        out["extensions"] = frozenset(x.strip().lower().lstrip(".") for x in extensions.split(",") if x.strip())
    if max_mb is not None:
        out["max_mb"] = float(max_mb)
    return out | ({"verify": True} if verify_findings else {})


class Run:
    """A scan's jobs under one tag: they can be cancelled, and their progress and peaks followed.

    Files that were written before a cancel stay; peaks are the largest of samples, not more."""

    def __init__(self, spark: SparkSession, tag: str = "scan", every: float = 5.0):
        self.spark, self.tag, self.every = spark, tag, every
        self.cancelled, self._stop, self.peaks = False, Event(), {"peak_rss_mb": None, "peak_cpu_percent": None, "workers": spark.sparkContext.defaultParallelism}
        self.ticker: deque[dict] = deque(maxlen=40)

    def __enter__(self) -> Run:
        self.spark.sparkContext.addJobTag(self.tag)
        self._thread = Thread(target=self._sample, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)

    def _sample(self) -> None:
        last = sum(os.times()[:4])
        while True:
            rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            self.peaks["peak_rss_mb"] = max(rss, self.peaks["peak_rss_mb"] or 0.0)
            if self._stop.wait(self.every):
                return
            now = sum(os.times()[:4])
            self.peaks["peak_cpu_percent"] = max(100 * (now - last) / self.every, self.peaks["peak_cpu_percent"] or 0.0)
            last = now

    def progress(self) -> dict[str, int]:
        """Tasks of the tag's running stages: done, running and all."""
        tracker, out = self.spark.sparkContext.statusTracker(), {"done": 0, "running": 0, "all": 0}
        for stage in tracker.getActiveStageIds():
            info = tracker.getStageInfo(stage)
            if info:
                out = {"done": out["done"] + info.numCompletedTasks, "running": out["running"] + info.numActiveTasks, "all": out["all"] + info.numTasks}
        return out

    def follow(self, scores: DataFrame, tell: Callable[[dict], None] | None = None) -> None:
        """Tells file, score, risk, top type and number of findings as files come; the newest 40 stay in `ticker`."""
        for r in scores.toLocalIterator():
            told = {"file": os.path.basename(str(r["doc_id"])), "score": r["score"], "risk": r["band"], "top_type": r["top_category"], "findings": r["n_findings"]}
            self.ticker.appendleft(told)
            if tell:
                tell(told)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def register_functions(spark: SparkSession) -> None:
    """detect_pii(text) as a table function of SQL: raw_type, value, confidence, source of the sequential layers."""
    from pyspark.sql.functions import udtf

    from ..operators import context_layers as ctx

    @udtf(returnType="raw_type string, value string, confidence double, source string")
    class Detect:
        def eval(self, text: str):
            for layer, kind, value, confidence, _ in ctx.detect(text, frozenset(fd.CONTEXT_LAYERS))[0]:
                yield kind, value, confidence, layer

    spark.udtf.register("detect_pii", Detect)


def risk_report(docs: DataFrame, layers=None) -> DataFrame:
    return fd.file_scores(scan_documents(docs, layers))


__all__ = ["Run", "register_functions", "risk_report", "scan_documents", "scan_file", "scan_folder", "scan_options", "scan_path", "tables_of"]
