"""Background jobs on the driver: Spark actions in a small thread pool, each under its own tag so it can be cancelled."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lipika.operators.status import write_json


class Jobs:
    """Runs functions of a session and keeps a table of what became of them; with a folder, each job is a file there too,
    written in one step, and outlives the process."""

    def __init__(self, spark: SparkSession, workers: int = 2, keep: int = 100, folder: str | None = None) -> None:
        self.spark, self.keep, self.folder = spark, keep, folder
        self.pool = ThreadPoolExecutor(max_workers=max(1, min(4, workers)))
        self.rows: dict[str, dict[str, Any]] = {}
        self.futures: dict[str, Future] = {}
        self.lock = threading.Lock()
        if folder:
            self._restore()

    def _file(self, job: str) -> Path:
        return Path(self.folder) / f"{job}.json"

    def _keep(self, row: dict[str, Any]) -> None:
        if self.folder:
            write_json(row, str(self._file(row["job_id"])))

    def _restore(self) -> None:
        """Read the jobs of earlier processes; those that were not finished ended with them. Broken files are passed over."""
        for path in sorted(Path(self.folder).glob("[0-9a-f]*.json")):
            try:
                row = json.loads(path.read_text(encoding="utf-8"))
                times = {k: row[k] and datetime.fromisoformat(row[k]) for k in ("created_at", "finished_at")}
            except (OSError, ValueError, KeyError, TypeError):
                continue
            row |= times
            if row["status"] in ("queued", "running"):
                row |= {"status": "error", "error": "interrupted", "finished_at": datetime.now(timezone.utc)}
                self._keep(row)
            self.rows[row["job_id"]] = {k: row.get(k) for k in ("job_id", "kind", "status", "created_at", "finished_at", "error")}

    def submit(self, kind: str, function: Callable[[SparkSession], Any]) -> str:
        """Queue a function; returns the job's id. The oldest finished jobs go once there are too many."""
        job = uuid.uuid4().hex[:12]
        with self.lock:
            self.rows[job] = {"job_id": job, "kind": kind, "status": "queued", "created_at": datetime.now(timezone.utc), "finished_at": None, "error": None}
            done = sorted((r for r in self.rows.values() if r["finished_at"]), key=lambda r: r["finished_at"])
            for r in done[: max(0, len(self.rows) - self.keep)]:
                del self.rows[r["job_id"]]
                if self.folder:
                    self._file(r["job_id"]).unlink(missing_ok=True)
            self._keep(self.rows[job])
        self.futures[job] = self.pool.submit(self._run, job, function)
        return job

    def _run(self, job: str, function: Callable[[SparkSession], Any]) -> Any:
        row = self.rows[job]
        row["status"] = "running"
        self._keep(row)
        self.spark.addTag(f"job-{job}")
        try:
            result = function(self.spark)
            row["status"] = "done"
            return result
        except Exception as e:  # noqa: BLE001 - kept in the table
            row["status"], row["error"] = "error", str(e)[:160]
            return None
        finally:
            row["finished_at"] = datetime.now(timezone.utc)
            self._keep(row)
            self.spark.clearTags()

    def cancel(self, job: str) -> None:
        """Cancel the Spark work of a job."""
        self.spark.interruptTag(f"job-{job}")

    def wait(self, job: str) -> Any:
        """The job's result."""
        return self.futures[job].result()

    def get(self, job: str) -> dict[str, Any] | None:
        """One job's row."""
        return self.rows.get(job)

    def table(self, limit: int = 100) -> DataFrame:
        """Jobs, the newest first; 1 to 100 of them."""
        rows = sorted(self.rows.values(), key=lambda r: r["created_at"], reverse=True)[: max(1, min(100, limit))]
        return self.spark.createDataFrame([tuple(r.values()) for r in rows], "job_id string, kind string, status string, created_at timestamp, finished_at timestamp, error string")
