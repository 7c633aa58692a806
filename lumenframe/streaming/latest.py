"""Only the newest run counts: a change cancels the Spark jobs of the run before it, and a stale run publishes nothing."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


class Latest:
    """Runs of a query, each in a thread of its own, of which only the one begun last is kept."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out, self.lock = spark, out, threading.Lock()
        self.newest, self.published, self.tag, self.threads = 0, 0, "", []
        self.failed: dict[int, BaseException] = {}

    def changed(self, run: Callable[[], DataFrame]) -> int:
        """Cancels the run that is going on and begins ``run``; gives its version."""
        with self.lock:
            if self.tag:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.newest += 1
            version, self.tag = self.newest, f"latest-{uuid.uuid4().hex}"
            thread = threading.Thread(target=inheritable_thread_target(self.spark)(self._run), args=(version, self.tag, run), daemon=True)
            self.threads.append(thread)
        thread.start()
        return version

    def _run(self, version: int, tag: str, run: Callable[[], DataFrame]) -> None:
        sc = self.spark.sparkContext
        sc.addJobTag(tag)
        try:
            if self.newest == version:
                run().write.mode("overwrite").parquet(f"{self.out}/version={version}")
                with self.lock:
                    if self.newest == version:
                        self.published = version
        except BaseException as e:  # a cancelled run ends here; the newest one's failure is raised by wait()
            self.failed[version] = e
        finally:
            sc.removeJobTag(tag)

    def wait(self) -> DataFrame:
        """The newest version, when its run is done. A failure of the newest run is raised here, those of stale ones are not."""
        for t in list(self.threads):
            t.join()
        if self.newest in self.failed:
            raise self.failed[self.newest]
        return self.spark.read.parquet(f"{self.out}/version={self.published}")
