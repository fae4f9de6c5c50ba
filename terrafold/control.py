"""Configuration, cancellation, bounded job pools, memoization and progress (CTL-01..04, TMP-12)."""

from __future__ import annotations

import os
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass(frozen=True)
class Config:
    """CTL-04: settings with defaults; `TERRAFOLD_<NAME>` in the environment overrides one."""

    root: str = "."
    sample_cap: int = 20_000
    broadcast_rows: int = 100_000
    window_hours: tuple[int, ...] = (24, 168, 720, 2160)

    @classmethod
    def load(cls, environ=None) -> Config:
        environ = os.environ if environ is None else environ
        found = {}
        for f in fields(cls):
            text = environ.get(f"TERRAFOLD_{f.name.upper()}")
            if text is not None:
                found[f.name] = int(text) if isinstance(f.default, int) else tuple(map(int, text.split(","))) if isinstance(f.default, tuple) else text
        return cls(**found)


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """CTL-01: jobs started inside carry a tag; `cancel` with the same tag stops those that run."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """CTL-01: jobs that carry the tag end with an error."""
    spark.sparkContext.cancelJobsWithTag(tag)


def memory_share() -> float:
    """The share of the driver machine's memory that is in use."""
    page, total, free = (os.sysconf(n) for n in ("SC_PAGE_SIZE", "SC_PHYS_PAGES", "SC_AVPHYS_PAGES"))
    return 1 - free * page / (total * page)


def run_bounded(tasks, workers: int = 4, pending: int = 4, watermark: float = 0.8, used=memory_share, pause: float = 0.05):
    """CTL-02: the results of tasks (callables that start Spark jobs), in the order in which they end.

    At most workers * pending tasks are waiting; while memory in use is above the watermark and something runs, no new one
    is taken.  Executors schedule the jobs' own work; this bounds what the driver starts at once.
    """
    source, running = iter(tasks), set()
    with ThreadPoolExecutor(workers) as pool:
        more = True
        while more or running:
            while more and len(running) < workers * pending and not (running and used() > watermark):
                task = next(source, None)
                if task is None:
                    more = False
                else:
                    running.add(pool.submit(task))
            ended, running = wait(running, timeout=pause if more else None, return_when=FIRST_COMPLETED)
            for f in ended:
                yield f.result()


class Memo:
    """CTL-03: frames that are read again and again stay cached until they are released; storage may spill to disk."""

    def __init__(self):
        self.held: dict[str, DataFrame] = {}

    def get(self, name: str, build) -> DataFrame:
        if name not in self.held:
            self.held[name] = build().persist()
        return self.held[name]

    def release(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


class Progress(StreamingQueryListener):
    """TMP-12: the last rows per second of each running query, by its id."""

    def __init__(self):
        self.rates: dict[str, float] = {}

    def onQueryStarted(self, event):
        self.rates[str(event.id)] = 0.0

    def onQueryProgress(self, event):
        self.rates[str(event.progress.id)] = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rates.pop(str(event.id), None)
