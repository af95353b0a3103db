"""Watching projects: a stream's heartbeat compares the tree with the index, keeps the change list, and updates when it has grown and gone quiet."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between looks at the tree; changed files and quiet seconds before an update.
BEAT, UPDATE_FILES, UPDATE_QUIET = 1, 100, 60


class Watch:
    """Keeps a project's change list equal to what differs from its index.

    A beat asks for the ``mark`` of what the list depends on, and compares the tree with the index's
    listing only if it is another than last time; without one, each beat compares. So a watch that starts
    again, or a beat that runs again, comes to the same list: nothing but the list itself is kept. ``last``
    is when the list was written, so that quiet time goes on over a new start. Beats come whether or not anything changed, so an update is not missed when the tree goes quiet. An update
    that fails leaves the changes as they are, and is tried again after the next quiet time.
    """

    def __init__(self, changed: Callable[[], DataFrame], listed: Callable[[], DataFrame], write: Callable[[DataFrame], None], update: Callable[[], None], files: int = UPDATE_FILES, quiet: float = UPDATE_QUIET, clock: Callable[[], float] = time.time, mark: Callable[[], object] = object, last: float | None = None):
        self.changed, self.listed, self.write, self.update, self.mark = changed, listed, write, update, mark
        self.files, self.quiet, self.clock = files, quiet, clock
        self.last, self.failures, self.seen, self.n = clock() if last is None else last, 0, None, 0

    def beat(self) -> str:
        """One look; tells what was done: ``written``, ``updated``, ``failed`` or ``quiet``."""
        mark = self.mark()
        if mark != self.seen:
            written = self._compare()
            self.seen = mark
            if written:
                self.last = self.clock()
                return "written"
        if self.clock() - self.last < self.quiet or self.n <= self.files:
            return "quiet"
        self.last = self.clock()
        try:
            self.update()
        except Exception:
            self.failures += 1
            return "failed"
        return "updated"

    def _compare(self) -> bool:
        """Write what differs now, if the list has it otherwise."""
        now, was = self.changed().select("path").distinct(), self.listed().select("path")
        now = now.persist()
        try:
            self.n = now.count()
            gone, new = was.join(now, "path", "left_anti"), now.join(was, "path", "left_anti")
            if new.isEmpty() and gone.isEmpty():
                return False
            self.write(now)
            return True
        finally:
            now.unpersist()

    def start(self, spark: SparkSession, seconds: float = BEAT):
        """A streaming query whose batches are the beats; stop it to end the watch."""
        beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return beats.writeStream.foreachBatch(lambda rows, number: self.beat()).trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds").start()


def filter_stream(stream: DataFrame, query: str, options=None) -> DataFrame:
    """The path matchers over a stream's ``path`` column, batch by batch as lines come: by regex, literal, name or tokens.

    A fuzzy query adds each line's ``score``; an order over all lines is for tables only.
    """
    from tessera.operators import files
    from tessera.plans.options import Options

    options = options or Options()
    rows = stream.where("path <> ''")
    if "name" not in rows.columns:
        rows = rows.withColumn("name", files.name_of(F.col("path")))
    if query and options.style == "fuzzy":
        return rows.where(files.subsequence(query)).withColumn("score", files.rank_udf(query)(F.col("path")))
    return rows.where(files.matches(query, options)) if query else rows
