"""The task queue as tables: what waits, runs and is done, and the loop that takes the oldest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A file younger than this may still be being written.
SETTLED = 0.19
#: Seconds between updates of the corpus, and outputs that are kept.
UPDATE_EVERY, KEPT_OUTPUTS = 24 * 3600, 100


def queue_status(tasks: DataFrame, now: float) -> DataFrame:
    """(dataset, submitted, finished, modified) -> dataset, status, position.

    Settled tasks without an end wait in the order of submission; the first of them runs.
    """
    waiting = F.col("finished").isNull()
    settled = tasks.where(~waiting | (F.lit(now) - F.col("modified") > SETTLED))
    place = F.row_number().over(Window.partitionBy(waiting).orderBy("submitted", "dataset"))
    rows = settled.withColumn("_place", place)
    status = F.when(~waiting, "done").when(F.col("_place") == 1, "running").otherwise("waiting")
    return rows.select("dataset", status.alias("status"), F.when(waiting, F.col("_place")).alias("position"))


def outdated(tasks: DataFrame, keep: int = KEPT_OUTPUTS) -> DataFrame:
    """Done tasks beyond the newest ``keep``."""
    done = tasks.where("finished is not null").withColumn("_new", F.row_number().over(Window.orderBy(F.desc("submitted"), "dataset")))
    return done.where(F.col("_new") > keep).drop("_new")


def due(now: float, last: float | None, every: float = UPDATE_EVERY) -> bool:
    return last is None or now - last > every


def serve_once(tasks: DataFrame, now: float, run: Callable[[str], None], update: Callable[[], None], delete: Callable[[str], None], updated: float | None = None, trimmed: float | None = None) -> tuple[str | None, float | None, float | None]:
    """One turn of the queue: trim old outputs and update the corpus where a day has passed, then run the task whose turn it is.

    Returns the task that ran and when the two others last did; a loop calls it with these.
    """
    if due(now, trimmed):
        for row in outdated(tasks).select("dataset").toLocalIterator():
            delete(row.dataset)
        trimmed = now
    if due(now, updated):
        update()
        updated = now
    return run_next(tasks, now, run), updated, trimmed


def run_next(tasks: DataFrame, now: float, run: Callable[[str], None]) -> str | None:
    """Runs the task whose turn it is; None if none waits."""
    turn = queue_status(tasks, now).where("status = 'running'").select("dataset").first()
    if turn is None:
        return None
    run(turn.dataset)
    return turn.dataset
