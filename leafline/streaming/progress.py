"""Progress and cancellation of running work: observed counts, and groups of jobs that can be stopped together."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df and an observation of it: rows and the given aggregates, counted where the rows pass and ready when an action has read them all."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), watch


@contextmanager
def cancellable(spark: SparkSession, group: str, about: str = "") -> Iterator[None]:
    """Actions inside belong to a group that cancel() stops, in this thread."""
    spark.sparkContext.setJobGroup(group, about or group, interruptOnCancel=True)
    try:
        yield
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)


def cancel(spark: SparkSession, group: str) -> None:
    """Stops what runs in a group; what has not begun in it is not stopped."""
    spark.sparkContext.cancelJobGroup(group)
