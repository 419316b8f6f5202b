"""Observed progress and cancelled groups of jobs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from leafline.streaming import progress


def test_observed(spark):
    df, watch = progress.observed(spark.range(50), "fifty", largest=F.max("id"))
    assert df.where("id % 2 = 0").count() == 25
    assert watch.get == {"rows": 50, "largest": 49}


def test_cancel(spark):
    slow = spark.range(4, numPartitions=4).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id long")
    timer = threading.Timer(4, lambda: progress.cancel(spark, "slow"))
    timer.start()
    began = time.time()
    with pytest.raises(Exception, match="(?i)cancel"), progress.cancellable(spark, "slow"):
        slow.count()
    timer.cancel()
    assert time.time() - began < 50 and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert spark.range(3).count() == 3
