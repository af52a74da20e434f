"""How rows lie over partitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many partitions as there are cores, where that at least doubles the tasks at work.

    Only a plain scan with splits for at most half of the cores is redistributed:
    a few small files whose texts would keep most cores idle. A scan with more
    splits, or a plan that shuffles anyway, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if re.search("(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)
