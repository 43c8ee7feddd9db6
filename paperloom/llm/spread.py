"""Even work for CPU-heavy row-wise stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperloom.runtime import width


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition rows round-robin only where the scan gives fewer splits than the cluster has cores.

    The splits are estimated from the optimizer's size of the scanned files, so nothing runs while the plan is built. Over large inputs
    the scan's own splits are kept and nothing is shuffled.
    """
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    wanted = per_core * width(spark)
    return df if size >= wanted * split else df.repartition(wanted)
