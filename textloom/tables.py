"""Readers of the engine's named Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

#: Bytes below which a table is spread over all cores.
SMALL = 32 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table of less than SMALL bytes over all cores, by ``key``; those of a larger one as they are read.

    A small table may be one row group, and so one task.  What is shuffled never
    exceeds SMALL bytes on disk; the planner's own estimate is used, so no files are listed for it.
    """
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key) if size < SMALL else rows
