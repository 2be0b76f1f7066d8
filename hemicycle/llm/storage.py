"""Checkpoints that also give back the disk of what they replace."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from hemicycle.session import cut_lineage, scratch_folder


def give_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to.

    It does so once the driver has collected those plans, which a mostly idle
    driver may not do for a long time; so it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder, after the disk of earlier steps is free."""
    give_back(df.sparkSession)
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder, for loops with joins.

    A checkpoint keeps the estimated size of its plan. In a loop each join
    multiplies estimates, until numbers with millions of digits fill the driver;
    a table has the size of its files.
    """
    give_back(df.sparkSession)
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
