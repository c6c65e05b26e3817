"""Training parameters by environment as a table."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import params as P


def environment_table(spark: SparkSession) -> DataFrame:
    """One row per environment: a fixed, small table, so a join with it needs no shuffle of the other side."""
    return spark.createDataFrame([asdict(p) for p in P.ENVIRONMENTS.values()])


def with_parameters(df: DataFrame, environment: str = "environment") -> DataFrame:
    """Each row with the parameters of its environment; rows without one keep nulls."""
    table = environment_table(df.sparkSession).withColumnRenamed("environment", "__environment")
    return df.join(F.broadcast(table), F.col(environment) == F.col("__environment"), "left").drop("__environment")
