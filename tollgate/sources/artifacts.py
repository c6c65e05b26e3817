"""Cut points: tables, models and manifests written to shared storage and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.session import run_folder, work_folder

CHAIN_ENTRY = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("workspace", T.StringType()),
    T.StructField("from_workspace", T.StringType()),
    T.StructField("to_workspace", T.StringType()),
    T.StructField("from_stage", T.StringType()),
    T.StructField("to_stage", T.StringType()),
    T.StructField("from_version", T.IntegerType()),
    T.StructField("model_version_url", T.StringType()),
    T.StructField("training_run_url", T.StringType()),
    T.StructField("import_run_url", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("export_timestamp", T.StringType()),
    T.StructField("export_path", T.StringType()),
    T.StructField("source", T.StructType([
        T.StructField("workspace", T.StringType()),
        T.StructField("model_version", T.IntegerType()),
        T.StructField("model_version_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("model_version_url", T.StringType()),
        T.StructField("training_run_url", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ])),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("artifacts", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("scaler", T.StringType()),
    ])),
    T.StructField("promotion_chain", T.ArrayType(CHAIN_ENTRY)),
])


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write Parquet. With partition columns the rows are rebalanced by them first: few files for a small partition,
    and a large one is split over several tasks."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    This cuts the lineage at a copy on shared storage: a lost executor costs a file read, not the whole plan, and the
    readers keep column pruning and filter pushdown.
    """
    path = write_table(df, work_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write the table that ``build`` makes, remove the cut points it made on its way, and read the table back."""
    path = work_folder(spark, name)
    with run_folder(spark, f"{name}-steps"):
        df = build()
        write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def write_manifests(manifests: DataFrame, path: str) -> str:
    """One JSON text per row. Absent fields stay absent; the text is written as it is."""
    manifests.select("manifest").write.mode("overwrite").text(path)
    return path


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def parse_manifest(raw: str = "manifest"):
    return F.from_json(F.col(raw), MANIFEST)


def save_model(model: PipelineModel, spark: SparkSession, name: str) -> str:
    path = work_folder(spark, name)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
