"""Feature tables read from Parquet, each with an explicit key column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_KEY = "o_orderkey"
ORDER_FEATURES = ("o_totalprice", "n_lines", "avg_discount", "avg_quantity", "avg_tax")
DOCUMENT_FEATURES = ("n_chars", "digit_frac", "space_frac", "nl_frac", "upper_frac", "punct_frac")
LARGE_ORDER = 250_000
RARE_LARGE_ORDER = 300_000


def read_labelled(spark: SparkSession, path: str, key: str, features: Sequence[str], label: str = "label",
                  file_format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A feature table with its key and binary label from Parquet, CSV, JSON or any other source format."""
    reader = spark.read.format(file_format).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path).select(
        key, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("label"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(name: str) -> Column:
    """A two-decimal amount as a whole number, so that sums are exact in any order."""
    return F.rint(F.col(name) * 100).cast("bigint")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order key; the partial sums run before the shuffle, so a hot order costs one row per task."""
    sums = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            *[F.sum(_cents(c)).alias(c) for c in ("l_discount", "l_quantity", "l_tax", "l_extendedprice")],
        )
    )
    mean = lambda c: F.col(c) / F.lit(100.0) / F.col("lines")
    return sums.select(
        "l_orderkey",
        F.col("lines").cast("double").alias("n_lines"),
        mean("l_discount").alias("avg_discount"),
        mean("l_quantity").alias("avg_quantity"),
        mean("l_tax").alias("avg_tax"),
        F.col("l_extendedprice").alias("price_cents"),
    )


def order_features(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Orders that have lines, with their features, the price in cents and any ``extra`` order columns."""
    orders = table(spark, folder, "orders").select(ORDER_KEY, "o_totalprice", *extra)
    lines = order_lines(spark, folder)
    return orders.join(lines, F.col(ORDER_KEY) == F.col("l_orderkey")).drop("l_orderkey")


def large_order(spark: SparkSession, folder: str, limit: int = LARGE_ORDER) -> DataFrame:
    """Labelled orders: label 1 iff the line prices sum to more than ``limit``."""
    return order_features(spark, folder).select(
        ORDER_KEY, *ORDER_FEATURES, (F.col("price_cents") > limit * 100).cast("int").alias("label")
    )


def noise_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The same features with a label they say nothing about: the gates must fail here."""
    closed = order_features(spark, folder, "o_orderstatus").where(F.col("o_orderstatus").isin("F", "O"))
    return closed.select(ORDER_KEY, *ORDER_FEATURES, (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def toxic_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Character shares of the whole text of each labelled document; few rows have label 1."""
    size = F.length("text").cast("double")

    def share(characters: str) -> Column:
        kept = F.length(F.translate("text", characters, ""))
        return F.coalesce((size - kept) / F.nullif(size, F.lit(0.0)), F.lit(0.0))

    # The shares come before the join: texts never go through a shuffle.
    shares = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        share("0123456789").alias("digit_frac"),
        share(" ").alias("space_frac"),
        share("\n").alias("nl_frac"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper_frac"),
        share(".,;:!?").alias("punct_frac"),
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return shares.join(labels, "doc_id")


def wide_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as an array of DOUBLE: 64 features, more than the limit above which components are used."""
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


def dirty_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with nulls, NaN and repeated rows put in by a hash of the row's content."""
    lines = table(spark, folder, "lineitem")
    content = F.concat_ws("|", *[F.col(c).cast("string") for c in
                                 ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                          F.rint(F.col("l_quantity")).cast("bigint").cast("string"), _cents("l_extendedprice").cast("string"))
    byte = lambda i: F.substring("__hash", 2 * i + 1, 2)
    spoiled = lines.withColumn("__hash", F.md5(content)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(byte(0) < "1a", None).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(byte(1) < "0d", F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(byte(2) < "05", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return spoiled.withColumn("copy", F.explode("copies")).drop("copies", "copy")
