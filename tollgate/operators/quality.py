"""Data-quality measures, gate, column profile and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import flag_sum, is_missing, ratio


WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}  # all other fixed types have 8 bytes


class QualityError(ValueError):
    """A data-quality check did not pass."""


def _row_hash(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """256 bits that tell rows apart: four hashes over values and null marks, each with its own first value.

    A zero and a negative zero are equal, as are all NaN: adding 0.0 and folding NaN gives equal rows equal hashes.
    """
    def canonical(name: str) -> Column:
        if df.schema[name].dataType.typeName() in ("double", "float"):
            return F.when(F.isnan(name), F.lit(float("nan"))).otherwise(F.col(name) + F.lit(0.0))
        return F.col(name)

    cells = [part for c in columns for part in (F.isnull(c), canonical(c))]
    return [F.xxhash64(F.lit(i), *cells).alias(f"__hash{i}") for i in range(4)]


def _distinct_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group and distinct row: its number, and the missing cells of all its copies.

    Only hashes and two counts go through the shuffle, and copies combine on the map side. Two different rows share all
    256 bits with a probability that no table reaches.
    """
    cells = sum((F.when(is_missing(df, c), 1).otherwise(0) for c in columns), F.lit(0))
    hashed = df.select(*by, *_row_hash(df, [c for c in columns if c not in by]), cells.alias("__missing"))
    return hashed.groupBy(*by, *[f"__hash{i}" for i in range(4)]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__missing").alias("missing"))


def repeated_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group: how many rows repeat an earlier row over all ``columns``. Groups without repeats have no row."""
    copies = _distinct_rows(df, columns, by).where("n > 1").groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))
    return copies if by else copies.select(F.coalesce("duplicate_rows", F.lit(0)).cast("bigint").alias("duplicate_rows"))


def missing_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and missing cells in one pass."""
    cells = sum((F.when(is_missing(df, c), 1).otherwise(0) for c in columns), F.lit(0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("missing_cells"))


def quality_measures(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing cells, missing fraction and repeated rows; one row per group, or one row in all.

    One scan and one narrow shuffle: all three follow from the counts of the distinct rows.
    """
    measures = _distinct_rows(df, columns, by).groupBy(*by).agg(
        *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name) for x, name in (
            (F.col("n"), "n_rows"), (F.col("missing"), "missing_cells"), (F.col("n") - 1, "duplicate_rows"))])
    cells = F.col("n_rows") * len(columns)
    return measures.select("*", ratio(F.col("missing_cells"), cells).alias("missing_fraction"))


def quality_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What the gate needs of one part of a table, to be stored with it: one row of 256 bits and two counts per distinct row."""
    return _distinct_rows(df, columns, [])


def merged_measures(states: DataFrame, columns: int) -> DataFrame:
    """The measures of the whole table from the states of its parts, one after the other in ``states``; rows that repeat across parts are found."""
    hashes = [f"__hash{i}" for i in range(4)]
    rows = states.groupBy(*hashes).agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"))
    measures = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name) for x, name in (
        (F.col("n"), "n_rows"), (F.col("missing"), "missing_cells"), (F.col("n") - 1, "duplicate_rows"))])
    return measures.select("*", ratio(F.col("missing_cells"), F.col("n_rows") * columns).alias("missing_fraction"))


def quality_verdict(measures: DataFrame, min_rows: int | Column = P.MIN_ROWS,
                    max_missing: float = P.MAX_MISSING_FRACTION) -> DataFrame:
    """Add the checks in their order and the first one that fails. Repeated rows only warn."""
    limit = F.lit(min_rows) if isinstance(min_rows, int) else min_rows
    rows_pass = F.col("n_rows") >= limit
    missing_pass = F.col("missing_fraction") <= max_missing
    return measures.select(
        *measures.columns,
        rows_pass.alias("rows_pass"),
        missing_pass.alias("missing_pass"),
        (F.col("duplicate_rows") > 0).alias("duplicate_warning"),
        F.when(~rows_pass, "min_rows").when(~missing_pass, "missing_fraction").alias("first_failure"),
        (rows_pass & missing_pass).alias("passed"),
    )


def require_quality(df: DataFrame, columns: Sequence[str], min_rows: int = P.MIN_ROWS,
                    max_missing: float = P.MAX_MISSING_FRACTION) -> DataFrame:
    """Return the input unchanged, or raise. One aggregated row reaches the driver."""
    row = quality_verdict(quality_measures(df, columns), min_rows, max_missing).first()
    if row.first_failure == "min_rows":
        raise QualityError(f"{row.n_rows} rows, at least {min_rows} needed")
    if row.first_failure == "missing_fraction":
        raise QualityError(f"{row.missing_fraction:.2%} of the cells are missing, at most {max_missing:.2%} allowed")
    return df


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column from one pass: type, missing count and percentage, bytes of its values, and the table's shape.

    Bytes are those of the values that are there: a fixed width per type, the encoded length of text.
    """
    columns = list(columns or df.columns)

    def size(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        each = F.octet_length(name) if kind in ("string", "binary") else F.lit(WIDTHS.get(kind, 8))
        return F.coalesce(F.sum(F.when(F.col(name).isNotNull(), each)), F.lit(0)).cast("bigint").alias(f"{name}__bytes")

    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[flag_sum(is_missing(df, c)).alias(c) for c in columns],
                    *[size(c) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(c).alias("missing_count"), F.col(f"{c}__bytes").alias("n_bytes"))
        for c in columns
    ])
    return counts.select("n_rows", F.inline(cells)).select(
        "column", "dtype", "missing_count",
        F.when(F.col("n_rows") > 0, F.col("missing_count") / F.col("n_rows") * 100).alias("missing_pct"),
        "n_bytes", "n_rows", F.lit(len(columns)).alias("n_cols"))


def report_rows(measures: DataFrame, dataset: Column, min_rows: Column, max_missing: float = P.MAX_MISSING_FRACTION) -> DataFrame:
    """The three checks of each measured table as report rows: dataset, check, threshold, actual, result."""
    def row(check: str, threshold: Column, actual: Column, result: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), threshold.cast("double").alias("threshold"),
                        actual.cast("double").alias("actual"), result.alias("result"))

    outcome = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    none = F.lit(None)
    rows = F.array(
        row("minimum_rows", min_rows, F.col("n_rows"), outcome(F.col("n_rows") >= min_rows)),
        row("missing_values", F.lit(max_missing), F.col("missing_fraction"),
            outcome(F.col("missing_fraction") <= max_missing)),
        row("duplicate_rows", none, F.col("duplicate_rows"), F.when(F.col("duplicate_rows") > 0, "WARNING").otherwise("OK")),
    )
    return measures.select(dataset.alias("dataset"), F.inline(rows))


def split_min_rows(split: str = "split", min_rows: int = P.MIN_ROWS) -> Column:
    """The test part needs a fifth of the rows."""
    return F.when(F.col(split) == "test", F.lit(min_rows // P.TEST_ROWS_DIVISOR)).otherwise(F.lit(min_rows))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def resample_decision(df: DataFrame, label: str = "label", enabled: bool = True,
                      threshold: float = P.IMBALANCE_THRESHOLD) -> DataFrame:
    """Share of the rarest class, and whether to add rows: only if enabled and below the threshold."""
    share = F.min("n") / F.nullif(F.sum("n"), F.lit(0))
    return class_distribution(df, label).agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("labelled_rows"),
        share.alias("minority_ratio"),
    ).withColumn("resample", F.lit(enabled) & F.coalesce(F.col("minority_ratio") < threshold, F.lit(False)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any null or NaN in the columns."""
    return df.dropna("any", subset=list(columns) if columns else None)
