"""Exact stratified train/test split and the fixed inference sample."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import key_hash
from tollgate.sources.artifacts import materialize

PREFIX_STEP = 3  # hex digits of a range of keys: 4096 ranges per class, and 4096 in the range that holds the cut
#: Up to so many classes the cuts are found by a few counts and are literals; with more they are tables.
LITERAL_CLASSES = 64
#: Hashes of the ranges that hold the cuts, fetched at most; larger ranges are counted more finely first.
RANGE_ROWS = 50_000


class SplitError(ValueError):
    """The table cannot be split by class."""


@dataclass(frozen=True)
class SplitCut:
    """Per class the last test row in hash order (null if it has none): rows up to it are test rows. A table, or literals."""

    key: str
    label: str
    seed: int
    cuts: DataFrame | None = None  # label, last
    literals: tuple[tuple[object, str | None], ...] = ()

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``split``, null where the label is: a comparison per row, or a join whose other side has one row per class."""
        h = key_hash(self.key, self.seed)
        if self.cuts is None:
            test = reduce(Column.__or__, [(F.col(self.label) == F.lit(c)) & (h <= last) for c, last in self.literals if last], F.lit(False))
            return df.withColumn("split", F.when(F.col(self.label).isNotNull(), F.when(test, "test").otherwise("train")))
        cuts = self.cuts.select(F.col("label").alias("__label"), F.col("last").alias("__last"))
        part = F.when(h <= F.col("__last"), "test").otherwise("train")
        joined = df.join(cuts, F.col(self.label) == F.col("__label"), "left")
        return joined.select(*df.columns, F.when(F.col(self.label).isNotNull(), part).alias("split"))


def class_test_sizes(counts: DataFrame, test_size: float) -> DataFrame:
    """Test rows per class from ``label, n``: the train part is shared out by largest remainder, the rest is test."""
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(every)
    shared = counts.select("label", "n", total.alias("total")).withColumn(
        "n_train", F.col("total") - F.ceil(F.lit(test_size) * F.col("total")))
    exact = F.col("n") * F.col("n_train") / F.col("total")
    shared = shared.withColumn("train", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "label"))
    more = (place <= F.col("n_train") - F.sum("train").over(every)).cast("int")
    return shared.select("label", "n", (F.col("n") - F.col("train") - more).alias("size"))


def fit_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = P.SEED) -> SplitCut:
    """Find each class's cut in hash order.

    The rank of a row among millions of its class is found by counting rows per hash prefix, twice, so that a range of a
    16-millionth of the class is left to be sorted. Classes of any number and size stay in tables; a class of any size is
    spread over all tasks. ``key`` is the row identity: a repeated key raises, whatever the size of the table.
    """
    held = df.where(F.col(label).isNotNull())
    if not held.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise SplitError(f"'{key}' is not unique")
    hashed = held.select(F.col(label).alias("label"), key_hash(key, seed).alias("h"))
    found = _ranges(hashed, PREFIX_STEP).limit(16**PREFIX_STEP * LITERAL_CLASSES + 1).collect()
    classes = {r["label"] for r in found}
    if len(classes) <= LITERAL_CLASSES and not any(c != c for c in classes):
        return SplitCut(key, label, seed, literals=_literal_cuts(hashed, found, test_size))
    hashed = materialize(hashed, "hashed")
    ranges = materialize(_ranges(hashed, PREFIX_STEP), "ranges")
    sizes = materialize(class_test_sizes(ranges.groupBy("label").agg(F.sum("n").alias("n")), test_size), "sizes")
    _refuse_small(r["label"] for r in sizes.where("n < 2").orderBy("label").limit(10).collect())
    return SplitCut(key, label, seed, materialize(_cuts(hashed, ranges, sizes.select("label", "size")), "cuts"))


def _refuse_small(labels) -> None:
    if small := list(labels):
        raise SplitError(f"classes with fewer than 2 rows, the first of them: {small}")


def _literal_cuts(hashed: DataFrame, found: list, test_size: float) -> tuple[tuple[object, str | None], ...]:
    """The cuts of few classes: the counts of the ranges say in which one a cut lies; that range is counted more finely until
    its hashes are few enough to be fetched and sorted."""
    counts: dict[object, int] = {}
    for r in found:
        counts[r["label"]] = counts.get(r["label"], 0) + r["n"]
    _refuse_small(sorted(c for c, n in counts.items() if n < 2)[:10])
    total = sum(counts.values())
    n_train = total - math.ceil(test_size * total)
    exact = {c: float(n * n_train) / total for c, n in counts.items()}
    train = {c: math.floor(x) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (-(exact[c] - train[c]), c))[:n_train - sum(train.values())]:
        train[c] += 1
    rank = {c: n - train[c] for c, n in counts.items() if n > train[c]}
    depth = PREFIX_STEP
    while rank:
        at, held = {}, 0
        for c in rank:
            for r in sorted((r for r in found if r["label"] == c), key=lambda r: r["prefix"]):
                if rank[c] <= r["n"]:
                    at[c], held = r["prefix"], held + r["n"]
                    break
                rank[c] -= r["n"]
        inside = hashed.where(reduce(Column.__or__, [(F.col("label") == F.lit(c)) & F.col("h").startswith(p) for c, p in at.items()]))
        if held <= RANGE_ROWS or depth >= 32:
            hashes: dict[object, list] = {}
            for r in inside.collect():
                hashes.setdefault(r["label"], []).append(r["h"])
            last = {c: sorted(hashes[c])[k - 1] for c, k in rank.items()}
            return tuple((c, last.get(c)) for c in counts)
        depth += PREFIX_STEP
        found = _ranges(inside, depth).collect()
    return tuple((c, None) for c in counts)


def _ranges(hashed: DataFrame, depth: int) -> DataFrame:
    return hashed.groupBy("label", F.substring("h", 1, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def _at(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per class the range that holds row number ``size``, and that row's number within it."""
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("prefix"))
    inside = ranges.join(sizes, "label").withColumn("before", upto - F.col("n"))
    inside = inside.where((F.col("before") < F.col("size")) & (F.col("size") <= F.col("before") + F.col("n")))
    return inside.select("label", "prefix", (F.col("size") - F.col("before")).alias("size"))


def _cuts(hashed: DataFrame, ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per class the hash of its row number ``size`` in hash order; null for size 0."""
    first = _at(ranges, sizes)
    near = hashed.withColumn("prefix", F.substring("h", 1, PREFIX_STEP)).join(first, ["label", "prefix"]).drop("prefix")
    second = _at(_ranges(near, 2 * PREFIX_STEP), first.select("label", "size"))
    last = near.drop("size").withColumn("prefix", F.substring("h", 1, 2 * PREFIX_STEP)).join(second, ["label", "prefix"])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    found = last.withColumn("rank", rank).where(F.col("rank") == F.col("size")).select("label", F.col("h").alias("last"))
    return sizes.select("label").join(found, "label", "left")


def rank_cuts(df: DataFrame, key: str, sizes: DataFrame, seed: object, label: str = "label") -> DataFrame:
    """``label, last``: per class the hash up to which exactly ``size`` of its rows lie, for sizes ``label, size``."""
    hashed = df.select(F.col(label).alias("label"), key_hash(key, seed).alias("h"))
    return _cuts(hashed, _ranges(hashed, PREFIX_STEP), sizes)


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = P.SEED) -> DataFrame:
    return fit_split(df, key, label, test_size, seed).assign(df)


def inference_sample(df: DataFrame, key: str, rows: int = P.INFERENCE_SAMPLE_ROWS, seed: int = P.SEED) -> DataFrame:
    """A fixed number of rows without replacement, the same on every run. Each task keeps its own top rows."""
    return df.orderBy(key_hash(key, seed), key).limit(rows)
