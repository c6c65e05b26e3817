"""Exact nearest neighbours within one table, without comparing all pairs.

Equal vectors are folded first. A small sample sets the cuts of a k-d tree, whose leaves then hold about equally many
distinct vectors. Each leaf answers its own vectors, which bounds how far their true neighbours can be; a vector is sent
to another leaf only if that leaf's box lies within this bound, which is asked from the root of the tree downwards. The
sample affects the balance, never the result.

The work grows with the leaves a bound reaches: few in low dimensions, most of them in high ones, where an exact answer
is close to all pairs by nature; ``hashed_nearest`` answers those approximately, from buckets of random projections.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.scalars import key_hash
from tollgate.sources.artifacts import materialize

# The helpers below travel with the tasks, so the executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 2_000
MAX_LEAVES = 16_384  # of all groups together; their sample comes to the driver
SAMPLE_PER_LEAF = 8
CHUNK_CELLS = 4_000_000
GROUP_ROWS = 20_000  # visits answered by one group, and rows that it looks at
#: Hashed form: tables of random projections, the rows a bucket should have, and further projections to split those with more.
TABLES, BUCKET_ROWS, SPLITS = 16, 500, 12


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order: the feature and the cut of every inner node."""

    feature: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.feature[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def build_tree(sample: np.ndarray, depth: int) -> Tree:
    """Cut each node at the median of its widest feature."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.zeros(inner)
    members = {0: sample}
    for node in range(inner):
        rows = members.pop(node)
        if len(rows):
            feature[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut[node] = float(np.median(rows[:, feature[node]]))
        right = rows[:, feature[node]] > cut[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return Tree(feature, cut, depth)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature in order, so that they equal the plain expression to the last bit."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return total


def _nearest_in(queries: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple]:
    """For blocks of queries: query numbers, row numbers and distances of the k nearest, ties by key."""
    block = max(1, CHUNK_CELLS // max(1, len(rows)))
    by_key = np.argsort(keys, kind="stable")
    rows = rows[by_key]
    width = min(k, len(rows))
    for start in range(0, len(queries), block):
        d = _squared(queries[start:start + block], rows)
        # Everything up to the k-th distance, in order of distance and key; the first k of each query.
        q, r = np.nonzero(d <= np.partition(d, width - 1, axis=1)[:, width - 1:width])
        order = np.lexsort((r, d[q, r], q))
        first = np.searchsorted(q, np.arange(len(d)))
        take = order[(first[:, None] + np.arange(width)).ravel()]
        yield np.arange(start, start + len(d)), by_key[r[take]].reshape(-1, width), d[q[take], r[take]].reshape(-1, width)


def _long(vids, query_rows: np.ndarray, found: np.ndarray, near: np.ndarray, keys) -> pd.DataFrame:
    width = found.shape[1]
    return pd.DataFrame({
        "vid": np.repeat(vids[query_rows], width),
        "neighbour": keys[found.ravel()],
        "distance2": near.ravel(),
    })


def _answer(keep: int):
    """The ``keep`` nearest rows of a group to each of its questions."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"vid": queries["vid"][:0], "neighbour": rows["key"][:0], "distance2": np.zeros(0)})
        keys, vids = rows["key"].to_numpy(), queries["vid"].to_numpy()
        parts = [_long(vids, q, near_rows, near, keys)
                 for q, near_rows, near in _nearest_in(_matrix(queries, "x"), _matrix(rows, "x"), keys, keep)]
        return pd.concat(parts)
    return run


def _matrix(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.array(pdf[column].tolist(), dtype=np.float64)


def nearest(df: DataFrame, key: str, features: Sequence[str], k: int, leaf_rows: int = LEAF_ROWS,
            by: str | None = None) -> DataFrame:
    """Per distinct vector the k + 1 nearest rows of the table by (distance, key), itself included.

    With ``by`` a row's neighbours are those of its own group, and the result has that column too. Returns the feature
    columns and ``near``: an ordered array of (distance2, neighbour, features). A row finds its own k neighbours by
    leaving itself out. Feature columns must hold no nulls. Leaves stop multiplying at MAX_LEAVES; from there on they
    grow, and the rows and the questions of a leaf are dealt over groups of GROUP_ROWS each, so no task grows.
    """
    keep = k + 1
    members = _members(df, key, features, keep, by)
    trees = _fit_trees(members.where("rank = 1"), leaf_rows)

    def leaf_of(parts: pd.Series, x: pd.Series) -> pd.Series:
        leaf = np.zeros(len(x), dtype=np.int64)
        for part in set(parts) & set(trees):
            at = np.flatnonzero(parts == part)
            leaf[at] = trees[part].leaf(np.array(x.iloc[at].tolist(), dtype=np.float64))
        return pd.Series(leaf)

    number = F.pandas_udf(leaf_of, T.LongType())("part", "x") if trees else F.lit(0).cast("long")
    placed = materialize(members.withColumn("leaf", number), "leaves")
    key_type, part_type = (members.schema[c].dataType.simpleString() for c in ("key", "part"))
    out = f"vid {key_type}, neighbour {key_type}, distance2 double"

    in_leaf = _answer(keep)
    rows = placed.select("part", "key", "x", "leaf")
    asked = placed.where("rank = 1").select("part", F.col("key").alias("vid"), "x", "leaf")
    local = materialize(_salted_cogroup(asked, rows, in_leaf, out), "local")
    found = local
    if trees:
        visits = materialize(_visits(asked, local, trees, _boxes(placed, trees, len(features)), keep, part_type), "visits")
        found = local.unionByName(_salted_cogroup(visits, rows, in_leaf, out))
    return _lists(found, members, asked, features, keep, by)


def _members(df: DataFrame, key: str, features: Sequence[str], keep: int, by: str | None) -> DataFrame:
    """``part, key, rank, x``. Of equal vectors only the first ``keep`` keys can be anyone's neighbour; Spark applies this
    limit before the shuffle."""
    group = F.col(by) if by else F.lit(0)
    same = Window.partitionBy("part", *features).orderBy("key")
    members = df.select(group.alias("part"), F.col(key).alias("key"), *features).withColumn("rank", F.row_number().over(same)).where(
        F.col("rank") <= keep)
    return materialize(
        members.select("part", "key", "rank", F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "vectors")


def _lists(found: DataFrame, members: DataFrame, asked: DataFrame, features: Sequence[str], keep: int, by: str | None) -> DataFrame:
    """Per distinct vector the ``keep`` nearest of what was found, with their features."""
    best = Window.partitionBy("vid").orderBy("distance2", "neighbour")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    with_x = top.join(members.select(F.col("key").alias("neighbour"), F.col("x").alias("nx")), "neighbour")
    lists = with_x.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance2", "neighbour", "nx"))).alias("near"))
    return lists.join(asked.select("vid", "part", "x"), "vid").select(
        *([F.col("part").alias(by)] if by else []), *[F.col("x")[i].alias(f) for i, f in enumerate(features)], "near")


def _projections(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, width))


def hashed_nearest(df: DataFrame, key: str, features: Sequence[str], k: int, by: str | None = None, tables: int = TABLES,
                   bucket_rows: int = BUCKET_ROWS, seed: int = 17) -> DataFrame:
    """As :func:`nearest`, but from buckets: the nearest of those rows that share one with the vector.

    In each of ``tables`` tables a row's bucket is the row of sides on which it lies of random projections, each cut at the median
    of its group. There are as many projections as give buckets of ``bucket_rows``; a bucket with more is split by up to
    ``SPLITS`` further ones. What is then still larger is a clump in every direction and is compared in full, dealt over groups of
    GROUP_ROWS. A vector looks at about ``tables * bucket_rows`` rows, whatever the table's size.

    Near neighbours of a few thousand vectors are found almost surely; the more projections a larger table needs, the more tables
    keep a recall. Fewer than k + 1 rows come back where a vector's buckets hold fewer.
    """
    keep = k + 1
    members = _members(df, key, features, keep, by)
    key_type, part_type = (members.schema[c].dataType.simpleString() for c in ("key", "part"))
    sizes = {r["part"]: r["n"] for r in members.where("rank = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    depth = max([0, *(int(np.ceil(np.log2(n / bucket_rows))) for n in sizes.values() if n > bucket_rows)])
    axes = _projections(len(features), tables, depth + SPLITS if depth else 0, seed)
    own = members.where("rank = 1")
    if not depth:
        placed = members.withColumns({"table": F.lit(0), "leaf": F.lit(0).cast("long")})
    else:
        cuts = _medians(own, axes)
        bits = axes.shape[1]

        def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _matrix(pdf, "x").reshape(len(pdf), -1)
                cut = np.stack([cuts.get(p, np.zeros(axes.shape[:2])) for p in pdf["part"]]) if len(pdf) else np.zeros((0, *axes.shape[:2]))
                for t in range(len(axes)):
                    code = ((x @ axes[t].T > cut[:, t]) << np.arange(bits - 1, -1, -1)).sum(axis=1)
                    yield pdf.assign(table=np.int32(t), code=code.astype(np.int64))

        coded = members.mapInPandas(sides, T.StructType([*members.schema.fields, T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType())]))
        placed = _split_buckets(materialize(coded, "codes"), sizes, bucket_rows, bits)
    rows = placed.select(F.struct("part", "table").alias("part"), "key", "x", "leaf")
    asked = placed.where("rank = 1").select(F.struct("part", "table").alias("part"), F.col("key").alias("vid"), "x", "leaf")
    found = _salted_cogroup(asked, rows, _answer(keep), f"vid {key_type}, neighbour {key_type}, distance2 double")
    return _lists(found.distinct(), members, own.select("part", F.col("key").alias("vid"), "x"), features, keep, by)


def _medians(own: DataFrame, axes: np.ndarray, sample: int = 4_096) -> dict[object, np.ndarray]:
    """Per group the median of each projection, from at most ``sample`` vectors of it in hash order."""
    first = Window.partitionBy("part").orderBy(key_hash("key", "median"))
    some = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).select("part", "x")

    def median(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf, "x").reshape(len(pdf), -1)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "cut": [np.median(x @ axes.reshape(-1, axes.shape[2]).T, axis=0)]})

    schema = T.StructType([own.schema["part"], T.StructField("cut", T.ArrayType(T.DoubleType()))])
    return {r["part"]: np.array(r["cut"]).reshape(axes.shape[:2]) for r in some.groupBy("part").applyInPandas(median, schema).collect()}


def _split_buckets(coded: DataFrame, sizes: dict, bucket_rows: int, bits: int) -> DataFrame:
    """``leaf`` for each row and table: the sides on as many projections as its bucket needs, at most all."""
    deep = {p: max(0, int(np.ceil(np.log2(n / bucket_rows)))) for p, n in sizes.items()}
    depths = coded.sparkSession.createDataFrame([(p, d) for p, d in deep.items()], T.StructType([coded.schema["part"], T.StructField("depth", T.IntegerType())]))
    # The number of projections leads the bits, so buckets of different depth do not mix.
    leaf = lambda depth: F.call_function("shiftright", F.col("code"), F.lit(bits) - depth) + F.call_function(
        "shiftleft", F.lit(1).cast("long"), depth)
    rows = coded.join(depths, "part").withColumn("leaf", leaf(F.col("depth")))
    for _ in range(SPLITS):
        large = materialize(rows.groupBy("part", "table", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * bucket_rows).select(
            "part", "table", "leaf", F.lit(1).alias("more")), "large")
        if large.isEmpty():
            break
        rows = rows.join(large, ["part", "table", "leaf"], "left").withColumn(
            "depth", F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(bits))).withColumn("leaf", leaf(F.col("depth"))).drop("more")
    return rows.select("part", "key", "rank", "x", "table", "leaf")


def _fit_trees(vectors: DataFrame, leaf_rows: int) -> dict[object, Tree]:
    """A tree for each group of more than ``leaf_rows`` vectors, from a hash sample of about SAMPLE_PER_LEAF per leaf. All groups
    are sampled in one query: SAMPLE_PER_LEAF * MAX_LEAVES vectors reach the driver at most, shared by size."""
    large = {r["part"]: r["n"] for r in vectors.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows).collect()}
    total = sum(large.values())
    depth = {p: int(np.ceil(np.log2(max(1.0, min(MAX_LEAVES * n / total, n / leaf_rows))))) for p, n in large.items()}
    limits = {p: f"{min(int(min(1.0, 2**depth[p] * SAMPLE_PER_LEAF / n) * 16**8), 16**8 - 1):08x}" for p, n in large.items() if depth[p]}
    if not limits:
        return {}
    table = vectors.sparkSession.createDataFrame(list(limits.items()), T.StructType([vectors.schema["part"], T.StructField("limit", T.StringType())]))
    picked = vectors.join(table, "part").where(F.substring(key_hash("key", "tree"), 1, 8) <= F.col("limit")).select("part", "x").collect()
    samples: dict[object, list] = {}
    for r in picked:
        samples.setdefault(r["part"], []).append(r["x"])
    return {p: build_tree(np.array(x, dtype=np.float64), depth[p]) for p, x in samples.items()}


def _boxes(placed: DataFrame, trees: dict, width: int) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Per group the smallest and largest value of every feature in each node of its tree, in heap order."""
    edges = [e for i in range(width) for e in (F.min(F.col("x")[i]).alias(f"lo{i}"), F.max(F.col("x")[i]).alias(f"hi{i}"))]
    boxes = {p: (np.full((2 ** (t.depth + 1) - 1, width), np.inf), np.full((2 ** (t.depth + 1) - 1, width), -np.inf)) for p, t in trees.items()}
    for r in placed.where(F.col("part").isin(list(trees))).groupBy("part", "leaf").agg(*edges).collect():
        low, high = boxes[r["part"]]
        node = 2 ** trees[r["part"]].depth - 1 + r["leaf"]
        low[node], high[node] = [r[f"lo{i}"] for i in range(width)], [r[f"hi{i}"] for i in range(width)]
    for low, high in boxes.values():
        for node in range(len(low) // 2 - 1, -1, -1):
            low[node] = np.minimum(low[2 * node + 1], low[2 * node + 2])
            high[node] = np.maximum(high[2 * node + 1], high[2 * node + 2])
    return boxes


def _reached(x: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Queries and the leaves whose box lies within their bound: down the tree, leaving out what an inner box excludes."""
    inner = len(low) // 2
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        outside = np.maximum(low[node] - x[at], 0) + np.maximum(x[at] - high[node], 0)
        # Slightly lowered, so that rounding can never leave out a leaf.
        at = at[(outside * outside).sum(axis=1) * (1 - 1e-9) <= bound[at]]
        if not len(at):
            continue
        if node < inner:
            stack += [(2 * node + 1, at), (2 * node + 2, at)]
        else:
            yield at, node - inner


def _visits(asked: DataFrame, local: DataFrame, trees: dict, boxes: dict, keep: int, part_type: str) -> DataFrame:
    """Each vector with every leaf of its group, but its own, that can hold a nearer neighbour."""
    found = local.groupBy("vid").agg(F.max("distance2").alias("furthest"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= keep, F.col("furthest")).otherwise(F.lit(float("inf")))
    bounded = asked.where(F.col("part").isin(list(trees))).join(found.select("vid", bound.alias("bound")), "vid").select(
        "part", "vid", "x", "leaf", "bound")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, rows in pdf.groupby("part", sort=False):
                x, own = _matrix(rows, "x").reshape(len(rows), -1), rows["leaf"].to_numpy()
                for at, leaf in _reached(x, rows["bound"].to_numpy(), *boxes[part]):
                    at = at[own[at] != leaf]
                    if len(at):
                        yield rows.iloc[at][["part", "vid", "x"]].assign(leaf=leaf)

    return bounded.mapInPandas(reach, T.StructType([bounded.schema[c] for c in ("part", "vid", "x", "leaf")]))


def _salted_cogroup(visits: DataFrame, rows: DataFrame, fn, out: str) -> DataFrame:
    """Answer the questions to each leaf. Those to a popular leaf are dealt over several groups, and so are the rows of a large
    one: every share of the questions meets every share of the rows, and the best of all answers count."""
    leaf = ["part", "leaf"]
    rows = rows.toDF(*rows.columns)  # columns of its own, where both sides come from one table
    shares = lambda df, name: df.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias(name))
    dealt = shares(visits, "shares").join(shares(rows, "pieces"), leaf)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = visits.join(dealt, leaf).withColumns({"share": F.pmod(F.xxhash64("vid"), F.col("shares")).cast("int"), "piece": all_of("pieces")}).select(
        *leaf, "share", "piece", "vid", "x")
    looked = rows.join(dealt, leaf).withColumns({"piece": F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"), "share": all_of("shares")}).select(
        *leaf, "share", "piece", "key", "x")
    return asked.groupBy(*leaf, "share", "piece").cogroup(looked.groupBy(*leaf, "share", "piece")).applyInPandas(fn, out)
