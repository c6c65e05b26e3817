"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves and each half gets its own codebook, so ``codes ** 2`` cells are described by ``2 * codes``
centroids. A query walks pairs of centroids by the sum of its two distances, taken from a heap, until the cells it has
met hold the wanted share of all entries, and the entries of those cells are ranked by their exact cosine.

The codebooks are fitted on a bounded sample (``FIT_VECTORS``, smallest md5 of the id); every row is indexed. Cells are
packed into bundles of about ``BUNDLE`` rows; a cell with more is dealt over several. A bundle's rows meet the queries that
walk one of its cells, in chunks of ``CHUNK`` queries, and return at most k rows per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.vectors import by_width, dots, matrix, norms, usable
from tollgate.sources.artifacts import materialize

FIT_VECTORS = 20_000
CODES = 32
BUNDLE, CHUNK = 8_192, 20_000
#: A query walks cells that hold this share of all entries and this number of them on top.
SHARE, LEAST = 0.4, 2_000


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, units = self.first.shape[1], _two_halves(units)
        return tuple(((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))
                     for x, c in ((units[:, :half], self.first), (units[:, half:], self.second)))

    def cells(self, units: np.ndarray) -> np.ndarray:
        one, two = self.distances(units)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)


def _two_halves(units: np.ndarray) -> np.ndarray:
    """A single component gets a zero beside it, so that there are two halves."""
    return np.hstack([units, np.zeros((len(units), 1))]) if units.shape[1] == 1 else units


def _centroids(points: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[random.permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        nearest = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, weights=points[:, k], minlength=len(centres)) for k in range(points.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def fit(vectors: DataFrame, codes: int = CODES, rows: int = FIT_VECTORS, rounds: int = 12, seed: int = 11) -> Codebooks | None:
    """Codebooks from a table ``id, vector`` of one width; None if it is empty."""
    sample = vectors.withColumn("by", F.md5(F.col("id").cast("string"))).orderBy("by", "vector").limit(rows)
    got = sample.select("vector").toArrow().column("vector")
    if not len(got):
        return None
    points = matrix(got)
    points = _two_halves(points / norms(points)[:, None])
    half = points.shape[1] // 2
    return Codebooks(_centroids(points[:, :half], codes, rounds, seed), _centroids(points[:, half:], codes, rounds, seed + 1))


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of the summed distance until they hold ``wanted`` entries; ``sizes`` has the entries of each cell."""
    rows, columns = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    first, second = one[rows].tolist(), two[columns].tolist()
    width, heap, cells, held = len(columns), [(first[0] + second[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * width + columns[j]
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        # (i, j + 1) follows (i, j), and (i + 1, 0) follows (i, 0): every pair enters the heap once.
        if j + 1 < width:
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
    return cells


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1))
            cells = shared.value.cells(vectors / norms(vectors)[:, None]) if len(vectors) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=["id", "vector", "cell"])
    return run


def _visit(shared, plan, wanted: int, chunks: int):
    """Each query once per bundle that holds one of its cells, with those cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, starts, parts = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(1))
            one, two = shared.value.distances(vectors / norms(vectors)[:, None])
            for k in range(batch.num_rows):
                seen: dict[int, list[int]] = {}
                for cell in walk(one[k], two[k], sizes, wanted):
                    for bundle in range(starts[cell], starts[cell] + parts[cell]):
                        seen.setdefault(int(bundle), []).append(cell)
                n = len(seen)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(seen), pa.int32()), pa.array([row.column(0)[0].as_py() % chunks] * n, pa.int32()),
                    pa.concat_arrays([row.column(0)] * n) if n else pa.array([], pa.int64()),
                    pa.concat_arrays([row.column(1)] * n) if n else pa.array([], pa.list_(pa.float64())),
                    pa.array(list(seen.values()), pa.list_(pa.int32()))], names=["bundle", "chunk", "query_id", "vector", "cells"])
    return run


def _rank(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if entries.num_rows and queries.num_rows:
            vectors, ids = matrix(entries.column("vector")), entries.column("id").to_numpy()
            size = norms(vectors)
            units = vectors / size[:, None]
            names, place = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
            for at in range(0, queries.num_rows, 128):
                part = queries.slice(at, 128)
                asked, query_ids = matrix(part.column("vector")), part.column("query_id").to_pylist()
                lengths = norms(asked)
                near = asked / lengths[:, None] @ units.T
                for q, cells in enumerate(part.column("cells").to_pylist()):
                    good = np.flatnonzero(np.isin(names, cells)[place] & (ids != query_ids[q]))
                    if len(good) > k:
                        close = near[q, good]
                        good = good[close >= np.partition(close, len(close) - k)[len(close) - k] - 1e-9]
                    exact = dots(asked[q:q + 1], vectors[good]) / (lengths[q] * size[good])
                    for o in np.lexsort((ids[good], -exact))[:k].tolist():
                        out.append((query_ids[q], int(ids[good[o]]), float(exact[o])))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64()], strict=True)],
                        names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            codes: int = CODES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found by cosine, for rows for which ``is_query(id)`` holds.

    Candidates are all rows but those with the query's id. Null, zero and broken vectors take no part (see ``usable``).
    Ties go to the smaller id. An id that repeats among queries is asked once, with its smallest vector; among
    candidates each row counts. With fewer than k candidates all are returned; an empty table returns nothing. Vectors of
    different widths are not compared: each width is searched by itself, and an id among queries of two widths is asked in both.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    found = by_width(rows, lambda same: _nearest(same, is_query, k, codes, share, least))
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest(rows: DataFrame, is_query, k: int, codes: int, share: float, least: int) -> DataFrame:
    spark = rows.sparkSession
    books = fit(rows, codes)
    shared = spark.sparkContext.broadcast(books)
    indexed = materialize(rows.mapInArrow(_assign(shared), "id long, vector array<double>, cell int"), "indexed")
    sizes = np.zeros(len(books.first) * len(books.second), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most codes ** 2 rows
        sizes[r["cell"]] = r["count"]
    parts = np.maximum(-(-sizes // BUNDLE), 1)
    starts, bundle, room = np.zeros(len(sizes), np.int64), -1, 0
    for cell in np.flatnonzero(sizes).tolist():
        if parts[cell] > 1:
            starts[cell], bundle, room = bundle + 1, bundle + int(parts[cell]), 0
        else:
            if sizes[cell] > room:
                bundle, room = bundle + 1, BUNDLE
            starts[cell], room = bundle, room - int(sizes[cell])
    total = int(sizes.sum())
    wanted = least + int(share * total) + k
    plan = spark.sparkContext.broadcast((sizes, starts, parts))
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"))
    chunks = queries.count() // CHUNK + 1
    visits = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").mapInArrow(
        _visit(shared, plan, wanted, chunks), "bundle int, chunk int, query_id long, vector array<double>, cells array<int>")

    at = spark.createDataFrame([(int(c), int(starts[c]), int(parts[c])) for c in np.flatnonzero(sizes)], "cell int, start int, parts int")
    # At most codes ** 2 rows.
    placed = indexed.join(F.broadcast(at), "cell").withColumn(
        "bundle", (F.col("start") + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts"))).cast("int"))
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("bundle", "chunk", "id", "vector", "cell")
    found = placed.groupBy("bundle", "chunk").cogroup(visits.groupBy("bundle", "chunk")).applyInArrow(
        _rank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
