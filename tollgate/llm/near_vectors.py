"""Near-duplicate vectors by sorted projection passes.

In every pass each vector gets a key, the sides of random directions on which it lies, and all vectors are sorted by it. A
direction is cut at the median of a sample's vectors of the same cell so far, so a dense group far from the origin is
halved as well as any. Each block of ``BLOCK`` vectors is compared within itself and with the next one.
What hangs together there is noted as stars, fewer pairs than rows, and the stars of all passes are united. All links lie
within the components found; they are counted there, tile by tile, each pair of classes once and no pair as a row. A run
of copies of any length is a chain of blocks in the passes and a number of tiles in the count; no group grows with it.

The number of passes is not fixed. ``PLANTED`` sampled vectors get a partner at just the threshold in a random direction, which
takes part in the passes and joins nothing. Passes are doubled until the share ``RECALL`` of the partners has been linked
with its vector or that one's component. A random direction tells all differences of one length apart alike, so the
partners stand for the hardest links wherever the table has mass; links above the threshold are easier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.components import components
from tollgate.llm.vectors import by_width, dots, matrix, norms, usable
from tollgate.sources.artifacts import materialize, settle

PASSES, BLOCK, TILE = 8, 512, 2048
#: Blocks of one task's group; only the one that follows them is sent a second time.
SPAN = 8
#: Vectors sampled for the cuts, and numbers in them; sampled vectors that a cell of the sample holds at least.
SAMPLE, SAMPLE_NUMBERS, LEAST = 16_384, 4_000_000, 8
#: Planted partners, and the share of them that must be found before passes end.
PLANTED, RECALL = 1000, 0.999
#: Passes after which all tiles are compared instead, so that a table that no direction tells apart comes to an end.
MOST_PASSES = 256
_FOUND = "a long, b long, planted boolean"


class Cuts:
    """The key of one pass: random directions, each with a cut at the median of the sampled vectors of the same cell.

    ``levels`` cuts halve the sample down to ``LEAST`` vectors; the ``more`` that follow have one cut per cell of those.
    """

    def __init__(self, units: np.ndarray, levels: int, more: int, seed: int):
        self.axes = np.random.default_rng(seed).normal(size=(units.shape[1], levels + more + 1))
        places, cell = units @ self.axes, np.zeros(len(units), np.int64)
        self.cuts = []
        for k in range(levels):
            self.cuts.append(_medians(places[:, k], cell, 1 << k))
            cell = 2 * cell + (places[:, k] >= self.cuts[-1][cell])
        self.rest = np.stack([_medians(places[:, levels + k], cell, 1 << levels) for k in range(more)]) if more else np.zeros((0, 1 << levels))

    def keys(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its place on one more direction, which orders the vectors of a cell."""
        places, cell = units @ self.axes, np.zeros(len(units), np.int64)
        for k, cut in enumerate(self.cuts):
            cell = 2 * cell + (places[:, k] >= cut[cell])
        key = cell
        for k, cut in enumerate(self.rest):
            key = 2 * key + (places[:, len(self.cuts) + k] >= cut[cell])
        return key, places[:, -1]


def _medians(places: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """The upper median of each cell; zero where a cell has none."""
    order = np.lexsort((places, cell))
    counts = np.bincount(cell, minlength=cells)
    at = np.cumsum(counts) - counts + counts // 2
    return np.where(counts > 0, np.append(places[order], 0.0)[at], 0.0)


def _project(cuts: list[tuple[int, Cuts]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(1))
            units = vectors / norms(vectors)[:, None]
            for p, cut in cuts:
                key, place = cut.keys(units)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(key), pa.int32()), pa.array(key), pa.array(place), batch.column(0)],
                                                 names=["pass", "key", "place", "rep"])
    return run


def plant(units: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each unit vector a partner at just the threshold, in a random direction."""
    step = np.random.default_rng(seed).normal(size=units.shape)
    step -= (step * units).sum(axis=1, keepdims=True) * units
    long = np.sqrt((step ** 2).sum(axis=1, keepdims=True))
    cosine = min(1.0, threshold + 1e-6)
    return cosine * units + np.sqrt(1 - cosine ** 2) * step / np.where(long > 0, long, 1)


def _linked(vectors: np.ndarray, size: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``rows`` link with which of ``others``; what lies at the threshold is settled by exact products."""
    cosines = (vectors[rows] / size[rows, None]) @ (vectors[others] / size[others, None]).T
    linked = cosines >= threshold
    i, j = np.nonzero(np.abs(cosines - threshold) < 1e-9)
    if len(i):
        x, y = rows[i], others[j]
        linked[i, j] = dots(vectors[x], vectors[y]) >= threshold * (size[x] * size[y])
    return linked


def stars(linked: np.ndarray) -> np.ndarray:
    """For each column the first column that it hangs together with; the rows are the first columns."""
    m, k = linked.shape
    root, open_ = np.arange(k), linked.sum(axis=1) > linked[:, :m].diagonal()
    fresh = np.ones(k, bool)
    for first in range(m):
        rows = np.array([first])
        while open_[rows].any():
            rows = rows[open_[rows]]
            open_[rows] = False
            columns = np.flatnonzero(linked[rows].any(axis=0) & fresh)
            root[columns], fresh[columns] = first, False
            rows = np.union1d(columns[columns < m], np.flatnonzero(linked[:, columns].any(axis=1)))
    return root


def _join(threshold: float):
    """What hangs together in each leading block and the next one, each vector paired with one of its block: fewer pairs than rows.

    A planted vector (``of`` is the one that it was made from) joins nothing. It gives one row, ``planted``, if it links here:
    with its maker if that is here, else with its nearest.
    """
    def run(table: pa.Table) -> pa.Table:
        blocks, ids, lead = table.column("block").to_numpy(), table.column("rep").to_numpy(), table.column("lead").to_numpy()
        of = table.column("of").fill_null(0).to_numpy()
        made = ~table.column("of").is_null().to_numpy()
        vectors = matrix(table.column("vector"))
        size = norms(vectors)
        pairs, met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for block in np.unique(blocks[lead]).tolist():
            own, rest = np.flatnonzero((blocks == block) & ~made), np.flatnonzero((blocks == block + 1) & ~made)
            order, extra = np.concatenate([own, rest]), np.flatnonzero(made & ((blocks == block) | (blocks == block + 1)))
            root = stars(_linked(vectors, size, own, order, threshold))
            moved = np.flatnonzero(root != np.arange(len(root)))
            a, b = ids[order[root[moved]]], ids[order[moved]]
            pairs.append((np.minimum(a, b), np.maximum(a, b)))
            if len(extra) and len(order):
                linked = _linked(vectors, size, extra, order, threshold)
                near = np.where(linked, (vectors[extra] / size[extra, None]) @ (vectors[order] / size[order, None]).T, -2)
                near[linked & (ids[order] == of[extra][:, None])] = 2
                # Vectors that both lie in the next block meet when that is the first.
                near[np.ix_(blocks[extra] > block, blocks[order] > block)] = -2
                best = near.argmax(axis=1)
                got = np.flatnonzero(near[np.arange(len(extra)), best] > -2)
                met.append((ids[extra[got]], ids[order[best[got]]]))
        a, b = (np.concatenate([x[k] for x in pairs + met]) for k in (0, 1))
        return pa.table([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(a) - sum(len(x) for x, _ in met))], names=["a", "b", "planted"])
    return run


def _count(threshold: float):
    """Links between two tiles of a component, or within one: per vector the rows that it links with, no pairs."""
    def run(table: pa.Table) -> pa.Table:
        ids, tile, group, weight = (table.column(c).to_numpy() for c in ("rep", "tile", "component", "size"))
        vectors = matrix(table.column("vector"))
        size, n = norms(vectors), np.zeros(len(ids), np.int64)
        low = table.column("low")[0].as_py()
        same = low == table.column("high")[0].as_py()
        others = np.arange(len(ids)) if same else np.flatnonzero(tile != low)
        rows = others if same else np.flatnonzero(tile == low)
        for at in range(0, len(rows), BLOCK):
            part = rows[at:at + BLOCK]
            linked = _linked(vectors, size, part, others, threshold) & (group[part][:, None] == group[others])
            if same:
                linked &= part[:, None] != others
            else:
                n[others] += weight[part] @ linked
            n[part] += linked @ weight[others]
        return pa.table([pa.array(ids), pa.array(n)], names=["a", "n"])
    return run


def _count_links(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``a, linked``: for each class the rows of other classes of its component that it links with.

    A component of more than ``TILE`` classes is dealt over tiles by hash, and each two tiles are one task's group; smaller
    ones share groups of about as many rows. A pair of classes is compared once here, however many passes it met in.
    """
    linked = materialize(classes.join(labels.withColumnRenamed("node", "id"), "id").select("rep", "component", "size", "vector"), "linked")
    large = linked.groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")).where("tiles > 1")
    buckets = linked.count() // TILE + 1
    # At most one row for each TILE rows.
    dealt = linked.join(F.broadcast(large), "component", "left").withColumn(
        "bucket", F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("component"), F.lit(buckets)))).withColumn(
        "owner", F.when(F.col("tiles").isNotNull(), F.col("component"))).withColumn(
        "tile", F.coalesce(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles")), F.lit(0)).cast("int"))
    both = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).select(
        "bucket", "owner", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "rep", "component", "size", "vector")
    got = both.groupBy("bucket", "owner", "low", "high").applyInArrow(_count(threshold), "a long, n long")
    return got.groupBy("a").agg(F.sum("n").alias("linked"))


def _pass_links(vectors: DataFrame, cuts: list[tuple[int, Cuts]], threshold: float) -> DataFrame:
    """Stars of the blocks of some passes, and what planted vectors met."""
    spark = vectors.sparkSession
    keyed = vectors.select("rep", "vector").mapInArrow(_project(cuts), "pass int, key long, place double, rep long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "pass", "key", "place", "rep").sortWithinPartitions("pass", "key", "place", "rep").select(
        "pass", "rep", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    dealt = materialize(dealt, "sorted")
    counts = dealt.groupBy("pass", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pass").orderBy("part")) - F.col("n")
    # At most one row per partition and one more per pass.
    starts = F.broadcast(counts.select("pass", "part", (before - F.col("low")).alias("move")))
    place = ((F.col("at") + F.col("move")) / F.lit(BLOCK)).cast("int").alias("block")
    blocks = dealt.join(starts, ["pass", "part"]).select("pass", place, "rep")
    blocks = materialize(blocks.join(vectors, "rep"), "blocks")
    group = F.floor(F.col("block") / SPAN).cast("int")
    own = blocks.select("pass", group.alias("group"), "block", F.lit(True).alias("lead"), "rep", "of", "vector")
    after = blocks.where((F.col("block") % SPAN == 0) & (F.col("block") > 0)).select(
        "pass", (group - 1).alias("group"), "block", F.lit(False).alias("lead"), "rep", "of", "vector")
    return materialize(own.unionByName(after).groupBy("pass", "group").applyInArrow(_join(threshold), _FOUND).distinct(), "links")


def _all_tiles(vectors: DataFrame, threshold: float) -> DataFrame:
    """What passes give, from all pairs of tiles: exact, each two tiles one task's group, and quadratic in their number."""
    tiles = vectors.count() // BLOCK + 1
    dealt = vectors.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(tiles)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    first = F.col("tile") <= F.col("with")
    both = dealt.select(F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), F.when(first, 0).otherwise(1).alias("block"),
                        first.alias("lead"), "rep", "of", "vector")
    return materialize(both.groupBy("low", "high").applyInArrow(_join(threshold), _FOUND).distinct(), "links")


def _recall(links: DataFrame, planted: DataFrame, ids: DataFrame, same: DataFrame) -> tuple[float, DataFrame]:
    """The share of planted vectors that met their maker or its component, and the components of the real ones.

    Components are of ids: a class stands for its smallest id, and an id with several vectors is a node of several classes.
    """
    named = links.where("not planted").join(ids.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(
        ids.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = materialize(components(named.unionByName(same)), "labels")
    met = links.where("planted").select(F.col("a").alias("rep"), "b").join(F.broadcast(planted.select("rep", "of")), "rep")
    where = lambda rep, name: ids.select(F.col("rep").alias(rep), F.col("id").alias("node")).join(labels, "node", "left").select(
        rep, F.coalesce("component", "node").alias(name))
    found = met.join(where("b", "x"), "b").join(where("of", "y"), "of").where("x = y").select("rep").distinct().count()
    n = planted.count()
    return found / n if n else 1.0, labels


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                 passes: int = PASSES, seed: int = 101) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Equal vectors are one class, compared once: a member links with all others of its class and of the classes that it
    links with. Null, zero and broken vectors (see ``usable``) have no links and are their own component; so does a null
    id, whose component is null and which is not kept by that name. Rows that repeat an id are counted as rows. Vectors of
    different widths are not compared: each width is a table of its own (an id with vectors of two widths has a row for each).
    """
    return settle(vectors.sparkSession, lambda: _near_vectors(vectors, threshold, id_col, vector_col, passes, seed), "near-vectors")


def _near_vectors(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, passes: int, seed: int) -> DataFrame:
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    done = by_width(rows, lambda same: _of_one_width(same, threshold, passes, seed))
    if done is None:
        done = rows.sparkSession.createDataFrame([], "id long, n_links long, component_id long")
    done = materialize(done, "done")
    # The rows that take no part, as often as they stand in the table.
    every = vectors.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    out = every.join(done.groupBy("id").agg(F.count("*").alias("m")), "id", "left").withColumn(
        "n", F.col("n") - F.coalesce("m", F.lit(0))).where("n > 0").withColumn("again", F.explode(F.expr("sequence(1, n)")))
    rest = out.join(done.groupBy("id").agg(F.min("component_id").alias("c")), "id", "left").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _of_one_width(rows: DataFrame, threshold: float, passes: int, seed: int) -> DataFrame:
    """``id, n_links, component_id`` of vectors that take part and have one width."""
    spark = rows.sparkSession
    classes = materialize(rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("size")).select(
        F.xxhash64("vector", "id").alias("rep"), "id", "size", "vector"), "classes")
    ids = classes.select("rep", "id")
    members = rows.join(classes.select("vector", "rep", F.col("id").alias("class_id"), "size"), "vector").select("id", "rep", "class_id", "size")
    members = materialize(members, "members")
    several = members.groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a != z").select("id", "a")
    same = materialize(members.join(several, "id").select("a", F.col("class_id").alias("b")), "same")

    # The sample: at most SAMPLE vectors and SAMPLE_NUMBERS numbers on the driver.
    n = classes.count()
    width = classes.select(F.size("vector")).first()[0] if n else 1
    some = classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // width))).select("rep", "vector").toArrow()
    reps = some.column("rep").to_numpy()[:PLANTED]
    units = matrix(some.column("vector")) if n else np.zeros((0, 1))
    units = units / norms(units)[:, None]
    depth = max(0, math.ceil(math.log2(max(1, n) / BLOCK))) + 3
    levels = min(depth, int(math.log2(max(1, len(units) / LEAST))))
    partners = plant(units[:PLANTED], threshold, seed - 1)
    planted = spark.createDataFrame([(-1 - i, int(r), v) for i, (r, v) in enumerate(zip(reps, partners.tolist(), strict=True))],
                                    "rep long, of long, vector array<double>")
    every_one = materialize(classes.select("rep", F.lit(None).cast("long").alias("of"), "vector").unionByName(planted), "planted")

    links, done_passes, more = None, 0, passes
    while True:
        cuts = [(p, Cuts(units, levels, depth - levels, seed + p)) for p in range(done_passes, done_passes + more)]
        got = _pass_links(every_one, cuts, threshold)
        done_passes, more = done_passes + more, done_passes + more
        links = got if links is None else materialize(links.unionByName(got).distinct(), "links")
        recall, labels = _recall(links, planted, ids, same)
        if recall >= RECALL:
            break
        if done_passes >= MOST_PASSES:
            _, labels = _recall(_all_tiles(every_one, threshold), planted, ids, same)
            break
    linked = _count_links(classes, labels, threshold)
    return members.join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id"))
