"""Near-duplicate documents: a Hamming join of b-bit min-hash signatures over several indexes, confirmed on full sets.

A document's signature holds 64 values of 16 bits, the low bits of its smallest shingle hashes under 64 hash functions.
The distance of two signatures is the number of values that differ; at a similarity of 0.75 it is 16 on average with
a standard deviation of 3.5. The signature is cut into 16 chunks of 4 values. Two signatures at a distance of at most 31
have a chunk with at most one error (16 chunks with two errors each would make 32), so each document is filed under
every chunk with every single value left out, 64 keys in all, and all pairs within that distance meet under some key.
31 is 4.3 standard deviations above the mean at 0.75, so fewer than 3 in 100,000 such links lie beyond it.

A Hamming distance over single bits was weighed and left: at 0.75 the threshold needs 3 errors in chunks of 16 bits, which
makes a sixth of all pairs candidates. Whole values of 16 bits keep the pigeonhole and its enumeration of errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.arrays import mix, runs_of, shingle_sets, slices, text_bytes
from tollgate.llm.components import components
from tollgate.sources.artifacts import materialize, settle

VALUES, CHUNKS, WIDTH = 64, 16, 4
#: The guaranteed distance: one error per chunk, and one more in each but the last would still leave a chunk with one.
DISTANCE = 2 * CHUNKS - 1
#: Rows compared at once; a larger group is dealt over tiles of this size, or over all pairs of them.
TILE = 512
#: Bytes of text on each side of a tile; a longer text is alone.
TILE_BYTES = 2 << 20
#: Ids that are sent to all tasks at most, to pick out their texts: some 40 MB.
IDS_SENT = 1_000_000

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def _signature(shingles: np.ndarray) -> np.ndarray:
    lowest = np.empty(VALUES, np.uint64)
    for at in range(0, VALUES, 8):
        lowest[at:at + 8] = (shingles[None, :] * _FACTORS[at:at + 8, None] >> np.uint64(16)).min(axis=1)
    return (mix(lowest) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array([_signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], names=["id", "n_shingles", "set_a", "set_b", "signature"])
    return run


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5) -> DataFrame:
    """``id, n_shingles, set_a, set_b, signature``: the size, two sums over hashes (equal for equal sets) and the signature."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sign(length), "id long, n_shingles long, set_a long, set_b long, signature binary")


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature under its 64 keys: the three values of a chunk that remain, hashed to 58 bits, and the chunk and place left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), CHUNKS, WIDTH).astype(np.uint64)
        for chunk in range(CHUNKS):
            for out in range(WIDTH):
                key = np.full(len(ids), chunk * WIDTH + out, np.uint64)
                for k in range(WIDTH):
                    if k != out:
                        key = mix((key << np.uint64(16) | values[:, chunk, k]) + np.uint64(k))
                key = key & ~np.uint64(63) | np.uint64(chunk * WIDTH + out)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], names=["key", "rep"])


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a smallest spanning tree over the signatures of each group, where they lie within the distance."""
    found: list[tuple[int, int]] = []
    for table in runs_of(batches, ["key", "low", "high"]):
        ids, values = table.column("rep").to_numpy(), _signatures(table)
        n = len(ids)
        near, by = np.full(n, VALUES + 1), np.zeros(n, np.int64)
        left = np.ones(n, bool)
        at = 0
        for _ in range(n - 1):
            left[at] = False
            away = (values != values[at]).sum(axis=1)
            closer = left & (away < near)
            near[closer], by[closer] = away[closer], at
            at = int(np.where(left, near, VALUES + 2).argmin())
            if near[at] <= DISTANCE and ids[at] != ids[by[at]]:
                found.append((int(ids[at]), int(ids[by[at]])))
        if len(found) >= 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def first_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first of the 64 keys that a signature shares with each of others; 64 if none."""
    same = (others == one).reshape(len(others), CHUNKS, WIDTH)
    wrong = WIDTH - same.sum(axis=2)
    # Without errors every key of a chunk is shared, the first of which leaves out place 0; with one, the one that leaves out the error.
    slot = np.where(wrong == 0, 0, same.argmin(axis=2)) + WIDTH * np.arange(CHUNKS)
    return np.where(wrong <= 1, slot, VALUES).min(axis=1)


class _Groups:
    """Which rows hang together so far: a label for each."""

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, k: int) -> bool:
        """Put two rows' groups together; false if they are."""
        one, two = self.labels[i], self.labels[k]
        if one == two:
            return False
        self.labels[self.labels == two] = one
        return True


def _near(table: pa.Table, percent: int, slot: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row the other rows in different parts that lie within the signature distance and are near enough in
    size, the closest first; with ``slot`` only those with which it shares no earlier key."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    parts, size, values = table.column("part").to_numpy(), table.column("n_shingles").to_numpy(), _signatures(table)
    other = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        near = other[(parts[other] != parts[i]) & (100 * np.minimum(size[i], size[other]) >= percent * np.maximum(size[i], size[other]))]
        away = (values[near] != values[i]).sum(axis=1)
        near = near[away <= DISTANCE][np.argsort(away[away <= DISTANCE], kind="stable")]
        if slot is not None and len(near):
            near = near[first_shared(values[i], values[near]) == slot]
        if len(near):
            yield i, near


def _across(percent: int):
    """What hangs together across the parts of each group by signatures: fewer pairs than rows.

    A pair that meets under several keys counts under the first of them only. Of groups with the same members the one under the first
    key is kept (see ``candidates``), so that one is always there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["key", "low", "high"]):
            ids = table.column("rep").to_numpy()
            groups, found = _Groups(ids), []
            for i, near in _near(table, percent, table.column("key")[0].as_py() & (VALUES - 1)):
                for label in np.unique(groups.labels[near]).tolist():
                    k = int(near[np.argmax(groups.labels[near] == label)]) if (groups.labels[near] == label).any() else i
                    if groups.join(i, k):
                        found.append((int(ids[i]), int(ids[k])))
            yield _pairs(found)
    return run


def _verify(length: int, percent: int):
    """Links across the parts of each family, confirmed on full sets, as far as they join what is still apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["key", "low", "high"]):
            ids, groups, found = table.column("rep").to_numpy(), _Groups(table.column("part").to_numpy()), []
            data, offsets = text_bytes(table.column("text"))
            sets = [s for i, j in slices(offsets) for s in shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)]
            for i, near in _near(table, percent):
                for k in near.tolist():
                    if groups.labels[i] != groups.labels[k] and _linked(sets[i], sets[k], percent):
                        groups.join(i, k)
                        found.append((int(ids[i]), int(ids[k])))
            yield _pairs(found)
    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])


def _confirm(length: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            a, b = batch.column(0), batch.column(1)
            for i, j in slices(left[1] + right[1]):
                one, two = (shingle_sets(d[o[i]:o[j]], o[i:j + 1] - o[i], length) for d, o in (left, right))
                keep = pa.array([_linked(x, y, percent) for x, y in zip(one, two, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.slice(i, j - i).filter(keep), b.slice(i, j - i).filter(keep)], names=["a", "b"])
    return run


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct texts of the wanted ids. Up to ``IDS_SENT`` ids go to the texts; beyond it both are shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    wanted = F.broadcast(wanted) if wanted.count() <= IDS_SENT else wanted
    return texts.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"])


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5,
            percent: int = 75) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have ``100 * intersection >= percent * union``."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(wanted, "wanted")
    texts = _texts(docs, wanted, id_col, text_col)
    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        _confirm(length, percent), "a long, b long").distinct()


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")


def _tiles(size: Column) -> Column:
    return F.ceil(size / F.lit(TILE)).cast("int")


def _once(members: DataFrame) -> DataFrame:
    """Every member in one tile of its group, and the group's first class in each tile of a large group."""
    tile = F.pmod(F.xxhash64("rep"), _tiles(F.col("size"))).cast("int")
    first = members.where((F.col("size") > TILE) & (F.col("rep") == F.col("first"))).withColumn(
        "low", F.explode(F.sequence(F.lit(0), _tiles(F.col("size")) - 1)))
    return _sorted(members.withColumn("low", tile).unionByName(first).withColumn("high", F.col("low")))


def _mixed(placed: DataFrame) -> DataFrame:
    """The members of groups in several parts, dealt so that each member outside its group's largest part meets all others:
    a group in one task, or for a large one every tile of the former with every tile of all. Tiles are bounded in rows and in bytes of text."""
    size = F.octet_length("text") if "text" in placed.columns else F.lit(0)
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    groups = counts.groupBy("key").agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("largest"),
        F.sum("size").alias("bytes"), F.max_by("size", F.struct("n", "part")).alias("of_largest"))
    groups = materialize(groups.where("all > most"), "mixed")
    rows = placed.join(groups, "key")
    tiles = lambda n, size: F.greatest(_tiles(n), F.ceil(size / F.lit(TILE_BYTES)).cast("int"))
    mine, every = tiles(F.col("all") - F.col("most"), F.col("bytes") - F.col("of_largest")), tiles(F.col("all"), F.col("bytes"))
    tile = F.xxhash64("rep")
    asks = rows.where("part != largest").withColumns({
        "asks": F.lit(True), "low": F.pmod(tile, mine).cast("int"), "high": F.explode(F.sequence(F.lit(0), every - 1))})
    others = rows.withColumns({
        "asks": F.lit(False), "low": F.explode(F.sequence(F.lit(0), mine - 1)), "high": F.pmod(tile, every).cast("int")})
    return _sorted(asks.unionByName(others).drop("all", "most", "largest", "bytes", "of_largest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5,
                    percent: int = 75) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Documents with equal sets are one class from the start. Under each key the classes of a group are joined by a
    smallest spanning tree, its edges are confirmed on full sets and united. Where a group is then still in several parts,
    its classes within the signature distance and in different parts hang together as families, and every such pair of a family
    is compared on full sets, so a pair is skipped only if its ends are already in one component, and the components are those of all links. Groups under different keys with the same
    members are compared once, and large groups over many tasks. A key is one of 64 that each class has, so a group that holds
    a third of all classes is less than a hundredth of the rows that are dealt by key.

    A document without words (null, empty or white space) has size 0 and links with nothing. A null id takes no part: its
    component is null and it is not kept by that name. Rows that repeat an id are one document with several texts.
    Ties do not matter. Other columns are not looked at. Hashes of 64 bits stand for words and shingles: two of a billion different ones
    are equal with odds of 1 to 37, and that changes one set by one element.
    """
    return settle(docs.sparkSession, lambda: _near_duplicates(docs, id_col, text_col, length, percent), "near-documents")


def candidates(classes: DataFrame) -> DataFrame:
    """``key, size, first, rep, n_shingles, signature``: classes (rep, n_shingles, signature) by the keys they share with
    others; of several groups with the same members one."""
    filed = classes.select("rep", "signature").mapInArrow(_file, "key long, rep long")
    groups = filed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
    # Written, so that the join's sides are plain exchanges, whose larger partitions Spark can split.
    filed = materialize(filed.join(materialize(groups, "groups"), "key"), "filed")
    mark = F.xxhash64("rep")
    marks = filed.groupBy("key", "size").agg(F.sum(F.shiftright(mark, 32)).alias("upper"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("lower"))
    first = F.struct(F.col("key").bitwiseAND(VALUES - 1), "key")
    once = marks.groupBy("size", "upper", "lower").agg(F.min(first)["key"].alias("key")).select("key")
    return filed.join(once, "key").join(classes.select("rep", "n_shingles", "signature"), "rep")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, length: int, percent: int) -> DataFrame:
    signed = materialize(sign(docs, id_col, text_col, length), "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    known = signed.where("id is not null and n_shingles > 0")
    classes = materialize(known.groupBy(*sets).agg(
        F.min("id").alias("rep"), F.max("id").alias("last"), F.first("signature").alias("signature")), "classes")
    members = materialize(candidates(classes), "members")

    tree = materialize(_once(members.drop("n_shingles")).mapInArrow(_tree, "a long, b long").distinct(), "tree")
    links = materialize(confirm(tree, docs, id_col, text_col, length, percent), "confirmed")
    # An id with several texts is a node of several classes.
    rows = known.join(classes.select(*sets, "rep"), sets).select("id", "rep")
    several = rows.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("id", "a")
    same = rows.join(several, "id").select("a", F.col("rep").alias("b"))
    parts = materialize(components(links.unionByName(same)), "parts")

    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n_shingles", "signature", F.coalesce("component", "rep").alias("part"))
    across = materialize(_mixed(placed).mapInArrow(_across(percent), "a long, b long").distinct(), "across")
    # What hangs together by signatures is a family; its texts are sent to its tiles and compared there.
    family = components(across).select(F.col("node").alias("rep"), F.col("component").alias("key"))
    family = materialize(family.join(placed.select("rep", "part").distinct(), "rep"), "family")
    texts = _texts(docs, family.select(F.col("rep").alias("id")).distinct(), id_col, text_col).withColumnRenamed("id", "rep")
    whole = family.join(classes.select("rep", "n_shingles", "signature"), "rep").join(texts, "rep")
    whole = materialize(whole.select("key", "rep", "n_shingles", "signature", "part", "text"), "whole")
    more = materialize(_mixed(whole).mapInArrow(_verify(length, percent), "a long, b long").distinct(), "confirmed")
    if not more.isEmpty():
        parts = components(parts.toDF("a", "b").unionByName(more))

    labels = parts.withColumnRenamed("node", "rep")
    of_set = classes.join(labels, "rep", "left").select(*sets, F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(of_set, sets, "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
