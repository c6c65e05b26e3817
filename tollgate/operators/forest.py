"""A forest as a table of nodes, and scores from that table without the library that trained it.

A row is a node: its tree, number (0 is the root), feature and cut, the two nodes below it, and how the training rows that
reached it were shared out. The table can be read, compared and scored by anything that reads Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tollgate.session import work_folder

#: The deepest tree that can be trained.
DEEPEST = 30


def forest_nodes(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``tree, node, feature, cut, left, right, rows, share``: every node of the forest, from its stored form.

    A value up to the cut goes left. A leaf has neither feature nor nodes below. ``rows`` counts training rows as often
    as they were drawn; ``share`` is that of class 1.
    """
    spark = df.sparkSession
    path = work_folder(spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    node, inner = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    names = F.array(*[F.lit(f) for f in features])
    stats = node["impurityStats"]
    total = F.reduce(stats, F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"),
        F.when(inner, F.get(names, node["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        F.when(inner, node["leftChild"]).alias("left"), F.when(inner, node["rightChild"]).alias("right"),
        total.cast("long").alias("rows"), (F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / total).alias("share"))


def score_nodes(df: DataFrame, nodes: DataFrame, keep: Sequence[str], deepest: int = DEEPEST) -> DataFrame:
    """Kept columns, prediction and probability of class 1: the mean share of the leaves that a row reaches.

    Every row walks down all trees in one projection, as many steps as the forest has levels. The nodes travel as one row, whose
    size is that of the forest and not of the data; rows are not shuffled. A feature that is null goes right, as nothing says it
    lies below the cut; an empty forest scores null.
    """
    inner = nodes.where("left IS NOT NULL OR feature IS NOT NULL").select("tree", "node", "feature", "left", "right").collect()
    features = sorted({r["feature"] for r in inner if r["feature"] is not None})
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int") - 1 if features else F.lit(None).cast("int")
    fields = F.struct("node", place.alias("feature"), "cut", "left", "right", "share")
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(fields)).alias("nodes"))
    forest = trees.agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("__trees"))
    values = F.array(*[F.col(f).cast("double") for f in features]) if features else F.array(F.lit(None).cast("double"))
    rows = df.withColumn("__values", values).crossJoin(F.broadcast(forest))  # one row

    def leaf(tree):
        def step(node, _):
            down = F.when(F.get(F.col("__values"), node["feature"]) <= node["cut"], node["left"]).otherwise(node["right"])
            return F.when(node["left"].isNull(), node).otherwise(tree["nodes"][down])

        return F.reduce(F.array_repeat(F.lit(0), _levels(inner, deepest)), tree["nodes"][0], step)["share"]

    shares = F.transform("__trees", leaf)
    scored = rows.withColumn("__p", F.reduce(shares, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("__trees"), F.lit(0)))
    return scored.select(*keep, (F.col("__p") > 0.5).cast("int").alias("prediction"), F.col("__p").alias("probability"))


def _levels(inner: Sequence[Row], deepest: int) -> int:
    """Steps from the root to the deepest leaf of any tree, at most ``deepest``."""
    below = {(r["tree"], r["node"]): [(r["tree"], r["left"]), (r["tree"], r["right"])] for r in inner if r["left"] is not None}
    at, levels = {(tree, 0) for tree, _ in below}, 0
    while levels < deepest and (at := {n for node in at for n in below.get(node, ())}):
        levels += 1
    return levels
