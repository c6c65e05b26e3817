"""Synthetic minority rows between near neighbours (SMOTE), with every choice made by a key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import key_hash
from tollgate.operators.neighbours import LEAF_ROWS, hashed_nearest, nearest
from tollgate.operators.quality import resample_decision
from tollgate.operators.split import rank_cuts
from tollgate.sources.artifacts import materialize


def _hash_number(text: Column, salt: str) -> Column:
    """32 bits of the hash as a number."""
    return F.conv(F.substring(key_hash(text, salt), 1, 8), 16, 10).cast("bigint")


def smote(df: DataFrame, key: str, features: Sequence[str], label: str = "label", k: int = P.SMOTE_NEIGHBOURS,
          seed: int = P.SEED, leaf_rows: int = LEAF_ROWS, hashed: bool = False) -> DataFrame:
    """The table with synthetic rows added to every other class until it is as large as the largest.

    The wanted rows are dealt evenly over the class, the remainder to the first rows in hash order. Each synthetic row
    lies between its base row and one of the base row's k nearest rows of the same class. Returns key (as text),
    features, label and ``synthetic``; the original rows are unchanged. Classes stay in tables, however many there are. A
    null or NaN feature of a labelled row raises; rows without a label are passed on.

    With ``hashed`` the neighbours are those that :func:`hashed_nearest` finds, for tables of many columns or rows: work per row
    does not grow. A row then chooses among as many of the k as were found, and one with none found repeats itself.
    """
    held = df.where(F.col(label).isNotNull())
    missing = held.where(" OR ".join(f"`{f}` IS NULL OR isnan(`{f}`)" for f in features))
    if not missing.isEmpty():
        raise ValueError("features with null or NaN have no neighbours; drop or fill these rows first")
    counts = materialize(held.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")), "classes")
    largest = F.max("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wanted = materialize(counts.withColumn("wanted", largest - F.col("n")).where("wanted > 0"), "wanted")
    few = wanted.where(F.col("n") <= k).orderBy("label").first()
    if few:
        raise ValueError(f"class {few['label']} has {few['n']} rows, more than {k} are needed")
    columns = [F.col(key).cast("string").alias(key), *features, label]
    result = df.select(*columns, F.lit(False).alias("synthetic"))
    if wanted.isEmpty():
        return result
    members = materialize(held.join(wanted.select(F.col("label").alias(label)), label, "left_semi").select(key, *features, label), "members")
    made = _synthesize(members, key, features, label, k, seed, wanted, leaf_rows, hashed)
    return result.unionByName(made.withColumn("synthetic", F.lit(True)))


def _synthesize(members: DataFrame, key: str, features: Sequence[str], label: str, k: int, seed: int, wanted: DataFrame,
                leaf_rows: int, hashed: bool) -> DataFrame:
    """``wanted`` has the rows and the wanted rows of each class; all classes are made in one plan."""
    shares = wanted.select("label", F.expr("wanted div n").alias("each"), F.expr("wanted % n").alias("size"))
    cuts = rank_cuts(members, key, shares.select("label", "size"), f"{seed}|copies", label)
    plan = shares.join(cuts, "label").select(F.col("label").alias(label), "each", "last")
    extra = F.coalesce(key_hash(key, f"{seed}|copies") <= F.col("last"), F.lit(False)).cast("int")
    bases = members.join(plan, label).withColumn("__copies", (F.col("each") + extra).cast("int")).drop("each", "last").where(
        F.col("__copies") > 0)
    near = hashed_nearest(members, key, features, k, by=label) if hashed else nearest(members, key, features, k, leaf_rows, by=label)
    found = bases.join(near, [label, *features])
    dealt = found.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    name = F.concat(F.col(key).cast("string"), F.lit("#"), F.col("__copy").cast("string"))
    others = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col(key)), 1, k)
    place = F.pmod(_hash_number(name, f"{seed}|neighbour"), F.greatest(F.size(others), F.lit(1))).cast("int")
    step = _hash_number(name, f"{seed}|step") / F.lit(float(2**32))
    chosen = dealt.select(name.alias("__name"), label, *features, F.coalesce(F.get(others, place)["nx"], F.array(*[F.col(f).cast("double") for f in features])).alias("__nx"), step.alias("__u"))
    return chosen.select(
        F.col("__name").alias(key),
        *[(F.col(f) + F.col("__u") * (F.col("__nx")[i] - F.col(f))).alias(f) for i, f in enumerate(features)], label)


def balance(df: DataFrame, key: str, features: Sequence[str], label: str = "label", enabled: bool = True,
            threshold: float = P.IMBALANCE_THRESHOLD, seed: int = P.SEED) -> DataFrame:
    """SMOTE if enabled and the rarest class is below the threshold; otherwise the rows as they are."""
    if enabled and resample_decision(df, label, enabled, threshold).first()["resample"]:
        return smote(df, key, features, label, seed=seed)
    return df.select(F.col(key).cast("string").alias(key), *features, label, F.lit(False).alias("synthetic"))
