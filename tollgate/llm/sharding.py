"""Sharding by a histogram sort: exact byte counts below probe keys, refined until the splitters stand, one exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.sources.artifacts import materialize

#: Hex digits of each of the three parts of a key: the text, the id, the row.
PART = 16
#: Digits by which a round refines an open splitter: 256 probes each.
STEP = 2
#: Above every hex digit, so ``key + AFTER`` lies behind all keys that begin with ``key``.
AFTER = "g"


def shard_key(text: Column, identity: Column) -> Column:
    """Equal texts stand side by side in the order of these keys; rows that agree in both are told apart by number."""
    part = lambda c: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, PART)
    return F.concat(part(text), part(identity), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), PART, "0"))


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[str]:
    """Keys at which shards 1, 2, ... begin. The driver sees at most 256 counts per open splitter and round.

    Each round counts the bytes below all probes, the next two digits after each open splitter's known prefix, and goes
    on in the range that holds the splitter's target. When that range is one group of equal texts, the splitter takes
    the nearer edge of the group if it is within ``tolerance`` of a shard's mean bytes; else the search goes on inside
    the group down to the nearest row edge.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    goals = {i: total * i / shards for i in range(1, shards)}
    found: dict[int, str] = {} if total else dict.fromkeys(goals, AFTER)
    prefix, below = dict.fromkeys(goals, ""), dict.fromkeys(goals, 0)
    while len(found) < len(goals):
        probes = sorted({prefix[i] for i in goals if i not in found})
        probe = reduce(lambda rest, p: F.when(F.col("key").startswith(p), F.substring("key", 1, len(p) + STEP)).otherwise(rest),
                       probes, F.lit(None).cast("string"))
        counts = keyed.withColumn("probe", probe).where("probe is not null").groupBy("probe").agg(
            F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("probe").collect()
        for i in [i for i in goals if i not in found]:
            at = below[i]
            for row in (r for r in counts if r["probe"].startswith(prefix[i])):
                if at + row["bytes"] > goals[i]:
                    break
                at += row["bytes"]
            same = _common(row["low"], row["high"])
            edges = [(goals[i] - at, row["low"]), (at + row["bytes"] - goals[i], row["low"] + AFTER)]
            group = [(goals[i] - at, row["low"][:PART]), (at + row["bytes"] - goals[i], row["low"][:PART] + AFTER)]
            if same >= PART and len(prefix[i]) < PART and min(group)[0] <= slack:
                found[i] = min(group, key=lambda e: e[0])[1]
            elif same == len(row["low"]):
                found[i] = min(edges, key=lambda e: e[0])[1]
            else:
                prefix[i], below[i] = row["low"][:same], at
    return [found[i] for i in sorted(found)]


def shard_rows(rows: DataFrame, key: Column, size: Column, shards: int = 24, tolerance: float = 0.005) -> DataFrame:
    """``row`` (all columns of ``rows``), ``size, shard, slot``: shards of nearly equal bytes, slots gapless from 0.

    The rows given are written once with their keys, and exchanged once by ranges of the key; pass what the shards should
    hold. Neither a group of equal texts nor a repeated id nor equal rows make a large task: ranges are cut by whole keys,
    which are unique. Slots are a partition's row numbers moved by the counts of the partitions before, one count per
    partition and shard. An empty table gives none.
    """
    keyed = materialize(rows.select(F.struct("*").alias("row"), size.cast("long").alias("size"), key.alias("key")), "keyed")
    splitters = find_splitters(keyed, shards, tolerance)
    shard = reduce(lambda a, b: a + b, [(F.col("key") >= F.lit(s)).cast("int") for s in splitters], F.lit(0))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key").select(
        "row", "size", shard.alias("shard"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    dealt = materialize(dealt, "dealt")
    counts = dealt.groupBy("shard", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("shard", "part", (before - F.col("low")).alias("move"))
    # At most one row per partition and one more per shard.
    return dealt.join(F.broadcast(starts), ["shard", "part"]).select(
        "row", "size", "shard", (F.col("at") + F.col("move")).alias("slot"))
