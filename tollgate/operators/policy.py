"""Governance policies on registered versions: tags, names, commits, environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import params as P


def tag_environment(versions: DataFrame, environment: str) -> DataFrame:
    """Attach the environment that trained the versions to be appended."""
    if environment not in P.ENVIRONMENTS:
        raise ValueError(f"unknown environment {environment!r}")
    return versions.withColumn("environment", F.lit(environment))


def missing_tag_prefixes(tags: str = "tags") -> Column:
    """The required prefixes that no tag starts with."""
    present = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    def absent(prefix: str) -> Column:
        return F.when(~F.exists(present, lambda tag: tag.startswith(prefix)), F.lit(prefix))
    return F.array_compact(F.array(*[absent(p) for p in P.REQUIRED_TAG_PREFIXES]))


def valid_name(name: str = "model") -> Column:
    valid = F.lit(False)
    for prefix in P.MODEL_NAME_PREFIXES:
        valid = valid | F.col(name).startswith(prefix)
    return valid


def has_commit(commit: str = "git_commit") -> Column:
    return F.coalesce(F.col(commit), F.lit("")) != ""


def governance_sweep(versions: DataFrame) -> DataFrame:
    """All three policies for every registered version, as warnings: one projection, nothing fails."""
    missing, named, commit = missing_tag_prefixes(), valid_name(), has_commit()
    return versions.where(F.col("number").isNotNull()).select(
        "model", "number",
        missing.alias("missing_prefixes"),
        named.alias("name_ok"),
        commit.alias("commit_ok"),
        ((F.size(missing) > 0).cast("int") + (~named).cast("int")).alias("warnings"),
    )
