"""Version lookup, stages, promotion chain and rollback over append-only registry tables.

Nothing here collects a model's versions into one group: every choice among versions is a max with a condition, which
combines on the map side, and neighbours in a chain are found by joining on (model, number, seq), which is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import run_url
from tollgate.operators.gates import apply_gate, metric_columns


def _newest(condition: Column | None = None) -> Column:
    return F.max("number") if condition is None else F.max(F.when(condition, F.col("number")))


def newest_first(versions: DataFrame, rows: int = P.LISTING_ROWS, by: str = "updated") -> DataFrame:
    """The registry listing: newest first, as many as the page has."""
    return versions.orderBy(F.col(by).desc(), F.col("model"), F.col("number").desc()).limit(rows)


def newest_per_model(versions: DataFrame, rows: int = P.LISTING_ROWS, by: str = "updated") -> DataFrame:
    """The listing of every model at once. Spark applies the rank limit before the shuffle, so a model with very many
    versions costs each task ``rows`` rows."""
    newest = Window.partitionBy("model").orderBy(F.col(by).desc(), F.col("number").desc())
    return versions.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= rows)


def latest_with_metrics(versions: DataFrame, metrics: DataFrame, prefer: str | None = "staging") -> DataFrame:
    """Per model the newest version with all gated metrics, first among those of the preferred environment."""
    complete = metric_columns(metrics).dropna("any", subset=list(P.GATED_METRICS)).select("model", "number")
    usable = versions.select("model", "number", "environment").join(complete, ["model", "number"])
    preferred = _newest(F.col("environment") == prefer) if prefer else F.lit(None).cast("int")
    return usable.groupBy("model").agg(preferred.alias("preferred"), _newest().alias("any_environment")).select(
        "model",
        F.coalesce("preferred", "any_environment").alias("number"),
        F.col("preferred").isNull().alias("fallback"),
    )


def latest_trained_in(versions: DataFrame, environment: str = "staging") -> DataFrame:
    """Per model the newest version trained in the environment; null if it has none."""
    return versions.groupBy("model").agg(_newest(F.col("environment") == environment).alias("number"))


def stage_holders(versions: DataFrame) -> DataFrame:
    """Per model the newest version of all, and the one in each stage."""
    return versions.groupBy("model").agg(
        _newest().alias("latest"),
        _newest(F.col("stage") == "staging").alias("staging"),
        _newest(F.col("stage") == "production").alias("production"),
    )


def look_up(wanted: DataFrame, versions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Resolve requests (model, version, from_stage): the version given wins over the stage, then the newest with metrics.

    Not found is null, with ``found`` false, whichever way was asked for.
    """
    holders = stage_holders(versions)
    measured = latest_with_metrics(versions, metrics).select("model", F.col("number").alias("measured"))
    existing = versions.select("model", F.col("number").alias("version"), F.lit(True).alias("exists"))
    resolved = (
        wanted.join(existing, ["model", "version"], "left").join(holders, "model", "left").join(measured, "model", "left")
    )
    by_stage = (
        F.when(F.col("from_stage") == "latest", F.col("latest"))
        .when(F.col("from_stage") == "staging", F.col("staging"))
        .when(F.col("from_stage") == "production", F.col("production"))
    )
    number = (
        F.when(F.col("version").isNotNull(), F.when(F.col("exists"), F.col("version")))
        .when(F.col("from_stage").isNotNull(), by_stage)
        .otherwise(F.col("measured"))
    )
    how = F.when(F.col("version").isNotNull(), "version").when(F.col("from_stage").isNotNull(), "stage").otherwise("metrics")
    return resolved.select(
        *wanted.columns, how.alias("chosen_by"), number.alias("number"), number.isNotNull().alias("found"))


def comparison_pair(versions: DataFrame, run_versions: DataFrame | None = None) -> DataFrame:
    """Per model the champion (in staging) and challenger (newest trained in staging).

    Each falls back to the version that the comparing run itself trained or was given (``run_versions``: model, number, one row for a
    model), and without one to the newest.
    """
    trained = latest_trained_in(versions).select("model", F.col("number").alias("trained"))
    pairs = stage_holders(versions).join(trained, "model")
    own = F.lit(None).cast("int")
    if run_versions is not None:
        pairs, own = pairs.join(run_versions.select("model", F.col("number").alias("own")), "model", "left"), F.col("own")
    return pairs.select(
        "model",
        F.coalesce("staging", own, "latest").alias("champion"),
        F.coalesce("trained", own, "latest").alias("challenger"),
    )


def occupancy(candidates: DataFrame, versions: DataFrame, target: str, force: bool = False) -> DataFrame:
    """Whether other versions hold the target stage, and what follows: free, blocked, or the others are demoted.

    ``occupant`` is the newest other holder. Archived has no limit on its versions.
    """
    if target == "archived":
        return candidates.select("model", "number", F.lit(target).alias("target"), F.lit(None).cast("int").alias("occupant"),
                                 F.lit("free").alias("outcome"))
    # The two newest holders of each model: the newest other one is among them.
    holders = versions.where(F.col("stage") == target).groupBy("model").agg(_newest().alias("newest"))
    second = versions.where(F.col("stage") == target).join(holders, "model").where(
        F.col("number") != F.col("newest")).groupBy("model").agg(_newest().alias("second"))
    other = F.when(F.col("newest") != F.col("number"), F.col("newest")).otherwise(F.col("second"))
    outcome = F.when(other.isNull(), "free").otherwise("demote" if force else "blocked")
    return candidates.select("model", "number").join(holders, "model", "left").join(second, "model", "left").select(
        "model", "number", F.lit(target).alias("target"), other.alias("occupant"), outcome.alias("outcome"))


def next_seq(events: DataFrame) -> DataFrame:
    return events.groupBy("model", "number").agg((F.max("seq") + 1).alias("next_seq"))


def stage_events(moves: DataFrame, events: DataFrame, workspace: str = P.DEV_WORKSPACE,
                 first_seq: Column | None = None) -> DataFrame:
    """Entries to append for moves (model, number, from_stage, to_stage, ts, training_run_id), numbered after the old ones."""
    numbered = moves.join(next_seq(events), ["model", "number"], "left")
    return numbered.select(
        "model", "number",
        (F.coalesce(F.col("next_seq"), F.lit(0)) + (F.lit(0) if first_seq is None else first_seq)).alias("seq"),
        F.lit("promoted").alias("action"),
        F.lit(workspace).alias("workspace"),
        F.coalesce("from_stage", F.lit("none")).alias("from_stage"),
        "to_stage", "ts",
        run_url(F.lit(workspace), F.col("training_run_id")).alias("training_run_url"),
    )


def promote(candidates: DataFrame, versions: DataFrame, events: DataFrame, target: str, ts: Column,
            force: bool = True, workspace: str = P.DEV_WORKSPACE) -> DataFrame:
    """Entries that promote the candidates (model, number), at most one per model, to the target stage.

    With ``force`` every other version that held the stage is archived in the same append, so a stage has one holder at
    any time; without it a candidate whose target is held gets no entry. This looks at no gate: see ``promotion_flow``.
    """
    state = versions.select("model", "number", F.col("stage").alias("from_stage"), "training_run_id")
    verdict = occupancy(candidates, versions, target, force).where(F.col("outcome") != "blocked")
    promoted = verdict.select("model", "number", F.lit(target).alias("to_stage"))
    demoting = verdict.where(F.col("outcome") == "demote").select("model", F.col("number").alias("candidate"))
    demoted = versions.where(F.col("stage") == target).join(demoting, "model").where(
        F.col("number") != F.col("candidate")).select("model", "number", F.lit("archived").alias("to_stage"))
    moves = promoted.unionByName(demoted).join(state, ["model", "number"]).withColumn("ts", ts)
    return stage_events(moves, events, workspace)


def promotion_decisions(wanted: DataFrame, versions: DataFrame, metrics: DataFrame, target: str, force: bool = False,
                        skip_validation: bool = False) -> DataFrame:
    """One row per request (model, version, from_stage): the version found, the gate's verdict, the stage's occupant and
    the decision: promoted, not found, refused by the gate, or blocked by the occupant.

    The version of a request without version and stage is the newest with metrics. ``skip_validation`` leaves the gate
    out, ``force`` demotes the occupants.
    """
    found = look_up(wanted, versions, metrics)
    existing = found.where("found").select("model", "number").distinct()
    gate = apply_gate(existing, metrics, P.STAGE_GATES[target]).select("model", "number", "outcome", "failures")
    held = occupancy(existing, versions, target, force).select("model", "number", "occupant", F.col("outcome").alias("place"))
    passed = F.lit(True) if skip_validation else F.col("outcome") == "PASS"
    decision = (
        F.when(~F.col("found"), "not found").when(~passed, "refused").when(F.col("place") == "blocked", "blocked")
        .otherwise("promoted")
    )
    return found.join(gate, ["model", "number"], "left").join(held, ["model", "number"], "left").select(
        "model", "number", "chosen_by", F.lit(target).alias("target"),
        F.col("outcome").alias("gate"), "failures", "occupant", decision.alias("decision"))


def promotion_flow(wanted: DataFrame, versions: DataFrame, metrics: DataFrame, events: DataFrame, target: str, ts: Column,
                   force: bool = False, skip_validation: bool = False,
                   workspace: str = P.DEV_WORKSPACE) -> tuple[DataFrame, DataFrame]:
    """Look up, validate, check the stage, and append: the decisions, and the entries that the promoted ones add."""
    decisions = promotion_decisions(wanted, versions, metrics, target, force, skip_validation)
    accepted = decisions.where("decision = 'promoted'").select("model", "number")
    return decisions, promote(accepted, versions, events, target, ts, force, workspace)


def current_stage(events: DataFrame) -> DataFrame:
    """Per version the stage its last entry set."""
    return events.groupBy("model", "number").agg(
        F.max_by("to_stage", "seq").alias("stage"), F.max("seq").alias("seq"), F.max("ts").alias("since"))


def chains(events: DataFrame) -> DataFrame:
    """The chain of each version as one ordered array. A version's chain holds its stage changes only."""
    fields = ["seq", *[c for c in events.columns if c not in ("model", "number", "seq")]]
    return events.groupBy("model", "number").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("chain"))


def stage_history(events: DataFrame) -> DataFrame:
    """Each entry with the stage before it, the time of the next entry and the days between; null for the last.

    Neighbours are those in order of ``seq``, whether or not it has gaps. A window holds one version's stage changes.
    """
    chain = Window.partitionBy("model", "number").orderBy("seq")
    return events.select(
        "model", "number", "seq", "action", F.lag("to_stage").over(chain).alias("previous_stage"),
        F.col("to_stage").alias("stage"), "ts", F.lead("ts").over(chain).alias("until"),
        F.lead("seq").over(chain).isNull().alias("is_last"),
    ).select(
        "model", "number", "seq", "action", "previous_stage", "stage", "ts", "until",
        F.date_diff("until", "ts").alias("days_in_stage"), "is_last")


def last_actions(events: DataFrame) -> DataFrame:
    """Per version the last entry's action, and whether it was an import."""
    return events.groupBy("model", "number").agg(F.max_by("action", "seq").alias("last_action")).withColumn(
        "imported", F.col("last_action") == "imported")


def rollback_targets(versions: DataFrame) -> DataFrame:
    """Per model the version in production and the two candidates to go back to.

    ``target``: the version just below by number if it exists, else the highest archived one below.
    ``previous``: the highest one below in any stage.
    """
    production = stage_holders(versions).select("model", F.col("production").alias("current"))
    below = versions.join(production, "model").where(F.col("number") < F.col("current"))
    eligible = (F.col("stage") == "archived") | (F.col("number") == F.col("current") - 1)
    found = below.groupBy("model").agg(_newest(eligible).alias("target"), _newest().alias("previous"))
    return production.join(found, "model", "left")


def rollback_plan(versions: DataFrame, to_version: int | None = None, reason: str | None = None,
                  triggered_by: str = "rollback") -> DataFrame:
    """One row per model: the planned rollback, or why there is none. Writing nothing is the dry run."""
    targets = rollback_targets(versions)
    if to_version is not None:
        exists = versions.where(F.col("number") == to_version).select("model", F.col("number").alias("explicit"))
        targets = targets.join(exists, "model", "left").withColumn("target", F.col("explicit")).drop("explicit")
    outcome = (
        F.when(F.col("current").isNull(), "no production version")
        .when(F.col("target").isNull(), "no target version")
        .when(F.col("target") == F.col("current"), "target is in production")
        .otherwise("planned")
    )
    return targets.select(
        "model", outcome.alias("outcome"),
        F.col("current").alias("from_version"), F.col("target").alias("to_version"),
        F.lit(reason or P.DEFAULT_REASON).alias("reason"),
        F.lit(triggered_by).alias("triggered_by"),
    )


def rollback_events(plan: DataFrame, versions: DataFrame, events: DataFrame, ts: Column,
                    workspace: str = P.PRODUCTION_WORKSPACE) -> DataFrame:
    """The two stage changes of each planned rollback, for one append: promote the target, archive the current one."""
    planned = plan.where(F.col("outcome") == "planned")
    moves = planned.select("model", F.inline(F.array(
        F.struct(F.col("to_version").alias("number"), F.lit("production").alias("to_stage")),
        F.struct(F.col("from_version").alias("number"), F.lit("archived").alias("to_stage")),
    )))
    state = versions.select("model", "number", F.col("stage").alias("from_stage"), "training_run_id")
    return stage_events(moves.join(state, ["model", "number"]).withColumn("ts", ts), events, workspace)
