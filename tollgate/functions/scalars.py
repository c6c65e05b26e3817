"""Column expressions shared by the operators. All of them stay inside code generation on the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import params as P


def key_hash(key: str | Column, salt: object) -> Column:
    """A hex hash of the row key and a salt: the same on every run, engine and partitioning."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f"|{salt}")))


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, and for floating columns also NaN."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """numerator / denominator as DOUBLE, and ``empty`` when the denominator is 0."""
    return F.coalesce(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(empty))


def flag_sum(condition: Column) -> Column:
    """How many rows meet the condition, as a sum that combines on the map side and is 0 on no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def risk_tier(probability: str | Column) -> Column:
    """Tier of P(class 1), where class 1 is the harmless class: a low probability is a high risk."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p > P.TIER_LOW_ABOVE, "LOW").when(p > P.TIER_MEDIUM_ABOVE, "MEDIUM").otherwise("HIGH")


def reasons(rules: Iterable[tuple[str, str, float, str]]) -> Column:
    """Texts of the rules that hold, in rule order; an empty array if none does."""
    hits = []
    for field, comparison, limit, text in rules:
        holds = F.col(field) > limit if comparison == ">" else F.col(field) < limit
        hits.append(F.when(holds, F.lit(text)))
    return F.array_compact(F.array(*hits))


def round_probability(probability: str | Column, places: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(probability, places)


def short_id(key: str) -> Column:
    """Eight hex characters of the key's hash. Unlike a random id it is the same when a task is run again."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 8)


def three_places(value: Column) -> Column:
    """Number text with three decimals for gate messages."""
    return F.format_string("%.3f", F.bround(value, 3))


def text_or_null(template: str, **parts: Column) -> Column:
    """Fill a '{name}' template with columns; null if any part is null."""
    pieces, rest = [], template
    while "{" in rest:
        before, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        if before:
            pieces.append(F.lit(before))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def run_url(workspace: Column, run_id: Column, project: Column | None = None, base: str = P.REGISTRY_ADDRESS) -> Column:
    project = F.lit(P.PROJECT) if project is None else project
    return text_or_null(P.RUN_URL, base=F.lit(base), workspace=workspace, project=project, id=run_id)


def version_url(workspace: Column, version_id: Column, project: Column | None = None,
                base: str = P.REGISTRY_ADDRESS) -> Column:
    project = F.lit(P.PROJECT) if project is None else project
    return text_or_null(P.VERSION_URL, base=F.lit(base), workspace=workspace, project=project, id=version_id)
