"""Export manifests: build, validate, import, and link back to the source version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import run_url, version_url
from tollgate.operators.registry import chains
from tollgate.sources.artifacts import CHAIN_ENTRY, MANIFEST


def _entry(**values: Column) -> Column:
    """A chain entry in the fixed schema; fields not given are null."""
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHAIN_ENTRY.fields])


def _old_entry(e: Column) -> Column:
    kept = {c: e[c] for c in ("action", "workspace", "from_stage", "to_stage", "training_run_url")}
    return _entry(**kept, timestamp=e["ts"].cast("string"))


def metric_maps(metrics: DataFrame) -> DataFrame:
    """Metrics of a version as a map. A version has a handful of metrics."""
    return metrics.groupBy("model", "number").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def export_manifests(versions: DataFrame, metrics: DataFrame, events: DataFrame, exchange: str, exported_at: str,
                     workspace: str = P.DEV_WORKSPACE) -> DataFrame:
    """One manifest per version: source, metrics, artifacts, and the chain with an 'exported' entry at its end."""
    joined = (
        versions.join(metric_maps(metrics), ["model", "number"], "left")
        .join(chains(events), ["model", "number"], "left")
    )
    here = F.lit(workspace)
    link = version_url(here, F.col("version_id"))
    folder = F.concat(
        F.lit(f"{exchange}/exports/"), F.col("model"), F.lit(f"/{workspace}_to_production/"),
        F.col("number").cast("string"), F.lit(f"/{exported_at.replace(':', '-')}"))
    stage = F.coalesce("stage", F.lit("latest"))
    old = F.transform(F.col("chain"), _old_entry)
    exported = _entry(
        action=F.lit("exported"), from_workspace=here, from_stage=stage, from_version=F.col("number"),
        model_version_url=link, timestamp=F.lit(exported_at))
    chain = F.concat(F.coalesce(old, F.array().cast(f"array<{CHAIN_ENTRY.simpleString()}>")), F.array(exported))
    manifest = F.struct(
        F.col("model").alias("model_name"),
        F.lit(exported_at).alias("export_timestamp"),
        folder.alias("export_path"),
        F.struct(
            here.alias("workspace"),
            F.col("number").alias("model_version"),
            F.col("version_id").alias("model_version_id"),
            stage.alias("stage"),
            link.alias("model_version_url"),
            run_url(here, F.col("training_run_id")).alias("training_run_url"),
            F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        ).alias("source"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        F.struct(
            F.concat(folder, F.lit("/model")).alias("model"),
            F.when(F.col("has_scaler"), F.concat(folder, F.lit("/scaler"))).alias("scaler"),
        ).alias("artifacts"),
        chain.alias("promotion_chain"),
    )
    return joined.select("model", "number", manifest.alias("parsed"))


def manifest_json(manifests: DataFrame) -> DataFrame:
    """The JSON text of each manifest; null fields are left out."""
    return manifests.select("model", "number", F.to_json("parsed").alias("manifest"))


def _absent(required: tuple, present: Column) -> Column:
    names = F.array(*[F.lit(n) for n in required])
    return F.array_except(names, F.coalesce(present, F.array().cast("array<string>")))


def validate_manifests(manifests: DataFrame, raw: str = "manifest") -> DataFrame:
    """Presence of the required fields in the JSON text; the first group that lacks one is reported.

    A field counts as present when its name is there, even with a null value.
    """
    inner = lambda name: F.json_object_keys(F.get_json_object(raw, f"$.{name}"))
    top = _absent(P.MANIFEST_FIELDS, F.json_object_keys(raw))
    source = _absent(P.MANIFEST_SOURCE_FIELDS, inner("source"))
    no_model = ~F.array_contains(F.coalesce(inner("artifacts"), F.array().cast("array<string>")), "model")
    problem = (
        F.when(F.size(top) > 0, F.concat(F.lit("missing required fields: "), F.array_join(top, ", ")))
        .when(F.size(source) > 0, F.concat(F.lit("missing source fields: "), F.array_join(source, ", ")))
        .when(no_model, F.lit("missing artifacts.model field"))
    )
    return manifests.select(
        *[c for c in manifests.columns if c != raw], problem.isNull().alias("valid"), problem.alias("problem"))


def import_manifests(parsed: DataFrame, workspace: str, stage: str, imported_at: str, import_run: Column,
                     git_commit: Column | None = None) -> DataFrame:
    """Import records: the chain with an 'imported' entry that links its run, and the source lineage as it was.

    ``parsed`` has one struct column ``parsed`` in the manifest schema.
    """
    entry = _entry(
        action=F.lit("imported"), to_workspace=F.lit(workspace), to_stage=F.lit(stage), timestamp=F.lit(imported_at))
    extended = F.concat(F.col("parsed.promotion_chain"), F.array(entry))
    url = run_url(F.lit(workspace), import_run)

    def with_run(e: Column, i: Column) -> Column:
        last = (i == F.size("chain") - 1) & (e["action"] == "imported") & url.isNotNull()
        return F.when(last, e.withField("import_run_url", url)).otherwise(e)

    source = F.struct(*[F.col(f"parsed.source.{f}").alias(f) for f in (
        "workspace", "model_version", "model_version_id", "model_version_url", "training_run_url", "created_at")])
    return parsed.withColumn("chain", extended).select(
        F.col("parsed.model_name").alias("model"),
        F.lit("imported").alias("status"),
        F.col("parsed.source.workspace").alias("source_workspace"),
        F.col("parsed.source.model_version").alias("source_version"),
        F.lit(stage).alias("dest_stage"),
        source.alias("source"),
        F.col("parsed.metrics").alias("metrics"),
        F.transform("chain", with_run).alias("promotion_chain"),
        F.col("parsed.export_timestamp").alias("imported_at"),
        F.col("parsed.artifacts.scaler").isNotNull().alias("has_scaler"),
        (F.lit(None) if git_commit is None else git_commit).cast("string").alias("git_commit"),
    )


def back_links(exported: DataFrame, imported: DataFrame, workspace: str, stage: str, ts: str) -> DataFrame:
    """Rows to append to the source versions: where each went. Only versions exported in this run get one.

    ``exported`` has (model, number); ``imported`` has (model, source_version, new_version_id).
    """
    arrived = imported.select("model", F.col("source_version").alias("number"), "new_version_id")
    target = F.lit(workspace)
    return exported.select("model", "number").join(arrived, ["model", "number"]).select(
        "model", "number",
        F.struct(
            target.alias("workspace"), F.lit(stage).alias("stage"), F.col("new_version_id").alias("model_version_id"),
            version_url(target, F.col("new_version_id")).alias("model_version_url"), F.lit(ts).alias("timestamp"),
        ).alias("promoted_to"),
    )


def unwrap_metadata(metadata: DataFrame) -> DataFrame:
    """Schemaless metadata (model, number, name, raw JSON value) to metric rows.

    Numbers, text and booleans are kept, an object is read through its ``value`` field, other types are dropped, and
    the promotion chain is left to :func:`unwrap_chains`. Only an unquoted JSON number has a ``value``; quoted text is kept
    whatever it says.
    """
    raw = F.trim("raw")
    inner = F.when(raw.startswith("{"), F.get_json_object("raw", "$.value")).otherwise(
        F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v")).otherwise(raw))
    parsed = F.try_parse_json("raw")
    kind = F.schema_of_variant(F.when(raw.startswith("{"), F.try_variant_get(parsed, "$.value", "variant")).otherwise(parsed))
    number = F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return (
        metadata.where(F.col("name") != "promotion_chain")
        .select("model", "number", "name", inner.alias("text"), kind.alias("kind"))
        .where(F.col("text").isNotNull() & (number | F.col("kind").isin("STRING", "BOOLEAN")))
        .select("model", "number", "name", "text", F.when(number, F.col("text").try_cast("double")).alias("value"))
    )


def unwrap_chains(metadata: DataFrame) -> DataFrame:
    """The promotion chains in the metadata, stored as a JSON list or as a JSON string that holds one."""
    raw = F.trim("raw")
    text = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "raw", F.lit("}")), "$.v")).otherwise(raw)
    return metadata.where(F.col("name") == "promotion_chain").select(
        "model", "number", F.from_json(text, f"array<{CHAIN_ENTRY.simpleString()}>").alias("chain"))

