"""Scoring a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tollgate.operators.models import GaussianModel
from tollgate.operators.scoring import answers, respond
from tollgate.sources.bundles import Bundle, load_bundle, resolve
from tollgate.sources.requests import FIELDS, parse_requests, rejected_requests, valid_requests


def score_requests(requests: DataFrame, model: GaussianModel, version: object) -> DataFrame:
    """Fill defaults, scale, score, and add tier and reasons; invalid requests have no answer. Works on a batch and on a
    stream."""
    return respond(model, valid_requests(parse_requests(requests)), version)


def start_scoring(requests: DataFrame, production: Callable[[], tuple[GaussianModel, object] | None], output: str,
                  checkpoint: str, rejects: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Score with the version that is in production when a batch starts; a promotion takes effect with the next batch.

    Each batch goes to its own folder, so a batch that is run again after a failure replaces what it wrote before. Invalid
    requests go to ``rejects`` with their problem. The default trigger takes what is there and stops; a service gives
    another, such as ``{"processingTime": "10 seconds"}``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        served = production()
        if served is None:
            raise RuntimeError("no production version")
        score_requests(batch, *served).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        if rejects:
            rejected_requests(parse_requests(batch)).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_stage_scoring(requests: DataFrame, versions: Callable[[], DataFrame], model: str, stage: str, output: str, rejects: str,
                        checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Answer requests with the bundle that holds a stage, whatever its kind.

    Each batch asks ``versions`` (a table with model, number, stage and bundle) which version that is, so a promotion takes effect with the next
    batch; a bundle is loaded once for as long as it is served. A batch is parsed once: valid requests go to
    ``output`` and the others with their problem to ``rejects``, each batch in folders of its own, so a batch that is run again
    replaces what it wrote.
    """
    served: dict[str, Bundle] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        number, path = resolve(versions(), model, stage)
        if path not in served:
            served.clear()
            served[path] = load_bundle(batch.sparkSession, path)
        parsed = parse_requests(batch).persist()
        try:
            valid = valid_requests(parsed)
            kept = [c for c in valid.columns if c not in FIELDS and c != "unknown_fields"]
            scored = served[path].score(valid, [*kept, *FIELDS])
            answers(scored, kept, number).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            rejected_requests(parsed).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
