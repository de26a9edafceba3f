"""Arriving partial entities, projected against a finished run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import similarity


def project_stream(arriving: DataFrame, primary_signature: DataFrame, placed: DataFrame, validated: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream of rows (id, is_validated, kind, feature), all of an entity in one batch, into ``sink(batch, number)``.

    The projection has no state beside the finished run, so a batch that is
    repeated after a failure gives the same rows; a sink that replaces by batch
    number is then exact.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            partials = held.groupBy("id").agg(F.coalesce(F.bool_or("is_validated"), F.lit(False)).alias("is_validated"))
            signature = held.filter("feature is not null").select("id", "kind", "feature").distinct()
            sink(similarity.project(partials, signature, primary_signature, placed, validated, k), number)
        finally:
            held.unpersist()

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
