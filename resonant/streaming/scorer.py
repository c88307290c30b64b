"""Stateless scoring of a stream of queries against a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import query_index
from ..sources.tables import read_index


def score_stream(queries: DataFrame, index: str, sink: Callable[[DataFrame, int], None], *, k: int = 10, checkpoint: str | None = None) -> StreamingQuery:
    """Start a query that ranks documents of the index saved at a path for each micro-batch of (query_id, tokens) and hands the result to `sink`."""
    stored = read_index(queries.sparkSession, index)
    writer = queries.writeStream.foreachBatch(lambda batch, n: sink(query_index(stored, batch, k=k), n))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
