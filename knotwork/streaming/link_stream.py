"""Linking new records as they come, against a fixed table of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators import decide, knn


def link_batch(batch: DataFrame, entities: DataFrame, t: float, k: int = 10, label: str = "country") -> DataFrame:
    """batch, entities: id, label, vec. The best entity of each new record, if its cosine reaches t."""
    found = knn.ranked(knn.knn_blocks(batch, entities, k, 0, label), "q_idx", "cos", "s1_idx", k, "rq")
    return decide.threshold_links(decide.best_per_query(found.withColumnRenamed("cos", "p")), t)


def link_stream(records: DataFrame, entities: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, t: float = 0.75, label: str = "country") -> StreamingQuery:
    """Runs link_batch on each micro-batch; the sink gets the links and the batch number, by which it can write each batch once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(link_batch(batch, entities, t, label=label), number)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
