"""A stream of documents into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..ingest import Prepare, default_prepare, ingest
from ..store import Store


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, prepare: Prepare = default_prepare, build_index: bool = False, **trigger) -> StreamingQuery:
    """Each micro-batch of stream(origin, text) updates the store. A batch that is run again after a failure changes
    nothing more, since an update with stored chunks does nothing. trigger: as in writeStream.trigger."""

    def batch(df: DataFrame, _: int) -> None:
        ingest(store, df, prepare, build_index)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
