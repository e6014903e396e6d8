"""Streams: change logs into collections, and silent members."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import latest
from ..workspace import scope, stored

#: Batches after which what was taken is folded into one table.
FOLDED = 16


def ingest(stream: DataFrame, collection: Any, checkpoint: str, *, order: str = "version", **trigger: Any):
    """Apply a stream of (vector_id, op, embedding, metadata, ``order``) to a collection.

    Each micro-batch keeps the last entry of each id by ``order`` and is
    compared with what the collection has taken before, kept beside it, so a
    batch that is replayed, or entries that arrive late or in any order, lead
    to the same state.  No watermark: a late version is still a valid one.

    What was taken is a row an id up to some batch, ``taken/base=N``, and what
    each batch after it took; every FOLDED batches the base is made anew, so a
    batch reads no more than these.
    """
    spark = stream.sparkSession
    store = collection.store

    def before(batch_id: int) -> DataFrame | None:
        """What batches before this one took."""
        done = [n for n in store._done("taken", "base") if n < batch_id]
        after = done[-1] if done else -1
        paths = [f"{store.path}/taken/base={n}" for n in done[-1:]] + [f"{store.path}/taken/batch={n}" for n in store._done("taken", "batch") if after < n < batch_id]
        return spark.read.parquet(*paths).groupBy("vector_id").agg(F.max("at").alias("_taken")) if paths else None

    def take(batch: DataFrame, batch_id: int) -> None:
        with scope(spark):
            last = latest(batch, version=order)
            taken = before(batch_id)
            if taken is not None:
                last = last.join(taken, "vector_id", "left").where(F.col("_taken").isNull() | (F.col(order) > F.col("_taken"))).drop("_taken")
            last = stored(last, "batch")
            puts = last.where("op <> 'delete'")
            if not puts.isEmpty():
                collection.put_many(puts.select("vector_id", "embedding", *(["metadata"] if "metadata" in puts.columns else [])))
            gone = last.where("op = 'delete'")
            if not gone.isEmpty():
                collection.delete_many(gone)
            # written last: a batch that fails before this is taken again, and putting it again changes nothing
            last.select("vector_id", F.col(order).alias("at")).write.mode("overwrite").parquet(f"{store.path}/taken/batch={batch_id}")
            if batch_id % FOLDED == FOLDED - 1:
                before(batch_id + 1).withColumnRenamed("_taken", "at").write.mode("overwrite").parquet(f"{store.path}/taken/base={batch_id}")
                for kind, key in (("batch", batch_id), ("base", batch_id - 1)):
                    store.drop([f"taken/{kind}={n}" for n in store._done("taken", kind) if n <= key])

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def silent_members(beats: DataFrame, timeout_ms: int, *, node: str = "node_id", ts: str = "ts") -> DataFrame:
    """node_id, last_seen of members whose next beat doesn't come in time, on a stream of beats.

    Processing-time timers: a member is reported once and forgotten until it
    beats again.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        newest = max((f[ts].max() for f in frames), default=None)
        micros = int(pd.Timestamp(newest).value // 1000)
        if state.exists:
            micros = max(micros, state.get[0])
        state.update((micros,))
        state.setTimeoutDuration(timeout_ms)
        return

    return beats.select(F.col(node).cast("string").alias(node), ts).groupBy(node).applyInPandasWithState(
        watch, "node_id string, last_seen timestamp", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
