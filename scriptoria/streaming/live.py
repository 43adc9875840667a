"""Suppression of repeated frames, over a stream."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState

from scriptoria.operators.live import UNCHANGED, Fold, _flag
from scriptoria.session import remove, shared_dir

OUTPUT = "frame_id long, changed boolean, analyzed boolean, reused boolean"
STATE = "last array<double>, frame long, result string"


def suppress_repeats(stream: DataFrame, session: str, order: list[str], signature: str, result: str, delta: float = UNCHANGED, force: str | None = None, reset: str | None = None) -> DataFrame:
    """session, order columns, OUTPUT and `shown` for every frame of the stream, in arrival order.

    State is one signature, one result and a counter for each session. Frames of a micro-batch are taken
    in `order`; a frame that arrives in a later batch than its successors is compared as it comes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    names = [session, *order]
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in names)}, {OUTPUT}, shown string"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold()
        if state.exists:
            last, fold.frame, fold.result = state.get
            fold.last = None if last is None else np.asarray(last, np.float64)
        # a micro-batch's frames of one session, which the trigger bounds, in their order
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [fold.step(s, None if r is None else str(r), f, z, delta) for s, r, f, z in zip(pdf[signature], pdf[result], _flag(pdf, force), _flag(pdf, reset), strict=True)]
        state.update((None if fold.last is None else fold.last.tolist(), fold.frame, fold.result))
        analysed = [o[1] for o in out]
        yield pdf[names].assign(frame_id=[o[0] for o in out], changed=analysed, analyzed=analysed, reused=[not a for a in analysed], shown=[o[2] for o in out])

    return stream.groupBy(session).applyInPandasWithState(run, schema, STATE, "append", "NoTimeout")


def run_to_memory(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Drain a finite stream into an in-memory table; for tests and small runs."""
    spark: SparkSession = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return spark.table(name)


def run_to_files(stream: DataFrame) -> DataFrame:
    """Drain a finite stream into files below the session's shared folder; no row comes to the driver.

    The stream's state lies there too. Both go when the driver ends, as the result is read later.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def keep_latest(stream: DataFrame, by: list[str], order: list[str], handle, checkpoint: str | None = None):
    """Start a query that hands each micro-batch's newest row of each group to `handle(df, batch_id)`."""
    from scriptoria.operators.live import latest

    writer = stream.writeStream.foreachBatch(lambda df, k: handle(latest(df, by, order), k))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
