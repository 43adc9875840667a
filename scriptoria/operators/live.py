"""Suppression of repeated frames, over a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

UNCHANGED = 0.008


class Fold:
    """One session: a frame is analysed unless it is close to the last one that was."""

    __slots__ = ("last", "frame", "result")

    def __init__(self):
        self.last, self.frame, self.result = None, 0, None

    def step(self, signature, result, force: bool, reset: bool, delta: float) -> tuple[int, bool, object]:
        """(frame number, analysed, result shown) of the next frame."""
        if reset:
            self.last, self.frame, self.result = None, 0, None
        self.frame += 1
        v = np.atleast_1d(np.asarray(signature, np.float64))
        same = not force and self.last is not None and self.last.shape == v.shape and float(np.mean(np.abs(v - self.last))) <= delta
        if not same:
            self.last, self.result = v, result
        return self.frame, not same, self.result


def _flag(pdf: pd.DataFrame, column: str | None) -> list[bool]:
    return [bool(v) if v is not None and v == v else False for v in pdf[column]] if column else [False] * len(pdf)


def suppress_repeats(df: DataFrame, session: str, order: list[str], signature: str, result: str, delta: float = UNCHANGED, force: str | None = None, reset: str | None = None) -> DataFrame:
    """The rows in session order with frame_id, changed, analyzed, reused and `shown`, the result in force.

    Sessions are dealt out by hash and sorted within partitions; the fold streams over the sorted batches
    and keeps one frame, so a session of any length needs no more memory than one frame.
    """
    more = [StructField("frame_id", LongType()), StructField("changed", BooleanType()), StructField("analyzed", BooleanType()), StructField("reused", BooleanType()), StructField("shown", df.schema[result].dataType)]
    schema = StructType([*df.schema.fields, *more])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, at = Fold(), object()
        for pdf in batches:
            out = []
            for key, sig, res, f, r in zip(pdf[session], pdf[signature], pdf[result], _flag(pdf, force), _flag(pdf, reset), strict=True):
                if key != at and not (key != key and at != at):
                    fold, at = Fold(), key
                out.append(fold.step(sig, res, f, r, delta))
            analysed = [o[1] for o in out]
            yield pdf.assign(frame_id=[o[0] for o in out], changed=analysed, analyzed=analysed, reused=[not a for a in analysed], shown=[o[2] for o in out])

    return df.repartition(F.col(session)).sortWithinPartitions(session, *order).mapInPandas(run, schema)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group: back-pressure that keeps only the newest frame."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*by, *(F.col(f"_l.{c}") for c in rest))
