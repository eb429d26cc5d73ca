"""Strands from a stream of trace points that arrive in stroke order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lineloom.functions.lattice import ordered


def strands(trace: DataFrame, key: str = "pattern_id") -> DataFrame:
    """key, seq, ax, ay, bx, by: a row for each step between successive dots, as :func:`lineloom.operators.graph.strands` gives in batch.

    ``trace`` is a stream of key, step, x, y. The state of a pattern is its last dot and the number of its visits; points of one
    micro-batch are put in order of step, and a point that comes after a later batch has been seen is taken as it comes.
    """
    on = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y"))
    dots = trace.where(on).select(key, "step", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seq = (state.get[:2], state.get[2]) if state.exists else (None, 0)
        rows = []
        for x, y in pd.concat(list(frames)).sort_values("step")[["x", "y"]].itertuples(index=False):
            if (x, y) == last:
                continue
            if last is not None:
                rows.append((*k, seq, *ordered(*last, x, y)))
            last, seq = (int(x), int(y)), seq + 1
        if last is not None:
            state.update((*last, seq))
        yield pd.DataFrame(rows, columns=[key, "seq", "ax", "ay", "bx", "by"])

    kind = trace.schema[key].dataType.simpleString()
    return dots.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq bigint, ax int, ay int, bx int, by int", "x int, y int, seq bigint", "append", GroupStateTimeout.NoTimeout)
