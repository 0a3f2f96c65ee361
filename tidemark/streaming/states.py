"""Events to states on streams: the last state and running totals of each key, and windows over late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums of `value` by window; events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def running_states(events: DataFrame, key: str, time: str, kind: str, terminal: str) -> DataFrame:
    """For each event of a key, in the order of time within a micro-batch, how many came so far and whether the terminal one has been reached; events after it are left out."""

    def step(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        # a key's events of a micro-batch may come in several batches; the source's limits bound them
        events = pd.concat(list(batches)).sort_values([time], kind="stable")
        rows = []
        for t, k in zip(events[time], events[kind], strict=True):
            if ended:
                break
            n, ended = n + 1, k == terminal
            rows.append((keys[0], t, k, n, ended))
        if rows:
            yield pd.DataFrame(rows, columns=[key, time, kind, "n_so_far", "ended"])
        state.update((n, ended))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {kind} {kinds[kind]}, n_so_far long, ended boolean"
    return events.select(key, time, kind).groupBy(key).applyInPandasWithState(step, schema, "n long, ended boolean", "append", GroupStateTimeout.NoTimeout)
