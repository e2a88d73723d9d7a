"""Streams of detections: session windows, windowed counts with late data, and a tracker with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import OpenTracks, in_time_order

NO_TIME = -1 << 62


def session_counts(events: DataFrame, time: str, group: str, gap: str, late: str) -> DataFrame:
    """group, first, last, n of sessions; a session closes when the watermark (`late` behind) passes its gap."""
    w = events.withWatermark(time, late).groupBy(group, F.session_window(time, gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).select(group, "first", "last", "n")


def window_counts(events: DataFrame, time: str, group: str, width: str, slide: str, late: str) -> DataFrame:
    w = events.withWatermark(time, late).groupBy(group, F.window(time, width, slide).alias("w"))
    return w.agg(F.count("*").alias("n")).select(group, F.col("w.start").alias("start"), "n")


def tracked(detections: DataFrame, group: str, max_gap_ms: int = 2500, least_score: float = 0.18) -> DataFrame:
    """group, detection_id, track: each video's open tracks are its state; tracks older than the gap are dropped from it.

    Rows of one batch are taken in order of time, frame and falling confidence; a row before a track's last time never extends it.
    """
    kind = detections.schema[group].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = OpenTracks(max_gap_ms, least_score)
        if state.exists:
            (flat, kept.n) = state.get
            kept.tracks = [[None if x == NO_TIME else x for x in flat[i : i + 7]] for i in range(0, len(flat), 7)]
        part = in_time_order(pd.concat(list(parts)))
        out = [kept.take(d) for d in part.itertuples()]
        state.update(([NO_TIME if x is None else x for t in kept.tracks for x in t], kept.n))
        yield pd.DataFrame({group: [key[0]] * len(part), "detection_id": part["detection_id"].to_numpy(), "track": out})

    return detections.groupBy(group).applyInPandasWithState(run, f"{group} {kind}, detection_id long, track long", "open array<long>, n long", "append", GroupStateTimeout.NoTimeout)
