"""Live forms of interval operators over streams of frames.

Most operators look ahead, so a live form answers late: a frame's bridged flag
is known once `gap` more frames have come. Frames of an episode must arrive in
order; the state holds the undecided frames only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "episode long, frame long, seen boolean"
STATE = "pending array<bigint>, begun boolean, long boolean"


def _bridged(gap: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, begun, long = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], False, False)
        out: list[tuple[int, bool]] = []
        for rows in batches:
            for frame, seen in rows.sort_values("frame")[["frame", "seen"]].itertuples(index=False):
                if seen:
                    out += [(f, True) for f in pending] + [(frame, True)]
                    pending, begun, long = [], True, False
                elif long or not begun:
                    out.append((frame, False))
                else:
                    pending.append(int(frame))
                    if len(pending) > gap:
                        out += [(f, False) for f in pending]
                        pending, long = [], True
        state.update((pending, begun, long))
        if out:
            yield pd.DataFrame({"episode": key[0], "frame": [int(f) for f, _ in out], "seen": [bool(s) for _, s in out]})

    return step


def bridge_gaps_live(frames: DataFrame, gap: int) -> DataFrame:
    """(episode, frame, seen) of a stream: false runs of at most `gap` frames between seen ones are filled.

    The last frames of an episode, if not seen and `gap` or fewer, stay undecided until more of it comes.
    """
    return frames.groupBy("episode").applyInPandasWithState(_bridged(gap), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_visibility(events: DataFrame, time: str, late: str, width: str, threshold: float) -> DataFrame:
    """Share of seen events in tumbling windows, with a watermark for late ones."""
    from pyspark.sql import functions as F

    seen = (F.col("value") > threshold).cast("double")
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "user_id").agg(F.count("*").alias("n"), F.avg(seen).alias("seen"))


def visible_sessions(events: DataFrame, time: str, keys: list[str], seen: Column, gap: str, late: str) -> DataFrame:
    """(keys, start, stop, n): intervals of visibility as sessions: seen events whose distance stays under `gap` are one interval, stop being the last of them.

    Rows that come later than the watermark allows do not change what has been handed on; `dropped` counts them.
    """
    from pyspark.sql import functions as F

    held = events.filter(seen).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys)
    return held.agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("stop")).select(*keys, "start", "stop", "n")


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late for their watermark so far, over the progress that the query keeps."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
