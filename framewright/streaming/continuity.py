"""Joint values carried over from chunk to chunk on a stream, by keyed state.

A recording arrives in chunks; every chunk goes on where the one before it
ended. What must survive is small: for each (episode, side) the last frame, its raw joints and the joints as
they were handed on. It lies in the state store of the query's checkpoint, so a query that stops and starts again goes on
from there, and nothing of earlier chunks is read again. The session needs a
state store that keeps values by key (RocksDB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "episode long, side string, frame long, joints array<double>, follows boolean"
STATE = "source_frame long, raw array<double>, turned array<double>"
#: The state store that the operator needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def turns(raw: np.ndarray) -> np.ndarray:
    """What to add to each row of angles so that no step is half a turn or more: the shift of `smoothing.unwrap`."""
    step = np.diff(raw, axis=0)
    wrapped = (step + math.pi) % (2 * math.pi) - math.pi
    wrapped = np.where((wrapped == -math.pi) & (step > 0), math.pi, wrapped)
    return np.vstack([np.zeros((1, raw.shape[1])), np.cumsum(np.where(np.abs(step) < math.pi, 0.0, wrapped - step), axis=0)])


class Carried(StatefulProcessor):
    """Angles of one (episode, side), each taking the turn nearest to the frame before it, across chunks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows)).drop_duplicates("frame").sort_values("frame")  # a chunk is bounded
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            chunk = chunk[chunk["frame"] > known[0]]  # what has been handed on already stays as it is
        if not len(chunk):
            return
        raw = np.array(chunk["joints"].tolist(), float)
        frames = chunk["frame"].to_numpy()
        if known is None:
            joined, before = raw + turns(raw), np.append(-2, frames[:-1])
        else:
            whole = np.vstack([np.array(known[1], float)[None], raw])
            joined = (whole + turns(whole))[1:] + (np.array(known[2], float) - np.array(known[1], float))
            before = np.append(known[0], frames[:-1])
        self.last.update((int(frames[-1]), raw[-1].tolist(), joined[-1].tolist()))
        yield pd.DataFrame({"episode": key[0], "side": key[1], "frame": frames, "joints": joined.tolist(), "follows": frames == before + 1})

    def close(self) -> None:
        pass


def carried_live(chunks: DataFrame) -> DataFrame:
    """(episode, side, frame, joints, follows) of a stream of chunks (episode, side, frame, joints): angles without jumps of a turn over
    the whole recording; follows: the frame before it was there. Chunks arrive in order; frames that are not later than the last one handed on are left out.
    """
    return chunks.groupBy("episode", "side").transformWithStateInPandas(Carried(), OUT, "append", "none")
