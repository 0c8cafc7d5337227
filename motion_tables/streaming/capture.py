"""Streams of camera frames: ordered ingest with state, trigger clips, live counts.

A frame stream has the columns of ``FRAMES``: arrival is the source's own number, ts a timestamp of ts_ns, for watermarks; a trigger stream session_id, shot_id,
trigger_ns, pre_roll_ns and ts.  The exact bounds are always those in nanoseconds.  Every function takes a streaming or a batch DataFrame, but for the
stateful ingest, whose batch twins are the window functions ``order_violations``, ``sequence_gaps`` and ``retained``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FRAMES = "session_id long, camera_id string, arrival long, sequence long, ts_ns long, bytes long, width int, height int, format string, ts timestamp"
OUT = "session_id long, camera_id string, arrival long, sequence long, ts_ns long, accepted boolean, rule string, missing long, dropped_so_far long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = "last_ns long, last_sequence long, dropped long, width int, height int, format string"


class Ingest(StatefulProcessor):
    """The frames of one camera, in the order in which they arrived, against the last accepted one.  State is six values, whatever the camera has sent."""

    def __init__(self, most_bytes: int | None, idle_ms: int | None):
        self.most_bytes, self.idle_ms = most_bytes, idle_ms

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        ns, sequence, dropped, *kind = self.last.get() if known else (None, None, 0, None, None, None)
        batch, out = pd.concat(list(rows)).sort_values(["arrival", "sequence", "ts_ns"], kind="stable"), []
        for f in batch.itertuples(index=False):
            if not known:
                known, kind = True, [f.width, f.height, f.format]
            rule = self.rule(f, ns, sequence, kind)
            missing = 0 if rule or sequence is None else int(f.sequence - sequence - 1)
            if rule is None:
                ns, sequence, dropped = int(f.ts_ns), int(f.sequence), dropped + missing
            out.append((*key, f.arrival, f.sequence, f.ts_ns, rule is None, rule, missing, dropped))
        self.last.update((ns, sequence, dropped, int(kind[0]), int(kind[1]), kind[2]))
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=NAMES)

    def rule(self, f, ns: int | None, sequence: int | None, kind: list) -> str | None:
        """The first rule that a frame breaks; a refused frame changes nothing."""
        if (f.width, f.height) != (kind[0], kind[1]):
            return "size changed"
        if f.format != kind[2]:
            return "format changed"
        if ns is not None and f.ts_ns <= ns:
            return "duplicate timestamp" if f.ts_ns == ns else "backward timestamp"
        if sequence is not None and f.sequence <= sequence:
            return "sequence does not increase"
        return "larger than the buffer" if self.most_bytes is not None and f.bytes > self.most_bytes else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The camera has been silent: a row without a frame says so.  The last numbers stay, so what it sends late is refused as before."""
        ns, sequence, dropped, *_ = self.last.get()
        yield pd.DataFrame([(*key, None, sequence, ns, None, "silent", 0, dropped)], columns=NAMES).astype({"arrival": "Int64", "accepted": "boolean"})

    def close(self) -> None:
        pass


def ordered_ingest(frames: DataFrame, *, most_bytes: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Every frame of a stream with whether it is accepted, the rule it breaks if not, and the holes before it.

    ``arrival`` is the number that the source gave the frame: rows of a micro-batch reach the state in any order and are put in the order of arrival there, so a camera's frames must be in
    micro-batches in that order, as a source that numbers them hands them out.  A camera's first frame fixes its size and format.  A frame older than the last accepted one is refused however late it
    comes, since the state outlives every window.  With ``idle_ms`` (and a watermark on ts) a camera silent for so long gives a row with the rule ``silent``.

    The session needs the RocksDB state store (``state_store``).
    """
    mode = "none" if idle_ms is None else "eventTime"
    return frames.groupBy("session_id", "camera_id").transformWithStateInPandas(Ingest(most_bytes, idle_ms), OUT, "append", mode)


def state_store(spark) -> None:
    """Sets the state store that custom state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _too_long(retention: str) -> Column:
    """Whether a trigger's pre-roll is longer than the retention."""
    held = F.unix_micros("ts") - F.unix_micros(F.expr(f"ts - interval {retention}"))
    return F.col("pre_roll_ns") > held * 1000


def trigger_clips(triggers: DataFrame, frames: DataFrame, retention: str = "1 day") -> DataFrame:
    """Frames of each trigger's session within its pre-roll: an interval join of two watermarked streams; frames older than the retention leave the state, so a trigger whose pre-roll is longer gets no clip: ``refused_triggers`` has it."""
    t = triggers.where(~_too_long(retention)).withWatermark("ts", retention).withColumnRenamed("ts", "trigger_ts").alias("t")
    f = frames.withWatermark("ts", retention).alias("f")
    same = F.expr(f"t.session_id = f.session_id and f.ts_ns <= t.trigger_ns and f.ts_ns >= t.trigger_ns - t.pre_roll_ns and f.ts <= t.trigger_ts and f.ts >= t.trigger_ts - interval {retention}")
    return t.join(f, same).select("t.session_id", "shot_id", "camera_id", "sequence", "ts_ns")


def refused_triggers(triggers: DataFrame, retention: str = "1 day") -> DataFrame:
    """session_id, shot_id, rule of the triggers that ``trigger_clips`` can't give a whole clip for the retention."""
    return triggers.where(_too_long(retention)).select("session_id", "shot_id", F.lit("pre-roll longer than the retention").alias("rule"))


def live_counts(frames: DataFrame, window: str, late: str = "10 minutes") -> DataFrame:
    """Frames of each camera in windows of a fixed length: start, frames, first_ns, last_ns."""
    g = frames.withWatermark("ts", late).groupBy("camera_id", F.window("ts", window).alias("w"))
    return g.agg(F.count("*").alias("frames"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")).select("camera_id", F.col("w.start").alias("start"), "frames", "first_ns", "last_ns")


def activity_sessions(frames: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """Runs of each camera's frames without a pause of ``idle`` or more."""
    g = frames.withWatermark("ts", late).groupBy("camera_id", F.session_window("ts", idle).alias("w"))
    return g.agg(F.count("*").alias("frames"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")).select("camera_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "first_ns", "last_ns")
