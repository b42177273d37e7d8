"""Stateful operators over streams of files: windows with a watermark, last match per reference, last label and position per cell."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_windows(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums per window and type of a stream with columns ts, event_type, value; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _switches(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("frame")
    last = rows["comp"].shift(fill_value=before)
    state.update((int(rows["comp"].iloc[-1]),))
    hit = (last != rows["comp"]) & (last != 0)
    yield pd.DataFrame({"seq": key[0], "ref": key[1], "frame": rows["frame"][hit], "comp": rows["comp"][hit], "before": last[hit]})


def switches(matches: DataFrame) -> DataFrame:
    """Identity switches of a stream of matches (seq, frame, ref, comp) whose frames come in order: the last match per reference is state."""
    return matches.groupBy("seq", "ref").applyInPandasWithState(
        _switches, "seq string, ref int, frame int, comp int, before int", "comp int", "append", GroupStateTimeout.NoTimeout)


def _carried(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    label, x, y = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values("frame")
    known = rows["label"].where(rows["label"].isin([0, 1])).astype("float64").ffill()
    known = known if label is None else known.fillna(float(label))
    seen = rows["x"].notna() & rows["y"].notna()
    before = {}
    for name, first in (("x", x), ("y", y)):
        v = rows[name].where(seen).ffill()
        before[name] = v.shift(1) if first is None else v.shift(1).fillna(first)
        before[f"last_{name}"] = v.iloc[-1] if pd.notna(v.iloc[-1]) else first
    last = known.iloc[-1]
    state.update((int(last) if pd.notna(last) else None, *(float(before[f"last_{n}"]) if before[f"last_{n}"] is not None else None for n in "xy")))
    speed = ((rows["x"] - before["x"]) ** 2 + (rows["y"] - before["y"]) ** 2) ** 0.5
    yield pd.DataFrame({"seq": key[0], "cell_id": key[1], "frame": rows["frame"], "label": known.astype("Int32"), "speed": speed})


def carried(rows: DataFrame) -> DataFrame:
    """For a stream of rows (seq, cell_id, frame, label, x, y) whose frames come in order: the last label 0 or 1 and the distance to the last position of each cell, which are state."""
    return rows.groupBy("seq", "cell_id").applyInPandasWithState(
        _carried, "seq string, cell_id int, frame int, label int, speed double", "label int, x double, y double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, append it to ``out`` and stop; a later call goes on from ``checkpoint``."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
