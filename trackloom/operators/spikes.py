"""Implausible readings per source: two-sided Hampel filter, stuck runs, physical bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import group_codes, whole_groups
from ..functions.ranks import quantiles
from ..session import stage


@dataclass(frozen=True)
class Measure:
    """A measured field: bounds of the possible, whether it varies by factors, and the least scale of its variation."""

    name: str
    low: float = -np.inf
    high: float = np.inf
    low_open: bool = False
    log: bool = False
    floor: float = 0.0


@dataclass(frozen=True)
class Rules:
    side: int = 5  # readings on each side that the rolling medians see
    factor: float = 6.0  # departures beyond this many scales are spikes
    run: int = 6  # equal successive readings that count as stuck
    shard: int = 8192  # time units handled together
    halo: int = 512  # time units seen beyond a shard's edge


def _ranks(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and row count of each row's group; ``code`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.append(first, len(code)))
    return np.repeat(first, size), np.repeat(size, size)


def _side_median(x: np.ndarray, t: np.ndarray, first: np.ndarray, size: np.ndarray, side: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the up to ``side`` readings before (step -1) or after (+1) each one, and of their times; NaN where none."""
    at = np.arange(len(x))[:, None] + step * np.arange(1, side + 1)[None, :]
    ok = (at >= first[:, None]) & (at < (first + size)[:, None])
    at = np.clip(at, 0, max(len(x) - 1, 0))
    n = ok.sum(axis=1)
    out = []
    for v in (x, t):
        s = np.sort(np.where(ok, v[at], np.inf), axis=1)
        i = np.arange(len(x))
        with np.errstate(invalid="ignore"):
            m = (s[i, np.maximum(n - 1, 0) // 2] + s[i, n // 2 - (n // 2 >= side)]) / 2 if len(x) else np.empty(0)
        out.append(np.where(n > 0, m, np.nan))
    return out[0], out[1]


def group_median(code: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Median of the non-NaN ``x`` of each row's group."""
    order = np.lexsort((x, code))  # NaN sorts last
    first, size = _ranks(code)
    n = np.add.reduceat(~np.isnan(x), np.unique(first)) if len(x) else np.empty(0, int)
    n = np.repeat(n, size[np.unique(first)]) if len(x) else n
    s = x[order]
    last = max(len(x) - 1, 0)
    m = (s[np.minimum(first + np.maximum(n - 1, 0) // 2, last)] + s[np.minimum(first + n // 2, last)]) / 2 if len(x) else s
    return np.where(n > 0, m, np.nan)


def judge(code: np.ndarray, t: np.ndarray, v: np.ndarray, m: Measure, r: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, departure, off the line) of each reading; sorted by (code, t), no NaN in ``v``.

    The kind is 0 plain, 1 impossible or 2 stuck. The departure is the least of those from the medians of both sides, where both have one direction (else
    0), and from the line between them; ``off`` is the absolute value of the latter, NaN without readings on both sides. Impossible and stuck
    readings take no part in medians and have neither.
    """
    kind, least, away = np.zeros(len(v), np.int32), np.zeros(len(v)), np.full(len(v), np.nan)
    if not len(v):
        return kind, least, away
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (v[1:] != v[:-1])])
    run = np.cumsum(new) - 1
    stuck = np.bincount(run)[run] >= r.run
    wrong = (v <= m.low if m.low_open else v < m.low) | (v > m.high)
    kind[stuck], kind[wrong] = 2, 1
    free = np.flatnonzero(kind == 0)
    if not len(free):
        return kind, least, away
    c, tt, x = code[free], t[free].astype(float), v[free]
    if m.log:
        x = np.log(x)
    first, size = _ranks(c)
    before, tb = _side_median(x, tt, first, size, r.side, -1)
    after, ta = _side_median(x, tt, first, size, r.side, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        off = x - (before + (after - before) * (tt - tb) / (ta - tb))
        left, right = x - before, x - after
        least[free] = np.where(left * right > 0, np.minimum(np.minimum(np.abs(left), np.abs(right)), np.abs(off)), 0.0)
    away[free] = np.abs(off)
    return kind, least, away


KINDS = ["plain", "impossible", "stuck", "spike"]
_MAD = 1.4826  # a normal distribution's standard deviation in median absolute departures


def _suspects(ks: list[str], measures: list[Measure], rules: Rules) -> object:
    """Readings that are impossible, stuck or may be spikes, with the scale of their shard; and a row of kind -1 per source and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*ks, "shard"]):
            code = group_codes(table, [*ks, "shard"])
            t, own, shard = table["t"].to_numpy(), table["own"].to_numpy(zero_copy_only=False), table["shard"].to_numpy()
            here = np.flatnonzero(own)
            here = here[np.unique(code[here], return_index=True)[1]]
            parts = [(here, shard[here].astype(np.int32), -1, np.full(len(here), -1, np.int32), *(np.zeros(len(here)) for _ in range(3)))]
            for i, m in enumerate(measures):
                v = table[f"m{i}"].to_numpy()
                at = np.flatnonzero(~np.isnan(v))
                kind, least, away = judge(code[at], t[at], v[at], m, rules)
                scale = _MAD * group_median(code[at], away)
                hit = ((kind > 0) | (least > rules.factor * m.floor)) & own[at]
                parts.append((at[hit], t[at[hit]], i, kind[hit], v[at[hit]], least[hit], scale[hit]))
            rows = pa.array(np.concatenate([p[0] for p in parts]))
            columns = [table[k].combine_chunks().take(rows) for k in ks]
            columns += [pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)), pa.array(np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]).astype(np.int32))]
            columns += [pa.array(np.concatenate([p[k] for p in parts])) for k in (3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays(columns, names=[*ks, "t", "field", "kind", "value", "least", "scale"])

    return run


def _departures(ks: list[str], measures: list[Measure], rules: Rules) -> object:
    """How far each own reading lies off the line: ks.., field, off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [*ks, "shard"]):
            code = group_codes(table, [*ks, "shard"])
            t, own = table["t"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
            for i, m in enumerate(measures):
                v = table[f"m{i}"].to_numpy()
                at = np.flatnonzero(~np.isnan(v))
                away = judge(code[at], t[at], v[at], m, rules)[2]
                keep = own[at] & ~np.isnan(away)
                rows = pa.array(at[keep])
                yield pa.RecordBatch.from_arrays([*(table[k].combine_chunks().take(rows) for k in ks), pa.array(np.full(len(rows), i, np.int32)), pa.array(away[keep])], names=[*ks, "field", "off"])

    return run


def implausible(readings: DataFrame, source: list[str], time: str, measures: list[Measure], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Readings that are impossible, stuck or spikes: ``source.., time, field, kind, value``, one row per such reading and field.

    ``readings`` must hold one row per source and time. A spike departs by more than ``rules.factor`` scales from the medians of both sides, in one direction, and
    from the line between them; the scale is 1.4826 times the source's median absolute departure from that line, at least the measure's floor. A
    reading without readings on both sides is no spike. Impossible goes before stuck, stuck before spike. NULL and NaN values are no readings: they are
    neither flagged nor do they break a run. Rows with a NULL source or time are left out. An empty table gives no rows; other columns are ignored.

    A source is handled in time shards of ``rules.shard`` units, each seeing ``rules.halo`` units beyond its edges, so that a long
    source is spread over many tasks. A source in several shards gets its scale from the exact median over all of them, in a second pass over such
    sources alone, so that the result does not depend on the shards.
    """
    ks = [f"s{i}" for i in range(len(source))]
    d = readings.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(source, ks, strict=True)), F.col(f"`{time}`").cast("int").alias("t"), *(F.col(f"`{m.name}`").cast("double").alias(f"m{i}") for i, m in enumerate(measures)))
    for c in [*ks, "t"]:
        d = d.where(F.col(c).isNotNull())
    types = dict(d.dtypes)
    keys = ", ".join(f"{k} {types[k]}" for k in ks)

    def sharded(d: DataFrame) -> DataFrame:
        at = F.sequence(F.floor((F.col("t") - rules.halo) / rules.shard), F.floor((F.col("t") + rules.halo) / rules.shard))
        d = d.withColumn("shard", F.explode(at)).withColumn("own", F.floor(F.col("t") / rules.shard) == F.col("shard"))
        d = d.repartition(*ks, "shard").sortWithinPartitions(*ks, "shard", "t")
        return d.select(*ks, "shard", "t", "own", *(f"m{i}" for i in range(len(measures))))

    found = stage(sharded(d).mapInArrow(_suspects(ks, measures, rules), f"{keys}, t int, field int, kind int, value double, least double, scale double"))
    rows = found.where("kind >= 0")
    long_ = stage(found.where("kind = -1").groupBy(*ks).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").select(*ks))
    if long_.limit(1).count():
        off = stage(sharded(d.join(long_, ks, "left_semi")).mapInArrow(_departures(ks, measures, rules), f"{keys}, field int, off double"))
        whole = quantiles(off, [*ks, "field"], "off", [0.5]).select(*ks, "field", (_MAD * F.col("q")[0]).alias("whole"))
        rows = rows.join(whole, [*ks, "field"], "left").withColumn("scale", F.coalesce("whole", "scale"))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("field") + 1)
    spike = F.col("least") > rules.factor * F.greatest(F.nanvl("scale", F.lit(0.0)), pick([float(m.floor) for m in measures]))
    kind = F.when(F.col("kind") > 0, F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)).when(spike, F.lit(KINDS[3]))
    out = rows.withColumn("said", kind).where("said is not null")
    return out.select(*(F.col(k).alias(c) for k, c in zip([*ks, "t"], [*source, time], strict=True)), pick([m.name for m in measures]).alias("field"), F.col("said").alias("kind"), "value")
