"""Irregular readings onto a regular grid: monotone cubic interpolation per source segment, in time shards with halos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _slope(h1: Column, d1: Column, h0: Column, d0: Column, h2: Column, d2: Column) -> Column:
    """Slope at a knot with interval (h1, d1) on one side and (h0, d0), NULL at a segment's end, on the other.

    Inside: weighted harmonic mean, 0 at a turn. At an end: three-point formula over (h1, d1), (h2, d2), kept monotone.
    """
    w1, w0 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w1 + w0) / (w1 / d0 + w0 / d1))
    three = ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2)
    end = F.when(d2.isNull(), d1).when(three * d1 <= 0, 0.0).when((d1 * d2 <= 0) & (F.abs(three) > 3 * F.abs(d1)), 3 * d1).otherwise(three)
    return F.when(d0.isNull(), end).otherwise(inner)


def regular_grid(readings: DataFrame, source: list[str], time: str, values: list[str], max_gap: int = 20, shard: int = 1024) -> DataFrame:
    """One row per source and time step from its first to its last reading: ``source.., time, values.., status``.

    ``status`` is 'observed', 'filled' (shape-preserving cubic between readings at most ``max_gap`` steps apart) or 'long_gap'
    (values NULL). Long gaps cut a source into segments; slopes never look over them. ``readings`` must hold one row per source
    and whole time step; rows with a NULL or NaN in any of the columns used are no readings. A source with one reading gives that
    row; an empty table gives none. Other columns are ignored.

    Work is sharded by (source, time shard); readings within ``2 * max_gap`` steps of a shard's edge go to the neighbour too, which
    is all that a slope can see. So a long source is spread over many tasks and the result does not depend on ``shard``.
    """
    halo = 2 * max_gap
    if halo >= shard:
        raise ValueError("a shard must be longer than its halo")
    key = [F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(source)]
    val = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(values)]
    ks, vs = [f"s{i}" for i in range(len(source))], [f"v{i}" for i in range(len(values))]
    d = readings.select(*key, F.col(f"`{time}`").cast("int").alias("t"), *val)
    for c in [*ks, "t"]:
        d = d.where(F.col(c).isNotNull())
    for c in vs:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
    d = stage(d)
    low, high = F.floor((F.col("t") - halo) / shard), F.floor((F.col("t") + halo) / shard)
    at = d.withColumn("shard", F.explode(F.sequence(low, high))).withColumn("own", F.floor(F.col("t") / shard) == F.col("shard"))
    w = Window.partitionBy(*ks, "shard").orderBy("t")
    named = F.struct("t", *vs)
    near = at.withColumn("b", F.lag(named).over(w)).withColumn("n", F.lead(named).over(w)).withColumn("nn", F.lead(named, 2).over(w)).where("own")
    close = lambda a, b: (b - a) <= max_gap
    near = near.withColumn("b", F.when(close(F.col("b.t"), F.col("t")), F.col("b"))).withColumn("nn", F.when(close(F.col("n.t"), F.col("nn.t")), F.col("nn")))
    near = near.withColumn("fill", close(F.col("t"), F.col("n.t")))
    h0, h1, h2 = F.col("t") - F.col("b.t"), F.col("n.t") - F.col("t"), F.col("nn.t") - F.col("n.t")
    slopes = []
    for v in vs:
        d0, d1, d2 = (F.col(v) - F.col(f"b.{v}")) / h0, (F.col(f"n.{v}") - F.col(v)) / h1, (F.col(f"nn.{v}") - F.col(f"n.{v}")) / h2
        slopes += [_slope(h1, d1, h0, d0, h2, d2).alias(f"m1_{v}"), _slope(h1, d1, h2, d2, h0, d0).alias(f"m2_{v}")]
    rows = near.select(*ks, "t", *vs, "n", "fill", *slopes)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n.t") - F.col("t") - 1, F.lit(0)))).alias("k"))
    h = (F.col("n.t") - F.col("t")).cast("double")
    s = F.col("k") / h
    out = []
    for v in vs:
        a, b, m1, m2 = F.col(v), F.col(f"n.{v}"), F.col(f"m1_{v}") * h, F.col(f"m2_{v}") * h
        cubic = a + s * (m1 + s * ((3 * (b - a) - 2 * m1 - m2) + s * (2 * (a - b) + m1 + m2)))
        out.append(F.when(F.col("k") == 0, a).when(F.col("fill"), cubic).alias(v))
    status = F.when(F.col("k") == 0, "observed").when(F.col("fill"), "filled").otherwise("long_gap")
    grid = rows.select(*ks, (F.col("t") + F.col("k")).alias("t"), *out, status.alias("status"))
    # gaps that reach beyond a shard's halo: from the shards' first and last readings
    ends = d.groupBy(*ks, F.floor(F.col("t") / shard).alias("shard")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = ends.withColumn("next", F.lead("first").over(Window.partitionBy(*ks).orderBy("shard")))
    far = ends.where(F.col("next") >= (F.col("shard") + 1) * shard + halo).where("next - last > 1")
    far = far.select(*ks, F.explode(F.sequence(F.col("last") + 1, F.col("next") - 1)).alias("t"), *(F.lit(None).cast("double").alias(v) for v in vs), F.lit("long_gap").alias("status"))
    names = [F.col(a).alias(b) for a, b in zip([*ks, "t", *vs], [*source, time, *values], strict=True)]
    return grid.unionByName(far).select(*names, "status")
