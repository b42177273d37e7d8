"""Ranks, running sums and exact quantiles over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def ranged(df: DataFrame, by: list[str], value: str, n: int | None = None) -> DataFrame:
    """Adds ``bucket``, rising with ``value`` within each group ``by``: the range partition that a row lies in. NULL and NaN values are left out.

    The ranges' bounds come from a sample of the rows, so that each of the ``n`` (by default as many as a shuffle has) holds about as many, however the values lie.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    keys = [F.col(c) for c in [*by, value]]
    d = d.repartitionByRange(n, *keys) if n else d.repartitionByRange(*keys)
    return stage(d.withColumn("bucket", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], descending: bool = False, n: int | None = None) -> DataFrame:
    """Per group and distinct ``value``: the sums of that value and, as ``{name}_cum``, of all up to it (from the top if ``descending``).

    Values are first summed up per distinct value, then ordered within ranges of values; the sums of whole ranges before are added. No task holds
    more than one range's distinct values.
    """
    d = ranged(df.groupBy(*by, value).agg(*(F.sum(c).alias(k) for k, c in sums.items())), by, value, n)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    over = Window.partitionBy(*by).orderBy(way("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = d.groupBy(*by, "bucket").agg(*(F.sum(k).alias(k) for k in sums))
    whole = whole.select(*by, "bucket", *(F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy(*by, "bucket").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(whole, [*by, "bucket"])
    return d.select(*by, value, *sums, *((F.sum(k).over(inside) + F.col(f"_{k}")).alias(f"{k}_cum") for k in sums))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, .. in ``order`` within each group ``by``, as row_number does, over ranges of rows instead of a window over a whole group. ``order`` must tell rows apart."""
    d = stage(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_bucket", F.spark_partition_id()))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_bucket", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    d = d.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))).join(before, [*by, "_bucket"])
    return d.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_bucket", "_before")


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], n: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: by.., n_values, q (array, in the order of ``at``).

    Distinct values with their running counts give the values at the two ranks around each quantile. NULL and NaN are no values.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    r = running(d, by, value, {"n": F.lit(1)}, n=n)
    total = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_values"))
    r = r.join(total, by) if by else r.crossJoin(F.broadcast(total))  # one row
    picks = []
    for i, q in enumerate(at):
        h = (F.col("n_values") - 1) * F.lit(float(q))
        for k, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (rank >= F.col("n_cum") - F.col("n")) & (rank < F.col("n_cum"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"{k}{i}"))
    g = r.groupBy(*by, "n_values").agg(*picks)
    part = lambda q: (F.col("n_values") - 1) * F.lit(float(q)) - F.floor((F.col("n_values") - 1) * F.lit(float(q)))
    return g.select(*by, "n_values", F.array(*(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part(q) for i, q in enumerate(at))).alias("q"))
