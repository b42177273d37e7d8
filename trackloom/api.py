"""Named scores of a comparison, and a command line over pixel tables.

    python -m trackloom.api evaluate --pixels PATH [--ref-tracks PATH] [--comp-tracks PATH] [--metrics DET TRA ...] [--out PATH]
    python -m trackloom.api validate --pixels PATH [--comp-tracks PATH]

Pixel tables (parquet) have seq, frame, ref, comp. Track files have lines ``label birth end parent`` in folders ``seq=...``; without
them tracks are what the pixels show, without parents.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scoring as s
from .sources.files import read_tracks, write_table


def _from(build: Callable[[s.Comparison], DataFrame], column: str) -> Callable[[s.Comparison], DataFrame]:
    return lambda c: build(c).select("seq", F.col(column).cast("double").alias("value"))


_conf = s.confusion
METRICS: dict[str, Callable[[s.Comparison], DataFrame]] = {
    **{n.upper(): _from(s.technical, n) for n in ("det", "seg", "tra", "lnk", "op_csb", "op_ctb")},
    "CT": _from(s.ct, "ct"), "TF": _from(s.tf, "tf"), "CCA": _from(s.cca, "cca"),
    **{f"BC({i})": (lambda c, i=i: s.bc(c, (i,)).select("seq", F.col("bc").alias("value"))) for i in range(4)},
    **{f"BIO({i})": _from(s.biological, f"bio_{i}") for i in range(4)},
    "MOTA": _from(s.mota, "mota"), "HOTA": _from(lambda c: s.hota(_conf(c)), "hota"), "CHOTA": _from(lambda c: s.chota(c, _conf(c)), "chota"), "IDF1": _from(lambda c: s.identity(_conf(c)), "idf1"),
    "MT": _from(lambda c: s.mostly_tracked(_conf(c)), "mt"), "ML": _from(lambda c: s.mostly_tracked(_conf(c)), "ml"), "FAF": _from(s.false_alarms, "faf"),
}


def comparison(px: DataFrame, ref_tracks: DataFrame | None = None, comp_tracks: DataFrame | None = None) -> s.Comparison:
    c = s.contingency(px)
    return s.Comparison(c, *(t if t is not None else s.observed_tracks(c, side, F.lit(0)) for t, side in ((ref_tracks, "ref"), (comp_tracks, "comp"))))


def evaluate(c: s.Comparison, metrics: Iterable[str] | None = None) -> DataFrame:
    """seq, metric, value of the metrics named (all if none are). Only the plans of those are built. An unknown name raises KeyError."""
    out = None
    for name in metrics or METRICS:
        d = METRICS[name](c).select("seq", F.lit(name).alias("metric"), "value")
        out = d if out is None else out.unionByName(d)
    return out


def validate(c: s.Comparison) -> DataFrame:
    """seq, valid and the number of violations of the computed side."""
    v = s.validity(c.contingency, c.comp_tracks, c.comp).groupBy("seq").agg(F.sum("violations").alias("violations"))
    return v.select("seq", (F.col("violations") == 0).alias("valid"), "violations")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="trackloom")
    p.add_argument("command", choices=["evaluate", "validate"])
    p.add_argument("--pixels", required=True)
    p.add_argument("--ref-tracks")
    p.add_argument("--comp-tracks")
    p.add_argument("--metrics", nargs="*")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    c = comparison(spark.read.parquet(a.pixels), *(read_tracks(spark, t) if t else None for t in (a.ref_tracks, a.comp_tracks)))
    result = evaluate(c, a.metrics) if a.command == "evaluate" else validate(c)
    if a.out:
        write_table(result, a.out, sep=";")
    else:
        result.show(1000, truncate=False)


if __name__ == "__main__":
    main()
