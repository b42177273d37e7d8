"""Matching entities across two sources without keys, from positions and sizes that agree only roughly.

An entity is a track: readings of position and size over time. Attributes become q-grams (the run of q neighbouring bins
that a number stands for) in fixed bit vectors, so that the Hamming distance of two vectors is the distance of the numbers in bins, up to q.
Multi-index Hamming hashing finds all pairs of vectors within a radius exactly. The two sources may differ by a constant
shift in place, size and time within a group; it is estimated from all candidate pairs. With it taken out, x, y and size of every common reading become bit vectors
again, finer ones, whose field-weighted Dice scores make a pair's score. Scores become confidences by comparison with decoys: the tracks of one source moved to
where they cannot be, whose best pairs are known to be false.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spikes import group_median
from ..session import stage


@dataclass(frozen=True)
class Match:
    shift: float = 16.0  # the two sources' places differ by less than this in each direction
    block: int = 8  # readings over so many time steps are summed up for the search
    most: float = 11.0  # the constant shift of a group is less than this in each direction
    lag: int = 3  # the two sources' times differ by at most this
    slack: int = 4  # a track of one source may begin earlier or end later than in the other by so many time steps
    part: float = 0.45  # share of b's readings that must lie between a's first and last all the same
    near: float = 6.0  # after the shift is taken out, candidates lie nearer than this
    q_place: float = 6.0  # width of a place's q-gram set: Dice falls to 0 at this distance
    q_size: float = 0.3  # the same for the logarithm of the size
    weights: tuple[float, float, float] = (0.4, 0.4, 0.2)  # of x, y and size
    confidence: float = 0.5  # pairs below are no matches
    decoy: float = 40.0  # decoys are moved by so much in each direction
    weak: float = 0.5  # a group with good scores for less than this share of b's tracks is searched again
    wide: float = 4.0  # by so many times the shift, most and lag


_TRACK = "array<struct<t:int,x:float,y:float,s:float>>"


def tracks(readings: DataFrame, group: str, entity: str, time: str, x: str, y: str, size: str) -> DataFrame:
    """``g, e, track`` (sorted by time). Readings without a place are left out; a size that is no positive number is NULL.

    Of several readings of one entity and time the largest in column order stays, so a track has at most one per time step.
    """
    ok = lambda c: F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`")
    d = readings.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{entity}`").isNotNull() & F.col(f"`{time}`").isNotNull() & ok(x) & ok(y))
    s = F.when(ok(size) & (F.col(f"`{size}`") > 0), F.log(f"`{size}`")).cast("float")
    d = d.select(F.col(f"`{group}`").alias("g"), F.col(f"`{entity}`").alias("e"), F.col(f"`{time}`").alias("t"), F.struct(F.col(f"`{x}`").cast("float").alias("x"), F.col(f"`{y}`").cast("float").alias("y"), s.alias("s")).alias("r"))
    d = d.groupBy("g", "e", "t").agg(F.max("r").alias("r"))
    one = F.struct(F.col("t").cast("int").alias("t"), "r.x", "r.y", "r.s")
    return d.groupBy("g", "e").agg(F.sort_array(F.collect_list(one)).alias("track"))


def _flat(track: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row number, t, x, y and s of all readings of a batch; a NULL s is NaN."""
    size = track.value_lengths().to_numpy(zero_copy_only=False)
    r = track.flatten()
    row = np.repeat(np.arange(len(size)), size)
    col = [r.field(c) for c in ("t", "x", "y", "s")]
    return row, col[0].to_numpy().astype(np.int64), col[1].to_numpy(), col[2].to_numpy(), col[3].to_numpy(zero_copy_only=False).astype(np.float32)


def _blocks(step: int) -> object:
    """Medians of each track over blocks of ``step`` time steps, in two systems that lie half a block apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, t, x, y, s = _flat(b.column("track"))
            for system in (0, 1):
                block = (t + system * (step // 2)) // step
                code = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                at = pa.array(row[first])
                med = [pa.array(group_median(code, v.astype(float))[first]) for v in (x, y, s)]
                yield pa.RecordBatch.from_arrays([b.column("g").take(at), b.column("e").take(at), pa.array((2 * block[first] + system).astype(np.int32)), *med], names=["g", "e", "block", "x", "y", "s"])

    return run


def _word(bin_: Column) -> Column:
    """The q-grams of a bin, q = 64 of 128 bins in a circle, as 64 bits: two words differ in as many bits as their bins lie apart."""
    b = F.pmod(bin_, F.lit(128)).cast("int")
    above = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), n)
    return F.when(b < 64, F.bitwise_not(above(b))).otherwise(above(b - 64))


def close_pairs(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """All pairs of rows of one ``g`` and ``block`` whose words ``wx, wy`` differ in at most ``radius`` bits together.

    Multi-index hashing: the bits are dealt into ``radius + 1`` chunks, every so many-th bit to one; words within the radius agree in at
    least one chunk whole. A pair that agrees in several is kept at the first. ``a`` and ``b`` may not share other column names.
    """
    m = radius + 1
    masks = [sum(1 << i for i in range(c, 64, m)) for c in range(m)]
    masks = [v - (1 << 64) if v >> 63 else v for v in masks]

    def keyed(d: DataFrame, s: str) -> DataFrame:
        chunks = F.array(*(F.struct(F.lit(c).alias("c"), F.col("wx").bitwiseAND(F.lit(v)).alias("cx"), F.col("wy").bitwiseAND(F.lit(v)).alias("cy")) for c, v in enumerate(masks)))
        d = d.select("*", F.explode(chunks).alias("k"))
        return d.select("g", "block", "k.*", *(F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in ("g", "block", "k")))

    p = keyed(a, "a").join(keyed(b, "b"), ["g", "block", "c", "cx", "cy"])
    dx, dy = F.col("wx_a").bitwiseXOR(F.col("wx_b")), F.col("wy_a").bitwiseXOR(F.col("wy_b"))
    first = F.lit(None).cast("int")
    for c, v in reversed(list(enumerate(masks))):
        first = F.when((dx.bitwiseAND(F.lit(v)) == 0) & (dy.bitwiseAND(F.lit(v)) == 0), F.lit(c)).otherwise(first)
    return p.where((F.bit_count(dx) + F.bit_count(dy) <= radius) & (F.col("c") == first))


GRAMS, CIRCLE = 64, 512  # q-grams of a number: 64 neighbouring bins of a circle of 512


def grams(x: np.ndarray, width: float) -> np.ndarray:
    """Bit vectors of the numbers ``x``, which reach a distance of ``width`` before they share no bit: a row of 8 words of 64 bits each; none for NaN."""
    there = ~np.isnan(x)
    bin_ = np.floor(np.where(there, x, 0) / width * GRAMS).astype(np.int64) % CIRCLE
    out = np.zeros((len(x), CIRCLE // 64), np.uint64)
    word, bit, row = bin_ // 64, (bin_ % 64).astype(np.uint64), np.arange(len(x))
    full = np.uint64((1 << 64) - 1)
    out[row, word] = np.where(there, full << bit, np.uint64(0))
    out[row, (word + 1) % (CIRCLE // 64)] = np.where(there, (np.uint64(1) << bit) - np.uint64(1), np.uint64(0))
    return out


def dice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dice scores of the rows of two arrays of ``grams``: the bits in common over the mean of their bits; all have as many."""
    return np.bitwise_count(a & b).sum(axis=1) / GRAMS


def _scores(m: Match) -> object:
    """Per pair of tracks and time shift: common readings and the sum of their Dice scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                c = b.slice(lo, 4096)
                n = c.num_rows
                ra, ta, xa, ya, sa = _flat(c.column("track_a"))
                rb, tb, xb, yb, sb = _flat(c.column("track_b"))
                ka, kb = (ra << 24) + ta + (1 << 20), (rb << 24) + tb + (1 << 20)
                mx, my, ms = (c.column(v).to_numpy() for v in ("mx", "my", "ms"))
                fields = [(grams(u, q), grams(v - w[rb], q), weight) for u, v, w, q, weight in (
                    (xa, xb, mx, m.q_place, m.weights[0]), (ya, yb, my, m.q_place, m.weights[1]), (sa, sb, ms, m.q_size, m.weights[2]))]
                sized_a, sized_b = ~np.isnan(sa), ~np.isnan(sb)
                common, dices, within, loose = [], [], [], []
                begin, end = np.full(n, 1 << 62), np.full(n, -(1 << 62))
                np.minimum.at(begin, ra, ta)
                np.maximum.at(end, ra, ta)
                for lag in range(-m.lag, m.lag + 1):
                    at = np.minimum(np.searchsorted(ka, kb + lag), max(len(ka) - 1, 0))
                    hit = ka[at] == kb + lag
                    at, of = at[hit], rb[hit]
                    sized = sized_a[at] & sized_b[hit]
                    # a reading without a size on either side is judged by its place alone
                    score = sum(weight * dice(u[at], v[hit]) for u, v, weight in fields) / np.where(sized, sum(m.weights), sum(m.weights[:2]))
                    common.append(np.bincount(of, minlength=n))
                    for counts, slack in ((within, 0), (loose, m.slack)):
                        counts.append(np.bincount(rb[(tb + lag >= begin[rb] - slack) & (tb + lag <= end[rb] + slack)], minlength=n))
                    dices.append(np.bincount(of, score, minlength=n))
                off = pa.array(np.arange(n + 1, dtype=np.int32) * (2 * m.lag + 1))
                lists = [pa.ListArray.from_arrays(off, pa.array(np.stack(v, 1).ravel().astype(ty))) for v, ty in ((common, np.int32), (within, np.int32), (loose, np.int32), (dices, np.float64))]
                size = c.column("track_b").value_lengths()
                yield pa.RecordBatch.from_arrays([c.column("g"), c.column("a"), c.column("b"), size, *lists], names=["g", "a", "b", "n_b", "common", "within", "loose", "dice"])

    return run


def candidate_pairs(a: DataFrame, b: DataFrame, m: Match = Match()) -> DataFrame:  # noqa: B008
    """Pairs of tracks that lie near in some block: ``g, a, b, n`` (blocks), mean differences ``dx, dy, ds`` and the spread of place."""
    width = m.shift / 2

    def records(t: DataFrame) -> DataFrame:
        kind = dict(t.dtypes)["e"]
        r = t.select("g", "e", "track").mapInArrow(_blocks(m.block), f"g string, e {kind}, block int, x double, y double, s double")
        return r.select("*", _word(F.floor(F.col("x") / width)).alias("wx"), _word(F.floor(F.col("y") / width)).alias("wy"))

    # a difference below two bins' width is at most two bins, in x and in y
    p = close_pairs(records(a), records(b), 4)
    dx, dy, ds = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"), F.nanvl(F.col("s_b") - F.col("s_a"), F.lit(None))
    p = p.where((F.abs(dx) < m.shift) & (F.abs(dy) < m.shift))
    return p.groupBy("g", F.col("e_a").alias("a"), F.col("e_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(dx).alias("dx"), F.avg(dy).alias("dy"), F.avg(ds).alias("ds"), (F.var_pop(dx) + F.var_pop(dy)).alias("spread"))


def shifts(pairs: DataFrame, most: float = 11.0) -> DataFrame:
    """The constant difference of the two sources per ``g``: ``mx, my, ms``, where most candidate pairs agree.

    Pairs vote in four grids of cells 4 wide that lie half a cell apart; long pairs whose difference hardly varies weigh most.
    """
    pairs = pairs.where((F.abs("dx") < most) & (F.abs("dy") < most))
    w = F.col("n") / (1.0 + F.col("spread"))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor((F.col("dx") + dx) / 4).alias("cx"), F.floor((F.col("dy") + dy) / 4).alias("cy")) for i, (dx, dy) in enumerate(((0, 0), (0, 2), (2, 0), (2, 2))))))
    v = pairs.select("g", "dx", "dy", "ds", w.alias("w"), grid.alias("c")).groupBy("g", "c").agg(
        F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("dx")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("dy")) / F.sum("w")).alias("my"),
        (F.sum(F.col("w") * F.col("ds")) / F.sum(F.when(F.col("ds").isNotNull(), F.col("w")))).alias("ms"))
    best = v.groupBy("g").agg(F.max(F.struct("w", "c", "mx", "my", "ms")).alias("m"))
    return best.select("g", "m.mx", "m.my", F.coalesce("m.ms", F.lit(0.0)).alias("ms"))


def best_lag(out: DataFrame, m: Match) -> DataFrame:
    """``g, lag``: the place in the lists of the time shift at which a group's pairs score most, the smallest of equals."""
    lag = out.select("g", F.posexplode("dice").alias("lag", "d")).groupBy("g", "lag").agg(F.sum("d").alias("d"))
    return lag.groupBy("g").agg(F.max_by("lag", F.struct("d", -F.abs(F.col("lag") - m.lag))).alias("lag"))


def scored_pairs(a: DataFrame, b: DataFrame, m: Match = Match(), shift: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Candidate pairs at the group's time shift: ``g, a, b, common`` (readings at one time), ``strict`` and ``score``; and the shifts ``g, mx, my, ms, lag``.

    Both are the mean Dice of the common readings times the share of b's readings that lie between a's first and last, so that
    readings missing inside a count for nothing and a pair that covers only a part of b counts for that part. ``score`` allows ``m.slack`` steps
    beyond either end, if at least ``m.part`` of b lies inside; ``strict`` decides between several a. A ``shift`` that is given is not sought. ``a`` and ``b`` are read more than once.
    """
    pairs = stage(candidate_pairs(a, b, m))
    s = shifts(pairs, m.most) if shift is None else shift
    near = pairs.join(s.select("g", "mx", "my", "ms"), "g").where((F.abs(F.col("dx") - F.col("mx")) < m.near) & (F.abs(F.col("dy") - F.col("my")) < m.near)).select("g", "a", "b", "mx", "my", "ms")
    d = near.join(a.select("g", F.col("e").alias("a"), F.col("track").alias("track_a")), ["g", "a"]).join(b.select("g", F.col("e").alias("b"), F.col("track").alias("track_b")), ["g", "b"])
    ty = dict(a.dtypes)["e"], dict(b.dtypes)["e"]
    out = stage(d.mapInArrow(_scores(m), f"g string, a {ty[0]}, b {ty[1]}, n_b int, common array<int>, within array<int>, loose array<int>, dice array<double>"))
    if shift is None:
        s = stage(s.join(best_lag(out, m), "g"))
    at = lambda c: F.element_at(c, F.col("lag") + 1)
    mean, share = at("dice") / at("common"), at("within") / F.col("n_b")
    score = mean * F.when(share >= m.part, at("loose") / F.col("n_b")).otherwise(share)
    return out.join(s.select("g", "lag"), "g").where(at("common") > 0).select("g", "a", "b", at("common").alias("common"), (mean * share).alias("strict"), score.alias("score")), s


BINS = 20


def calibrate(best: list[int], decoys: list[int]) -> list[float]:
    """Per bin of scores the share of true pairs among the best ones, made to rise with the score.

    ``best`` and ``decoys`` count the best pairs of the tracks and of their decoys in each bin. As many of the tracks' pairs are taken as false as the decoys have there;
    one pair more per bin, as likely as its score, stands in for what was not seen. Neighbouring bins that fall are pooled.
    """
    blocks: list[list[float]] = []
    for i, (x, y) in enumerate(zip(best, decoys, strict=True)):
        blocks.append([max(0, x - y) + (i + 0.5) / len(best), x + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            x2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [x / n for x, n, k in blocks for _ in range(int(k))]


def searched_pairs(a: DataFrame, b: DataFrame, m: Match = Match()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``scored_pairs``; groups whose shift found few matches are searched again more widely. The shifts have ``wide``, whether the second search gave them, and ``edge``.

    The wide search counts for a group if it gives ``m.weak`` of b's tracks a good score (0.5), which a false shift cannot. ``edge`` is how far the shift lies from 0 as a share
    of the bounds of its search: near 1 the true shift may lie beyond them.
    """

    def told(s: DataFrame, m: Match, wide: bool) -> DataFrame:
        edge = F.greatest(F.abs("mx") / m.most, F.abs("my") / m.most, F.abs(F.col("lag") - m.lag) / (m.lag + 1))
        return s.select("*", F.lit(wide).alias("wide"), edge.alias("edge"))

    p, s = scored_pairs(a, b, m)
    p, s = stage(p), told(s, m, False)
    size = b.groupBy("g").agg(F.count(F.lit(1)).alias("n_b"))
    good = lambda d: d.where("score >= 0.5").groupBy("g").agg(F.countDistinct("b").alias("good"))
    # a single track agrees with anything
    share = F.coalesce("good", F.lit(0)) / F.col("n_b")
    weak = stage(size.join(a.select("g").distinct(), "g").join(good(p), "g", "left").where((share < m.weak) & (F.col("n_b") >= 3)).select("g"))
    if not weak.limit(1).count():
        return p, s
    far = widened(m)
    q, t = scored_pairs(a.join(weak, "g", "left_semi"), b.join(weak, "g", "left_semi"), far)
    q, t = stage(q), told(t, far, True)
    better = stage(good(q).join(size, "g").where((share >= m.weak) & (F.col("good") >= 3)).select("g"))
    mixed = lambda x, y: x.join(better, "g", "left_anti").unionByName(y.join(better, "g", "left_semi"))
    return mixed(p, q), stage(mixed(s, t))


def widened(m: Match) -> Match:
    return replace(m, shift=m.wide * m.shift, most=m.wide * m.most, lag=round(m.wide * m.lag))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Per track of b the pair with the highest ``strict`` score, then the most common readings, then the smallest a."""
    best = pairs.groupBy("g", "b").agg(F.max(F.struct("strict", "common", (-F.col("a")).alias("a"), "score")).alias("m"))
    return best.select("g", (-F.col("m.a")).alias("a"), "b", "m.common", "m.score")


def decoys(b: DataFrame, m: Match) -> DataFrame:
    """``b`` with every track moved by ``m.decoy`` in both directions, where its own partner is out of reach."""
    moved = F.transform("track", lambda r: F.struct(r["t"].alias("t"), (r["x"] + F.lit(m.decoy).cast("float")).alias("x"), (r["y"] - F.lit(m.decoy).cast("float")).alias("y"), r["s"].alias("s")))
    return b.withColumn("track", moved)


def match(a: DataFrame, b: DataFrame, m: Match = Match()) -> DataFrame:  # noqa: B008
    """Tracks of ``b`` with the track of ``a`` that is the same thing: ``g, a, b, common, score, confidence``.

    ``a`` and ``b`` come from ``tracks``. Each b has at most one a, the best-scored (then the one with more common readings, then the smaller);
    an a may have several b. Pairs below ``m.confidence`` are left out. Groups that only one source has, and empty tables, give no rows.
    The calibration needs counts in 20 bins of scores of the best pairs and of the decoys' best pairs, all that reaches the driver.
    """
    return matched(a, b, m)[0]


def matched(a: DataFrame, b: DataFrame, m: Match = Match()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``match`` and the groups' shifts, see ``searched_pairs``."""
    a, b = stage(a), stage(b)
    pairs, shift = searched_pairs(a, b, m)
    best = stage(best_pairs(pairs))
    shift = stage(shift)
    # the decoys are judged at their group's shift, in the search that found it
    near, false = shift.where("not wide"), decoys(b, m)
    known = lambda s: false.join(s.select("g"), "g", "left_semi")
    known_a = lambda s: a.join(s.select("g"), "g", "left_semi")
    wrong = scored_pairs(known_a(near), known(near), m, near)[0]
    if shift.where("wide").limit(1).count():
        far = shift.where("wide")
        wrong = wrong.unionByName(scored_pairs(known_a(far), known(far), widened(m), far)[0])
    bin_ = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    tops, lows = ({r[0]: r[1] for r in d.groupBy(bin_).count().collect()} for d in (best, best_pairs(wrong)))
    curve = calibrate([tops.get(i, 0) for i in range(BINS)], [lows.get(i, 0) for i in range(BINS)])
    out = best.withColumn("confidence", F.element_at(F.array(*(F.lit(float(c)) for c in curve)), bin_ + 1))
    return out.where(F.col("confidence") >= m.confidence), shift
