"""Splits that keep related records together.

Groups are the connected components of links, found by hooking and shortcutting over parent arrays: first inside a task,
where whole arrays are hooked and shortcut at once, then over joined tables until nothing moves. Split totals are met by
subset-sum bitsets over the multiplicities of group sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import group_codes, whole_groups
from ..session import stage

_STAR = "g string, node int, root int"


def hook_and_shortcut(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected node of each of ``n`` nodes under the links ``a[i] - b[i]``."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            top = up[up]
            if (top == up).all():
                break
            up = top
    return up


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links g, a, b sorted by (g, block): a star per component, each node with its smallest node, the root included."""
    for t in whole_groups(batches, ["g", "block"], 1 << 18):
        code = group_codes(t, ["g"]).astype(np.int64)
        g = t["g"].combine_chunks()
        key = np.concatenate([(code << 33) + t[c].to_numpy().astype(np.int64) + (1 << 31) for c in ("a", "b")])
        nodes, first, of = np.unique(key, return_index=True, return_inverse=True)
        up = hook_and_shortcut(len(nodes), of[: len(code)], of[len(code) :])
        number = ((nodes & ((1 << 33) - 1)) - (1 << 31)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([g.take(pa.array(first % len(code))), pa.array(number), pa.array(number[up])], names=["g", "node", "root"])


def components(links: DataFrame, block: int = 4096) -> DataFrame:
    """Connected components of ``links`` (g string, a int, b int): ``g, node, root``, root being the smallest node.

    A row per node, links of a node to itself included (a node with no other link is its own root). Links with a NULL are
    left out; repeated links change nothing; an empty table gives no rows.

    Links are dealt by (g, block of node numbers) and reduced to stars inside the tasks, so that one g may hold any share of
    all links. Nodes that got more than one root link those roots; these few links go through rounds of hooking (smallest
    root met) and shortcutting (root of the root) over joined tables.
    """
    d = links.where("g is not null and a is not null and b is not null").select("g", "a", "b", F.floor(F.least("a", "b") / block).alias("block"))
    stars = stage(d.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_local, _STAR))
    low = stars.groupBy("g", "node").agg(F.min("root").alias("root"), F.max("root").alias("most"))
    roots = stars.join(low.where("root <> most").select("g", "node", F.col("root").alias("low")), ["g", "node"]).where("root <> low")
    edges = stage(roots.select("g", F.col("root").alias("a"), F.col("low").alias("b")).distinct())
    out = low.select("g", "node", "root")
    if not edges.limit(1).count():
        return out
    both = stage(edges.unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))))
    up = stage(both.groupBy("g", "a").agg(F.min("b").alias("m")).select("g", F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        # hook: the smallest root among the neighbours' roots, offered to one's own root
        far = both.join(up.select("g", F.col("node").alias("b"), F.col("root").alias("rb")), ["g", "b"]).groupBy("g", "a").agg(F.min("rb").alias("rb"))
        met = up.join(far.withColumnRenamed("a", "node"), ["g", "node"])
        offer = met.groupBy("g", F.col("root").alias("node")).agg(F.min("rb").alias("offer"))
        hooked = up.join(offer, ["g", "node"], "left").select("g", "node", F.least("root", "offer").alias("root"), F.col("root").alias("old"))
        hooked = met.select("g", "node", "rb").join(hooked, ["g", "node"]).select("g", "node", F.least("root", "rb").alias("root"), "old")
        hooked = stage(hooked)
        # shortcut twice
        for _ in range(2):
            tops = hooked.select("g", F.col("node").alias("root"), F.col("root").alias("top"))
            hooked = hooked.join(tops, ["g", "root"], "left").select("g", "node", F.coalesce("top", "root").alias("root"), "old")
        hooked = stage(hooked)
        up = hooked.select("g", "node", "root")
        if not hooked.where("root <> old").limit(1).count():
            break
    return out.join(up.select("g", F.col("node").alias("root"), F.col("root").alias("top")), ["g", "root"], "left").select("g", "node", F.coalesce("top", "root").alias("root"))


def closest_counts(sizes: list[tuple[int, int]], target: int, most: int = 1 << 26) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as can be.

    ``sizes`` holds (size, multiplicity), sizes above 0. Totals up to ``most`` are searched exactly. Totals beyond it are counted in units: sizes are
    rounded down to whole units, then what is too much is taken back, what is left is filled, largest groups first, and at last a part of the groups, of
    ``most`` rows at most, is dealt again exactly. That meets the target as a rule, but is proved to be closest only where it does.
    """
    total = sum(s * m for s, m in sizes)
    target = max(0, min(target, total))
    if total <= most:
        return _exact_counts(sizes, target)
    unit = -(-total // most)
    units: dict[int, list[tuple[int, int]]] = {}
    for s, m in sorted(sizes, reverse=True):
        if s >= unit:
            units.setdefault(s // unit, []).append((s, m))
    taken: dict[int, int] = {}
    for u, n in closest_counts([(u, sum(m for _, m in own)) for u, own in units.items()], target // unit, most).items():
        for s, m in units[u]:
            if k := min(m, n):
                taken[s] = k
                n -= k
    left = target - sum(s * k for s, k in taken.items())
    for s in sorted(taken, reverse=True):
        k = min(taken[s], max(0, -left) // s)
        taken[s] -= k
        left += k * s
    if left < 0:
        s = min(s for s, k in taken.items() if k)
        taken[s] -= 1
        left += s
    for s, m in sorted(sizes, reverse=True):
        k = min(m - taken.get(s, 0), max(0, left) // s)
        taken[s] = taken.get(s, 0) + k
        left -= k * s
    if not left:
        return {s: n for s, n in taken.items() if n}
    # some taken and some other groups of each size, the smallest first, are dealt again
    pool: dict[int, list[int]] = {}
    room, k = most, 1
    while room > 0 and k <= max(m for _, m in sizes):
        for s, m in sorted(sizes):
            own = pool.setdefault(s, [0, 0])
            for side, there in enumerate((taken.get(s, 0), m - taken.get(s, 0))):
                more = min(k, there - own[side], room // s)
                own[side] += more
                room -= more * s
        k *= 2
    goal = left + sum(s * a for s, (a, _) in pool.items())
    again = closest_counts([(s, a + b) for s, (a, b) in pool.items() if a + b], goal, most)
    if abs(goal - sum(s * n for s, n in again.items())) < abs(left):
        for s, (a, _) in pool.items():
            taken[s] = taken.get(s, 0) - a + again.get(s, 0)
    return {s: n for s, n in taken.items() if n}


def _exact_counts(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """``closest_counts`` by one integer whose bits are the reachable totals; a multiplicity is split into powers of two.

    For each total the item that reached it first is kept: what it leaves was reached by earlier items. The search ends when the target is reached.
    """
    items = []
    for s, m in sorted(sizes, reverse=True):
        k = 1
        while m > 0:
            items.append((s, min(k, m)))
            m -= k
            k *= 2
    # the closest total above the target exceeds it by less than a group
    high = min(sum(s * m for s, m in sizes), 2 * target, target + max((s for s, _ in sizes), default=0))
    words = high // 64 + 1
    limit = (1 << (high + 1)) - 1
    first = np.zeros(words * 64, np.int16 if len(items) < 1 << 15 else np.int32)
    bits = 1
    for i, (s, k) in enumerate(items):
        if bits >> target & 1:
            break
        if s * k > high:
            continue
        more = bits << s * k & limit & ~bits
        new = np.frombuffer(more.to_bytes(words * 8, "little"), "<u8")
        there = np.flatnonzero(new)
        for lo in range(0, len(there), 1 << 15):
            at = there[lo : lo + (1 << 15)]
            row, col = np.nonzero(np.unpackbits(new[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            first[at[row] * 64 + col] = i
        bits |= more
    below = (bits & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = bits >> (target + 1)
    rest = below
    if above:
        up = target + (above & -above).bit_length()
        rest = up if up - target < target - below else below
    taken: dict[int, int] = {}
    while rest > 0:
        s, k = items[first[rest]]
        taken[s] = taken.get(s, 0) + k
        rest -= s * k
    return taken


def assign_splits(groups: DataFrame, shares: dict[str, float], buckets: int = 256) -> DataFrame:
    """A split for every group: ``groups`` (id columns.., stratum, size) plus ``split``.

    Within each stratum every split gets rows as close to its share as whole groups allow; the last split gets the rest. Which
    groups of one size go where follows a hash of the ids, so that the result does not depend on the input's order. Sizes of 0 are
    no groups; a NULL stratum is one of its own. Only the histogram of sizes reaches the driver: distinct sizes add up to at most the row count, so there are
    fewer than sqrt(2 n) of them.
    """
    ids = [c for c in groups.columns if c not in ("stratum", "size")]
    h = groups.where("size > 0").withColumn("k", F.coalesce(F.col("stratum").cast("string"), F.lit("\0")))
    h = stage(h.withColumn("h", F.xxhash64(*ids)).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")))
    counts = h.groupBy("k", "size", "bucket").count()
    before = Window.partitionBy("k", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    hist: dict[str, dict[int, int]] = {}
    for r in h.groupBy("k", "size").count().collect():
        hist.setdefault(r[0], {})[r[1]] = r[2]
    plan, names = [], list(shares)
    for stratum, left in hist.items():
        total = sum(s * m for s, m in left.items())
        start = dict.fromkeys(left, 0)
        for name in names:
            taken = dict(left) if name == names[-1] else closest_counts(list(left.items()), round(total * shares[name]))
            for s, n in taken.items():
                if n:
                    plan.append((stratum, s, start[s], start[s] + n, name))
                    start[s] += n
                    left[s] -= n
            left = {s: m for s, m in left.items() if m}
    bounds = groups.sparkSession.createDataFrame(plan, "k string, size long, low long, high long, split string")
    rank = F.row_number().over(Window.partitionBy("k", "size", "bucket").orderBy("h", *ids)) - 1
    ranked = h.withColumn("in_bucket", rank).join(counts, ["k", "size", "bucket"]).withColumn("place", F.col("before") + F.col("in_bucket"))
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    return ranked.join(bounds, ["k", "size"]).where(inside).select(*ids, "stratum", "size", "split")
