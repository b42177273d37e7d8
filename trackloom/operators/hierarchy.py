"""Parent-child links to full hierarchies, by weighted disjoint-set forests.

Every node has at most one parent, so the links of a group form trees and, where the data are wrong, rings with trees
below them. A forest is three arrays per node: the node above it, the weighted distance to it and the smallest node
passed. Forests are built per block of node numbers inside a task (path compression over whole arrays), the few links
that leave a block are merged in wider blocks, and whatever is still open is closed by joins that double the distance
each round. No step holds more than one block, so one group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import group_codes, whole_groups
from ..session import stage

_FOREST = "g string, node int, root int, dist long, least int, ring int, next int"


def compress(up: np.ndarray, dist: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path compression of a whole forest: (root, distance, smallest node on the way, is on or below a ring)."""
    up, dist, least = up.copy(), dist.copy(), least.copy()
    for _ in range(max(1, int(len(up)).bit_length() + 1)):
        if (up[up] == up).all():
            break
        dist += dist[up]
        np.minimum(least, least[up], out=least)
        up = up[up]
    # a root points at itself at distance 0; what still moves has a ring above it
    return up, dist, least, (dist[up] != 0) | (up[up] != up)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns g, node, parent, weight, least (smallest node the link passes), sorted by g and block."""
    for t in whole_groups(batches, ["g", "block"]):
        code = group_codes(t, ["g"]).astype(np.int64)
        node = t["node"].to_numpy().astype(np.int64)
        has = ~t["parent"].is_null().to_numpy(zero_copy_only=False)
        parent = t["parent"].fill_null(0).to_numpy().astype(np.int64)
        key, pkey = (code << 33) + node + (1 << 31), (code << 33) + parent + (1 << 31)
        order = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key, pkey, sorter=order), len(key) - 1)
        inside = has & (key[order[at]] == pkey)
        self_ = np.arange(len(key))
        up0 = np.where(inside, order[at], self_)
        w = t["weight"].to_numpy()
        low = t["least"].to_numpy().astype(np.int64)
        up, dist, least, ring = compress(up0, np.where(inside, w, 0), np.where(inside, low, node))
        ring |= inside[up] & (up0[up] == up)  # a node that names itself
        root = node[up]
        ringed = least[up]
        out_next = pa.array(np.where(has & ~inside, parent, 0)[up].astype(np.int32), mask=ring | ~(has & ~inside)[up])
        yield pa.RecordBatch.from_arrays([
            t["g"].combine_chunks(), pa.array(node.astype(np.int32)), pa.array(root.astype(np.int32)), pa.array(dist),
            pa.array(least.astype(np.int32)), pa.array(ringed.astype(np.int32), mask=~ring), out_next,
        ], names=["g", "node", "root", "dist", "least", "ring", "next"])


def _merge(links: DataFrame, block: int) -> DataFrame:
    """links: g, node, parent, weight, least. Gives _FOREST; ``next`` is the parent outside the block of the root."""
    d = links.withColumn("block", F.floor(F.col("node") / block))
    d = d.repartition("g", "block").sortWithinPartitions("g", "block")
    return d.select("g", "block", "node", "parent", "weight", "least").mapInArrow(_forests, _FOREST)


def _links(nodes: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    d = nodes.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{node}`").cast("int").alias("node"), F.col(f"`{parent}`").cast("int").alias("parent"))
    d = d.where("g is not null and node is not null").withColumn("weight", F.lit(1).cast("long"))
    return d.withColumn("least", F.col("node"))


def forest(nodes: DataFrame, group: str, node: str, parent: str, block: int = 4096, widen: int = 64) -> DataFrame:
    """Root, depth and ring of every node: columns ``group, node, root, depth, ring``.

    ``nodes`` has one row per existing node. A parent that is NULL or is no node of its group ends the line: the node is
    a root of depth 0. A node whose line never ends (on a ring or below one, a node naming itself included) has NULL
    root and depth, and in ``ring`` the smallest node of that ring. Rows with a NULL group or node are left out; an empty
    table gives no rows; other columns are ignored.
    """
    base = stage(_merge(_links(nodes, group, node, parent), block))
    cross = stage(_crossing(base))
    out = base.select("g", "node", "root", "dist", "ring")
    if cross.limit(1).count():
        far = _solve(cross, block * widen)
        rings = base.where("ring is not null").select("g", F.col("node").alias("top"), F.col("ring").alias("at_top"))
        far = far.join(rings, ["g", "top"], "left").select(
            "g", F.col("node").alias("root"), "top", F.col("dist").alias("more"), F.coalesce("ring", "at_top").alias("above"))
        out = out.join(far, ["g", "root"], "left").select(
            "g", "node", F.coalesce("top", "root").alias("root"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("ring", "above").alias("ring"))
    ends = F.col("ring").isNull()
    return out.select(
        F.col("g").alias(group), F.col("node").alias(node), F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("dist")).alias("depth"), "ring")


def _crossing(base: DataFrame) -> DataFrame:
    """The links that leave a block, between block roots: g, node, parent, weight, least. Parents that exist nowhere drop out."""
    leaving = base.where("node = root and next is not null").select("g", "node", "next")
    at = base.select("g", F.col("node").alias("next"), F.col("root").alias("parent"), (F.col("dist") + 1).alias("weight"), F.col("least").alias("low"))
    return leaving.join(at, ["g", "next"]).select("g", "node", "parent", "weight", F.least("node", "low").alias("least"))


def _solve(links: DataFrame, block: int) -> DataFrame:
    """Follow every link to its top, a parent that has no link itself: g, node, top, dist, ring (of the links alone)."""
    wide = stage(_merge(links, block))
    own = links.select("g", "node", "weight", F.col("least").alias("own"))
    there = wide.select("g", F.col("node").alias("next"), F.col("root").alias("up"), F.col("dist").alias("d"), F.col("least").alias("l"), F.col("ring").alias("ring"))
    hop = wide.where("node = root and ring is null").select("g", "node", "next").join(own, ["g", "node"]).join(there, ["g", "next"], "left")
    hop = stage(hop.select(
        "g", "node", F.coalesce("up", "next").alias("up"), (F.col("weight") + F.coalesce("d", F.lit(0))).alias("dist"), F.least("own", "l").alias("least"), "ring"))
    closed = False
    for _ in range(hop.count().bit_length() + 1):
        over = hop.select("g", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("least").alias("l2"), F.col("ring").alias("r2"))
        both = hop.join(over, ["g", "up"], "left").withColumn("moved", F.col("up2").isNotNull() & F.col("ring").isNull())
        hop = stage(both.select(
            "g", "node", F.when(F.col("moved"), F.col("up2")).otherwise(F.col("up")).alias("up"),
            F.when(F.col("moved"), F.col("dist") + F.col("d2")).otherwise(F.col("dist")).alias("dist"),
            F.when(F.col("moved"), F.least("least", "l2")).otherwise(F.col("least")).alias("least"),
            F.when(F.col("moved"), F.col("r2")).otherwise(F.col("ring")).alias("ring"), "moved"))
        closed = not hop.where("moved").limit(1).count()
        if closed:
            break
    if not closed:  # what still moves after more doublings than there are nodes stands on or below a ring
        ring = hop.select("g", F.col("node").alias("up"), F.col("least").alias("l2"))
        hop = hop.join(ring, ["g", "up"], "left").withColumn("ring", F.coalesce("ring", "l2"))
    above = hop.select("g", F.col("node").alias("root"), F.col("up").alias("top"), F.col("dist").alias("more"), F.col("ring").alias("above"))
    return wide.join(above, ["g", "root"], "left").select(
        "g", "node", F.coalesce("top", "root").alias("top"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("ring", "above").alias("ring"))


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node from its block's root, by parent traversal over a sorted index."""
    for t in whole_groups(batches, ["g", "block"]):
        code = group_codes(t, ["g"]).astype(np.int64)
        node = t["node"].to_numpy().astype(np.int64)
        has = ~t["parent"].is_null().to_numpy(zero_copy_only=False)
        parent = t["parent"].fill_null(0).to_numpy().astype(np.int64)
        key, pkey = (code << 33) + node + (1 << 31), (code << 33) + parent + (1 << 31)
        order = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key, pkey, sorter=order), len(key) - 1)
        inside = has & (key[order[at]] == pkey)
        up0 = np.where(inside, order[at], np.arange(len(key)))
        up, dist, _, _ = compress(up0, inside.astype(np.int64), node)
        leaves = pa.array(parent.astype(np.int32), mask=~(has & ~inside))
        for rows in _batches_of(dist + 1):
            off = np.concatenate([[0], np.cumsum(dist[rows] + 1)])
            flat = np.empty(off[-1], np.int32)
            cur, place = rows, off[1:] - 1
            while len(cur):
                flat[place] = node[cur]
                on = inside[cur]
                cur, place = up0[cur[on]], place[on] - 1
            yield pa.RecordBatch.from_arrays([
                t["g"].combine_chunks().take(pa.array(rows)), pa.array(node[rows].astype(np.int32)), pa.array(node[up[rows]].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat)), leaves.take(pa.array(up[rows])),
            ], names=["g", "node", "root", "path", "next"])


def _batches_of(size: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Row numbers in runs whose sizes add up to about ``most``."""
    part = np.cumsum(size) // most
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        if len(rows):
            yield rows


def paths(nodes: DataFrame, group: str, node: str, parent: str, block: int = 4096) -> DataFrame:
    """Every node with its whole line: ``group, node, root, depth, path, ring``; ``path`` runs from the root to the node.

    Nodes whose line never ends have NULL root, depth and path and their ring's smallest node in ``ring``. See ``forest``.
    """
    found = forest(nodes, group, node, parent, block).select(F.col(group).alias("g"), F.col(node).alias("node"), "ring")
    rings = found.where("ring is not null")
    links = _links(nodes, group, node, parent).join(rings.select("g", "node"), ["g", "node"], "left_anti")
    d = links.withColumn("block", F.floor(F.col("node") / block)).repartition("g", "block").sortWithinPartitions("g", "block")
    base = stage(d.select("g", "block", "node", "parent").mapInArrow(_local_paths, "g string, node int, root int, path array<int>, next int"))
    leaving = base.where("node = root and next is not null").select("g", "node", "next")
    at = base.select("g", F.col("node").alias("next"), F.col("root").alias("up"), F.col("path").alias("before"))
    before = stage(leaving.join(at, ["g", "next"]).select("g", "node", "up", "before"))
    moving = bool(before.limit(1).count())
    crossed = moving
    while moving:
        above = before.select("g", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("before").alias("b2"))
        nxt = before.join(above, ["g", "up"], "left")
        before = stage(nxt.select(
            "g", "node", F.coalesce("up2", "up").alias("up"), F.when(F.col("b2").isNull(), F.col("before")).otherwise(F.concat("b2", "before")).alias("before"), F.col("up2").isNotNull().alias("moved")))
        moving = bool(before.where("moved").limit(1).count())
        before = before.drop("moved")
    out = base.select("g", "node", "root", "path")
    if crossed:
        out = out.join(before.select("g", F.col("node").alias("root"), "before"), ["g", "root"], "left").select(
            "g", "node", F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
    out = out.select("g", "node", F.col("path")[0].alias("root"), (F.size("path") - 1).cast("long").alias("depth"), "path", F.lit(None).cast("int").alias("ring"))
    none = rings.select("g", "node", F.lit(None).cast("int").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<int>").alias("path"), "ring")
    return out.unionByName(none).select(F.col("g").alias(group), F.col("node").alias(node), "root", "depth", "path", "ring")


def descendants(path_rows: DataFrame, group: str, node: str) -> DataFrame:
    """All (ancestor, descendant, distance) pairs out of ``paths``: ``group, node, descendant, distance``.

    A row per pair, never an array per ancestor, so that a root above any share of the nodes fills no single row. A node
    is not its own descendant; nodes on or below rings have none.
    """
    d = path_rows.where("depth > 0").select(group, F.col(node).alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", node))
    return d.select(group, node, "descendant", (F.col("depth") - F.col("at")).alias("distance"))
