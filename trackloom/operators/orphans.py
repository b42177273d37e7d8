"""References to records that do not exist: sorted key arrays per range, probed by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "g string, key int, child int, at timestamp_ntz, state string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range, sorted by (g, key, is_ref): the keys of the range come before the references to them.

    The keys of a batch are a sorted array, with the last key of the batch before in front; the references of the batch
    are probed with one binary search.
    """
    group, keys, first, there = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g").dictionary_encode()
        code = np.asarray(g.indices)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        names = g.dictionary.take(pa.array(code[starts])).to_pylist()
        key = b.column("key").to_numpy().astype(np.int64)
        ref = b.column("is_ref").to_numpy(zero_copy_only=False)
        when = b.column("at").cast("int64")
        null_at = when.is_null().to_numpy(zero_copy_only=False)
        at = when.fill_null(np.iinfo(np.int64).min).to_numpy()
        live = b.column("live").fill_null(False).to_numpy(zero_copy_only=False)
        ordinal = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        # the group carried over from the last batch goes in front, under the number of its group here or none
        carried = np.full(len(keys), 0 if names[0] == group else -1)
        k_ord, k_key = np.concatenate([carried, ordinal[~ref]]), np.concatenate([keys, key[~ref]])
        k_first, k_live = np.concatenate([first, at[~ref]]), np.concatenate([there, live[~ref]])
        packed = (k_ord << 33) + k_key + (1 << 31)
        probe = (ordinal[ref] << 33) + key[ref] + (1 << 31)
        if len(probe):
            pos = np.searchsorted(packed, probe)
            safe = np.minimum(pos, max(len(packed) - 1, 0))
            hit = (packed[safe] == probe) if len(packed) else np.zeros(len(probe), bool)
            exists = hit & (k_live[safe] if len(packed) else False)
            late = exists & ~null_at[ref] & (k_first[safe] > at[ref] if len(packed) else False)
            state = np.where(~hit, "absent", np.where(~exists, "deleted", np.where(late, "late", "ok")))
            rows = pa.array(np.flatnonzero(ref)[state != "ok"])
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(rows) for c in ("g", "key", "child", "at")] + [pa.array(state[state != "ok"])], names=["g", "key", "child", "at", "state"])
        keep = np.flatnonzero(k_ord == ordinal[-1])[-1:]
        group, keys, first, there = names[-1], k_key[keep], k_first[keep], k_live[keep]


def orphans(refs: DataFrame, keys: DataFrame, hot: int = 100_000) -> DataFrame:
    """References whose key is absent, deleted or came later: ``g, child, key, at, state``.

    ``refs``: g (string), child (int), key (int), at (timestamp_ntz); a NULL g or key refers to nothing and is left out; a NULL ``at`` is
    never judged late. ``keys``: g, key, live (boolean, NULL counts as deleted), first (timestamp_ntz, when the key was first
    there; NULL counts as always); one row per key. Repeated references give repeated rows. Other columns are ignored.

    Keys and references are range-partitioned together by (g, key, part). A key with more than ``hot`` references (and
    more than a thousandth of all, so that there are at most a thousand) is repeated in ``1 + n / hot`` parts and its
    references are dealt over them, so that no range grows with one key.
    """
    refs = refs.where("g is not null and key is not null").select("g", "key", "child", "at")
    n = refs.groupBy("g", "key").count()
    many = max(hot, refs.count() // 1000)
    heavy = F.broadcast(n.where(F.col("count") > many).select("g", "key", (1 + F.floor(F.col("count") / hot)).cast("int").alias("parts")))
    r = refs.join(heavy, ["g", "key"], "left").select(
        "g", "key", F.coalesce(F.pmod(F.xxhash64("child"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), F.lit(True).alias("is_ref"), "child", "at", F.lit(None).cast("boolean").alias("live"))
    k = keys.where("g is not null and key is not null").join(heavy, ["g", "key"], "left").select(
        "g", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("is_ref"), F.lit(None).cast("int").alias("child"), F.col("first").alias("at"), "live")
    both = k.unionByName(r).repartitionByRange("g", "key", "part").sortWithinPartitions("g", "key", "part", "is_ref")
    return both.select("g", "key", "is_ref", "child", "at", "live").mapInArrow(_probe, _OUT)


def orphan_report(found: DataFrame, refs: DataFrame, tab: str) -> DataFrame:
    """Counts per table and month of loading: ``tab, period, n_refs, n_absent, n_deleted, n_late``.

    ``period`` is the first day of the month of ``at``, NULL for references without a time.
    """
    period = F.trunc(F.col("at"), "month").alias("period")
    total = refs.where("g is not null and key is not null").groupBy(period).agg(F.count(F.lit(1)).alias("n_refs"))
    by = found.groupBy(period).agg(*(F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("absent", "deleted", "late")))
    out = total.join(by.withColumnRenamed("period", "p"), F.col("period").eqNullSafe(F.col("p")), "left")
    return out.select(F.lit(tab).alias("tab"), "period", "n_refs", *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("absent", "deleted", "late")))
