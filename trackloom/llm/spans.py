"""Long exact spans shared between records, by recompression.

A text is a row of symbols, at first its code points. In each round runs of one symbol become a symbol, then pairs of neighbours
become a symbol, so that equal stretches get equal symbols but for a few characters at their ends. Two kinds of rounds:

* Over characters, inside tasks. A symbol's name is a hash of what it is made of, so that all tasks agree without a dictionary of every pair of letters. Only
  symbols of at most ``limit`` characters take part in a round, so whether a border survives depends on at most ``reach()`` characters around it. Of these
  borders, every one that is the least named within some window stays: a landmark. It and the stretch around it, which lies inside any shared span of the length
  asked for, make a block, the symbol that the next rounds start from. Rounds without a limit make every text one symbol: equal texts have equal ones.
* Over blocks, by Spark. Blocks that stand in one record only are dropped; runs and pairs of touching neighbours get names from one dictionary of
  all records, which holds those that stand in more than one record. Rounds go on while they join more than a fifth of the symbols.

Symbols reveal the shared spans from the highest down: two records share a symbol, and what it is made of need not be compared again where it stands in equal
places of one higher symbol. A symbol of a span's length or more is a shared span; around shorter ones the texts decide, character by
character, and where very many records share one, they are first split by what stands before and behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


@dataclass(frozen=True)
class Levels:
    span: int = 300  # characters that a shared span must have
    limits: tuple[int, ...] = (1, 1, 2, 2, 4, 4, 8)  # longest symbols that take part, round by round

    def reach(self) -> int:
        """Characters on either side that decide about a border: each round looks over one symbol for runs and one for pairs."""
        return 2 * sum(self.limits)

    def window(self) -> int:
        """Any so many characters that are far enough from a shared span's ends hold a landmark."""
        return (self.span - 2 * self.reach()) // 2

    def after(self) -> int:
        """Characters of a key behind its landmark: the first landmark of a span has that much of it behind."""
        return self.span - self.reach() - self.window()

    def beyond(self) -> int:
        """Characters that a span has outside the key of its first landmark."""
        return self.span - self.reach() - self.after()


_ODD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier for hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(a + np.uint64(salt)) + b * np.uint64(0xC2B2AE3D27D4EB4F))


class Row:
    """Texts laid end to end as symbols: the name, the place and, for runs, the length of what is repeated (else 0) of each."""

    def __init__(self, points: np.ndarray, texts: np.ndarray):
        self.n = len(points)
        self.name = mix(points.astype(np.uint64) + np.uint64(1))
        self.at = np.arange(self.n, dtype=np.int64)
        self.unit = np.zeros(self.n, np.int32)
        self.first = np.zeros(self.n + 1, bool)
        self.first[texts] = True

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.at, self.n))

    def round(self, number: int, limit: int) -> None:
        """Name runs, then pairs, of symbols of at most ``limit`` characters; none reaches over two texts."""
        size = self.sizes()
        short, edge = size <= limit, self.first[self.at]
        same = np.zeros(len(self.at), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & short[1:] & ~edge[1:]
        if same.any():
            head = np.flatnonzero(~same)
            count = np.diff(np.append(head, len(self.at)))
            long_ = count > 1
            new, unit = self.name[head], self.unit[head]
            new[long_] = _pair(new[long_], count[long_].astype(np.uint64), 2 * number + 1)
            unit[long_] = size[head[long_]]
            self.name, self.at, self.unit = new, self.at[head], unit
            short, edge = self.sizes() <= limit, self.first[self.at]
        coin = (mix(self.name + np.uint64(number + 77)) >> np.uint64(40)) & np.uint64(1)
        right = np.zeros(len(self.at), bool)
        right[1:] = (coin[:-1] == 0) & (coin[1:] == 1) & short[1:] & short[:-1] & ~edge[1:]
        head = np.flatnonzero(~right)
        with_ = np.append(right[1:], False)[head]
        new, unit = self.name[head], self.unit[head]
        new[with_] = _pair(self.name[head[with_]], self.name[head[with_] + 1], 2 * number + 2)
        unit[with_] = 0
        self.name, self.at, self.unit = new, self.at[head], unit


def whole(row: Row, texts: int, number: int) -> np.ndarray:
    """The one symbol of each of the texts, all of which hold something."""
    while len(row.at) > texts:
        row.round(number, row.n)
        number += 1
    return row.name


def _least_within(at: np.ndarray, rank: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Which borders are the least of all borders of some ``window`` characters of their text (the rightmost of equals)."""
    n = len(at)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    # borders closer than the window on either side that are less (or equal, on the right); a border stays unless
    # the nearest such on the left and on the right are less than a window apart
    left, right = _nearest_less(rank, strict=True), n - 1 - _nearest_less(rank[::-1], strict=False)[::-1]
    far = np.int64(1) << 40
    l_at = np.where((left >= 0) & (text[np.maximum(left, 0)] == text), at[np.maximum(left, 0)], -far)
    r_at = np.where((right < n) & (text[np.minimum(right, n - 1)] == text), at[np.minimum(right, n - 1)], far)
    return (r_at - l_at) > window


def _nearest_less(x: np.ndarray, strict: bool) -> np.ndarray:
    """Index of the nearest earlier element that is less (or equal, if not strict), -1 if none; by pointer jumping."""
    n = len(x)
    near = np.arange(n) - 1
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        p = near[open_]
        bad = (x[p] >= x[open_]) if strict else (x[p] > x[open_])
        open_ = open_[bad]
        if not len(open_):
            break
        # what stands before a greater element and is not less than that one cannot be the answer either
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
    return near


def _landmarks(points: np.ndarray, texts: np.ndarray, lv: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text and name of every landmark's block, and two names of every whole text: its last symbol and a hash of its characters."""
    row = Row(points, texts)
    for number, limit in enumerate(lv.limits):
        row.round(number, limit)
    at, unit, size = row.at, row.unit, row.sizes()
    text = np.searchsorted(texts, at, side="right") - 1
    before, after = lv.reach(), lv.after()
    n = len(points)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + np.uint64(3)) * power[:n])])

    def stretch(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Polynomial hash of the characters lo..hi out of prefix sums, modulo 2^64."""
        return mix((sums[hi] - sums[lo]) * back[lo])

    near = max(lv.limits)
    rank = stretch(np.maximum(at - near, texts[:-1][text]), np.minimum(at + near, texts[1:][text]))
    keep = _least_within(at, rank, text, lv.window())
    place, of = at[keep], text[keep]
    # inside a long run nothing but the run's own repeats borders: one landmark per repeat, all with one key
    runs = np.flatnonzero((unit > 0) & (size > lv.window() // 2))
    if len(runs):
        count = size[runs] // np.maximum(unit[runs], 1) + 1
        inner = np.repeat(at[runs], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * np.repeat(unit[runs], count)
        place, of = np.concatenate([place, inner]), np.concatenate([of, np.repeat(text[runs], count)])
    begin, end = texts[:-1][of], texts[1:][of]
    fits = (place - before >= begin) & (place + after <= end)
    place, of = place[fits], of[fits]
    key = stretch(place - before, place + after)
    if len(runs):
        order = np.lexsort((place, key, of))
        of, key, place = of[order], key[order], place[order]
        # repeats of one run: the first two, the last two and one in every window of neighbours with one key stay
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1]) & (place[1:] - place[:-1] <= lv.window())
        inner = same & np.append(same[1:], False)
        inner = inner & np.append(False, inner[:-1]) & np.append(inner[1:], False)
        inner[1:] &= place[1:] // lv.window() == place[:-1] // lv.window()
        of, key, place = of[~inner], key[~inner], place[~inner]
    return of, place - texts[:-1][of], key, whole(row, len(texts) - 1, len(lv.limits)), stretch(texts[:-1], texts[1:])


def _emit(lv: Levels, most: int = 1 << 20) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            start = 0
            while start < len(ids):
                stop, n = start, 0
                while stop < len(ids) and (stop == start or n + len(texts[stop]) <= most):
                    n += len(texts[stop])
                    stop += 1
                part = texts[start:stop]
                points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
                of, place, key, *names = _landmarks(points, offsets, lv)
                own, n = np.array(ids[start:stop], np.int64), stop - start
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([own, own[of]])), pa.array(np.concatenate([np.full(n, -1, np.int32), place.astype(np.int32)])),
                    pa.array(np.concatenate([names[0], key]).view(np.int64)), pa.array(np.concatenate([names[1], np.zeros(len(key), np.uint64)]).view(np.int64))], names=["id", "place", "name", "check"])
                start = stop

    return run


def blocks(docs: DataFrame, id_: str, text: str, lv: Levels = Levels()) -> DataFrame:  # noqa: B008
    """``id, place, name, check``: the block of every landmark, and at place -1 the names of the whole text. Texts shorter than a span have none. Nothing is shuffled."""
    d = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    d = d.where(F.col("id").isNotNull() & (F.length("text") >= lv.span))
    return d.mapInArrow(_emit(lv), "id long, place int, name long, check long")


def shared_blocks(marks: DataFrame) -> DataFrame:
    """``id, place, name`` of the blocks that stand in more than one record."""
    own = marks.where("place >= 0").select("id", "place", "name").distinct()
    return own.join(own.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("name"), "name")


def copies(marks: DataFrame) -> DataFrame:
    """Records whose whole text, as one symbol, stands in several: ``id, rep``, the smallest id with that text (itself included)."""
    d = marks.where("place = -1").select("id", "name", "check")
    reps = d.groupBy("name", "check").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    return d.join(reps, ["name", "check"]).select("id", "rep").distinct()


_SYMBOL = ["id", "level", "name", "start", "last"]


def recompressed(kept: DataFrame, touch: int) -> DataFrame:
    """All symbols over the blocks ``kept`` (id, place, name): id, level, name, start, last (landmark), up (name of the symbol that it went into, NULL: none) and role (its place in that).

    A round compares each symbol of a record with its neighbours, at most ``touch`` characters away: equal ones make a run; one whose hash is the least
    among them makes a pair with the next. A run or pair gets a name in the round's dictionary if it stands in more than one record. A round that takes out
    a fifth of the symbols or less is the last: what stays apart is revealed as it is.
    """
    row = kept.select("id", F.lit(0).alias("level"), "name", F.col("place").alias("start"), F.col("place").alias("last"))
    done, number = None, 0
    while True:
        number += 1
        w = Window.partitionBy("id").orderBy("start", "last", "name")
        rank = F.xxhash64("name", "round")
        d = row.withColumn("round", F.lit(number)).withColumn("me", F.struct("level", "name", "start", "last", rank.alias("rank")))
        d = d.withColumn("before", F.lag("me").over(w)).withColumn("next", F.lead("me").over(w))
        d = d.withColumn("before", F.when(F.col("start") - F.col("before.last") <= touch, F.col("before"))).withColumn("next", F.when(F.col("next.start") - F.col("last") <= touch, F.col("next")))
        alike = lambda c: F.coalesce((F.col(f"{c}.level") == F.col("level")) & (F.col(f"{c}.name") == F.col("name")), F.lit(False))
        # a run's symbols are equal and equally far apart
        d = d.withColumn("gap", F.when(alike("before"), F.col("start") - F.col("before.start"))).withColumn("on", F.col("gap").isNotNull() & (F.col("gap") == F.coalesce(F.lag("gap").over(w), "gap")))
        d = d.withColumn("run", F.col("on") | F.coalesce(F.lead("on").over(w), F.lit(False))).withColumn("island", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
        least = F.col("next").isNotNull() & (rank < F.coalesce("before.rank", F.lit((1 << 63) - 1))) & (rank <= F.col("next.rank"))
        d = d.withColumn("head", ~F.col("run") & least & ~F.coalesce(F.lead("run").over(w), F.lit(True)))
        d = d.withColumn("tail", F.coalesce(F.lag("head").over(w), F.lit(False)))
        whole_run = Window.partitionBy("id", "island")
        d = d.withColumn("from", F.min("start").over(whole_run)).withColumn("to", F.max("last").over(whole_run)).withColumn("count", F.count(F.lit(1)).over(whole_run)).withColumn("gap", F.max(F.when(F.col("on"), F.col("gap"))).over(whole_run))
        first = F.when(F.col("run"), F.col("from")).when(F.col("head"), F.col("start")).when(F.col("tail"), F.col("before.start"))
        end = F.when(F.col("run"), F.col("to")).when(F.col("head"), F.col("next.last")).when(F.col("tail"), F.col("last"))
        parts = lambda a, b: F.xxhash64("round", f"{a}.level", f"{a}.name", F.col(f"{b}.start") - F.col(f"{a}.start"), f"{b}.level", f"{b}.name")
        made = F.when(F.col("run"), F.xxhash64("round", "level", "name", "count", "gap")).when(F.col("head"), parts("me", "next")).when(F.col("tail"), parts("before", "me"))
        d = d.select(*_SYMBOL, made.alias("up"), first.alias("first"), end.alias("end"))
        named = d.where("up is not null and start = first").groupBy("up").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("up", F.lit(True).alias("named"))
        d = stage(d.join(named, "up", "left").withColumn("up", F.when(F.col("named"), F.col("up"))).drop("named"))
        went = d.where("up is not null")
        up = went.where("start = first").select("id", F.lit(number).alias("level"), F.col("up").alias("name"), "start", F.col("end").alias("last")).distinct()
        row = d.where("up is null").select(*_SYMBOL).unionByName(up)
        went = went.select(*_SYMBOL, "up", (F.col("start") - F.col("first")).alias("role"))
        done = went if done is None else done.unionByName(went)
        n, taken = d.agg(F.count(F.lit(1)), F.count(F.when(F.col("start") > F.col("first"), F.col("up")))).first()
        if taken * 5 <= n:
            break
    return done.unionByName(row.select(*_SYMBOL, F.lit(None).cast("long").alias("up"), F.lit(None).cast("int").alias("role")))


def dealt_pairs(rows: DataFrame, key: list[str], group: int = 512) -> DataFrame:
    """Pairs of ``rows`` (with ``n``, how many share the key) of different records, the smaller id first: the key, and all other columns with _a and _b.

    One side of a key with many rows is dealt over parts, to which the other side is copied, so that no task holds all pairs of a key.
    """
    parts = F.ceil(F.col("n") / group).cast("int")
    a, b = (rows.select(*key, salt.alias("salt"), *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in (*key, "n"))) for s, salt in (
        ("a", F.pmod(F.xxhash64("id", "start"), parts).cast("int")), ("b", F.explode(F.sequence(F.lit(0), parts - 1)))))
    return a.join(b, [*key, "salt"]).where("id_a < id_b").drop("salt")


#: the two rows of a pair are not the same part of one higher symbol
_APART = "not coalesce(up_a = up_b and role_a = role_b, false)"


def surrounded(symbols: DataFrame, docs: DataFrame, id_: str, text: str, lv: Levels) -> DataFrame:
    """Short symbols with the text around them: ``mid`` (a hash of what the symbol covers), up to ``need`` characters before (``lead``) and behind (``tail``)."""
    d = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    d = symbols.join(d.where(F.col("id").isNotNull() & (F.length("text") >= lv.span)), "id")
    lo, size = F.col("start") - lv.reach(), F.col("last") - F.col("start") + lv.reach() + lv.after()
    return d.select(
        *symbols.columns, F.xxhash64(F.substring("text", lo + 1, size)).alias("mid"), F.substring("text", F.greatest(lo - F.col("need"), F.lit(0)) + 1, F.least(lo, F.col("need"))).alias("lead"),
        F.substring("text", lo + size + 1, F.col("need")).alias("tail"))


def split_groups(rows: DataFrame, most: int = 16) -> DataFrame:
    """Rows of ``surrounded`` with ``key``: rows of two records that share a span through their symbol share a key, of which ``n`` rows have one.

    Two such rows agree in as many characters before and behind the symbol as are needed in all, so in half of them (rounded up) before or behind. Keys of more than ``most`` rows are
    split by these halves, then by halves of the rest, until few rows share one or nothing is needed any more: rows that share a symbol and nothing around it meet nobody.
    """
    open_ = rows.select("*", F.xxhash64("level", "name", "mid").alias("key"), F.lit(0).alias("ahead"), F.lit(0).alias("behind"))

    def counted(d: DataFrame) -> DataFrame:
        n = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "n")
        return stage(d.join(n, "key"))

    open_, ready = counted(open_), None
    while True:
        rest = F.col("need") - F.col("ahead") - F.col("behind")
        fine = open_.where((F.col("n") <= most) | (rest <= 0))
        ready = fine if ready is None else ready.unionByName(fine)
        many = open_.where((F.col("n") > most) & (rest > 0)).drop("n")
        if not many.limit(1).count():
            return ready.drop("ahead", "behind")
        half = F.ceil(rest / 2).cast("int")
        before = F.when(F.length("lead") >= F.col("ahead") + half, F.struct(F.substr("lead", F.length("lead") - F.col("ahead") - half + 1, half).alias("s"), (F.col("ahead") + half).alias("ahead"), F.col("behind").alias("behind"), F.lit(0).alias("side")))
        after = F.when(F.length("tail") >= F.col("behind") + half, F.struct(F.substr("tail", F.col("behind") + 1, half).alias("s"), F.col("ahead").alias("ahead"), (F.col("behind") + half).alias("behind"), F.lit(1).alias("side")))
        many = many.withColumn("h", F.explode(F.filter(F.array(before, after), lambda x: x.isNotNull())))
        many = many.withColumn("key", F.xxhash64("key", "h.side", "h.s")).withColumn("ahead", F.col("h.ahead")).withColumn("behind", F.col("h.behind")).drop("h")
        open_ = counted(many)


def candidates(docs: DataFrame, id_: str, text: str, symbols: DataFrame, lv: Levels) -> DataFrame:
    """Pairs of short symbols' rows whose surroundings are to be compared; ``symbols``: rows of ``recompressed``."""
    short = symbols.where(F.col("last") - F.col("start") + lv.reach() + lv.after() < lv.span)
    short = short.withColumn("need", lv.span - lv.reach() - lv.after() - F.col("last") + F.col("start"))
    return dealt_pairs(split_groups(surrounded(short, docs, id_, text, lv)), ["key"]).where(_APART)


def span_matches(docs: DataFrame, id_: str, text: str, marks: DataFrame, same: DataFrame, lv: Levels = Levels()) -> DataFrame:  # noqa: B008
    """Where two records with different texts share a span: ``a, b, place_a, place_b``, the smaller id first; a row or more per maximal stretch.

    Symbols of at least a span are shared spans (two blocks or more make them up, each known by a 64-bit hash). Shorter ones must agree in a second 64-bit hash of
    what they cover, and around that the texts are compared character by character.
    Whole copies (``same``) are left to their representatives, so that a text that stands in very many records is compared once.
    """
    own = marks.join(same.where("id <> rep").select("id"), "id", "left_anti")
    symbols = stage(recompressed(shared_blocks(own), lv.reach() + lv.after()))
    # symbols that always stand in one place of one higher symbol tell nothing new
    where = F.struct("up", "role")
    group = symbols.groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"), F.count("up").alias("inner"), F.min(where).alias("p"), F.max(where).alias("q"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    group = group.where("lo < hi and (inner < n or p <> q)").select("level", "name", "n")
    symbols = stage(symbols.join(group, ["level", "name"]))
    long_ = dealt_pairs(symbols.where(F.col("last") - F.col("start") + lv.reach() + lv.after() >= lv.span), ["level", "name"]).where(_APART)
    p = candidates(docs, id_, text, symbols.drop("n"), lv)
    need = F.col("need_a")
    room = lambda s: F.least(F.length(f"{s}_a"), F.length(f"{s}_b"))
    behind = lambda s, i: F.substr(f"lead_{s}", F.length(f"lead_{s}") - i + 1)
    ahead = lambda s, i: F.substr(f"tail_{s}", F.lit(1), need - i)
    low, high = F.greatest(F.lit(0), need - room("tail")), F.least(need, room("lead"))
    ok = F.exists(F.sequence(low, high), lambda i: (behind("a", i) == behind("b", i)) & (ahead("a", i) == ahead("b", i)))
    p = p.where((F.col("mid_a") == F.col("mid_b")) & (low <= high) & ok)
    pick = lambda d: d.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("start_a").alias("place_a"), F.col("start_b").alias("place_b"))
    return pick(long_).unionByName(pick(p))


def _expanded(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Pairs of representatives to pairs of all records, with the pairs inside the classes of copies."""
    p = pairs
    for c in "ab":
        p = p.join(same.select(F.col("rep").alias(c), F.col("id").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).select("a", "b")
    sized = same.join(same.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "rep").withColumn("start", F.lit(0))
    inside = dealt_pairs(sized, ["rep"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inside)


def span_pairs(docs: DataFrame, id_: str, text: str, lv: Levels = Levels()) -> DataFrame:  # noqa: B008
    """Pairs of records with an identical stretch of at least ``lv.span`` code points: ``a, b``, the smaller id first.

    NULL texts, NULL ids and texts shorter than the span have no pairs; repeated rows of one id count as one record; an
    empty table gives no rows; other columns are ignored. Found between classes of whole copies, then expanded. See ``span_matches``.
    """
    marks = stage(blocks(docs, id_, text, lv))
    same = stage(copies(marks))
    return _expanded(span_matches(docs, id_, text, marks, same, lv).select("a", "b").distinct(), same)


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal common stretch around two places that are known to agree: its first and last character in both texts."""
    for t in batches:
        out: list[tuple[int, int, int]] = []
        for a, b, i, j, x, y in zip(*(t.column(c).to_pylist() for c in ("a", "b", "place_a", "place_b", "text_a", "text_b")), strict=True):
            u, v = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (x, y))
            n = min(len(u) - i, len(v) - j)
            d = np.flatnonzero(u[i : i + n] != v[j : j + n])
            right = int(d[0]) if len(d) else n
            n = min(i, j)
            d = np.flatnonzero(u[i - n : i] != v[j - n : j])
            left = n - 1 - int(d[-1]) if len(d) else n
            out += [(a, i - left, i + right), (b, j - left, j + right)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], ty) for k, ty in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["id", "lo", "hi"])


def shared_lengths(docs: DataFrame, id_: str, text: str, lv: Levels = Levels()) -> DataFrame:  # noqa: B008
    """For every record: ``id, n_chars, n_shared`` (characters inside some span shared with another record), ``n_partners``.

    NULL texts have n_chars 0. Spans that overlap count once. Rows with a NULL id are left out; repeated rows of one id give one row.
    """
    marks = stage(blocks(docs, id_, text, lv))
    same = stage(copies(marks))
    found = stage(span_matches(docs, id_, text, marks, same, lv).distinct())
    whole = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where("id is not null")
    whole = whole.groupBy("id").agg(F.max("text").alias("text"))
    d = found
    for s in "ab":
        d = d.join(whole.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")), s)
    parts = d.select("a", "b", "place_a", "place_b", "text_a", "text_b").mapInArrow(_extents, "id long, lo int, hi int").distinct()
    w = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(w), F.lit(0))))
    length = parts.select("id", new.alias("new")).groupBy("id").agg(F.sum("new").alias("n_shared"))
    partners = _expanded(found.select("a", "b").distinct(), same)
    partners = partners.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_partners"))
    out = whole.select("id", F.length("text").cast("long").alias("n_chars")).join(length, "id", "left").join(partners, "id", "left")
    out = out.join(same, "id", "left").withColumn("n_shared", F.when(F.col("rep").isNotNull(), F.col("n_chars")).otherwise(F.col("n_shared")))
    return out.select("id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("n_partners", F.lit(0)).alias("n_partners"))
