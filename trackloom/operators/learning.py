"""Windows, sampling, scaling and evaluation of classifiers over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered, quantiles, running
from ..session import stage

#: First frame of the window of each phase used for learning, and the windows' length.
STARTS = ((1, 12), (2, 108), (3, 152), (4, 233))
LENGTH = 29


def life(rows: DataFrame) -> DataFrame:
    """Birth, death, label at birth and whether it is a daughter, per cell: seq, cell_id, birth, death, label, daughter."""
    return rows.groupBy("seq", "cell_id").agg(
        F.min("frame").alias("birth"), F.max("frame").alias("death"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("frame"))).alias("label"), F.max("daughter").alias("daughter"))


def qualifying(cells: DataFrame, starts: tuple[tuple[int, int], ...] = STARTS, length: int = LENGTH) -> DataFrame:
    """Cells that are no daughters and live through a window: phase, start, stop, seq, cell_id, label."""
    w = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(s).alias("start"), F.lit(s + length - 1).alias("stop")) for p, s in starts))).alias("w")
    d = cells.where("not daughter and label is not null").select("seq", "cell_id", "label", "birth", "death", w)
    return d.where("birth <= w.start and death >= w.stop").select("w.*", "seq", "cell_id", "label")


def survival(cells: DataFrame, lengths: range = range(5, 30, 3)) -> DataFrame:
    """How many qualifying cells of each class live through windows of growing length: phase, length, label, n."""
    out = None
    for n in lengths:
        q = qualifying(cells, length=n).groupBy("phase", "label").agg(F.count(F.lit(1)).alias("n")).select("phase", F.lit(n).alias("length"), "label", "n")
        out = q if out is None else out.unionByName(q)
    return out


def sample_order(*keys: str) -> Column:
    """A fixed shuffle that both a task and a plain SQL engine can compute: digits of an MD5 of the keys."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))


def balanced(q: DataFrame, ratio: int = 10) -> DataFrame:
    """All cells of class 1 and the first ``ratio`` times as many others by ``sample_order``, per phase.

    The others are ranked by counts of hash prefixes and then within a prefix, never in one task.
    """
    d = stage(q.withColumn("h", sample_order("phase", "seq", "cell_id")).withColumn("pre", F.conv(F.substring("h", 1, 3), 16, 10).cast("double")))
    rare = d.where("label = 1").groupBy("phase").agg((F.count(F.lit(1)) * ratio).alias("most"))
    counts = d.where("label = 0").groupBy("phase", "pre").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("phase").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("phase", "pre", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("phase", "pre").orderBy("h"))
    others = d.where("label = 0").withColumn("rank", rank).join(counts, ["phase", "pre"]).join(rare, "phase").where(F.col("rank") + F.col("before") <= F.col("most"))
    columns = ["phase", "seq", "cell_id", "label"]
    return d.where("label = 1").select(*columns).unionByName(others.select(*columns))


def first_of_each(q: DataFrame, most: int) -> DataFrame:
    """The first ``most`` cells of each class by ``sample_order``, per phase: as many of one as of the other where both have enough."""
    d = numbered(q.withColumn("h", sample_order("phase", "seq", "cell_id")), ["phase", "label"], [F.col("h").asc(), F.col("seq").asc(), F.col("cell_id").asc()], "place")
    return d.where(F.col("place") <= most).select("phase", "seq", "cell_id", "label")


def scaled(rows: DataFrame, by: str, features: list[str], fit: Column | None = None) -> DataFrame:
    """Features clipped to their 1 and 99 % quantiles, less the median, over the interquartile range (1 if 0), per ``by``; NULL stays NULL.

    Quantiles are those of the clipped values, as a scaler fitted after clipping sees them: clipping moves no value across a quartile.
    ``fit`` tells the rows that the quantiles come from (all if None), such as those of the training part.
    """
    fitted = rows if fit is None else rows.where(fit)
    out = rows
    for f in features:
        q = quantiles(fitted, [by], f, [0.01, 0.25, 0.5, 0.75, 0.99]).select(by, F.col("q").alias(f"_{f}"))
        x, iqr = F.col(f"_{f}"), F.col(f"_{f}")[3] - F.col(f"_{f}")[1]
        out = out.join(q, by, "left").withColumn(f, F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), x[0]), x[4]) - x[2]) / F.when(iqr == 0, 1.0).otherwise(iqr)).drop(f"_{f}")
    return out


def confusion(scored: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """Counts and derived measures of ``score >= threshold`` against ``label`` 0/1: precision, recall, F1, F0.5, F2, accuracies, MCC, G-mean."""
    hit = F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    y = F.col("label") == 1
    g = scored.groupBy(*by).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r, s = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fp)
    fb = lambda b: over((1 + b * b) * p * r, b * b * p + r)
    mcc = over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return g.select(
        *by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), s.alias("specificity"), fb(1.0).alias("f1"), fb(0.5).alias("f05"), fb(2.0).alias("f2"), over(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((r + s) / 2).alias("balanced_accuracy"), F.sqrt(r * s).alias("gmean"), mcc.alias("mcc"))


def curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts at every distinct score taken as threshold: by.., score, pos, neg (at it), pos_cum, neg_cum (at it or above)."""
    y = F.col("label") == 1
    return running(scored, by, "score", {"pos": y.cast("long"), "neg": (~y).cast("long")}, descending=True)


def areas(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision, per ``by``; NULL if a class is missing."""
    c = stage(curve(scored, by))
    total = c.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    d = c.join(total, by) if by else c.crossJoin(F.broadcast(total))  # one row
    won = F.col("pos") * (F.col("n") - F.col("neg_cum") + F.col("neg") / 2)
    ap = F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    g = d.groupBy(*by, "p", "n").agg(F.sum(won).alias("w"), F.sum(ap).alias("a"))
    ok = (F.col("p") > 0) & (F.col("n") > 0)
    return g.select(*by, F.when(ok, F.col("w") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(ok, F.col("a") / F.col("p")).alias("pr_auc"))


def best_threshold(scored: DataFrame, by: list[str]) -> DataFrame:
    """The score with the highest F1 as threshold (the largest of equals), per ``by``."""
    c = curve(scored, by)
    total = scored.groupBy(*by).agg(F.sum((F.col("label") == 1).cast("long")).alias("p"))
    d = c.join(total, by) if by else c.crossJoin(F.broadcast(total))  # one row
    f1 = 2 * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum") + F.col("p"))
    return d.groupBy(*by).agg(F.max(F.struct(F.round(f1, 12).alias("f1"), "score")).alias("m")).select(*by, F.col("m.score").alias("threshold"), F.col("m.f1").alias("f1"))


def hashed(*parts: Column, n: int) -> Column:
    """A number 0..n-1 out of an MD5 of the parts, which any engine can compute."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 6), 16, 10).cast("long"), F.lit(n)).cast("int")


#: Thousandths below which a Poisson number of mean 1 is at most 0, 1, 2 and 3.
POISSON = (368, 736, 920, 981)


def resampled(rows: DataFrame, keys: list[str], times: int = 20) -> DataFrame:
    """Every row once per resample ``round`` with a weight 0..4 that is nearly Poisson, the limit of drawing as many rows with replacement. Rows with weight 0 are left out.

    Weights come from hashes of the keys, so that the draws are independent of the partitions and can be repeated.
    """
    d = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("round"))
    h = hashed(F.col("round"), *(F.col(k) for k in keys), n=1000)
    weight = F.lit(len(POISSON))
    for k, below in reversed(list(enumerate(POISSON))):
        weight = F.when(h < below, k).otherwise(weight)
    return d.withColumn("weight", weight).where("weight > 0")


def holdouts(cells: DataFrame, reach: int = 3, starts: tuple[tuple[int, int], ...] = STARTS, length: int = LENGTH) -> DataFrame:
    """Cells that live through a phase's window moved by -reach..reach frames, with their part: phase, offset, seq, cell_id, label, part.

    At offset 0 a fifth of the cells, by hash, is 'test' and the rest 'train'; at the others all are 'holdout'.
    """
    out = None
    for o in range(-reach, reach + 1):
        q = qualifying(cells, tuple((p, s + o) for p, s in starts), length).select("phase", F.lit(o).alias("offset"), "seq", "cell_id", "label")
        out = q if out is None else out.unionByName(q)
    part = F.when(F.col("offset") != 0, "holdout").when(hashed(F.col("phase"), F.col("seq"), F.col("cell_id"), n=5) == 0, "test").otherwise("train")
    return out.withColumn("part", part)
