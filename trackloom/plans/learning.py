"""Queries over labelled rows: windows, balanced samples, scaling, classifier measures, correlations, histograms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import cells as c
from ..operators import learning as ml
from ..session import shared_folder, stage, table
from .scores import rounded

FEATURES = {"Area": "area", "Volume": "volume", "Perimeter": "perimeter", "Solidity": "solidity", "Speed": "speed"}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labelled rows: seq, cell_id, frame, label, daughter (the parent's number is not 0), features; NaN is NULL; one row per key."""
    t = table(spark, d, "consensus_retrospective_labels").where(F.col("seq").isNotNull() & F.col("Cell ID").isNotNull() & F.col("Frame").isNotNull())
    parent = F.expr("try_cast(regexp_replace(trim(`Parent ID`), '[.]0+$', '') as int)")
    r = F.max(F.struct("rec_id", F.col("Label").alias("label"), (F.coalesce(parent, F.lit(0)) != 0).alias("daughter"), *(c.valid(k).alias(v) for k, v in FEATURES.items()))).alias("r")
    return t.groupBy("seq", F.col("Cell ID").alias("cell_id"), F.col("Frame").alias("frame")).agg(r).select("seq", "cell_id", "frame", "r.*").drop("rec_id")


def cell_life(spark: SparkSession, d: str) -> DataFrame:
    return ml.life(labelled(spark, d))


def qualifying_cells(spark: SparkSession, d: str) -> DataFrame:
    return ml.qualifying(ml.life(labelled(spark, d)))


def survival_windows(spark: SparkSession, d: str) -> DataFrame:
    return ml.survival(stage(ml.life(labelled(spark, d))))


def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return ml.balanced(ml.qualifying(ml.life(labelled(spark, d)), length=5))


def half_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 20 cells of each class by phase."""
    return ml.first_of_each(ml.qualifying(ml.life(labelled(spark, d)), length=5), 20)


def _phased(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).withColumn("phase", c.phase(F.col("frame"))).where("phase is not null")


def feature_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of Area and Volume by phase."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).alias("value")) for v in ("area", "volume")))).alias("f")
    q = ranks.quantiles(_phased(spark, d).select("phase", each).select("phase", "f.*"), ["phase", "feature"], "value", [0.01, 0.25, 0.5, 0.75, 0.99])
    return rounded(q.select("phase", "feature", F.col("n_values").alias("n"), *(F.col("q")[i].alias(n) for i, n in enumerate(("q01", "q25", "q50", "q75", "q99")))))


def robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    r = stage(_phased(spark, d).select("seq", "cell_id", "frame", "phase", "area", "volume"))
    return rounded(ml.scaled(r, "phase", ["area", "volume"]))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a label, Area as a score, phase and a fold out of a hash of the cell."""
    r = _phased(spark, d).where("label is not null and area is not null")
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "seq", F.col("cell_id").cast("string"))), 1, 6), 16, 10).cast("long"), F.lit(5))
    return r.select("phase", fold.cast("int").alias("fold"), "label", F.col("area").alias("score"))


def classifier_measures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ml.confusion(scored(spark, d), F.lit(300.0), ["phase"]))


def curve_areas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ml.areas(scored(spark, d), ["phase"]))


def best_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ml.best_threshold(stage(scored(spark, d)), ["phase"]))


def precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ml.curve(scored(spark, d), ["phase"]))


def fold_measures(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation over five folds of the measures at a fixed threshold, by phase."""
    m = ml.confusion(scored(spark, d), F.lit(300.0), ["phase", "fold"])
    return rounded(m.groupBy("phase").agg(*(f(v).alias(f"{v}_{n}") for v in ("precision", "recall", "f1", "mcc") for n, f in (("mean", F.avg), ("std", F.stddev_pop)))))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of every pair of features by phase."""
    r = _phased(spark, d)
    names = list(FEATURES.values())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    g = r.groupBy("phase").agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("p")
    return rounded(g.select("phase", each).select("phase", "p.*"))


def histograms(spark: SparkSession, d: str) -> DataFrame:
    """25 equal bins of Area by phase, the largest value in the last bin."""
    r = stage(_phased(spark, d).where("area is not null").select("phase", "area"))
    m = r.groupBy("phase").agg(F.min("area").alias("lo"), F.max("area").alias("hi"))
    b = F.least(F.floor((F.col("area") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 25), F.lit(24))
    return r.join(m, "phase").groupBy("phase", F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    """Cells and rows by seq and label, with the rows per row of class 1."""
    g = labelled(spark, d).groupBy("seq").agg(F.count(F.when(F.col("label") == 1, 1)).alias("rare"), F.count(F.when(F.col("label") == 0, 1)).alias("common"), F.count(F.when(F.col("label").isNull(), 1)).alias("unknown"))
    return rounded(g.withColumn("ratio", F.col("common") / F.nullif("rare", F.lit(0))))


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out measures of a logistic regression, a forest and their mean probability, trained on folds 1 to 4 and tried on fold 0.

    The models are fitted by distributed optimisers on all rows of their folds.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["area", "volume", "perimeter", "solidity"]
    r = _phased(spark, d).na.drop(subset=["label", *names])
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "seq", F.col("cell_id").cast("string"))), 1, 6), 16, 10).cast("long"), F.lit(5))
    weight = F.when(F.col("label") == 1, 8.0).otherwise(1.0)
    r = stage(r.select("seq", "cell_id", "frame", F.col("label").cast("double").alias("label"), fold.alias("fold"), weight.alias("weight"), *names))
    v = VectorAssembler(inputCols=names, outputCol="features").transform(r)
    train, test = v.where("fold <> 0"), v.where("fold = 0")
    lr = LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01).fit(train).transform(test).withColumn("p1", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    rf = RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=6, seed=42).fit(train).transform(lr).withColumn("p2", vector_to_array("probability")[1])
    each = F.explode(F.array(F.struct(F.lit("logistic").alias("model"), F.col("p1").alias("score")), F.struct(F.lit("forest").alias("model"), F.col("p2").alias("score")), F.struct(F.lit("vote").alias("model"), ((F.col("p1") + F.col("p2")) / 2).alias("score")))).alias("s")
    s = stage(rf.select("label", each).select("s.*", "label"))
    return rounded(ml.areas(s, ["model"]).join(ml.confusion(s, F.lit(0.5), ["model"]), "model"))


def train_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Features scaled by quantiles of the training part alone (folds 1 to 4)."""
    r = _phased(spark, d).withColumn("fold", ml.hashed(F.col("seq"), F.col("cell_id"), n=5))
    return rounded(ml.scaled(stage(r.select("seq", "cell_id", "frame", "phase", "fold", "area", "volume")), "phase", ["area", "volume"], F.col("fold") != 0))


def bootstrap_measures(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of F1 over 20 resamples of the rows at a fixed threshold, by phase."""
    r = _phased(spark, d).where("label is not null and area is not null").select("phase", "seq", "cell_id", "frame", "label", F.col("area").alias("score"))
    b = ml.resampled(r, ["seq", "cell_id", "frame"])
    hit, y = F.col("score") >= 300.0, F.col("label") == 1
    n = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0)).cast("double")
    m = b.groupBy("phase", "round").agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), F.sum("weight").alias("drawn"))
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    m = m.withColumn("f1", F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0))
    return rounded(m.groupBy("phase").agg(F.count(F.lit(1)).alias("rounds"), F.avg("drawn").alias("drawn"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std")))


def holdout_windows(spark: SparkSession, d: str) -> DataFrame:
    """Cells by phase, offset of the window, part and label."""
    h = ml.holdouts(stage(ml.life(labelled(spark, d))), length=5)
    return h.groupBy("phase", "offset", "part", "label").agg(F.count(F.lit(1)).alias("n"))


def repeated_folds(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the best F1 of each of 5 times 5 folds by rows, the threshold tuned on the fold: by repeat."""
    r = _phased(spark, d).where("label is not null and area is not null").select("seq", "cell_id", "frame", "label", F.col("area").alias("score"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat"))
    r = r.withColumn("fold", ml.hashed(F.col("repeat"), F.col("seq"), F.col("cell_id"), F.col("frame"), n=5))
    b = ml.best_threshold(stage(r.select("repeat", "fold", "label", "score")), ["repeat", "fold"])
    return rounded(b.groupBy("repeat").agg(F.count(F.lit(1)).alias("folds"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std")))


def json_results(spark: SparkSession, d: str) -> DataFrame:
    """The classifier measures written as a bundle of JSON and read again."""
    m = classifier_measures(spark, d)
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    m.write.json(path)
    return spark.read.schema(m.schema).json(path)


def next_phase_scores(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a logistic regression fitted on one phase (1 to 4) and tried on the next (after 4 comes 1), on that one's own scaled features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["area", "volume"]
    r = ml.scaled(stage(_phased(spark, d).where("phase <= 4").select("seq", "cell_id", "frame", "phase", "label", *names)), "phase", names)
    r = r.na.drop(subset=["label", *names]).withColumn("label", F.col("label").cast("double")).withColumn("weight", F.when(F.col("label") == 1, 8.0).otherwise(1.0))
    v = stage(r.select("phase", "label", "weight", *names))
    kinds = {p for p, _ in v.where("label in (0, 1)").groupBy("phase", "label").count().select("phase", "label").collect()}
    both = v.groupBy("phase").agg(F.countDistinct("label").alias("k")).where("k = 2").select("phase").collect()
    v, s = VectorAssembler(inputCols=names, outputCol="features").transform(v), None
    for p in sorted(kinds & {x[0] for x in both}):
        m = LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01).fit(v.where(F.col("phase") == p))
        t = m.transform(v.where(F.col("phase") == p % 4 + 1)).select(F.lit(p).alias("trained"), F.col("phase").alias("tried"), "label", vector_to_array("probability")[1].alias("score"))
        s = t if s is None else s.unionByName(t)
    if s is None:
        s = v.where("false").select(F.col("phase").alias("trained"), F.col("phase").alias("tried"), "label", F.lit(0.0).alias("score"))
    s = stage(s)
    return rounded(ml.areas(s, ["trained", "tried"]).join(ml.confusion(s, F.lit(0.5), ["trained", "tried"]), ["trained", "tried"]))


QUERIES = {f.__name__: f for f in (
    cell_life, qualifying_cells, survival_windows, balanced_sample, half_sample, feature_quantiles, robust_scaled, classifier_measures, curve_areas, best_thresholds, precision_recall_curve, fold_measures, correlations, histograms, class_balance, model_scores, train_scaled, bootstrap_measures, holdout_windows, repeated_folds, json_results, next_phase_scores)}

_V = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END AS {1}"
_L = f"""WITH lab AS (SELECT seq, "Cell ID" AS cell_id, Frame AS frame, Label AS label, coalesce(try_cast(regexp_replace(trim("Parent ID"), '[.]0+$', '') AS INTEGER), 0) <> 0 AS daughter, {", ".join(_V.format(k, v) for k, v in FEATURES.items())} FROM
  (SELECT *, row_number() OVER (PARTITION BY seq, "Cell ID", Frame ORDER BY rec_id DESC) AS rn FROM (SELECT DISTINCT * FROM consensus_retrospective_labels) WHERE seq IS NOT NULL AND "Cell ID" IS NOT NULL AND Frame IS NOT NULL) WHERE rn = 1),
life AS (SELECT seq, cell_id, min(frame) AS birth, max(frame) AS death, arg_min(label, frame) FILTER (label IS NOT NULL) AS label, bool_or(daughter) AS daughter FROM lab GROUP BY ALL)"""
_PH = "CASE " + " ".join(f"WHEN frame BETWEEN {a} AND {b} THEN {p}" for p, a, b in c.PHASES) + " END"
_P = f"{_L}, ph AS (SELECT *, {_PH} AS phase FROM lab WHERE frame BETWEEN 0 AND 400)"
_S = f"{_P}, sc AS (SELECT phase, cast(('0x' || substr(md5(seq || '|' || cell_id), 1, 6))::BIGINT % 5 AS INTEGER) AS fold, label, area AS score FROM ph WHERE label IS NOT NULL AND area IS NOT NULL)"
_STARTS = ", ".join(f"({p}, {s})" for p, s in ml.STARTS)


def _qual(length: str) -> str:
    return f"SELECT w.phase, w.s AS start, w.s + {length} - 1 AS stop, l.seq, l.cell_id, l.label FROM life l CROSS JOIN (VALUES {_STARTS}) w(phase, s) WHERE NOT daughter AND label IS NOT NULL AND birth <= w.s AND death >= w.s + {length} - 1"


def _measures(by: str) -> str:
    return f"""cf AS (SELECT {by}, cast(count(*) FILTER (score >= 300 AND label = 1) AS DOUBLE) AS tp, cast(count(*) FILTER (score >= 300 AND label <> 1) AS DOUBLE) AS fp, cast(count(*) FILTER (score < 300 AND label = 1) AS DOUBLE) AS fn, cast(count(*) FILTER (score < 300 AND label <> 1) AS DOUBLE) AS tn FROM sc GROUP BY ALL),
prs AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity FROM cf),
ms AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS f05, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2,
  (tp + tn) / (tp + fp + fn + tn) AS accuracy, (recall + specificity) / 2 AS balanced_accuracy, sqrt(recall * specificity) AS gmean, CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM prs)"""


_MS = ("precision", "recall", "specificity", "f1", "f05", "f2", "accuracy", "balanced_accuracy", "gmean", "mcc")
_CURVE = """, cv AS (SELECT phase, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sc GROUP BY ALL), cu AS (SELECT *, cast(sum(pos) OVER w AS BIGINT) AS pos_cum, cast(sum(neg) OVER w AS BIGINT) AS neg_cum FROM cv WINDOW w AS (PARTITION BY phase ORDER BY score DESC))"""
_Q = (0.01, 0.25, 0.5, 0.75, 0.99)

ORACLE = {
    "cell_life": f"{_L} SELECT * FROM life",
    "qualifying_cells": f"{_L} {_qual('29')}",
    "survival_windows": f"{_L} SELECT phase, length, label, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT phase, label, {n} AS length FROM ({_qual(str(n))})' for n in range(5, 30, 3))}) GROUP BY ALL",
    "balanced_sample": f"{_L}, q AS ({_qual('5')}), o AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY md5(phase || '|' || seq || '|' || cell_id)) AS rn FROM q WHERE label = 0), k AS (SELECT phase, 10 * count(*) AS most FROM q WHERE label = 1 GROUP BY phase) SELECT phase, seq, cell_id, label FROM q WHERE label = 1 UNION ALL SELECT o.phase, o.seq, o.cell_id, o.label FROM o JOIN k ON k.phase = o.phase WHERE rn <= most",
    "feature_quantiles": f"{_P} " + " UNION ALL ".join(f"SELECT phase, '{v}' AS feature, count({v}) AS n, " + ", ".join(f"round(quantile_cont({v}, {q}), 6) AS {n}" for q, n in zip(_Q, ("q01", "q25", "q50", "q75", "q99"), strict=True)) + " FROM ph GROUP BY phase" for v in ("area", "volume")),
    "robust_scaled": f"{_P}, qs AS (SELECT phase, " + ", ".join(f"quantile_cont({v}, {q}) AS {v[0]}{i}" for v in ("area", "volume") for i, q in enumerate(_Q)) + " FROM ph GROUP BY phase) SELECT seq, cell_id, frame, ph.phase, " + ", ".join(f"round((CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, {v[0]}0), {v[0]}4) END - {v[0]}2) / CASE WHEN {v[0]}3 = {v[0]}1 THEN 1 ELSE {v[0]}3 - {v[0]}1 END, 6) AS {v}" for v in ("area", "volume")) + " FROM ph JOIN qs ON qs.phase = ph.phase",
    "classifier_measures": f"{_S}, {_measures('phase')} SELECT phase, tp, fp, fn, tn, {', '.join(f'round({m}, 6) AS {m}' for m in _MS)} FROM ms",
    "curve_areas": f"{_S}{_CURVE}, t AS (SELECT phase, sum(pos) AS p, sum(neg) AS n FROM cv GROUP BY phase) SELECT cu.phase, CASE WHEN p > 0 AND n > 0 THEN round(sum(pos * (n - neg_cum + neg / 2)) / (p * n), 6) END AS roc_auc, CASE WHEN p > 0 AND n > 0 THEN round(sum(pos * pos_cum / (pos_cum + neg_cum)) / p, 6) END AS pr_auc FROM cu JOIN t ON t.phase = cu.phase GROUP BY cu.phase, p, n",
    "best_thresholds": f"{_S}{_CURVE}, t AS (SELECT phase, sum(pos) AS p FROM cv GROUP BY phase) SELECT phase, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY f1 DESC, score DESC) AS rn FROM (SELECT cu.phase, score, round(2 * pos_cum / (pos_cum + neg_cum + p), 12) AS f1 FROM cu JOIN t ON t.phase = cu.phase)) WHERE rn = 1",
    "precision_recall_curve": f"{_S}{_CURVE} SELECT phase, round(score, 6) AS score, pos, neg, pos_cum, neg_cum FROM cu",
    "fold_measures": f"{_S}, {_measures('phase, fold')} SELECT phase, {', '.join(f'round(avg({v}), 6) AS {v}_mean, round(stddev_pop({v}), 6) AS {v}_std' for v in ('precision', 'recall', 'f1', 'mcc'))} FROM ms GROUP BY phase",
    "correlations": f"{_P} " + " UNION ALL ".join(f"SELECT phase, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ph GROUP BY phase" for i, a in enumerate(FEATURES.values()) for b in list(FEATURES.values())[i + 1 :]),
    "histograms": f"{_P}, m AS (SELECT phase, min(area) AS lo, max(area) AS hi FROM ph GROUP BY phase) SELECT ph.phase, cast(coalesce(least(floor((area - lo) / nullif(hi - lo, 0) * 25), 24), 0) AS BIGINT) AS bin, count(*) AS n FROM ph JOIN m ON m.phase = ph.phase WHERE area IS NOT NULL GROUP BY ALL",
    "class_balance": f"{_L} SELECT seq, count(*) FILTER (label = 1) AS rare, count(*) FILTER (label = 0) AS common, count(*) FILTER (label IS NULL) AS unknown, round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0), 6) AS ratio FROM lab GROUP BY seq",
}

_H = "('0x' || substr(md5({}), 1, 6))::BIGINT % {}"
_ROWS = f"{_P}, rw AS (SELECT phase, seq, cell_id, frame, label, area AS score FROM ph WHERE label IS NOT NULL AND area IS NOT NULL)"
_WEIGHT = "CASE " + " ".join(f"WHEN h < {below} THEN {k}" for k, below in enumerate(ml.POISSON)) + f" ELSE {len(ml.POISSON)} END"
_QUAL5 = " UNION ALL ".join(f"SELECT {o} AS \"offset\", w.phase, l.seq, l.cell_id, l.label FROM life l CROSS JOIN (VALUES {_STARTS}) w(phase, s) WHERE NOT daughter AND label IS NOT NULL AND birth <= w.s + {o} AND death >= w.s + {o} + 4" for o in range(-3, 4))
ORACLE |= {
    "train_scaled": ORACLE["robust_scaled"].replace(" FROM ph GROUP BY phase) SELECT seq, cell_id, frame, ph.phase,", f" FROM ph WHERE {_H.format("seq || '|' || cell_id", 5)} <> 0 GROUP BY phase) SELECT seq, cell_id, frame, ph.phase, cast({_H.format("seq || '|' || cell_id", 5)} AS INTEGER) AS fold,"),
    "bootstrap_measures": f"{_ROWS}, bs AS (SELECT *, {_WEIGHT} AS weight FROM (SELECT rw.*, g.r AS round, {_H.format("g.r || '|' || seq || '|' || cell_id || '|' || frame", 1000)} AS h FROM rw CROSS JOIN range(0, 20) g(r))), m AS (SELECT phase, round, sum(weight) AS drawn, coalesce(sum(weight) FILTER (score >= 300 AND label = 1), 0) AS tp, coalesce(sum(weight) FILTER (score >= 300 AND label <> 1), 0) AS fp, coalesce(sum(weight) FILTER (score < 300 AND label = 1), 0) AS fn FROM bs WHERE weight > 0 GROUP BY ALL) SELECT phase, count(*) AS rounds, round(avg(drawn), 6) AS drawn, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m) GROUP BY phase",
    "holdout_windows": f"{_L} SELECT phase, \"offset\", CASE WHEN \"offset\" <> 0 THEN 'holdout' WHEN {_H.format("phase || '|' || seq || '|' || cell_id", 5)} = 0 THEN 'test' ELSE 'train' END AS part, label, count(*) AS n FROM ({_QUAL5}) GROUP BY ALL",
    "repeated_folds": f"{_ROWS}, rp AS (SELECT cast(g.r AS INTEGER) AS repeat, {_H.format("g.r || '|' || seq || '|' || cell_id || '|' || frame", 5)} AS fold, label, score FROM rw CROSS JOIN range(0, 5) g(r)), cv AS (SELECT repeat, fold, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM rp GROUP BY ALL), cu AS (SELECT *, sum(pos) OVER w AS pc, sum(neg) OVER w AS nc, sum(pos) OVER (PARTITION BY repeat, fold) AS p FROM cv WINDOW w AS (PARTITION BY repeat, fold ORDER BY score DESC)), bf AS (SELECT repeat, fold, max(round(2 * pc / (pc + nc + p), 12)) AS f1 FROM cu GROUP BY ALL) SELECT repeat, count(*) AS folds, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM bf GROUP BY repeat",
    "json_results": ORACLE["classifier_measures"],
    "half_sample": f"{_L}, q AS ({_qual('5')}) SELECT phase, seq, cell_id, label FROM (SELECT *, row_number() OVER (PARTITION BY phase, label ORDER BY md5(phase || '|' || seq || '|' || cell_id), seq, cell_id) AS rn FROM q) WHERE rn <= 20",
}
