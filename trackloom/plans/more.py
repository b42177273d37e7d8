"""Queries over several trackers, images, noise, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consensus as k
from ..operators import images as im
from ..operators import noise as nz
from ..operators import scoring
from ..session import shared_folder, stage, table
from ..sources import files
from ..streaming import streams
from .cells import _C, _O, cells, observations
from .fixtures import SQL, comparison, pixels
from .scores import rounded


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# several trackers


def tracker_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as rows of five trackers: algorithm, fov, cell_id, frame, x, y, area, volume, label."""
    t = table(spark, d, "events").select(F.col("event_type").alias("algorithm"), (F.col("user_id") % 3).cast("int").alias("fov"), F.col("user_id").cast("int").alias("cell_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame"), "value")
    t = t.groupBy("algorithm", "fov", "cell_id", "frame").agg(F.avg("value").alias("area"), F.sum("value").alias("volume"), F.bool_or(F.col("value") > 450).alias("label"))
    x, y = (((F.col("cell_id") * m) % 400 + F.col("frame") * 2).cast("double") for m in (37, 53))
    return t.select("*", x.alias("x"), y.alias("y"))


def tracker_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(k.segments(tracker_rows(spark, d)))


def consensus_groups(spark: SparkSession, d: str) -> DataFrame:
    return k.groups(k.segments(tracker_rows(spark, d)))


def late_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Groups of segments that begin late, on a finer grid, in at least two trackers."""
    seg = k.segments(tracker_rows(spark, d)).where("start >= 20")
    return k.groups(seg, width=5, late=20)


def consensus_representatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(k.representatives(k.segments(tracker_rows(spark, d))))


def path_extensions(spark: SparkSession, d: str) -> DataFrame:
    seg = stage(k.segments(tracker_rows(spark, d)))
    return rounded(k.extensions(k.representatives(seg), seg))


def renumbered(spark: SparkSession, d: str) -> DataFrame:
    return k.renumber(stage(cells(spark, d)))


# images


def image_pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as grey images of 64 x 64: seq, frame, y, x, v; the largest of several values at one place."""
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("2001-09-01").cast("timestamp_ntz"))
    frame = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    t = t.select(F.concat(F.lit("L"), (F.col("l_linenumber") % 2).cast("string")).alias("seq"), frame.alias("frame"), (F.col("l_partkey") % 64).cast("int").alias("y"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % 64).cast("int").alias("x"), F.least(F.col("l_quantity") * 5, F.lit(255.0)).alias("v"))
    return t.groupBy("seq", "frame", "y", "x").agg(F.max("v").alias("v"))


def image_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.statistics(image_pixels(spark, d)))


def image_presence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.presence(stage(image_pixels(spark, d))))


def image_binarized(spark: SparkSession, d: str) -> DataFrame:
    return im.binarized(stage(image_pixels(spark, d)))


def image_components(spark: SparkSession, d: str) -> DataFrame:
    return im.components(im.binarized(stage(image_pixels(spark, d))).where("v > 0"))


def image_objects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.objects(im.components(im.binarized(stage(image_pixels(spark, d))).where("v > 0")), 3))


def image_features(spark: SparkSession, d: str) -> DataFrame:
    px = stage(image_pixels(spark, d))
    return rounded(im.features(stage(im.components(im.binarized(px).where("v > 0"))), px))


def image_solidity(spark: SparkSession, d: str) -> DataFrame:
    """Perimeter, area of the convex hull and their ratio (0 without a hull) of every object."""
    labels = stage(im.components(im.binarized(stage(image_pixels(spark, d))).where("v > 0")))
    h = im.perimeters(labels).join(im.hulls(labels), ["seq", "frame", "ty", "tx"])
    return rounded(h.withColumn("solidity", F.when(F.col("hull") > 0, F.col("perimeter") / F.col("hull")).otherwise(0.0)))


def image_contrast(spark: SparkSession, d: str) -> DataFrame:
    c = im.contrasted(image_pixels(spark, d))
    return rounded(c.groupBy("seq", "frame", "factor").agg(F.avg("v").alias("mean"), F.count(F.when(F.col("v") == 255, 1)).alias("saturated")))


def image_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Cropped to the middle, flipped left to right, brought to [-1, 1]."""
    p = im.normalized(im.flipped(im.cropped(image_pixels(spark, d), 16, 48, 16, 48), 32, 32))
    return rounded(p)


def segmentation_dice(spark: SparkSession, d: str) -> DataFrame:
    """Dice coefficient of the foregrounds of both sides, per seq and frame."""
    p = pixels(spark, d)
    return rounded(p.groupBy("seq", "frame").agg(im.dice((F.col("ref") > 0).cast("int"), (F.col("comp") > 0).cast("int")).alias("dice")))


def overlap_detection(spark: SparkSession, d: str) -> DataFrame:
    """Reference objects covered well in the last frames: per frame a share above 0.15 (0.10 for small ones) scores; two frames and a mean of 0.15 are needed."""
    p = pixels(spark, d).where("frame >= 40 and ref > 0").groupBy("seq", "frame", "ref").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("comp") > 0).cast("int")).alias("share"))
    p = p.where(F.col("share") > F.when(F.col("n") < 100, 0.10).otherwise(0.15))
    g = p.groupBy("seq", "ref").agg(F.count(F.lit(1)).alias("frames"), F.avg("share").alias("mean_share"))
    return rounded(g.where("frames >= 2 and mean_share >= 0.15"))


def strict_detection(spark: SparkSession, d: str) -> DataFrame:
    """As overlap_detection, by the strict rule: frames where at least 0.3 is covered count, a cell needs 2 of them, a mean score (covered pixels) of 15 and a mean share of 0.4."""
    p = pixels(spark, d).where("frame >= 40 and ref > 0").groupBy("seq", "frame", "ref").agg(F.sum((F.col("comp") > 0).cast("int")).alias("score"), F.avg((F.col("comp") > 0).cast("int")).alias("share")).where("share >= 0.3")
    g = p.groupBy("seq", "ref").agg(F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_score"), F.avg("share").alias("mean_share"))
    return rounded(g.where("frames >= 2 and mean_score >= 15 and mean_share >= 0.4"))


def brightness_scores(spark: SparkSession, d: str) -> DataFrame:
    """How far late cells stand out from their frame's background: frames, mean and largest score, and whether the cell is chosen.

    A score is the difference of the means over the background's deviation, times the cell's size over 100 (2 at most), 0 if darker; chosen are cells with 2 frames, a mean of 2.5 and a largest one of 3.
    """
    p = stage(pixels(spark, d).where("frame >= 40").select("seq", "frame", "ref", "v"))
    back = p.where("ref = 0").groupBy("seq", "frame").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    c = p.where("ref > 0").groupBy("seq", "frame", "ref").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("area")).join(back, ["seq", "frame"])
    score = F.greatest((F.col("mean") - F.col("m")) / (F.col("s") + 1e-6) * F.least(F.col("area") / 100, F.lit(2.0)), F.lit(0.0))
    g = c.withColumn("score", score).groupBy("seq", "ref").agg(F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_score"), F.max("score").alias("top_score"))
    return rounded(g.withColumn("chosen", (F.col("frames") >= 2) & (F.col("mean_score") >= 2.5) & (F.col("top_score") >= 3)))


# noise


def noise_splits(spark: SparkSession, d: str) -> DataFrame:
    return nz.without_splits(comparison(spark, d).ref_tracks, 5)


def noise_matches(spark: SparkSession, d: str) -> DataFrame:
    return nz.without_matches(comparison(spark, d).matches.select("seq", "frame", "ref", "comp"), 50)


def noise_false_positives(spark: SparkSession, d: str) -> DataFrame:
    c = comparison(spark, d)
    return nz.with_false_positives(c.comp_tracks, c.comp, 20)


def noise_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    return nz.without_detections(comparison(spark, d).comp, 40)


def noise_switches(spark: SparkSession, d: str) -> DataFrame:
    c = comparison(spark, d)
    return nz.with_switches(c.comp, c.comp_tracks, 6)


def noise_effect(spark: SparkSession, d: str) -> DataFrame:
    """Recall after dropping growing numbers of matches, per seq and magnitude: a study of how a score answers to noise."""
    c = comparison(spark, d)
    m = stage(c.matches.select("seq", "frame", "ref", "comp"))
    v = c.ref.groupBy("seq").agg(F.count(F.lit(1)).alias("v"))
    out = None
    for n in (0, 50, 100, 150):
        x = nz.without_matches(m, n, seed=n).groupBy("seq").agg(F.count(F.lit(1)).alias("tp")).join(v, "seq").select("seq", F.lit(n).alias("magnitude"), (F.col("tp") / F.col("v")).alias("recall"))
        out = x if out is None else out.unionByName(x)
    return rounded(out)


def noise_settings(spark: SparkSession, d: str) -> DataFrame:
    """The grid of noise settings for every sequence of the pixels, less those already stored (the first seed's)."""
    s = pixels(spark, d).select("seq").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    kinds = ("false_positive", "false_negative", "id_switch", "match", "split")
    grid = s.select("seq", "seed").withColumn("kind", F.explode(F.array(*(F.lit(x) for x in kinds)))).withColumn("magnitude", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(20))))
    grid = stage(grid)
    return files.not_yet(grid, grid.where("seed = 0"), ["seq", "seed", "kind", "magnitude"])


# files


def track_files(spark: SparkSession, d: str) -> DataFrame:
    """Existing cells written as track files per sequence and read back."""
    path = _folder(spark, "tracks")
    t = cells(spark, d).where("start_frame is not null and end_frame is not null")
    files.write_tracks(t.select("seq", F.col("cell_id").alias("label"), F.col("start_frame").alias("birth"), F.col("end_frame").alias("end"), F.coalesce("parent_id", F.lit(0)).alias("parent")), path)
    return files.read_tracks(spark, path).select(F.col("seq").cast("string").alias("seq"), "label", "birth", "end", "parent")


def feature_files(spark: SparkSession, d: str) -> DataFrame:
    """Positions in force written as a delimited table with N/A for NULL and read back."""
    path = _folder(spark, "features")
    files.write_table(observations(spark, d).select("seq", "cell_id", "frame", "x", "y", "label"), path, sep=";")
    return files.read_table(spark, path, "seq string, cell_id int, frame int, x double, y double, label int", sep=";")


def sequence_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Fields of view 2..54 with their sequences, labelled rows and classes."""
    t = table(spark, d, "features").where(F.col("fov").between(2, 54) & F.col("seq").isNotNull())
    return t.groupBy("fov").agg(F.countDistinct("seq").alias("n_seq"), F.count("Label").alias("n_labelled"), F.countDistinct("Label").alias("n_classes"))


def shared_columns(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every feature table by name under one schema: tab, seq, n, mean area (tables lacking a needed column would drop out)."""
    need = ["seq", "Cell ID", "Label", "Frame", "X", "Y", "Area"]
    out = None
    for tab in ("features", "consensus_data", "consensus_retrospective_labels"):
        t = table(spark, d, tab)
        if all(c in t.columns for c in need):
            t = t.select(F.lit(tab).alias("tab"), *(F.col(c) for c in need))
            out = t if out is None else out.unionByName(t)
    area = F.when(~F.isnan("Area"), F.col("Area"))
    return rounded(out.groupBy("tab", "seq").agg(F.count(F.lit(1)).alias("n"), F.count("Label").alias("n_label"), F.avg(area).alias("mean_area")))


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Frame numbers parsed from image names made of the observations' sequences and frames, missing ones per sequence counted."""
    o = observations(spark, d).select("seq", "frame").distinct().withColumn("path", F.concat(F.col("seq"), F.lit("/mask"), F.lpad(F.col("frame").cast("string"), 3, "0"), F.lit(".tif")))
    n = files.image_names(o, "path").withColumn("seq", F.substring_index("path", "/", 1))
    return n.groupBy("seq").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"), (F.max("frame") - F.min("frame") + 1 - F.count(F.lit(1))).alias("missing"))


def challenge_folders(spark: SparkSession, d: str) -> DataFrame:
    """The existing cells written as track files by field of view (challenge), sequence and side, found again and paired; odd fields have no reference."""
    t = cells(spark, d).where("fov is not null and start_frame is not null and end_frame is not null")
    number = t.select("fov", "seq").distinct().withColumn("number", F.row_number().over(Window.partitionBy("fov").orderBy("seq")))  # a row per sequence
    t = t.join(number, ["fov", "seq"]).withColumn("sequence", F.lpad(F.col("number").cast("string"), 2, "0"))
    t = t.select(F.concat(F.lit("F"), F.col("fov").cast("string")).alias("challenge"), "sequence", "fov", F.col("cell_id").alias("label"), F.col("start_frame").alias("birth"), F.col("end_frame").alias("end"), F.coalesce("parent_id", F.lit(0)).alias("parent"))
    t = stage(t.where("sequence in ('01', '02', '03')"))
    root = _folder(spark, "challenges")
    files.write_challenges(t.withColumn("side", F.lit("RES")).unionByName(t.where("fov % 2 = 0").withColumn("side", F.lit("GT"))), root)
    return files.paired(files.read_challenges(spark, root))


# streams


def stream_cells(spark: SparkSession, d: str) -> DataFrame:
    """The label carried on and the speed of every row, from a stream that arrives in four parts by frame; both live on as state between them."""
    path, out, state = _folder(spark, "rows"), _folder(spark, "carried"), _folder(spark, "state")
    o = stage(observations(spark, d).select("seq", "cell_id", "frame", "label", "x", "y"))
    for part in range(4):
        o.where(F.col("frame").between(101 * part, 101 * part + 100)).write.mode("append").parquet(path)
        streams.run_once(streams.carried(spark.readStream.schema(o.schema).parquet(path)), out, state)
    return rounded(spark.read.parquet(out))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of events by type, from a stream; the last windows stay open until the watermark passes them."""
    path, out = _folder(spark, "events"), _folder(spark, "windows")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    streams.run_once(streams.event_windows(stream, late="0 seconds"), out, _folder(spark, "state"))
    return rounded(spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))


def stream_id_switches(spark: SparkSession, d: str) -> DataFrame:
    """Identity switches from a stream of matches that arrives in four parts; the state of each reference lives on between them."""
    path, out, state = _folder(spark, "matches"), _folder(spark, "switches"), _folder(spark, "state")
    m = stage(comparison(spark, d).matches.select("seq", "frame", "ref", "comp"))
    for part in range(4):
        m.where(F.col("frame").between(20 * part, 20 * part + 19)).write.mode("append").parquet(path)
        streams.run_once(streams.switches(spark.readStream.schema(m.schema).parquet(path)), out, state)
    return spark.read.parquet(out)


QUERIES = {f.__name__: f for f in (
    tracker_segments, consensus_groups, late_consensus, consensus_representatives, path_extensions, renumbered, image_statistics, image_presence, image_binarized, image_components, image_objects, image_features, image_solidity, image_contrast,
    image_transforms, segmentation_dice, overlap_detection, strict_detection, brightness_scores, noise_splits, noise_matches, noise_false_positives, noise_false_negatives, noise_switches, noise_effect, noise_settings, track_files, feature_files,
    sequence_discovery, shared_columns, image_files, challenge_folders, stream_windows, stream_id_switches, stream_cells)}

_T = """WITH rw AS (SELECT event_type AS algorithm, cast(user_id % 3 AS INTEGER) AS fov, cast(user_id AS INTEGER) AS cell_id, cast(date_diff('day', DATE '2024-01-01', ts::DATE) AS INTEGER) AS frame, avg(value) AS area, sum(value) AS volume, bool_or(value > 450) AS label FROM events GROUP BY ALL),
rx AS (SELECT *, cast(cell_id * 37 % 400 + frame * 2 AS DOUBLE) AS x, cast(cell_id * 53 % 400 + frame * 2 AS DOUBLE) AS y, frame - row_number() OVER (PARTITION BY algorithm, fov, cell_id ORDER BY frame) AS g FROM rw),
seg AS (SELECT algorithm, fov, cell_id, min(frame) AS start, max(frame) AS "end", count(*) AS n, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1, arg_min(area, frame) AS area0, arg_max(area, frame) AS area1, avg(area) AS area, avg(volume) AS volume, bool_or(label) AS label FROM rx GROUP BY algorithm, fov, cell_id, g),
sg AS (SELECT *, cast(round_even(x0 / 10, 0) * 10 AS INTEGER) AS gx, cast(round_even(y0 / 10, 0) * 10 AS INTEGER) AS gy FROM seg),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fov, start, gx, gy ORDER BY n, -area, -volume, x0, y0, algorithm, cell_id) AS rn, (SELECT count(DISTINCT algorithm) FROM sg s WHERE s.fov = sg.fov AND s.start = sg.start AND s.gx = sg.gx AND s.gy = sg.gy) AS n_algorithms FROM sg) WHERE rn = 1 AND n_algorithms >= CASE WHEN start >= 370 THEN 2 ELSE 3 END)"""
_I = """WITH RECURSIVE ip AS (SELECT 'L' || cast(l_linenumber % 2 AS VARCHAR) AS seq, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS frame, cast(l_partkey % 64 AS INTEGER) AS y, cast((l_orderkey * 7 + l_suppkey) % 64 AS INTEGER) AS x, max(least(l_quantity * 5, 255)) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-09-01' GROUP BY ALL),
st AS (SELECT seq, frame, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS largest FROM ip GROUP BY ALL),
s2 AS (SELECT *, least(greatest(mean + 2 * std, 80), 200) AS bright, least(greatest(mean + 1.5 * std, 60), 200) AS threshold FROM st),
bin AS (SELECT ip.seq, ip.frame, ip.y, ip.x, CASE WHEN ip.v > s2.threshold THEN 255 ELSE 0 END AS v FROM ip JOIN s2 ON s2.seq = ip.seq AND s2.frame = ip.frame)"""
_K = """, fg AS (SELECT seq, frame, y, x FROM bin WHERE v > 0),
reach AS (SELECT seq, frame, y, x, y AS ty, x AS tx FROM fg UNION SELECT r.seq, r.frame, r.y, r.x, f.y, f.x FROM reach r JOIN fg f ON f.seq = r.seq AND f.frame = r.frame AND f.y BETWEEN r.ty - 1 AND r.ty + 1 AND f.x BETWEEN r.tx - 1 AND r.tx + 1),
cc AS (SELECT seq, frame, y, x, min(ty * 64 + tx) // 64 AS ty, min(ty * 64 + tx) % 64 AS tx FROM reach GROUP BY ALL)"""
_N = f"WITH RECURSIVE {SQL}"


def _draw(table_: str, n: int, seed: str, *keys: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY seq ORDER BY md5(concat_ws('|', '{seed}', {', '.join(keys)}))) AS r FROM {table_} QUALIFY r <= {n})"


ORACLE = {
    "tracker_segments": f'{_T} SELECT algorithm, fov, cell_id, start, "end", n, x0, y0, x1, y1, round(area0, 6) AS area0, round(area1, 6) AS area1, round(area, 6) AS area, round(volume, 6) AS volume, label FROM seg',
    "consensus_groups": f"{_T} SELECT fov, start, gx, gy, count(DISTINCT algorithm) AS n_algorithms, count(*) AS n_segments, bool_or(label) AS label, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms FROM sg GROUP BY ALL HAVING count(DISTINCT algorithm) >= CASE WHEN start >= 370 THEN 2 ELSE 3 END",
    "late_consensus": f"{_T} SELECT fov, start, cast(round_even(x0 / 5, 0) * 5 AS INTEGER) AS gx, cast(round_even(y0 / 5, 0) * 5 AS INTEGER) AS gy, count(DISTINCT algorithm) AS n_algorithms, count(*) AS n_segments, bool_or(label) AS label, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms FROM seg WHERE start >= 20 GROUP BY ALL HAVING count(DISTINCT algorithm) >= 2",
    "consensus_representatives": f'{_T} SELECT fov, start, gx, gy, n_algorithms, algorithm, cell_id, "end", n, x1, y1, round(area1, 6) AS area1 FROM rep',
    "path_extensions": f"""{_T}, ex AS (SELECT r.fov, r.start, r.gx, r.gy, s.algorithm AS via, s.cell_id AS next, s.n AS length, sqrt((s.x0 - r.x1) ** 2 + (s.y0 - r.y1) ** 2) AS distance FROM rep r JOIN seg s ON s.fov = r.fov AND s.start = r."end" + 1 WHERE least(s.area0, r.area1) >= 0.6 * greatest(s.area0, r.area1))
      SELECT fov, start, gx, gy, via, next, length, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY fov, start, gx, gy ORDER BY length DESC, distance, via, next) AS rn FROM ex WHERE distance <= 50) WHERE rn = 1""",
    "renumbered": f"{_C}, nw AS (SELECT t.seq, t.cell_id, t.parent_id, cast(row_number() OVER (PARTITION BY t.seq ORDER BY tree.depth NULLS LAST, t.start_frame, t.cell_id) AS INTEGER) AS new_id FROM tk t LEFT JOIN tree ON tree.seq = t.seq AND tree.cell_id = t.cell_id) SELECT n.seq, n.cell_id, n.new_id, coalesce(p.new_id, 0) AS new_parent FROM nw n LEFT JOIN nw p ON p.seq = n.seq AND p.cell_id = n.parent_id",
    "image_statistics": f"{_I} SELECT seq, frame, n, round(mean, 6) AS mean, round(std, 6) AS std, largest, round(bright, 6) AS bright, round(threshold, 6) AS threshold FROM s2",
    "image_presence": f"{_I}, br AS (SELECT ip.seq, ip.frame, any_value(largest) AS largest, any_value(std) AS std, avg(CASE WHEN v > bright THEN 1 ELSE 0 END) AS r FROM ip JOIN s2 ON s2.seq = ip.seq AND s2.frame = ip.frame GROUP BY ALL), x AS (SELECT seq, frame, round(r, 6) AS bright_ratio, CASE WHEN largest < 80 THEN 'dark' WHEN std < 15 THEN 'flat' WHEN r <= 0.0005 THEN 'few' WHEN r >= 0.4 THEN 'many' ELSE 'bright' END AS reason FROM br) SELECT *, reason = 'bright' AS present FROM x",
    "image_binarized": f"{_I} SELECT * FROM bin",
    "image_components": f"{_I}{_K} SELECT seq, frame, y, x, cast(ty AS INTEGER) AS ty, cast(tx AS INTEGER) AS tx FROM cc",
    "image_objects": f"{_I}{_K} SELECT seq, frame, cast(ty AS INTEGER) AS ty, cast(tx AS INTEGER) AS tx, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS extent FROM cc GROUP BY ALL HAVING count(*) >= 3",
    "image_features": f"""{_I}{_K}, qd AS (SELECT seq, frame, ty, tx, y - i AS qy, x - j AS qx, sum(1 << (2 * i + j)) AS m FROM cc CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) GROUP BY ALL),
      pm AS (SELECT seq, frame, ty, tx, sum(CASE WHEN m IN (6, 9) THEN sqrt(2) WHEN m IN (3, 5, 10, 12) THEN 1 WHEN m = 15 THEN 0 ELSE 1 / sqrt(2) END) AS p FROM qd GROUP BY ALL),
      gr AS (SELECT o.seq, o.frame, o.y, o.x, o.v, sqrt(((coalesce(r.v, o.v) - coalesce(l.v, o.v)) / 2) ** 2 + ((coalesce(n.v, o.v) - coalesce(u.v, o.v)) / 2) ** 2) AS g FROM ip o {" ".join(f"LEFT JOIN ip {k} ON {k}.seq = o.seq AND {k}.frame = o.frame AND {k}.y = o.y {i} AND {k}.x = o.x {j}" for k, i, j in (("r", "", "+ 1"), ("l", "", "- 1"), ("n", "+ 1", ""), ("u", "- 1", "")))}),
      ob AS (SELECT cc.seq, cc.frame, cast(ty AS INTEGER) AS ty, cast(tx AS INTEGER) AS tx, count(*) AS n, avg(cc.y) AS cy, avg(cc.x) AS cx, var_pop(cc.y) AS vy, var_pop(cc.x) AS vx, covar_pop(cc.x, cc.y) AS cxy, (max(cc.y) - min(cc.y) + 1) * (max(cc.x) - min(cc.x) + 1) AS box, avg(v) AS im, sum(v) AS isum, stddev_pop(v) AS isd, max(v) AS imax, min(v) AS imin, avg(g) AS g
        FROM cc JOIN gr ON gr.seq = cc.seq AND gr.frame = cc.frame AND gr.y = cc.y AND gr.x = cc.x GROUP BY ALL),
      ax AS (SELECT ob.*, p, greatest(2 * sqrt(greatest(round((vx + vy + sqrt((vx - vy) ** 2 + 4 * cxy ** 2)) / 2, 9), 0)), 0.001) ** 2 AS b2, greatest(2 * sqrt(greatest(round((vx + vy - sqrt((vx - vy) ** 2 + 4 * cxy ** 2)) / 2, 9), 0)), 0.001) ** 2 AS c2 FROM ob JOIN pm ON pm.seq = ob.seq AND pm.frame = ob.frame AND pm.ty = ob.ty AND pm.tx = ob.tx)
      SELECT seq, frame, ty, tx, n AS volume, round(p, 6) AS area, round(p, 6) AS perimeter, round(p / (4 * pi()), 6) AS compactness, round(pi() ** (1.0 / 3) * (6 * n) ** (2.0 / 3) / p, 6) AS sphericity, round(p / box, 6) AS extent, round(0.5 / (0.25 + b2) * greatest(1 - (0.25 + b2) / (2 * c2), 0), 6) AS prolate,
      round(2 * b2 / (b2 + c2) * greatest(1 - 0.5 / (b2 + c2), 0), 6) AS oblate, cast(1.5 AS DOUBLE) AS nucleus_ratio, round(sqrt(cy ** 2 + cx ** 2), 6) AS displacement, round(im, 6) AS intensity_mean, round(isum, 6) AS intensity_sum, round(isd, 6) AS intensity_std, imax AS intensity_max, imin AS intensity_min, round(g, 6) AS gradient FROM ax""",
    "image_contrast": f"{_I} SELECT seq, frame, f.factor, round(avg(least(v * f.factor, 255)), 6) AS mean, count(*) FILTER (v * f.factor >= 255) AS saturated FROM ip CROSS JOIN (SELECT unnest([0.8, 0.9, 1.1, 1.2, 1.3, 1.4, 1.5]::DOUBLE[]) AS factor) f GROUP BY ALL",
    "image_transforms": f"{_I} SELECT seq, frame, y - 16 AS y, 31 - (x - 16) AS x, round((v / 255 - 0.5) / 0.5, 6) AS v FROM ip WHERE y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47",
    "segmentation_dice": f"{_N} SELECT seq, frame, round((2 * count(*) FILTER (ref > 0 AND comp > 0) + 1e-6) / (count(*) FILTER (ref > 0) + count(*) FILTER (comp > 0) + 1e-6), 6) AS dice FROM px GROUP BY ALL",
    "overlap_detection": f"{_N}, ov AS (SELECT seq, frame, ref, count(*) AS n, avg(CASE WHEN comp > 0 THEN 1 ELSE 0 END) AS share FROM px WHERE frame >= 40 AND ref > 0 GROUP BY ALL) SELECT seq, ref, count(*) AS frames, round(avg(share), 6) AS mean_share FROM ov WHERE share > CASE WHEN n < 100 THEN 0.10 ELSE 0.15 END GROUP BY ALL HAVING count(*) >= 2 AND avg(share) >= 0.15",
    "noise_splits": f"{_N}, sp AS (SELECT seq, parent FROM tr WHERE parent > 0 GROUP BY ALL HAVING count(*) > 1), gone AS {_draw('sp', 5, '0', 'seq', 'parent')} SELECT t.seq, label, birth, \"end\", CASE WHEN g.parent IS NULL THEN t.parent ELSE 0 END AS parent FROM tr t LEFT JOIN gone g ON g.seq = t.seq AND g.parent = t.parent",
    "noise_matches": f"{_N}, mm AS (SELECT seq, frame, ref FROM m WHERE frame >= 1), gone AS {_draw('mm', 50, '0', 'seq', 'frame', 'ref')} SELECT m.seq, m.frame, m.ref, m.comp FROM m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.seq = m.seq AND g.frame = m.frame AND g.ref = m.ref)",
    "noise_false_positives": f"{_N}, fr AS (SELECT DISTINCT seq, frame FROM vc), new AS {_draw('fr', 20, '0', 'seq', 'frame')} SELECT seq, label, birth, \"end\", parent FROM tc UNION ALL SELECT n.seq, cast((SELECT max(label) FROM tc WHERE tc.seq = n.seq) + r AS INTEGER), frame, frame, 0 FROM new n",
    "noise_false_negatives": f"{_N}, gone AS {_draw('vc', 40, '0', 'seq', 'frame', 'label')}, kp AS (SELECT v.*, (SELECT count(*) FROM gone g WHERE g.seq = v.seq AND g.label = v.label AND g.frame < v.frame) AS piece FROM vc v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.seq = v.seq AND g.frame = v.frame AND g.label = v.label)), pc AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY label, piece) AS r FROM (SELECT DISTINCT seq, label, piece FROM kp WHERE piece > 0)) SELECT k.seq, k.frame, k.label, CASE WHEN k.piece > 0 THEN cast((SELECT max(label) FROM vc WHERE vc.seq = k.seq) + p.r AS INTEGER) ELSE k.label END AS new_label FROM kp k LEFT JOIN pc p ON p.seq = k.seq AND p.label = k.label AND p.piece = k.piece",
    "noise_switches": f"{_N}, dr AS {_draw('tc', 12, '0', 'seq', 'label')}, pr AS (SELECT seq, (r - 1) // 2 AS pair, arg_min(label, r) AS a, arg_max(label, r) AS b, max(birth) AS since FROM dr GROUP BY ALL HAVING count(*) = 2), sw AS (SELECT seq, a AS label, b AS other, since FROM pr UNION ALL SELECT seq, b, a, since FROM pr) SELECT v.seq, v.frame, v.label, CASE WHEN v.frame >= s.since THEN s.other ELSE v.label END AS new_label FROM vc v LEFT JOIN sw s ON s.seq = v.seq AND s.label = v.label",
    "noise_effect": f"{_N}, mm AS (SELECT seq, frame, ref FROM m WHERE frame >= 1) " + " UNION ALL ".join(f"SELECT m.seq, {n} AS magnitude, round(count(*) / (SELECT count(*) FROM vr WHERE vr.seq = m.seq), 6) AS recall FROM m WHERE NOT EXISTS (SELECT 1 FROM {_draw('mm', n, str(n), 'seq', 'frame', 'ref')} g WHERE g.seq = m.seq AND g.frame = m.frame AND g.ref = m.ref) GROUP BY m.seq" for n in (0, 50, 100, 150)),
    "noise_settings": f"{_N} SELECT q.seq, cast(s.i AS INTEGER) AS seed, k.kind, cast(g.m AS INTEGER) AS magnitude FROM seqs q CROSS JOIN range(1, 3) s(i) CROSS JOIN (VALUES ('false_positive'), ('false_negative'), ('id_switch'), ('match'), ('split')) k(kind) CROSS JOIN range(0, 101, 20) g(m)",
    "track_files": f'{_C} SELECT seq, cell_id AS label, start_frame AS birth, end_frame AS "end", coalesce(parent_id, 0) AS parent FROM tk WHERE start_frame IS NOT NULL AND end_frame IS NOT NULL',
    "feature_files": f"{_O} SELECT seq, cell_id, frame, x, y, label FROM obs",
    "sequence_discovery": "SELECT fov, count(DISTINCT seq) AS n_seq, count(Label) AS n_labelled, count(DISTINCT Label) AS n_classes FROM features WHERE fov BETWEEN 2 AND 54 AND seq IS NOT NULL GROUP BY fov",
    "shared_columns": " UNION ALL ".join(f"SELECT '{t}' AS tab, seq, count(*) AS n, count(Label) AS n_label, round(avg(CASE WHEN isnan(Area) THEN NULL ELSE Area END), 6) AS mean_area FROM {t} GROUP BY seq" for t in ("features", "consensus_data", "consensus_retrospective_labels")),
    "image_files": f"{_O} SELECT seq, min(frame) AS first, max(frame) AS last, count(DISTINCT frame) AS n, max(frame) - min(frame) + 1 - count(DISTINCT frame) AS missing FROM obs GROUP BY seq",
    "stream_windows": "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events) GROUP BY ALL",
    "stream_id_switches": f"{_N} SELECT seq, ref, frame, comp, before FROM (SELECT *, lag(comp) OVER (PARTITION BY seq, ref ORDER BY frame) AS before FROM m) WHERE before <> comp",
}
ORACLE |= {
    "challenge_folders": f"""{_C}, sq AS (SELECT *, dense_rank() OVER (PARTITION BY fov ORDER BY seq) AS k FROM tk WHERE fov IS NOT NULL AND start_frame IS NOT NULL AND end_frame IS NOT NULL) SELECT 'F' || fov AS challenge, lpad(cast(k AS VARCHAR), 2, '0') AS sequence, count(*) AS res_tracks, CASE WHEN fov % 2 = 0 THEN count(*) END AS gt_tracks FROM sq WHERE k <= 2 GROUP BY fov, k""",
    "stream_cells": f"{_O}, k AS (SELECT *, max(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN frame END) OVER w AS fp, last_value(CASE WHEN label IN (0, 1) THEN label END IGNORE NULLS) OVER (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lb FROM obs WINDOW w AS (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k.seq, k.cell_id, k.frame, k.lb AS label, round(sqrt((k.x - p.x) ** 2 + (k.y - p.y) ** 2), 6) AS speed FROM k LEFT JOIN obs p ON p.seq = k.seq AND p.cell_id = k.cell_id AND p.frame = k.fp",
    "strict_detection": f"{_N}, ov AS (SELECT seq, frame, ref, count(*) FILTER (comp > 0) AS score, avg(CASE WHEN comp > 0 THEN 1 ELSE 0 END) AS share FROM px WHERE frame >= 40 AND ref > 0 GROUP BY ALL) SELECT seq, ref, count(*) AS frames, round(avg(score), 6) AS mean_score, round(avg(share), 6) AS mean_share FROM ov WHERE share >= 0.3 GROUP BY ALL HAVING count(*) >= 2 AND avg(score) >= 15 AND avg(share) >= 0.4",
    "brightness_scores": f"{_N}, bg AS (SELECT seq, frame, avg(v) AS m, stddev_pop(v) AS s FROM px WHERE frame >= 40 AND ref = 0 GROUP BY ALL), ce AS (SELECT seq, frame, ref, avg(v) AS mean, count(*) AS area FROM px WHERE frame >= 40 AND ref > 0 GROUP BY ALL), sc AS (SELECT ce.seq, ref, greatest((mean - m) / (s + 1e-6) * least(area / 100, 2), 0) AS score FROM ce JOIN bg ON bg.seq = ce.seq AND bg.frame = ce.frame) SELECT seq, ref, count(*) AS frames, round(avg(score), 6) AS mean_score, round(max(score), 6) AS top_score, count(*) >= 2 AND avg(score) >= 2.5 AND max(score) >= 3 AS chosen FROM sc GROUP BY ALL",
}
