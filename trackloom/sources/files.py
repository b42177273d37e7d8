"""Track files, delimited tables and JSON: reading, writing, discovery by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK = "label int, birth int, end int, parent int"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track files of lines ``label birth end parent``, separated by spaces or tabs: seq, label, birth, end, parent.

    The sequence is the file's folder when named ``seq=...``. Lines with fewer than four whole numbers are skipped; empty files give no rows.
    """
    lines = spark.read.option("recursiveFileLookup", "false").text(path)
    parts = F.split(F.trim("value"), r"[ \t]+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    keep = [c for c in lines.columns if c != "value"]
    d = lines.select(*keep, *(number(i).alias(n) for i, n in enumerate(("label", "birth", "end", "parent"))))
    return d.where("label is not null and birth is not null and `end` is not null and parent is not null")


def write_tracks(tracks: DataFrame, path: str) -> None:
    """One folder of track files per seq: columns seq, label, birth, end, parent."""
    tracks.select("seq", F.concat_ws(" ", "label", "birth", "end", "parent").alias("value")).write.mode("overwrite").partitionBy("seq").text(path)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited files with a header; ``N/A`` and empty fields are NULL."""
    d = spark.read.csv(path, header=True, schema=schema, sep=sep, nullValue="N/A", emptyValue="")
    return d


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep, nullValue="N/A")


def not_yet(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys (NULL equals NULL) are not stored yet."""
    on = None
    s = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return wanted.join(s, on, "left_anti")


def image_names(paths: DataFrame, column: str) -> DataFrame:
    """Frame number and slice of image file names such as mask012.tif or man_seg_012_003.tif; others are left out."""
    n = F.regexp_extract(F.substring_index(column, "/", -1), r"^(\D*)(\d+)(?:_(\d+))?\.tiff?$", 0)
    frame = F.regexp_extract(F.substring_index(column, "/", -1), r"^\D*(\d+)(?:_(\d+))?\.tiff?$", 1)
    part = F.regexp_extract(F.substring_index(column, "/", -1), r"^\D*\d+_(\d+)\.tiff?$", 1)
    return paths.where(n != "").select(column, frame.cast("int").alias("frame"), F.nullif(part, F.lit("")).cast("int").alias("slice"))


def read_challenges(spark: SparkSession, root: str) -> DataFrame:
    """Track files in folders ``challenge/NN_RES`` and ``challenge/NN_GT/TRA`` below ``root``: challenge, sequence, side (RES or GT), label, birth, end, parent.

    Only the sequences 01 and 02 count. Lines as in ``read_tracks``; folders may also be named ``challenge=...`` and ``part=...``.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select("value", F.input_file_name().alias("path"))
    where = lambda i: F.regexp_extract("path", r"/(?:challenge=)?([^/=]+)/(?:part=)?(0[12])_(RES|GT)(?:/TRA)?/[^/]*\.txt$", i)
    parts = F.split(F.trim("value"), r"[ \t]+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    d = lines.select(where(1).alias("challenge"), where(2).alias("sequence"), where(3).alias("side"), *(number(i).alias(n) for i, n in enumerate(("label", "birth", "end", "parent"))))
    return d.where("challenge <> '' and label is not null and birth is not null and `end` is not null and parent is not null")


def write_challenges(tracks: DataFrame, root: str) -> None:
    """Track files in folders by challenge, sequence and side: columns challenge, sequence, side, label, birth, end, parent."""
    d = tracks.select("challenge", F.concat_ws("_", "sequence", "side").alias("part"), F.concat_ws(" ", "label", "birth", "end", "parent").alias("value"))
    d.repartition("challenge", "part").write.partitionBy("challenge", "part").text(root)


def paired(tracks: DataFrame) -> DataFrame:
    """Tracks of both sides by sequence, rows of ``read_challenges``: challenge, sequence, res_tracks, gt_tracks (NULL: no file with tracks)."""
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    g = tracks.groupBy("challenge", "sequence").agg(n("RES").alias("r"), n("GT").alias("g"))
    return g.select("challenge", "sequence", F.when(F.col("r") > 0, F.col("r")).alias("res_tracks"), F.when(F.col("g") > 0, F.col("g")).alias("gt_tracks"))
