"""The queries of the text and training-set problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_numbers
from ..plans.problems import readings
from ..session import stage, table
from . import groups, leakage, matching, spans, tokens

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
LABELLED = ("features", "consensus_retrospective_labels")


def cell_links(spark: SparkSession, d: str) -> DataFrame:
    """g (tab and seq), a, b: links of cells with rows to themselves, their parents and their daughters, distinct."""
    out = None
    for tab in LABELLED:
        t = table(spark, d, tab).where(F.col("Cell ID").isNotNull() & F.col("seq").isNotNull())
        t = t.select(F.concat(F.lit(f"{tab}|"), "seq").alias("g"), F.col("Cell ID").alias("a"), "Parent ID", "Daughter IDs").distinct()
        out = t if out is None else out.unionByName(t)
    # one text holds both lists: a quoted number in either keeps its quotes, and the two never touch
    named = split_numbers(out.withColumn("named", F.concat_ws("|", "Parent ID", "Daughter IDs")), ["g", "a"], "named")
    return named.select("g", "a", F.col("child_id").alias("b")).unionByName(out.select("g", "a", F.col("a").alias("b"))).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of cells by table; the smallest cell with rows names the group."""
    links = stage(cell_links(spark, d))
    nodes = groups.components(links)
    there = links.where("a = b").select("g", F.col("a").alias("node")).distinct()
    own = nodes.join(there, ["g", "node"], "left_semi")
    name = own.groupBy("g", "root").agg(F.min("node").alias("group_id"))
    out = own.join(name, ["g", "root"])
    return out.select(F.substring_index("g", "|", 1).alias("tab"), F.expr("substring(g, instr(g, '|') + 1)").alias("seq"), F.col("node").alias("cell_id"), "group_id")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every cell with rows: tab, seq, cell_id, group_id, split.

    Groups of the two tables whose cells are the same physical cells (by ``p3_found``) form a family and go to one split, too. Families with a row of class 1
    are shared out on their own, and so are those of one table alone, so that each table and class gets its shares.
    """
    return _dealt(spark, d)[0]


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """What p6_splits comes to: stratum, split, n_families, n_rows, target (the split's share of the rows) and gap, how far whole families leave it from that."""
    s = _dealt(spark, d)[1]
    g = s.groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n_families"), F.sum("size").alias("n_rows"))
    whole = s.groupBy("stratum").agg(F.sum("size").alias("whole"))
    share = F.element_at(F.create_map(*(F.lit(v) for kv in SHARES.items() for v in kv)), F.col("split"))
    target = F.round(F.col("whole") * share).cast("long")
    return g.join(whole, "stratum").select("stratum", "split", "n_families", "n_rows", target.alias("target"), (F.col("n_rows") - target).alias("gap"))


def _dealt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cells with their splits, and the families: seq, family, stratum, size, split."""
    found = stage(p6_found(spark, d))
    number = {LABELLED[0]: 2 * F.col("group_id"), LABELLED[1]: 2 * F.col("group_id") + 1}  # the two tables' groups side by side
    own = found.withColumn("node", F.when(F.col("tab") == LABELLED[0], number[LABELLED[0]]).otherwise(number[LABELLED[1]]))
    side = lambda tab, cell, name: own.where(F.col("tab") == tab).select("seq", F.col("cell_id").alias(cell), F.col("node").alias(name))
    pairs = p3_found(spark, d).join(side(LABELLED[0], "cell_id", "a"), ["seq", "cell_id"]).join(side(LABELLED[1], "consensus_cell_id", "b"), ["seq", "consensus_cell_id"])
    links = pairs.select(F.col("seq").alias("g"), "a", "b").unionByName(own.select(F.col("seq").alias("g"), F.col("node").alias("a"), F.col("node").alias("b"))).distinct()
    family = groups.components(links).select(F.col("g").alias("seq"), "node", F.col("root").alias("family"))
    own = stage(own.join(family, ["seq", "node"]).drop("node"))
    sizes = None
    for tab in LABELLED:
        t = table(spark, d, tab).where(F.col("Cell ID").isNotNull() & F.col("seq").isNotNull())
        t = t.groupBy(F.lit(tab).alias("tab"), "seq", F.col("Cell ID").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("Label") == 1, F.lit(False))).alias("rare"))
        sizes = t if sizes is None else sizes.unionByName(t)
    g = own.join(sizes, ["tab", "seq", "cell_id"]).groupBy("seq", "family").agg(F.sum("n").alias("size"), F.max("rare").alias("rare"), F.min("tab").alias("one"), F.max("tab").alias("other"))
    where = F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.lit("both"))
    g = g.select("seq", "family", F.concat_ws("|", where, F.col("rare").cast("string")).alias("stratum"), "size")
    s = stage(groups.assign_splits(g, SHARES))
    cells = own.join(s.select("seq", "family", "split"), ["seq", "family"]).select("tab", "seq", "cell_id", "group_id", "split")
    return cells, s


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p8_ids(spark: SparkSession, d: str, path: str = TOKENIZER) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), ["doc_id"], "text", path)


def p8_roundtrip(spark: SparkSession, d: str, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_ids and whether decoding gives the text back."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("whole"), "text")
    back = tokens.decode(tokens.encode(docs, ["doc_id", "whole"], "text", path), ["doc_id", "whole", "ids"], "ids", path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), (F.col("text") == F.col("whole")).alias("same"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    p = spans.span_pairs(table(spark, d, "documents"), "doc_id", "text")
    return p.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    s = spans.shared_lengths(table(spark, d, "documents"), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), "n_chars", "n_shared", "n_partners")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id and the words of the longest stretch."""
    found = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["passage", "question"])
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "words")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inside = F.col("X").between(0, 1023) & F.col("Y").between(0, 1023)
    a = matching.tracks(readings(spark, d, ["X", "Y", "Area"]).where(inside), "seq", "cell_id", "frame", "X", "Y", "Area")
    b = matching.tracks(table(spark, d, "consensus_data").where(inside), "seq", "Cell ID", "Frame", "X", "Y", "Area")
    return a, b


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every consensus cell with its features cell, the frames they have in common and the confidence."""
    m = matching.match(*_sources(spark, d))
    return m.select(F.col("g").alias("seq"), F.col("a").cast("int").alias("cell_id"), F.col("b").cast("int").alias("consensus_cell_id"), "common", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def p3_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence's shift between the sources: shift_x, shift_y, factor (of sizes), lag (frames), whether the wide search gave it and how near its bounds it lies (1: at them)."""
    m = matching.Match()
    s = matching.matched(*_sources(spark, d), m)[1]
    lag = F.col("lag") - F.when(F.col("wide"), matching.widened(m).lag).otherwise(m.lag)
    return s.select(F.col("g").alias("seq"), F.round("mx", 6).alias("shift_x"), F.round("my", 6).alias("shift_y"), F.round(F.exp("ms"), 6).alias("factor"), lag.cast("int").alias("lag"), "wide", F.round("edge", 6).alias("edge"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("seq", "cell_id", "consensus_cell_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_matches, p3_shifts, p6_found, p6_splits, p6_shares, p8_ids, p8_roundtrip, p9_found, p9_leaks, p10_found, p10_shares)}
_NAMED = r"""regexp_extract_all(regexp_replace(regexp_replace(coalesce("Parent ID", '') || '|' || coalesce("Daughter IDs", ''), '"(\d{1,3}),(\d{3})"', '"\1\2"', 'g'), '(\d)\.0+', '\1', 'g'), '\d+')"""
_LINKS = " UNION ".join(f"""SELECT '{t}' AS tab, seq, "Cell ID" AS a, cast(x AS INTEGER) AS b FROM (SELECT seq, "Cell ID", unnest({_NAMED}) AS x FROM {t} WHERE "Cell ID" IS NOT NULL) WHERE cast(x AS INTEGER) > 0""" for t in LABELLED)
_ROWS = " UNION ".join(f"""SELECT '{t}' AS tab, seq, "Cell ID" AS cell_id FROM {t} WHERE "Cell ID" IS NOT NULL""" for t in LABELLED)
_WINDOWS = "w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"

ORACLE = {
    "p6_found": f"WITH RECURSIVE l AS ({_LINKS}), c AS ({_ROWS}), e AS (SELECT * FROM l UNION SELECT tab, seq, b, a FROM l), r AS (SELECT tab, seq, cell_id AS a, cell_id AS b FROM c UNION SELECT r.tab, r.seq, r.a, e.b FROM r JOIN e ON e.tab = r.tab AND e.seq = r.seq AND e.a = r.b) SELECT r.tab, r.seq, r.a AS cell_id, min(r.b) AS group_id FROM r JOIN c ON c.tab = r.tab AND c.seq = r.seq AND c.cell_id = r.b GROUP BY ALL",
    "p10_found": f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON b.h = a.h AND a.doc_id < b.doc_id",
    "p10_shares": f"WITH {_WINDOWS}, p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM w a JOIN w b ON b.h = a.h AND a.doc_id <> b.doc_id), g AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 300)) AS pos FROM w WHERE h IN (SELECT h FROM g)) GROUP BY doc_id) SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(s.n, 0) AS n_shared, (SELECT count(*) FROM p WHERE p.a = d.doc_id) AS n_partners FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id",
}
