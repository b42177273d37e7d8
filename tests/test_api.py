import pytest

from trackloom import api

ROWS = [("s", f, r, c) for f in range(4) for r, c, n in ((0, 0, 5), (1, 1, 4), (2, 2 if f < 2 else 3, 4)) for _ in range(n)]


def test_perfect_and_switched(spark, tmp_path):
    px = spark.createDataFrame(ROWS, "seq string, frame int, ref int, comp int")
    c = api.comparison(px)
    got = {r["metric"]: r["value"] for r in api.evaluate(c, ["DET", "SEG", "TRA", "LNK", "CT", "MOTA", "IDF1", "TF", "BC(0)", "CCA"]).collect()}
    assert got["DET"] == got["SEG"] == 1.0 and got["BC(0)"] is None and got["CCA"] is None
    assert got["LNK"] == pytest.approx(1 - 1.5 / 9) and got["TRA"] == pytest.approx(1 - 1.5 / (80 + 9))
    assert got["CT"] == pytest.approx(2 / 5) and got["MOTA"] == pytest.approx(1 - 1 / 8) and got["TF"] == pytest.approx(0.75) and got["IDF1"] == pytest.approx(12 / 16)
    assert [tuple(r) for r in api.validate(c).collect()] == [("s", True, 0)]
    assert set(api.METRICS) >= {"HOTA", "CHOTA", "OP_CSB", "BIO(3)", "FAF"}
    with pytest.raises(KeyError):
        api.evaluate(c, ["NO"])
    path = str(tmp_path / "px")
    px.write.parquet(path)
    api.main(["evaluate", "--pixels", path, "--metrics", "DET", "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True, sep=";").count() == 1


def test_empty(spark):
    c = api.comparison(spark.createDataFrame([], "seq string, frame int, ref int, comp int"))
    assert api.evaluate(c, ["DET", "CT", "HOTA", "MOTA", "FAF"]).collect() == []
