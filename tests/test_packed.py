import pyarrow as pa
import pytest

from trackloom.operators.packed import number_lists, split_numbers

CASES = [
    ("7", [7]), ("11|12", [11, 12]), ('"19","20"', [19, 20]), ('"12,067"', [12067]), ('"1,022", "12,006"', [1022, 12006]), ('"12,13"', [12, 13]), ("1,022", [1, 22]), ("[12, 13]", [12, 13]), ("19.0", [19]), ("5.0,6.0", [5, 6]),
    ("12.5", [12, 5]), ("000019;000020", [19, 20]), (";106;;107", [106, 107]), ("16 → \"17\" → 18", [16, 17, 18]), ("11、12", [11, 12]), ("#1 & #2", [1, 2]), ('"1,000,234"', [1000234]), ('1042;"1043"', [1042, 1043]),
    ("No_Children", []), ("nan", []), ("", []), (None, []), ("0", []), ("-", []), ("99999999999999999999,4", [4]), ("2147483648", []), ("2147483647", [2147483647]), ('"', []), ('"1,022', [1022])]


@pytest.mark.parametrize("text, want", CASES)
def test_notations(text, want):
    assert number_lists(pa.array([text], pa.string())).to_pylist() == [want]


def test_rows_do_not_run_into_each_other():
    texts = [t for t, _ in CASES] * 3
    assert number_lists(pa.array(texts, pa.string())).to_pylist() == [w for _, w in CASES] * 3
    assert number_lists(pa.array(texts, pa.string()).slice(5, 9)).to_pylist() == [w for _, w in CASES][5:14]
    assert number_lists(pa.array([], pa.string())).to_pylist() == []


def test_split_keeps_rows_and_places(spark):
    df = spark.createDataFrame([(1, "a", "3;4"), (1, "a", "3;4"), (2, None, "x"), (3, "b", "9," * 5000)], "id long, k string, packed string").withColumnRenamed("packed", "a list")
    rows = split_numbers(df, ["id", "k"], "a list").collect()
    assert sorted((r["id"], r["k"], r["pos"], r["child_id"]) for r in rows if r["id"] < 3) == [(1, "a", 1, 3), (1, "a", 1, 3), (1, "a", 2, 4), (1, "a", 2, 4)]
    assert [r["pos"] for r in rows if r["id"] == 3] == list(range(1, 5001))
    assert split_numbers(df.where("false"), ["id"], "a list").collect() == []
    with pytest.raises(ValueError):
        split_numbers(df.withColumnRenamed("k", "pos"), ["pos"], "a list")
