import random

import numpy as np
import pytest

from trackloom.llm import spans


def longest_common(a, b):
    """Length of the longest common stretch (binary search over rolling sets)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        k = (lo + hi + 1) // 2
        s = {a[i : i + k] for i in range(len(a) - k + 1)}
        if any(b[i : i + k] in s for i in range(len(b) - k + 1)):
            lo = k
        else:
            hi = k - 1
    return lo


def corpus():
    rnd = random.Random(11)
    abc = "abcdefghijklmnopqrstuvwxyz     éß漢🙂"
    text = lambda n: "".join(rnd.choice(abc) for _ in range(n))
    shared = text(300)
    docs = {1: text(50) + shared + text(70), 2: text(9) + shared, 3: shared[:299] + text(100), 4: shared[1:] + text(5), 5: shared, 6: None, 7: "", 8: " " * 700, 9: text(3) + " " * 300 + text(3), 10: " " * 299}
    docs |= {11: "ab" * 400, 12: text(10) + "ba" * 151 + text(10), 13: text(30) + "ab" * 149 + text(30), 14: "hear, " * 80, 15: text(40) + "hear, " * 55 + text(40), 16: text(20000), 19: text(400)}
    docs[17] = text(500) + docs[16][7000:7400] + text(200)
    docs[18] = docs[16][7100:7399] + text(300) + docs[16][100:420]
    for i in range(20, 40):  # pieces of one long text, of lengths around the least one, at any offset
        n, at = rnd.randint(290, 310), rnd.randint(0, 19000)
        docs[i] = text(rnd.randint(0, 60)) + docs[16][at : at + n] + text(rnd.randint(0, 60))
    return docs


def test_pairs_and_lengths_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in docs.items()] + [(5, docs[5], "k"), (None, docs[1], "k")], "doc_id long, text string, key string")
    got = {(r["a"], r["b"]) for r in spans.span_pairs(df, "doc_id", "text").collect()}
    ids = [i for i, t in docs.items() if t]
    want = {(a, b) for a in ids for b in ids if a < b and longest_common(docs[a], docs[b]) >= 300}
    assert got == want
    shares = {r["id"]: r for r in spans.shared_lengths(df, "doc_id", "text").collect()}
    assert set(shares) == set(docs)
    for i, t in docs.items():
        covered = np.zeros(len(t or ""), bool)
        for j in ids:
            if t and j != i and (min(i, j), max(i, j)) in want:
                pieces = {docs[j][k : k + 300] for k in range(len(docs[j]) - 299)}
                for k in range(len(t) - 299):
                    if t[k : k + 300] in pieces:
                        covered[k : k + 300] = True
        assert (shares[i]["n_shared"], shares[i]["n_chars"]) == (covered.sum(), len(t or "")), i
        assert shares[i]["n_partners"] == sum(i in p for p in want)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyzéß "])
def test_every_shared_span_has_a_common_key(alphabet):
    rnd, lv = random.Random(len(alphabet)), spans.Levels()
    for _ in range(60):
        core = "".join(rnd.choice(alphabet) for _ in range(lv.span))
        if rnd.random() < 0.3:
            core = (core[: rnd.randint(1, 40)] * lv.span)[: lv.span]
        keys = []
        for _ in range(2):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) + core + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400)))
            p = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            keys.append(set(spans._landmarks(p, np.array([0, len(p)]), lv)[2].tolist()))
        assert keys[0] & keys[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.span_pairs(df, "doc_id", "text").collect() == [] and spans.shared_lengths(df, "doc_id", "text").collect() == []


def test_many_whole_copies(spark):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    one, other = text(2000), text(900)
    docs = {i: one for i in range(1, 61)} | {i: other for i in range(100, 103)} | {200: text(50) + one[700:1100] + text(50), 201: text(20) + one[900:1190], 202: other[:305] + one[:305]}
    df = spark.createDataFrame(list(docs.items()) + [(3, one)], "doc_id long, text string")
    got = [(r["a"], r["b"]) for r in spans.span_pairs(df, "doc_id", "text").collect()]
    want = {(a, b) for a in docs for b in docs if a < b and docs[a] == docs[b]}
    want |= {(i, 200) for i in range(1, 61)} | {(i, 202) for i in [*range(1, 61), *range(100, 103)]}
    assert len(got) == len(set(got)) and set(got) == want
    n = {r["id"]: (r["n_shared"], r["n_partners"]) for r in spans.shared_lengths(df, "doc_id", "text").collect()}
    assert n[1] == (2000, 61) and n[100] == (900, 3) and n[200] == (400, 60) and n[201] == (0, 0) and n[202] == (610, 63)


def parts(df, lv=spans.Levels()):  # noqa: B008
    marks = spans.stage(spans.blocks(df, "doc_id", "text", lv))
    own = spans.shared_blocks(marks)
    return marks, spans.stage(spans.recompressed(own, lv.reach() + lv.after()))


def test_a_formula_that_many_share_gives_no_candidates(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    formula = text(250)
    docs = {i: text(rnd.randint(100, 400)) + formula + text(rnd.randint(100, 400)) for i in range(400)}
    docs[500] = text(100) + docs[7][80:900]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    _, symbols = parts(df)
    assert spans.candidates(df, "doc_id", "text", symbols, spans.Levels()).count() < 400
    assert [tuple(r) for r in spans.span_pairs(df, "doc_id", "text").collect()] == [(7, 500)]


def test_whole_copies_and_long_stretches_become_symbols(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    one = text(6000)
    docs = {1: one, 2: one, 3: text(500) + one[1000:5000] + text(500), 4: text(6000), 5: "abc " * 900, 6: "abc " * 900 + "x"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    marks, symbols = parts(df)
    assert {(r["id"], r["rep"]) for r in spans.copies(marks).collect()} == {(1, 1), (2, 1)}
    rows = symbols.collect()
    long_ = {(r["id"], r["last"] - r["start"]) for r in rows if r["level"] > 0}
    assert max(n for i, n in long_ if i == 1) == max(n for i, n in long_ if i == 2) > 400
    assert not any(i == 4 for i, _ in long_)
    # every symbol that went into another lies inside it
    at = {(r["id"], r["name"], r["start"]): r["last"] for r in rows}
    assert all(at[r["id"], r["up"], r["start"] - r["role"]] >= r["last"] for r in rows if r["up"] is not None)
