import dataclasses
import random

from trackloom.llm import leakage as le

rnd = random.Random(7)
VOCAB = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(3, 10))) for _ in range(2000)]
take = lambda n: [rnd.choice(VOCAB) for _ in range(n)]
ITEM = take(30)
TESTS = [(1, " ".join(ITEM), None), (2, " ".join(take(25)), " ".join(take(20))), (3, "too short", ""), (None, "x", "y")]


def docs():
    p = ITEM
    out = {
        "whole": take(40) + p + take(40), "part15": take(20) + p[5:20] + take(20), "part14": take(20) + p[5:19] + take(20), "start": p[:15], "end": take(9) + p[15:],
        "layout": [w.upper() + ",\n" for w in p], "typos": [w[:-1] + "x" if i % 9 == 4 and len(w) > 4 else w for i, w in enumerate(p)], "other words": [rnd.choice(VOCAB) if i in (6, 13) else w for i, w in enumerate(p[:20])],
        "interrupted": p[:9] + ["(Laughter)", "from", "the", "benches"] + p[9:18], "left out": p[:8] + p[9:18], "mixed": rnd.sample(p, 30), "none": take(200)}
    return {k: " ".join(v) for k, v in out.items()} | {"null": None, "empty": ""}


WANT = {"whole", "part15", "start", "end", "layout", "typos", "other words", "interrupted", "left out"}


def test_altered_passages(spark):
    d = docs()
    names = list(d)
    df = spark.createDataFrame([(i, d[n], "x") for i, n in enumerate(names)] + [(0, d["whole"], "x"), (None, d["whole"], "x")], "doc_id long, text string, id string")
    t = spark.createDataFrame(TESTS, "item long, passage string, question string")
    got = le.leaks(df, "doc_id", "text", t, "item", ["passage", "question"]).collect()
    assert {(names[r["id"]], r["item"]) for r in got} == {(n, 1) for n in WANT} and len(got) == len(WANT)
    # a test set in several blocks gives the same
    small = dataclasses.replace(le.Search(), block=40)
    assert sorted(le.leaks(df, "doc_id", "text", t, "item", ["passage", "question"], small).collect()) == sorted(got)
    assert le.leaks(df.where("false"), "doc_id", "text", t, "item", ["passage"]).collect() == []
    assert le.leaks(df, "doc_id", "text", t.where("false"), "item", ["passage"]).collect() == []


def test_masks_hit_fifteen_words_with_any_three_altered():
    from itertools import combinations

    for bad in combinations(range(15), 3):
        assert any(all(p + o not in bad for o in m) for m in le.Search().masks for p in range(15 - m[-1]))


def test_words():
    assert le.words("Straße, ÉTÉ 5,499 and 1 467­ co-\nop's\t12.5%") == ["strasse", "ete", "5499", "and", "1467", "coop", "s", "125"]
    assert le.words(None) == le.words("") == le.words(" .,\n") == []
    assert le.near("carriage", "carraige") and le.near("harbour", "harbor") and not le.near("1985", "1986") and not le.near("cat", "car")


def test_the_part_of_a_cut_passage_that_holds(spark):
    p = random.Random(3).sample(VOCAB, 60)
    other = lambda ws: "".join(c if c in "aeiou" else "z" for c in ws) + "qqq"
    d = {
        "16+13": p[:16] + p[21:34], "15+11": p[:15] + p[19:30], "20+20": p[:20] + p[26:46], "second part": p[:10] + p[15:31], "replaced": p[:16] + [other(w) for w in p[16:21]] + p[21:34],
        "long gap after": p[:16] + take(30) + p[16:26], "long gap before": p[:10] + take(30) + p[10:26], "twice": p[:15] + take(30) + p[20:60], "14+14": p[:14] + p[19:33], "every fifth": [other(w) if i % 5 == 4 else w for i, w in enumerate(p)]}
    names = list(d)
    df = spark.createDataFrame([(i, " ".join(take(30) + d[n] + take(30))) for i, n in enumerate(names)], "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(p))], "item long, passage string")
    got = {names[r["id"]]: r["words"] for r in le.leaks(df, "doc_id", "text", t, "item", ["passage"]).collect()}
    assert got == {"16+13": 16, "15+11": 15, "20+20": 20, "second part": 16, "replaced": 16, "long gap after": 26, "long gap before": 26, "twice": 40, "every fifth": 59}


def test_short_pieces_around_an_interruption(spark):
    p = ["government", "benches", "colleague", "industry", "quarrel", "moderate", "northern", "railway", "treasury", "hospital", "building", "vessels", "question", "schedule", "whatever"]
    alter = lambda *at: [w[:-2] + w[-1] + w[-2] if i in at else w for i, w in enumerate(p)]
    rows = [(bad, cut) for cut in (5, 6, 7, 8, 9, 10) for bad in [(), (9,), (10,), (3, 10), (2, 11)]]
    docs = [(i, " ".join(take(20) + (a := alter(*bad))[:cut] + ["(Laughter", "from", "the", "benches)"] + a[cut:] + take(20))) for i, (bad, cut) in enumerate(rows)]
    t = spark.createDataFrame([(1, " ".join(p))], "item long, passage string")
    got = le.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", t, "item", ["passage"]).collect()
    assert {rows[i] for i in range(len(rows))} - {rows[r["id"]] for r in got} == set()


def leaked(spark, passage, docs):
    """Which of ``docs`` (name: words) hold a stretch of the passage."""
    names = list(docs)
    df = spark.createDataFrame([(i, " ".join(docs[n])) for i, n in enumerate(names)], "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(passage))], "item long, passage string")
    return {names[r["id"]] for r in le.leaks(df, "doc_id", "text", t, "item", ["passage"]).collect()}


def test_two_and_three_of_fifteen_words_replaced(spark):
    from itertools import combinations

    p = random.Random(5).sample(VOCAB, 15)
    triples = random.Random(6).sample(list(combinations(range(1, 14), 3)), 120)
    bads = [(), *((i,) for i in range(15)), *combinations(range(15), 2), *triples]
    docs = {b: take(25) + ["zzqq" + str(i) if i in b else w for i, w in enumerate(p)] + take(25) for b in bads}
    inner = {b for b in bads if 0 not in b and 14 not in b}  # a stretch whose first or last word is replaced has fewer than 15
    assert leaked(spark, p, docs) == inner
    # four of fifteen are too many, and another number tells something else
    worse = {b: ["zzqq" if i in b else w for i, w in enumerate(p)] for b in [(2, 5, 8, 11), (3, 4, 9, 12)]}
    assert leaked(spark, p, worse) == set()
    q = [*p[:7], "476", *p[7:14]]
    assert leaked(spark, q, {"same": q, "other": [*q[:7], "810", *q[8:]], "word": [*q[:7], "many", *q[8:]]}) == {"same", "word"}
    # a number broken up is the same number
    r = [*p[:7], "6528", *p[7:15]]
    broken = {k: [*p[:7], *k.split(), *p[7:15]] for k in ("6 528", "6, 528", "6 (Rires) 528", "65-28", "6 529", "7 528")}
    assert leaked(spark, r, broken) == {"6 528", "6, 528", "6 (Rires) 528", "65-28"}


def test_interruptions_of_any_length(spark):
    docs, p = {}, random.Random(8).sample(VOCAB, 20)
    for n in (4, 30, 60, 200, 5000):
        docs[n, "one"] = take(30) + p[:10] + take(n) + p[10:] + take(30)
        docs[n, "two"] = take(3000) + p[:7] + take(n) + p[7:13] + take(n) + p[13:]
        docs[n, "altered"] = p[:4] + ["zzqq"] + p[5:10] + take(n) + p[10:15] + ["zzqq"] + p[16:]
        docs[n, "turned"] = p[10:] + take(n) + p[:10]  # the pieces stand in another order
    assert leaked(spark, p, docs) == {k for k in docs if k[1] != "turned"}
