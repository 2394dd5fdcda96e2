import random

import pytest
from pyspark.sql import functions as F

from graywether.functions.text import leak_normal
from graywether.operators import leaks, ranking
from graywether.operators.ordered import running


def plain_grams(n, k):
    return {n[i : i + k] for i in range(len(n) - k + 1)} if len(n) >= k else {n}


def plain_classes(queries, reference, law):
    """The published scan, row by row, over normal forms."""
    first = {}
    for i, n in sorted(reference):
        first.setdefault(n, i)
    index = {i: plain_grams(n, law.k) for n, i in first.items()}
    held = {}
    for i, g in index.items():
        for x in g:
            held.setdefault(x, []).append(i)
    out = {}
    for q, n in queries:
        if n in first:
            out[q] = ("exact", first[n], 1.0)
            continue
        mine, counts = plain_grams(n, law.k), {}
        for x in mine:
            for r in held.get(x, []) if len(held.get(x, [])) < law.rare_cap else []:
                counts[r] = counts.get(r, 0) + 1
        best, ref = 0.0, None
        for r in sorted(counts, key=lambda r: (-counts[r], r))[: law.top]:
            j = len(mine & index[r]) / len(mine | index[r])
            if j > best:
                best, ref = j, r
        out[q] = ("near", ref, best) if ref is not None and best >= law.near else ("clean", None, best)
    return out


@pytest.mark.parametrize("law", [leaks.Law(), leaks.Law(k=3, near=0.4, rare_cap=4, top=2)])
def test_classes_equal_the_plain_scan(spark, law):
    rng = random.Random(law.k)
    words = "alpha beta gamma delta omega sigma tau rho".split()
    ref = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    asked = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    asked += [(300 + i, t.upper() + "!") for i, t in ref[:5]] + [(400 + i, t + " x") for i, t in ref[5:15]] + [(500, None), (501, "é"), (502, "ab"), (503, asked[0][1])]
    q, r = (spark.createDataFrame(x, "id long, text string") for x in (asked, ref))
    normal = lambda df: [(x.id, x.n) for x in df.select("id", leak_normal(F.coalesce("text", F.lit(""))).alias("n")).collect()]
    want = plain_classes(normal(q), normal(r), law)
    got = {x.id: (x.kind, x.ref_id, x.jaccard) for x in leaks.classify(q, r, law).collect()}
    assert set(got) == set(want)
    for k, (kind, ref_id, j) in want.items():
        assert got[k][:2] == (kind, ref_id) and got[k][2] == pytest.approx(j)
    assert {"exact", "near", "clean"} <= {v[0] for v in got.values()}


def test_tallies(spark):
    ref = spark.createDataFrame([(1, "x", "one two three four"), (2, "y", "five six seven eight")], "id long, label string, text string")
    asked = spark.createDataFrame([(11, "x", "One two three four"), (12, "x", "five six seven eight"), (13, "y", "five six seven eight 9"), (14, "z", "nothing alike at all")], "id long, label string, text string")
    got = leaks.tallies(leaks.classify(asked, ref), asked, ref).first().asDict()
    assert got == {"reference": 2, "query": 4, "exact": 2, "exact_label_conflict": 1, "near": 1, "near_scanned": 2, "near_same_label": 1}
    assert leaks.tallies(leaks.classify(asked.where("false"), ref), asked.where("false"), ref).collect() == []
    assert {r.kind for r in leaks.classify(asked, ref.where("false")).collect()} == {"clean"}


def test_running_sums_by_group(spark):
    rows = [(g, x, x % 3) for g in ("a", "b", None) for x in range(50)]
    df = spark.createDataFrame(rows, "g string, x int, n int").repartition(5)
    for desc in (False, True):
        got = {(r.g, r.x): (r.n_upto, r.n_all) for r in running(df, "x", ["n"], ("g",), desc).collect()}
        assert len(got) == 150
        for g in ("a", "b", None):
            for x in range(50):
                assert got[g, x] == (sum(y % 3 for y in range(50) if (y >= x if desc else y <= x)), sum(y % 3 for y in range(50)))
    assert running(df.where("false"), "x", ["n"]).collect() == []


def test_recommendations(spark):
    rows = [("a", float(100 - i), int(100 - i >= 60 or i % 7 == 0)) for i in range(50)] + [("thin", 1.0, 1)] * 15 + [("tied", 5.0, 1)] * 10 + [("tied", 5.0, 0)] * 10
    obs = spark.createDataFrame(rows, "axis string, score double, ok int")
    by = lambda **k: {r.axis: r.asDict() for r in ranking.recommend(obs, **k).collect()}
    got = by(rho=0.3)
    scores = sorted(s for a, s, _ in rows if a == "a")
    assert got["a"]["threshold"] == scores[15] and (got["a"]["n_pass"], got["a"]["n_abstain"]) == (35, 15)
    assert got["thin"] == {"axis": "thin", "threshold": None, "status": None, "accuracy": None, "n": 15, "n_pass": None, "n_abstain": None}
    assert (got["tied"]["threshold"], got["tied"]["accuracy"], got["tied"]["n_pass"]) == (5.0, 0.5, 20)
    met = by(target=0.9)["a"]
    fits = [s for s in scores if sum(o for a, x, o in rows if a == "a" and x >= s) / sum(a == "a" and x >= s for a, x, _ in rows) >= 0.9]
    assert (met["threshold"], met["status"]) == (min(fits), "fitted")
    assert by(target=0.9)["tied"]["status"] == "target_unmet"
    with pytest.raises(ValueError):
        ranking.recommend(obs)
