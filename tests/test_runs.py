"""Ensembles, resampled thresholds, posture search and decoy ladders against plain Python."""

import hashlib
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from graywether.operators import descent, ensemble, null_ladder, stability, vectors
from graywether.operators.verdicts import POISSON


def test_ensembles_equal_plain_samples(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, rng.normal(size=20).astype(np.float32).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    cents = vectors.centroids(df)
    dirs = {r.label: np.array(r["dir"]) for r in cents.collect()}
    got = {(r.case_id, r.opt): r for r in ensemble.fold(ensemble.samples(df, cents, 5, 0.3)).collect()}
    for i, _, x in rows:
        u = np.array(x, dtype=float) / np.linalg.norm(np.array(x, dtype=float))
        probs, picks = [], []
        for k in range(5):
            raw = [hashlib.md5(f"{i}:{k}:{b}".encode()).digest() for b in range(2)]
            keep = np.array([not (k and raw[d // 16][d % 16] < int(0.3 * 256)) for d in range(20)])
            v = u * keep
            v = v / (np.linalg.norm(v) or 1)
            s = [1 / (1 + math.exp(-8 * (v @ dirs[c] - 0.35))) for c in sorted(dirs)]
            p = [round(y / sum(s), 6) for y in s]
            probs.append(p)
            picks.append(p.index(max(p)))
        for c in sorted(dirs):
            r = got[i, c]
            mine = [p[c] for p in probs]
            assert (r.n, r.picks) == (5, picks.count(c))
            assert r["mean"] == pytest.approx(statistics.mean(mine), abs=1e-6) and r.sigma == pytest.approx(statistics.pstdev(mine), abs=1e-6)
    read = {r.case_id: r for r in ensemble.readouts(ensemble.fold(ensemble.samples(df, cents, 5, 0.3))).collect()}
    for i, _, _ in rows:
        counts = [got[i, c].picks for c in sorted(dirs)]
        assert read[i].majority == counts.index(max(counts)) and read[i].u_bon == pytest.approx(1 - max(counts) / 5)
        assert read[i].u_pair == pytest.approx(1 - sum(c * (c - 1) for c in counts) / 20)
    one = ensemble.readouts(ensemble.fold(ensemble.samples(df, cents, 1, 0.3))).collect()
    plain = {r.case_id: r.pick for r in vectors.answer(vectors.route(df, cents)).collect()}
    assert all(r.majority == plain[r.case_id] and r.u_pair == 0 for r in one)


def weight(key, draw):
    u = int(hashlib.md5(f"{key}:{draw}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= t for t in POISSON)


def test_resampled_thresholds_equal_sorting_each_draw(spark):
    rows = [(a, i, round(((i * 37) % 23) / 23, 3), int(i % 3 > 0)) for a, n in (("x", 60), ("y", 25), ("thin", 5)) for i in range(n)]
    obs = spark.createDataFrame(rows, "axis string, key long, score double, ok int").repartition(3)
    drawn = stability.resampled(obs, 0.3, draws=20)
    got = {(r.axis, r.draw): (r.threshold, r.m, r.n_pass) for r in drawn.collect()}
    want = {}
    for a in ("x", "y", "thin"):
        for d in range(20):
            listed = sorted(s for b, i, s, _ in rows if b == a for _ in range(weight(i, d)))
            if listed:
                t = listed[min(int(len(listed) * 0.3), len(listed) - 1)]
                want[a, d] = (t, len(listed), sum(s >= t for s in listed))
    assert got == want
    spread = {r.axis: r for r in stability.distribution(drawn, 20).collect()}
    for a in ("x", "y"):
        ts = sorted(t for (b, _), (t, _, _) in want.items() if b == a)
        assert (spread[a].p05, spread[a].p95, spread[a].least, spread[a].most) == (ts[int(len(ts) * 0.05)], ts[int(len(ts) * 0.95)], ts[0], ts[-1])
        assert spread[a].sd == pytest.approx(statistics.stdev(ts)) and spread[a].n_none == 20 - len(ts)
    cells = {r.axis: r for r in stability.cells(obs, obs, 0.3, 20).collect()}
    assert cells["thin"].threshold is None and cells["thin"].stable == 0 and cells["thin"].mean is None
    assert cells["x"].stable in (0, 1) and cells["x"].edge in ("none", "pass_rate", "accuracy")
    curve = [(r.place, r.n_pass) for r in stability.curve(obs, spark.createDataFrame([("x", 0.5)], "axis string, threshold double")).orderBy("place").collect()]
    assert curve == [(p, sum(s >= round(0.5 + o, 9) for a, _, s, _ in rows if a == "x")) for p, o in zip(range(-3, 4), (-0.1, -0.05, -0.02, 0, 0.02, 0.05, 0.1))]


def plain_accuracy(rows, point):
    cases = {}
    for case, gold, opt, *terms in rows:
        cases.setdefault((case, gold), []).append((-round(sum(point[n] * t for n, t in zip("abc", terms)), 9), opt))
    return sum(min(v)[1] == gold for (_, gold), v in cases.items()) / len(cases)


def test_descent_equals_a_plain_walk_and_counts_jobs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, o, *(float(x) for x in np.round(rng.normal(size=3) + (o == i % 3) * np.array([0.3, 0.6, 0.2]), 3))) for i in range(80) for o in range(3)]
    terms = spark.createDataFrame(rows, "case_id int, gold int, opt int, a double, b double, c double")
    ladders = {"a": [0.0, 0.5, 1.0, 2.0], "b": [0.0, 1.0, 2.0], "c": [0.0, 1.0]}
    walk = descent.descend(terms, {"a": 1.0, "b": 0.0, "c": 0.0}, ladders)
    point, acc, passes, moves, jobs = {"a": 1.0, "b": 0.0, "c": 0.0}, plain_accuracy(rows, {"a": 1.0, "b": 0.0, "c": 0.0}), 0, [], 1
    for turn in range(2):
        moved = False
        for name, ladder in ladders.items():
            jobs += 1
            best, found = None, acc
            for rung in ladder:
                trial = point | {name: rung}
                a = plain_accuracy(rows, trial)
                if rung != point[name] and round(a - acc - 0.01, 9) >= 0 and a > found:
                    best, found = trial, a
            if best:
                moves.append((turn, name, point[name], best[name]))
                point, acc, moved = best, found, True
        passes += 1
        if not moved:
            break
    assert (walk.point, walk.passes, walk.jobs, [m[:4] for m in walk.moves]) == (point, passes, jobs, moves) and walk.accuracy == pytest.approx(acc)
    grid = [dict(zip("abc", p)) for p in itertools.product(*ladders.values())]
    assert descent.accuracies(terms, grid) == pytest.approx([plain_accuracy(rows, p) for p in grid])
    only = descent.descend(terms, {"a": 0.0, "b": 0.0, "c": 0.0}, {"b": [0.0, 1.0]})
    assert only.accuracy == pytest.approx(max(plain_accuracy(rows, {"a": 0, "b": b, "c": 0}) for b in (0.0, 1.0)))
    assert descent.accuracies(terms.where("false"), grid[:2]) == [0.0, 0.0]


def test_scales_swap_without_refitting():
    point = {"a": 1.0, "b": 0.0}
    assert descent.swapped(point, {"a"}, a=0.5) == {"a": 0.5, "b": 0.0} and descent.swapped(point, {"a"}, b=0.0) == point
    with pytest.raises(ValueError, match="b"):
        descent.swapped(point, {"a"}, b=0.5)


def record(spark, rows):
    """Answers (case_id, k, probs, abstained, confidence, regime, p_yes) with two own options and decoys after them."""
    made = [(c, k, [f"o{i}" for i in range(len(p))], 2, p, p.index(max(p)), conf, ab, regime, yes) for c, k, p, ab, conf, regime, yes in rows]
    schema = "case_id int, k int, options array<string>, n_own int, probs array<double>, pick int, confidence double, abstained int, regime string, p_yes double"
    return null_ladder.records(spark.createDataFrame(made, schema))


def test_null_ladder_hand_cases(spark):
    rows = [
        (1, 0, [0.6, 0.4], 0, 0.6, "routed", 0.5), (1, 2, [0.2, 0.3, 0.4, 0.1], 0, 0.4, "routed", 0.5),  # flips, a decoy wins
        (2, 0, [0.3, 0.7], 0, 0.7, "routed", 0.4), (2, 2, [0.4, 0.1, 0.3, 0.2], 1, 0.4, "drafter-only", 0.4),  # flips across regimes
        (3, 0, [0.5, 0.5], 1, 0.5, "routed", None), (3, 2, [0.1, 0.6, 0.2, 0.1], 0, 0.6, "routed", None),  # ties without decoys
        (4, 0, [0.9, 0.1], 0, 0.9, "routed", 0.2), (4, 2, [0.4, 0.4, 0.1, 0.1], 0, 0.4, "routed", 0.2),  # towards neutral only
    ]
    recs = record(spark, rows)
    got = {(r.case_id, r.k): r for r in recs.collect()}
    assert (got[1, 2].a, got[1, 2].p_a, got[1, 2].p_b, got[1, 2].decoy_won) == ("o0", 0.2, 0.3, 1)
    assert (got[2, 2].a, got[2, 2].p_a, got[3, 0].tie, got[4, 2].n_shown) == ("o1", 0.1, 1, 4)
    a1 = {r.k: r for r in null_ladder.drift(recs).collect()}
    assert (a1[0].abstain_rate, a1[0].median_d_conf_pt, a1[2].abstain_rate, a1[2].d_abstain_pt, a1[2].decoy_win_rate) == (0.25, 0, 0.25, 0, 0.25)
    assert a1[2].median_d_conf_pt == pytest.approx(30)  # of 10, 20, 30, 50 the one at 4 // 2
    a2 = {r.k: r for r in null_ladder.flips(recs).collect()}
    assert (a2[0].flips, a2[0].verdict) == (0, "PASS")
    assert (a2[2].n_untied, a2[2].flips, a2[2].within, a2[2].cross, a2[2].verdict) == (3, 2, 1, 1, "RED") and a2[2].flip_rate == pytest.approx(2 / 3)
    a3 = null_ladder.shape(recs).first()
    assert (a3.noul_identical, a3.conf_shape) == (1, "joint") and a3.median_d_conf_top_pt == pytest.approx(30)
    still = record(spark, [(1, 0, [0.6, 0.4], 0, 0.6, "n/a", None), (1, 2, [0.6, 0.4, 0.0], 0, 0.6, "n/a", None)])
    a3 = null_ladder.shape(still).first()
    assert (a3.noul_identical, a3.conf_shape, a3.median_d_conf_top_pt) == (None, "conditional", 0)
    drifting = record(spark, [(1, 0, [0.6, 0.4], 0, 0.6, "n/a", 0.5), (1, 2, [0.6, 0.4, 0.0], 0, 0.6, "n/a", 0.6)])
    assert null_ladder.shape(drifting).first().noul_identical == 0


def test_arms_show_what_decoys_there_are(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], ["x", "y", "z"]), (2, ["a", "b"], [])], "case_id int, options array<string>, decoys array<string>")
    got = {(r.case_id, r.k): (r.options, r.n_own) for r in null_ladder.arms(cases, [0, 2, 9]).collect()}
    assert got[1, 0] == (["a", "b"], 2) and got[1, 2] == (["a", "b", "x", "y"], 2) and got[1, 9][0] == list("abxyz") and got[2, 9] == (["a", "b"], 2)
    with pytest.raises(ValueError):
        null_ladder.run(cases, [2], lambda df: df)
    assert null_ladder.flips(record(spark, [(1, 0, [0.6, 0.4], 0, 0.6, "n/a", None)]).where("false")).collect() == []
