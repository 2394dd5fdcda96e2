"""The decision core against plain Python."""

import math

import pytest

from graywether.operators import decisions

SCORES = "array<struct<label: string, score: double>>"
SCHEMA = f"case_id long, qid string, kind string, options array<string>, n long, cosines {SCORES}, nb {SCORES}, scores array<double>"
POSTURE = decisions.Posture(route=4.0, nb=1.0, nb_pair=0.25, option=0.5, yes_domain="x", threshold=0.05)


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def plain(kind, opts, n, cosines, nb, own, p=POSTURE):
    cosines, nb = dict(cosines), dict(nb or [])
    opts = ["yes", "no"] if kind == "noul" else opts or []
    named = kind != "noul" and opts and all(o in cosines for o in opts)

    def margin(d, among):
        others = [nb.get(e, 0.0) for e in among if e != d]
        return nb.get(d, 0.0) - (max(others) if others else 0.0)

    def blend(m, scale):
        return scale / 2 if n == 0 else scale * sigmoid(m / n)

    sums = []
    for i, o in enumerate(opts):
        s = 0.0
        if named:
            s += sigmoid(p.route * cosines[o]) + blend(margin(o, cosines), p.nb) + (p.nb_pair * sigmoid(margin(o, opts)) if len(opts) > 1 else 0)
        if kind == "noul" and p.yes_domain is not None:
            yes = blend(margin(p.yes_domain, cosines), p.nb)
            s += yes if o == "yes" else p.nb - yes
        mine = own[i] if i < len(own) else None
        if mine is not None:
            others = [x for j, x in enumerate(own) if j != i and x is not None]
            s += blend(mine - (max(others) if others else 0), p.option)
        sums.append(s)
    total = sum(sums)
    return [s / total if total > 0 else 1 / len(sums) for s in sums]


DOMAINS = [("x", 0.4), ("y", -0.1), ("z", 0.0)]
NB = [("x", -3.0), ("y", 2.5), ("z", 0.5)]
CASES = [
    ("choice", ["x", "y", "z"], 5, DOMAINS, NB, [1.0, -2.0, None]),
    ("choice", ["z", "x"], 5, DOMAINS, NB, [None, None]),
    ("choice", ["y", "unknown"], 5, DOMAINS, NB, [0.5, 0.25]),  # not all are domains: no route
    ("choice", ["unknown", "other"], 5, DOMAINS, NB, [None, None]),  # no term at all: even shares
    ("choice", ["x"], 5, DOMAINS, NB, [2.0]),
    ("choice", [], 5, DOMAINS, NB, []),
    ("choice", None, 5, DOMAINS, NB, []),
    ("choice", ["x", None], 5, DOMAINS, NB, [1.0, None]),
    ("choice", ["x", "y"], 0, DOMAINS, None, [0.0, 0.0]),  # a state without words
    ("score", ["0", "1", "2"], 7, DOMAINS, NB, [1.0, 3.0, -4.0]),
    ("score", ["x", "y"], 7, [], [], [1.0, 1.0]),  # no domains
    ("noul", None, 4, DOMAINS, NB, [0.5, -0.5]),
    ("noul", ["ignored"], 0, DOMAINS, None, [None, None]),
]


def test_decisions_equal_plain_python(spark):
    rows = [(i, "q", kind, opts, n, cosines, nb, own) for i, (kind, opts, n, cosines, nb, own) in enumerate(CASES)]
    found = decisions.decide(spark.createDataFrame(rows, SCHEMA), ["case_id"], POSTURE).collect()
    assert len(found) == len(CASES)
    for r in found:
        want = [round(x, 6) for x in plain(*CASES[r.case_id])]
        assert r.probs == pytest.approx(want, abs=1.5e-6), r.case_id
        if not want:
            assert (r.pick, r.conf, r.cause) == (None, None, "no_option")
        else:
            assert r.pick == r.options[r.probs.index(max(r.probs))]
            assert r.cause == ("score_gate" if r.conf < 0.05 else "answered")
    by = {r.case_id: r for r in found}
    assert by[3].pick == "unknown" and by[3].cause == "score_gate"  # ties: the first
    assert by[4].probs == [1.0] and by[4].cause == "answered"


def test_terms_that_are_off(spark):
    rows = [(1, "q", "noul", None, 4, DOMAINS, NB, [None, None])]
    out = decisions.decide(spark.createDataFrame(rows, SCHEMA), ["case_id"], decisions.Posture()).first()
    assert out.probs == [0.5, 0.5] and out.pick == "yes"  # nothing speaks: even shares, the first
    rows = [(1, "q", "choice", ["x", "y"], 4, DOMAINS, NB, [None, None])]
    out = decisions.decide(spark.createDataFrame(rows, SCHEMA), ["case_id"], decisions.Posture(readout="max_prob")).first()
    assert out.conf == max(out.probs)


def test_centroids_leave_the_own_fold_out(spark):
    rows = [(0, "a", [1.0, 0.0]), (0, "b", [0.0, 1.0]), (1, "a", [0.6, 0.8]), (1, "b", [0.0, 2.0]), (2, "c", [3.0, 4.0]), (2, None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "fold int, label string, vector array<double>")
    found = {r.fold: {d.label: d.dir for d in r.domains} for r in decisions.fold_centroids(df).collect()}
    assert {f: sorted(d) for f, d in found.items()} == {0: ["a", "b", "c"], 1: ["a", "b", "c"], 2: ["a", "b"]}  # c is known to fold 2 only
    assert found[0]["a"] == pytest.approx([0.6, 0.8]) and found[1]["a"] == pytest.approx([1, 0]) and found[0]["c"] == pytest.approx([0.6, 0.8])
    both = [1.6, 0.8]
    assert found[2]["a"] == pytest.approx([x / math.hypot(*both) for x in both])
    out = {(r.fold, r.label): {c.label: c.score for c in r.cosines} for r in decisions.cosines(df, decisions.fold_centroids(df)).collect()}
    assert out[1, "a"] == pytest.approx({"a": 0.6, "b": 0.8, "c": 1.0})


def test_one_fold_and_no_rows(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0])], "fold int, label string, vector array<double>")
    cents = decisions.fold_centroids(df)
    assert cents.count() == 0
    assert decisions.cosines(df, cents).first().cosines == []
    assert decisions.decide(spark.createDataFrame([], SCHEMA), ["case_id"]).count() == 0


def test_a_decision_is_a_projection(spark):
    rows = [(i, "q", kind, opts, n, cosines, nb, own) for i, (kind, opts, n, cosines, nb, own) in enumerate(CASES)]
    plan = decisions.decide(spark.createDataFrame(rows, SCHEMA), ["case_id"], POSTURE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_events_of_a_state_are_written_once(spark, sf_dir, monkeypatch):
    """No written table has a row for each question with the text's events, and the answers are given without a shuffle of them."""
    from graywether.plans import decisions as plan

    written = {}

    class Noted(plan.Workspace):
        def save(self, df, table):
            written[table] = df.columns
            return super().save(df, table)

    monkeypatch.setattr(plan, "Workspace", Noted)
    out = plan.decided(spark, sf_dir)
    assert [t for t, columns in written.items() if "toks" in columns] == ["rows"]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
