import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graywether.operators import basis, bayes, features, typed

ROWS = [
    (1, "w", "s", '{"b": {"type": "choice", "instructions": "x", "criteria": {"z": "d", "a": null}}, "a": {"type": "score", "instructions": "y", "criteria": ["lo", "hi"]}}', '{"b": {"label": "a", "probabilities": {"a": 0.7, "z": 0.3}}, "a": {"label": " 1 ", "score": 0.5}}'),
    (2, "w", "s", '{"l": {"type": "choice", "instructions": "x", "criteria": ["p", 7, null]}, "m": {"type": "choice", "instructions": "x", "criteria": ["p", null]}}', '{"l": {"label": 7}, "m": {"label": null}}'),
    (3, "w", "s", '{"t": {"type": "noul", "instructions": "x"}, "u": {"type": "noul", "instructions": "x"}, "v": {"type": "noul", "instructions": "x"}}', '{"t": {"label": true, "probabilities": {"true": 0.9}}, "u": {"label": "False", "noul": 0.2}, "v": {"label": "TRUE"}}'),
    (4, "w", "s", '{"no_gold": {"type": "noul", "instructions": "x"}, "bad": {"type": "free", "instructions": "x"}, "n": {"type": "noul", "instructions": 5}, "w": {"type": "choice", "instructions": "x", "criteria": {"a": 1}}, "k": 3}', '{"bad": {"label": 1}, "n": {"label": true}, "w": {"label": "b"}, "k": {"label": 1}}'),
    (5, None, "s", "{}", "{}"), (6, "w", None, "{}", "{}"), (7, "w", "s", "[1]", "{}"), (8, "w", "s", "{}", "{broken"), (9, "w", "s", None, "{}"), (10, "w", "s", "{}", "{}"),
    (11, "w", "s", '{"q": {"type": "score", "instructions": "x", "criteria": {"a": 1}}, "r": {"type": "score", "instructions": "x", "criteria": ["a"]}, "s": {"type": "score", "instructions": "x", "criteria": ["a"]}}', '{"q": {"label": 0}, "r": {"label": -1}, "s": {"label": 1.5}}'),
]


def exploded(spark):
    return typed.exploded(spark.createDataFrame(ROWS, "id int, workflow string, state string, questions string, gold string"))


def test_questions_keep_order_and_gold(spark):
    got = {(r.id, r.qid): r for r in exploded(spark).collect()}
    assert (got[1, "b"].pos, got[1, "a"].pos, got[1, "b"].options, got[1, "b"].gold_idx, got[1, "b"].soft) == (0, 1, ["z", "a"], 1, [0.3, 0.7])
    assert (got[1, "a"].options, got[1, "a"].gold_idx, got[1, "a"].soft, got[1, "a"].gold_score) == (["0", "1"], 1, [0, 0], 0.5)
    assert (got[2, "l"].options, got[2, "l"].gold_idx, got[2, "m"].gold_idx) == (["p", "7", "None"], 1, 1)
    assert [got[3, q].gold_idx for q in "tuv"] == [1, 0, 1] and [got[3, q].soft[1] for q in "tuv"] == [0.9, 0.2, 0.5]


def test_what_is_skipped_is_counted(spark):
    rows = exploded(spark)
    got = {(r.id, r.qid): r.status for r in rows.collect()}
    assert [got[4, q] for q in ("no_gold", "bad", "n", "w", "k")] == ["gold", "kind", "instructions", "answer", "kind"]
    assert all(got[i, None] == "row" for i in (5, 6, 7, 8, 9)) and not any(i == 10 for i, _ in got)
    assert [got[11, q] for q in "qrs"] == ["answer", "answer", "answer"]
    counts = {r.status: r.n for r in typed.validity(rows).collect()}
    assert counts == {"ok": 7, "row": 5, "gold": 1, "kind": 2, "instructions": 1, "answer": 4}


def test_responses(spark):
    schema = "id int, pos int, qid string, kind string, options array<string>, probs array<double>, pick int, confidence double, abstained int, reason string"
    rows = [(1, 1, "b", "noul", ["false", "true"], [0.25, 0.75], 1, 0.5, 1, "gate"), (1, 0, "a", "choice", ["x", "y"], [0.9, 0.1], 0, 0.8, 0, "answered")]
    got = json.loads(typed.responses(spark.createDataFrame(rows, schema)).first().response)
    assert got["answers"] == [
        {"question_id": "a", "outcome": "x", "probabilities": [0.9, 0.1], "confidence": 0.8},
        {"question_id": "b", "outcome": None, "probabilities": [0.75], "confidence": 0.5},
    ]
    assert got["routing"] == ["answered", "gate"]


def test_self_training_uses_the_other_half_only(spark):
    schema = "doc_id long, gold string, label string, fold int, known boolean, text string"
    rows = [(1, "en", "en", 2, True, "the cat"), (2, "fr", "fr", 2, True, "le chat"), (3, "en", None, 0, False, "the moon shines"), (4, "en", None, 1, False, "moon shines"), (5, "fr", None, 1, False, "zzz"), (6, "fr", None, 0, False, None)]
    counted = features.bucket_rows(spark.createDataFrame(rows, schema), ["doc_id", "gold", "label", "fold", "known"])

    def decide(found):
        best = F.array_max(F.transform("scores", lambda x: F.struct(x["score"].alias("s"), x["label"].alias("l"))))
        return found.select("doc_id", "gold", best["l"].alias("pick"))

    got = {r.doc_id: (r.honest, r.pick) for r in bayes.transductive(counted, decide).collect()}
    assert got == {3: ("en", "en"), 4: (None, "en"), 5: (None, None), 6: (None, None)}


def test_embedded_rows_have_unit_length(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "same same same")], "id long, text string")
    got = {r.id: np.array(r.vector) for r in features.embedded(rows, ["id"], 32).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and not got[2].any() and not got[3].any()
    assert np.count_nonzero(got[4]) in (1, 2)


def test_certificate_finds_planted_directions(spark):
    rng = np.random.default_rng(5)
    d, n = 6, 400
    mix = rng.normal(size=(d, d))
    pop = rng.normal(size=(n, d)) @ mix
    lead = np.linalg.qr(rng.normal(size=(d, 2)))[0]
    white = rng.normal(size=(n, 2)) @ lead.T + 0.02 * rng.normal(size=(n, d))
    cov = np.cov(pop.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    back = (vectors * np.sqrt(values)) @ vectors.T
    deltas = white @ back
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    population = frame([(x.tolist(),) for x in pop], "vector array<double>")
    pairs = [("fit", x.tolist()) for x in deltas[:300]] + [("held", x.tolist()) for x in deltas[300:]] + [("other", x.tolist()) for x in rng.normal(size=(50, d)) @ back] + [("fit", None), ("fit", [1.0])]
    cert = basis.certify(population, frame(pairs, "family string, vector array<double>"), d)
    moment = np.linalg.inv(back) @ (deltas[:300].T @ deltas[:300] / 300) @ np.linalg.inv(back)
    np.testing.assert_allclose(cert.spectrum, np.linalg.eigvalsh(moment)[::-1], rtol=1e-4, atol=1e-6)
    assert (cert.verdict, cert.k, cert.n_pairs, cert.n_population) == ("certified", 2, 300, n)
    assert cert.leakage["held"] < 0.01 < 0.4 < cert.leakage["other"]
    assert np.linalg.norm(cert.directions, axis=1) == pytest.approx(1)
    few = basis.certify(population, frame(pairs[:3], "family string, vector array<double>"), d)
    assert few.verdict == "unidentified_insufficient_pairs" and few.k is None
    flat = basis.certify(population, frame([("fit", x.tolist()) for x in rng.normal(size=(300, d)) @ back], "family string, vector array<double>"), d)
    assert flat.verdict == "unidentified_no_gap" and flat.directions is None
    rows = frame([(1, pop[0].tolist())], "id int, vector array<double>")
    out = {r.direction: np.array(r.vector) for r in basis.moved(rows, cert.directions, 0.5, ["id"]).collect()}
    want = pop[0] + 0.5 * cert.directions[1]
    np.testing.assert_allclose(out[1], want / np.linalg.norm(want))
    np.testing.assert_allclose(out[-1], pop[0] / np.linalg.norm(pop[0]))
