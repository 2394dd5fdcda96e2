"""Fitted readouts against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graywether.functions.text import BUCKETS
from graywether.operators import density, features, heads, kernels, ridge
from graywether.plans import fits
from graywether.sources.tables import table


def counted(rows):
    return [(r.doc_id, r.label, r.fold, dict(zip(r.toks, r.times)), dict(zip(r.toks, r.runs))) for r in rows.collect()]


def plain_ridge(rows, k, lam):
    """Weights (ratio times weight, then the bias) of a dense fit over rows of bucket counts, by label."""
    df = {}
    for *_, times, _ in rows["all"]:
        for t in times:
            df[t] = df.get(t, 0) + 1
    chosen = sorted(sorted(df, key=lambda t: (-df[t], t))[:k])
    train = rows["train"]
    x = np.array([[float(t in r[3]) for t in chosen] + [1.0] for r in train])
    counts = np.array([[r[3].get(t, 0) for t in chosen] for r in train])
    out = {}
    for label in {r[1] for r in rows["all"]}:
        mine = np.array([r[1] == label for r in train])
        n_in, n_all = counts[mine].sum(axis=0), counts.sum(axis=0)
        r = np.append(np.log((n_in + 1) / BUCKETS) - np.log((n_all - n_in + 1) / (len(train) + BUCKETS)), 1)
        scaled = x * r
        out[label] = (r, np.linalg.solve(scaled.T @ scaled + lam * np.eye(len(r)), scaled.T @ mine.astype(float)))
    return chosen, out


def weights_of(model, fold):
    out = {}
    for r in model.weights.where(F.col("fold") == fold).collect():
        out.setdefault(r.label, {})[r.tok] = (r.ratio, r.weight)
    return out


@pytest.mark.parametrize("k, crossed", [(300, True), (2048, False)])
def test_ridge_weights_and_scores_equal_a_dense_solve(spark, sf_dir, monkeypatch, k, crossed):
    monkeypatch.setattr(ridge, "CLASSES", 3)
    monkeypatch.setattr(ridge, "MOST_WEIGHTS", 3000)
    rows = fits.counted(spark, sf_dir)
    model = ridge.fit(rows, k, crossed=crossed)
    scored = {}
    for r in ridge.scores(rows, model, ["doc_id"]).collect():
        scored[r.doc_id, r.label] = r.score
    every = counted(rows)
    assert len(scored) == len(every) * 4
    for fold in range(fits.FOLDS) if crossed else [0]:
        train = [r for r in every if not crossed or r[2] != fold]
        chosen, want = plain_ridge({"all": every, "train": train}, k, ridge.LAMBDA)
        got = weights_of(model, fold)
        assert list(model.features) == chosen and set(got) == set(want)
        for label, (ratio, weight) in want.items():
            mine = np.array([got[label][t] for t in [*chosen, -1]])
            np.testing.assert_allclose(mine[:, 0], ratio, rtol=1e-12)
            np.testing.assert_allclose(mine[:, 1], weight, atol=1e-8)
            for doc, _, f, _, runs in every:
                if f == fold or not crossed:
                    score = sum(runs.get(t, 0) * ratio[i] * weight[i] for i, t in enumerate(chosen)) + weight[-1]
                    assert scored[doc, label] == pytest.approx(score, abs=1e-7)


def test_ridge_takes_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, label string, fold int, text string"
    rows = [(1, "a", 0, "red apple"), (1, "a", 0, "red apple"), (None, "b", 1, "blue sky"), (3, "b", 1, None), (4, "a", 1, ""), (5, None, 0, "red sky " * 50), (6, "b", 0, "blue blue")]
    made = features.bucket_rows(spark.createDataFrame(rows, schema), ["doc_id", "label", "fold"])
    got = {(r.doc_id, r.label): r for r in made.collect()}
    assert got[3, "b"].toks == [] and got[3, "b"].n == 0 and got[6, "b"].n == 3
    assert sorted(got[6, "b"].times) == [1, 2] and sorted(got[6, "b"].runs) == [1, 1] and sum(got[5, None].times) == 199
    model = ridge.fit(made, 10)
    scores = ridge.scores(made, model, ["doc_id", "text"] if "text" in made.columns else ["doc_id"]).collect()
    assert len(scores) == len(rows) * 3 and all(np.isfinite(r.score) for r in scores)
    none = features.bucket_rows(spark.createDataFrame([], schema), ["doc_id", "label", "fold"])
    assert ridge.scores(none, ridge.fit(none, 10), ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        ridge.fit(made, ridge.MOST_FEATURES + 1)


@pytest.mark.parametrize("rows_at_once, exact, sums", [(4096, 1 << 24, 1000), (3, 7, 1)])
def test_ridge_sums_in_tasks_equal_plain_ones(spark, monkeypatch, rows_at_once, exact, sums):
    monkeypatch.setattr(ridge, "ROWS", rows_at_once)
    monkeypatch.setattr(ridge, "EXACT", exact)
    monkeypatch.setattr(ridge, "CLASS_SUMS", sums)
    rng = np.random.default_rng(5)
    rows = [(i % 3, [None, "a", "b"][i % 5 % 3], sorted(rng.choice(12, i % 7, replace=False).tolist())) for i in range(60)]
    data = [(f, label, toks, [t + 1 for t in toks]) for f, label, toks in rows]
    df = spark.createDataFrame(data, "fold int, label string, toks array<int>, times array<int>").repartition(2)
    have = {t: sum(t in toks for _, _, toks in rows) for t in range(12)}
    chosen = ridge.top_buckets(df, 8)
    assert chosen == sorted(sorted(have, key=lambda t: (-have[t], t))[:8])
    counts = ridge.class_counts(df, chosen)
    want = {(f, x, t): [(t + 1) * n, n] for f in range(3) for x in (None, "a", "b") for t in chosen if (n := sum(t in toks for g, y, toks in rows if (g, y) == (f, x)))}
    assert {(r.fold, r.label, r.tok): [r.n_in, r.df] for r in counts.collect()} == want
    for r in ridge.pair_counts(df, chosen).collect():
        x = np.array([[t in toks for t in chosen] + [True] for f, _, toks in rows if f == r.fold], dtype=np.int64)
        assert (np.frombuffer(r.m, np.int64).reshape(9, 9) == x.T @ x).all()
    assert "Generate explode" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert ridge.class_counts(df, []).count() == 0


def test_ridge_blend_term(spark):
    scored = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "doc_id long, label string, score double")
    temp = ridge.temperature(scored, "doc_id")
    assert temp.first().temp == 0.5
    got = {(r.doc_id, r.label): r.term for r in ridge.blend_terms(scored, "doc_id", temp, 2.0).collect()}
    assert got[1, "a"] == pytest.approx(2 / (1 + np.exp(-2))) and got[1, "b"] == pytest.approx(2 / (1 + np.exp(2))) and got[2, "a"] == got[2, "b"] == 1


def plain_heads(rows, labels):
    """The published sequential fit of rows (label, vector) in order."""
    w, b, t = np.zeros((len(labels), len(rows[0][1]))), np.zeros(len(labels)), 0
    for _ in range(heads.EPOCHS):
        for label, x in rows:
            rate = heads.RATE * (1 - t / (heads.EPOCHS * len(rows)))
            t += 1
            z = w @ x + b
            g = 1 / (1 + np.exp(-z)) - np.array([float(v == label) for v in labels])
            w = w * (1 - rate * heads.DECAY) - rate * np.outer(g, x)
            b = b - rate * g
    return np.column_stack([w, b])


def log_loss(w, rows, labels):
    total = 0.0
    for label, x in rows:
        z = w[:, :-1] @ x + w[:, -1]
        total += sum(np.log1p(np.exp(-v if k == label else v)) for k, v in zip(labels, z))
    return total / len(rows)


def test_one_shard_is_the_sequential_fit_and_shards_come_near(spark, sf_dir):
    rows = fits.vectors_folded(spark, sf_dir)
    plain = sorted((r.label, r.key, np.array(r.vector)) for r in rows.collect())
    one = heads.fit(rows, crossed=False)
    ordered = [(label, x) for label, _, x in plain]
    want = plain_heads(ordered, one.labels)
    np.testing.assert_allclose(one.weights[0], want, atol=1e-9)
    many = heads.fit(rows, crossed=False, shard_rows=max(1, len(plain) // 3))
    again = heads.fit(rows.repartition(3), crossed=False, shard_rows=max(1, len(plain) // 3))
    assert many.weights[0].tobytes() == again.weights[0].tobytes()
    base = log_loss(np.zeros_like(want), ordered, one.labels)
    assert log_loss(want, ordered, one.labels) < log_loss(many.weights[0], ordered, one.labels) < base


def test_heads_leave_out_what_has_no_label_and_refuse_too_many(spark, monkeypatch):
    schema = "key long, label string, fold int, shard_by long, vector array<float>"
    rows = spark.createDataFrame([(1, "a", 0, 1, [1.0, 0.0]), (2, "b", 1, 2, [0.0, 1.0]), (3, None, 0, 3, [1.0, 1.0]), (4, "a", 1, 4, None), (5, "a", 1, 5, [1.0, 0.5]), (6, "b", 0, 6, [0.0, 1.0])], schema)
    fitted = heads.fit(rows)
    got = heads.logits(rows, fitted, ["key"]).collect()
    assert fitted.labels == ("a", "b") and sorted({r.key for r in got}) == [1, 2, 3, 5, 6]
    picks = {k: max((r.logit, r.label) for r in got if r.key == k)[1] for k in (1, 2, 5, 6)}
    assert picks == {1: "a", 2: "b", 5: "a", 6: "b"}
    assert heads.logits(rows.where("false"), heads.fit(rows.where("false")), ["key"]).collect() == []
    monkeypatch.setattr(heads, "MOST_WEIGHTS", 3)
    with pytest.raises(ValueError):
        heads.fit(rows)


def test_scale_ladder(spark):
    rows = [(i, 0, opt, 0.6 if opt == 1 else 0.4, 9.0 if opt == 0 else -9.0) for i in range(10) for opt in (0, 1)]
    terms = spark.createDataFrame(rows, "case_id long, gold int, opt int, base double, logit double")
    got = {r.scale: (r.accuracy, r.selected) for r in heads.scale_ladder(terms, [0.0, 0.1, 0.25, 1.0]).collect()}
    assert got == {0.0: (0.0, 0), 0.1: (0.0, 0), 0.25: (1.0, 1), 1.0: (1.0, 0)}
    off = {r.scale: r.selected for r in heads.scale_ladder(terms.withColumn("gold", F.lit(1)), [0.0, 0.5]).collect()}
    assert off == {0.0: 1, 0.5: 0}


def test_density_steps_equal_numpy_and_never_fall(spark, sf_dir):
    rows = density.projected(fits.vectors_folded(spark, sf_dir), ["key", "label", "fold"], 64, 8)
    local = rows.collect()
    gates = density.fit(rows, components=3, steps=5)
    first = density.start(rows.join(spark.createDataFrame([(x, i) for i, x in enumerate(gates.labels)], "label int, place int"), "label"), 3, [0, 1], True)
    for (fold, model), mixture in first.items():
        x = np.array([r.x for r in local if r.fold != fold and model in (density.POOLED, gates.labels.index(r.label))])
        seen = []
        for _ in range(5):
            terms = np.array([[np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (row - m) ** 2 / v).sum() for w, m, v in zip(mixture.weight, mixture.mean, mixture.var)] for row in x])
            total = np.log(np.exp(terms).sum(axis=1))
            seen.append(total.mean())
            r = np.exp(terms - total[:, None])
            n = r.sum(axis=0)
            mean = (r.T @ x) / n[:, None]
            mixture = density.Mixture(n / len(x), mean, np.maximum((r.T @ x**2) / n[:, None] - mean**2, density.VAR_FLOOR))
        got = [ll for f, m, _, ll in gates.history if (f, m) == (fold, model)]
        np.testing.assert_allclose(got, seen, rtol=1e-8)
        assert all(b >= a - 1e-9 for a, b in zip(got, got[1:]))
        np.testing.assert_allclose(gates.mixtures[fold, model].mean, mixture.mean, atol=1e-8)


def test_density_declines_strangers_and_takes_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], i // 2 % 2, (rng.normal(size=4) * 0.2 + (i % 2) * 3).tolist()) for i in range(80)] + [(90, None, 0, [0.0] * 4), (91, "a", 0, None)]
    df = spark.createDataFrame(rows, "key long, label string, fold int, x array<double>")
    gates = density.fit(df, components=2, steps=4)
    asked = spark.createDataFrame([(1, "a", 0, [0.0] * 4), (2, "a", 0, [3.0] * 4), (3, "z", 0, [0.0] * 4), (4, "b", 1, [3.0] * 4)], "key long, pick string, fold int, x array<double>")
    got = {r.key: r for r in density.declined(density.confidences(asked, gates, ["key"]), 0.5).collect()}
    assert [got[k].declined for k in (1, 2, 3, 4)] == [0, 1, 0, 0] and got[3].confidence is None
    none = density.fit(df.where("false"), 2)
    assert none.mixtures == {} and density.confidences(asked, none, ["key"]).count() == 4
    arms = spark.createDataFrame([("a", 0, 0.9, 1), ("a", 1, 0.1, 0), ("b", 1, 0.5, 1)], "arm string, declined int, conf double, ok int")
    stats = {r.arm: r for r in density.arm_stats(arms).collect()}
    assert (stats["a"].abstain_rate, stats["a"].selective_n, stats["a"].selective_accuracy) == (0.5, 1, 1.0) and stats["a"].answered_ece == pytest.approx(0.1)
    assert (stats["b"].abstain_rate, stats["b"].selective_accuracy, stats["b"].answered_ece) == (1.0, 0.0, None)


def plain_kernel(rows):
    u = {k: np.array(v) / np.linalg.norm(v) for k, _, v in rows}
    out = {}
    for label in {r[1] for r in rows}:
        mine = sorted(k for k, x, _ in rows if x == label)
        if len(mine) < 2:
            continue
        tau = max(np.mean([1 - u[a] @ u[b] for a in mine for b in mine if a < b]), 1e-6)
        for a in mine:
            cos = [(u[a] @ u[b], -b) for b in mine if b != a]
            out[a] = (np.log(sum(np.exp(c / tau) for c, _ in cos)) - np.log(len(cos)), -max((round(c, 12), b) for c, b in cos)[1], tau)
    return out


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_kernel_densities_equal_brute_force(spark, sf_dir, block_rows):
    df = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.label, np.array(r.embedding, dtype=float)) for r in df.collect()]
    odd = df.limit(1).select((F.col("vec_id") + 10**6).alias("vec_id"), "embedding", F.lit(77).alias("label")).unionByName(df.limit(1).select(F.lit(None).cast("long").alias("vec_id"), "embedding", "label"))
    loo, packed, shape = kernels.densities(df.select("vec_id", "embedding", "label").unionByName(odd), block_rows=block_rows)
    want = plain_kernel(rows)
    got = {r.key: r for r in loo.collect()}
    assert set(got) == set(want)
    for k, (ell, near, _) in want.items():
        assert got[k].loo == pytest.approx(ell, abs=1e-9) and got[k].near == near
    assert max(r.n for r in packed.select(F.size("rows").alias("n")).collect()) <= 4 * block_rows
    cands = df.select(F.col("vec_id").alias("key"), "label", F.col("vec_id").alias("src"), F.reverse("embedding").alias("vector"))
    deltas = {r.key: r.delta for r in kernels.candidate_deltas(cands, loo, packed, shape, block_rows=block_rows).collect()}
    u = {k: v / np.linalg.norm(v) for k, _, v in rows}
    for k, label, _ in rows[:20]:
        mine = [u[b] for b, x, _ in rows if x == label]
        back = u[k][::-1]
        assert deltas[k] == pytest.approx(np.log(np.mean([np.exp(back @ v / want[k][2]) for v in mine])) - want[k][0], abs=1e-8)
