import pytest
from pyspark.sql import functions as F

from graywether.operators import laws, verdicts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_g1_verdict(spark):
    v = lambda fitted, *e: one(spark, verdicts.g1_verdict(F.lit(fitted), *map(F.lit, e)))
    assert [v(True, 0.1, 0.2, 0.3), v(True, 0.2, 0.2, 0.3), v(True, 0.1, 0.2, 0.1), v(False, 0.1, 0.2, 0.3)] == ["pass", "fail", "fail", "no_claim"]
    d = lambda *x: one(spark, verdicts.dominates(*map(F.lit, x)))
    assert d(0.9, 0.1, 0.8, 0.1) and not d(0.9, 0.2, 0.8, 0.1) and not d(0.8, 0.1, 0.8, 0.1)


def test_router_leaves_its_own_case_out(spark):
    cases = "case_id int, gold string, labels array<string>, probs array<double>, ok int"
    a = spark.createDataFrame([(1, "x", ["x", "y"], [0.9, 0.1], 1), (2, "x", ["x", "y"], [0.2, 0.8], 0)], cases)
    b = spark.createDataFrame([(1, "x", ["x", "y"], [0.1, 0.9], 0), (2, "x", ["x", "y"], [0.8, 0.2], 1)], cases)
    # without its own hit each case trusts the other lane, which is wrong there
    assert tuple(verdicts.loo_routed(a, b).first()) == (0.0, 2)
    assert tuple(verdicts.loo_routed(a.limit(1), b.where("case_id = 1")).first())[0] is None


def test_byte_trigrams(spark):
    grams = lambda s: one(spark, verdicts.byte_trigrams(F.lit(s)))
    assert grams("") == [] and grams("Ab") == ["6162"] and grams("ABCA") == ["616263", "626361"]
    assert grams("é") == ["C3A9"]


def test_decoys_span_from_near_to_far(spark):
    slots = spark.createDataFrame([(1, "alpha", ["alpha"]), (2, "x", ["alphb", "alphx", "beta", "zz"])], "case_id int, gold string, labels array<string>")
    got = {r.case_id: r.decoys for r in verdicts.graded_decoys(slots, 3).collect()}
    assert got[1] == ["alphb", "alphx", "zz"] and got[2] == ["alpha"]


def test_label_space_and_fields(spark):
    assert one(spark, verdicts.label_space(F.array(*map(F.lit, [0.5, 0.3, 0.2])), F.array(*map(F.lit, [2, 0, 1])))) == [0.3, 0.2, 0.5]
    assert one(spark, verdicts.fields(F.lit("a\n\nb\n"))) == ["a", "b"]


def test_resample_weights_are_poisson(spark):
    w = spark.range(20000).select(verdicts.poisson_weights(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert w.m == pytest.approx(1, abs=0.03) and w.v == pytest.approx(1, abs=0.05)


def test_depth_and_evidence(spark):
    rows = spark.createDataFrame([(10, 1), (10, 1), (1, 0), (0, 1), (None, 1)], "depth int, ok int")
    got = verdicts.depth_ece(rows).first()
    assert got.n == 3 and got.ece == pytest.approx(0.1 / 3)
    seen = spark.createDataFrame([(0, 4), (3, 6), (8, 8), (8, 16)], "seen long, total long")
    got = verdicts.evidence_stats(seen).first().asDict()
    assert (got["p25"], got["p50"], got["p75"], got["rumor_share"], got["zero_share"]) == (0, 3, 8, 0.5, 0.25)
    assert got["mean_share"] == pytest.approx((0 + 0.5 + 1 + 0.5) / 4)


def test_hygiene_of_empty_and_shared_texts(spark):
    rows = [(0, 1, "the quick brown fox"), (9, 1, None), (1, 0, "a quick brown fox"), (2, 0, ""), (3, 0, "other words other words"), (4, 0, "other words other")]
    got = {r.fold: r for r in verdicts.hygiene(spark.createDataFrame(rows, "id int, fold int, text string")).collect()}
    assert (got[0].n, got[0].max_overlap, got[0].trigram_hits) == (4, 0.75, 1) and got[0].mean_overlap == pytest.approx(0.1875)
    assert (got[1].n, got[1].max_overlap, got[1].trigram_hits) == (2, 0.75, 1)


def test_fields_lose_no_line(spark):
    rows = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 12))), (2, "a\n\nb"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.f for r in rows.select("id", verdicts.fields(F.col("text")).alias("f")).collect()}
    assert got == {1: [*(f"l{i}" for i in range(1, 7)), "l7\nl8\nl9\nl10\nl11", "l8"], 2: ["a", "b"], 3: [], 4: None}


def test_budget_without_weight_goes_round(spark):
    rooms = spark.createDataFrame([("a", 3, 0.0), ("b", 1, 0.0), ("c", 9, 0.0)], "label string, room long, weight double")
    assert {r.label: r.share for r in laws.budget(rooms, 6).collect()} == {"a": 3, "b": 1, "c": 2}
    weighed = rooms.withColumn("weight", F.when(F.col("label") == "c", 3.0).otherwise(1.0))
    assert {r.label: r.share for r in laws.budget(weighed, 6).collect()} == {"a": 2, "b": 1, "c": 3}


def test_knife_edge(spark):
    items = spark.createDataFrame([(i, 0.5 if i < 8 else 0.9, 1) for i in range(10)], "case_id int, conf double, ok int")
    got = {r.place: (r.pass_rate, r.edge) for r in verdicts.knife_edge(items, 0.5).collect()}
    assert got == {-1: (1.0, "none"), 0: (1.0, "none"), 1: (0.2, "pass_rate")}
