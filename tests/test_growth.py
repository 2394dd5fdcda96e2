"""Steps whose memory, shuffles or seconds grew faster than their rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.functions.text import leak_normal, tokens
from graywether.operators import ensemble, events, leaks, slices, stability


def test_pieces_hold_few_words_and_every_row():
    lists = [["a"] * n for n in (3, 0, 5, 900, 1, 1, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["k", "ws"])
    found = list(events.pieces(iter([batch, batch.slice(2, 4), batch.slice(0, 0)]), 1, 6))
    assert [r for b in found for r in b.to_pylist()] == batch.to_pylist() + batch.slice(2, 4).to_pylist()
    assert all(b.num_rows == 1 or sum(len(x or []) for x in b.column(1).to_pylist()) <= 6 for b in found)


@pytest.mark.parametrize("text", ["  A  b\t\nc ", "a - b", "İK é Ünï ß", "", " - ", "x\x0b\x0cy  \r z", "٣1 ２"])
def test_normal_form_is_that_of_spark(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(leak_normal(F.col("text")).alias("n")).first()
    assert leaks.normal_form(text.encode()).decode() == row.n


def test_twins_are_found_by_digests_and_no_text_is_shuffled(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B!"), (3, None), (4, None), (5, ""), (6, "-"), (7, "c")], "id long, text string")
    twins = leaks.exact_twins(rows, rows)
    assert {(r.query_id, r.twin_id) for r in twins.collect()} == {(1, 1), (2, 1), (5, 5), (6, 5), (7, 7)}
    assert "regexp_replace" not in twins._jdf.queryExecution().optimizedPlan().toString()


def test_slices_order_no_texts(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, f"text {i}") for i in range(60)] + [(None, "a", "last")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    found = slices.split_three(df, "lang", "doc_id", 4, 3)
    got = {r.doc_id: (r.slice, r.text) for r in found.collect()}
    for lang in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is None, r[0]))
        assert [got[r[0]] for r in own] == [("cal" if i < 4 else "test" if i < 7 else "pool", r[2]) for i, r in enumerate(own)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not any("text" in line for line in plan.splitlines() if "Sort [" in line)


def test_lengths_and_sums_are_bound_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r.u for r in df.select(maths.unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert [r.s for r in df.select(maths.shares(F.col("v")).alias("s")).collect()] == [[3 / 7, 4 / 7], [0.5, 0.5], None]
    for of in (maths.unit, maths.shares):
        plan = df.select(of(F.col("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == 1  # no sum inside the element's function


def test_a_sample_takes_each_hash_once(spark):
    import hashlib

    df = spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    for rate in (0.2, 1.0):
        found = df.select("id", "k", ensemble.dropped(F.col("id"), F.col("k"), F.lit(40), rate).alias("m"))
        for r in found.collect():
            want = [r.k > 0 and hashlib.md5(f"{r.id}:{r.k}:{d // 16}".encode()).digest()[d % 16] < int(rate * 256) for d in range(40)]
            assert r.m == want


def test_resamples_equal_the_plain_ones_and_list_no_row_a_score_and_draw(spark):
    rows = [(a, i, round(random.Random(i).random(), 2)) for a in ("x", "y", None) for i in range(90)]
    obs = spark.createDataFrame([(*r, 1) for r in rows], "axis string, key long, score double, ok int").repartition(3)
    weights = {(r.key, r.draw): r.w for r in spark.range(90).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draw")).select("key", "draw", stability.poisson_weights(F.col("key"), F.col("draw")).alias("w")).collect()}
    want = set()
    for axis in ("x", "y"):
        for draw in range(5):
            drawn = sorted(s for a, k, s in rows if a == axis for _ in range(weights[k, draw]))
            at = min(int(len(drawn) * 0.3), len(drawn) - 1)
            want.add((axis, draw, drawn[at], len(drawn), sum(s >= drawn[at] for s in drawn)))
    found = stability.resampled(obs.where("axis is not null"), 0.3, 5)
    assert {tuple(r) for r in found.collect()} == want
    assert stability.resampled(obs.where("false"), 0.3, 5).collect() == []
    assert np.isfinite([w[2] for w in want]).all()


def test_terms_far_from_an_entity_disclose_it_too(spark):
    from graywether.llm import privacy

    far = "from zed@mail.example.org " + "word " * 400 + "Zebulon"
    rows = [(i, far if i < 3 else f"word from number {i}") for i in range(3000)]
    got = {r.doc_id: r.spans for r in privacy.report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 4").collect()}
    assert all(got[i].endswith(f",term:{len(far) - 7}:{len(far)}") for i in range(3)) and got[3] == ""


def test_tokens_are_found_in_one_pass_and_as_before(spark):
    rng = random.Random(3)
    signs = ["a", "Z", "9", " ", "\n", "\t", "\x0b", "\x0c", "\r", "-", "'", "é", "ß", "\u2028", "\u0085", "\U0001F600", "\x00", "٣"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "x" * 200_000, "-" * 200_000, "a" + "-" * 100_000 + " b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    trimmed = F.transform(F.split("text", r"[ \t\n\f\r]+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    found = df.select(tokens(F.col("text")).alias("got"), F.filter(trimmed, lambda t: t != "").alias("want"))
    assert found.where("not got <=> want").count() == 0
    plan = df.select(tokens(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan  # no pattern for each word
