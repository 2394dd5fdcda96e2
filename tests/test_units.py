import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graywether.functions import maths
from graywether.functions import text as T
from graywether.operators import compare, events, metrics, ranking
from graywether.plans import registry
from graywether.sources import corpora
from graywether.streaming import feedback


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_readouts(spark):
    assert one(spark, maths.readout(array(1, 0, 0))) == pytest.approx(1)
    assert one(spark, maths.readout(array(0.5, 0.5))) == pytest.approx(0)
    assert one(spark, maths.readout(array(*[0.2] + [0.1] * 8))) == pytest.approx(0.2)
    assert one(spark, maths.readout(array(*[0.3] + [0.1] * 7))) == pytest.approx(1 - (-0.3 * math.log(0.3) - 0.7 * math.log(0.1)) / math.log(8))
    assert one(spark, maths.argmax_first(array(1, 3, 3))) == 1
    assert one(spark, maths.skill(F.lit(0.9), F.lit(0.5))) == pytest.approx(0.8)


def test_bins_are_right_closed(spark):
    edges = [(0.0, None), (1 / 15, 0), (1 / 15 + 1e-9, 1), (1.0, 14)]
    assert [one(spark, maths.ece_bin(F.lit(x))) for x, _ in edges] == [b for _, b in edges]


def test_wilson(spark):
    low, high = maths.wilson(F.lit(5), F.lit(10.0))
    assert one(spark, low) == pytest.approx(0.236593, abs=1e-5) and one(spark, high) == pytest.approx(0.763407, abs=1e-5)
    assert [one(spark, c) for c in maths.wilson(F.lit(0), F.lit(0.0))] == [0, 1]


def test_auroc_of_one_class_is_nan(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, y int")
    assert math.isnan(metrics.auroc(df).first().auroc)
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "score double, y int")
    assert metrics.auroc(df).first().auroc == pytest.approx(0.875)


def test_mcnemar():
    assert compare.exact_mcnemar(0, 0) == 1 and compare.exact_mcnemar(9, 1) == pytest.approx(22 / 1024)


def test_target_threshold_falls_back_to_the_best(spark):
    df = spark.createDataFrame([(1, 0.9, 0), (2, 0.8, 1), (3, 0.7, 1), (4, 0.1, 0)], "case_id int, conf double, ok int")
    got = ranking.target_threshold(df, 0.99).first()
    assert (got.threshold, got.support, got.met) == (0.7, 3, False)
    assert ranking.target_threshold(df, 0.6).first().threshold == 0.7


def fnv_bytes(raw, salt):
    h = T.FNV_OFFSET ^ salt
    for b in raw:
        h = ((h ^ (b + 32 if 65 <= b <= 90 else b)) * 1099511628211) % (1 << 64)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def fnv(word):
    return signed(fnv_bytes(word.encode(), T.WORD_SALT))


def test_pairs_fold_bytes_like_letters(spark):
    words = ["Hello", "naïve", "a", "x" * 40, "win", "lose"]
    hashes = [fnv_bytes(w.encode(), T.WORD_SALT) for w in words]
    want = [signed(fnv_bytes(a.to_bytes(8, "little") + b.to_bytes(8, "little"), T.BIGRAM_SALT)) for a, b in zip(hashes, hashes[1:])]
    assert [one(spark, T.bigram_hash(F.lit(signed(a)), F.lit(signed(b)))) for a, b in zip(hashes, hashes[1:])] == want
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    rows = events.token_events(docs).where("is_bigram").orderBy("pos").collect()
    assert [r.h for r in rows] == want
    assert any(65 <= b <= 90 for h in hashes for b in h.to_bytes(8, "little"))  # else folding isn't tested


def test_negations(spark):
    for word, want in [("Not", True), ("isnt", True), ("don't", True), ('don"T', True), ("DON'T", False), ("n't", False), ("scarcely", False), ("knot", False)]:
        assert one(spark, T.is_negation(F.lit(word))) is want, word


def test_features_of_sentence_pairs(spark):
    def features(premise, hypothesis):
        df = spark.createDataFrame([(premise, hypothesis)], "p string, h string")
        return tuple(df.select(T.nli_tokens(F.col("p")).alias("p"), T.nli_tokens(F.col("h")).alias("h")).select(*T.nli_features(F.col("p"), F.col("h"))).first())

    assert features("They win 3 games", "they don't lose 3 or 4 happy games") == (3 / 10, 3 / 9, 9 / 4, 1, 0, 1, 1, 1, 0, 1)
    assert features("an unhappy and disabled man", "happy, able, abled")[8] == 2
    assert features("no not never none", "") == (0, 0, 0, 0, 3, 3, 0, 0, 0, 0)
    assert features("", "a") == (0, 0, 1, 0, 0, 0, 0, 0, 0, 0)


def test_hash_and_normal_forms(spark):
    for w in ("Hello", "naïve", "a", "x" * 40):
        assert one(spark, T.word_hash(F.lit(w))) == fnv(w)
    assert one(spark, T.leak_normal(F.lit("  A -- b\n\tC! "))) == "a  b c"
    assert one(spark, T.tokens(F.lit("(one) -- two's, 3."))) == ["one", "two's", "3"]
    assert one(spark, T.char_grams(T.characters(F.lit("abcab")), 2)) == ["ab", "bc", "ca"]
    assert one(spark, T.char_grams(T.characters(F.lit("a")), 2)) == ["a"]
    assert one(spark, T.common_prefix(F.split(F.lit("A b c"), " "), F.split(F.lit("a B d"), " "))) == 2
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1


def test_corpus_folder(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "billing").mkdir(parents=True)
    (root / "billing" / "a.md").write_text(" invoice \n")
    (root / "billing" / "b.md").write_text("refund")
    (root / "deploy.md").write_text("ship it")
    rows = corpora.read_corpus(spark, str(root)).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("billing", "billing/a.md", "invoice"), ("billing", "billing/b.md", "refund"), ("deploy", "deploy.md", "ship it")]
    (root / "billing.md").write_text("twice")
    with pytest.raises(ValueError):
        corpora.read_corpus(spark, str(root))
    (root / "billing.md").unlink()
    (root / "deploy.md").write_text(" \n")
    with pytest.raises(Exception, match="empty document"):
        corpora.read_corpus(spark, str(root)).collect()


def test_envelopes_and_sinks(spark, tmp_path):
    (tmp_path / "train-000.json").write_text(json.dumps({"rows": [{"row_idx": 0, "row": {"text": "a", "label": 1}}, {"row_idx": 1, "row": {"text": "b", "label": 0}}]}))
    (tmp_path / "train-001.json").write_text("not json")
    rows = corpora.read_envelopes(spark, [str(tmp_path / "train-000.json"), str(tmp_path / "train-001.json")], "text string, label int").collect()
    assert sorted((r.row_idx, r.text, r.label) for r in rows) == [(0, "a", 1), (1, "b", 0)]
    q = spark.createDataFrame([(1, 0, 1, [0.25, 0.75])], "row_id long, gold int, pick int, q array<double>")
    corpora.write_teacher(q, str(tmp_path / "t"))
    assert corpora.read_teacher(spark, str(tmp_path / "t")).first().q == [0.25, 0.75]
    made = spark.createDataFrame([("x", "text", "gold")], "label string, text string, provenance string")
    corpora.write_synthetic(made, str(tmp_path / "s"), {"suite": "demo"})
    assert corpora.read_synthetic(spark, str(tmp_path / "s")).count() == 1
    made.write.mode("append").json(str(tmp_path / "s" / "rows"))
    with pytest.raises(ValueError):
        corpora.read_synthetic(spark, str(tmp_path / "s"))
    corpora.write_items(q.drop("q"), str(tmp_path / "i"), by="gold")
    assert spark.read.json(str(tmp_path / "i")).count() == 1


def test_calibrator(spark, sf_dir):
    assert feedback.fit([(0.9, 1)] * 10) == (1.0, 0.0)
    over = [(0.9, i % 2) for i in range(200)] + [(0.1, i % 2) for i in range(200)]
    a, b = feedback.fit(over)
    assert 0 < a < 0.1 and abs(b) < 0.1
    batch = {tuple(r) for r in registry.QUERIES["feedback_calibration"](spark, sf_dir).collect()}
    assert batch == {tuple(r) for r in registry.QUERIES["feedback_stream"](spark, sf_dir).collect()}


def test_entry_and_names(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and set(rows.columns) == {"doc_id", "gold", "pick", "conf", "cause", "ok"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
