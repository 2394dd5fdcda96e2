import numpy as np
import pytest
from pyspark.sql import functions as F

from graywether.functions.text import BUCKETS
from graywether.operators import bayes, features
from graywether.plans import texts

SCHEMA = "doc_id long, label string, fold int, text string"
ROWS = [
    (1, "en", 0, "the cat sat on the mat"),
    (1, "en", 0, "the cat sat on the mat"),
    (2, "en", 1, "the dog sat"),
    (3, "fr", 0, "le chat est la"),
    (4, "fr", 1, "le chien est la la"),
    (5, None, 1, "the cat est"),
    (6, "fr", 2, "nothing known here zzz"),
    (7, "en", 0, ""),
    (8, "fr", 1, None),
    (None, "en", 0, "the mat"),
    (9, "de", 2, "der hund le"),
    (10, "en", 7, "a fold of its own: the cat"),
]


def plain(rows, row):
    """n, seen and scores by label of one row, from dictionaries."""
    train = [r for r in rows if r.fold != row.fold and r.label is not None]
    n_in = {}
    for r in train:
        mine = n_in.setdefault(r.label, {})
        for t, k in zip(r.toks, r.times):
            mine[t] = mine.get(t, 0) + k
    n_in = {label: c for label, c in n_in.items() if c}
    total = sum(sum(c.values()) for c in n_in.values())
    known = {t for c in n_in.values() for t in c}
    seen = sum(k for t, k in zip(row.toks, row.times) if t in known)
    if not seen:
        return row.n, 0, None
    scores = {}
    for label, c in n_in.items():
        size = sum(c.values())
        scores[label] = 0.0
        for t, k in zip(row.toks, row.times):
            if t in known:
                out = sum(x.get(t, 0) for x in n_in.values()) - c.get(t, 0)
                scores[label] += k * (np.log2((c.get(t, 0) + 1) / (size + BUCKETS)) - np.log2((out + 1) / (total - size + BUCKETS)))
    return row.n, seen, scores


@pytest.mark.parametrize("most", [bayes.MOST_TABLE, 0])
def test_scores_by_either_way_equal_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(bayes, "MOST_TABLE", most)
    rows = features.bucket_rows(spark.createDataFrame(ROWS, SCHEMA), ["doc_id", "label", "fold"]).cache()
    got = bayes.scores(rows.withColumn("gold", F.col("label")), bayes.fold_counts(rows), ["doc_id", "gold"]).collect()
    local = rows.collect()
    want = [(r.doc_id, r.label, *plain(local, r)) for r in local]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert len(got) == len(want)
    for g, (doc, gold, n, seen, scores) in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (g.doc_id, g.gold, g.n, g.seen) == (doc, gold, n, seen)
        found = None if g.scores is None else {x.label: x.score for x in g.scores}
        assert found == (None if scores is None else pytest.approx(scores))
    rows.unpersist()


def test_every_document_is_decided_or_has_no_evidence(spark, tmp_path):
    rows = spark.createDataFrame([(r[0], r[3], r[1]) for r in ROWS], "doc_id long, text string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.decide_language(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    causes = {r.doc_id: (r.cause, r.pick, r.conf) for r in got}
    assert causes[7] == causes[8] == ("no_evidence", None, None) and causes[1][0] != "no_evidence"
    rows.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert texts.decide_language(spark, str(tmp_path / "none")).collect() == []


def test_empty_table(spark):
    rows = features.bucket_rows(spark.createDataFrame([], SCHEMA), ["doc_id", "label", "fold"])
    assert bayes.scores(rows, bayes.fold_counts(rows), ["doc_id"]).collect() == []
