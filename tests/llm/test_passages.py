import hashlib
import random
import re
from collections import Counter

import pytest

from graywether.llm import passages
from graywether.llm.queries import QUERIES

from .fixtures import clashing, empty, odd


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df):
    got = passages.remove_repeats(df).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)
    assert mine == brute(df.collect())
    return got


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sum(r.n_removed for r in check(docs)) > 0
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_passages"](spark, sf_dir).collect()]
    assert sorted(rows, key=str) == brute(docs.collect())


def test_made_overlaps_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 160))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            text += p[a : a + rng.randint(20, 120)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(text)))
    rows += [(500, " ".join(["a b"] * 60)), (501, " ".join(["same"] * 35)), (502, " ".join(["once"] * 34)), (503, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(df)
    monkeypatch.setattr(passages, "SHARD_REGIONS", 3)
    monkeypatch.setattr(passages, "SLOT_PHRASES", 2)
    monkeypatch.setattr(passages, "_WORDS", 100)
    check(df)


def test_rows_that_repeat_without_end(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage + " and an end")] * 5000 + [(i, f"start {i} {passage} end {i}") for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df)


@pytest.mark.parametrize("make", [odd, empty, lambda s: clashing(s, "row_key", "key", "anchor", "marks", "n_words")])
def test_odd_rows(spark, make):
    df = make(spark)
    assert len(check(df)) == df.count()


def test_chains_break_where_contexts_differ():
    words = [f"w{i}" for i in range(40)]
    place = lambda i, left, right: {"place": i, "left": left, "right": right}
    whole = [place(0, False, True), place(1, True, True), place(2, True, False)]
    assert passages.chains(words, whole) == [" ".join(words[:37])]
    assert len(passages.chains(words, [place(0, False, False), place(1, True, False), place(4, False, False)])) == 3
