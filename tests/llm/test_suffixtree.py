import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from graywether.llm import suffixtree
from graywether.llm.queries import QUERIES

from .fixtures import clashing, empty, odd


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def check(df):
    rows = df.collect()
    c = Counter(w for r in rows if not is_held(r.doc_id) for w in split(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = split(r.text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((r.doc_id, is_held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    got = suffixtree.score(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return got


def test_counts_and_base_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(docs)
    held = [r for r in got if r.held_out]
    assert 20 < len(held) < 60
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert QUERIES["op8_suffix_tree"](spark, sf_dir).count() == 200


def brute_scores(rows):
    """The tree in plain Python, level by level: scores by row, and the number of states of each length."""
    seqs = [[None, *split(r.text)] for r in rows]
    train = [q for q, r in zip(seqs, rows) if not is_held(r.doc_id)]
    words = Counter(w for q in train for w in q[1:])
    n, v = sum(words.values()), len(words)
    states, sizes = {}, []

    def p_of(q, i, depth):
        p = (words[q[i]] + 0.5) / (n + 0.5 * (v + 1))
        for d in range(1, depth + 1):
            after = states.get(tuple(q[i - d : i])) if i >= d else None
            if after is None:
                break
            t = sum(after.values())
            p = (after[q[i]] + t**suffixtree.PRIOR * p) / (t + t**suffixtree.PRIOR)
        return p

    for depth in range(1, 99):
        after, where = defaultdict(Counter), {}
        for q in train:
            for i in range(depth, len(q)):
                c = tuple(q[i - depth : i])
                if depth == 1 or c[1:] in states:
                    after[c][q[i]] += 1
                    where[c, q[i]] = (q, i)
        new = {}
        for c, counts in after.items():
            t = sum(counts.values())
            if t < suffixtree.MIN_CONTEXT:
                continue
            prior, saved = t**suffixtree.PRIOR, 0.0
            for w, k in counts.items():
                p = p_of(*where[c, w], depth - 1)
                saved += k * math.log2((k - 1 + prior * p) / ((t - 1 + prior) * p))
            if saved >= suffixtree.DIVERGENCE * t:
                new[c] = counts
        if not new:
            break
        states |= new
        sizes.append(len(new))
    return [sum(math.log10(p_of(q, i, 99)) for i in range(1, len(q))) for q in seqs], sizes


def test_scores_against_brute_force(spark, sf_dir):
    rng = random.Random(3)
    made = [" ".join(rng.choice(["a b c d e", "x b c y e", "z c q", "a b c d f"]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    small = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    for docs in (small, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")):
        rows = docs.collect()
        want, sizes = brute_scores(rows)
        got = {r.doc_id: r for r in suffixtree.score(docs, part=200 if docs is small else suffixtree.PART).collect()}
        for r, s in zip(rows, want):
            assert got[r.doc_id].score == pytest.approx(s, rel=1e-6), r.doc_id
        assert {r.depth for r in got.values()} == {len(sizes)}
        if docs is small:
            assert len(sizes) >= 3


def test_odd_rows(spark):
    check(odd(spark))
    assert len(check(clashing(spark, "key", "held_out", "at", "base", "chunk"))) == 13
    assert suffixtree.score(empty(spark)).count() == 0
    key = next(i for i in range(99) if is_held(i))
    check(spark.createDataFrame([(key, "held out only")], "doc_id long, text string"))


def test_requests_follow_what_is_sought_and_grow_with_the_input(spark, sf_dir, monkeypatch):
    """A level has as many parts as its sequences fill, not its tokens; chunks and parts grow where their pairs would otherwise."""
    docs, parts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), {}

    class Counted(suffixtree.Workspace):
        def save(self, df, table):
            out = super().save(df, table)
            if table.startswith("answers"):
                parts[int(table[7:])] = out.where("chunk is null").count()
            return out

    monkeypatch.setattr(suffixtree, "Workspace", Counted)
    want = {r.doc_id: r.score for r in suffixtree.score(docs).collect()}
    parts.clear()
    got = {r.doc_id: r.score for r in suffixtree.score(docs, part=1000).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    tokens = sum(len(split(r.text)) for r in docs.collect())
    assert tokens // 1000 > 60 and parts[1] > 20  # beside their sequences, a level's tokens would fill all these
    assert len(parts) >= 3 and all(parts[k] <= parts[1] // 2 for k in parts if k > 2)
    text = sum(len((r.text or "").encode()) for r in docs.collect())
    monkeypatch.setattr(suffixtree, "GROWS", text // 16)
    monkeypatch.setattr(suffixtree, "CHUNK", 4000)
    before = parts.copy()
    assert {r.doc_id: r.score for r in suffixtree.score(docs, part=1000).collect()} == pytest.approx(want, rel=1e-9)
    assert parts[1] <= before[1] // 2  # four times as large, of more and smaller chunks
    assert [suffixtree._growth(x) for x in (0, text // 16, text)] == [1.0, 1.0, pytest.approx(4.0, rel=0.01)]


def test_words_and_packed_arrays():
    texts = ["", " ", "A b", "\x0b x\x0cY\r\n", "İ\x1c Éa\u0085b\xa0c", "b  "]
    words, sizes = suffixtree.tokens(pa.array(["cut", *texts], pa.large_string()).slice(1))
    want = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.cast(pa.large_binary()).to_pylist() == [w for ws in want for w in ws]
    hashes, at = suffixtree._numbered([words.slice(0, 2), words.slice(2)], sizes)
    assert hashes[at].tolist() == [xxhash.xxh3_64_intdigest(w) for ws in want for w in (b"", *ws, b"")]
    arrays = [np.array([1, 2**40 + 3, 5]), np.array([], np.float32), np.array([True, False]), np.array([7, 2**47 + 1], np.uint64)]
    widths = (None, None, 1, 6)
    back = suffixtree._unpacked(suffixtree._packed(*arrays, widths=widths), np.int64, np.float32, np.bool_, np.uint64, widths=widths)
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back))
    assert [x.tolist() for x in suffixtree._unpacked(suffixtree._packed(arrays[1]), np.float32)] == [[]]
