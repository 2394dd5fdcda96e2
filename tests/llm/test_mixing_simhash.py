import glob
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from graywether.llm import mixing, simhash
from graywether.llm.queries import QUERIES
from graywether.llm.tables import Workspace, shared_dir

from .fixtures import clashing, empty, odd


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def check_mix(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
    target = water_fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mix_meets_targets_and_reruns_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(mixing, "LEAF", 4)
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 200
    check_mix(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_mix_odd_rows(spark):
    rows = mixing.mix(clashing(spark, "size", "p", "u", "leaf")).collect()
    assert len(rows) == 13
    check_mix(rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_capped_sources_reshare(spark):
    sizes = {"a": 100, "b": 1, "c": 2, "d": 1000, None: 5}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(df, Workspace(spark, "test")).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_large_ids_beside_nulls_and_repeats(spark):
    ids = [2**53 + 1 + 2 * i for i in range(20)]
    rows = [(i, f"some words {i}", "s") for i in ids] + [(None, "no id here", "s"), (None, None, "s")]
    rows += [(7, "the same words again", "s")] * 5000 + [(1000 + i, "one", f"source{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    check_mix(got)
    copies = [r.copies for r in got if r.doc_id == 7]
    assert len(set(copies)) == 2
    assert Counter(r.doc_id for r in mixing.take(docs, mixed).collect()) == Counter({i: n for i, n in _summed(got).items() if n})
    leaf = docs.sparkSession.read.parquet(max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/mixing-*/leaves"), key=os.path.getmtime))
    assert leaf.where("source = 's'").groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 5 * mixing.BLOCK


def _summed(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id] += r.copies
    return out


def test_pivot_keeps_mass_and_odds():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 50, 40).astype(float)
    p = rng.random(40)
    mean = np.zeros(40)
    for _ in range(4000):
        q, held = mixing.pivot(list(size), list(p), list(rng.random(40)))
        assert abs(size @ np.array(q) - size @ p) < 1e-6
        assert sum(0 < x < 1 for x in q) == (held >= 0)
        mean += q
    assert np.abs(mean / 4000 - p).max() < 0.05


def test_take_repeats_rows(spark, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd(spark)):
        mixed = mixing.mix(docs)
        out = mixing.take(docs, mixed)
        assert out.columns == docs.columns
        assert out.count() == sum(r.copies for r in mixed.collect())


def simple_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [simple_simhash(r.text) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(root(i)), r.doc_id) if x is not None]
        least[root(i)] = min(ids, default=None)
    return sorted(((r.doc_id, f"{fps[i]:016x}", least[root(i)]) for i, r in enumerate(rows)), key=str)


def test_near_duplicates_against_brute_force(spark, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd(spark)):
        got = simhash.near_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(docs.collect())
    assert QUERIES["op7_simhash"](spark, sf_dir).count() == 200
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(clashing(spark, "fp", "component_id")).count() == 13


def test_any_three_bits_meet_under_a_key():
    keys = [set(s) for s in simhash.position_keys()]
    from itertools import combinations

    assert all(any(not s & set(bad) for s in keys) for bad in combinations(range(8), 3))


@pytest.mark.parametrize("postings", [5, 60, 20_000])
def test_split_keys_give_the_same_groups(spark, monkeypatch, postings):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 6, 120)]
    fps = sorted({(int(x) ^ f) - (1 << 64 if (int(x) ^ f) >> 63 else 0) for x in base for f in flips})
    monkeypatch.setattr(simhash, "POSTINGS", postings)
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    def groups():
        out = defaultdict(set)
        for x in fps:
            out[root(x)].add(x)
        return sorted(map(sorted, out.values()))

    for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), Workspace(spark, "test")).collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 64
        label[root(max(r.a, r.b))] = root(min(r.a, r.b))
    got, label = groups(), {x: x for x in fps}
    for x in fps:
        for y in fps:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3:
                label[root(max(x, y))] = root(min(x, y))
    assert got == groups()


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    got = defaultdict(set)
    for r in simhash.components(edges, Workspace(spark, "test")).collect():
        got[r.root].add(r.node)
    assert sorted(map(len, got.values())) == [200, 301]


def brute_alike(rows, least=0.8):
    """Index sets of the rows that links of a five-word likeness of `least` reach."""
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) / len(a | b) >= least):
                group[max(root(i), root(j))] = min(root(i), root(j))
    found = defaultdict(set)
    for i in range(len(rows)):
        found[root(i)].add(i)
    return list(found.values())


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.mark.parametrize("bucket", [4, 10_000])
def test_alike_against_brute_force(spark, monkeypatch, bucket):
    rng = np.random.default_rng(11)
    texts = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        # shares of changed words from hardly any to too many for a likeness of 0.8
        texts += [edited(rng, base, int(len(base) * share)) for share in rng.uniform(0, 0.05, 25)]
        texts += [" ".join(base).upper().replace(" ", "\n"), " ".join(base)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, "one two"), (901, "ONE  two"), (902, "one"), (903, ""), (904, None), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    held = docs.collect()
    want = {frozenset(str(held[i].doc_id) for i in g) for g in brute_alike(held)}
    got = defaultdict(set)
    for r in simhash.alike(docs).collect():
        got[r.group].add(str(r.doc_id))
    got = {frozenset(g) for g in got.values()}
    assert 12 < len(want) < len(rows) - 30
    assert got == want


def test_alike_odd_rows(spark):
    assert simhash.alike(clashing(spark, "cls", "sig", "group", "bucket")).count() == 13
    assert simhash.alike(empty(spark)).count() == 0
    kept = simhash.keep_one(clashing(spark, "cls", "sig", "group"))
    assert kept.columns[-3:] == ["cls", "sig", "group"]
    held = odd(spark).collect()
    assert kept.count() == len(brute_alike(held))
