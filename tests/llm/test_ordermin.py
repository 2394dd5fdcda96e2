import hashlib
import re
from collections import Counter

import pytest
import xxhash

from graywether.llm import ordermin
from graywether.llm.queries import QUERIES

from .fixtures import clashing, empty, odd


def expected(rows):
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    tie = lambda r: (hashed(r.text) >> 33, signed(hashed(r.text)), r.text or "")
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, *tie(r)))
    out = []
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        change = text[: len(text) - half] + after[:half]
        out.append((r.doc_id, len(text), hashlib.sha256(change.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df):
    got = ordermin.fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(df.collect())
    for r in got:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * ordermin.SKETCHES
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint != r.edited_fingerprint or r.near_edited == 1
    return got


def test_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ordermin, "RANGE_ROWS", 7)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text, by_id = {}, {r.doc_id: r for r in got}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    parts = lambda f: [f[i : i + 4] for i in range(0, len(f), 4)]
    for r in got:
        a, b = parts(r.fingerprint), parts(by_id[(r.doc_id + 1) % 200].fingerprint)
        some = [x for x in zip(a, b) if set(x) != {ordermin.EMPTY}]
        assert abs(r.near_next - (sum(x == y for x, y in some) / len(some) if some else 1.0)) < 1e-9
    monkeypatch.undo()
    again = {r.doc_id: r for r in QUERIES["op2_ordermin"](spark, sf_dir).collect()}
    assert {k: tuple(r) for k, r in again.items()} == {r.doc_id: tuple(r) for r in got}


def test_odd_rows(spark):
    check(odd(spark))
    assert len(check(clashing(spark, "part", "row", "guest", "own", "n_chars"))) == 13
    assert ordermin.fingerprints(empty(spark)).count() == 0
    alone = spark.createDataFrame([(5, "one two three four five six")], "doc_id long, text string")
    assert check(alone)[0].near_next == 1.0


def test_order_and_repeats_count(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [
        (0, " ".join(words)),
        (1, " ".join(words[150:] + words[:150])),
        (2, " ".join(words[:298] + ["x", "y"])),
        (3, " ".join(words + words)),
        (4, " ".join(words)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [r.fingerprint[i : i + 4] for i in range(0, 256, 4)] for r in ordermin.fingerprints(df).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(got[a], got[b])) / 64
    assert like(0, 4) == 1 and like(0, 2) > 0.85 and 0.3 < like(0, 1) < 0.8 and like(0, 3) < 0.6


def signed64(n):
    return n - (1 << 64) if n >> 63 else n


def brute_fingerprint(text):
    """Order MinHash in plain Python over the same hashes: each of 64 orders is the ring of k-mers from its start."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    eight = lambda h, seed: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)

    def chained(*hashes):
        seed = 42
        for h in hashes:
            seed = eight(h & (1 << 64) - 1, seed)
        return seed

    hashes = [one(w) for w in words]
    size = ordermin.K if len(words) >= ordermin.K else len(words)
    kmers = [chained(*hashes[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    seen, points = Counter(), []
    for place, k in enumerate(kmers):
        seen[k] += 1
        number = seen[k].to_bytes(4, "little")
        points.append((xxhash.xxh64_intdigest(number, eight(k, 42)) >> 26, place))
    out = []
    for sketch in range(ordermin.SKETCHES):
        start = sketch << 32  # of 38 bits
        ring = sorted(points, key=lambda x: ((x[0] - start) % (1 << 38), x[1]))
        if not ring:
            out.append(ordermin.EMPTY)
            continue
        a, b = sorted([ring[0], ring[1 % len(ring)]], key=lambda x: x[1])
        out.append(f"{signed64(chained(a[0], b[0])) % 65535 + 1:04x}")
    return "".join(out)


def test_fingerprints_against_brute_force(spark, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd(spark)):
        got = ordermin.fingerprints(docs).collect()
        want = Counter((r.doc_id, brute_fingerprint(r.text)) for r in docs.collect())
        assert Counter((r.doc_id, r.fingerprint) for r in got) == want


@pytest.mark.parametrize("n", [60, 250])
def test_swapped_halves_are_unlike(spark, n):
    rows = []
    for d in range(30):
        words = [f"w{d}x{i}" for i in range(n)]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[n // 2 :] + words[: n // 2]))]
    got = {r.doc_id: r.near_next for r in ordermin.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mean = sum(got[2 * d] for d in range(30)) / 30
    assert 0.35 < mean < 0.6


def test_ids_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ordermin, "RANGE_ROWS", 10)
    rows = [(None, f"no id {i}") for i in range(200)] + [(7, f"seven {i}") for i in range(200)] + [(i, f"row {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(docs)
    sizes = [r["count"] for r in ordermin.with_next(docs).groupBy("part").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 60
