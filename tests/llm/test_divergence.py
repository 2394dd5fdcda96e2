import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from graywether.llm import divergence
from graywether.llm.queries import ORACLES, QUERIES

from .fixtures import ROWS, clashing, empty, odd


def brute(rows):
    """Rows of the audit for (lang, source, text), in plain integers."""
    having, times, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        having[lang].update(set(found))
        times[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= divergence.MIN_DOCS]
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            count = times[lang, s] if s is not None else sum((times[lang, x] for x in sources), Counter())
            n = sum(count[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if times[lang, s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -minus, i + 1) for i, (minus, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.lang, r.source, r.text) for r in docs.collect()])
    assert rows_of(QUERIES["op13_divergence"](spark, sf_dir)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(ORACLES["op13_divergence"]).fetchall()) == want


def test_blocks_of_groups_and_terms_give_the_same_rows(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    want = rows_of(divergence.audit(docs))
    monkeypatch.setattr(divergence, "GROUPS", 6)
    monkeypatch.setattr(divergence, "TILE", 400)
    assert rows_of(divergence.audit(docs)) == want


def test_odd_rows(spark):
    many = odd(spark)
    for _ in range(2):
        many = many.union(many)
    many = many.union(many).union(many)  # a text has 12 copies, so its words are kept
    got = rows_of(divergence.audit(many))
    assert got == brute([(r[2], r[3], r[1]) for r in ROWS] * 12)
    assert {x[1] for x in got if x[0] == ""} == set("b") | {""} and any(x[4] == 0 for x in got)


def test_ties_empty_tables_and_clashing_columns(spark):
    assert rows_of(divergence.audit(empty(spark))) == []
    names = ["n", "docs", "term", "value", "rank", "v", "n_lang", "block", "tb", "other", "total"]
    assert rows_of(divergence.audit(clashing(spark, *names))) == rows_of(divergence.audit(odd(spark)))
    same = spark.createDataFrame([("en", s, "b a c") for s in ("x", "y", "é", "z") for _ in range(12)], "lang string, source string, text string")
    got = rows_of(divergence.audit(same))
    assert [(r[1], r[3], r[5]) for r in got if r[1] == "x"] == [("x", "y", 1), ("x", "z", 2), ("x", "é", 3)] and {r[4] for r in got} == {0}


@pytest.mark.parametrize("total", [1, 7, 10**9 + 7, 9 * 10**15])
def test_weights_are_exact(total):
    counts = sorted({0, 1, total // 3, total - total // 7, total})
    got = divergence.weights(np.array(counts), np.full(len(counts), total))
    assert got.tolist() == [1 + 10**9 * c // total for c in counts]
