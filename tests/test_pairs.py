"""The sentence-pair view and option-conditioned tables against plain Python."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graywether.functions import text as T
from graywether.operators import options, pairs

SCHEMA = "doc_id long, text string"


def fnv(raw, salt):
    h = T.FNV_OFFSET ^ salt
    for b in raw:
        h = ((h ^ (b + 32 if 65 <= b <= 90 else b)) * 1099511628211) % (1 << 64)
    return h


def tokens(text):
    out = []
    for piece in text.replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ").split(" "):
        while piece and not (piece[0].isascii() and piece[0].isalnum()):
            piece = piece[1:]
        while piece and not (piece[-1].isascii() and piece[-1].isalnum()):
            piece = piece[:-1]
        out += [piece] if piece else []
    return out


def chain(words, salt, pair_salt):
    hashes = [fnv(w.encode(), salt) for w in words]
    return hashes + [fnv(a.to_bytes(8, "little") + b.to_bytes(8, "little"), pair_salt) for a, b in zip(hashes, hashes[1:])]


def events(parts, text):
    """Buckets with counts of a text whose fields are known."""
    if len(parts) < 2:
        return Counter(h % T.BUCKETS for h in chain(tokens(text), T.WORD_SALT, T.BIGRAM_SALT))
    context, last = [w for p in parts[:-1] for w in tokens(p)], tokens(parts[-1])
    seen = {fnv(w.encode(), pairs.SALT_NEW) % 4096 for w in context}
    new = [fnv(w.encode(), pairs.SALT_NEW) for w in last]
    old = sum(h % 4096 in seen for h in new)
    negated = 2 * any(map(pairs.negates, context)) + any(map(pairs.negates, last))
    marks = [f"cov{old * 5 // max(len(last), 1)}", f"len{min(len(last) // 4, 5)}", f"neg{negated}"]
    hashes = chain(last, pairs.SALT_LAST, pairs.SALT_LAST_PAIR) + [h for h in new if h % 4096 not in seen] + [fnv(m.encode(), pairs.SALT_MARK) for m in marks]
    return Counter(h % T.BUCKETS for h in hashes)


CASES = [
    ("A man is not outside.\nThe man is outside!", ["A man is not outside.", "The man is outside!"]),
    ("one\n\n\ntwo\n", ["one", "two"]),
    ("only one line of words", ["only one line of words"]),
    ("", []),
    ("\n\n", []),
    ("...\n---", ["...", "---"]),
    ('{"premise": "He didn\'t go", "n": 3, "hypothesis":"He \\"went\\" home"}', ["He didn't go", 'He \\"went\\" home']),
    ('{"a": "", "b": "only value"}', ["only value"]),
    ('{"a": "x", "b": "not closed', ["x", "not closed"]),
    ('{"a": "x", "b": "ends\\', ["x", "ends\\"]),
    ("{not json\nbut lines}", []),
    ("\n".join(f"line {i}" for i in range(8)), [f"line {i}" for i in range(8)]),
    ("\n".join(f"line {i}" for i in range(12)), [f"line {i}" for i in range(6)] + ["\n".join(f"line {i}" for i in range(6, 12)), "line 7"]),
    ("naïve Łódź\né Łódź naïve", ["naïve Łódź", "é Łódź naïve"]),
    ("w " * 30000 + "\n" + "w v " * 30000, ["w " * 30000, "w v " * 30000]),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_fields(at):
    text, parts = CASES[at]
    assert pairs.fields(text) == parts


def test_words_and_negations():
    for text, _ in CASES:
        assert pairs.words(text) == tokens(text)
    assert pairs.words("(a--b) !! c'") == ["a--b", "c"]
    assert [pairs.negates(w) for w in ("NOT", "can't", 'can"T', "n't", "CAN'T", "dont", "scarcely")] == [True, True, True, False, False, True, False]


def test_events_equal_plain_python(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)] + [(None, None), (None, "a\nb"), (3, "a\nb")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA + ", toks string")
    found = pairs.view_rows(docs, ["doc_id"], "pair").collect()
    want = Counter()
    for (k, text), parts in zip(rows, [p for _, p in CASES] + [[], ["a", "b"], ["a", "b"]]):
        want[k, tuple(sorted(events(parts, text or "").items()))] += 1
    assert Counter((r.doc_id, tuple(zip(r.toks, r.times))) for r in found) == want
    assert all(r.n == sum(r.times) for r in found)


def test_json_and_lines_give_the_same_events(spark):
    premise, hypothesis = "the old dog never sleeps", "the dog sleeps all day"
    states = [f"{premise}\n{hypothesis}", json.dumps({"premise": premise, "n": 1, "hypothesis": hypothesis}), json.dumps({"p": premise, "h": hypothesis}, separators=(",", ":"))]
    rows = pairs.view_rows(spark.createDataFrame(list(enumerate(states)), SCHEMA), ["doc_id"], "pair").collect()
    assert len({(tuple(r.toks), tuple(r.times)) for r in rows}) == 1


def test_views(spark):
    docs = spark.createDataFrame([(1, "a b\nc")], SCHEMA)
    assert pairs.view_rows(docs, ["doc_id"], "bag").first().n == 5
    assert pairs.view_rows(docs.limit(0), ["doc_id"], "pair").count() == 0
    with pytest.raises(ValueError):
        pairs.view_rows(docs, ["doc_id"], "lines")


def scored(spark, rows):
    """Rows (doc_id, qid, option, fold, options, tokens) scored; tokens are buckets."""
    data = [(i, q, o, f, opts, sorted(set(t)), [t.count(x) for x in sorted(set(t))], len(t)) for i, q, o, f, opts, t in rows]
    df = spark.createDataFrame(data, "doc_id long, qid string, option string, fold int, options array<string>, toks array<int>, times array<int>, n long")
    found = options.scores(df.withColumnRenamed("option", "gold"), options.fold_counts(df), ["doc_id"], 2).withColumn("pick", F.lit(None))
    return {r.doc_id: r for r in found.withColumn("pick", options.picks(found)).collect()}


def plain(rows):
    out = {}
    for i, q, _, fold, opts, toks in rows:
        counts, seen = defaultdict(Counter), set()
        for _, other, option, f, _, t in rows:
            if f != fold and other is not None and option is not None:
                seen |= set(t)
                if other == q:
                    counts[option].update(t)
        mass, total = len(seen), sum((c for c in counts.values()), Counter())
        scores = []
        for o in opts:
            if o not in counts or not counts[o]:
                scores.append(None)
                continue
            size, every, a = sum(counts[o].values()), sum(total.values()), mass / T.BUCKETS
            scores.append(sum(math.log2((counts[o][t] + a) / (size + mass)) - math.log2((total[t] - counts[o][t] + a) / (every - size + mass)) for t in toks if total[t]))
        terms = []
        for at, s in enumerate(scores):
            others = [x for j, x in enumerate(scores) if j != at and x is not None]
            terms.append(None if s is None else 0.5 if not toks else 1 / (1 + math.exp(-(s - (max(others) if others else 0)) / len(toks))))
        out[i] = scores, terms
    return out


@pytest.mark.parametrize("most", [options.MOST_CELLS, 0])
def test_option_scores_equal_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(options, "MOST_CELLS", most)  # 0: by joins
    rows = [
        (1, "q", "a", 0, ["a", "b", "c"], [1, 1, 2]),
        (2, "q", "b", 1, ["a", "b", "c"], [2, 3]),
        (3, "q", "a", 1, ["b", "a"], [1, 4]),
        (4, "q", "b", 0, ["a", "b"], []),  # no events
        (5, "r", "a", 0, ["a"], [1, 2]),  # the only option of its question
        (6, "r", "a", 1, ["a", "z"], [1, 5]),
        (7, "s", "a", 0, ["a", "b"], [1]),  # a question that no other fold has
        (8, None, "a", 0, ["a"], [1]),
        (9, "q", None, 1, [], [9]),
        (10, "q", "c", 1, ["c", None], [7, 7, 7]),
    ]
    found, want = scored(spark, rows), plain(rows)
    assert sorted(found) == sorted(want)
    for i, (scores, terms) in want.items():
        assert found[i].scores == [None if s is None else pytest.approx(s) for s in scores], i
        assert found[i].terms == [None if t is None else pytest.approx(t) for t in terms], i
    assert found[7].scores == [None, None] and found[7].pick is None and found[8].pick is None and found[9].pick is None
    assert found[5].pick == "a" and found[4].terms == [0.5, 0.5] and found[4].pick == "a"


@pytest.mark.parametrize("most", [options.MOST_CELLS, -1])
def test_no_rows_to_score(spark, monkeypatch, most):
    monkeypatch.setattr(options, "MOST_CELLS", most)
    rows = spark.createDataFrame([], "doc_id long, qid string, option string, fold int, options array<string>, toks array<int>, times array<int>, n long")
    assert options.scores(rows, options.fold_counts(rows), ["doc_id"], 2).count() == 0


@pytest.mark.parametrize("most_of_one", [options.MOST_OF_ONE, 5, 0])
def test_option_scores_by_parts_equal_plain_python(spark, monkeypatch, most_of_one):
    monkeypatch.setattr(options, "MOST_CELLS", 0)
    monkeypatch.setattr(options, "MOST_OF_ONE", most_of_one)  # 5: one question by parts, one by joins; 0: all by joins
    monkeypatch.setattr(options, "PART_EVENTS", 40)  # several parts a question
    rng = random.Random(2)
    rows = [(i, "q", "abc"[i % 3], rng.randrange(3) % 2, ["a", "b", "z"], [rng.randrange(30) for _ in range(i % 9)]) for i in range(60)]
    rows += [(60, "r", "a", 0, ["a"], [1]), (61, "r", "b", 1, ["b", "a"], [1, 2]), (62, None, "a", 0, ["a"], [1]), (63, "s", None, 1, [], [9])]
    found, want = scored(spark, rows), plain(rows)
    assert sorted(found) == sorted(want)
    for i, (scores, terms) in want.items():
        assert found[i].scores == [None if s is None else pytest.approx(s) for s in scores], i
        assert found[i].terms == [None if t is None else pytest.approx(t) for t in terms], i


def test_option_scores_shuffle_no_event_on_its_own(spark, monkeypatch):
    monkeypatch.setattr(options, "MOST_CELLS", 0)
    rows = [(i, "q", "ab"[i % 2], i % 2, ["a", "b"], [i % 5, 7]) for i in range(20)]
    data = [(i, q, o, f, opts, sorted(set(t)), [1] * len(set(t)), 2) for i, q, o, f, opts, t in rows]
    df = spark.createDataFrame(data, "doc_id long, qid string, option string, fold int, options array<string>, toks array<int>, times array<int>, n long")
    counts = options.fold_counts(df)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (counts, options.scores(df, counts, ["doc_id"], 2))]
    exchanges = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("tok#" in line for line in exchanges)


@pytest.mark.parametrize("held", [options.HELD_CELLS, 16])
def test_fold_counts_equal_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(options, "HELD_CELLS", held)  # 16: sums are sent on several times
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice(["q", "r", None]), rng.choice(["a", "b", None]), [(t, rng.randrange(1, 9)) for t in sorted(rng.sample(range(12), i % 6))]) for i in range(80)]
    want = Counter()
    for fold, qid, option, cells in rows:
        for tok, t in cells if qid and option else []:
            want[fold, qid, option, tok] += t
    data = [(f, q, o, [t for t, _ in c], [n for _, n in c]) for f, q, o, c in rows]
    df = spark.createDataFrame(data, "fold int, qid string, option string, toks array<int>, times array<int>").repartition(2)
    found = options.fold_counts(df)
    assert found.columns == ["fold", "qid", "option", "tok", "n_in"]
    assert {(r.fold, r.qid, r.option, r.tok): r.n_in for r in found.collect()} == want and found.count() == len(want)
