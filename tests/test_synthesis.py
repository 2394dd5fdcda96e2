import random
from collections import Counter

import pytest

from graywether.operators import synthesis as S

SCHEMA = "id long, label string, text string"


def affix(a, b):
    p = 0
    while p < min(len(a), len(b)) and a[p].lower() == b[p].lower():
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[len(a) - 1 - s].lower() == b[len(b) - 1 - s].lower():
        s += 1
    return p, s


def pairwise(rows, most):
    """Spans by frame (label, words before and after in lower case), from every pair of a label's texts; and the least text."""
    texts = {}
    for i, label, text in sorted(rows, key=lambda r: r[0]):
        words = tuple((text or "").split())
        if label is not None and words:
            texts.setdefault((label, words), i)
    out = {}
    every = list(texts.items())
    for (la, a), i in every:
        for (lb, b), j in every:
            if la != lb or i >= j:
                continue
            p, s = affix(a, b)
            sa, sb = a[p : len(a) - s], b[p : len(b) - s]
            if not sa or not sb or sa == sb or max(len(sa), len(sb)) > most:
                continue
            frame = (la, tuple(w.lower() for w in a[:p]), tuple(w.lower() for w in a[len(a) - s :]))
            for span, k in ((sa, i), (sb, j)):
                mine = out.setdefault(frame, {})
                mine[" ".join(span)] = min(k, mine.get(" ".join(span), k))
    return out, {i: words for (_, words), i in texts.items()}


def sample(seed, n=50):
    rng = random.Random(seed)
    words = ["book", "a", "table", "for", "two", "Two", "please", "now", "x"]
    rows = [(i, rng.choice("AB"), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(n)]
    return rows + [(900, None, "book a"), (901, "A", None), (902, "A", "  book\ta  "), (903, "A", "book a")]


@pytest.mark.parametrize("seed, most", [(1, 4), (2, 1), (3, 2)])
def test_slots_and_transplants_equal_the_pairwise_form(spark, seed, most):
    rows = sample(seed)
    found, texts = S.slots(spark.createDataFrame(rows, SCHEMA).repartition(4), most)
    want, words = pairwise(rows, most)
    local = {r.id: r.words for r in texts.collect()}
    assert {i: tuple(w) for i, w in local.items()} == words
    got = {}
    for r in found.collect():
        w = [x.lower() for x in local[r.id]]
        frame = (r.label, tuple(w[: r.p]), tuple(w[len(w) - r.s :]))
        got.setdefault(frame, {})[r.span] = r.id
    assert got == want

    for tried in (2, 48):
        made = S.transplants(found, texts, spark.createDataFrame(rows, SCHEMA), tried).collect()
        known = {" ".join((t or "").split()).lower() for _, _, t in rows}
        cands = {}
        for frame, own in want.items():
            src = min(own.values())
            spans = sorted({s for f, o in want.items() if f[0] == frame[0] for s in o} - set(own), key=str.encode)[:tried]
            for span in spans:
                w, p, s = words[src], len(frame[1]), len(frame[2])
                full = [*w[:p], *span.split(" "), *w[len(w) - s :]]
                text = " ".join(full)
                if text.lower() not in known:
                    entry = (frame[0], " ".join(w[:p]), " ".join(w[len(w) - s :]), span, text, src, p, len(span.split(" ")))
                    cands[text.lower()] = min(entry, cands.get(text.lower(), entry))
        assert sorted((r.label, r.text, r.src, r.p, r.span_words) for r in made) == sorted((e[0], e[4], e[5], e[6], e[7]) for e in cands.values())


def test_budget_extension_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    found, texts = S.slots(none)
    assert found.collect() == [] and S.transplants(found, texts, none).collect() == []
    cands = spark.createDataFrame([(x, f"{x}{i}") for x, n in (("a", 5), ("b", 2), ("c", 9)) for i in range(n)], "label string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 8.0)], "label string, weight double")
    got = [(r.label, r.text) for r in S.allotted(cands, weights, 9, 4).collect()]
    assert sorted(got) == [("a", "a0"), ("a", "a1"), ("a", "a2"), ("a", "a3"), ("b", "b0"), ("b", "b1"), ("c", "c0"), ("c", "c1"), ("c", "c2")]
    train = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (4, "q", "no")], SCHEMA)
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    extra = spark.createDataFrame([(1, "b", "e"), (2, "b", "f")], SCHEMA)
    rows = sorted(map(tuple, S.extended(train, extra, labels, 2, 1).collect()))
    assert rows == [("a", "x", "train"), ("a", "y", "train"), ("b", "e", "extra"), ("c", "c", "fallback")]


def test_only_texts_that_share_half_a_frame_list_frames(spark, monkeypatch):
    """Long texts of words of their own write no frames; one that differs from another in a word writes those of that word's side."""
    written = {}

    class Counted(S.Workspace):
        def save(self, df, table):
            out = super().save(df, table)
            written[table] = out.count()
            return out

    monkeypatch.setattr(S, "Workspace", Counted)
    rows = [(i, "A", " ".join(f"{i}w{k}" for k in range(60))) for i in range(40)]
    found, _ = S.slots(spark.createDataFrame(rows, SCHEMA))
    assert found.count() == 0 and written["shown"] == 0
    changed = rows[0][2].split(" ")
    changed[40] = "other"
    found, _ = S.slots(spark.createDataFrame([*rows, (99, "A", " ".join(changed))], SCHEMA))
    assert {(r.p, r.s, r.span) for r in found.collect()} == {(40, 19, "0w40"), (40, 19, "other")}
    assert 0 < written["shown"] < 2 * 4 * 60  # two texts' frames at most, not all 41


@pytest.mark.parametrize("most", [1, 2, 4])
def test_shared_halves_lose_no_frame(most):
    rng = random.Random(most)
    texts = {tuple(rng.choice("abcdA") for _ in range(rng.randrange(1, 9))) for _ in range(120)}
    shown, seen = {w: list(S.halves_of(list(w), most)) for w in texts}, {}
    for halves in shown.values():
        for x in halves:
            seen[x] = seen.get(x, 0) + 1
    kept, every = {}, {}
    for w in texts:
        live = frozenset(x[0] for x in shown[w] if seen[x] > 1)
        for out, halves in ((kept, live), (every, None)):
            for p, s, head, tail, *_ in S.frames_of(list(w), most, halves):
                out.setdefault((p, s, head, tail), []).append(w)
    twice = lambda d: {k: sorted(v) for k, v in d.items() if len(v) > 1}
    assert twice(kept) == twice(every)


@pytest.mark.parametrize("frames, spans", [(2, 3), (512, 2048)])
def test_every_frame_takes_every_other_span(spark, monkeypatch, frames, spans):
    """More spans than a frame was once tried with, in labels that share frames and words; texts that several frames make come once."""
    monkeypatch.setattr(S, "FRAMES", frames)
    monkeypatch.setattr(S, "SPANS", spans)
    rows = [*sample(5, 40), (70, "A", "two two two"), (71, "B", "two two two"), (72, "B", "Two x"), (73, "A", "two x"), (74, "A", "a two now x")]
    rows += [(100 + i, "A", f"call n{i} m{i} now") for i in range(60)] + [(200 + i, "B", f"N{i} m{i}") for i in range(3)]
    found, texts = S.slots(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, words = pairwise(rows, 4)
    for known in (rows, rows[:30]):
        lines = {" ".join((t or "").split()).lower() for _, _, t in known}
        cands = {}
        for frame, own in want.items():
            w, p, s = words[min(own.values())], len(frame[1]), len(frame[2])
            for span in {x for f, o in want.items() if f[0] == frame[0] for x in o} - set(own):
                text = " ".join([*w[:p], *span.split(" "), *w[len(w) - s :]])
                if text.lower() not in lines:
                    entry = (frame[0], " ".join(w[:p]), " ".join(w[len(w) - s :]), span, text, min(own.values()), p, len(span.split(" ")))
                    cands[text.lower()] = min(entry, cands.get(text.lower(), entry))
        made = S.transplants(found, texts, spark.createDataFrame(known, SCHEMA)).collect()
        assert sorted((r.label, r.text, r.src, r.p, r.span_words) for r in made) == sorted((e[0], e[4], e[5], e[6], e[7]) for e in cands.values())
        assert max(Counter((r.label, r.src, r.p, len(r.text.split()) - r.span_words) for r in made).values()) > S.MOST_TRIED
