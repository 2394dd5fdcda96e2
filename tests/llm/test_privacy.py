import hashlib
import re
import time

import pytest

from graywether.llm import privacy
from graywether.llm.queries import QUERIES

from .fixtures import ROWS, clashing, empty, odd


def brute(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


TEXTS = [
    "a@b.c d@e f..g@h-i.jk@l.mn %+@x.y@z.w a@b.c@d.e @a.b a@@b.c",
    "x" * 300 + "@y.zz " + "n." * 100 + "q@r.st.u. é@é.com éa@b.co-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255 1..2.3.4 9.9.9",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1 5500 0000 0000 0004",
    "+1 (743) 555-3824 +12345678 +1 +1 555 +1(2)3.4-5 6 7 8 9 ++49 30 1234567 +123456789012345678",
    "\U0001f600 mail me: \U0001f600a@b.cd, ٣٤ 1٣.1.1.1",
]


def test_base_spans_against_plain_patterns(spark, sf_dir):
    texts = TEXTS + [r[1] or "" for r in ROWS]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        assert privacy.base_spans(text) == brute(text), text[:100]


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000 + " @", "1" * 300_000, "1." * 300_000, "+1" + " " * 300_000, "a@" * 200_000):
        privacy.base_spans(text)


def test_terms_beside_an_entity_disclose_it(spark):
    rows = [(i, f"Doc {i} number {i * 7} says Zebulon wrote, {'xyzzy'[i % 5] * 5} from zed@mail.example.org today and more {i}") for i in range(6)]
    rows += [(100 + i, f"wrote number {i} says from today and more about nothing in particular") for i in range(60)]
    rows += [(200, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.report(df).collect()}
    text = rows[0][1]
    at = text.index("Zebulon")
    assert f"term:{at}:{at + 7}" in got[0].spans and got[0].n_terms == 1 and got[200].spans == got[0].spans
    assert all(got[100 + i].spans == "" for i in range(60))
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and "says" in clean[0] and clean[100] == rows[6][1]


def test_copies_count_alike_for_pairs_entities_and_terms(spark):
    texts = [f"number {i} as Zebulon wrote {c * 4} from zed@mail.example.org today" for i, c in enumerate("abc")]
    rows = [(1000 * i + j, t) for i, t in enumerate(texts) for j in range(400)] + [(None, texts[0])] * 40
    rows += [(9000 + i, f"number wrote from today {i}") for i in range(8000)]
    rows += [(5000 + i, "zed@mail.example.org") for i in range(10)]  # no term beside it
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = privacy.report(df).where("doc_id = 0").first()
    at = texts[0].index("Zebulon")
    assert f"term:{at}:{at + 7}" in out.spans


def test_pairs_of_any_support_are_decided(spark):
    signed = "kind regards, Zebulon <zed@mail.example.org> wrote this on behalf of everybody who reads the list and more"
    rows = [(0, signed)] + [(i, f"regards wrote this behalf everybody reads list more number {i}") for i in range(1, 2000)]
    rows += [(3000 + i, f"kind {i}") for i in range(2000)]
    got = {r.doc_id: r for r in privacy.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = signed.index("Zebulon")
    assert got[0].spans.endswith(f",term:{at}:{at + 7}") and got[0].n_terms == 1


def test_overlaps_are_replaced_once():
    assert privacy.replaced("call +1 743 555 3824 now", [(0, 4, False), (21, 24, True)]) == "[TERM] [PHONE] "
    card = "+4111111111111111"
    assert privacy.replaced(card, []) in ("+[CARD]", "[PHONE]")


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_privacy"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in privacy.KINDS]


@pytest.mark.parametrize("make", [odd, empty, lambda s: clashing(s, "row_key", "base", "beside", "terms", "_terms_")])
def test_odd_rows(spark, make):
    df = make(spark)
    assert privacy.report(df).count() == df.count()
    out = privacy.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    key = lambda r: str((r.doc_id, r.text))
    assert sorted(map(key, out.collect())) == sorted(map(key, df.collect()))


def test_many_spans_of_one_text_take_linear_time():
    text = " ".join(f"name{i % 7} person{i}@mail.org wrote" for i in range(20_000))
    start = time.perf_counter()
    spans = privacy.base_spans(text)
    found = privacy.candidates(text, spans)
    assert len(spans) == 20_000 and len(found) > 20_000 and time.perf_counter() - start < 5
