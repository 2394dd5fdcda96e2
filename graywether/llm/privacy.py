"""Information-theoretic sanitisation of personal data.

Base spans (emails, ip addresses, card and phone numbers) are the protected entities. The terms (words of letters) of the
whole document that holds an entity are beside it. Pairs, entities and
terms are all counted in documents, copies included. A term discloses an entity by the share of the entity's information it gives
away: PMI(entity; term) / IC(entity), which nears 1 if the term occurs nowhere else. The PMI takes the lower bound
(Wilson, Z standard errors) of the share of the term's documents that have it beside the entity, so pairs of any
support are decided, those with few documents more cautiously. Beside an entity that it discloses by DISCLOSE or more
a term is generalised, by REMOVE or more removed. Terms beside no entity are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

KINDS = ("email", "ip", "card", "phone")
DISCLOSE = 0.8
REMOVE = 0.95
#: Standard errors of the lower bound: 95 % on one side.
Z = 1.645
#: Terms a task counts before it hands partial counts to Spark.
_COUNTED = 200_000
_ROWS = 512

# Fixed patterns of the base spans. A run that can't start a match fails at its first character only.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @: all starts in the run before it fail or match together."""
    last, at = 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > last:  # back to the run's start, in steps
            low = max(last, start - step)
            outside = [m.end() for m in _NOT_LOCAL.finditer(text, low, start)]
            if outside:
                start = outside[-1]
                break
            start, step = low, step * 2
        end = at
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            last = end
        else:
            last = max(last, at + 1)
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """kind, start, end of all base spans, by kind as in KINDS, then by start (code points, end exclusive)."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def _entity(kind: str, value: str) -> int:
    plain = value.lower() if kind in ("email", "ip") else _NO_DIGIT.sub("", value)
    return int.from_bytes(xxhash.xxh64_digest(f"{kind}:{plain}".encode()), "big", signed=True)


def candidates(text: str, spans: list[Span]) -> list[dict]:
    """Terms of the whole text outside the base spans: term, start and end. None for a text without base spans."""
    found, last = [], 0
    for start, end in [*sorted((s, e) for _, s, e in spans), (len(text), len(text))] if spans else []:
        for m in _TERM.finditer(text, last, start) if start > last else ():
            found.append({"term": m[0].lower(), "start": m.start(), "end": m.end()})
        last = max(last, end)
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_key, n_email, n_ip, n_card, n_phone, base (spans, joined), entities (distinct) and beside (candidate terms) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "row_key", *(f"n_{k}" for k in KINDS), "base", "entities", "beside"]
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                counts: list[list[int]] = [[] for _ in KINDS]
                base, entities, beside = [], [], []
                for value in batch.column(2):
                    text = value.as_py() or ""
                    spans = base_spans(text)
                    for n, k in zip(counts, KINDS):
                        n.append(sum(s[0] == k for s in spans))
                    base.append(_joined(spans))
                    entities.append(list({_entity(k, text[s:e]) for k, s, e in spans}))
                    beside.append(candidates(text, spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(beside, pa.list_(_FOUND))],
                    names=names,
                )

    found = "array<struct<term: string, start: int, end: int>>"
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(key, row_key(F.col(key)).alias("row_key"), "text")
    return rows.mapInArrow(run, f"`{key}` {kind}, row_key long, {counted}, base string, entities array<long>, beside {found}")


def row_key(key: Column) -> Column:
    """Tells rows apart by key and text; rows alike in both have the same spans."""
    return F.xxhash64(key.cast("string"), F.col("text"))


def term_documents(docs: DataFrame) -> DataFrame:
    """term, n_docs: in how many documents each term occurs, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update({w.lower() for w in set(_TERM.findall(text.as_py() or ""))})
                if len(seen) > _COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def least_share(k: Column, n: Column) -> Column:
    """Wilson's lower bound of k / n: n / (n + Z * Z) where k is n."""
    p, z2 = k / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def pairs(found: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """row_key, entity, term, n_entity, n_docs: the pairs of each row, once a row, that may reach DISCLOSE.

    found: row_id, row_key, entities and beside of each row; terms: term, n_docs. A pair has n_docs and n_entity documents at most, which bounds
    its disclosure before pairs are counted: terms of too many documents are left out, and no other pair.
    """
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    owners = found.select("row_id", "row_key", F.explode("entities").alias("entity")).join(entities, "entity")
    words = found.select("row_id", F.explode(F.array_distinct(F.transform("beside", lambda x: x["term"]))).alias("term")).join(terms, "term")
    most = least_share(F.least("n_entity", "n_docs"), F.col("n_docs"))
    least = F.pow(F.col("n_entity") / F.lit(float(max(n_docs, 1))), F.lit(1 - DISCLOSE)) * (1 - 1e-9)  # room for rounding
    return owners.join(words, "row_id").where(most >= least).select("row_key", "entity", "term", "n_entity", "n_docs")


def disclosures(met: DataFrame, n_docs: int) -> DataFrame:
    """entity, term, disclosure for pairs that reach DISCLOSE (met: pairs, a row for each row that has one)."""
    # a row counts once for a pair or an entity, as it does for a term
    joined = met.groupBy("entity", "term", "n_entity", "n_docs").agg(F.count("*").alias("n_both"))
    total = F.lit(float(max(n_docs, 1)))
    ic = -F.log2(F.col("n_entity") / total)
    # a word that an email ends in is beside it but no word of the text, so it may have fewer documents
    given = -F.log2(least_share(F.least("n_both", "n_docs"), F.col("n_docs")))
    share = F.when(ic > 0, 1 - given / ic).otherwise(F.lit(0.0))
    return joined.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSE)


def analyse(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of find(docs), and row_key, terms: sorted distinct (start, end, remove) of disclosing terms.

    Null keys and texts are allowed (a null text has no spans); repeated rows have one entry in the second table.
    """
    ws = Workspace(docs.sparkSession, "privacy")
    rows = ws.save(find(docs, key).withColumn("row_id", F.monotonically_increasing_id()), "found")  # written: all uses see the same
    terms = rows.select(F.explode(F.transform("beside", lambda x: x["term"])).alias("term")).distinct()
    counts = ws.save(term_documents(docs).join(terms, "term", "left_semi"), "terms")
    n_docs = rows.count()
    met = ws.save(pairs(rows, counts, n_docs), "pairs")
    leaks = met.join(ws.save(disclosures(met, n_docs), "leaks"), ["entity", "term"]).groupBy("row_key", "term").agg(F.max("disclosure").alias("disclosure"))
    beside = rows.where(F.size("beside") > 0).select("row_key", F.inline("beside"))
    spans = beside.join(leaks, ["row_key", "term"]).groupBy("row_key", "start", "end").agg(F.max("disclosure").alias("d"))
    spans = spans.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("d") >= REMOVE).alias("remove")))).alias("terms"))
    return rows, ws.save(spans, "spans")


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, counts of base spans, base, spans (base ones, then terms as term:start:end) and n_terms of each row."""
    rows, spans = analyse(docs, key)
    joined = rows.drop("entities", "beside").join(spans, "row_key", "left")
    listed = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ",")
    both = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat_ws(",", "base", listed))
    return joined.select(
        key, *(f"n_{k}" for k in KINDS), "base", both.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms")
    )


def replaced(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """text with base spans as [KIND], removed terms as nothing, generalised ones as [NAME] or [TERM].

    Where spans of different kinds overlap, the one that starts first (then the longer) stands for all it touches.
    """
    spans = [(s, -e, f"[{k.upper()}]") for k, s, e in base_spans(text)]
    spans += [(s, -e, "" if remove else "[NAME]" if text[s].isupper() else "[TERM]") for s, e, remove in terms]
    out, last = [], 0
    for s, minus_e, mark in sorted(spans):
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, -minus_e)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with personal data in text replaced; other columns and rows without any stay as they are."""
    _, spans = analyse(docs, key)
    kept = docs.columns
    at = kept.index("text")
    # one row for each document with disclosing terms: joined by broadcast if small, by shuffle if not
    spans = spans.select(F.col("row_key").alias("__row_key"), F.col("terms").alias("__terms"))
    joined = docs.withColumn("__row_key", row_key(F.col(key))).join(spans, "__row_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                terms = batch.column(len(kept))
                texts = [
                    None if t is None else replaced(t, [(x["start"], x["end"], x["remove"]) for x in more or []])
                    for t, more in zip(batch.column(at).to_pylist(), terms.to_pylist())
                ]
                columns = list(batch.columns[: len(kept)])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*kept, "__terms").mapInArrow(run, schema)
