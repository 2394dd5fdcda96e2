"""Audit of how far the sources of a language diverge in their words, by dense term-block matrices.

Terms are runs of ASCII letters and of all code points from U+0080, only A-Z lower-cased. A language keeps the terms
that MIN_DOCS of its documents have. Each (lang, source) group, and each language as a whole, gives a kept term the
weight p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)); two weights differ by floor((p - q)^2 / (p + q)).

The kept terms of a language are dealt by hash to blocks, its groups (where they are many) to blocks too. A tile is one
block of terms for one pair of blocks of groups: a dense numpy int64 matrix of groups by terms, in which all pairs of
groups are compared by broadcasting. A tile gives partial sums of its pairs, which Spark adds up, and for each group a
heap of its TOP most distinctive terms, which Spark merges. Terms of a block that no group of the tile has are one
column, weighted by their number. Blocks are sized from the language's counts of terms and groups, so a tile stays near
TILE cells however large the vocabulary. Everything is exact in 64 bits as long as N + 2 * V is below 9 * 10^15.

Null text, lang and source read as ''. Repeated rows are documents of their own; ids aren't looked at. A group without
terms (empty texts, a language without kept terms) has pairs too, of value 0 if V is 0, and no terms. A language with
one source has no pairs. An empty table gives no rows. Ties in value are ranked by item in UTF-8 order.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Cells (groups x terms) of a tile, groups of a block, and cells that one broadcast makes.
TILE = 1 << 17
GROUPS = 256
_BROADCAST = 1 << 21
#: Entries a task counts before it hands partial counts to Spark.
_COUNTED = 200_000

#: A-Z to a-z, other bytes that are no letters to blanks; bytes from 0x80 are parts of letters in UTF-8.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode().translate(_FOLD).split()


def weights(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for counts <= total, by long division in three digits of a thousand."""
    out, rest = np.divmod(counts, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        having: dict[tuple[str, str], Counter] = {}
        added = 0

        def out() -> pa.RecordBatch:
            keys = [k for k, c in times.items() for _ in c]
            found = [t for c in times.values() for t in c]
            docs = [having[k][t] for k, c in times.items() for t in c]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array(found, pa.binary()).cast(pa.string()),
                    pa.array([n for c in times.values() for n in c.values()], pa.int64()),
                    pa.array(docs, pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                found = terms(text.as_py())
                key = (lang.as_py(), source.as_py())
                count = times.setdefault(key, Counter())
                before = len(count)
                count.update(found)
                having.setdefault(key, Counter()).update(set(found))
                added += len(count) - before
                if added > _COUNTED:
                    yield out()
                    times, having, added = {}, {}, 0
        yield out()

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def compare(groups: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The rows of one tile: partial sums of its pairs (part `pair`, the lesser source first) and its groups' heaps.

    groups: source, block, total (N + 2 V), lang_total, n_terms (of the term block), a and b (the tile's two blocks).
    counts: source, term, n, n_lang.
    """
    sources = groups["source"].to_numpy(object)
    block, n_terms = groups["block"].to_numpy(), int(groups["n_terms"].iloc[0])
    a, b = int(groups["a"].iloc[0]), int(groups["b"].iloc[0])
    place = {s: i for i, s in enumerate(sources)}
    column, names = pd.factorize(counts["term"])
    seen = len(names)
    # a last column stands for the block's terms that no group here has
    dense = np.zeros((len(sources), seen + 1), np.int64)
    dense[counts["source"].map(place).to_numpy(np.int64), column] = counts["n"].to_numpy(np.int64)
    totals = np.maximum(groups["total"].to_numpy(np.int64), 1)
    p = weights(dense + 2, np.maximum(totals, 2)[:, None])
    times = np.ones(seen + 1, np.int64)
    times[seen] = n_terms - seen
    rows: list[tuple[str, str, str, int]] = []

    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    step = max(1, _BROADCAST // max(1, len(right) * (seen + 1)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        sums = (apart(p[some][:, None, :], p[right][None, :, :]) * times).sum(axis=2)
        for i, line in zip(some, sums):
            for j, value in zip(right, line):
                if a != b or sources[i] < sources[j]:
                    rows.append((sources[i], "pair", sources[j], int(value)))

    if a == b and seen:
        lang = np.zeros(seen, np.int64)
        lang[column] = counts["n_lang"].to_numpy(np.int64)
        q = weights(lang + 2, np.full(seen, max(int(groups["lang_total"].iloc[0]), 1), np.int64))
        raw = np.array([str(t).encode() for t in names], object)
        for i, source in enumerate(sources):
            mine = np.flatnonzero((dense[i, :seen] > 0) & (p[i, :seen] > q))
            value = apart(p[i, mine], q[mine])
            best = heapq.nsmallest(TOP, zip((-value).tolist(), raw[mine], names[mine]))
            rows += [(source, "term", str(term), -minus) for minus, _, term in best]
    return pd.DataFrame(rows, columns=["source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a group's language (part `pair`) and the group's TOP
    terms that it uses more than its language (part `term`), the most divergent first."""
    ws = Workspace(docs.sparkSession, "divergence")
    counts = ws.save(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")
    kept = ws.save(kept, "kept")
    used = ws.save(counts.drop("docs").join(kept, ["lang", "term"]), "used")

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    groups = ws.save(groups, "groups")
    shape = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    shape = shape.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all")), "lang", "left").fillna(0, ["v", "n_all"])
    shape = shape.select(
        "lang",
        "v",
        (F.col("n_all") + 2 * F.col("v")).alias("lang_total"),
        F.ceil(F.col("sources") / GROUPS).cast("int").alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("v") * F.least("sources", F.lit(2 * GROUPS)) / TILE)).cast("int").alias("term_blocks"),
    )
    shape = ws.save(shape, "shape")

    dealt = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    # a row of block g goes to the tiles (g, other): one for each other block, itself included
    others = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)).alias("other")
    tile = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    block_sizes = kept.join(shape, "lang").groupBy("lang", dealt("term", "term_blocks").alias("tb")).agg(F.count("*").alias("n_terms"))
    lines = groups.join(shape, "lang").withColumn("block", dealt("source", "group_blocks"))
    lines = lines.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).select("*", others)
    lines = lines.join(block_sizes, ["lang", "tb"], "left").fillna(0, ["n_terms"])
    lines = lines.select("lang", "tb", *tile, "source", "block", (F.col("n") + 2 * F.col("v")).alias("total"), "lang_total", "n_terms")
    cells = used.join(shape, "lang").withColumn("block", dealt("source", "group_blocks")).withColumn("tb", dealt("term", "term_blocks"))
    cells = cells.select("*", others).select("lang", "tb", *tile, "source", "term", "n", "n_lang")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = compare(left, right)
        rows.insert(0, "lang", key[0])
        return rows

    keys = ["lang", "tb", "a", "b"]
    found = lines.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(run, "lang string, source string, part string, item string, value long")
    found = ws.save(found, "tiles")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "part", "value", both).select("lang", "source", "part", "item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def oracle() -> str:
    """The rows of audit(documents) in DuckDB SQL."""
    p = "(1 + (1000000000::hugeint * ({c} + 2)) // ({n} + 2 * v))"
    f = "((p - q) * (p - q) // (p + q))"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    tok AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n_lang FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
    langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(n_lang), 0) AS n_all FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
    used AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN used USING (lang, source) GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, {p.format(c="coalesce(c, 0)", n="n")} AS p, {p.format(c="n_lang", n="n_all")} AS q_lang
        FROM groups g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
    apart AS (SELECT lang, a.source, b.source AS item, sum({f.replace("p", "a.p").replace("q", "b.p")}) AS value
        FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, {f.replace("q", "q_lang")}::bigint AS value FROM dense WHERE c > 0 AND p > q_lang)
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    QUALIFY part = 'pair' OR rank <= {TOP}
    """
