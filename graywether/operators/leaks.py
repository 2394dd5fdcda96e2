"""Leak scans: does a text stand in a reference?"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.operators.events import pieces
from graywether.sources.steps import Workspace

_ODD = 0x9E3779B97F4A7C15
#: Bytes of texts that are worked on at once, beyond a single longer text.
_BYTES = 1 << 21
_BLANKS = bytes.maketrans(b"\t\n\x0b\f\r", b"     ")
_KEPT = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_OTHER = bytes(b for b in range(256) if b not in _KEPT)


def normal_form(text: bytes) -> bytes:
    """functions.text.leak_normal of a UTF-8 text. Beyond A-Z only U+0130 and U+212A have a lower case that holds a letter of a-z."""
    if not text.isascii():
        text = text.replace(b"\xc4\xb0", b"i").replace(b"\xe2\x84\xaa", b"k")
    text = text.translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.translate(_LOWER, _OTHER).strip(b" ")


def digests(rows: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry, digest: 128 bits of each text's normal form, so that no text is shuffled; null for a null text."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(carry), _BYTES):
            texts = (t.as_py() for t in batch.column(len(carry)).cast(pa.large_binary()))
            found = [None if t is None else hashlib.blake2b(normal_form(t), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.binary())], names=[*carry, "digest"])

    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return rows.select(*carry, text).mapInArrow(run, f"{carried}, digest binary")


def exact_twins(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """query_id, twin_id: the first reference row with the same normal form (queries and reference: id, text). Normal forms are
    worked out once for each side, once in all if both are the same DataFrame, and meet as digests."""
    ws = Workspace(queries.sparkSession, "twins")
    ref = ws.save(digests(reference, ["id"]), "reference")
    asked = ref if queries is reference else digests(queries, ["id"])
    first = ref.where("digest is not null").groupBy("digest").agg(F.min("id").alias("twin_id"))
    return asked.select(F.col("id").alias("query_id"), "digest").join(first, "digest").select("query_id", "twin_id")


def gram_hashes(text: bytes, k: int) -> np.ndarray:
    """Distinct hashes of the k-grams of an ASCII text; of the whole text if it is shorter, none if it is empty."""
    data = np.frombuffer(text, dtype=np.uint8)
    n, width = max(len(data) - k + 1, min(len(data), 1)), min(k, len(data))
    h = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ data[j : j + n]) * np.uint64(_ODD)
        h ^= h >> np.uint64(29)
    return np.unique(h).view(np.int64)


def grams(df: DataFrame, k: int, name: str) -> DataFrame:
    """name, gram: the distinct k-grams of each text's normal form (df: id, text), as 64-bit hashes.

    The normal form is ASCII, so a gram is k bytes. A null text has none.
    """
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _BYTES):
            found = [gram_hashes(normal_form(t.as_py() or b""), k) for t in batch.column(1).cast(pa.large_binary())]
            owner = np.repeat(np.arange(len(found)), [len(g) for g in found])
            flat = np.concatenate(found) if found else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(flat)], names=[name, "gram"])

    return df.select("id", "text").mapInArrow(run, f"`{name}` {kind}, gram long")


def near_twins(queries: DataFrame, reference: DataFrame, k: int, rare_cap: int, least: float) -> DataFrame:
    """query_id, ref_id, shared, contained: pairs that share `least` of the reference's rare k-grams or more.

    An inverted index: grams that rare_cap or more reference rows hold are left out of it, so no gram has a long
    list; pairs are counted where they meet. The index is as large as the reference; Spark sends it to all tasks if it
    is below its broadcast threshold, so that the queries' grams aren't shuffled.
    """
    posts = grams(reference, k, "ref_id")
    rare = posts.groupBy("gram").agg(F.count("*").alias("held")).where(F.col("held") < rare_cap).select("gram")
    posts = posts.join(rare, "gram")
    size = posts.groupBy("ref_id").agg(F.count("*").alias("size"))
    met = grams(queries, k, "query_id").join(posts, "gram").groupBy("query_id", "ref_id").agg(F.count("*").alias("shared"))
    share = F.col("shared") / F.col("size")
    return met.join(size, "ref_id").where(share >= least).select("query_id", "ref_id", "shared", share.alias("contained"))


@dataclass(frozen=True)
class Law:
    """When a text is near another: grams of k characters, a Jaccard similarity of `near`, the `top` candidates that share
    most grams held by fewer than `rare_cap` reference texts. Fixed values of the published scan."""

    k: int = 4
    near: float = 0.8
    rare_cap: int = 200
    top: int = 5


#: Grams of a part, about, and pairs of texts that a task lists at once.
_PART = 2_000_000
_PAIRS = 4_000_000


def _set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct k-grams of a normal form as hashes; the empty form has one gram, itself."""
    return gram_hashes(text, k) if text else np.zeros(1, np.int64)


def normals(rows: DataFrame) -> DataFrame:
    """id, normal: each text's normal form, empty for a null text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _BYTES):
            found = [normal_form(t.as_py() or b"").decode() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "normal"])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, normal string")


def _dealt(texts: DataFrame, k: int, parts: int, ref: bool) -> DataFrame:
    """part, ref, id, xs: a text's grams in each part, as one row (texts: id long, normal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _BYTES):
            found = [_set(t.as_py(), k) for t in batch.column(1).cast(pa.large_binary())]
            who = np.repeat(np.arange(len(found)), [len(g) for g in found])
            x = np.concatenate(found)
            part = (x.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
            order = np.lexsort((part, who))
            who, part, x = who[order], part[order], x[order]
            first = np.append(True, (who[1:] != who[:-1]) | (part[1:] != part[:-1]))
            starts = np.flatnonzero(first)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts].astype(np.int32)), pa.array([ref] * len(starts), pa.bool_()), batch.column(0).take(pa.array(who[starts])), lists], names=["part", "ref", "id", "xs"]
            )

    return texts.select("id", "normal").mapInArrow(run, "part int, ref boolean, id long, xs array<long>")


def _meetings(rare_cap: int) -> Callable[[pa.Table], pa.Table]:
    """For a part's texts: id, refs, counts, how many of the part's rare grams a query shares with each reference text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ref = np.asarray(table["ref"])
        ids, n = np.asarray(table["id"]), np.asarray(pc.list_value_length(table["xs"]), dtype=np.int64)
        owner, x = np.repeat(np.arange(len(n)), n), np.asarray(pc.list_flatten(table["xs"]))
        mine = ref[owner]
        order = np.argsort(x[mine], kind="stable")
        posts, holders = x[mine][order], owner[mine][order]
        low, high = (np.searchsorted(posts, x[~mine], side=side) for side in ("left", "right"))
        asked, met = owner[~mine], high - low
        met = np.where(met < rare_cap, met, 0)
        keep = met > 0
        asked, low, met = asked[keep], low[keep], met[keep]
        edges = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.array([], dtype=np.int64)  # a query's first gram
        upto = np.append(0, np.cumsum(met))
        out, at = [], 0
        while at < len(edges):
            stop = max(at + 1, int(np.searchsorted(upto[edges], upto[edges[at]] + _PAIRS, side="right")) - 1)
            a, b = edges[at], edges[stop] if stop < len(edges) else len(asked)
            m = met[a:b]
            place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[a:b], m)
            pairs, counts = np.unique(np.repeat(asked[a:b], m) * len(n) + holders[place], return_counts=True)
            query, other = pairs // len(n), pairs % len(n)
            starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            ends = pa.array(np.append(starts, len(query)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids[other], counts.astype(np.int32))]
            out.append(pa.table({"id": pa.array(ids[query[starts]]), "refs": lists[0], "counts": lists[1]}))
            at = stop
        kind = pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
        return pa.concat_tables(out) if out else kind.empty_table()

    return run


def _likeness(pairs: DataFrame, k: int) -> DataFrame:
    """id, ref_id, place, jaccard of pairs (id, ref_id, place, a, b: normal forms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4, _BYTES):
            found, last, grams = [], None, np.array([], dtype=np.int64)
            for a, b in zip(*(batch.column(i).cast(pa.large_binary()).to_pylist() for i in (3, 4))):
                if a != last:
                    last, grams = a, _set(a, k)
                other = _set(b, k)
                both = len(np.intersect1d(grams, other, assume_unique=True))
                found.append(both / (len(grams) + len(other) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], names=["id", "ref_id", "place", "jaccard"])

    return pairs.select("id", "ref_id", "place", "a", "b").mapInArrow(run, "id long, ref_id long, place int, jaccard double")


def classify(queries: DataFrame, reference: DataFrame, law: Law = Law()) -> DataFrame:
    """id, kind, ref_id, jaccard for each row of queries (id, text): `exact` with the first reference row of the same normal
    form, `near` with the best of the candidates if its Jaccard similarity reaches law.near, else `clean` (no ref_id);
    jaccard is the best seen, 0 without a candidate and 1 for an exact twin. Ids are whole numbers.

    Rows of one normal form, on either side, are one text until the end. Grams are dealt to parts by hash, a text's in a part as
    one row; a part sees all that hold a gram, leaves out those of rare_cap or more reference texts and lists for a query
    the texts it meets, with counts, as one row. `top` a query are kept; what is joined for them is normal forms, and
    gram sets are made again in the task. Null texts have the empty normal form.
    """
    ws = Workspace(queries.sparkSession, "leaks")
    asked = ws.save(normals(queries), "asked")
    ref = ws.save(normals(reference).groupBy("normal").agg(F.min("id").cast("long").alias("id")), "reference")
    exact = ref.select("normal", F.col("id").alias("ref_id"))
    texts = asked.select("normal").distinct().join(exact, "normal", "left_anti")
    left = ws.save(texts.select(F.xxhash64("normal").alias("id"), "normal"), "left")

    letters = left.select("normal").union(ref.select("normal")).agg(F.sum(F.length("normal")).alias("n")).first().n or 0
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // _PART + 1)
    grams = _dealt(ref, law.k, parts, True).union(_dealt(left, law.k, parts, False))
    met = grams.groupBy("part").applyInArrow(_meetings(law.rare_cap), "id long, refs array<long>, counts array<int>")
    # dealt by query as packed rows; what follows stays in the task
    met = met.repartition(4 * parts, "id").select("id", F.inline(F.arrays_zip(F.col("refs").alias("ref_id"), F.col("counts").alias("n"))))
    shared = met.groupBy("id", "ref_id").agg(F.sum("n").alias("shared"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("shared"), "ref_id"))
    best = ws.save(shared.withColumn("place", place).where(F.col("place") <= law.top).select("id", "ref_id", "place"), "best")
    sets = best.join(ref.select(F.col("id").alias("ref_id"), F.col("normal").alias("b")), "ref_id").join(left.select("id", F.col("normal").alias("a")), "id")
    top = _likeness(sets, law.k).groupBy("id").agg(F.min(F.struct((-F.col("jaccard")).alias("o"), "place", "ref_id")).alias("t"))
    near = left.join(ws.save(top, "top"), "id").select("normal", F.col("t.ref_id").alias("near_id"), (-F.col("t.o")).alias("jaccard"))
    known = exact.select("normal", "ref_id", F.lit(None).cast("long").alias("near_id"), F.lit(1.0).alias("jaccard"))
    known = known.union(near.select("normal", F.lit(None).cast("long"), "near_id", "jaccard"))
    found = asked.join(known, "normal", "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    is_near = F.col("jaccard") >= law.near
    kind = F.when(F.col("ref_id").isNotNull(), "exact").when(is_near & F.col("near_id").isNotNull(), "near").otherwise("clean")
    return found.select("id", kind.alias("kind"), F.coalesce("ref_id", F.when(is_near, F.col("near_id"))).alias("ref_id"), "jaccard")


def tallies(classes: DataFrame, queries: DataFrame, reference: DataFrame) -> DataFrame:
    """reference, query, exact, exact_label_conflict, near, near_scanned, near_same_label of classified queries; queries and
    reference have id and label. No row if either side is empty: nothing measured is no rate of zero."""
    own = classes.join(queries.select("id", "label"), "id").join(reference.select(F.col("id").alias("ref_id"), F.col("label").alias("ref_label")), "ref_id", "left")
    same = F.col("label").eqNullSafe(F.col("ref_label"))
    count = lambda c, name: F.count_if(c).alias(name)
    sums = own.agg(
        F.count("*").alias("query"),
        count(F.col("kind") == "exact", "exact"),
        count((F.col("kind") == "exact") & ~same, "exact_label_conflict"),
        count(F.col("kind") == "near", "near"),
        count(F.col("kind") != "exact", "near_scanned"),
        count((F.col("kind") == "near") & same, "near_same_label"),
    )
    size = reference.agg(F.count("*").alias("reference"))
    return size.crossJoin(F.broadcast(sums)).where("reference > 0 and query > 0")  # one row each
