"""Order MinHash fingerprints.

A text's k-mers (K words) are numbered by occurrence, so repeats count, and hashed to points of a ring. A fingerprint
has SKETCHES entries; each has its own order of the numbered k-mers, the ring read from the entry's start, and takes
the ELEMENTS = 2 least, puts them in text order and hashes the pair. So an entry agrees between two texts only if the
same k-mers are least and stand in the same order: likeness falls with edit distance, also where a text's parts only
change places.

All of it is DataFrame functions. Rows are dealt once, by ranges of doc_id, and everything after (the next
document, occurrence numbers, entries) happens inside those ranges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import words

K = 3
SKETCHES = 64
ELEMENTS = 2
#: Documents in a range, and most ranges; ranges are found by quantiles of doc_id.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 16
#: An entry of a text without k-mers.
EMPTY = "0000"
#: A numbered k-mer is one long: its point on the ring, and its place in the text in the low bits.
_PLACE = 25
_ARC = 63 - 6  # bits within one of the SKETCHES = 2 ** 6 arcs


@dataclass(frozen=True)
class Ranges:
    """Parts of the documents in order of (doc_id, hash of the text), nulls last.

    starts are doc_ids, ascending; range i has all doc_ids from starts[i] to below the next, and the last range the
    nulls. Part offsets[i] is its first. If its starting id has many rows, those are dealt by hash to all its parts but
    the last.
    """

    starts: list[int]
    offsets: list[int]
    parts: int


def find_ranges(docs: DataFrame) -> Ranges:
    """Ranges of about RANGE_ROWS rows, by quantiles of doc_id; ids (and the null) with many rows have several parts."""
    seen = docs.agg(F.count("*").alias("all"), F.count("doc_id").alias("n"), F.min("doc_id").alias("low")).first()
    ranges = min(MOST_RANGES, math.ceil(seen.n / RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] if shares else []
    rows = max(2 * RANGE_ROWS, math.ceil(2 * seen.all / MOST_RANGES))  # MOST_RANGES / 2 ids at most have more
    many = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > rows).collect()}
    starts = sorted({seen.low, *cuts, *(i for i in many if i is not None)}) if seen.n else []
    offsets, at = [], 0
    for i in [*starts, None]:
        offsets.append(at)
        at += math.ceil(many[i] / rows) + 1 if i in many else 1
    return Ranges(starts, offsets, at)


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range of a key: how many bounds are at most key, less one; in two steps for many bounds."""
    step = max(1, math.isqrt(len(bounds)))
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_most(_longs(bounds[::step])) - 1
    fine = at_most(F.slice(_longs(bounds), coarse * step + 1, F.lit(step)))
    return coarse * step + fine - 1


def part_of(key: Column, text_hash: Column, ranges: Ranges) -> Column:
    """The part of a row."""
    own = F.when(key.isNull() | F.lit(not ranges.starts), F.lit(len(ranges.starts))).otherwise(_range_of(key, ranges.starts or [0]))
    first = F.element_at(_longs(ranges.offsets), own.cast("int") + 1)
    last = F.element_at(_longs([*ranges.offsets[1:], ranges.parts]), own.cast("int") + 1) - 1
    starting = key.isNull() | F.array_contains(_longs(ranges.starts or [0]), key)
    share = F.shiftrightunsigned(text_hash, 33) / F.lit(float(1 << 31))  # of all hashes, from 0 to below 1
    # unsigned order of hashes is that of share
    sub = F.when((last > first) & starting, F.floor(share * (last - first))).otherwise(last - first)
    return (first + sub).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """part, row, guest, doc_id, text and next_text; a part holds a range of rows by (doc_id, hash of text) in order.

    Each part's first row is a guest at the end of the part before (the first of all in the last), so every document
    finds its next in its own part. Null doc_ids come last; ties of doc_id go by the text's hash, then by text, so an
    id (or the null) that many rows share is spread over parts. Only rows alike in id and text stay together.
    """
    ranges = find_ranges(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    place = F.struct(F.shiftrightunsigned("h", 33).alias("s"), "h")
    rows = rows.withColumn("own", part_of(F.col("doc_id"), F.col("h"), ranges))
    # one row for each part: its first row's id and hash
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), place.alias("p"))).alias("m")
    heads = sorted((r.own, r.m.i, r.m.p.h) for r in rows.groupBy("own").agg(least).collect())
    before = {own: heads[i - 1][0] for i, (own, _, _) in enumerate(heads)}
    found = {own: (i, h) for own, i, h in heads}
    of = lambda value: F.element_at(_longs([value(p) for p in range(ranges.parts)]), F.col("own") + 1)
    null = of(lambda p: int(p in found and found[p][0] is None)) == 1
    same = F.when(F.col("doc_id").isNull(), null).otherwise(~null & (F.col("doc_id") == of(lambda p: found.get(p, (0, 0))[0] or 0)))
    head = same & (F.col("h") == of(lambda p: found.get(p, (0, 0))[1]))
    home = F.struct(F.col("own").alias("part"), F.lit(0).alias("guest"))
    visit = F.struct(of(lambda p: before.get(p, 0)).cast("int").alias("part"), F.lit(1).alias("guest"))
    rows = rows.select(F.inline(F.when(head, F.array(home, visit)).otherwise(F.array(home))), "doc_id", "h", "text")
    rows = rows.repartitionById(ranges.parts, "part")
    order = "over (partition by part order by guest, doc_id nulls last, shiftrightunsigned(h, 33), h, text)"
    return rows.select(
        "part",
        F.expr(f"row_number() {order}").alias("row"),
        "guest",
        "doc_id",
        "text",
        F.coalesce(F.expr(f"lead(text) {order}"), F.lit("")).alias("next_text"),
    )


def edited(text: Column, next_text: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by as many of next_text's first, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Columns that are worked out once per row, not where they are used."""
    one = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.inline(F.array(one)))


def numbered_kmers(texts: DataFrame) -> DataFrame:
    """part, row, side and kmer (point and place) of texts (part, row, side, text), dealt by part.

    A text of fewer than K words has one k-mer of all its words, one without words has none.
    """
    hashed = texts.select("part", "row", "side", F.explode(F.array(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))).alias("h"))
    count = F.greatest(F.size("h") - (K - 1), F.least(F.size("h"), F.lit(1)))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    kmers = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(K)]))
    rows = hashed.select("part", "row", "side", F.posexplode(kmers).alias("place", "kmer"))
    number = F.expr("row_number() over (partition by part, row, side, kmer order by place)")
    point = F.shiftrightunsigned(F.xxhash64("kmer", number), _PLACE + 1)
    place = F.col("place").cast("long").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.select("part", "row", "side", F.shiftleft(point, _PLACE).bitwiseOR(place).alias("kmer"))


def arcs(kmers: Column) -> Column:
    """The two least k-mers (ascending array) of each arc of the ring, ascending."""
    arc = lambda x: F.shiftright(x, _ARC)
    return F.filter(kmers, lambda x, i: (i < ELEMENTS) | (arc(x) != arc(F.get(kmers, i - ELEMENTS))))


def entries(least: Column, first: Column) -> Column:
    """SKETCHES codes of four digits: of the k-mer from the entry's arc on and the one after it, in text order.

    least: arcs(kmers); first: for each arc the place in least (from 1) of its first k-mer, null if it has none.
    """
    place, point = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)), lambda x: F.shiftright(x, _PLACE)

    def code(at: Column) -> Column:
        a, b = F.get(least, at - 1), F.get(least, F.pmod(at, F.size(least)))
        pair = F.when(place(a) <= place(b), F.xxhash64(point(a), point(b))).otherwise(F.xxhash64(point(b), point(a)))
        return F.lower(F.lpad(F.hex(F.pmod(pair, F.lit(65535)) + 1), 4, "0"))

    at = F.transform(first, lambda _, i: F.coalesce(F.array_min(F.slice(first, i + 1, SKETCHES)), F.lit(1)))
    return F.when(F.size(least) == 0, F.array_repeat(F.lit(EMPTY), SKETCHES)).otherwise(F.transform(at, code))


def _first(least: Column) -> Column:
    """For each arc the place (from 1) of its first k-mer in least, null if it has none."""
    of = F.transform(least, lambda x: F.shiftright(x, _ARC))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SKETCHES - 1).cast("long")), lambda a: F.nullif(F.array_position(of, a), F.lit(0).cast("long")).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among those that either fingerprint (array of entries) has; two of none are alike."""
    some = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != EMPTY) | (y != EMPTY)).cast("int")), F.lit(0), lambda s, x: s + x)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: ((x == y) & (x != EMPTY)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    docs needs doc_id (a whole number) and text; other columns are ignored. Null counts as the empty text, whose
    fingerprint has no entries. Equal texts have equal fingerprints. Repeated rows follow one another.
    """
    rows = with_next(docs)
    change = edited(F.col("text"), F.col("next_text"))
    sides = F.when(F.col("guest") == 1, F.array(F.struct(F.lit(0).alias("side"), "text")))
    sides = sides.otherwise(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), change.alias("text"))))
    kmers = numbered_kmers(rows.select("part", "row", F.inline(sides)))
    # all k-mers of a document and of its edited text in one row: as much as the texts themselves
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("kmer"))))
    found = kmers.groupBy("part", "row").agg(of(0).alias("own"), of(1).alias("new"))
    found = _once(found.select("part", "row", arcs(F.col("own")).alias("own"), arcs(F.col("new")).alias("new")), first=_first(F.col("own")), first_new=_first(F.col("new")))
    found = _once(found, codes=entries(F.col("own"), F.col("first")), new_codes=entries(F.col("new"), F.col("first_new")))
    found = found.select("part", "row", F.col("codes").alias("own"), F.col("new_codes").alias("new"))
    none = F.array_repeat(F.lit(EMPTY), SKETCHES)
    about = rows.select("part", "row", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(change, 256).alias("edited_sha256"))
    joined = about.join(found, ["part", "row"], "left")
    joined = joined.withColumns({"own": F.coalesce("own", none), "new": F.coalesce("new", none)})
    joined = joined.withColumn("next", F.expr("lead(own) over (partition by part order by row)")).where("guest = 0")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("new", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
