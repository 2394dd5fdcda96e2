"""Removal of passages that recur, by automata of repeated phrases.

A window is WINDOW consecutive words of one document. Every window is assigned to its anchor, the least hashed
phrase of PHRASE words in it; equal windows have equal anchors, so windows that share an anchor make a region and
only regions whose anchor occurs twice can hold a repeated window. Among those:

1. equal regions fall together by an aggregation, one witness of each is read again from the documents;
2. windows of the witnesses are counted with their regions' numbers: from two on they are confirmed. Confirmed
   windows that always follow one another are chained into phrases, so that a phrase occurs wherever one of its
   windows does;
3. phrases are dealt into shards by anchor, each compiled into an Aho-Corasick automaton over words, and all
   regions of the shard are streamed through it, which locates every occurrence;
4. located windows go back to all documents with such a region, whose covered words are removed.

All counts are Spark aggregations with map-side sums. A shard with many phrases has several slots: a phrase goes to the
slot of its first window, a region to the slots of its windows. A slot with many regions (a common passage in many
contexts) is dealt to several tasks, each with the slot's phrases; so neither an automaton nor what it is sent to grows
with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

WINDOW = 35
PHRASE = 8
#: Windows of one region at most: those that hold its anchor.
_SPAN = WINDOW - PHRASE + 1
#: Distinct regions for one automaton and its stream.
SHARD_REGIONS = 8_000
#: Phrases for one automaton.
SLOT_PHRASES = 16_000
_WORDS = 400_000  # of a slice of documents that is hashed at once

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hasher:
    """Hashes of ranges of a sequence of word hashes: polynomials modulo 2^64, mixed."""

    _up = np.ones(1, dtype=np.uint64)
    _down = np.ones(1, dtype=np.uint64)

    def __init__(self, words: list[bytes]):
        n = len(words)
        if len(_Hasher._up) <= n:
            size = max(2 * n, 1 << 16)
            _Hasher._up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, dtype=np.uint64)])
            _Hasher._down = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE, dtype=np.uint64)])
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        self.sums = np.r_[np.uint64(0), np.cumsum(self.words * _Hasher._up[:n])]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * _Hasher._down[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` values the place of its least, the first of equals."""
    v, at, k = values, np.arange(len(values)), 1
    while 2 * k <= width:
        right = v[k:] < v[:-k]
        v, at = np.where(right, v[k:], v[:-k]), np.where(right, at[k:], at[:-k])
        k *= 2
    if k < width:
        d = width - k
        right = v[d:] < v[:-d]
        at = np.where(right, at[d:], at[:-d])
    return at


def find_regions(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """document number, first window, windows, anchor and content hash of every region of some documents' words."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.cumsum(sizes) - sizes
    none = np.array([], dtype=np.int64)
    n = int(sizes.sum())
    if n < WINDOW:
        return none, none, none, none, none
    h = _Hasher([w for t in texts for w in t])
    at = np.arange(n - PHRASE + 1)
    phrases = h.ranges(at, at + PHRASE)
    anchor = _first_least(phrases, _SPAN)
    doc = np.repeat(np.arange(len(texts)), sizes)
    windows = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(windows):
        return none, none, none, none, none
    a, d = anchor[windows], doc[windows]
    cut = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
    first = windows[cut]
    count = np.diff(np.r_[np.flatnonzero(cut), len(windows)])
    owner = doc[first]
    content = h.ranges(first, first + count + WINDOW - 1)
    return owner, first - offsets[owner], count, phrases[anchor[first]].view(np.int64), content.view(np.int64)


def row_key(key: Column) -> Column:
    """Tells documents apart by key and text; rows alike in both lose the same words."""
    return F.xxhash64(key.cast("string"), F.col("text"))


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Pieces of the batches of about _WORDS words, and their documents' words."""
    for batch in batches:
        start, held, total = 0, [], 0
        for i, t in enumerate(batch.column(text).cast(pa.large_binary())):
            held.append((t.as_py() or b"").split())
            total += len(held[-1])
            if total >= _WORDS or i == batch.num_rows - 1:
                yield batch.slice(start, len(held)), held
                start, held, total = i + 1, [], 0


def regions(docs: DataFrame) -> DataFrame:
    """row_key, first, windows, anchor, content: the regions of docs (row_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 1):
            owner, first, count, anchor, content = find_regions(texts)
            keys = np.asarray(batch.column(0))[owner] if len(owner) else np.array([], dtype=np.int64)
            columns = [pa.array(keys, pa.int64()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(content)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "first", "windows", "anchor", "content"])

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, first int, windows int, anchor long, content long")


def read_witnesses(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """anchor, content, n, words (joined by blanks) of asked: row_key, and anchor, content, n, first, windows of its regions; a
    written table, so that Spark knows its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 1):
            wanted = batch.column(0)
            flat = wanted.flatten()
            lengths = np.diff(np.asarray(wanted.offsets))
            first, count = np.asarray(flat.field("first")), np.asarray(flat.field("windows"))
            owner = np.repeat(np.arange(len(texts)), lengths)
            words = [b" ".join(texts[o][f : f + c + WINDOW - 1]) for o, f, c in zip(owner.tolist(), first.tolist(), count.tolist())]
            columns = [flat.field("anchor"), flat.field("content"), flat.field("n"), pa.array(words, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "n", "words"])

    # only witnesses are sorted by key; rows alike are one: a row that repeats without end is read once for each map task
    once = docs.join(asked.select("row_key"), "row_key", "left_semi").groupBy("row_key").agg(F.first("text").alias("text"))
    joined = asked.join(once, "row_key").select("asked", "text")
    return joined.mapInArrow(run, "anchor long, content long, n long, words string")


def windows(found: DataFrame) -> DataFrame:
    """anchor, content, n, place, window, before, after: windows of regions, with hashes of the words beside them
    in the region (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 3):
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            h = _Hasher([w for t in texts for w in t])
            count = sizes - WINDOW + 1
            owner = np.repeat(np.arange(len(texts)), count)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = (np.cumsum(sizes) - sizes)[owner] + place
            near = (h.words >> np.uint64(33)).astype(np.int32) | 1
            before = np.where(place > 0, near[start - 1], 0).astype(np.int32)
            end = start + WINDOW
            after = np.where(place < count[owner] - 1, near[end.clip(max=len(near) - 1)], 0).astype(np.int32)
            per = [np.asarray(batch.column(i))[owner] for i in range(3)]
            columns = [*per, place.astype(np.int32), h.ranges(start, end).view(np.int64), before, after]
            names = ["anchor", "content", "n", "place", "window", "before", "after"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return found.mapInArrow(run, "anchor long, content long, n long, place int, window long, before int, after int")


def confirm(found: DataFrame) -> DataFrame:
    """anchor, content, places: windows that occur twice or more, at their witness, the region of least content.

    places has place, left, right: whether the same word is before or after the window wherever it occurs.
    """
    counted = windows(found).groupBy("anchor", "window").agg(
        F.sum("n").alias("n"),
        F.min("content").alias("content"),
        F.min_by("place", "content").alias("place"),
        *[f(c).alias(f"{name}_{c}") for c in ("before", "after") for f, name in ((F.min, "min"), (F.max, "max"))],
    )
    alone = lambda c: (F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"min_{c}") != 0)
    sure = counted.where("n >= 2").select("anchor", "content", F.struct("place", alone("before").alias("left"), alone("after").alias("right")).alias("p"))
    return sure.groupBy("anchor", "content").agg(F.sort_array(F.collect_list("p")).alias("places"))


def chains(words: list[str], places: list[dict]) -> list[str]:
    """Phrases of a witness: windows that always follow one another are one phrase."""
    out, start, last = [], None, None
    for p in places:
        if start is not None and p["place"] == last["place"] + 1 and last["right"] and p["left"]:
            last = p
            continue
        if start is not None:
            out.append(" ".join(words[start : last["place"] + WINDOW]))
        start, last = p["place"], p
    if start is not None:
        out.append(" ".join(words[start : last["place"] + WINDOW]))
    return out


def phrases(found: DataFrame, confirmed: DataFrame) -> DataFrame:
    """anchor, phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (anchor, phrase)
                for anchor, words, places in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for phrase in chains(words.split(" "), places)
            ]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "phrase"])

    joined = confirmed.join(found.dropDuplicates(["anchor", "content"]), ["anchor", "content"])
    return joined.select("anchor", "words", "places").mapInArrow(run, "anchor long, phrase string")


def locate_in(phrase_words: list[list[str]], texts: list[list[str]]) -> list[int]:
    """For each text the windows that lie in an occurrence of a phrase, as bits; one automaton for all phrases."""
    numbers: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrase_words:
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in p]), len(p))
    if not len(automaton):
        return [0] * len(texts)
    automaton.make_automaton()
    found, number = [], numbers.get
    for words in texts:
        bits = 0
        for end, size in automaton.iter(tuple([number(w, 0) for w in words])):
            first = end - size + 1
            bits |= ((1 << (size - WINDOW + 1)) - 1) << first
        found.append(bits)
    return found


def _window_slots(slots: Column) -> Column:
    """The slots of a region's windows, given how many its shard has."""
    words = F.split("words", " ")
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    each = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")), slots))
    return F.when(slots == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(each))


def locate(found: DataFrame, phrase_rows: DataFrame) -> DataFrame:
    """anchor, content, bits of every region in found (anchor, content, words) in which a phrase occurs."""
    shards = max(1, -(-found.count() // SHARD_REGIONS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    patterns = phrase_rows.select(shard.alias("shard"), "phrase").distinct()
    # one row a shard, and one a slot: how many slots it has, how many tasks its regions need
    slots = patterns.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_PHRASES).alias("slots"))
    first = F.xxhash64(F.substring_index("phrase", " ", WINDOW))
    patterns = patterns.join(slots, "shard").select("shard", F.pmod(first, F.col("slots")).alias("slot"), "phrase")
    streams = found.withColumn("shard", shard).join(slots, "shard")
    streams = streams.select("shard", F.explode(_window_slots(F.col("slots"))).alias("slot"), "anchor", "content", "words")
    tasks = streams.groupBy("shard", "slot").agg(F.ceil(F.count("*") / (2.0 * SHARD_REGIONS)).alias("tasks"))
    deal = F.pmod(F.xxhash64("content"), F.col("tasks")).cast("int")
    streams = streams.join(tasks, ["shard", "slot"]).select("shard", "slot", deal.alias("task"), "anchor", "content", "words")
    every = F.explode(F.sequence(F.lit(0), F.col("tasks").cast("int") - 1)).alias("task")
    patterns = patterns.join(tasks, ["shard", "slot"]).select("shard", "slot", every, "phrase")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"anchor": [], "content": [], "bits": []}, dtype="int64")
        bits = locate_in([p.split(" ") for p in left["phrase"]], [w.split(" ") for w in right["words"]])
        out = right[["anchor", "content"]].assign(bits=np.array(bits, dtype=np.int64))
        return out[out["bits"] != 0]

    keys = ["shard", "slot", "task"]
    hits = patterns.groupBy(*keys).cogroup(streams.groupBy(*keys)).applyInPandas(run, "anchor long, content long, bits long")
    return hits.groupBy("anchor", "content").agg(F.bit_or("bits").alias("bits"))


def covered(size: int, first: list[int], bits: list[int]) -> np.ndarray:
    """Which of a document's words lie in located windows."""
    change = np.zeros(size + 1, dtype=np.int64)
    for f, b in zip(first, bits):
        while b:
            low = (b & -b).bit_length() - 1
            run = ((b >> low) + 1 & -((b >> low) + 1)).bit_length() - 1  # ones in a row
            change[f + low] += 1
            change[min(size, f + low + run + WINDOW - 1)] -= 1
            b &= ~(((1 << run) - 1) << low)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_removed and kept_text (the kept words joined by one blank) of each row of docs (key, text).

    Repeated rows repeat each other's windows. Null and short texts have no windows and keep their words.
    """
    ws = Workspace(docs.sparkSession, "passages")
    rows = docs.select(F.col(key).alias("key"), row_key(F.col(key)).alias("row_key"), "text")
    all_regions = ws.save(regions(rows), "regions")
    # written first, so that the join's sides are plain reads and a common anchor's regions can be split over tasks
    twice = ws.save(all_regions.groupBy("anchor").agg(F.count("*").alias("n")).where("n >= 2").select("anchor"), "twice")
    recurring = ws.save(all_regions.join(twice, "anchor", "left_semi"), "recurring")
    ws.drop("regions", "twice")
    classes = recurring.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min_by("first", "row_key").alias("first"), F.first("windows").alias("windows")
    )
    asked = ws.save(classes.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "content", "n", "first", "windows")).alias("asked")), "asked")
    found = ws.save(read_witnesses(rows.select("row_key", "text"), asked), "witnesses")
    confirmed = ws.save(confirm(found), "confirmed")
    shards = ws.save(phrases(found, confirmed), "phrases")
    located = ws.save(locate(found, shards), "located")
    marks = recurring.join(located, ["anchor", "content"]).select("row_key", "first", "bits").distinct()
    marks = ws.save(marks.groupBy("row_key").agg(F.collect_list(F.struct("first", "bits")).alias("marks")), "marks")
    ws.drop("recurring", "asked", "witnesses", "confirmed", "phrases", "located")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 1):
            removed, kept = [], []
            for words, marks in zip(texts, batch.column(2).to_pylist()):
                if marks:
                    keep = ~covered(len(words), [m["first"] for m in marks], [m["bits"] for m in marks])
                    removed.append(int(len(words) - keep.sum()))
                    words = compress(words, keep.tolist())
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), sizes, pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_removed", "kept_text"])

    kind = docs.schema[key].dataType.simpleString()
    joined = rows.join(marks, "row_key", "left").select("key", "text", "marks")
    return joined.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")
