"""New labelled texts by moving spans between frames: slots that two texts of a label show, filled with the label's other spans.

Two texts of a label that agree in a prefix and a suffix and differ in what stands between (its first and last words
differ, case ignored, and it has at most MOST_SPAN words) attest a frame with both spans. Pairs are not made: a text
emits a key for each prefix and suffix that leave a span short enough, and whether a span has a partner follows from
counts by key, by first word and by last word.

Of a frame's m words, half or more stand before or after the span. So a text first emits the digests of its halves, two for
each m (at most MOST_SPAN of them), and lists the frames of those halves only that another text of the label shows too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.operators.laws import budget
from graywether.operators.ordered import running
from graywether.sources.steps import Workspace

#: Words of a span, and spans tried in a frame where a budget takes few of them anyway.
MOST_SPAN = 4
MOST_TRIED = 48
#: Frames and spans of a tile: what a task joins at once is their product.
FRAMES = 512
SPANS = 2048

KEY = ["label", "p", "s", "head", "tail"]


def normal_words(text: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def norm_key(text: Column) -> Column:
    return F.lower(F.array_join(normal_words(text), " "))


def _digest(h) -> int:
    return int.from_bytes(h.digest(), "little", signed=True)


def _half(m: int) -> int:
    """A frame of m words has this many before its span, or more than m less this many after it."""
    return (m + 1) // 2


def halves_of(words: list[str], most: int) -> Iterator[tuple[int, int]]:
    """What another text has to show for frames of m words, the text's words less 1 to `most`: 2 m and the digest of the first
    half of m, 2 m + 1 and that of the last."""
    low = [w.lower() for w in words]
    sizes = range(max(0, len(low) - most), len(low))
    for side, chain, length in ((0, low, _half), (1, low[::-1], lambda m: m - _half(m) + 1)):
        h, at = hashlib.blake2b(digest_size=8), 0
        for m in sizes:
            if side and not m:
                continue  # no words after the span: the first half is all
            for w in chain[at : length(m)]:
                h.update(f"{len(w)}:{w}".encode())
            at = length(m)
            yield 2 * m + side, _digest(h)


def frames_of(words: list[str], most: int, halves: frozenset[int] | None = None) -> Iterator[tuple[int, int, int, int, int, int, str]]:
    """For each prefix and suffix that leave 1 to `most` words: their lengths and digests, the digests of the span's first and
    last word (case ignored), and the span. halves: numbers that halves_of gives, for the frames of these only."""
    low = [w.lower() for w in words]
    n = len(low)
    heads, tails = [hashlib.blake2b(digest_size=8)], [hashlib.blake2b(digest_size=8)]
    for i in range(n - 1):
        for chain, w in ((heads, low[i]), (tails, low[n - 1 - i])):
            h = chain[-1].copy()
            h.update(f"{len(w)}:{w}".encode())
            chain.append(h)
    head, tail = [_digest(h) for h in heads], [_digest(h) for h in tails]
    one = [_digest(hashlib.blake2b(w.encode(), digest_size=8)) for w in low]
    for p in range(n):
        for size in range(1, min(most, n - p) + 1):
            s = n - p - size
            m = p + s
            if halves is not None and 2 * m + (p < _half(m)) not in halves:
                continue
            yield p, s, head[p], tail[s], one[p], one[p + size - 1], " ".join(words[p : p + size])


def slots(texts: DataFrame, most_span: int = MOST_SPAN) -> tuple[DataFrame, DataFrame]:
    """The attested spans, label, p, s, head, tail (the frame: words before and after, digests of them), span, id (the least
    text that shows it), and the texts they come from, label, id, words.

    texts: id, label, text; ids are unique. Texts of the same words are one, the one of the least id. Null labels and texts
    without words show none.
    """
    ws = Workspace(texts.sparkSession, "slots")
    # words hold no blanks, so joined they say as much and are shuffled in less room
    rows = texts.where("label is not null").select("id", "label", F.array_join(normal_words(F.col("text")), " ").alias("text")).where("text <> ''")
    rows = ws.save(rows.groupBy("label", "text").agg(F.min("id").alias("id")).select("label", "id", "text"), "texts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(halves_of(text.split(" "), most_span)) for text in batch.column(2).to_pylist()]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            columns = list(zip(*(x for f in found for x in f))) or [[]] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=["label", "id", "half", "digest"])

    half = rows.mapInArrow(halves, f"label {kinds['label']}, id {kinds['id']}, half int, digest long")
    half = ws.save(half.select("id", "half", F.xxhash64("label", "half", "digest").alias("key")), "halves")  # a collision only lists more frames
    met = half.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key")
    live = half.join(met, "key", "left_semi").groupBy("id").agg(F.collect_list("half").alias("halves"))  # 2 most_span at most
    asked = ws.save(rows.join(live, "id").select("label", "id", "text", "halves"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [list(frames_of(text.split(" "), most_span, frozenset(h))) for text, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                columns = list(zip(*(x for f in found for x in f))) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["label", "id", "p", "s", "head", "tail", "first", "last", "span"],
                )

    schema = f"label {kinds['label']}, id {kinds['id']}, p int, s int, head long, tail long, first long, last long, span string"
    shown = ws.save(asked.mapInArrow(run, schema), "shown")
    met = shown.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    shared = ws.save(shown.join(met, KEY), "shared")
    by = lambda name, *more: shared.groupBy(*KEY, *more).agg(F.count("*").alias(name))
    counted = shared.join(by("n_first", "first"), [*KEY, "first"]).join(by("n_last", "last"), [*KEY, "last"]).join(by("n_both", "first", "last"), [*KEY, "first", "last"])
    attested = counted.where("n - n_first - n_last + n_both > 0").groupBy(*KEY, "span").agg(F.min("id").alias("id"))
    return ws.save(attested, "slots"), rows.select("label", "id", F.split("text", " ").alias("words"))


def _words_of(frames: DataFrame, texts: DataFrame, ws: Workspace) -> DataFrame:
    """label, src, words of the frames' least texts; of the texts only these are joined to what they make."""
    sources = ws.save(frames.select("label", "src").distinct(), "sources")
    return ws.save(texts.withColumnRenamed("id", "src").join(sources, ["label", "src"], "left_semi"), "words")


def transplants(found: DataFrame, texts: DataFrame, known: DataFrame, tried: int | None = None) -> DataFrame:
    """label, text, src, p, span_words: each frame, in the words of its least text src, with every span of its label that it
    doesn't have itself, less the texts of `known` (column text, any label), each text once: by the least label, words before and
    after, and span. tried: only the first so many spans of a frame, in order.

    found, texts: as slots() gives them. The result has frames times spans of a label, so it grows with the square of the input.
    Blocks of frames meet blocks of spans, each pair in one place whatever its label; frames and spans have numbers in the order in
    which the least is sought. What isn't to be made, a frame's own spans, known texts and all but one of equal texts, is found first,
    from digests of 128 bits with these numbers. Then the texts are made where frame and span meet; none is shuffled or written.
    """
    if tried is not None:
        return _first_transplants(found, texts, known, tried)
    ws = Workspace(found.sparkSession, "transplants")
    one = F.lit(1).cast("long").alias("one")
    spans = running(found.select("label", "span").distinct().select("*", one), "span", ["one"], ("label",)).withColumn("no", F.col("one_upto") - 1)
    spans = ws.save(spans.select("label", "span", F.size(F.split("span", " ")).alias("span_words"), "no", F.floor(F.col("no") / SPANS).alias("sb")), "spans")
    frames = found.groupBy(*KEY).agg(F.min("id").alias("src"))
    words = _words_of(frames, texts, ws)
    head, tail = F.slice("words", 1, F.col("p")), F.slice("words", F.size("words") - F.col("s") + 1, F.col("s"))
    frames = frames.join(words, ["label", "src"]).select(*KEY, "src", F.struct("label", F.array_join(head, " ").alias("h"), F.array_join(tail, " ").alias("t")).alias("name"), one)
    frames = running(frames, "name", ["one"]).withColumn("frame", F.col("one_upto") - 1)
    before, after = F.when(F.col("name.h") == "", "").otherwise(F.concat("name.h", F.lit(" "))), F.when(F.col("name.t") == "", "").otherwise(F.concat(F.lit(" "), "name.t"))
    frames = ws.save(frames.select(*KEY, "src", before.alias("before"), after.alias("after"), "frame", F.floor(F.col("frame") / FRAMES).alias("fb")), "frames")
    # frames are numbered label by label, so a label's blocks are a range
    blocks = frames.groupBy("label").agg(F.min("fb").alias("from_fb"), F.max("fb").alias("to_fb")).join(spans.groupBy("label").agg(F.max("sb").alias("to_sb")), "label")
    blocks = ws.save(blocks, "blocks")
    tiles = blocks.agg(F.sum(F.expr("(to_fb - from_fb + 1) * (to_sb + 1)"))).first()[0] or 1
    parts = min(tiles, 32 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # given, as Spark would join few bytes in one task

    def pairs(skips: DataFrame) -> DataFrame:
        """Every frame with every span of its label, but for these (frame, no)."""
        listed = skips.groupBy("frame", F.floor(F.col("no") / SPANS).alias("sb")).agg(F.collect_list("no").alias("skip"))  # SPANS at most
        left = frames.select("label", "src", "p", "before", "after", "frame", "fb").join(blocks.select("label", "to_sb"), "label")
        left = left.withColumn("sb", F.explode(F.sequence(F.lit(0).cast("long"), "to_sb"))).join(listed, ["frame", "sb"], "left")
        right = spans.join(blocks.select("label", "from_fb", "to_fb"), "label").withColumn("fb", F.explode(F.sequence("from_fb", "to_fb")))
        tile = ["label", "fb", "sb"]
        left, right = left.drop("to_sb").repartition(parts, *tile), right.drop("from_fb", "to_fb").repartition(parts, *tile)
        return left.hint("merge").join(right, tile).where("skip is null or not array_contains(skip, no)")

    def digests(key: Column) -> list[Column]:
        return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]

    text = F.concat("before", "span", "after")
    own = found.join(frames.select(*KEY, "frame"), KEY).join(spans.select("label", "span", "no"), ["label", "span"]).select("frame", "no")
    own = ws.save(own, "own")
    nothing = F.lit(-1).cast("long")
    keys = known.select(*digests(norm_key(F.col("text")))).distinct().select("h1", "h2", nothing.alias("frame"), nothing.alias("no"))
    made = pairs(own).select(*digests(F.lower(text)), "frame", "no").unionByName(keys)
    place = F.row_number().over(W.partitionBy("h1", "h2").orderBy("frame", "no"))
    again = ws.save(made.withColumn("place", place).where("place > 1 and frame >= 0").select("frame", "no"), "again")
    return pairs(own.unionByName(again)).select("label", text.alias("text"), "src", "p", "span_words")


def _first_transplants(found: DataFrame, texts: DataFrame, known: DataFrame, tried: int) -> DataFrame:
    """transplants() with the first `tried` spans of each frame. A frame's own spans are skipped by arithmetic on ranks: the m-th
    span that it lacks has the rank m plus the number of its own spans before it."""
    ws = Workspace(found.sparkSession, "transplants")
    one = F.lit(1).cast("long").alias("one")
    ranks = ws.save(running(found.select("label", "span").distinct().select("*", one), "span", ["one"], ("label",)), "ranks")
    ranks = ranks.select("label", "span", F.col("one_upto").alias("rank"), F.col("one_all").alias("spans"))
    frames = found.groupBy(*KEY).agg(F.min("id").alias("src"), F.count("*").alias("own"))
    placed = running(found.join(ranks, ["label", "span"]).select(*KEY, "rank", "spans", one), "rank", ["one"], tuple(KEY))
    early = placed.withColumn("gap", F.col("rank") - F.col("one_upto")).where(F.col("gap") < tried)
    gaps = early.groupBy(*KEY, "gap").agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.collect_list(F.struct("gap", "c")).alias("gaps"))  # `tried` entries
    sizes = ranks.groupBy("label").agg(F.max("spans").alias("spans"))
    asked = frames.join(gaps, KEY, "left").join(sizes, "label").withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(tried).cast("long"))))
    before = F.aggregate(F.coalesce("gaps", F.array().cast("array<struct<gap: long, c: long>>")), F.lit(0).cast("long"), lambda n, g: n + F.when(g["gap"] < F.col("m"), g["c"]).otherwise(0))
    asked = asked.where(F.col("m") <= F.col("spans") - F.col("own")).withColumn("rank", F.col("m") + before)
    words = _words_of(frames, texts, ws)
    filled = asked.join(ranks.drop("spans"), ["label", "rank"]).join(words, ["label", "src"])
    head, tail = F.slice("words", 1, F.col("p")), F.slice("words", F.size("words") - F.col("s") + 1, F.col("s"))
    text = F.array_join(F.concat(head, F.split("span", " "), tail), " ")
    made = filled.select("label", "src", "p", F.size(F.split("span", " ")).alias("span_words"), text.alias("text"), F.array_join(head, " ").alias("h"), F.array_join(tail, " ").alias("t"), "span")
    made = ws.save(made.withColumn("key", norm_key(F.col("text"))).drop("text"), "made")
    # a text that is known has a known hash; the texts themselves are compared for these only
    keys = known.select(norm_key(F.col("text")).alias("key"))
    suspect = made.select("key").distinct().withColumn("hash", F.xxhash64("key"))
    suspect = ws.save(suspect.join(keys.select(F.xxhash64("key").alias("hash")).distinct(), "hash", "left_semi").select("key"), "suspect")
    new = made.join(keys.join(suspect, "key", "left_semi").distinct(), "key", "left_anti")
    least = F.min(F.struct("label", "h", "t", "span", "src", "p", "span_words")).alias("x")  # h, span and t are the text
    full = F.array_join(F.filter(F.array("x.h", "x.span", "x.t"), lambda x: x != ""), " ")
    return new.groupBy("key").agg(least).select("x.label", full.alias("text"), "x.src", "x.p", "x.span_words")


def allotted(cands: DataFrame, weights: DataFrame, most: int, most_each: int) -> DataFrame:
    """The candidates (label, text, ...) that a budget of `most` takes: shares by weights (label, weight), at most most_each a label,
    the rest in turn; of a label the least texts."""
    rooms = cands.groupBy("label").agg(F.least(F.count("*"), F.lit(most_each)).alias("room")).join(weights, "label", "left").fillna(0.0, ["weight"])
    shares = budget(rooms.select("label", "room", "weight"), most).select("label", "share")
    place = F.row_number().over(W.partitionBy("label").orderBy("text"))
    first = cands.withColumn("place", place).where(F.col("place") <= most_each)  # Spark keeps most_each a label and task
    return first.join(shares, "label").where("place <= share").drop("share")


def extended(train: DataFrame, extra: DataFrame, labels: DataFrame, cap: int, extra_cap: int) -> DataFrame:
    """label, text, origin: of each label the first `cap` rows of train and `extra_cap` of extra (id, label, text), by id; a label
    of labels (column label) with neither has its own name as text, origin `fallback`."""

    def first(rows: DataFrame, n: int, origin: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("label").orderBy("id"))
        return rows.withColumn("place", place).where(F.col("place") <= n).select("label", "text", F.lit(origin).alias("origin"))

    wanted = labels.select("label").distinct()
    both = first(train, cap, "train").unionByName(first(extra, extra_cap, "extra")).join(wanted, "label", "left_semi")
    bare = wanted.join(both.select("label").distinct(), "label", "left_anti").select("label", F.col("label").cast("string").alias("text"), F.lit("fallback").alias("origin"))
    return both.unionByName(bare)
