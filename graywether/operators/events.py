"""Token events of texts and the count tables built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions.text import BIGRAM_SALT, BUCKETS, FNV_OFFSET, WORD_SALT, tokens

_PRIME = np.uint64((1 << 40) + 435)


#: Words that are worked on at once, beyond a single longer text.
_WORDS = 1 << 18


def pieces(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches whose column `at` (lists or texts) holds `most` elements or bytes together, or of
    one row: so memory doesn't grow with the rows of a batch."""
    for batch in batches:
        column = batch.column(at)
        length = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
        ends, start = np.cumsum(np.asarray(length(column).fill_null(0), dtype=np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _word_hashes(words: pa.StringArray, salt: int = WORD_SALT) -> np.ndarray:
    """Salted FNV-1a of every word's bytes, A-Z lower-cased: byte by byte, all words at once."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(offsets)
    h = np.full(len(size), FNV_OFFSET ^ salt, dtype=np.uint64)
    on, place = np.flatnonzero(size > 0), 0
    while len(on):
        b = data[offsets[on] + place]
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
        h[on] = (h[on] ^ b) * _PRIME
        place += 1
        on = on[size[on] > place]
    return h


def _pair_hashes(a: np.ndarray, b: np.ndarray, salt: int = BIGRAM_SALT) -> np.ndarray:
    """Salted FNV-1a of two word hashes, low byte first; bytes that are A-Z are lower-cased here too."""
    h = np.full(len(a), FNV_OFFSET ^ salt, dtype=np.uint64)
    for part in (a, b):
        for i in range(8):
            byte = part >> np.uint64(8 * i) & np.uint64(255)
            h = (h ^ np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)) * _PRIME
    return h


def token_events(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, h, is_bigram: a hash for every word and every pair of neighbours, in the row (no shuffle).

    The hash wraps at 64 bits, which SQL arithmetic doesn't; it is worked out in Arrow batches, once for each distinct
    word of a batch. A null text has no events.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _WORDS):
            words = batch.column(1)
            sizes = np.diff(np.asarray(words.offsets)) if len(words) else np.array([], dtype=np.int64)
            coded = words.flatten().dictionary_encode()
            h = _word_hashes(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.array([], dtype=np.uint64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            second = np.flatnonzero(pos > 0)
            both = np.concatenate([h, _pair_hashes(h[second - 1], h[second])])
            columns = [
                batch.column(0).take(pa.array(np.concatenate([owner, owner[second]]))),
                pa.array(np.concatenate([pos, pos[second]]).astype(np.int32)),
                pa.array(both.view(np.int64)),
                pa.array(np.arange(len(both)) >= len(h)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "h", "is_bigram"])

    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("ws")
    return docs.select(key, words).mapInArrow(run, f"`{key}` {kind}, pos int, h long, is_bigram boolean")


def hashed_embedding(events: DataFrame, key: str = "doc_id", size: int = 256) -> DataFrame:
    """key, bucket, weight: words count 1, pairs 0.5, negative with the hash's top bit; length 1 per key."""
    sign = F.when(F.col("h") < 0, -1.0).otherwise(1.0)
    value = sign * F.when(F.col("is_bigram"), 0.5).otherwise(1.0)
    sums = events.groupBy(key, F.col("h").bitwiseAND(F.lit(size - 1)).cast("int").alias("bucket")).agg(F.sum(value).alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return sums.select(key, "bucket", (F.col("w") / norm).alias("weight"))


def count_table(events: DataFrame, domain: str) -> DataFrame:
    """domain, tok, n_in: events by bucket; a sum with map-side partials."""
    tok = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    return events.groupBy(domain, tok.alias("tok")).agg(F.count("*").alias("n_in"))


def log_odds(counts: DataFrame, domain: str, alpha: float | None = 1.0, vocabulary: int = BUCKETS, by: tuple[str, ...] = ()) -> DataFrame:
    """domain, tok, n_in, n_out, score: log2 of smoothed shares inside and outside the domain, for every domain; apart
    for each value of the columns `by`.

    Buckets a domain lacks (n_in = 0) are made by joining seen buckets with the domains, which are few. alpha None: the
    number of seen buckets by the vocabulary, so that all buckets together get one count for each seen one.
    """
    everything = counts.groupBy(*by, "tok").agg(F.sum("n_in").alias("n_all"))
    size = counts.groupBy(*by, domain).agg(F.sum("n_in").alias("size_in"))
    total = size.groupBy(*by).agg(F.sum("size_in").alias("size_all"))
    if alpha is None:
        observed = everything.groupBy(*by).agg((F.count("*") / vocabulary).alias("alpha"))
        total = total.join(observed, list(by)) if by else total.crossJoin(F.broadcast(observed))  # one row
    else:
        total = total.withColumn("alpha", F.lit(alpha))
    if by:
        full = everything.join(size.join(total, list(by)), list(by))
    else:
        full = everything.crossJoin(F.broadcast(size.crossJoin(F.broadcast(total))))  # a row a domain
    joined = full.join(counts, [*by, domain, "tok"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    n_out = F.col("n_all") - F.col("n_in")
    mass = F.col("alpha") * vocabulary
    inside = (F.col("n_in") + F.col("alpha")) / (F.col("size_in") + mass)
    outside = (n_out + F.col("alpha")) / (F.col("size_all") - F.col("size_in") + mass)
    return joined.select(*by, domain, "tok", "n_in", n_out.alias("n_out"), (F.log2(inside) - F.log2(outside)).alias("score"))


def other_folds(counts: DataFrame, domain: str, fold: str, folds: int) -> DataFrame:
    """fold, domain, tok, n_in: for each fold the counts (fold, domain, tok, n_in) of all the others together."""
    others = F.array_remove(F.array(*map(F.lit, range(folds))), F.col(fold))
    spread = counts.select(F.explode(others).alias("_fold"), domain, "tok", "n_in")
    return spread.groupBy(F.col("_fold").alias(fold), domain, "tok").agg(F.sum("n_in").alias("n_in"))


def in_scores(events: DataFrame, odds: DataFrame, domain: str, key: str = "doc_id") -> DataFrame:
    """key, domain, score, seen: the sum of log-odds of a text's events in buckets that training has seen.

    Events are counted per key and bucket before the join, so a repeated word meets the table once.
    """
    tok = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    asked = events.groupBy(key, tok.alias("tok")).agg(F.count("*").alias("times"))
    joined = asked.join(odds.select(domain, "tok", "score"), "tok")
    return joined.groupBy(key, domain).agg(F.sum(F.col("times") * F.col("score")).alias("score"), F.sum("times").alias("seen"))
