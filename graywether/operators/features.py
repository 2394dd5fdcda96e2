"""Rows of hashed token counts, and sums of packed matrices over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graywether.functions.text import BUCKETS, tokens
from graywether.operators.events import _WORDS, _pair_hashes, _word_hashes, pieces


def cells(owner: np.ndarray, stream: np.ndarray, n: int) -> list[pa.Array]:
    """Lists toks, times and runs of n rows, from a stream of buckets ordered by its rows."""
    keyed = owner * BUCKETS + stream
    fresh = np.ones(len(keyed), dtype=bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    found, place = np.unique(keyed, return_inverse=True)
    edges = pa.array(np.searchsorted(found, np.arange(n + 1) * BUCKETS).astype(np.int32))
    arrays = [found % BUCKETS, np.bincount(place, minlength=len(found)), np.bincount(place, weights=fresh, minlength=len(found))]
    return [pa.ListArray.from_arrays(edges, pa.array(a.astype(np.int32))) for a in arrays]


def bucket_rows(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry, toks, times, runs, n: the buckets of each row's words and pairs of neighbours, ascending, how often each
    occurs, how often without repeats in a row of the stream (word, word, pair, word, pair, ...), and the stream's length.

    All within the row: no shuffle. A null text has empty arrays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(carry), _WORDS):
            words = batch.column(len(carry))
            offsets = np.asarray(words.offsets)
            sizes = np.diff(offsets)
            coded = words.flatten().dictionary_encode()
            h = _word_hashes(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.array([], dtype=np.uint64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            pos = np.arange(len(h)) - np.repeat(starts, sizes)
            second = np.flatnonzero(pos > 0)
            length = np.maximum(2 * sizes - 1, 0)
            begin = np.cumsum(length) - length
            stream = np.empty(int(length.sum()), dtype=np.int64)
            mask = np.uint64(BUCKETS - 1)
            stream[begin[owner] + np.maximum(2 * pos - 1, 0)] = (h & mask).astype(np.int64)
            stream[begin[owner[second]] + 2 * pos[second]] = (_pair_hashes(h[second - 1], h[second]) & mask).astype(np.int64)
            lists = cells(np.repeat(np.arange(len(sizes)), length), stream, len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *lists, pa.array(length.astype(np.int64))], names=[*carry, "toks", "times", "runs", "n"])

    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("ws")
    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return docs.select(*carry, words).mapInArrow(run, f"{carried}, toks array<int>, times array<int>, runs array<int>, n long")


def summed(parts: DataFrame, by: list[str], kind: str, ways: int = 32) -> DataFrame:
    """by, m: the sums of packed matrices m (numpy arrays of dtype `kind`, as bytes) by key, in two steps so that no task
    gets one from every task of the stage before."""
    schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in by)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows["m"].iloc[0], dtype=kind).copy()
        for m in rows["m"].iloc[1:]:
            total += np.frombuffer(m, dtype=kind)
        return pd.DataFrame([[*key[: len(by)], total.tobytes()]], columns=[*by, "m"])

    dealt = parts.withColumn("way", F.spark_partition_id() % ways)
    once = dealt.groupBy(*by, "way").applyInPandas(add, f"{schema}, m binary")
    return once.groupBy(*by).applyInPandas(add, f"{schema}, m binary")


def embedded(docs: DataFrame, carry: list[str], size: int = 256, text: str = "text") -> DataFrame:
    """carry, vector: the hashed embedding of each row, `size` numbers: words count 1, pairs of neighbours 0.5, negative with the
    hash's top bit, scaled to length 1. All within the row; a text without words is all zeros."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                words = batch.column(len(carry))
                sizes = np.diff(np.asarray(words.offsets))
                coded = words.flatten().dictionary_encode()
                h = _word_hashes(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.array([], dtype=np.uint64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                second = np.flatnonzero(np.arange(len(h)) > np.repeat(np.cumsum(sizes) - sizes, sizes))
                every = np.concatenate([h, _pair_hashes(h[second - 1], h[second])])
                weight = np.where(every >> np.uint64(63) > 0, -1.0, 1.0) * np.where(np.arange(len(every)) < len(h), 1.0, 0.5)
                place = np.concatenate([owner, owner[second]]) * size + (every & np.uint64(size - 1)).astype(np.int64)
                v = np.bincount(place, weights=weight, minlength=len(sizes) * size).reshape(len(sizes), size)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = v / np.where(norm == 0, 1, norm)
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[*carry, "vector"])

    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("ws")
    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return docs.select(*carry, words).mapInArrow(run, f"{carried}, vector array<double>")


def moments(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    """by, m: of each group's vectors (column vector) the sum of outer products with a leading 1, packed: their number in the corner,
    their sums beside it."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for whole in batches:
            keys = list(zip(*(c.to_pylist() for c in whole.columns[: len(by)]))) if by else [()] * whole.num_rows
            x = np.asarray(whole.column(len(by)).flatten(), dtype=np.float64).reshape(whole.num_rows, dims)
            x = np.hstack([np.ones((len(x), 1)), x])
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, mine in groups.items():
                part = x[mine].T @ x[mine]
                sums[k] = sums[k] + part if k in sums else part
        columns = [pa.array([k[i] for k in sums], to_arrow_type(kinds[c])) for i, c in enumerate(by)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=[*by, "m"])

    schema = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in by)
    parts = rows.where(F.size("vector") == dims).select(*by, "vector").mapInArrow(run, f"{schema}m binary")
    return summed(parts, by, "float64")
