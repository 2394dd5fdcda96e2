"""Online calibration from a stream of feedback (p, outcome).

State per key is a window of the last CAPACITY pairs. From LEAST pairs on, a logistic map of the logit of p is
fitted (Newton, a small ridge, slope above 0, so answers keep their order); before that it is the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY = 512
LEAST = 64
_RIDGE = 1e-3


def fit(pairs: Iterable[tuple[float, int]], steps: int = 25) -> tuple[float, float]:
    """temperature (slope) and bias of a logistic map of logits; (1, 0) under LEAST pairs."""
    pairs = list(pairs)
    if len(pairs) < LEAST:
        return 1.0, 0.0
    xs = [math.log(q / (1 - q)) for q in (min(1 - 1e-6, max(1e-6, p)) for p, _ in pairs)]
    a, b = 1.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = _RIDGE * (a - 1), _RIDGE * b, _RIDGE, 0.0, _RIDGE
        for x, (_, y) in zip(xs, pairs):
            z = a * x + b
            p = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
            ga, gb, w = ga + (p - y) * x, gb + (p - y), p * (1 - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(1e-3, a - da), b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


STATE = "ps array<double>, ys array<int>"
RESULT = "key string, n int, temperature double, bias double"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ps, ys = (list(x) for x in state.get) if state.exists else ([], [])
    for frame in frames:
        frame = frame.sort_values(["ts", "event_id"])
        ps = (ps + frame["p"].tolist())[-CAPACITY:]
        ys = (ys + frame["outcome"].astype(int).tolist())[-CAPACITY:]
    state.update((ps, ys))
    a, b = fit(zip(ps, ys))
    yield pd.DataFrame({"key": [key[0]], "n": [len(ps)], "temperature": [a], "bias": [b]})


def as_feedback(events: DataFrame) -> DataFrame:
    """key, ts, event_id, p, outcome from an events table or stream: value as probability, purchase as success."""
    p = 1.0 / (1.0 + F.exp(-(F.col("value") - 50.0) / 25.0))
    return events.select(F.col("event_type").alias("kind"), (F.col("user_id") % 8).cast("string").alias("key"), "ts", "event_id", p.alias("p"), (F.col("event_type") == "purchase").cast("int").alias("outcome"))


def calibrate_stream(feedback: DataFrame) -> DataFrame:
    """key, n, temperature, bias after each micro-batch of a feedback stream (update mode)."""
    rows = feedback.select("key", "ts", "event_id", "p", "outcome")
    return rows.groupBy("key").applyInPandasWithState(_update, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def calibrate_batch(feedback: DataFrame) -> DataFrame:
    """The batch twin: the last CAPACITY pairs of every key, fitted. Only those rows reach a key's task."""
    from pyspark.sql import Window as W

    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id")))
    kept = feedback.select("key", "ts", "event_id", "p", "outcome").withColumn("back", last).where(F.col("back") <= CAPACITY)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "event_id"])
        a, b = fit(zip(frame["p"].tolist(), frame["outcome"].tolist()))
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "n": [len(frame)], "temperature": [a], "bias": [b]})

    return kept.groupBy("key").applyInPandas(one, RESULT)


EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
