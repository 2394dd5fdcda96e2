"""Queries of the feedback calibrator: its batch twin and the stream driven over the events folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.plans.registry import query
from graywether.sources.tables import table
from graywether.streaming import feedback


@query()
def feedback_calibration(spark, sf_dir):
    return feedback.calibrate_batch(feedback.as_feedback(table(spark, sf_dir, "events")))


@query()
def feedback_stream(spark, sf_dir):
    """The stream over the events files until they are used up; the last row of every key."""
    name = f"feedback_{uuid.uuid4().hex}"
    source = spark.readStream.schema(feedback.EVENTS).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    run = feedback.calibrate_stream(feedback.as_feedback(source)).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n")))
    return spark.table(name).withColumn("back", last).where("back = 1").drop("back")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def hourly_feedback(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
