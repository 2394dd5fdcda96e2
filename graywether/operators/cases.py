"""Cases: one question with options and a gold answer per row, built from tables, and variants of them.

Everything is a projection of the row but for the sampled distractors, which join the few distinct labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graywether.functions.maths import total
from graywether.operators.ordered import running


def _strings(values: list[str]) -> object:
    return F.array(*map(F.lit, values))


def choice(rows: DataFrame, key: str, label: str, options: list[str]) -> DataFrame:
    """case_id, qid, kind, options, gold_idx (-1 for a label that is no option)."""
    gold = (F.array_position(_strings(options), F.col(label)) - 1).cast("int")
    return rows.select(F.col(key).alias("case_id"), F.lit(label).alias("qid"), F.lit("choice").alias("kind"), _strings(options).alias("options"), gold.alias("gold_idx"))


def noul(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Yes or no, yes first; rows without the flag are left out."""
    kept = rows.where(F.col(flag).isNotNull())
    return kept.select(F.col(key).alias("case_id"), F.lit(flag).alias("qid"), F.lit("noul").alias("kind"), _strings(["yes", "no"]).alias("options"), (1 - F.col(flag)).cast("int").alias("gold_idx"))


def score(rows: DataFrame, key: str, level: str, k: int, weight: float) -> DataFrame:
    """Ordered levels with soft gold: `weight` on the level, the rest even; gold_score is its mean level."""
    rest = (1 - weight) / (k - 1)
    soft = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(F.when(i == F.col(level), weight).otherwise(rest), 6))
    out = rows.select(
        F.col(key).alias("case_id"), F.lit(level).alias("qid"), F.lit("score").alias("kind"), _strings(list(map(str, range(k)))).alias("options"), F.col(level).alias("gold_idx"), soft.alias("gold_soft")
    )
    return out.withColumn("gold_score", F.round(total(F.transform("gold_soft", lambda p, i: p * i)), 6))


def with_distractors(rows: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """case_id, options (gold and n other labels by hash order, sorted), gold_idx. Distinct labels are few."""
    labels = F.broadcast(rows.agg(F.sort_array(F.collect_set(label)).alias("labels")))  # one row
    mark = lambda o: F.md5(F.concat(o, F.lit(":"), F.col(key).cast("string")))
    others = F.transform(F.filter("labels", lambda o: o != F.col(label)), lambda o: F.struct(mark(o).alias("m"), o.alias("o")))
    picked = F.transform(F.slice(F.sort_array(others), 1, n), lambda s: s["o"])
    out = rows.crossJoin(labels).select(F.col(key).alias("case_id"), F.col(label).alias("gold"), F.sort_array(F.array_append(picked, F.col(label))).alias("options"))
    return out.select("case_id", "options", (F.array_position("options", F.col("gold")) - 1).cast("int").alias("gold_idx"))


def rotated(rows: DataFrame, times: int) -> DataFrame:
    """case_id, k, options, gold_idx: every case under `times` rotations of its options."""
    k = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k")
    out = rows.select("case_id", "options", "gold_idx", k).withColumn("n", F.size("options"))
    turned = F.transform("options", lambda _, i: F.get(F.col("options"), (i + F.col("k")) % F.col("n")))
    return out.select("case_id", "k", turned.alias("options"), F.pmod(F.col("gold_idx") - F.col("k"), F.col("n")).cast("int").alias("gold_idx"))


def augmented(rows: DataFrame, decoys: list[str]) -> DataFrame:
    return rows.select("case_id", F.concat("options", _strings(decoys)).alias("options"), "gold_idx")


def null_twin(rows: DataFrame) -> DataFrame:
    """Is none of the options right? A yes or no twin of every case, whose answer is no."""
    return rows.select("case_id", F.lit("none").alias("qid"), F.lit("noul").alias("kind"), _strings(["yes", "no"]).alias("options"), F.lit(1).alias("gold_idx"))


def renamed(rows: DataFrame, to: dict[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    return rows.select("case_id", F.transform("options", lambda o: F.coalesce(F.element_at(names, o), o)).alias("options"), "gold_idx")


def exploded(rows: DataFrame) -> DataFrame:
    out = rows.select("case_id", "qid", "gold_idx", F.posexplode("options").alias("option_idx", "option"))
    return out.select("case_id", "qid", "option_idx", "option", (F.col("option_idx") == F.col("gold_idx")).cast("int").alias("is_gold"))


def dialogs(turns: DataFrame) -> DataFrame:
    """case_id, state (role: text lines in order), n_turns, n_user of every conversation."""
    line = F.concat("role", F.lit(": "), "text").alias("line")
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line))).alias("t"), F.count("*").alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"))
    return packed.select(F.col("conv_id").alias("case_id"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("state"), "n_turns", "n_user")


def json_number(rows: DataFrame, column: str, field: str) -> DataFrame:
    """A field of a JSON state as a whole number; rows without it are left out."""
    value = F.expr(f"try_cast(get_json_object({column}, '$.{field}') as bigint)")
    return rows.withColumn(field, value).where(F.col(field).isNotNull()).select(F.col("event_id").alias("case_id"), F.col("event_type").alias("qid"), field, "value")


def latencies(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, p50 (place n // 2), p99 (place ceil(.99 n) - 1), most, n: places in counts per distinct value."""
    each = rows.groupBy(by, F.col(x).alias("x")).agg(F.count("*").alias("c"))
    placed = running(each, "x", ["c"], (by,)).select("*", (F.col("c_upto") - 1).alias("last"), F.col("c_all").alias("n"))
    at = lambda p: F.max(F.when((p <= F.col("last")) & (p > F.col("last") - F.col("c")), F.col("x")))
    return placed.groupBy(by).agg(
        at(F.floor(F.col("n") / 2)).alias("p50"), at(F.ceil(F.col("n") * 0.99) - 1).alias("p99"), F.max("x").alias("most"), F.max("n").alias("n")
    )


def rungs(events: DataFrame, rung: int) -> DataFrame:
    """user_id, n, wins and wins among the first `rung` events, in order of time."""
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.withColumn("turn", turn).withColumn("ok", (F.col("event_type") == "purchase").cast("long"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("ok").alias("wins"), F.sum(F.when(F.col("turn") <= rung, F.col("ok")).otherwise(0)).alias("wins_8"))
