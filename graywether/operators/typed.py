"""Typed decisions: rows whose questions and gold answers are JSON maps, taken apart question by question.

A row without a workflow, a state or readable maps is kept as one line with its reason; a question that can't be asked or
has no gold answer keeps its line too, so what is skipped is counted and not lost. Questions keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("choice", "noul", "score")


def _kind_of(json: Column, path: str) -> Column:
    """The type of what stands at a path of a JSON text, in SQL terms; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def _shown(json: Column, path: str) -> Column:
    """What stands at a path as text: strings as they are, null as None, numbers and booleans as JSON."""
    return F.when(_kind_of(json, path) == "VOID", "None").otherwise(F.get_json_object(json, path))


def options(json: Column) -> Column:
    """A choice question's options in order: the criteria's keys, or its elements as text."""
    criteria = F.get_json_object(json, "$.criteria")
    listed = F.from_json(criteria, "array<string>")
    return F.when(_kind_of(json, "$.criteria").startswith("ARRAY"), F.transform(listed, lambda x: F.coalesce(x, F.lit("None")))).otherwise(F.json_object_keys(criteria))


def exploded(rows: DataFrame) -> DataFrame:
    """id, workflow, pos, qid, kind, instructions, options, gold_idx, soft, gold_score, status of rows (id, workflow, state, questions,
    gold: texts). status is ok, or what is missing: row (with qid null), gold, kind, instructions or answer."""
    read = rows.select("id", "workflow", "state", F.from_json("questions", "map<string,string>").alias("q"), F.from_json("gold", "map<string,string>").alias("g"))
    sound = F.col("workflow").isNotNull() & F.col("state").isNotNull() & F.col("q").isNotNull() & F.col("g").isNotNull()
    long = read.withColumn("sound", sound).select("id", "workflow", "sound", F.when(F.col("sound"), F.col("g")).alias("g"), F.posexplode_outer(F.when(F.col("sound"), F.col("q"))).alias("pos", "qid", "d"))
    long = long.where("not sound or qid is not null")
    long = long.withColumn("a", F.element_at("g", F.col("qid"))).withColumn("kind", F.get_json_object("d", "$.type"))
    long = long.withColumn("opts", F.when(F.col("kind") == "choice", options(F.col("d"))).when(F.col("kind") == "noul", F.array(F.lit("false"), F.lit("true"))))
    levels = F.from_json(F.get_json_object("d", "$.criteria"), "array<string>")
    is_list = _kind_of(F.col("d"), "$.criteria").startswith("ARRAY")
    long = long.withColumn("opts", F.when((F.col("kind") == "score") & is_list, F.transform(levels, lambda _, i: i.cast("string"))).otherwise(F.col("opts")))
    long = long.withColumn("label", _shown(F.col("a"), "$.label")).withColumn("probs", F.from_json(F.get_json_object("a", "$.probabilities"), "map<string,string>"))
    number = lambda path: F.expr(f"try_cast(get_json_object(a, '{path}') as double)")
    p_true = F.coalesce(F.expr("try_cast(element_at(probs, 'true') as double)"), number("$.noul"), F.lit(0.5))
    at = F.array_position("opts", F.col("label")) - 1
    level = F.expr("case when trim(label) rlike '^[+-]?[0-9]+$' then try_cast(trim(label) as int) end")
    idx = (
        F.when(F.col("kind") == "choice", F.when(at >= 0, at))
        .when(F.col("kind") == "noul", F.when(F.col("label").isNotNull(), (F.lower("label") == "true").cast("int")))
        .when((F.col("kind") == "score") & F.col("opts").isNotNull(), F.when(level >= 0, level))
    )
    long = long.withColumn("gold_idx", idx.cast("int"))
    soft = F.when(F.col("kind") == "noul", F.array(1 - p_true, p_true)).otherwise(F.transform("opts", lambda o: F.coalesce(F.element_at("probs", o).try_cast("double"), F.lit(0.0))))
    status = (
        F.when(~F.col("sound"), "row")
        .when(F.col("a").isNull(), "gold")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(F.coalesce(_kind_of(F.col("d"), "$.instructions"), F.lit("")) != "STRING", "instructions")
        .when(F.col("gold_idx").isNull(), "answer")
        .otherwise("ok")
    )
    long = long.withColumn("status", status)
    ok = F.col("status") == "ok"
    keep = lambda c: F.when(ok, c)
    score = keep(F.when(F.col("kind") == "score", F.coalesce(number("$.score"), F.col("label").try_cast("double"))))
    return long.select(
        "id", "workflow", "pos", "qid", keep(F.col("kind")).alias("kind"), keep(F.get_json_object("d", "$.instructions")).alias("instructions"), keep(F.col("opts")).alias("options"),
        keep(F.col("gold_idx")).alias("gold_idx"), keep(soft).alias("soft"), score.alias("gold_score"), "status",
    )


def validity(questions: DataFrame) -> DataFrame:
    """status, n of exploded questions."""
    return questions.groupBy("status").agg(F.count("*").alias("n"))


def responses(answers: DataFrame) -> DataFrame:
    """id, response: a case's answers (id, pos, qid, kind, options, probs, pick, confidence, abstained, reason) as JSON, in order. An abstained
    answer has no outcome; a noul question shows the probability of yes alone."""
    probs = F.when(F.col("kind") == "noul", F.slice("probs", 2, 1)).otherwise(F.col("probs"))
    outcome = F.when(F.col("abstained") == 0, F.get("options", F.col("pick")))
    answer = F.struct(F.col("qid").alias("question_id"), outcome.alias("outcome"), probs.alias("probabilities"), "confidence")
    packed = answers.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", answer.alias("a"), "reason"))).alias("x"))  # a case's questions
    body = F.struct(F.transform("x", lambda x: x["a"]).alias("answers"), F.transform("x", lambda x: x["reason"]).alias("routing"))
    return packed.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))
