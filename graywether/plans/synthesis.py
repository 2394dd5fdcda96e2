"""Queries of synthesis: slots of lines, transplanted spans, budgets, extended corpora. A line is a text, its language the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.operators import synthesis
from graywether.plans.registry import query
from graywether.plans.texts import docs
from graywether.sources.steps import Workspace

SPLIT = r"[ \t\n\x0b\f\r]+"
SLOTS = f"""WITH ln AS (SELECT doc_id * 16777216 + i AS id, lang AS label, list_filter(regexp_split_to_array(l, '{SPLIT}'), lambda w: w <> '') AS words
        FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
    tx AS (SELECT label, words, min(id) AS id FROM ln WHERE len(words) > 0 GROUP BY label, words),
    sh AS (SELECT id, label, p, k, words, len(words) - p - k AS s FROM (SELECT *, unnest(range(len(words))) AS p FROM tx) JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON p + k <= len(words)),
    fr AS (SELECT id, label, p, s, lower(array_to_string(words[1:p], ' ')) AS h, lower(array_to_string(words[len(words) - s + 1:], ' ')) AS t, lower(words[p + 1]) AS first, lower(words[p + k]) AS last, array_to_string(words[p + 1:p + k], ' ') AS span FROM sh),
    ct AS (SELECT *, count(*) OVER w AS n FROM fr WINDOW w AS (PARTITION BY label, p, s, h, t)),
    sl AS (SELECT label, p, s, h, t, span, min(id) AS id FROM ct a WHERE n > 1 AND EXISTS (SELECT 1 FROM ct b WHERE b.n > 1 AND b.label = a.label AND b.p = a.p AND b.s = a.s AND b.h = a.h AND b.t = a.t AND b.first <> a.first AND b.last <> a.last) GROUP BY ALL)"""


def moved_sql(tried: int | None = None) -> str:
    """Frames with other spans of their label, all or the first `tried` of each."""
    pairs = "FROM fm JOIN sp USING (label) WHERE NOT list_contains(own, sp.span)"
    if tried is None:
        pairs = f"SELECT fm.*, sp.span {pairs}"
    else:
        pairs = f"SELECT * FROM (SELECT fm.*, sp.span, row_number() OVER (PARTITION BY label, p, s, h, t ORDER BY sp.span) AS m {pairs}) WHERE m <= {tried}"
    return SLOTS + f""", fm AS (SELECT label, p, s, h, t, min(id) AS src, list(span) AS own FROM sl GROUP BY ALL), sp AS (SELECT DISTINCT label, span FROM sl),
    tr AS ({pairs}),
    md AS (SELECT tr.label, src, p, len(string_split(span, ' ')) AS span_words, span, array_to_string(words[1:p], ' ') AS hd, array_to_string(words[len(words) - s + 1:], ' ') AS tl,
        array_to_string(words[1:p] || string_split(span, ' ') || words[len(words) - s + 1:], ' ') AS text FROM tr JOIN tx ON tx.id = src AND tx.label = tr.label),
    nw AS (SELECT * FROM md WHERE lower(text) NOT IN (SELECT lower(array_to_string(words, ' ')) FROM tx)),
    cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY label, hd, tl, span, text, src) AS r FROM nw) WHERE r = 1)"""


MOVED = moved_sql(synthesis.MOST_TRIED)  # of the queries that take few


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id"), F.col("lang").alias("label"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        (F.col("doc_id") * 16777216 + F.col("i")).alias("id"), "label", "text"
    )


@query(SLOTS + " SELECT label AS lang, p, s, span, id FROM sl")
def span_slots(spark, sf_dir):
    """Every span that a frame of two lines shows, with the words before and after it and the first line that shows it."""
    found, _ = synthesis.slots(lines(spark, sf_dir))
    return found.select(F.col("label").alias("lang"), F.col("p").cast("long").alias("p"), F.col("s").cast("long").alias("s"), "span", "id")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transplants of each frame's first spans."""
    rows = lines(spark, sf_dir)
    found, texts = synthesis.slots(rows)
    return Workspace(spark, "moved").save(synthesis.transplants(found, texts, rows, synthesis.MOST_TRIED), "cands")


@query(moved_sql() + " SELECT label AS lang, text, src, p, span_words FROM cd")
def span_transplants(spark, sf_dir):
    """Frames filled with all their language's other spans, less the lines there are."""
    rows = lines(spark, sf_dir)
    found, texts = synthesis.slots(rows)
    return synthesis.transplants(found, texts, rows).select(F.col("label").alias("lang"), "text", "src", F.col("p").cast("long").alias("p"), F.col("span_words").cast("long").alias("span_words"))


@query(MOVED + """, rm AS (SELECT label, least(count(*), 40) AS room FROM cd GROUP BY label), wt AS (SELECT label, room, coalesce(w, 0) AS w, floor(100 * coalesce(w, 0) / sum(coalesce(w, 0)) OVER ()) AS b FROM rm LEFT JOIN (SELECT lang AS label, count(*)::DOUBLE AS w FROM documents GROUP BY lang) USING (label)),
    bs AS (SELECT label, room, least(room, b) AS base FROM wt), lf AS (SELECT greatest(100 - sum(base), 0) AS more FROM bs),
    rd AS (SELECT label, row_number() OVER (ORDER BY r, label) AS place FROM (SELECT label, unnest(range(1, (room - base)::BIGINT + 1)) AS r FROM bs WHERE room > base)), gv AS (SELECT label, count(*) AS g FROM rd, lf WHERE place <= more GROUP BY label),
    sr AS (SELECT label, base + coalesce(g, 0) AS share FROM bs LEFT JOIN gv USING (label))
    SELECT label AS lang, text, src, r2 AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY text) AS r2 FROM cd) JOIN sr USING (label) WHERE r2 <= share""")
def synthesised_lines(spark, sf_dir):
    """A hundred new lines, shared out by the languages' documents, forty a language at most."""
    weights = docs(spark, sf_dir).groupBy(F.col("lang").alias("label")).agg(F.count("*").cast("double").alias("weight"))
    taken = synthesis.allotted(moved(spark, sf_dir), weights, 100, 40)
    return taken.select(F.col("label").alias("lang"), "text", "src", F.col("place").cast("long").alias("place"))


@query(MOVED + """, tr1 AS (SELECT label, array_to_string(words, ' ') AS text, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM tx), ex AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY text) AS r FROM cd),
    al AS (SELECT label, text, 'train' AS origin FROM tr1 WHERE r <= 20 UNION ALL SELECT label, text, 'extra' FROM ex WHERE r <= 10)
    SELECT label AS lang, text, origin FROM al UNION ALL SELECT 'it', 'it', 'fallback'""")
def extended_corpus(spark, sf_dir):
    """Twenty lines a language and ten new ones; Italian has none."""
    rows = lines(spark, sf_dir)
    words = synthesis.normal_words(F.col("text"))
    train = rows.select("label", words.alias("words"), "id").where(F.size("words") > 0).groupBy("label", "words").agg(F.min("id").alias("id"))
    train = train.select("id", "label", F.array_join("words", " ").alias("text"))
    labels = rows.select("label").distinct().union(spark.range(1).select(F.lit("it").alias("label")))
    extra = moved(spark, sf_dir).select(F.col("text").alias("id"), "label", "text")
    return synthesis.extended(train, extra, labels, 20, 10).withColumnRenamed("label", "lang")
