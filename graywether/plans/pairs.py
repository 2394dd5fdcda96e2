"""Queries of the sentence-pair view and of option-conditioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graywether.functions import text as T
from graywether.operators import bayes, options, pairs
from graywether.plans.cases import LANGS
from graywether.plans.lanes import r6
from graywether.plans.registry import query
from graywether.plans.texts import FOLDS, HASHES, STEP, TOKENS, docs
from graywether.sources.steps import Workspace

BYTES = "list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INT, 2))::INT)"
EIGHT = "list_transform(range(0, 8), lambda i: (({0} >> (8 * i)::UBIGINT) & 255::UBIGINT)::INT)"
FOLD = "(CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END)::UBIGINT"


def fnv(raw: str, salt: int) -> str:
    """DuckDB SQL of the salted hash of a list of bytes."""
    return f"list_reduce(list_prepend({T.FNV_OFFSET ^ salt}::UBIGINT, list_transform({raw}, lambda b: {FOLD})), {STEP})"


NEGATES = f"lower(w) IN {T.NEGATIONS} OR (length(w) > 3 AND regexp_matches(w, 'n[''\"][tT]$'))"
CONTEXT_TEXT = "CASE WHEN len(l) > 8 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:len(l) - 1], chr(10)) END"
PAIRS = HASHES + f""",
    lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
    two AS (SELECT doc_id, {TOKENS.replace('(text,', '(h,')} AS hw, {TOKENS.replace('(text,', '(c,')} AS cw FROM (SELECT doc_id, l[least(len(l), 8)] AS h, {CONTEXT_TEXT} AS c FROM lines WHERE len(l) > 1)),
    lw AS (SELECT doc_id, unnest(hw) AS w, unnest(range(len(hw))) AS pos FROM two), cx AS (SELECT doc_id, unnest(cw) AS w FROM two),
    pvoc AS (SELECT w, {fnv(BYTES.format('w'), pairs.SALT_LAST)} AS h, {fnv(BYTES.format('w'), pairs.SALT_NEW)} AS g FROM (SELECT w FROM lw UNION SELECT w FROM cx)),
    lh AS (SELECT doc_id, pos, w, h, g, lag(h) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM lw JOIN pvoc USING (w)),
    lp AS (SELECT p, h, {fnv(f"list_concat({EIGHT.format('p')}, {EIGHT.format('h')})", pairs.SALT_LAST_PAIR)} AS q FROM (SELECT DISTINCT p, h FROM lh WHERE p IS NOT NULL)),
    known AS (SELECT DISTINCT doc_id, g % {pairs.CONTEXT} AS k FROM cx JOIN pvoc USING (w)),
    covered AS (SELECT lh.*, k IS NOT NULL AS old FROM lh LEFT JOIN known ON known.doc_id = lh.doc_id AND k = g % {pairs.CONTEXT}),
    ln AS (SELECT doc_id, count(*) AS n, sum(old::INT) AS c, bool_or({NEGATES}) AS neg FROM covered GROUP BY doc_id), cn AS (SELECT doc_id, bool_or({NEGATES}) AS neg FROM cx GROUP BY doc_id),
    marks AS (SELECT doc_id, unnest(['cov' || (coalesce(c, 0) * 5 // greatest(coalesce(n, 0), 1)), 'len' || least(coalesce(n, 0) // 4, 5), 'neg' || (2 * coalesce(cn.neg, false)::INT + coalesce(ln.neg, false)::INT)]) AS m FROM two LEFT JOIN ln USING (doc_id) LEFT JOIN cn USING (doc_id)),
    mh AS (SELECT m, {fnv(BYTES.format('m'), pairs.SALT_MARK)} AS h FROM (SELECT DISTINCT m FROM marks)),
    pe AS (SELECT doc_id, (h % {T.BUCKETS})::INT AS tok FROM (SELECT doc_id, h FROM lh UNION ALL SELECT doc_id, q FROM lh JOIN lp USING (p, h) UNION ALL SELECT doc_id, g FROM covered WHERE NOT old
        UNION ALL SELECT doc_id, h FROM marks JOIN mh USING (m) UNION ALL SELECT doc_id, h FROM ev WHERE doc_id NOT IN (SELECT doc_id FROM two)))"""

PLACED = f"placed AS (SELECT doc_id, lang, source, coalesce(doc_id % {FOLDS}, 0)::INT AS fold FROM documents), folds AS (SELECT unnest(range({FOLDS}))::INT AS fold)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, fold, toks, times, runs, n of every document in the pair view, written once. A null id is in fold 0."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).cast("int").alias("fold")
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), fold, "text")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # one file may hold most of the texts
    return Workspace(spark, "paired").save(pairs.view_rows(dealt, ["doc_id", "label", "fold"], "pair"), "rows")


@query(f"WITH {PAIRS}, t AS (SELECT doc_id, tok, count(*) AS n FROM pe GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS n_events, count(*) AS n_buckets, sum(n * tok)::BIGINT AS bucket_sum, max(n)::INT AS most FROM t GROUP BY doc_id")
def pair_view_events(spark, sf_dir):
    """Of every document with events: their number, that of their buckets, the buckets' sum, the most frequent one's count."""
    rows = pairs.view_rows(docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"], "pair").where("n > 0")
    summed = F.aggregate(F.zip_with("toks", "times", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.col("n").alias("n_events"), F.size("toks").cast("long").alias("n_buckets"), summed.alias("bucket_sum"), F.array_max("times").alias("most"))


@query(f"WITH {PAIRS}, {PLACED}" + f""", te AS (SELECT p.doc_id, p.lang, p.fold, tok FROM pe JOIN placed p USING (doc_id)),
    cnt AS (SELECT folds.fold, lang, tok, count(*) AS n_in FROM te JOIN folds ON te.fold <> folds.fold GROUP BY ALL), allt AS (SELECT fold, tok, sum(n_in) AS n_all FROM cnt GROUP BY ALL),
    obs AS (SELECT fold, count(*)::DOUBLE AS m FROM allt GROUP BY fold), sz AS (SELECT fold, lang, sum(n_in) AS size_in FROM cnt GROUP BY ALL), sa AS (SELECT fold, sum(size_in) AS size_all FROM sz GROUP BY fold),
    odds AS (SELECT fold, z.lang AS domain, t.tok, log2((coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (z.size_in + m)) - log2((t.n_all - coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (sa.size_all - z.size_in + m)) AS score
        FROM allt t JOIN sz z USING (fold) JOIN sa USING (fold) JOIN obs USING (fold) LEFT JOIN cnt c USING (fold, lang, tok))
    SELECT te.doc_id, o.domain AS lang, round(sum(o.score), 6) AS score, count(*) AS seen FROM te JOIN odds o USING (fold, tok) GROUP BY ALL""")
def pair_view_scores(spark, sf_dir):
    """Every document's score for every language in the pair view, under observed smoothing, by the folds it isn't in."""
    rows = paired(spark, sf_dir)
    counts = Workspace(spark, "pair_view").save(bayes.fold_counts(rows), "counts")
    found = bayes.scores(rows, counts, ["doc_id"], alpha=None)
    return r6(found.select("doc_id", "seen", F.inline("scores")).select("doc_id", F.col("label").alias("lang"), "score", "seen"))


#: Folds by hash: by remainder, all rows of a source could be in one.
HASHED = PLACED.replace(f"coalesce(doc_id % {FOLDS}, 0)::INT", f"coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % {FOLDS}, 0)::INT")
OPTIONS = f"WITH {HASHES}, {HASHED}" + f""", oe AS (SELECT p.doc_id, p.lang, p.source, p.fold, (e.h % {T.BUCKETS})::INT AS tok FROM ev e JOIN placed p USING (doc_id)),
    cnt AS (SELECT folds.fold, source, lang, tok, count(*) AS n_in FROM oe JOIN folds ON oe.fold <> folds.fold GROUP BY ALL), obs AS (SELECT fold, count(DISTINCT tok)::DOUBLE AS m FROM cnt GROUP BY fold),
    allt AS (SELECT fold, source, tok, sum(n_in) AS n_all FROM cnt GROUP BY ALL), sz AS (SELECT fold, source, lang, sum(n_in) AS size_in FROM cnt GROUP BY ALL), sa AS (SELECT fold, source, sum(size_in) AS size_all FROM sz GROUP BY ALL),
    odds AS (SELECT fold, source, z.lang AS opt, t.tok, log2((coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (z.size_in + m)) - log2((t.n_all - coalesce(c.n_in, 0) + m / {T.BUCKETS}) / (sa.size_all - z.size_in + m)) AS score
        FROM allt t JOIN sz z USING (fold, source) JOIN sa USING (fold, source) JOIN obs USING (fold) LEFT JOIN cnt c USING (fold, source, lang, tok)),
    got AS (SELECT oe.doc_id, o.opt, sum(o.score) AS score FROM oe JOIN odds o USING (fold, source, tok) GROUP BY ALL), ne AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY doc_id),
    sc AS (SELECT p.doc_id, p.source AS qid, z.lang AS opt, coalesce(got.score, 0) AS score, coalesce(n, 0) AS n FROM placed p JOIN sz z ON z.fold = p.fold AND z.source = p.source LEFT JOIN got ON got.doc_id = p.doc_id AND got.opt = z.lang
        LEFT JOIN ne ON ne.doc_id = p.doc_id WHERE z.lang IN {tuple(LANGS)}),
    tm AS (SELECT a.doc_id, a.qid, a.opt, a.score, CASE WHEN n = 0 THEN 0.5 ELSE 1 / (1 + exp(-(a.score - coalesce((SELECT max(b.score) FROM sc b WHERE b.doc_id = a.doc_id AND b.opt <> a.opt), 0)) / n)) END AS term FROM sc a)"""


def optioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gold, qid, options, n, scores, terms: the language of every document as a question that its source asks."""
    fold = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % FOLDS, F.lit(0)).alias("fold")
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("option"), F.col("source").alias("qid"), fold, "text")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    ws = Workspace(spark, "optioned")
    cells = ws.save(pairs.view_rows(dealt, ["doc_id", "option", "qid", "fold"], "bag").drop("runs"), "rows")
    counts = ws.save(options.fold_counts(cells), "counts")
    asked = cells.withColumn("options", F.array(*map(F.lit, LANGS))).withColumnRenamed("option", "gold")
    return options.scores(asked, counts, ["doc_id", "gold"], FOLDS, written=True)


@query(OPTIONS + " SELECT doc_id, qid, opt AS option, round(score, 6) AS score, round(term, 6) AS term FROM tm")
def option_conditioned_scores(spark, sf_dir):
    """Score and blend term of every offered option that the source's other folds have answered."""
    long = optioned(spark, sf_dir).select("doc_id", "qid", F.inline(F.arrays_zip(F.col("options").alias("option"), F.col("scores").alias("score"), F.col("terms").alias("term"))))
    return r6(long.where("score is not null"))


@query(OPTIONS + """, b AS (SELECT doc_id, first(opt ORDER BY round(term, 9) DESC, opt) AS pick, max(term) AS best FROM tm GROUP BY doc_id)
    SELECT p.doc_id, p.lang AS gold, pick, round(best, 6) AS term, coalesce((pick = p.lang)::INT, 0) AS ok FROM placed p LEFT JOIN b USING (doc_id)""")
def option_conditioned_picks(spark, sf_dir):
    """The option with the largest term for every document; none where its source has no tables."""
    scored = optioned(spark, sf_dir).withColumn("terms", F.transform("terms", lambda t: F.round(t, 9)))
    found = scored.select("doc_id", "gold", options.picks(scored).alias("pick"), F.round(F.array_max("terms"), 6).alias("term"))
    return found.withColumn("ok", F.coalesce((F.col("pick") == F.col("gold")).cast("int"), F.lit(0)))
