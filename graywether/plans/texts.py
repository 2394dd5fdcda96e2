"""Queries over texts: tokens, hashes, normal forms, leak scans, slices, count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.functions import text as T
from graywether.operators import bayes, events, features, leaks, ranking, slices
from graywether.plans.lanes import r6
from graywether.plans.registry import query
from graywether.sources.steps import Workspace
from graywether.sources.tables import table

# DuckDB forms of the text functions
TOKENS = "list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda t: regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda t: t <> '')"
NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"
RUNS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
NLI = RUNS.format("regexp_replace(lower({0}), 'n''t', ' not', 'g')")
STEP = "lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
HASHES = f"""
    tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, {TOKENS} AS ws FROM documents)),
    vocab AS (SELECT w, list_reduce(list_prepend({T.FNV_OFFSET ^ T.WORD_SALT}::UBIGINT, list_transform(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::INT),
        lambda b: (CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END)::UBIGINT)), {STEP}) AS h FROM (SELECT DISTINCT w FROM tok)),
    hashed AS (SELECT doc_id, pos, h FROM tok JOIN vocab USING (w)),
    pairs AS (SELECT doc_id, pos, lag(h) OVER (PARTITION BY doc_id ORDER BY pos) AS p, h FROM hashed),
    pv AS (SELECT p, h, list_reduce(list_prepend({T.FNV_OFFSET ^ T.BIGRAM_SALT}::UBIGINT, list_transform(list_concat(list_transform(range(0, 8), lambda i: ((p >> (8 * i)::UBIGINT) & 255::UBIGINT)),
        list_transform(range(0, 8), lambda i: ((h >> (8 * i)::UBIGINT) & 255::UBIGINT))), lambda b: (CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END)::UBIGINT)), {STEP}) AS g FROM (SELECT DISTINCT p, h FROM pairs WHERE p IS NOT NULL)),
    ev AS (SELECT doc_id, pos, h, false AS is_bigram FROM hashed UNION ALL SELECT doc_id, pos, g, true FROM pairs JOIN pv USING (p, h))"""
H = "WITH " + HASHES


FOLDS = 5


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len(ws)::BIGINT AS n_tokens, len(list_distinct(ws))::BIGINT AS n_distinct FROM (SELECT doc_id, {TOKENS} AS ws FROM documents)")
def tokens_per_doc(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(T.tokens(F.col("text")))).alias("ws"))
    return rows.select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"))


@query(H + " SELECT doc_id, (h % 131072)::INT AS bucket, count(*) AS n FROM hashed GROUP BY ALL")
def token_hash_buckets(spark, sf_dir):
    ev = events.token_events(docs(spark, sf_dir)).where("not is_bigram")
    return ev.groupBy("doc_id", F.col("h").bitwiseAND(F.lit(T.BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query(H + " SELECT doc_id, count(*) AS n, sum((h % 131072)::BIGINT)::BIGINT AS bucket_sum, sum((h >= 9223372036854775808)::INT)::BIGINT AS n_top_bit FROM ev WHERE is_bigram GROUP BY doc_id")
def bigram_events(spark, sf_dir):
    ev = events.token_events(docs(spark, sf_dir)).where("is_bigram")
    bucket = F.col("h").bitwiseAND(F.lit(T.BUCKETS - 1))
    return ev.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(bucket).alias("bucket_sum"), F.sum((F.col("h") < 0).cast("long")).alias("n_top_bit"))


@query(H + """, b AS (SELECT doc_id, (h % 256)::INT AS bucket, sum((CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) * (CASE WHEN is_bigram THEN 0.5 ELSE 1 END))::DOUBLE AS w FROM ev GROUP BY ALL)
    SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM b WHERE w <> 0""")
def hashed_embedding(spark, sf_dir):
    rows = docs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", "text")
    long = features.embedded(rows, ["doc_id"]).select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return r6(long.where("weight <> 0"))


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def leak_normaliser(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.leak_normal(F.col("text")).alias("normal"))


@query(f"WITH r AS (SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents), m AS (SELECT normal, min(doc_id) AS twin_id FROM r GROUP BY normal) SELECT doc_id AS query_id, twin_id FROM r JOIN m USING (normal) WHERE doc_id > twin_id")
def leak_exact_twins(spark, sf_dir):
    """Every document whose normal form an earlier one has, with the first of those."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return leaks.exact_twins(rows, rows).where("query_id > twin_id")


@query(f"""WITH p AS (SELECT DISTINCT item_id, substr(n, i::INT, 12) AS g FROM (SELECT item_id, n, unnest(range(1, greatest(length(n) - 11, 1) + 1)) AS i FROM (SELECT item_id, {NORMAL.format('text')} AS n FROM benchmark) WHERE n <> '')),
    rare AS (SELECT g FROM p GROUP BY g HAVING count(*) < 200), posts AS (SELECT p.* FROM p JOIN rare USING (g)), size AS (SELECT item_id, count(*) AS size FROM posts GROUP BY item_id),
    q AS (SELECT DISTINCT doc_id, substr(n, i::INT, 12) AS g FROM (SELECT doc_id, n, unnest(range(1, greatest(length(n) - 11, 1) + 1)) AS i FROM (SELECT doc_id, {NORMAL.format('text')} AS n FROM documents) WHERE n <> '')),
    m AS (SELECT doc_id AS query_id, item_id AS ref_id, count(*) AS shared FROM q JOIN posts USING (g) GROUP BY ALL)
    SELECT query_id, ref_id, shared, round(shared / size, 6) AS contained FROM m JOIN size ON item_id = ref_id WHERE shared / size >= 0.5""")
def leak_near_twins(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return r6(leaks.near_twins(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), bench, k=12, rare_cap=200, least=0.5))


# every conversation's later turns against all first turns; grams of 8 characters, as the texts are long
FIRST = f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, role AS label, turn - min(turn) OVER (PARTITION BY conv_id) AS place, {NORMAL.format("coalesce(text, '')")} AS n FROM conversations),
    rf AS (SELECT n, min(id) AS id FROM a WHERE place = 0 GROUP BY n), q AS (SELECT id, label, n FROM a WHERE place > 0), qd AS (SELECT DISTINCT n FROM q WHERE n NOT IN (SELECT n FROM rf)),
    gr AS (SELECT n, CASE WHEN n = '' THEN [''] ELSE list_distinct(list_transform(range(1, greatest(length(n) - 7, 1) + 1), lambda i: substr(n, i::INT, 8))) END AS g FROM (SELECT n FROM rf UNION SELECT n FROM qd)),
    ps AS (SELECT id AS ref_id, unnest(g) AS gram FROM rf JOIN gr USING (n)), rr AS (SELECT gram FROM ps GROUP BY gram HAVING count(*) < 50),
    sh AS (SELECT n, ref_id, count(*) AS shared FROM (SELECT n, unnest(g) AS gram FROM qd JOIN gr USING (n)) JOIN ps USING (gram) JOIN rr USING (gram) GROUP BY ALL),
    tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY shared DESC, ref_id) AS place FROM sh) WHERE place <= 5),
    jc AS (SELECT tp.n, ref_id, place, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS j FROM tp JOIN gr a ON a.n = tp.n JOIN rf ON rf.id = ref_id JOIN gr b ON b.n = rf.n),
    bs AS (SELECT n, first(ref_id ORDER BY j DESC, place) AS near_id, max(j) AS j FROM jc GROUP BY n),
    cl AS (SELECT q.id, q.label, CASE WHEN rf.id IS NOT NULL THEN 'exact' WHEN j >= 0.25 THEN 'near' ELSE 'clean' END AS kind, coalesce(rf.id, CASE WHEN j >= 0.25 THEN near_id END) AS ref_id,
        CASE WHEN rf.id IS NOT NULL THEN 1 ELSE coalesce(j, 0) END AS jaccard FROM q LEFT JOIN rf USING (n) LEFT JOIN bs USING (n))"""
FIRST_LAW = leaks.Law(k=8, near=0.25, rare_cap=50, top=5)


def first_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Later turns, and first turns: id, label (the role), text."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    rows = rows.join(first, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("label"), "text", (F.col("turn") > F.col("first")).alias("later"))
    return rows.where("later").drop("later"), rows.where("not later").drop("later")


@query(FIRST + " SELECT id, kind, ref_id, round(jaccard, 6) AS jaccard FROM cl")
def leak_classes(spark, sf_dir):
    return r6(leaks.classify(*first_turns(spark, sf_dir), FIRST_LAW))


@query(FIRST + """ SELECT (SELECT count(*) FROM a WHERE place = 0) AS reference, count(*) AS query, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'exact' AND r.label IS DISTINCT FROM cl.label) AS exact_label_conflict,
    count(*) FILTER (kind = 'near') AS near, count(*) FILTER (kind <> 'exact') AS near_scanned, count(*) FILTER (kind = 'near' AND r.label IS NOT DISTINCT FROM cl.label) AS near_same_label FROM cl LEFT JOIN a r ON r.id = ref_id""")
def leak_class_tallies(spark, sf_dir):
    later, first = first_turns(spark, sf_dir)
    return leaks.tallies(leaks.classify(later, first, FIRST_LAW), later, first)


TURNS = "t AS (SELECT conv_id, turn, text AS hypothesis, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS premise FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns as premise and hypothesis."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("hypothesis"), F.lag("text").over(w).alias("premise"))
    return rows.where("premise is not null")


HAS = "(list_contains({0}s, '{2}') AND list_contains({1}s, '{3}'))"
OPPOSED = " + ".join(f"({HAS.format('p', 'h', a, b)} OR {HAS.format('p', 'h', b, a)})::INT" for a, b in T.ANTONYMS)
DENIED = " + ".join(f"len(list_filter({x}s, lambda w: length(w) >= 3 AND list_contains({y}s, '{pre}' || w)))" for pre in T.NLI_PREFIXES for x, y in ("ph", "hp"))


@query(f"""WITH {TURNS}, k AS (SELECT conv_id, turn, {NLI.format('premise')} AS p, {NLI.format('hypothesis')} AS h FROM t WHERE premise IS NOT NULL),
    s AS (SELECT *, list_distinct(p) AS ps, list_distinct(h) AS hs FROM k),
    i AS (SELECT *, len(list_intersect(ps, hs)) AS shared, len(list_filter(p, lambda x: x IN {T.NLI_NEGATIONS})) AS np, len(list_filter(h, lambda x: x IN {T.NLI_NEGATIONS})) AS nh,
        list_filter(ps, lambda x: regexp_matches(x, '^[0-9]+$')) AS dp, list_filter(hs, lambda x: regexp_matches(x, '^[0-9]+$')) AS dh FROM s)
    SELECT conv_id, turn, round(shared / greatest(len(ps) + len(hs) - shared, 1), 6)::DOUBLE AS jaccard, round(shared / greatest(len(hs), 1), 6)::DOUBLE AS contained, round(len(h) / greatest(len(p), 1), 6)::DOUBLE AS length_ratio,
    least(nh, 3)::DOUBLE AS neg_hypothesis, least(np, 3)::DOUBLE AS neg_premise, least(abs(nh - np), 3)::DOUBLE AS neg_diff, len(list_intersect(dp, dh))::DOUBLE AS numbers_shared,
    len(list_filter(dh, lambda x: NOT list_contains(dp, x)))::DOUBLE AS numbers_new, least({DENIED}, 3)::DOUBLE AS denied, least({OPPOSED}, 3)::DOUBLE AS opposed FROM i""")
def nli_pair_features(spark, sf_dir):
    """The ten features of every turn and the one before it."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", T.nli_tokens(F.col("premise")).alias("p"), T.nli_tokens(F.col("hypothesis")).alias("h"))
    return r6(rows.select("conv_id", "turn", *T.nli_features(F.col("p"), F.col("h"))))


PLAIN = RUNS.format("replace(text, chr(39), '')")


@query(f"""WITH r AS (SELECT doc_id, {PLAIN} AS ws FROM documents)
    SELECT doc_id, len(ws)::INT AS n_tokens, (CASE WHEN len(ws) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END)::INT AS n_trigrams FROM r""")
def hygiene_trigrams(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(T.hygiene_tokens(F.col("text")))).alias("ws"))
    return rows.select("doc_id", F.size("ws").alias("n_tokens"), F.size(T.word_grams(F.col("ws"), 3)).alias("n_trigrams"))


@query(f"SELECT doc_id, array_to_string(({RUNS.format('text')})[1:4], ' ') AS bucket FROM documents")
def input_buckets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.input_bucket(F.col("text")).alias("bucket"))


@query(f"SELECT doc_id, len(list_filter({TOKENS}, lambda t: lower(t) IN {T.NEGATIONS} OR (length(t) > 3 AND regexp_matches(t, 'n[''\"][tT]$'))))::INT AS n_negations FROM documents")
def negations(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(T.tokens(F.col("text")), T.is_negation)).alias("n_negations"))


@query("SELECT trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_keys(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(T.dedup_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, min(doc_id) OVER (PARTITION BY lang) AS label_first FROM documents)"


@query(f"WITH {PLACED} SELECT doc_id, lang, place::INT AS place FROM placed ORDER BY place, label_first LIMIT 60")
def stratified_round_robin(spark, sf_dir):
    return slices.round_robin(docs(spark, sf_dir), "lang", "doc_id", 60).select("doc_id", "lang", "place")


@query(f"WITH {PLACED} SELECT doc_id, lang, (place % 5)::INT AS fold FROM placed")
def stratified_folds(spark, sf_dir):
    return slices.folds(docs(spark, sf_dir), "lang", "doc_id", 5).select("doc_id", "lang", "fold")


@query(f"WITH {PLACED} SELECT doc_id, lang FROM placed WHERE place < 25")
def per_label_cap(spark, sf_dir):
    return slices.per_label(docs(spark, sf_dir), "lang", "doc_id", 25).select("doc_id", "lang")


SLICED = PLACED + ", sliced AS (SELECT *, CASE WHEN place < 30 THEN 'cal' WHEN place < 60 THEN 'test' ELSE 'pool' END AS slice FROM placed)"


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.split_three(docs(spark, sf_dir), "lang", "doc_id", 30, 30)


@query(f"WITH {SLICED} SELECT slice, lang, count(*) AS n FROM sliced GROUP BY ALL")
def stratified_split(spark, sf_dir):
    return sliced(spark, sf_dir).groupBy("slice", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {SLICED}, k AS (SELECT DISTINCT slice, {NORMAL.format('text')} AS k FROM sliced) SELECT a.slice AS a, b.slice AS b, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.slice < b.slice GROUP BY ALL")
def slice_overlap_audit(spark, sf_dir):
    return slices.overlaps(leaks.digests(sliced(spark, sf_dir), ["slice"]), F.col("digest"))


@query(f"WITH r AS (SELECT doc_id, lang, coalesce(doc_id % 5, 0) AS fold, {NORMAL.format('text')} AS k FROM documents), m AS (SELECT k FROM r GROUP BY k HAVING count(DISTINCT fold) > 1) SELECT doc_id, lang FROM r WHERE k NOT IN (SELECT k FROM m)")
def known_text_removal(spark, sf_dir):
    """The documents whose normal form no other fold of five has."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).alias("fold")
    rows = docs(spark, sf_dir).select("doc_id", "lang", fold, T.leak_normal(F.col("text")).alias("k"))
    known = rows.groupBy("k").agg((F.min("fold") != F.max("fold")).alias("known")).where("known").select("k")
    return rows.join(known, "k", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def first_n_sample(spark, sf_dir):
    return docs(spark, sf_dir).orderBy("doc_id").limit(50).select("doc_id", "n_chars")


@query("SELECT least(9, floor(n_chars / 20001.0 * 10))::INT AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf_dir):
    """Longer documents are in the last bin."""
    x = docs(spark, sf_dir).select(F.least(F.col("n_chars") / 20001.0, F.lit(1.0)).alias("x"))
    return ranking.histogram(x, 10).where("n > 0").select("bin", "n")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def modal_tables(spark, sf_dir):
    return slices.modal(docs(spark, sf_dir), ["source"], "lang").select("source", "lang", "n")


@query(f"""WITH b AS (SELECT doc_id, lang, coalesce(doc_id % 5, 0) AS fold, array_to_string(({RUNS.format('text')})[1:1], ' ') AS bucket FROM documents), f AS (SELECT DISTINCT fold FROM b),
    m AS (SELECT fold, bucket, lang FROM (SELECT f.fold, bucket, lang, row_number() OVER (PARTITION BY f.fold, bucket ORDER BY count(*) DESC, lang) AS r FROM b JOIN f ON b.fold <> f.fold GROUP BY f.fold, bucket, lang) WHERE r = 1),
    g AS (SELECT fold, lang FROM (SELECT f.fold, lang, row_number() OVER (PARTITION BY f.fold ORDER BY count(*) DESC, lang) AS r FROM b JOIN f ON b.fold <> f.fold GROUP BY f.fold, lang) WHERE r = 1)
    SELECT doc_id, b.lang AS gold, coalesce(m.lang, g.lang) AS pick FROM b LEFT JOIN g USING (fold) LEFT JOIN m ON m.fold = b.fold AND m.bucket = b.bucket""")
def modal_floor_lookup(spark, sf_dir):
    """Every document's language by the most frequent one of its first word, or of all rows, in the folds it isn't in."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).cast("int").alias("fold")
    rows = docs(spark, sf_dir).select("doc_id", "lang", fold, F.coalesce(F.array_join(F.slice(T.runs(F.col("text")), 1, 1), " "), F.lit("")).alias("bucket"))
    counts = rows.groupBy("fold", "bucket", "lang").agg(F.count("*").alias("n_in"))
    others = events.other_folds(counts.withColumnRenamed("bucket", "tok"), "lang", "fold", FOLDS)

    def most(by: list[str], name: str) -> DataFrame:
        sums = others.groupBy(*by, "lang").agg(F.sum("n_in").alias("n"))
        return sums.groupBy(*by).agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias(name))

    keyed = most(["fold", "tok"], "keyed").withColumnRenamed("tok", "bucket")
    found = rows.join(keyed, ["fold", "bucket"], "left").join(most(["fold"], "overall"), "fold", "left")
    return found.select("doc_id", F.col("lang").alias("gold"), F.coalesce("keyed", "overall").alias("pick"))


NB = f"WITH {SLICED}, {HASHES}" + """,
    pe AS (SELECT s.lang, (e.h % 131072)::INT AS tok FROM ev e JOIN sliced s USING (doc_id) WHERE s.slice = 'pool'),
    cnt AS (SELECT lang, tok, count(*) AS n_in FROM pe GROUP BY ALL), allt AS (SELECT tok, sum(n_in) AS n_all FROM cnt GROUP BY tok), sz AS (SELECT lang, sum(n_in) AS size_in FROM cnt GROUP BY lang),
    odds AS (SELECT z.lang, t.tok, coalesce(c.n_in, 0) AS n_in, (t.n_all - coalesce(c.n_in, 0))::BIGINT AS n_out,
        log2((coalesce(c.n_in, 0) + 1.0::DOUBLE) / (z.size_in + 131072)) - log2((t.n_all - coalesce(c.n_in, 0) + 1.0::DOUBLE) / ((SELECT sum(size_in) FROM sz) - z.size_in + 131072)) AS score
        FROM allt t CROSS JOIN sz z LEFT JOIN cnt c ON c.lang = z.lang AND c.tok = t.tok)"""


@query(NB + " SELECT lang, tok, n_in, n_out, round(score, 6) AS score FROM odds WHERE n_in > 0")
def nb_token_log_odds(spark, sf_dir):
    """The pool's log-odds; the pool is what the slices leave."""
    rows = sliced(spark, sf_dir)
    # one file may hold most of the texts: they are dealt out before the hashing
    dealt = rows.where("slice = 'pool'").select("lang", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = features.bucket_rows(dealt, ["lang"]).select("lang", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("times").alias("t"))))
    counts = Workspace(spark, "log_odds").save(cells.groupBy("lang", "tok").agg(F.sum("t").alias("n_in")), "counts")
    return r6(events.log_odds(counts, "lang").where("n_in > 0"))


CROSSED = f"WITH {HASHES}" + f""",
    placed AS (SELECT doc_id, lang, coalesce(doc_id % {FOLDS}, 0)::INT AS fold FROM documents), te AS (SELECT p.doc_id, p.lang, p.fold, (e.h % 131072)::INT AS tok FROM ev e JOIN placed p USING (doc_id)),
    cf AS (SELECT fold AS own, lang, tok, count(*) AS n FROM te GROUP BY ALL), folds AS (SELECT unnest(range({FOLDS}))::INT AS fold),
    cnt AS (SELECT fold, lang, tok, sum(n) AS n_in FROM cf JOIN folds ON own <> fold GROUP BY ALL),
    allt AS (SELECT fold, tok, sum(n_in) AS n_all FROM cnt GROUP BY ALL), sz AS (SELECT fold, lang, sum(n_in) AS size_in FROM cnt GROUP BY ALL), sa AS (SELECT fold, sum(size_in) AS size_all FROM sz GROUP BY fold),
    odds AS (SELECT fold, z.lang AS domain, t.tok, log2((coalesce(c.n_in, 0) + 1.0::DOUBLE) / (z.size_in + 131072)) - log2((t.n_all - coalesce(c.n_in, 0) + 1.0::DOUBLE) / (sa.size_all - z.size_in + 131072)) AS score
        FROM allt t JOIN sz z USING (fold) JOIN sa USING (fold) LEFT JOIN cnt c USING (fold, lang, tok)),
    sc AS (SELECT te.doc_id, o.domain, sum(o.score) AS score, count(*) AS seen FROM te JOIN odds o USING (fold, tok) GROUP BY ALL),
    t AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY doc_id)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, fold, toks, times, runs, n of every document, written once. A null id is in fold 0."""
    fold = F.coalesce(F.pmod("doc_id", F.lit(FOLDS)), F.lit(0)).cast("int").alias("fold")
    rows = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), fold, "text")
    # one file may hold most of the texts: they are dealt out before the hashing
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Workspace(spark, "counted").save(features.bucket_rows(dealt, ["doc_id", "label", "fold"]), "rows")


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gold, n, seen, scores of every document, by the count tables of the folds it isn't in."""
    rows = counted(spark, sf_dir)
    counts = Workspace(spark, "crossed").save(bayes.fold_counts(rows), "counts")
    return bayes.scores(rows.withColumn("gold", F.col("label")), counts, ["doc_id", "gold"])


@query(CROSSED + " SELECT doc_id, domain AS lang, round(score, 6) AS score, seen FROM sc")
def nb_domain_scores(spark, sf_dir):
    """Every document's score for every language; a document without evidence has none."""
    return r6(crossed(spark, sf_dir).select("doc_id", "seen", F.inline("scores")).select("doc_id", F.col("label").alias("lang"), "score", "seen"))


@query(CROSSED + """, b AS (SELECT a.doc_id, a.domain, a.score - (SELECT max(b.score) FROM sc b WHERE b.doc_id = a.doc_id AND b.domain <> a.domain) AS m FROM sc a)
    SELECT doc_id, domain AS lang, round(1 / (1 + exp(-m / n)), 6) AS term FROM b JOIN t USING (doc_id)""")
def nb_margin_blend(spark, sf_dir):
    top = F.sort_array(F.transform("scores", lambda x: x["score"]), asc=False)  # one score a language
    long = crossed(spark, sf_dir).select("doc_id", "n", top.alias("s"), F.inline("scores"))
    other = F.when(F.col("score") == F.get("s", F.lit(0)), F.get("s", F.lit(1))).otherwise(F.get("s", F.lit(0)))
    return r6(long.select("doc_id", F.col("label").alias("lang"), maths.sigmoid((F.col("score") - other) / F.col("n")).alias("term")))


@query(CROSSED + """, e AS (SELECT doc_id, any_value(seen) AS seen FROM sc GROUP BY doc_id)
    SELECT (CASE WHEN coalesce(seen, 0) < 4 THEN 0 WHEN seen < 16 THEN 1 WHEN seen < 64 THEN 2 WHEN seen < 256 THEN 3 WHEN seen < 1024 THEN 4 ELSE 5 END)::INT AS bin, count(*) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY 1""")
def evidence_density_hist(spark, sf_dir):
    bin_ = F.lit(5)
    for i, edge in reversed(list(enumerate((4, 16, 64, 256, 1024)))):
        bin_ = F.when(F.col("seen") < edge, i).otherwise(bin_)
    return crossed(spark, sf_dir).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


DECIDED = CROSSED + """, sg AS (SELECT sc.doc_id, domain, 1 / (1 + exp(-8 * score / n)) AS s FROM sc JOIN t USING (doc_id)),
    pr AS (SELECT doc_id, domain, round(s / sum(s) OVER (PARTITION BY doc_id), 6) AS p FROM sg),
    dec AS (SELECT doc_id, first(domain ORDER BY p DESC, domain) AS pick, round(CASE WHEN count(*) = 1 THEN 1 ELSE 1 - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) END, 6) AS conf FROM pr GROUP BY doc_id),
    item AS (SELECT s.doc_id, s.lang AS gold, d.pick, d.conf, coalesce((s.lang = d.pick)::INT, 0) AS ok FROM placed s LEFT JOIN dec d USING (doc_id)),
    thr AS (SELECT conf AS t FROM (SELECT conf, row_number() OVER (ORDER BY conf, doc_id) - 1 AS i, count(*) OVER () AS n FROM item WHERE conf IS NOT NULL) WHERE i = least(floor(n * 0.1), n - 1))"""


def answers(found: DataFrame) -> DataFrame:
    """doc_id, gold, pick, conf, ok of scored rows (doc_id, gold, n, scores); pick and conf are null without evidence."""
    probs = maths.shares(F.transform("scores", lambda x: maths.sigmoid(8.0 * x["score"] / F.col("n"))))
    packed = found.withColumn("probs", F.transform(probs, lambda p: F.round(p, 6)))
    pick = F.get(F.transform("scores", lambda x: x["label"]), maths.argmax_first(F.col("probs")))
    conf = F.when(F.col("scores").isNotNull(), F.round(maths.readout(F.col("probs")), 6))
    return packed.select("doc_id", "gold", pick.alias("pick"), conf.alias("conf")).withColumn("ok", F.coalesce((F.col("pick") == F.col("gold")).cast("int"), F.lit(0)))


@query(DECIDED + " SELECT doc_id, gold, pick, conf, CASE WHEN conf IS NULL THEN 'no_evidence' WHEN conf < t THEN 'score_gate' ELSE 'answered' END AS cause, ok FROM item LEFT JOIN thr ON true")
def decide_language(spark, sf_dir):
    """Flagship: a decision for every document, by the count tables of the folds it isn't in, under a gate at the tenth
    percentile of the confidences. A document without a bucket that the other folds have (an empty or null text among
    them) has no pick; its cause is no_evidence."""
    found = Workspace(spark, "decide_language").save(answers(crossed(spark, sf_dir)), "found")
    gate = ranking.percentiles(found.where("conf is not null").select(F.col("conf").alias("x")), [0.1]).agg(F.max("threshold").alias("t"))  # one row
    cause = F.when(F.col("conf").isNull(), "no_evidence").when(F.col("conf") < F.col("t"), "score_gate").otherwise("answered")
    return found.crossJoin(F.broadcast(gate)).select("doc_id", "gold", "pick", "conf", cause.alias("cause"), "ok")
