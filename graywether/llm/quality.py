"""Quality rules by host.

Each document is measured and held against RULES. Failures are then summed per rule and host (the source), each host's
failure rate of a rule is shrunk towards all hosts by a beta prior fitted to the hosts' counts, and the verdict of its
host is joined back to every document: a document is kept if it passes the base rules and no shrunk failure rate of
its host is above REJECT_ABOVE.

The prior of a rule has the mean of all documents; its strength comes from how far the hosts' rates differ beyond
what binomial counts of their sizes would (method of moments with the binomial variance taken off).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import BLANK, Workspace, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
LEAST_WORD, MOST_WORD = 2, 15
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
#: What fails a rule, over the measures. The first two are the base rules, which also reject the document itself.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
    "word_length": f"word_chars < {LEAST_WORD} * n_words or word_chars > {MOST_WORD} * n_words",
}
BASE_RULES = ("few_words", "repeats")
#: A host is rejected if most of its documents fail a rule by the shrunk rate.
REJECT_ABOVE = 0.5
#: Pseudo-documents of the prior where there is one host; at least (an even prior); where hosts don't differ beyond chance.
PRIOR_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 20.0, 2.0, 1e6


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """value as a column that is worked out once per row and not inlined where it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more, given the hashes of all windows in text order.

    Windows are sorted by hash and place; the places of those equal to a neighbour are sorted again, and each
    covers WINDOW words or as many as lie before the next.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)

    def places(p: Column) -> Column:
        same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
        twice = F.filter(p, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  binds a value that f uses often
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(one(pairs, lambda p: one(places(p), covered)))


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words and fails. Columns of docs with these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.drop(*MEASURES)
    df = _once(df, "_hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    starts = F.when(F.size("_hashes") >= WINDOW, F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = _once(df, "_windows", F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, WINDOW))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _once(df, "_lines", lines)
    df = df.select(
        "*",
        F.size("_hashes").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
    ).drop("_hashes", "_windows", "_lines")
    return df.withColumn("base_failed", F.expr(" or ".join(RULES[r] for r in BASE_RULES)))


def prior_strength(hosts: float, docs: float, squares: float, failed: float, spread: float) -> float:
    """Strength of a rule's prior: of `docs` documents of `hosts` hosts `failed` fail; squares sums n * n, spread k * k / n.

    The hosts' weighted squared distances from the mean exceed their binomial expectation by rho, the share of variance
    between hosts, which is 1 / (strength + 1) of a beta prior.
    """
    mean = failed / docs if docs else 0.0
    each = mean * (1 - mean)
    room = docs - squares / docs - (hosts - 1) if docs else 0.0
    if hosts < 2 or each <= 0 or room <= 0:
        return PRIOR_STRENGTH
    rho = (spread - mean * failed - (hosts - 1) * each) / (each * room)
    return min(max(1 / rho - 1, LEAST_STRENGTH), MOST_STRENGTH) if rho > 0 else MOST_STRENGTH


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: host, n_docs, failed_<rule> and rate_<rule> (shrunk) of each rule, rate (the highest),
    host_rejected. A null host is a host of its own; no other column is looked at, so null ids don't matter."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").cast("double").alias("n_docs"), *[F.count_if(F.expr(rule)).cast("double").alias(f"failed_{name}") for name, rule in RULES.items()]
    )
    n = F.col("n_docs")
    fit = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum(n * n).alias("squares"),
        *[f(x).alias(f"{kind}_{name}") for name in RULES for kind, f, x in (("failed", F.sum, F.col(f"failed_{name}")), ("spread", F.sum, F.col(f"failed_{name}") ** 2 / n))],
    ).first()
    rates = {}
    for name in RULES:
        total = fit.docs or 0.0
        failed = fit[f"failed_{name}"] or 0.0
        strength = prior_strength(fit.hosts, total, fit.squares or 0.0, failed, fit[f"spread_{name}"] or 0.0)
        rates[f"rate_{name}"] = (F.col(f"failed_{name}") + strength * (failed / total if total else 0.0)) / (n + strength)
    found = hosts.withColumns(rates).withColumn("rate", F.greatest(*map(F.col, rates)))
    return found.withColumn("host_rejected", F.col("rate") > REJECT_ABOVE)


def judge(docs: DataFrame, host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns carry of it, the host among them) with the measures, base_failed, host_rate and kept.

    A document without a host is judged with all others that have none, whether it has an id or not. Ties and repeated rows are judged alike; an empty table stays empty. The verdicts are one row per host:
    Spark sends them to all tasks if they are below its broadcast threshold and joins by shuffle if not.
    """
    ws = Workspace(docs.sparkSession, "quality")
    measured = measure(docs.drop("host_rate", "kept"))
    if carry is not None:
        measured = measured.select(*carry, *MEASURES)
    measured = ws.save(measured, "measured")
    verdicts = ws.save(host_verdicts(measured, host), "hosts")
    verdicts = verdicts.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_rejected")
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.withColumn("kept", kept).drop("_host", "host_rejected")


def oracle() -> str:
    """doc_id, the measures and kept over documents in DuckDB SQL."""
    blank = r"\x20\x09-\x0D"
    counts = ", ".join(f"sum(({rule})::int)::double AS failed_{name}" for name, rule in RULES.items())
    fits = ", ".join(f"sum(failed_{name}) AS k_{name}, sum(failed_{name} * failed_{name} / n) AS s_{name}" for name in RULES)

    def rate(name: str) -> str:
        mean = f"(k_{name} / docs)"
        each = f"({mean} * (1 - {mean}))"
        rho = f"((s_{name} - {mean} * k_{name} - (hosts - 1) * {each}) / ({each} * (docs - squares / docs - (hosts - 1))))"
        strength = (
            f"CASE WHEN hosts < 2 OR {each} <= 0 OR docs - squares / docs - (hosts - 1) <= 0 THEN {PRIOR_STRENGTH} "
            f"WHEN {rho} <= 0 THEN {MOST_STRENGTH} ELSE least(greatest(1 / {rho} - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) END"
        )
        return f"(SELECT (failed_{name} + s * {mean}) / (n + s) FROM (SELECT {strength} AS s))"

    return rf"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') AS w FROM documents),
    l AS (SELECT *, (SELECT coalesce(list(x), []) FROM (SELECT unnest(string_split(t, chr(10))) AS x) WHERE regexp_matches(x, '[^{blank}]')) AS lines FROM d),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS words
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM twice) GROUP BY doc_id),
    m AS (SELECT doc_id, source, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words
        FROM l LEFT JOIN covered USING (doc_id)),
    hosts AS (SELECT source, count(*)::double AS n, {counts} FROM m GROUP BY source),
    fit AS (SELECT count(*)::double AS hosts, sum(n) AS docs, sum(n * n) AS squares, {fits} FROM hosts),
    verdicts AS (SELECT source, greatest({", ".join(map(rate, RULES))}) > {REJECT_ABOVE} AS rejected FROM hosts, fit),
    judged AS (SELECT m.*, ({" OR ".join(RULES[r] for r in BASE_RULES)}) AS base_failed, rejected
        FROM m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source)
    SELECT doc_id, {", ".join(MEASURES)}, NOT base_failed AND NOT rejected AS kept FROM judged
    """
