"""Verdicts over answers: routers, calibration claims, stability, hygiene, resamples.

Each is an aggregation to a few numbers; what is joined by broadcast is one row of such numbers or a label space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graywether.functions import maths
from graywether.functions import text as T
from graywether.operators import metrics, ranking
from graywether.operators.events import _WORDS, _word_hashes, pieces
from graywether.operators.ordered import running

#: Cumulative probabilities of a Poisson(1) draw of 0, 1, 2, ...
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080)


def loo_routed(a: DataFrame, b: DataFrame, temperature: float = 0.01) -> DataFrame:
    """accuracy, n: lanes blended by the sigmoid of their difference in accuracy, each case scored with its own hits
    taken out of the difference. Null accuracy under two cases."""
    rows = a.select("case_id", "gold", "labels", F.col("probs").alias("pa"), F.col("ok").alias("oa"))
    rows = rows.join(b.select("case_id", F.col("probs").alias("pb"), F.col("ok").alias("ob")), "case_id")
    sums = F.broadcast(rows.agg(F.sum(F.col("oa") - F.col("ob")).alias("gap"), F.count("*").alias("m")))  # one row
    own = F.col("gap") - (F.col("oa") - F.col("ob"))
    g = F.when(F.col("m") > 1, maths.sigmoid(own / F.nullif((F.col("m") - 1) * temperature, F.lit(0.0))))
    rows = rows.crossJoin(sums).withColumn("g", g)
    mixed = F.zip_with("pa", "pb", lambda x, y: F.round(F.col("g") * x + (1 - F.col("g")) * y, 9))
    rows = rows.withColumn("q", mixed).withColumn("pick", F.element_at("labels", maths.argmax_first(F.col("q")) + 1))
    hit = F.when(F.col("m") > 1, (F.col("pick") == F.col("gold")).cast("int"))
    return rows.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def ece_by(rows: DataFrame, by: str, n: int = metrics.BINS) -> DataFrame:
    """by, ece of rows (by, conf, ok)."""
    binned = rows.withColumn("bin", maths.ece_bin(F.col("conf"), n)).where("bin is not null")
    each = binned.groupBy(by, "bin").agg(F.count("*").alias("c"), F.avg("conf").alias("m"), F.avg("ok").alias("a"))
    return each.groupBy(by).agg((F.sum(F.col("c") * F.abs(F.col("m") - F.col("a"))) / F.sum("c")).alias("ece"))


def readout_report(items: DataFrame) -> DataFrame:
    """mode, ece of the three readouts of the same answers."""
    modes = ("dispatch", "max_prob", "inv_entropy")
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.round(maths.readout(F.col("probs"), m), 6).alias("conf")) for m in modes])
    return ece_by(items.select("ok", F.inline(each)), "mode")


def g1_verdict(fitted: Column, ece_cal: Column, ece_raw: Column, ece_floor: Column) -> Column:
    """pass if the calibrated readout beats both the raw one and the floor, fail if not, no_claim where nothing is fitted."""
    good = (ece_cal < ece_raw) & (ece_cal < ece_floor)
    return F.when(~fitted, "no_claim").when(good, "pass").otherwise("fail")


def g1_cell(cal: DataFrame, test: DataFrame, least: int = 64) -> DataFrame:
    """ece_raw, ece_cal, ece_floor, verdict: confidences of test against those calibrated by the accuracy of their bin in
    cal and against the conformal floor. Nothing is fitted under `least` calibration cases."""
    table = F.broadcast(metrics.bins(cal).select("bin", F.col("acc").alias("fit")))  # a row a bin
    rows = test.select("case_id", "conf", "ok").withColumn("bin", maths.ece_bin(F.col("conf"))).join(table, "bin", "left")
    floor = metrics.conformal_floor(cal.select(F.col("conf").alias("score")), test.select("case_id", F.col("conf").alias("score")))
    rows = rows.join(floor, "case_id")
    arms = {"raw": F.col("conf"), "cal": F.round(F.coalesce("fit", "conf"), 6), "floor": F.round("floor", 6)}
    long = rows.select("ok", F.inline(F.array(*[F.struct(F.lit(k).alias("arm"), v.alias("conf")) for k, v in arms.items()])))
    eces = ece_by(long, "arm").agg(*[F.max(F.when(F.col("arm") == k, F.col("ece"))).alias(f"ece_{k}") for k in arms])
    size = cal.agg((F.count("*") >= least).alias("fitted"))
    return eces.crossJoin(F.broadcast(size)).select(
        *[f"ece_{k}" for k in arms], g1_verdict(F.col("fitted"), F.col("ece_cal"), F.col("ece_raw"), F.col("ece_floor")).alias("verdict")
    )


def dominates(auroc: Column, ece: Column, other_auroc: Column, other_ece: Column) -> Column:
    """Better on one of AUROC and ECE, worse on neither."""
    return (auroc >= other_auroc) & (ece <= other_ece) & ((auroc > other_auroc) | (ece < other_ece))


def depth_ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """ece, n of rows (depth, ok) with depth over the largest depth as confidence; null and zero depths are in no bin."""
    most = F.broadcast(rows.agg(F.max("depth").alias("most")))  # one row
    held = rows.where("depth > 0").crossJoin(most)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("depth") - 1) * bins / F.col("most")))
    each = held.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"), F.avg(F.col("depth") / F.col("most")).alias("m"), F.avg("ok").alias("a"))
    return each.agg((F.sum(F.col("c") * F.abs(F.col("m") - F.col("a"))) / F.sum("c")).alias("ece"), F.sum("c").alias("n"))


def ceil_ranks(xs: DataFrame, rates: dict[str, float]) -> list[Column]:
    """Aggregates for rows (x, c, last, n) of counts per distinct value: the element at max(1, ceil(q n)), by name."""

    def at(q: float) -> Column:
        place = F.greatest(F.lit(1), F.ceil(F.col("n") * q)) - 1
        return F.max(F.when((place <= F.col("last")) & (place > F.col("last") - F.col("c")), F.col("x")))

    return [at(q).alias(name) for name, q in rates.items()]


def ranked_counts(rows: DataFrame, x: str) -> DataFrame:
    """x, c, last, n: counts per distinct value with the place of its last row and the number of rows."""
    each = running(rows.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("c")), "x", ["c"])
    return each.select("x", "c", (F.col("c_upto") - 1).alias("last"), F.col("c_all").alias("n"))


def evidence_stats(rows: DataFrame, rumor: int = 4) -> DataFrame:
    """n, least, p25, p50, p75, most, mean_seen, rumor_share, zero_share, mean_share of rows (seen, total)."""
    ranks = ranked_counts(rows, "seen")
    one = ranks.agg(F.min("x").alias("least"), *ceil_ranks(ranks, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), F.max("x").alias("most"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("seen") / F.nullif(F.col("total"), F.lit(0)))
    means = rows.agg(
        F.count("*").alias("n"),
        F.avg("seen").alias("mean_seen"),
        F.avg((F.col("seen") < rumor).cast("int")).alias("rumor_share"),
        F.avg((F.col("seen") == 0).cast("int")).alias("zero_share"),
        F.avg(share).alias("mean_share"),
    )
    return one.crossJoin(F.broadcast(means))


def spread_stats(spreads: DataFrame, most: float = 2.0) -> DataFrame:
    """n, median, largest (points), flips, flip_rate, verdict of spreads (swing, flip): RED if the median passes `most`."""
    rows = spreads.select(F.round(F.col("swing") * 100, 6).alias("pt"), "flip")
    ranks = ranked_counts(rows, "pt")
    one = ranks.agg(*ceil_ranks(ranks, {"median": 0.5}), F.max("x").alias("largest"))
    flips = rows.agg(F.count("*").alias("n"), F.sum(F.col("flip").cast("long")).alias("flips"), F.avg("flip").alias("flip_rate"))
    verdict = F.when(F.col("median") > most, "RED").otherwise("PASS").alias("verdict")
    return one.crossJoin(F.broadcast(flips)).select("n", "median", "largest", "flips", "flip_rate", verdict)


def rubric_residuals(items: DataFrame, scale: float = 10.0, shift: float = 7.0) -> DataFrame:
    """scale, shift, total, disagreements: how far expected values under two sets of level values break the identities
    S(cv) = c S(v) and S(v + c) = S(v) + c sum(p), the largest over cases, and picks that aren't the first largest."""
    k = F.size("probs")
    ramp = F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("double"))
    phi = (1 + 5**0.5) / 2
    scatter = F.transform(F.sequence(F.lit(1), k), lambda i: (i * phi - F.floor(i * phi)) * 100.0)
    p, mass = F.col("probs"), maths.total(F.col("probs"))
    off = lambda v, f, want: F.abs(maths.dot(p, F.transform(v, f)) - want(maths.dot(p, v)))
    scaled = [off(v, lambda x: x * scale, lambda s: s * scale) for v in (ramp, scatter)]
    shifted = [off(v, lambda x: x + shift, lambda s: s + shift * mass) for v in (ramp, scatter)]
    wrong = (F.element_at("labels", maths.argmax_first(p) + 1) != F.col("pick")).cast("long")
    return items.agg(F.max(F.greatest(*scaled)).alias("scale"), F.max(F.greatest(*shifted)).alias("shift"), F.max(F.abs(mass - 1)).alias("total"), F.sum(wrong).alias("disagreements"))


def byte_trigrams(label: Column) -> Column:
    """Distinct 3-byte pieces of a lower-cased string in hex; a shorter one is one piece, the empty one none."""
    raw = F.hex(F.lower(label).cast("binary"))
    n = F.octet_length(F.lower(label))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(raw, 2 * i - 1, F.lit(6)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def graded_decoys(slots: DataFrame, k: int) -> DataFrame:
    """case_id, decoys: k labels that aren't in the slot, evenly spaced from most to least like its gold label.

    slots: case_id, gold, labels (array). The pool is the union of all slots' labels in order of name; it is a label
    space and becomes one row.
    """
    pool = F.broadcast(slots.select(F.explode("labels").alias("l")).agg(F.sort_array(F.collect_set("l")).alias("pool")))
    like = lambda o: F.round(T.jaccard(byte_trigrams(o), byte_trigrams(F.col("gold"))), 9)
    rows = slots.crossJoin(pool).withColumn("others", F.filter("pool", lambda o: ~F.array_contains("labels", o)))
    ranked = F.array_sort(F.transform("others", lambda o, i: F.struct((-like(o)).alias("s"), i.alias("i"), o.alias("o"))))
    rows = rows.select("case_id", F.transform(ranked, lambda x: x["o"]).alias("r")).withColumn("n", F.size("r"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(F.col("r"), F.floor(i * (F.col("n") - 1) / max(k - 1, 1)).cast("int")))
    return rows.select("case_id", F.when(F.col("n") <= k, F.col("r")).otherwise(spaced).alias("decoys"))


def _spread(texts: DataFrame, parts: int) -> DataFrame:
    """gram, part, id, fold, xs, times: the distinct hashes of a text's words (gram false) and of three words in a row (true) that
    fall in each part, with how often they occur. texts: id, fold, ws."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, _WORDS):
            words = batch.column(2)
            sizes = np.diff(np.asarray(words.offsets))
            coded = words.flatten().dictionary_encode()
            h = _word_hashes(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.array([], dtype=np.uint64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            third = np.flatnonzero(owner[2:] == owner[:-2]) if len(h) > 2 else np.array([], dtype=np.int64)
            for gram, who, x in ((False, owner, h), (True, owner[third], (_mixed(_mixed(h[third]) ^ h[third + 1]) ^ h[third + 2]))):
                x = _mixed(x)
                part = (x >> np.uint64(32)) % np.uint64(parts)
                order = np.lexsort((x, part, who))
                who, part, x = who[order], part[order], x[order]
                fresh = np.ones(len(x), dtype=bool)
                fresh[1:] = (x[1:] != x[:-1]) | (who[1:] != who[:-1])
                at = np.flatnonzero(fresh)
                times = np.diff(np.append(at, len(x))).astype(np.int32)
                who, part, x = who[at], part[at], x[at]
                first = np.ones(len(x), dtype=bool)
                first[1:] = (who[1:] != who[:-1]) | (part[1:] != part[:-1])
                starts = np.flatnonzero(first)
                ends = pa.array(np.append(starts, len(x)).astype(np.int32))
                own = pa.array(who[starts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gram] * len(starts), pa.bool_()), pa.array(part[starts].astype(np.int32)), batch.column(0).take(own), batch.column(1).take(own),
                        pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    names=["gram", "part", "id", "fold", "xs", "times"],
                )

    return texts.select("id", "fold", "ws").mapInArrow(run, f"gram boolean, part int, id {kind}, fold int, xs array<long>, times array<int>")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """gram, id, times: what a text has in one part that another fold has too."""
    table = table.combine_chunks()
    n = np.asarray(pc.list_value_length(table["xs"]), dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    x, times = np.asarray(pc.list_flatten(table["xs"])), np.asarray(pc.list_flatten(table["times"]))
    folds = np.asarray(table["fold"])[owner]
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
    shared = np.minimum.reduceat(folds[order], starts) != np.maximum.reduceat(folds[order], starts)
    known = np.empty(len(x), dtype=bool)
    known[order] = np.repeat(shared, np.diff(np.append(starts, len(x))))
    hits = np.bincount(owner, weights=np.where(known, times, 0), minlength=len(n)).astype(np.int64)
    some = np.flatnonzero(hits)
    return pa.table({"gram": pa.array([key[0].as_py()] * len(some), pa.bool_()), "id": table["id"].take(pa.array(some)), "times": pa.array(hits[some])})


#: Words and grams of a part, about.
_PART = 2_000_000


def hygiene(rows: DataFrame) -> DataFrame:
    """fold, n, mean_overlap, max_overlap, trigram_hits of texts (id, fold, text): the share of a text's words that other
    folds have, and texts that share three words in a row with another fold. Each fold is held against the others in one
    pass. A text without words has a share of 0; ids are unique.

    Words and grams are 64-bit hashes. They are dealt to parts by hash, a text's in a part as one row, and shuffled once: a
    part sees all that have a hash. The number of parts grows with the texts, so a part doesn't (but for hashes that all
    texts hold, a number each).
    """
    kind = rows.schema["id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    letters = rows.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // (6 * _PART) + 1)
    texts = rows.select("id", "fold", T.hygiene_tokens(text).alias("ws"))
    met = _spread(texts, parts).groupBy("gram", "part").applyInArrow(_met, f"gram boolean, id {kind}, times long")
    found = met.groupBy("id").agg(F.sum(F.when(~F.col("gram"), F.col("times"))).alias("hits"), F.max(F.when(F.col("gram"), 1)).alias("walled"))
    share = F.coalesce(F.col("hits") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0))
    sized = texts.select("id", "fold", F.size("ws").alias("size")).join(found, "id", "left")
    return sized.groupBy("fold").agg(F.count("*").alias("n"), F.avg(share).alias("mean_overlap"), F.max(share).alias("max_overlap"), F.count("walled").alias("trigram_hits"))


def banned_tokens(rows: DataFrame, bans: list[str], key: str = "doc_id") -> DataFrame:
    """key, token, n: banned whole words of each text. A short list, tested in the row."""
    found = F.filter(T.hygiene_tokens(F.col("text")), lambda w: w.isin(bans))
    return rows.select(key, F.explode(found).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def poisson_weights(key: Column, draw: Column) -> Column:
    """How often a row is in a resample: a Poisson(1) number that the row's key and the resample decide."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((u >= t).cast("int") for t in POISSON)


def bootstrap_accuracy(items: DataFrame, draws: int = 200) -> DataFrame:
    """low, high, mean: the 2.5 and 97.5 % places of accuracy over resamples.

    Rows are weighted, not drawn, so a resample needs no order: sums per resample are added before the shuffle.
    """
    rows = items.select("case_id", "ok", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    w = poisson_weights(F.col("case_id"), F.col("b"))
    each = rows.groupBy("b").agg(F.sum(w * F.col("ok")).alias("k"), F.sum(w).alias("m")).where("m > 0").select((F.col("k") / F.col("m")).alias("x"))
    ends = ranking.percentiles(each, [0.025, 0.975])
    one = ends.agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    return one.crossJoin(F.broadcast(each.agg(F.avg("x").alias("mean"))))


def extremes(rows: DataFrame, by: str, x: str, order: list[str]) -> DataFrame:
    """by, first (in order), most, most_at (the earliest row with it: the last of the order columns), n."""
    at = F.struct(*order)
    earliest = F.min(F.struct((-F.col(x)).alias("o"), at.alias("at")))
    return rows.groupBy(by).agg(F.min_by(x, at).alias("first"), F.max(x).alias("most"), earliest["at"][order[-1]].alias("most_at"), F.count("*").alias("n"))


def label_space(probs: Column, order: Column) -> Column:
    """Probabilities of options shown in an order (option numbers from 0), back in the options' own order."""
    return F.transform(order, lambda _, i: F.get(probs, (F.array_position(order, i) - 1).cast("int")))


def fields(text: Column, most: int = 8) -> Column:
    """Non-empty lines of a text. Of more than `most`, the last but one holds every line from its own on, and the last is
    line `most`: nothing is cut off."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    folded = F.concat(F.slice(lines, 1, most - 2), F.array(F.array_join(F.slice(lines, most - 1, F.greatest(F.size(lines), F.lit(1))), "\n"), F.get(lines, F.lit(most - 1))))
    return F.when(F.size(lines) > most, folded).otherwise(lines)


def worthiness(pairs: DataFrame, at: float, least: int, delta: float) -> DataFrame:
    """n, acc_b, acc_a, delta, lcb95, disarmed: is lane b better where lane a abstains (confidence below `at`)?

    disarmed is null, and b stays armed, with fewer than `least` such cases.
    """
    m = pairs.where(F.col("conf_a") < at).agg(F.count("*").alias("n"), F.avg("ok_b").alias("acc_b"), F.avg("ok_a").alias("acc_a"))
    b, a, n = F.col("acc_b"), F.col("acc_a"), F.col("n")
    se = F.sqrt((b * (1 - b) + a * (1 - a)) / F.nullif(n, F.lit(0)))
    return m.select("n", "acc_b", "acc_a", (b - a).alias("delta"), (b - a - 1.644934 * se).alias("lcb95"), F.when(n >= least, b - a < delta).alias("disarmed"))


def knife_edge(items: DataFrame, rate: float, step: float = 0.02, drop: float = 2.0) -> DataFrame:
    """place, threshold, accuracy, pass_rate, edge: the threshold at a percentile and beside it; edge names what falls to
    1 / drop of its neighbour's. All three are counted in one pass."""
    star = ranking.percentiles(items.select(F.col("conf").alias("x")), [rate]).select(F.col("threshold").alias("t"))
    places = star.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), (F.col("t") + i * step).alias("threshold")) for i in (-1, 0, 1)])))
    points = items.crossJoin(F.broadcast(places)).groupBy("place", "threshold")  # three rows
    passed = F.col("conf") >= F.col("threshold")
    points = points.agg(F.avg(F.when(passed, F.col("ok"))).alias("accuracy"), F.avg(passed.cast("int")).alias("pass_rate"))
    own = F.broadcast(points.where("place = 0").select(F.col("accuracy").alias("sa"), F.col("pass_rate").alias("sp")))
    falls = lambda s, x: F.coalesce((x > 0) & (s >= drop * x), F.lit(False))
    edge = F.when(F.col("place") == 0, F.lit("none")).when(falls(F.col("sp"), F.col("pass_rate")), "pass_rate").when(falls(F.col("sa"), F.col("accuracy")), "accuracy").otherwise("none")
    return points.crossJoin(own).select("place", "threshold", "accuracy", "pass_rate", edge.alias("edge"))


def histogram_kl(a: DataFrame, b: DataFrame, bins: int = 10, most: float = 0.05) -> DataFrame:
    """kl, passes: divergence of two smoothed histograms of x in [0, 1]."""
    p, q = (ranking.histogram(x, bins, smooth=1.0).select("bin", F.col("share").alias(n)) for x, n in ((a, "p"), (b, "q")))
    kl = p.join(q, "bin").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
    return kl.select("kl", (F.col("kl") <= most).alias("passes"))
