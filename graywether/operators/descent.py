"""Search over postures: the weights that a decision gives to its blended terms, one coordinate at a time.

A term table (case_id, gold, opt, a column a term) is written once; all points of a coordinate's ladder are scored by
one job over it. The driver holds points and accuracies only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = dict[str, float]


@dataclass
class Walk:
    """Where a search ended; moves are (pass, coordinate, from, to, accuracy); jobs counts the scoring jobs."""

    point: Point
    accuracy: float
    moves: list[tuple[int, str, float, float, float]] = field(default_factory=list)
    passes: int = 0
    jobs: int = 0


def accuracies(terms: DataFrame, points: list[Point]) -> list[float]:
    """The share of cases that each point picks right: the option of the largest weighted sum of terms (nine decimals), ties to the
    lesser option. One job for all points; 0 without cases."""
    names = sorted({name for p in points for name in p})
    listed = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(float(p.get(n, 0.0))).alias(f"w_{n}") for n in names)) for i, p in enumerate(points)))
    rows = terms.select("*", F.explode(listed).alias("p"))
    score = F.round(sum((F.col(f"p.w_{n}") * F.col(n) for n in names), F.lit(0.0)), 9)
    picks = rows.groupBy("case_id", "gold", F.col("p.i").alias("i")).agg(F.min(F.struct((-score).alias("o"), "opt"))["opt"].alias("pick"))
    found = {r.i: r.a for r in picks.groupBy("i").agg(F.avg((F.col("pick") == F.col("gold")).cast("double")).alias("a")).collect()}  # a row a point
    return [found.get(i, 0.0) for i in range(len(points))]


def swapped(point: Point, fitted: set[str], **scales: float) -> Point:
    """The point with other scales and nothing refitted; a scale of a term that was never fitted is refused unless it is 0."""
    missing = sorted(n for n, s in scales.items() if s != 0 and n not in fitted)
    if missing:
        raise ValueError(f"not fitted: {', '.join(missing)}")
    return point | scales


def descend(terms: DataFrame, start: Point, ladders: dict[str, list[float]], margin: float = 0.01, passes: int = 2) -> Walk:
    """From start, each coordinate in turn moves to the ladder's best point if that beats the accuracy so far by the margin (of
    equals the earlier rung); passes end early when nothing moves. The margin's comparison takes nine decimals."""
    walk = Walk(dict(start), accuracies(terms, [start])[0], jobs=1)
    for turn in range(passes):
        moved = False
        for name, ladder in ladders.items():
            trials = [walk.point | {name: rung} for rung in ladder if rung != walk.point[name]]
            if not trials:
                continue
            walk.jobs += 1
            best, found = None, walk.accuracy
            for trial, accuracy in zip(trials, accuracies(terms, trials)):
                if round(accuracy - walk.accuracy - margin, 9) >= 0 and accuracy > found:
                    best, found = trial, accuracy
            if best is not None:
                walk.moves.append((turn, name, walk.point[name], best[name], found))
                walk.point, walk.accuracy, moved = best, found, True
        walk.passes += 1
        if not moved:
            break
    return walk


def select(terms: DataFrame, start: Point, name: str, ladder: list[float], margin: float = 0.05) -> tuple[float, list[tuple[float, float]]]:
    """The selected rung of one coordinate and every rung's accuracy: the best of those that beat the first rung by the margin (of
    equals the earlier), else the first."""
    found = list(zip(ladder, accuracies(terms, [start | {name: rung} for rung in ladder])))
    picked, best = found[0]
    for rung, accuracy in found[1:]:
        if round(accuracy - found[0][1] - margin, 9) >= 0 and accuracy > best:
            picked, best = rung, accuracy
    return picked, found
