"""Repair of conversations by weighted finite-state composition.

A conversation's rows, by turn (nulls first), are an input acceptor. The edit transducer keeps a row (0), gives it the
role user or assistant (1), deletes it (2; blank and duplicate rows must go) or inserts an empty row of either role (5);
a truncated row that stays costs 5 more. The grammar acceptor takes the role initials `(s?(ua)+)?`. The composition of
the three is expanded lazily, state by state as paths reach it, and the cheapest path through it wins; of several the
one whose edits' initials (D, I, K, R) are least in ASCII order: weights are pairs (cost, label string).

A path's costs to the end are found backwards in topological order; then the walk forward takes at each state the
least label that loses nothing. A label leads from a state to one state only, so the walk gives the least string.

Rows are sorted side by side in ranges, which may cut a conversation; ranges are cut into segments of at most
SEGMENT_ROWS rows and about SEGMENT_BYTES bytes. A conversation that lies in one segment, away from the range's ends, is done in
place. For the others each segment gives its matrix of costs between the grammar's four states; the product of
the matrices behind a segment is what its end still costs, its walk from each state gives the state it ends in, and
these follow from segment to segment. So a conversation of any length is spread over tasks; only its segments' 16
numbers, its row of the report and the SHA-256 of its text (a stream through one task) come together.

Rows of one turn are taken by the MD5 of role and text. Null roles and texts are one blank, so a null text is blank;
null turns come first and don't count as gaps; a null id is a conversation of its own. Repeated rows are duplicates. An
empty table gives no rows. Columns besides conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace, crc32_sql

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 20
#: Bytes of the rows that carry a long conversation's text to its hash, and of the packed rows a task holds back.
PIECE = 4096
_HELD = 1 << 23
_NONE = 1 << 60

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: The grammar (s?(ua)+)?: from state by letter to state. States 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(len(GRAMMAR))
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

# A row as the input acceptor's symbol: d must go; s, u, a, x (any other role) may stay; S, U, A, X likewise, truncated.


@lru_cache(None)
def arcs(state: int, symbol: str) -> list[tuple[str, int, str, int, bool]]:
    """The composition's arcs from a state of the grammar before a row: label, cost, letter written, state, whether the
    row is read; by label. Of user and assistant the grammar takes one only, whatever the state."""
    letter, step = next((x, GRAMMAR[state][x]) for x in "ua" if x in GRAMMAR[state])
    found = [("D", DELETE, "", state, True), ("I", INSERT, letter, step, False)]
    if symbol != "d":
        stay = TRUNCATED if symbol.isupper() else 0
        if (kept := symbol.lower()) in GRAMMAR[state]:
            found.append(("K", stay, kept, GRAMMAR[state][kept], True))
        found.append(("R", REROLE + stay, letter, step, True))
    return found


@lru_cache(None)
def endings() -> tuple[tuple[int, ...], tuple[str, ...]]:
    """By state: the cost of ending there, and the letters that have to be inserted."""
    letters = ("", "ua", "a", "")
    return tuple(INSERT * len(x) for x in letters), letters


Move = tuple[str, str, int, int]


@lru_cache(1 << 16)
def back(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[Move | None, ...]]:
    """One row backwards: costs to the end before it from those after it, less their least, that least, and by state the
    move of the least labels: labels, letters written, cost, state after the row."""
    before = [min(c + after[t] for _, c, _, t, reads in arcs(q, symbol) if reads) for q in STATES]
    for _ in STATES:  # inserted rows, at most one a state
        before = [min(before[q], *(c + before[t] for _, c, _, t, reads in arcs(q, symbol) if not reads)) for q in STATES]
    moves: list[Move | None] = []
    for q in STATES:
        if before[q] >= _NONE:
            moves.append(None)
            continue
        labels, letters, cost, at, reads = "", "", 0, q, False
        while not reads:
            label, c, letter, to, reads = next(x for x in arcs(at, symbol) if before[at] == x[1] + (after if x[4] else before)[x[3]])
            labels, letters, cost, at = labels + label, letters + letter, cost + c, to
        moves.append((labels, letters, cost, at))
    least = min(before)
    return tuple(min(x - least, _NONE) for x in before), least, tuple(moves)


def costs_before(symbols: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end, by state, before rows, from those after them."""
    total = 0
    for s in reversed(symbols):
        after, least, _ = back(s, after)
        total += least
    return tuple(min(x + total, _NONE) for x in after)


def matrix(symbols: str) -> list[int]:
    """Cost from each state before the rows to each state after them."""
    columns = [costs_before(symbols, tuple(0 if q == to else _NONE for q in STATES)) for to in STATES]
    return [columns[to][q] for q in STATES for to in STATES]


def walk(symbols: str, after: tuple[int, ...], entry: int) -> tuple[list[Move], int]:
    """The moves, one a row, of the least path from state entry, and the state it ends in."""
    least = min(after)
    after, moves = tuple(min(x - least, _NONE) for x in after), []
    for s in reversed(symbols):
        after, _, move = back(s, after)
        moves.append(move)
    path, at = [], entry
    for move in reversed(moves):
        path.append(move[at])
        at = move[at][3]
    return path, at


def faults(roles: list[str], texts: list[str], later: set[int]) -> tuple[str, list[int]]:
    """The symbols of rows, and how many are first of all blank, duplicate or truncated. later: rows that are known to
    have an equal row in an earlier segment."""
    symbols, counts, seen = [], [0, 0, 0], set()
    for i, (role, text) in enumerate(zip(roles, texts)):
        rest = text.rstrip(BLANKS)
        if not rest:
            counts[0] += 1
            symbols.append("d")
            continue
        again = i in later or (role, text) in seen
        seen.add((role, text))
        if again:
            counts[1] += 1
            symbols.append("d")
            continue
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if rest[-1] not in ".!?":
            counts[2] += 1
            symbol = symbol.upper()
        symbols.append(symbol)
    return "".join(symbols), counts


def row_digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


_SEGMENT = "conv_id {id}, part int, seg int, edge boolean, turns array<long>, roles array<string>, texts array<string>"


def segments(rows: DataFrame) -> DataFrame:
    """Rows packed to segments, in order of part and seg. edge: other segments may hold rows of the same conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    plain = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    # equal rows are told apart by their place in the input, so a row that repeats without end is cut too
    plain = plain.withColumn("tie", F.md5(F.concat_ws(":", "role", "text"))).withColumn("uid", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "tie", "uid"]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, first = TaskContext.get().partitionId(), 0, True
        packed: list[tuple] = []
        held, conv, cut, size, started = 0, None, False, 0, False
        turns: list = []
        roles: list = []
        texts: list = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*packed))
            types = [id_type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "part", "seg", "edge", "turns", "roles", "texts"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                other = not started or c != conv
                if started and (other or len(turns) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                    packed.append((conv, part, seg, first or cut or not other, turns, roles, texts))
                    held, seg, cut, first = held + size, seg + 1, not other, first and not other
                    turns, roles, texts, size = [], [], [], 0
                    if held >= _HELD:
                        yield out()
                        packed, held = [], 0
                conv, started = c, True
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                size += len(role) + len(text) + 16
        if started:
            packed.append((conv, part, seg, True, turns, roles, texts))
            yield out()

    return ordered.mapInArrow(run, _SEGMENT.format(id=kind))


def _per_segment(df: DataFrame, f, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """f of each row (as a tuple) of df, columns conv_id, part and seg first, which it passes on."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                made = list(zip(*(f(*row) for row in zip(*(c.to_pylist() for c in batch.columns[3:])))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(made, types))], names=["conv_id", "part", "seg", *names])

    return df.mapInArrow(run, f"conv_id {kind}, part int, seg int, {schema}")


def _links(edges: DataFrame, ws: Workspace) -> DataFrame:
    """part, seg, later, after, entry, final of segments whose conversations may have several: rows with an equal row in an
    earlier segment, costs to the end after the segment, the state it begins in, whether it is the last."""

    def symbols_and_digests(roles: list[str], texts: list[str]) -> tuple:
        firsts: dict[bytes, int] = {}
        for i, (r, t) in enumerate(zip(roles, texts)):
            firsts.setdefault(row_digest(r, t), i)
        return faults(roles, texts, set())[0], [{"digest": d, "i": i} for d, i in firsts.items()]

    digest = pa.list_(pa.struct([("digest", pa.binary()), ("i", pa.int32())]))
    read = edges.select("conv_id", "part", "seg", "roles", "texts")
    read = ws.save(_per_segment(read, symbols_and_digests, ["symbols", "firsts"], [pa.string(), digest], "symbols string, firsts array<struct<digest: binary, i: int>>"), "read")
    # a segment has each of its rows once here, so a list holds no more entries than a conversation has segments
    same = read.select("conv_id", "part", "seg", F.inline("firsts")).groupBy("conv_id", "digest").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "i"))).alias("at"))
    later = same.where(F.size("at") > 1).select(F.inline(F.slice("at", 2, F.size("at") - 1))).groupBy("part", "seg").agg(F.collect_list("i").alias("later"))
    known = read.drop("firsts").join(later, ["part", "seg"], "left").select("conv_id", "part", "seg", "symbols", "later")

    def priced(symbols: str, later: list[int] | None) -> tuple:
        left = list(symbols)
        for i in later or []:
            left[i] = "d"
        symbols = "".join(left)
        return symbols, later or [], matrix(symbols)

    costs = _per_segment(known, priced, ["symbols", "later", "costs"], [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())], "symbols string, later array<int>, costs array<long>")
    costs = ws.save(costs, "costs")
    kind = edges.schema["conv_id"].dataType.simpleString()

    def to_the_end(segs: pd.DataFrame) -> pd.DataFrame:
        segs = segs.sort_values(["part", "seg"])
        after, found = endings()[0], []
        for costs in reversed(segs["costs"].tolist()):
            found.append(list(after))
            after = tuple(min(_NONE, *(int(costs[q * 4 + t]) + after[t] for t in STATES)) for q in STATES)
        return pd.DataFrame({"part": segs["part"], "seg": segs["seg"], "after": found[::-1], "final": [False] * (len(found) - 1) + [True]})

    ends = costs.select("conv_id", "part", "seg", "costs").groupBy("conv_id").applyInPandas(to_the_end, "part int, seg int, after array<long>, final boolean")
    ends = ws.save(ends, "ends")

    def exits(symbols: str, after: list[int], final: bool) -> tuple:
        return ([walk(symbols, tuple(after), q)[1] for q in STATES],)

    walked = costs.select("conv_id", "part", "seg", "symbols").join(ends, ["part", "seg"]).select("conv_id", "part", "seg", "symbols", "after", "final")
    walked = ws.save(_per_segment(walked, exits, ["exits"], [pa.list_(pa.int32())], "exits array<int>"), "walked")

    def entries(segs: pd.DataFrame) -> pd.DataFrame:
        segs = segs.sort_values(["part", "seg"])
        at, found = 0, []
        for exits in segs["exits"]:
            found.append(at)
            at = int(exits[at])
        return pd.DataFrame({"part": segs["part"], "seg": segs["seg"], "entry": found})

    starts = walked.groupBy("conv_id").applyInPandas(entries, "part int, seg int, entry int")
    return ws.save(ends.join(starts, ["part", "seg"]).join(costs.select("part", "seg", "later"), ["part", "seg"]), "links")


_LEGAL = ("su", "ua", "au")
_MEASURES = ["least_turn", "most_turn", "turns", "head", "tail", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_MEASURE_TYPES = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 5 + [pa.string()]
_MEASURE_SCHEMA = "least_turn long, most_turn long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

Repaired = list[tuple[int | None, str, str, str]]


def repaired(turns: list, roles: list[str], texts: list[str], later: list[int], after: list[int] | None, entry: int, final: bool) -> tuple[tuple, Repaired]:
    """The measures of a segment, and its rows after repair: turn, role, text, edit."""
    symbols, counts = faults(roles, texts, set(later))
    moves, at = walk(symbols, endings()[0] if after is None else tuple(after), entry)
    rows: Repaired = []
    cost, audit = 0, []
    for turn, role, text, (labels, letters, price, _) in zip(turns, roles, texts, moves):
        cost += price
        audit.append(labels)
        rows += [(None, ROLES[x], "", "I") for x in letters[: len(labels) - 1]]
        if labels[-1] != "D":
            rows.append((turn, ROLES[letters[-1]] if labels[-1] == "R" else role, text, labels[-1]))
    if final:
        missing = endings()[1][at]
        cost += endings()[0][at]
        audit.append("I" * len(missing))
        rows += [(None, ROLES[x], "", "I") for x in missing]
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    known = [t for t in turns if t is not None]
    span = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
    return (*span, initials[0], initials[-1], *counts, illegal, cost, "".join(audit)), rows


def _lines(rows: Repaired) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text, _ in rows).encode()


def _placed(rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Segments of whole conversations, and the others with what links them."""
    packed = ws.save(segments(rows), "segments")
    edges = packed.where("edge")
    return packed.where("not edge").drop("edge"), edges.drop("edge").join(_links(edges, ws), ["part", "seg"])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the rows that a repaired conversation has. place orders them and has gaps;
    edit is K (kept), R (other role) or I (inserted: null turn, empty text)."""
    inner, outer = _placed(rows, Workspace(rows.sparkSession, "conversations"))
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))

    def mend(turns, roles, texts, later=(), after=None, entry=0, final=True):
        return ([dict(zip(("turn", "role", "text", "edit"), r)) for r in repaired(turns, roles, texts, later, after, entry, final)[1]],)

    made = "rows array<struct<turn: long, role: string, text: string, edit: string>>"
    mended = [
        _per_segment(inner.select("conv_id", "part", "seg", "turns", "roles", "texts"), mend, ["rows"], [kind], made),
        _per_segment(outer.select("conv_id", "part", "seg", "turns", "roles", "texts", "later", "after", "entry", "final"), mend, ["rows"], [kind], made),
    ]
    every = mended[0].unionByName(mended[1]).select("conv_id", "part", "seg", F.posexplode("rows").alias("i", "row"))
    place = F.shiftleft(F.col("part").cast("long"), 43) + F.shiftleft(F.col("seg").cast("long"), 15) + F.col("i")
    return every.select("conv_id", place.alias("place"), "row.*")


def _hashes(pieces: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 from part, seg, piece, lines: a conversation's text streams through one task."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "part", "seg", "piece"]
    ordered = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher, begun = None, None, False
        for batch in batches:
            done = []
            for c, piece, lines in zip(*(x.to_pylist() for x in batch.columns)):
                if hasher is None or c != conv:
                    if hasher is not None:
                        done.append((conv, hasher.hexdigest()))
                    conv, hasher, begun = c, hashlib.sha256(), False
                if piece == 0 and lines is not None:  # a segment's first line follows another one
                    hasher.update(b"\n" if begun else b"")
                    begun = True
                hasher.update(lines or b"")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((batch.schema.field(0).type, pa.string()))], names=["conv_id", "repaired_sha256"])
            last = batch.schema.field(0).type
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([hasher.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows of each conversation."""
    ws = Workspace(rows.sparkSession, "conversations")
    inner, outer = _placed(rows, ws)

    def whole(turns, roles, texts):
        measures, rows = repaired(turns, roles, texts, (), None, 0, True)
        return (*measures, len(turns), hashlib.sha256(_lines(rows)).hexdigest())

    def partial(turns, roles, texts, later, after, entry, final):
        measures, rows = repaired(turns, roles, texts, later, after, entry, final)
        lines = _lines(rows)
        return (*measures, len(turns), [lines[i : i + PIECE] for i in range(0, max(len(lines), 1), PIECE)] if rows else [])

    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    measured = ["blank", "duplicate", "truncated", "illegal", "cost"]
    done = _per_segment(
        inner.select("conv_id", "part", "seg", "turns", "roles", "texts"),
        whole,
        [*_MEASURES, "n_rows", "repaired_sha256"],
        [*_MEASURE_TYPES, pa.int64(), pa.string()],
        f"{_MEASURE_SCHEMA}, n_rows long, repaired_sha256 string",
    ).select("conv_id", gaps, *measured, "audit", "repaired_sha256", "n_rows")

    parts = _per_segment(
        outer.select("conv_id", "part", "seg", "turns", "roles", "texts", "later", "after", "entry", "final"),
        partial,
        [*_MEASURES, "n_rows", "pieces"],
        [*_MEASURE_TYPES, pa.int64(), pa.list_(pa.binary())],
        f"{_MEASURE_SCHEMA}, n_rows long, pieces array<binary>",
    )
    parts = ws.save(parts, "parts")
    hashes = _hashes(parts.select("conv_id", "part", "seg", F.posexplode_outer("pieces").alias("piece", "lines")))
    # a row for each segment of a conversation: its segments' borders are compared in order
    by = Window.partitionBy("conv_id").orderBy("part", "seg")
    border = F.concat(F.lag("tail").over(by), "head")
    joined = parts.drop("pieces").withColumns(
        {"again": (F.lag("most_turn").over(by) == F.col("least_turn")).cast("long"), "crossed": (~border.isin(*_LEGAL)).cast("long")}
    )
    audits = F.sort_array(F.collect_list(F.struct("part", "seg", "audit")))
    summed = joined.groupBy("conv_id").agg(
        F.min("least_turn").alias("least_turn"),
        F.max("most_turn").alias("most_turn"),
        (F.sum("turns") - F.coalesce(F.sum("again"), F.lit(0))).alias("turns"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (F.sum("illegal") + F.coalesce(F.sum("crossed"), F.lit(0))).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(audits, lambda a: a["audit"]), "").alias("audit"),
        F.sum("n_rows").alias("n_rows"),
    )
    summed = summed.select(F.col("conv_id").alias("_conv"), gaps, *measured, "audit", "n_rows")
    summed = summed.join(hashes, F.col("_conv").eqNullSafe(F.col("conv_id"))).drop("_conv")
    return done.unionByName(summed)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with known faults, by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text,
    2 takes its [.!?] away, 3 repeats it, 4 makes its role user. Nulls (but for ids and turns) are one blank."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    made = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    )
    copies: Column = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.where("fate <> 0").withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def audit(rows: DataFrame) -> DataFrame:
    """The report of rows after damage, with a row of zeros for each conversation that lost all of its rows."""
    found = report(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows"]
    return every.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def oracle() -> str:
    """The rows of audit(conversations) in DuckDB SQL, without n_rows: paths are extended row by row, the least kept by state."""
    letters = {q: next(x for x in "ua" if x in GRAMMAR[q]) for q in STATES}
    inserts, eats = [], []
    for q in STATES:
        at, lines = q, ""
        for k in range(len(GRAMMAR)):
            inserts.append(f"({q}, {at}, {INSERT * k}, '{'I' * k}', '{lines}')")
            lines, at = lines + ROLES[letters[at]] + ":~", GRAMMAR[at][letters[at]]
        eats.append(f"({q}, 'D', NULL, {DELETE}, {q})")
        eats += [f"({q}, 'K', '{x}', 0, {to})" for x, to in GRAMMAR[q].items()]
        eats.append(f"({q}, 'R', '{ROLES[letters[q]]}', {REROLE}, {GRAMMAR[q][letters[q]]})")
    costs, missing = endings()
    ends = [f"({q}, {costs[q]}, '{'I' * len(missing[q])}', '{''.join(ROLES[x] + ':~' for x in missing[q])}')" for q in STATES]
    blank = r"[\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE crc AS ({crc32_sql("table")}),
    r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS fate FROM conversations, crc),
    damaged AS (SELECT conv_id, coalesce(conv_id::varchar, ' ') AS c, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM r WHERE fate <> 0),
    n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        lag(left(role, 1)) OVER w || left(role, 1) AS border, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        right(regexp_replace(text, '{blank}+$', ''), 1) NOT IN ('.', '!', '?') AS cut
        FROM damaged WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy)),
    f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN cut THEN 'truncated' END AS fault FROM n),
    measured AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (border NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY c),
    ins(q, q2, price, labels, added) AS (VALUES {", ".join(inserts)}),
    eats(q2, label, makes, price, q3) AS (VALUES {", ".join(eats)}),
    ends(q, price, labels, added) AS (VALUES {", ".join(ends)}),
    paths AS (SELECT c, 0::bigint AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS lines FROM measured UNION ALL
        SELECT * FROM (SELECT p.c, f.i, e.q3, p.cost + s.price + e.price + CASE WHEN label <> 'D' AND fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS cost,
            p.audit || s.labels || e.label AS audit,
            p.lines || replace(s.added, '~', chr(10)) || CASE label WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE makes || ':' || text || chr(10) END
            FROM paths p JOIN f ON f.c = p.c AND f.i = p.i + 1 JOIN ins s ON s.q = p.q JOIN eats e ON e.q2 = s.q2
            WHERE label = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (label = 'R' OR left(role, 1) = makes))
        QUALIFY row_number() OVER (PARTITION BY c, q3 ORDER BY cost, audit) = 1),
    best AS (SELECT p.c, cost + price AS cost, audit || labels AS audit, lines || replace(added, '~', chr(10)) AS lines
        FROM paths p JOIN measured m ON m.c = p.c AND m.n = p.i JOIN ends e ON e.q = p.q
        QUALIFY row_number() OVER (PARTITION BY p.c ORDER BY cost + price, audit || labels) = 1)
    SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
        coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit,
        sha256(left(coalesce(lines, ''), greatest(length(coalesce(lines, '')) - 1, 0))) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::varchar, ' ') AS c FROM conversations) LEFT JOIN measured USING (c) LEFT JOIN best USING (c)
    """
