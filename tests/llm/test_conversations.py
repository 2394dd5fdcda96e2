import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from graywether.llm import conversations as C
from graywether.llm.queries import ORACLES, QUERIES

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}:{r[3]}".encode()).hexdigest()))


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        rest = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_path(rows):
    """Cost, labels and lines of the least path, by keeping the least prefix for each state of written initials."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def put(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry
            return True
        return False

    def inserted(table):
        todo = list(table)
        while todo:
            q = todo.pop()
            cost, labels, lines = table[q]
            for role in ("user", "assistant"):
                if (to := step.get((q, role[0]))) and put(table, to, (cost + 5, labels + "I", (*lines, role + ":"))):
                    todo.append(to)
        return table

    for (_, _, role, text), fault in zip(rows, faults(rows)):
        nxt = {}
        for q, (cost, labels, lines) in inserted(best).items():
            put(nxt, q, (cost + 2, labels + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if to := step.get((q, role[:1])):
                put(nxt, to, (cost + more, labels + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if to := step.get((q, other[0])):
                    put(nxt, to, (cost + 1 + more, labels + "R", (*lines, f"{other}:{text}")))
        best = nxt
    return min(v for q, v in inserted(best).items() if q in ("", "a"))


def brute(rows):
    """Reports by conversation, by the contract's words."""
    found = {}
    for c in {r[0] for r in rows}:
        mine = ordered(damage([r for r in rows if r[0] == c]))
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, labels, lines = plain_path(mine)
        found[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
            cost,
            labels,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reports(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("rows_a_segment", [4096, 2])
def test_query_equals_brute_force_and_sql(spark, sf_dir, monkeypatch, rows_a_segment):
    monkeypatch.setattr(C, "SEGMENT_ROWS", rows_a_segment)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert reports(QUERIES["op11_conversations"](spark, sf_dir)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(ORACLES["op11_conversations"]).fetchall()} == want


def noise(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", "User", "ux", None, "user", "assistant"]
    texts = ["Yes.", "No", " \t\x0b", "", None, "Why?\n ", "é!", "so on", "Fine.", "a.b", "\xa0", "ok. ", "x" * 50 + "."]
    return [(conv, rng.choice([None, i, i, i, i // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.") for i in range(n)]


@pytest.mark.parametrize("rows_a_segment", [4096, 3, 1])
def test_random_conversations(spark, monkeypatch, rows_a_segment):
    monkeypatch.setattr(C, "SEGMENT_ROWS", rows_a_segment)
    monkeypatch.setattr(C, "PIECE", 7)
    rng = random.Random(rows_a_segment)
    rows = [r for c in [*range(60), None, -5] for r in noise(rng, c, rng.randrange(1, 12))]
    rng.shuffle(rows)
    assert reports(C.audit(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_least_path_against_all_paths():
    """The walk against every string of edits, for short inputs."""
    for symbols in itertools.chain.from_iterable(itertools.product("dsuaxUA", repeat=n) for n in range(4)):
        best = None
        choices = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
        eats = [[("D", "")] + ([] if s == "d" else [("R", "u"), ("R", "a"), ("K", s.lower())]) for s in symbols]
        for gaps in itertools.product(choices, repeat=len(symbols) + 1):
            if sum(map(len, gaps)) > 2:
                continue
            for done in itertools.product(*eats):
                written = "".join(g + w for g, (_, w) in zip(gaps, (*done, ("", ""))))
                if not LEGAL.fullmatch(written):
                    continue
                cost = 5 * sum(map(len, gaps)) + sum({"D": 2, "R": 1, "K": 0}[e] + 5 * (e != "D" and s.isupper()) for s, (e, _) in zip(symbols, done))
                labels = "".join("I" * len(g) + e for g, (e, _) in zip(gaps, (*done, ("", ""))))
                best = min(best or (cost, labels), (cost, labels))
        moves, at = C.walk("".join(symbols), C.endings()[0], 0)
        got = (sum(m[2] for m in moves) + C.endings()[0][at], "".join(m[0] for m in moves) + "I" * len(C.endings()[1][at]))
        assert got == best, symbols


def test_a_conversation_with_most_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_ROWS", 64)
    rng = random.Random(5)
    rows = noise(rng, 7, 3000) + [r for c in range(100, 140) for r in noise(rng, c, 6)] + [(8, 1, "user", "Again and again.")] * 900
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    packed = C.segments(C.damaged(df)).collect()
    assert max(len(r.turns) for r in packed) <= 64 and len({r.part for r in packed if r.conv_id == 8}) > 1
    assert reports(C.audit(df)) == brute(rows)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_BYTES", 1000)
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} " + "word " * 300 + ".") for c in range(3) for t in range(8)]
    assert reports(C.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repaired_rows(spark, monkeypatch):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "system", "Be."), (1, 3, "user", "Hi."), (1, 4, "user", "Tell"), (1, 5, "assistant", "All."),
        (2, 0, "user", "One."),
        (3, None, "user", " "),
    ]
    for n in (4096, 2):
        monkeypatch.setattr(C, "SEGMENT_ROWS", n)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {}
        for r in C.repair(df).orderBy("conv_id", "place").collect():
            got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.edit))
        want = {r.conv_id: r for r in C.report(df).collect()}
        for c, lines in got.items():
            assert LEGAL.fullmatch("".join(role[0] for _, role, _, _ in lines))
            text = "\n".join(f"{role}:{text}" for _, role, text, _ in lines)
            assert want[c].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert "".join(e for *_, e in lines) == want[c].audit.replace("D", "")
        assert 3 not in got and want[3].audit == "D" and want[3].cost == 2


def test_empty_table_extra_columns_and_lost_conversations(spark):
    assert C.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hi.", 1, "x"), (None, 3, "user", "Hi there.", 2, "y")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, seg int, audit string")
    got = reports(C.audit(df))
    assert got == brute([r[:4] for r in rows]) and got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
