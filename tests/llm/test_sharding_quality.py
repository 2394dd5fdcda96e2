import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from graywether.llm import quality, sharding
from graywether.llm.queries import QUERIES

from .fixtures import clashing, empty, odd


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(repeat) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def test_measures_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    for df in (docs, odd(spark)):
        for r in quality.judge(df).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got == measures(r.text), r.doc_id
            assert r.kept == (not r.base_failed and r.host_rate <= quality.REJECT_ABOVE)


def with_failures(spark, hosts):
    """Measured rows of hosts {host: (documents, of which fail `symbols`)}."""
    rows = [(h, 100, 500, 400 if i < k else 0, 10, 0, 0, False) for h, (n, k) in hosts.items() for i in range(n)]
    columns = "source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return spark.createDataFrame(rows, columns)


def test_hosts_shrink_towards_all(spark):
    hosts = {"good": (100, 20), "bad": (100, 60), "tiny": (1, 1), None: (40, 12)}
    got = {r.host: r for r in quality.host_verdicts(with_failures(spark, hosts)).collect()}
    assert not got["good"].host_rejected and got["bad"].host_rejected and not got[None].host_rejected
    assert 0.2 < got["good"].rate < 0.25 and got["bad"].rate < 0.6 and got["tiny"].rate < 1
    # by hand: the strength is 1 / rho - 1, rho the variance between hosts beyond the binomial one
    n, k = [100, 100, 1, 40], [20, 60, 1, 12]
    mean = sum(k) / sum(n)
    over = sum(a * (b / a - mean) ** 2 for a, b in zip(n, k, strict=True)) - 3 * mean * (1 - mean)
    rho = over / (mean * (1 - mean) * (sum(n) - sum(a * a for a in n) / sum(n) - 3))
    assert math.isclose(got["good"].rate_symbols, (20 + mean * (1 / rho - 1)) / (100 + 1 / rho - 1))
    assert got["good"].rate_few_words == 0 and got["bad"].failed_symbols == 60


def test_hosts_alike_share_one_rate(spark):
    got = quality.host_verdicts(with_failures(spark, {f"h{i}": (50, 10) for i in range(20)})).collect()
    assert all(math.isclose(r.rate, 0.2, rel_tol=1e-3) for r in got)


def test_quality_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    cur = con.execute(quality.oracle())
    names = [c[0] for c in cur.description]
    got = QUERIES["op10_quality"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_quality_on_empty_and_clashing(spark):
    assert quality.judge(empty(spark)).count() == 0
    assert quality.judge(clashing(spark, "n_words", "kept", "base_failed")).count() == 13


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs.collect()}
    rows = QUERIES["op9_sharding"](spark, sf_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    largest = max(r["size"] for r in rows)
    assert max(load.values()) <= max(1.05 * sum(load.values()) / 24, largest)


def test_odd_shards(spark):
    rows = sharding.shard(clashing(spark, "size", "shard", "law"), shards=3).collect()
    assert len(rows) == 13 and {r["size"] for r in rows if r.doc_id == 2} == {8}
    assert sharding.shard(empty(spark)).count() == 0


def test_repeated_rows_leave_shards_even(spark):
    rows = [(i, f"text number {i}") for i in range(20000)] + [(5, "the same row again")] * 20000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(docs, shards=8).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t) + 8) for i, t in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(load.values()) <= 1.01 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stored_map_is_read_and_edited(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/maps"
    sharding.shard(docs, shards=4, maps=path).collect()
    one = sharding.SlotMap.read(spark, path)
    assert (one.version, one.shards, len(one.shard_of)) == (1, 4, sharding.SLOTS)
    sharding.shard(docs, shards=5, previous=one, maps=path).collect()
    two = sharding.SlotMap.read(spark, path)
    assert two.version == 2 and two.shards == 5 and sharding.SlotMap.read(spark, path, 1).shard_of == one.shard_of
    stayed = sum(a == b for a, b in zip(one.shard_of, two.shard_of))
    assert stayed > 0.7 * sharding.SLOTS


def test_map_edits_move_few_slots():
    loads = [1000 + (i * 7919) % 500 for i in range(sharding.SLOTS)]
    one = sharding.SlotMap.empty(24).edited(loads)
    assert one.version == 1 and one.edited(loads).shard_of == one.shard_of
    grown = one.edited(loads, 25)
    changed = [i for i in range(sharding.SLOTS) if grown.shard_of[i] != one.shard_of[i]]
    assert len(changed) < 1.3 * sharding.SLOTS / 25
    assert sum(grown.shard_of[i] == 24 for i in changed) > 0.9 * len(changed)
    fewer = one.edited(loads, 23)
    assert all(fewer.shard_of[i] == s for i, s in enumerate(one.shard_of) if s < 23 and i not in fewer.moved)
    total = Counter()
    for i, s in enumerate(grown.shard_of):
        total[s] += loads[i]
    assert max(total.values()) - min(total.values()) <= 0.01 * sum(loads) / 25
