"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints at MAX_BITS = 3 or fewer differing bits differ in at most 3 bytes, so
they share at least 5 of 8 positional bytes. The index posts each distinct fingerprint under keys of 4 positional
bytes, chosen so that any 5 positions hold all 4 of some key; a pair that meets under a key is tallied (how many
of the 8 positional bytes are equal), kept from 5 on, then verified by its differing bits. A key with many postings
is split by a fifth position and, if that isn't enough, into pairs of blocks; the tally is the same everywhere.

Copies fall into one fingerprint before the index, by an aggregation with map-side sums. A key's postings share 32
bits; they yield links of a spanning forest, one at most per fingerprint, not all pairs. Components are found by
contracting the links round by round in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Postings of a key that one task tallies; a key with more is split.
POSTINGS = 20_000
_BLOCK = 2048
_CHUNK = 1 << 16

#: The rule of alike(): words of a shingle and the least Jaccard similarity.
WORDS = 5
LIKENESS = 0.8
#: Min-wise bytes of a text, neighbouring ones in a key of its index, and those that a pair has to share to be verified:
#: 3.4 standard deviations below the 64 expected at a similarity of 0.8.
BYTES = 80
KEY_BYTES = 5
SHARED = 52
#: Shared bytes from which on a pair is likely to be alike.
SURE = 66
#: Classes of a bucket that one task compares; a bucket with more is dealt into blocks.
BUCKET = 10_000
_ROWS = 256
_MASKS, _ODD = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BYTES, 1), dtype=np.uint32)
_ODD |= np.uint32(1)


def position_keys(shared: int = 8 - MAX_BITS, width: int = 4) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any `shared` positions hold one of them, chosen greedily."""
    need = set(combinations(range(8), shared))
    sets = list(combinations(range(8), width))
    found = []
    while need:
        best = max(sets, key=lambda s: sum(set(s) <= set(n) for n in need))
        found.append(best)
        need = {n for n in need if not set(best) <= set(n)}
    return found


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * i) for i in positions)
    return m - (1 << 64) if m >> 63 else m


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text (0 without words), as a signed integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, row_key and fp (the fingerprint as long) of each row; a null text counts as empty."""
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps)], names=[key, "row_key", "fp"])

    rows = docs.select(key, row_key(F.col(key)).alias("row_key"), "text")
    return rows.mapInArrow(run, f"`{key}` {kind.dataType.simpleString()}, row_key long, fp long")


def row_key(key: Column) -> Column:
    """Tells rows apart by key and text."""
    return F.xxhash64(key.cast("string"), F.col("text"))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (fingerprint, root) that join the distinct fingerprints of one key as their pairs within MAX_BITS do:
    equal positional bytes are tallied for each pair, pairs that reach the guaranteed minimum are verified."""
    fps = np.sort(fps.astype(np.int64)).view(np.uint64)
    label = np.arange(len(fps))

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label[:] = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]

    for i in range(0, len(fps), _BLOCK):
        for j in range(0, i + 1, _BLOCK):
            x = fps[i : i + _BLOCK, None] ^ fps[None, j : j + _BLOCK]
            tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
            a, b = np.nonzero(tally >= 8 - MAX_BITS)
            near = np.bitwise_count(x[a, b]) <= MAX_BITS
            a, b = a[near] + i, b[near] + j
            unite(a[a > b], b[a > b])
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[r])) for i, r in enumerate(label) if i != r]


def _tallied(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From postings (key_no, part, fp) sorted by key: links (a, b), and the postings of keys with more than `most`.

    Only one key's postings are held at a time; those of a larger key pass through as they come.
    """
    held: tuple[int, int] | None = None
    parts: list[np.ndarray] = []
    size, large = 0, False
    none = np.array([], dtype=np.int64)

    def out(a=none, b=none, no=none, part=none, fp=none) -> pa.RecordBatch:
        n, m = len(a), len(fp)
        columns = [
            pa.array(np.r_[a, np.zeros(m, np.int64)]), pa.array(np.r_[b, np.zeros(m, np.int64)]), pa.array(np.r_[np.zeros(n, np.int32), no].astype(np.int32)),
            pa.array(np.r_[np.zeros(n, np.int64), part]), pa.array(np.r_[np.zeros(n, np.int64), fp]), pa.array(np.r_[np.zeros(n, bool), np.ones(m, bool)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key_no", "part", "fp", "open"])

    def closed() -> pa.RecordBatch | None:
        if large or size < 2:
            return None
        links = np.array(forest(np.concatenate(parts)), dtype=np.int64).reshape(-1, 2)
        return out(links[:, 0], links[:, 1])

    for batch in batches:
        no, part, fp = (np.asarray(batch.column(c)) for c in ("key_no", "part", "fp"))
        cut = np.flatnonzero((no[1:] != no[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(fp)]
        if not len(fp):
            continue
        # a key of one posting inside the batch has no pair
        several = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
        for s, e in zip(starts[several], ends[several]):
            key = (int(no[s]), int(part[s]))
            if key != held:
                if (done := closed()) is not None:
                    yield done
                held, parts, size, large = key, [], 0, False
            size += e - s
            if size > most:
                kept = np.concatenate([*parts, fp[s:e]])
                yield out(no=np.full(len(kept), key[0]), part=np.full(len(kept), key[1]), fp=kept)
                parts, large = [], True
            else:
                parts.append(fp[s:e])
    if (done := closed()) is not None:
        yield done


def _by_key(postings: DataFrame, most: int) -> DataFrame:
    """Links and open postings of postings dealt by key."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings.repartition(n, "key_no", "part").sortWithinPartitions("key_no", "part", "fp")
    return rows.mapInArrow(lambda batches: _tallied(batches, most), "a long, b long, key_no int, part long, fp long, open boolean")


def links(classes: DataFrame, ws: Workspace) -> DataFrame:
    """a, b: links between the distinct fingerprints of classes (fp) that join all within MAX_BITS.

    A key with more than POSTINGS postings is split by a further byte position, which loses nothing: a pair that shares
    5 of 8 positions shares, beside the key's 4, at least one more. A key of 5 positions that is still larger is dealt
    into blocks by hash, and each two blocks meet in a task of their own.
    """
    four = [_mask(s) for s in position_keys()]
    five = [_mask(s) for s in combinations(range(8), 8 - MAX_BITS)]
    posted = F.posexplode(F.array(*map(F.lit, four))).alias("key_no", "_mask")
    rows = classes.select("fp", posted).select("key_no", F.col("fp").bitwiseAND(F.col("_mask")).alias("part"), "fp")
    first = ws.save(_by_key(rows, POSTINGS), "keys4")
    found, large = first.where("not open").select("a", "b"), first.where("open")
    if large.isEmpty():
        return found.distinct()
    nos = F.array(*[F.array(*[F.lit(i) for i, m in enumerate(five) if m & k == k]) for k in four])
    split = large.select("fp", F.explode(F.get(nos, F.col("key_no"))).alias("key_no"))
    part = F.col("fp").bitwiseAND(F.get(F.array(*map(F.lit, five)), F.col("key_no")))
    second = ws.save(_by_key(split.select("key_no", part.alias("part"), "fp").distinct(), POSTINGS), "keys5")
    found = found.union(second.where("not open").select("a", "b"))
    large = second.where("open").select("key_no", "part", "fp")
    if large.isEmpty():
        return found.distinct()
    blocks = large.groupBy("key_no", "part").agg(F.ceil(F.count("*") / (POSTINGS / 4)).alias("n"))
    dealt = large.join(blocks, ["key_no", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.xxhash64("key_no", "part", F.least("own", "other"), F.greatest("own", "other"))
    # two blocks have half of POSTINGS by expectation; the few more that chance deals stay together
    third = _by_key(dealt.select(F.lit(0).alias("key_no"), pair.alias("part"), "fp"), 1 << 62)
    return found.union(third.select("a", "b").where("a != b")).distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame | None:
    """node, root for every end of edges (a, b), or None without edges.

    In each round a node moves to the neighbour (or itself) with the least hash of that round, links between moved
    ends remain; expected rounds grow with the logarithm of the longest path. All steps are aggregations and joins.
    """
    edges, roots, k = ws.save(edges, "links"), None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        to = ws.save(least.select("node", F.least(F.col("m"), rank("node"))["n"].alias("to")), f"to{k}")
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta != tb")
        edges = ws.save(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"links{k}")
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), "to")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = ws.save(roots, f"roots{k}")
        k += 1
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, row_key, group, fingerprint (16 hex digits) and component_id of each row of docs (key, text).

    component_id is the smallest key reachable over links of MAX_BITS or fewer differing bits, the row's own
    included; nulls among keys are passed over, a component of null keys has a null id. group is the same for all
    rows of a component. Repeated rows share a component. Texts without words have fingerprint zero and are linked
    like any other.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs, key, shingle), "fingerprints")
    classes = ws.save(rows.groupBy("fp").agg(F.min(key).alias("rep")), "classes")
    roots = components(links(classes, ws), ws)
    if roots is None:
        found = classes.select("fp", F.col("fp").alias("group"), F.col("rep").alias("component_id"))
    else:
        placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
        least = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
        found = placed.join(least, "group").select("fp", "group", "component_id")
    found = ws.save(found, "found")
    return rows.join(found, "fp").select(
        key, "row_key", "group", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def positional_bytes(text: bytes | None, shingle: int = WORDS) -> tuple[int, bytes]:
    """The class of a text (a hash of its lower-cased words, as a signed integer) and its BYTES min-wise bytes: byte i
    is the low byte of the least shingle hash under order i. A text without words has bytes of zero."""
    words = (text or b"").lower().split()
    own = _class(words)
    if not words:
        return own, bytes(BYTES)
    hashes, least = shingle_hashes(words, shingle).astype(np.uint32), np.full(BYTES, (1 << 32) - 1, np.uint32)
    for i in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[i : i + _BLOCK] ^ _MASKS) * _ODD).min(axis=1), out=least)
    return own, least.astype(np.uint8).tobytes()


def _class(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text's words (fewer words: of the whole sequence), ascending."""
    if not words:
        return np.array([], dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def byte_rows(docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """key, row_key, cls and sig (BYTES bytes) of each row; a null text counts as empty."""
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [positional_bytes(t.as_py(), shingle) for t in batch.column(2).cast(pa.large_binary())]
            columns = [*batch.columns[:2], pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "row_key", "cls", "sig"])

    rows = docs.select(key, row_key(F.col(key)).alias("row_key"), "text")
    return rows.mapInArrow(run, f"`{key}` {kind.dataType.simpleString()}, row_key long, cls long, sig binary")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A posting (bucket, cls) for each key: KEY_BYTES neighbouring positions of a class's bytes, with the key's number."""
    keys = BYTES // KEY_BYTES
    for batch in batches:
        sig = _matrix(batch.column(1)).reshape(-1, keys, KEY_BYTES)
        wide = np.zeros((len(sig), keys, 8), np.uint8)
        wide[:, :, :KEY_BYTES], wide[:, :, KEY_BYTES] = sig, np.arange(keys)
        cls = np.repeat(np.asarray(batch.column(0)), keys)
        yield pa.RecordBatch.from_arrays([pa.array(wide.view("<i8").reshape(-1)), pa.array(cls)], names=["bucket", "cls"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _tally(places: np.ndarray, rows: slice) -> np.ndarray:
    """How many positional bytes the given rows share with every row; places has a line for each position."""
    found = np.zeros((len(places[0, rows]), places.shape[1]), np.uint8)
    for place in places:
        found += place[rows, None] == place
    return found


def _proposed(cls: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket (rows ascending by cls) that share SHARED bytes or more, at most one for each row: the first row
    before it whose tally estimates the likeness, else the one of the highest tally."""
    a, b, places = [], [], np.ascontiguousarray(sig.T)
    for i in range(0, len(cls), _ROWS):
        tally = _tally(places, slice(i, i + _ROWS))
        tally[np.arange(i, i + len(tally))[:, None] <= np.arange(len(cls))] = 0
        sure = tally >= SURE
        best = np.where(sure.any(axis=1), sure.argmax(axis=1), tally.argmax(axis=1))
        v = np.flatnonzero(tally[np.arange(len(tally)), best] >= SHARED)
        a.append(cls[best[v]])
        b.append(cls[v + i])
    return np.concatenate(a), np.concatenate(b)


def _across(bucket: int, sig: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows u < v of one bucket, of different components, that share SHARED bytes or more, and how many: of two rows that
    meet in several buckets, in the one of their first common key only."""
    places, no = np.ascontiguousarray(sig.T), bucket >> (8 * KEY_BYTES) & 255
    for i in range(0, len(sig), _ROWS):
        tally = _tally(places, slice(i, i + _ROWS))
        v, u = np.nonzero((tally >= SHARED) & (comp[i : i + _ROWS, None] != comp) & (np.arange(i, i + len(tally))[:, None] > np.arange(len(sig))))
        for j in range(0, len(u), 1 << 16):
            x, y = u[j : j + (1 << 16)], v[j : j + (1 << 16)] + i
            first = (sig[x] == sig[y]).reshape(len(x), -1, KEY_BYTES).all(axis=2).argmax(axis=1) == no
            yield x[first], y[first], tally[y[first] - i, x[first]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows (bucket, part, ...) sorted by both, in whole parts, with where each part starts and ends; little more than one
    part is held at a time."""
    held: list[pa.RecordBatch] = []

    def closed(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(batches)
        bucket, part = (rows.column(c).to_numpy() for c in ("bucket", "part"))
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        return rows, starts, np.r_[starts[1:], len(bucket)]

    for batch in batches:
        if not len(batch):
            continue
        bucket, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        last = int(np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))[-1]) + 1 if (bucket[0], part[0]) != (bucket[-1], part[-1]) else 0
        if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (bucket[0], part[0]):
            yield closed(held)
            held = []
        if last:
            yield closed([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield closed(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that rows (bucket, part, cls, comp, sig), sorted by bucket, part and cls, propose."""
    for rows, starts, ends in _parts(batches):
        cls, sig = rows.column("cls").to_numpy(), _matrix(rows.column("sig").combine_chunks())
        two = starts[ends - starts == 2]
        near = two[(sig[two] == sig[two + 1]).sum(axis=1) >= SHARED]
        pairs = [(cls[near], cls[near + 1]), *(_proposed(cls[s:e], sig[s:e]) for s, e in zip(starts, ends) if e - s > 2)]
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, part, cls, comp, sig) those that share SHARED bytes with a row of another component: no pairs, each
    row once a part."""
    for rows, starts, ends in _parts(batches):
        bucket, comp = rows.column("bucket").to_numpy(), rows.column("comp").to_numpy()
        sig = _matrix(rows.column("sig").combine_chunks())
        asked = np.zeros(len(bucket), bool)
        for s, e in zip(starts, ends):
            for u, v, _ in _across(int(bucket[s]), sig[s:e], comp[s:e]):
                asked[s + u] = asked[s + v] = True
        if asked.any():
            yield from rows.filter(pa.array(asked)).to_batches()


def _joining(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the components of rows (bucket, part, cls, comp, sig, grams) as all their pairs that reach the
    likeness do. The likeliest pairs are tested first, on all shingles; what a link has joined isn't tested again."""
    for rows, starts, ends in _parts(batches):
        bucket, cls, comp = (rows.column(c).to_numpy() for c in ("bucket", "cls", "comp"))
        sig, grams = _matrix(rows.column("sig").combine_chunks()), rows.column("grams").combine_chunks()
        a, b = [], []
        for s, e in zip(starts, ends):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams[s:e]]
            root = {int(c): int(c) for c in comp[s:e]}

            def find(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = c = root[root[c]]  # noqa: B023
                return c

            for u, v, tally in _across(int(bucket[s]), sig[s:e], comp[s:e]):
                for k in np.argsort(-tally.astype(np.int16), kind="stable"):
                    x, y = sets[u[k]], sets[v[k]]
                    cu, cv = find(int(comp[s + u[k]])), find(int(comp[s + v[k]]))
                    if cu != cv and min(len(x), len(y)) >= least * max(len(x), len(y)) and likeness(x, y) >= least:
                        root[max(cu, cv)] = min(cu, cv)
                        a.append(cls[s + u[k]])
                        b.append(cls[s + v[k]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _hashed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """cls and the distinct shingle hashes of rows (text)."""
    for batch in batches:
        words = [(t.as_py() or b"").lower().split() for t in batch.column(0).cast(pa.large_binary())]
        grams = [shingle_hashes(w, shingle).tobytes() for w in words]
        yield pa.RecordBatch.from_arrays([pa.array([_class(w) for w in words], pa.int64()), pa.array(grams, pa.binary())], names=["cls", "grams"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, grams_a, grams_b) whose sets of shingles reach the likeness."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3)]
        keep = [min(len(a), len(b)) >= least * max(len(a), len(b)) and likeness(a, b) >= least for a, b in zip(*sets)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _grams(met: DataFrame, docs: DataFrame, classes: DataFrame, ws: Workspace, shingle: int) -> DataFrame:
    """cls and grams (the distinct shingle hashes) of each class that meets another, from the text of one of its rows."""
    wanted = classes.join(met.select("cls").distinct(), "cls", "left_semi")
    # written first and of keys alone, so that Spark knows how small it is when it chooses how to join the texts
    wanted = ws.save(wanted.select(F.col("rep").alias("__row_key")), "wanted")
    texts = docs.select(row_key(F.col("__key")).alias("__row_key"), "text").join(wanted, "__row_key", "left_semi").select("text")
    return ws.save(texts.mapInArrow(lambda batches: _hashed(batches, shingle), "cls long, grams binary").dropDuplicates(["cls"]), "grams")


def _verify(pairs: DataFrame, grams: DataFrame, ws: Workspace, name: str, least: float) -> DataFrame:
    """pairs (a, b), each tested on all shingles of the two classes."""
    a, b = (grams.select(F.col("cls").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "grams_a", "grams_b")
    return ws.save(rows.mapInArrow(lambda batches: _verified(batches, least), "a long, b long"), f"verified_{name}")


def _meeting(met: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, part, cls, comp, sig of the classes that meet in a bucket (bucket, cls, comp, n), part by part; a bucket of more
    than BUCKET classes is dealt into blocks, each two of which meet in a part of their own."""
    blocks = F.ceil(F.col("n") / F.lit(BUCKET / 2))
    dealt = met.withColumn("k", F.when(F.col("n") > BUCKET, blocks).otherwise(1)).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
    part = F.least("own", "other") * F.col("k") + F.greatest("own", "other")
    rows = dealt.withColumn("part", part.cast("long")).join(classes.select("cls", "sig"), "cls")
    return _in_parts(rows.select("bucket", "part", "cls", "comp", "sig"))


def _in_parts(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "cls")


def alike(docs: DataFrame, key: str = "doc_id", shingle: int = WORDS, least: float = LIKENESS) -> DataFrame:
    """key, row_key and group of each row of docs (key, text): rows are linked where the sets of their texts' shingles
    have a Jaccard similarity of `least` or more, and a group is what links reach.

    The same index and count filter as near_duplicates over other bytes: 64 majority bits of two texts at a
    similarity of 0.8 differ in about 10 places, beyond what equal positional bytes can find, while a min-wise byte is
    equal as often as the similarity says. A pair at 0.8 meets under one of 16 keys of 5 bytes with a chance of 0.998
    and passes the filter with 0.999; what passes is verified on all shingles. Fewer words than a shingle has count as one
    shingle; texts without words are alike, null ones included. Equal texts (but for case and blanks) fall together first.

    In a bucket every class first proposes one partner. What these links leave apart is compared inside the bucket's
    task, a pair in the bucket of its first common key, and only what joins two components comes out: no list of pairs.
    """
    ws = Workspace(docs.sparkSession, "alike")
    docs = docs.select(F.col(key).alias("__key"), "text")
    rows = ws.save(byte_rows(docs, "__key", shingle), "rows")
    classes = ws.save(rows.groupBy("cls").agg(F.min("row_key").alias("rep"), F.first("sig").alias("sig")), "classes")
    postings = classes.select("cls", "sig").mapInArrow(_posted, "bucket long, cls long")
    postings = ws.save(postings, "postings")
    large = ws.save(postings.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "large")
    met = ws.save(postings.join(large, "bucket").withColumn("comp", F.lit(0).cast("long")), "met")
    ws.drop("postings", "large")
    pairs = _meeting(met, classes).mapInArrow(_candidates, "a long, b long").distinct()
    first = ws.save(pairs, "pairs_first")
    grams = _grams(met, docs, classes, ws, shingle)
    links = _verify(first, grams, ws, "first", least)
    roots = components(links, ws)
    if roots is None:
        apart = met.withColumn("comp", F.col("cls"))
    else:
        to = roots.select(F.col("node").alias("cls"), "root")
        apart = met.drop("comp").join(to, "cls", "left").select("bucket", "cls", "n", F.coalesce("root", "cls").alias("comp"))
    apart = ws.save(apart, "apart")
    several = ws.save(apart.groupBy("bucket").agg((F.min("comp") < F.max("comp")).alias("s")).where("s").select("bucket"), "several")
    schema = "bucket long, part long, cls long, comp long, sig binary"
    left = ws.save(_meeting(apart.join(several, "bucket", "left_semi"), classes).mapInArrow(_open, schema), "open")
    more = _in_parts(left.join(grams, "cls").select("bucket", "part", "cls", "comp", "sig", "grams"))
    more = ws.save(more.mapInArrow(lambda batches: _joining(batches, least), "a long, b long"), "verified_second")
    ws.drop("apart", "several", "open", "met")
    if not more.isEmpty():
        # the second links join components of the first
        roots = components(links.union(more), Workspace(docs.sparkSession, "alike"))
    if roots is None:
        return rows.select(F.col("__key").alias(key), "row_key", F.col("cls").alias("group"))
    found = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    return found.select(F.col("__key").alias(key), "row_key", F.coalesce("root", "cls").alias("group"))


def keep_one(docs: DataFrame, key: str = "doc_id", shingle: int = WORDS, least: float = LIKENESS) -> DataFrame:
    """docs with one row of each group of alike(): the one of the least key (nulls last, then of the least row_key).

    Rows that repeat the one that stays go too. Columns are those of docs.
    """
    ws = Workspace(docs.sparkSession, "keep_one")
    found = ws.save(alike(docs, key, shingle, least).groupBy("group", "row_key").agg(F.min(key).alias("k"), F.count("*").alias("n")), "found")
    first = F.min(F.struct(F.col("k").isNull().alias("last"), "k", F.col("row_key").alias("__row_key"))).alias("m")
    stay = found.groupBy("group").agg(first, F.sum("n").alias("all")).where(F.col("all") > 1)
    met = ws.save(found.join(stay.select("group", F.col("m.__row_key").alias("stays")), "group").select("row_key", "stays", "n"), "met")
    # the rows that go, and those that stay once of several alike: fewer than those that just stay, so the texts are left where they are
    # as long as Spark may send these keys to all tasks
    gone = ws.save(met.where("row_key <> stays or n > 1").select(F.col("row_key").alias("__row_key")), "gone")
    again = ws.save(met.where("row_key = stays and n > 1").select(F.col("row_key").alias("__row_key")), "again")
    keyed = docs.withColumn("__row_key", row_key(F.col(key)))
    single = keyed.join(gone, "__row_key", "left_anti")
    repeated = keyed.join(again, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return single.union(repeated).select(*docs.columns)
