"""Language-model scores from a probabilistic suffix tree over words.

The tree is learned from the documents outside the held-out fold. A state is a context of some words; the root is the
empty one. Level by level, a context that occurs MIN_CONTEXT times or more and whose suffix is a state becomes one if
its next-symbol distribution diverges from its suffix's: coding each of its occurrences by the counts of the others
(one left out) has to save DIVERGENCE bits or more an occurrence. Levels are added until no context passes, so a state
is as long as the corpus gives reason for and the tree grows with the corpus.

A state's distribution is smoothed with its suffix's as prior, of strength T ** PRIOR for T occurrences, down to word
counts with half a count added. A text is scored by the longest state before each token.

Documents are packed into chunks of about CHUNK tokens. At each level a chunk asks for each distinct sequence it has
under a context that is frequent. What it asks goes, packed into arrays, to parts by a hash of the context; a context of
more than PART occurrences has several parts, by the sequence's hash, so a part holds about PART sequences whatever is
common. A level has as many parts as its sequences fill, which are few from contexts of three words on. As a request is a
row for each chunk and part, both sizes grow with the square root of the input beyond GROWS bytes of text, so that these rows
grow with the input and not with its square. A part adds up the chunks' counts, which are the counts of the tree, tests its contexts and answers each chunk
in the order in which it asked; contexts of several parts are tested on the sum over these. The chunks then update
their tokens. No count passes through the driver and none is broadcast. Words and contexts are told apart by 64-bit
hashes, sequences by their context's and 48 bits of their own.

Whole chunks are read for words and for contexts of one word only. From then on a chunk is the tokens that are still
sought: the sequence of one token is the context of the next, so a token needs its own word and its context's hash and
nothing else of the text. A token is sought as long as its context is frequent and its suffix, or the next token's, is a
state: without the one its score is final, without the other nobody asks for its count. Both follow from the sequence, so
all occurrences of a sequence are dropped together and the counts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

#: Fold of held-out documents: crc32 of the key's digits, mod FOLDS.
FOLDS, HELD_OUT = 5, 1
#: Occurrences from which on a context is tested; the same at every size.
MIN_CONTEXT = 32
#: Bits an occurrence that a state has to save.
DIVERGENCE = 0.01
PRIOR = 0.7
CHUNK = 500_000
_GROUP = 1 << 20  # bytes of text that are split at once
#: Sequences that a part counts, about; a context that occurs more often has several parts.
PART = 1_000_000
#: Bytes of text from which on chunks and parts grow.
GROWS = 1 << 31
#: The test reads -log2 p of a suffix in steps of 1 / 2 ** _STEPS.
_STEPS = 16
_END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def held_out(key: Column) -> Column:
    """Whether a row is held out; a row without a key is in the training part."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _schema(kind: str) -> str:
    """Of a row for each whole chunk. seqs: how many distinct words; words: their hashes; at: for each document an end, its words and an end, as places
    in words."""
    return f"chunk long, keys array<{kind}>, held array<boolean>, sizes array<int>, seqs long, words binary, at binary"


#: Of a chunk's sought tokens: seqs is the number of their sequences, done has the log10 of each document's finished ones. Of the others, pos (steps between places in the
#: chunk), doc (steps), gram (which sequence, marked) and train are listed by token; word, before (which word, which context, marked) and p (by the longest
#: state so far) by sequence; context (the hash of the words before that are sought next), t (its occurrences) and state (whether
#: its suffix is one) by context.
_SOUGHT = "chunk long, seqs long, done array<double>, words binary, pos binary, doc binary, gram binary, train binary, word binary, before binary, p binary, context binary, t binary, state binary"


def _packed(*arrays: np.ndarray, widths: tuple = ()) -> bytes:
    """Some arrays as bytes: of each all first bytes, all second ones and so on (of its width, if given: the low ones). Each of
    these is compressed alone, but those of hashes; one of zeros takes no room."""
    sizes, planes = [], []
    for x, width in zip(arrays, widths or (None,) * len(arrays)):
        for plane in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T[:width]:
            data = plane.tobytes()
            if x.dtype != np.uint64:
                less = pa.compress(data, codec="zstd", asbytes=True) if np.frombuffer(data, dtype=np.uint8).any() else b""
                data = less if len(less) < len(data) else data
            sizes.append(len(data))
            planes.append(data)
    return np.array([*map(len, arrays), *sizes], dtype="<u4").tobytes() + b"".join(planes)


def _unpacked(data: bytes, *kinds: type, widths: tuple = ()) -> list[np.ndarray]:
    widths = [w or np.dtype(kind).itemsize for kind, w in zip(kinds, widths or (None,) * len(kinds))]
    lengths = np.frombuffer(data, dtype="<u4", count=len(kinds)).tolist()
    sizes = iter(np.frombuffer(data, dtype="<u4", count=sum(widths), offset=4 * len(kinds)).tolist())
    out, at, data = [], 4 * (len(kinds) + sum(widths)), memoryview(data)
    for kind, width, n in zip(kinds, widths, lengths):
        values = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8)
        for j in range(width):
            plane = data[at : at + next(sizes)]
            at += len(plane)
            if plane:
                values[:, j] = np.frombuffer(plane if len(plane) == n else pa.decompress(plane, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8)
        out.append(values.view(kind).ravel())
    return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value comes first, in that order, and each value's number in it."""
    number = pd.factorize(values)[0]
    return np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), number


def _marked(number: np.ndarray) -> np.ndarray:
    """Numbers in the order in which they first come, as 0 where they do and one more elsewhere: mostly zeros take little room."""
    new = np.diff(np.maximum.accumulate(number), prepend=number.dtype.type(-1)) > 0
    return np.where(new, 0, number + 1).astype(np.int32)


def _unmarked(code: np.ndarray) -> np.ndarray:
    new = code == 0
    return np.where(new, np.cumsum(new) - 1, code - 1)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and how many each text has; the ends that follow them aren't listed."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # of the six blanks, with an empty word where they begin or end a text
    offsets, found = split.offsets.to_numpy(), split.flatten()
    some = pc.not_equal(pc.binary_length(found), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return found.filter(some), np.diff(upto[offsets - offsets[0]])


def _numbered(words: list[pa.Array], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of distinct words, the end first, and the texts as places in them, with an end before and after each text."""
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary.cast(pa.large_binary())])
    _, offsets, data = distinct.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[distinct.offset :][: len(distinct) + 1].tolist() if len(distinct) else [0]
    data = data.to_pybytes() if data else b""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in pairwise(ends)), dtype=np.uint64, count=len(distinct))
    at = np.zeros(len(coded) + 2 * len(sizes), dtype=np.int32)
    at[np.arange(len(coded)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = coded.indices.to_numpy() + 1
    return np.concatenate([[_END], hashes]), at


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks, of about so many tokens, of rows (key, held_out, text), before anything is counted."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        keys, held, seq, sizes, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words, at = _numbered(seq, np.concatenate(sizes))
            order = np.argsort(-np.bincount(at), kind="stable")  # frequent words have small places, which compress
            words, at = words[order], np.argsort(order)[at]
            columns = [
                pa.array([made], pa.int64()), pa.array([list(chain.from_iterable(keys))], pa.list_(key_type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes) + 1], pa.list_(pa.int32())), pa.array([len(words)], pa.int64()), pa.array([_packed(words)], pa.binary()),
                pa.array([_packed(at.astype(np.int32))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            texts = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            group = np.cumsum(pc.binary_length(texts).to_numpy() + 1) // _GROUP
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for low, high in zip(cuts, [*cuts[1:], len(group)]):
                words, n = tokens(texts.slice(low, high - low))
                keys.append(batch.column(0).slice(low, high - low).to_pylist())
                held.extend(batch.column(1).slice(low, high - low).to_pylist())
                seq.append(words)
                sizes.append(n)
                size += len(words) + 2 * len(n)
                if size >= chunk:
                    yield out()
                    made, keys, held, seq, sizes, size = made + 1, [], [], [], [], 0
        if seq:
            yield out()

    names = [part.split(" ")[0] for part in _schema(kind).split(", ")]
    return rows.select("key", "held_out", "text").mapInArrow(run, _schema(kind))


class _Chunk:
    """A whole chunk's arrays; seq holds the hashes of all its documents, each with an end before it and one after."""

    def __init__(self, row: dict):
        self.row = row
        self.sizes = np.asarray(row["sizes"].flatten())
        read = lambda name, kind: _unpacked(row[name][0].as_py(), kind)[0]
        self.words, self.at = read("words", np.uint64), read("at", np.int32)
        self.counts = read("counts", np.int64) if "counts" in row else None
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.token = np.ones(len(self.at), dtype=bool)
        self.token[first] = False
        self.train = ~np.asarray(row["held"].flatten().to_numpy(zero_copy_only=False), dtype=bool)[self.doc]

    def per_doc(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[at], weights=value, minlength=len(self.sizes))

    def distinct(self) -> _Words:
        return _Words(self.words, np.bincount(self.at, weights=(self.token & self.train).astype(float), minlength=len(self.words)))

    def known(self) -> np.ndarray:
        pos = np.flatnonzero(self.token)
        return self.per_doc((self.counts[self.at[pos]] > 0).astype(float), pos).astype(np.int64)

    def base(self, total: tuple[int, int]) -> np.ndarray:
        """The documents' scores by word counts alone."""
        pos = np.flatnonzero(self.token)
        return self.per_doc(np.log10(self.p(total))[self.at[pos]], pos)

    def p(self, total: tuple[int, int]) -> np.ndarray:
        n, v = total
        return (self.counts + 0.5) / (n + 0.5 * (v + 1))

    def many(self) -> np.ndarray:
        """Tokens before which one word is frequent enough to be sought."""
        many = self.token.copy()
        many[1:] &= (self.counts >= MIN_CONTEXT)[self.at[:-1]]
        return many

    def start(self, total: tuple[int, int]) -> _Sought:
        p, many = self.p(total), self.many()
        pos, rest = np.flatnonzero(many), np.flatnonzero(self.token & ~many)
        s = _Sought()
        s.words, s.done = self.words, self.per_doc(np.log10(p)[self.at[rest]], rest)
        before = self.at[pos - 1]
        s.pos, s.doc, s.word, s.context, s.train = pos.astype(np.int32), self.doc[pos].astype(np.int32), self.at[pos], self.words[before], self.train[pos]
        s.t, s.p, s.state = self.counts[before], p[self.at[pos]], np.ones(len(pos), dtype=bool)
        return s


class _Words:
    """Distinct words of a chunk and how often its training documents have them (None: not asked again)."""

    def __init__(self, words: np.ndarray, n: np.ndarray | None):
        self.words, self.n = words, np.zeros(len(words)) if n is None else n


class _Sought:
    """The tokens of a chunk that are still sought, in order of place."""

    _TOKENS = ("pos", "doc", "word", "context", "t", "p", "state", "train")

    @staticmethod
    def read(row: dict) -> _Sought:
        s = _Sought()
        get = lambda name, kind: _unpacked(row[name][0].as_py(), kind)[0]
        s.done, s.words = np.asarray(row["done"].flatten(), dtype=float), get("words", np.uint64)
        s.pos, s.doc = (np.cumsum(get(n, np.int32), dtype=np.int32) for n in ("pos", "doc"))
        s.train, gram = get("train", bool), _unmarked(get("gram", np.int32))
        before = _unmarked(get("before", np.int32))[gram]
        s.word, s.p = get("word", np.int32)[gram], get("p", np.float32)[gram].astype(float)
        s.context, s.t, s.state = get("context", np.uint64)[before], get("t", np.int64)[before], get("state", bool)[before]
        return s

    def columns(self) -> list:
        """seqs, done and the packed arrays; words that no token has any more are left out."""
        first, gram = _distinct(self.grams())
        at, before = _distinct(self.context[first])
        at = first[at]
        kept, word = np.unique(self.word[first], return_inverse=True)
        steps = lambda x: np.diff(x, prepend=np.int32(0)).astype(np.int32)
        tokens = [steps(self.pos), steps(self.doc), _marked(gram), self.train]
        arrays = [self.words[kept], *tokens, word.astype(np.int32), _marked(before), self.p[first].astype(np.float32), self.context[at], self.t[at], self.state[at]]
        return [pa.array([len(first)], pa.int64()), pa.array([self.done.tolist()], pa.list_(pa.float64())), *(pa.array([_packed(x)], pa.binary()) for x in arrays)]

    def grams(self) -> np.ndarray:
        """Hashes of each token's context and the token."""
        return _mixed(self.context, self.words[self.word])

    def finish(self, which: np.ndarray) -> None:
        self.done = self.done + np.bincount(self.doc[which], weights=np.log10(self.p[which]), minlength=len(self.done))

    def keep(self, on: np.ndarray) -> None:
        """Go on with some tokens; the others are done."""
        self.finish(~on)
        for name in self._TOKENS:
            setattr(self, name, getattr(self, name)[on])

    def deepen(self, count: np.ndarray, became: np.ndarray, gram: np.ndarray) -> None:
        """Take the answers: each token's count after its context, and whether that is a state; go on with contexts longer by a
        word, which are the sequences of the tokens before."""
        prior = self.t.astype(float) ** PRIOR
        self.p = np.where(became, (count + prior * self.p) / (self.t + prior), self.p)
        after = np.zeros(len(self.pos), dtype=bool)  # whether the token before stands right before
        after[1:] = np.diff(self.pos) == 1
        self.t = np.where(after, np.roll(count, 1), 0)
        self.context = np.roll(gram, 1)
        self.state = became
        needed = np.zeros(len(self.pos), dtype=bool)  # by the next token
        needed[:-1] = became[1:] & after[1:]
        self.keep((self.t >= MIN_CONTEXT) & (became | needed))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MIX[0] + b
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


#: Of a request, packed: the contexts, each with its occurrences, whether it is tested and how many sequences follow; of these
#: the hash, the count in the chunk's training documents and -log2 p by the context's suffix, in steps.
_ASKED = "part int, chunk long, asked binary"
_ARRAYS = {"context": (np.uint64, 8), "t": (np.int64, 8), "tested": (np.bool_, 1), "runs": (np.int32, 4), "gram": (np.uint64, 6), "n": (np.int64, 4), "steps": (np.uint32, 3)}
_KINDS, _WIDTHS = zip(*_ARRAYS.values())
#: Of an answer, packed: counts of the sequences and, of the contexts, whether they become states, both in the order of the
#: request; and those contexts that have several parts. A part's own row (no chunk) has the sums and occurrences of those,
#: how many others became states, and the occurrences and number of its sequences.
_ANSWER = "part int, chunk long, reply binary, shared array<long>, saved array<double>, t array<long>, states long, n long, v long"


def _each(rows: DataFrame, schema: str, work) -> DataFrame:
    """work(chunk number, columns of its row) for every row: columns of schema."""
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                columns = {n: row.column(n) for n in row.schema.names}
                yield pa.RecordBatch.from_arrays(list(map(pa.array, work(columns["chunk"][0].as_py(), columns))), names=names)

    return rows.mapInArrow(run, schema)


class _Request:
    """What a chunk asks for: its distinct sequences by part and context. `back` leads from each sought token (of a whole
    chunk: each word) to its sequence, `run` from each sequence to its context's place."""

    def __init__(self, c: _Words | _Sought, parts: tuple[int, int]):
        if isinstance(c, _Words):
            each = np.arange(len(c.words))
            gram, context, t, n = np.zeros(len(each), dtype=np.uint64), c.words, np.zeros(len(each), dtype=np.int64), c.n  # a word is its own context
            tested, p, back = np.zeros(len(each), dtype=bool), np.ones(len(each)), each
        else:
            self.grams = gram = c.grams()
            first, back = _distinct(gram)
            gram = gram[first]
            n = np.bincount(back, weights=c.train.astype(float), minlength=len(gram))
            context, t, tested, p = c.context[first], c.t[first], c.state[first], c.p[first]
        slots = np.minimum((t + parts[1] - 1) // parts[1], 1 << 16).clip(min=1).astype(np.uint64)
        slot = ((gram >> np.uint64(48)) * slots) >> np.uint64(16)
        slot = _mixed(context, slot)
        part = ((slot >> np.uint64(32)) * np.uint64(parts[0]) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(slot, kind="stable")  # alike on every machine, and by part
        slot = slot[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.back = place[back]
        self.gram, self.n, context, t, tested, part = gram[order], n[order].astype(np.int64), context[order], t[order], tested[order], part[order]
        self.steps = np.where(tested, np.rint(-np.log2(p[order]) * (1 << _STEPS)), 0).astype(np.uint32)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (slot[1:] != slot[:-1])
        first = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.context, self.t, self.tested, self.part = context[first], t[first], tested[first], part[first]
        self.runs = np.diff(first, append=len(order)).astype(np.int32)


def _reader(columns: list[str], total: tuple[int, int]):
    """From a row's columns what a chunk asks by: its words, without their counts, or else its sought tokens."""
    if "done" in columns:
        return _Sought.read
    return (lambda row: _Chunk(row).start(total)) if "counts" in columns else (lambda row: _Chunk(row).distinct())


def ask(state: DataFrame, parts: tuple[int, int], total: tuple[int, int] = (0, 0)) -> DataFrame:
    """The requests of each chunk (whole, or its sought tokens), a row for each part that it asks; parts: their number and the
    size of one."""
    read = _reader(state.columns, total)

    def work(no: int, columns: dict) -> list:
        r = _Request(read(columns), parts)
        ends = np.concatenate([[0], np.cumsum(r.runs)])
        cuts = np.flatnonzero(np.diff(r.part, prepend=-1))
        made = []
        for low, high in zip(cuts, [*cuts[1:], len(r.part)]):
            own, its = slice(low, high), slice(ends[low], ends[high])
            made.append(_packed(r.context[own], r.t[own], r.tested[own], r.runs[own], r.gram[its], r.n[its], r.steps[its], widths=_WIDTHS))
        return [r.part[cuts], np.full(len(cuts), no), pa.array(made, pa.binary())]

    return _each(state, _ASKED, work)


def answered(asked: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """The answers of the parts to the chunks, and a row for each part."""
    names = [part.split(" ")[0] for part in _ANSWER.split(", ")]
    longs, bytes_ = pa.list_(pa.int64()), pa.binary()
    types = [pa.int32(), pa.int64(), bytes_, longs, pa.list_(pa.float64()), longs, pa.int64(), pa.int64(), pa.int64()]

    def run(rows: pa.Table) -> pa.Table:
        read = dict(zip(_ARRAYS, zip(*(_unpacked(x.as_py(), *_KINDS, widths=_WIDTHS) for x in rows["asked"]))))
        sizes = [len(x) for x in read["context"]], [len(x) for x in read["gram"]]
        a = {name: np.concatenate(values) for name, values in read.items()}
        of = np.repeat(np.arange(len(a["context"])), a["runs"])
        first, back = _distinct(_mixed(a["context"][of], a["gram"]))
        count = np.bincount(back, weights=a["n"]).astype(np.int64)
        at, which = _distinct(a["context"])
        contexts = a["context"][at]
        on = (count > 0) & a["tested"][of[first]]
        n, one = count[on], first[on]
        t, p = a["t"][of[one]], np.exp2(a["steps"][one] / -float(1 << _STEPS))
        prior = t.astype(float) ** PRIOR
        saved = np.bincount(which[of[one]], weights=n * np.log2((n - 1 + prior * p) / ((t - 1 + prior) * p)), minlength=len(contexts))
        t, tested = a["t"][at], a["tested"][at]
        shared = tested & (t > parts[1])
        became = tested & ~shared & (saved >= DIVERGENCE * t)
        part = rows["part"][0].as_py()
        out = [(part, None, None, contexts[shared].view(np.int64), saved[shared], t[shared], int(became.sum()), int(count.sum()), int((count > 0).sum()))]
        cuts = [np.cumsum(x)[:-1] for x in sizes]
        for no, mine, counts in zip(rows["chunk"], np.split(which, cuts[0]), np.split(count[back], cuts[1])):
            out.append((part, no.as_py(), _packed(counts, became[mine]), contexts[mine[shared[mine]]].view(np.int64), None, None, None, None, None))
        return pa.Table.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), types)], names=names)

    return asked.groupBy("part").applyInArrow(run, _ANSWER)


def passing(answers: DataFrame) -> DataFrame:
    """context: those of several parts that become states."""
    sums = answers.where("chunk is null").select(F.inline(F.arrays_zip("shared", "saved", "t")))
    sums = sums.groupBy(F.col("shared").alias("context")).agg(F.sum("saved").alias("saved"), F.max("t").alias("t"))
    return sums.where(F.col("saved") >= DIVERGENCE * F.col("t")).select("context")


def _replies(answers: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """A row for each answer to a chunk and, with states, for each of those contexts of several parts that it asked for."""
    asked = answers.where("chunk is not null")
    replies = asked.select("chunk", "part", "reply", F.lit(None).cast("long").alias("context"))
    if states is None:
        return replies
    shared = asked.select("chunk", F.explode("shared").alias("context")).distinct().join(states, "context", "left_semi")
    return replies.union(shared.selectExpr("chunk", "null", "null", "context"))


def _joined(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The counts and the new states of all answers to a chunk, in the order in which it asked."""
    own = right.filter(right["part"].is_valid()).sort_by("part")
    counts, became = zip(*(_unpacked(x.as_py(), np.int64, np.bool_) for x in own["reply"]), (np.array([], np.int64), np.array([], np.bool_)))
    return np.concatenate(counts), np.concatenate(became)


def counted(whole: DataFrame, answers: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """The whole chunks with their words' counts; only the words meet the answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        r = _Request(_Words(_unpacked(left["words"][0].as_py(), np.uint64)[0], None), parts)
        counts = _joined(right)[0][r.back]
        return pa.table({"chunk": pa.array([left["chunk"][0].as_py()], pa.int64()), "counts": pa.array([_packed(counts)], pa.binary())})

    words = whole.select("chunk", "words").groupBy("chunk")
    counts = words.cogroup(_replies(answers).groupBy("chunk")).applyInArrow(run, "chunk long, counts binary")
    return whole.join(counts, "chunk")


def heads(whole: DataFrame, total: tuple[int, int]) -> DataFrame:
    """chunk, keys, held, sizes, known, base of whole chunks with counts, and seqs, how many sequences they ask for at most."""

    def work(no: int, columns: dict) -> list:
        c = _Chunk(columns)
        per = [pa.array([c.known().tolist()], pa.list_(pa.int64())), pa.array([c.base(total).tolist()], pa.list_(pa.float64()))]
        return [columns["chunk"], columns["keys"], columns["held"], columns["sizes"], *per, [int(c.many().sum())]]

    kind = whole.schema["keys"].dataType.simpleString()
    return _each(whole, f"chunk long, keys {kind}, held array<boolean>, sizes array<int>, known array<long>, base array<double>, seqs long", work)


def update(state: DataFrame, answers: DataFrame, states: DataFrame, parts: tuple[int, int], total: tuple[int, int]) -> DataFrame:
    """The sought tokens (of whole chunks: those of contexts of one word) with the answers, and the contexts of several parts that
    became states: those of contexts longer by a word."""
    names = [part.split(" ")[0] for part in _SOUGHT.split(", ")]
    read = _reader(state.columns, total)
    types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), *[pa.binary()] * (len(names) - 3)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        left = left.combine_chunks()
        c = read({n: left[n].chunk(0) for n in left.column_names})
        r = _Request(c, parts)
        count, became = _joined(right)
        became |= np.isin(r.context, right["context"].drop_null().to_numpy().view(np.uint64))
        c.deepen(count[r.back], became[r.run[r.back]], r.grams)
        return pa.Table.from_arrays([left["chunk"].chunk(0), *c.columns()], names=names)

    return state.groupBy("chunk").cogroup(_replies(answers, states).groupBy("chunk")).applyInArrow(run, _SOUGHT)


def finished(state: DataFrame, total: tuple[int, int]) -> DataFrame:
    """chunk, done with all tokens done."""
    read = _reader(state.columns, total)

    def work(no: int, columns: dict) -> list:
        c = read(columns)
        c.finish(np.ones(len(c.pos), dtype=bool))
        return [columns["chunk"], pa.array([c.done.tolist()], pa.list_(pa.float64()))]

    return _each(state, "chunk long, done array<double>", work)


def _growth(text: int) -> float:
    """How much larger than CHUNK and PART chunks and parts are, for so many bytes of text."""
    return max(1.0, (text / GROWS) ** 0.5)


def _parts(asked: DataFrame, part: int) -> tuple[int, int]:
    """How many parts the sequences that the chunks ask for fill, and the size of one."""
    return (asked.agg(F.sum("seqs")).first()[0] or 0) // part + 1, part


def score(docs: DataFrame, key: str = "doc_id", part: int = PART) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and depth (of the tree) of each row of docs
    (key, text).

    The end of a text is a token, so the empty (or null) text has one. Where nothing is learned (no training rows) all
    tokens are unknown and score is base_score. Repeated rows are scored alike; null keys are in the training part.
    """
    ws = Workspace(docs.sparkSession, "suffixtree")
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), "text")
    growth = _growth(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    part = round(part * growth)
    whole = ws.save(chunks(rows, round(CHUNK * growth)), "chunks")
    parts = _parts(whole, part)
    answers = ws.save(answered(ask(whole, parts), parts), "words")
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total = (sums.n or 0, sums.v or 0)
    whole = ws.save(counted(whole, answers, parts), "counted")
    ws.drop("chunks", "words")
    top = ws.save(heads(whole, total), "heads")
    state, asked, name, depth = whole, top, "counted", 1
    while True:
        parts = _parts(asked, part)
        answers = ws.save(answered(ask(state, parts, total), parts), f"answers{depth}")
        states = ws.save(passing(answers), f"states{depth}")
        if not answers.agg(F.sum("states")).first()[0] and states.isEmpty():
            break
        # the tokens of the level, without the chunks' texts beyond one word
        state = asked = ws.save(update(state, answers, states, parts, total), f"state{depth + 1}")
        ws.drop(f"answers{depth}", name)
        depth, name = depth + 1, f"state{depth + 1}"
    found = ws.save(top.join(finished(state, total), "chunk"), "scored")
    ws.drop(f"answers{depth}", name, "heads")
    each = found.select(F.inline(F.arrays_zip("keys", "held", "sizes", "known", "base", "done")))
    return each.select(
        F.col("keys").alias(key),
        F.col("held").alias("held_out"),
        F.col("sizes").cast("long").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total[0]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("done").alias("score"),
        F.lit(depth - 1).alias("depth"),
    )
