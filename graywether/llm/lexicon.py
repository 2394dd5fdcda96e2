"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Spark counts the words of all texts. The LEXICON_WORDS most frequent are merged into ids once and compiled into a
minimal acyclic automaton: words share prefixes and suffixes, the outputs on a word's path add up to its number,
and a table gives the ids of that number. The file is shipped to the executors once and memory-mapped by their
Python workers. Words that the automaton doesn't know are merged exactly where they occur, so the bound on the
lexicon changes speed only. Ids equal those of the tokenizers library for the same vocabulary file.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywether.llm.tables import Workspace

#: Words in the automaton; all others are merged.
LEXICON_WORDS = 100_000
#: Words that a worker remembers, and words counted before partial counts go to Spark.
REMEMBERED = 200_000
#: Symbols up to which a word is merged by scanning, beyond by a heap.
_SCAN = 48
#: Texts of these characters only are split here; others go through the file's own normalizer and splitter.
_PLAIN = regex.compile(r"[\t-\r\x20-\x7e -ɏ‐-‧€]*")
_ROWS = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """Merges, normalisation and splitting of one vocabulary file (BPE on byte letters with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        #: (left id, right id) as one number -> rank, rank -> id
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], n)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in (vocab | self.special).items():
            self.names[i] = name
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)
        self.letter_byte = {c: b for b, c in enumerate(letters)}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of its own, marked by a leading blank, which no other word has."""
        if "<|" in text:
            found: list[str] = []
            for k, part in enumerate(self.cut.split(text)):
                found += [" " + part] if k % 2 else self._words(part)
            return found
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable() or _PLAIN.fullmatch(text):
            return self.word.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        undo = self.letter_byte
        return [bytes(undo[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged, the leftmost first, until none has a rank."""
        if word[0] == " ":
            return [self.special[word[1:]]]
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        if len(ids) > _SCAN:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.merged)
        pairs = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i] = new = self.merged[best]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(ids[i - 1] << 20 | new, none)
            if i < len(pairs):
                pairs[i] = rank(new << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := self.rank.get(ids[i] << 20 | ids[right[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[right[i]]))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.merged[r], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(left[i])
            push(i)
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the ids joined by spaces, as the library does for a file without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def compile_words(words: list[str], ids: list[list[int]], path: str) -> None:
    """Write the automaton of sorted distinct words to a file.

    Words are added in byte order; the states behind the common prefix are then final, and a state equal to a
    registered one (same end mark and arcs) is replaced by it. An arc's output is the number of words that sort
    before those behind it, so outputs add up to a word's place in the order.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def register(node: list) -> int:
        signature = (node[0], tuple(node[1]))
        if signature not in registry:
            registry[signature] = len(states)
            states.append(signature)
        return registry[signature]

    path_nodes: list[list] = [[False, []]]  # of the last word: [end mark, arcs (byte, state) that are done]
    path_bytes = b""

    def close(keep: int) -> None:
        while len(path_nodes) - 1 > keep:
            node = path_nodes.pop()
            path_nodes[-1][1].append((path_bytes[len(path_nodes) - 1], register(node)))

    for raw in (w.encode() for w in words):
        keep = len(os.path.commonprefix([path_bytes, raw]))
        close(keep)
        path_nodes.extend([False, []] for _ in raw[keep:])
        path_nodes[-1][0] = True
        path_bytes = raw
    close(0)
    root = register(path_nodes[0])

    below = [0] * len(states)
    keys, to, out = [], [], []
    for s, (end, arcs) in enumerate(states):  # a state comes after those it leads to
        n = int(end)
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            to.append(t)
            out.append(n)
            n += below[t]
        below[s] = n
    offsets = np.cumsum([0, *map(len, ids)])
    tables = {
        "keys": np.array(keys, dtype="<i8"),
        "to": np.array(to, dtype="<i4"),
        "out": np.array(out, dtype="<i4"),
        "end": np.array([e for e, _ in states], dtype="<i1"),
        "offsets": offsets.astype("<i8"),
        "ids": np.array([i for x in ids for i in x], dtype="<u4"),
        "root": np.array([root], dtype="<i4"),
    }
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in tables.items()}).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in tables.values():
            f.write(b"\0" * (-f.tell() % 8) + v.tobytes())


class Transducer:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        at, self.t = 8 + n, {}
        for k, (kind, size) in json.loads(raw[8 : 8 + n].tobytes()).items():
            at += -at % 8
            width = np.dtype(kind).itemsize * size
            self.t[k] = raw[at : at + width].view(kind)
            at += width

    def look_up(self, words: list[str]) -> list[bytes | None]:
        """Packed ids of each word, None for words that it doesn't hold; all words walk at once, byte by byte."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        text, start = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size
        keys, to, out = self.t["keys"], self.t["to"], self.t["out"]
        state = np.full(len(raw), self.t["root"][0], dtype=np.int64)
        number = np.zeros(len(raw), dtype=np.int64)
        live = np.arange(len(raw)) if len(keys) else np.array([], dtype=np.int64)
        found = np.zeros(len(raw), dtype=bool)
        step = 0
        while len(live):
            done = size[live] == step
            found[live[done]] = self.t["end"][state[live[done]]] == 1
            live = live[~done]
            want = state[live] << 8 | text[start[live] + step]
            arc = np.searchsorted(keys, want).clip(max=len(keys) - 1)
            ok = keys[arc] == want
            live, arc = live[ok], arc[ok]
            state[live] = to[arc]
            number[live] += out[arc]
            step += 1
        offsets, ids = self.t["offsets"], self.t["ids"]
        return [ids[offsets[n] : offsets[n + 1]].tobytes() if f else None for f, n in zip(found.tolist(), number.tolist())]


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """word, n over all texts. Each task sums what it has read before Spark sums over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = bpe(vocabulary), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(model.words(text.as_py() or ""))
                if len(seen) > REMEMBERED:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of docs, `size` at most, and ship the file; gives its name for SparkFiles.

    The least count that is taken comes from the number of words per count, so only words of the lexicon reach the
    driver; words that tie at the edge stay out together.
    """
    spark = docs.sparkSession
    counts = Workspace(spark, "lexicon").save(word_counts(docs, vocabulary), "counts")
    per = counts.groupBy("n").agg(F.count("*").alias("words"))
    per = per.withColumn("so_far", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = per.where(F.col("so_far") <= size).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= F.lit(least)).select("word")
    words = sorted((r.word for r in top.collect()), key=str.encode)
    model = bpe(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    compile_words(words, [model.merge(w) for w in words], path)
    spark.sparkContext.addFile(path)
    return name


_lexicons: dict[str, tuple[Transducer, dict[str, bytes]]] = {}


def _lexicon(name: str) -> tuple[Transducer, dict[str, bytes]]:
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Transducer(SparkFiles.get(name)), {}
    return _lexicons[name]


def code(docs: DataFrame, vocabulary: str, lexicon: str) -> DataFrame:
    """docs (text is one of its columns) with ids (packed little-endian unsigned 32-bit) and decoded (text of the ids).

    Null and empty texts have no ids. Rows are coded one by one, so repeats, ties and any further columns but ids
    and decoded (which are replaced) come through as they are.
    """
    docs = docs.drop("ids", "decoded")
    kept = docs.columns
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary)
        automaton, known = _lexicon(lexicon)
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                texts = [model.words(t.as_py() or "") for t in batch.column(at)]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set().union(*texts).difference(known))
                for word, packed in zip(new, automaton.look_up(new)):
                    known[word] = np.array(model.merge(word), dtype="<u4").tobytes() if packed is None else packed
                ids = [b"".join(map(known.__getitem__, words)) for words in texts]
                decoded = [model.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, ids binary, decoded string")


def encode_and_decode(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> DataFrame:
    """Build the lexicon of docs and code them with it."""
    return code(docs, vocabulary, build(docs, vocabulary, size))
