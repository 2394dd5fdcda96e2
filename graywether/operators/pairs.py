"""Texts read as sentence pairs: the last field against every earlier one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graywether.functions.text import BIGRAM_SALT, BUCKETS, NEGATIONS, WORD_SALT
from graywether.operators.events import _pair_hashes, _word_hashes
from graywether.operators.features import bucket_rows, cells

#: Salts of the last field's words, of its word pairs, of its new words and of the marks; the buckets that tell
#: whether a word is new; and the most fields a text has.
SALT_LAST = 0x5A17000000000001
SALT_LAST_PAIR = 0x5A17000000000002
SALT_NEW = 0x5A17000000000003
SALT_MARK = 0x5A17000000000004
CONTEXT = 4096
FIELDS = 8

_VALUE = re.compile(r'": *"([^"\\]*(?:\\(?:.|\Z)[^"\\]*)*)"?', re.DOTALL)
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"[A-Za-z0-9](?:[^ \t\n\f\r]*[A-Za-z0-9])?")
_NOT = re.compile(r"n['\"][tT]\Z")


def fields(text: str) -> list[str]:
    """The string values of a text that opens with {, else its non-empty lines. Of more than FIELDS, the last but one reaches from
    its own start to the end of the text's last, and the last is number FIELDS."""
    found = _VALUE.finditer(text) if text.startswith("{") else _LINE.finditer(text)
    spans = [m.span(m.re.groups) for m in found]
    spans = [(a, b) for a, b in spans if b > a]
    if len(spans) > FIELDS:
        spans[FIELDS - 2] = (spans[FIELDS - 2][0], spans[-1][1])
    return [text[a:b] for a, b in spans[:FIELDS]]


def words(text: str) -> list[str]:
    """Pieces between ASCII blanks without what is neither letter nor digit at their ends, the empty ones left out."""
    return _WORD.findall(text)


def negates(word: str) -> bool:
    return word.lower() in NEGATIONS or (len(word) > 3 and _NOT.search(word) is not None)


def _hashed(flat: list[str], *salts: int) -> list[np.ndarray]:
    """A hash for every word and salt, worked out once for each distinct word."""
    coded = pa.array(flat, pa.string()).dictionary_encode()
    if not len(coded):
        return [np.array([], dtype=np.uint64) for _ in salts]
    at = np.asarray(coded.indices)
    return [_word_hashes(coded.dictionary, salt)[at] for salt in salts]


def _owners(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whose a flat list's elements are, and their places there."""
    n = np.array(sizes, dtype=np.int64)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every text's events, in order. With two fields or more these are, for each word of the last one, the
    word, its pair with the word before and, if no earlier field has it, the word as a new one; then three marks. Otherwise they
    are each word and its pair with the word before."""
    split = [fields(text) for text in texts]
    paired = np.array([len(f) > 1 for f in split], dtype=bool)
    tails = [words(f[-1]) if len(f) > 1 else words(text) for f, text in zip(split, texts)]
    earlier = [[w for part in f[:-1] for w in words(part)] for f in split]
    owner, place = _owners([len(t) for t in tails])
    flat = [w for t in tails for w in t]
    plain, last, new = _hashed(flat, WORD_SALT, SALT_LAST, SALT_NEW)
    whose = _owners([len(e) for e in earlier])[0]
    (known,) = _hashed([w for e in earlier for w in e], SALT_NEW)
    key = lambda who, hashes: who * CONTEXT + (hashes % np.uint64(CONTEXT)).astype(np.int64)
    both = paired[owner]
    covered = np.isin(key(owner, new), key(whose, known))
    h = np.where(both, last, plain)
    second, fresh = np.flatnonzero(place > 0), np.flatnonzero(both & ~covered)
    pairs = np.where(both[second], _pair_hashes(last[second - 1], last[second], SALT_LAST_PAIR), _pair_hashes(plain[second - 1], plain[second], BIGRAM_SALT))
    marked = np.flatnonzero(paired)
    sizes = np.bincount(owner, minlength=len(texts))
    share = np.bincount(owner, weights=covered, minlength=len(texts)).astype(np.int64) * 5 // np.maximum(sizes, 1)
    signs = [2 * any(map(negates, earlier[i])) + any(map(negates, tails[i])) for i in marked]
    (marks,) = _hashed([m for i, sign in zip(marked, signs) for m in (f"cov{share[i]}", f"len{min(sizes[i] // 4, 5)}", f"neg{sign}")], SALT_MARK)
    every = np.concatenate([h, pairs, new[fresh], marks])
    whose = np.concatenate([owner, owner[second], owner[fresh], np.repeat(marked, 3)])
    turn = np.concatenate([3 * place, 3 * place[second] + 1, 3 * place[fresh] + 2, 3 * np.repeat(sizes[marked], 3) + np.tile(np.arange(3), len(marked))])
    order = np.lexsort((turn, whose))
    return whose[order], (every[order] % np.uint64(BUCKETS)).astype(np.int64)


def pair_rows(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry, toks, times, runs, n like features.bucket_rows, of each text's sentence-pair events; a text with fewer than two
    fields (an empty or null one among them) has the events of its words and pairs of neighbours instead.

    All within the row: no shuffle. Whole texts are read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                owner, stream = _streams(batch.column(k).to_pylist())
                length = np.bincount(owner, minlength=batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *cells(owner, stream, batch.num_rows), pa.array(length)], names=[*carry, "toks", "times", "runs", "n"])

    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    shape = f"{carried}, toks array<int>, times array<int>, runs array<int>, n long"
    return docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, shape)


def view_rows(docs: DataFrame, carry: list[str], view: str, text: str = "text") -> DataFrame:
    """The rows of a view: `bag` (words and pairs of neighbours of the whole text) or `pair`."""
    if view not in ("bag", "pair"):
        raise ValueError(f"view is bag or pair, not {view}")
    return (pair_rows if view == "pair" else bucket_rows)(docs, carry, text)
