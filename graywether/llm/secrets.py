"""Secret scans by a worklist of decoded layers.

A text is scanned for secrets (assignments, access keys, long hexadecimal strings). Then its encoded parts are
unwrapped into layers, which are scanned and unwrapped in their turn until no layer is left:

- `url`: percent escapes, `unicode`: \\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX and numeric character references. All of a
  layer's escapes are decoded in one step; the rest of the layer stays around them, so a secret may be partly escaped.
- `base64`: runs of 16 or more of its letters (standard or URL-safe, padded or not, in lines of 60 or more, or a
  piece of a path), if they decode to UTF-8 text without control characters or to compressed bytes.
- `compressed`: gzip, zlib, bzip2, xz and zstandard bytes that base64 or percent escapes held.

The worklist keeps a fingerprint of every layer's content with the place it came from; one that was seen at that place
is not unwrapped again, so layers that decode to themselves end. Every character of a layer knows the span of the text
that it came from: exactly for escapes and base64, the whole run for compressed bytes. A finding in a layer is a span of
the text; findings with the same kind and span are one. Findings in the text itself are the base spans and always stay.

Memory is bounded: a layer may have MOST_LAYER characters and a text's layers BUDGET times MOST_LAYER in all. What lies
beyond isn't dropped silently: the run is reported as a span of kind `unread`.

Null texts read as empty ones. Ids aren't looked at, so null or repeated ids and repeated rows each have their row;
an empty table gives no rows. Rows never meet, so there is no shuffle and no common key.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
#: Characters of a layer, and layers of that size that one text may fill.
MOST_LAYER = 1 << 25
BUDGET = 4
_ROWS = 256

# Fixed patterns of the base spans; (?a) keeps the letters of either case within ASCII.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|(?:\\x[0-9A-Fa-f]{2})+|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{60,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

Span = tuple[str, int, int]


class TooLong(Exception):
    """What a run unwraps to doesn't fit in a layer."""


def scan(text: str) -> list[Span]:
    """kind, start, end of the secrets written plainly in a text, by start, then kind as in KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


class Layer:
    """A text and, for each of its characters, the span it came from in the document.

    starts and ends are None for the document itself; a layer of compressed bytes has one span for all characters.
    """

    __slots__ = ("text", "starts", "ends", "whole")

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the document that characters start to end (more than none) came from."""
        if self.whole is not None:
            return self.whole
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def key(self) -> bytes:
        at = self.span(0, len(self.text)) if self.text else (0, 0)
        return hashlib.blake2b(f"{at}".encode() + self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def readable(raw: bytes) -> str | None:
    """raw as text, or None if it isn't UTF-8 or has control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or _CONTROL.search(text) else text


def inflated(raw: bytes) -> bytes | None:
    """What compressed bytes hold, or None if they aren't compressed; TooLong if it is more than MOST_LAYER bytes."""
    try:
        if raw[:2] == b"\x1f\x8b" or len(raw) > 6 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
            out, more, rest = b"", False, raw
            while rest and not more and (rest is raw or rest[:2] == b"\x1f\x8b"):  # gzip may have several members
                box = zlib.decompressobj(47)
                out += box.decompress(rest, MOST_LAYER + 1 - len(out))
                more, rest = bool(box.unconsumed_tail) or len(out) > MOST_LAYER, box.unused_data
        elif raw[:3] == b"BZh":
            box = bz2.BZ2Decompressor()
            out = box.decompress(raw, MOST_LAYER + 1)
            more = not box.eof and not box.needs_input
        elif raw[:6] == b"\xfd7zXZ\x00":
            box = lzma.LZMADecompressor(memlimit=1 << 28)
            out = box.decompress(raw, MOST_LAYER + 1)
            more = not box.eof and not box.needs_input
        elif raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw) as box:
                out, more = box.read(MOST_LAYER + 1), False
        else:
            return None
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        return None
    if more or len(out) > MOST_LAYER:
        raise TooLong
    return out or None


def contents(raw: bytes) -> str | None:
    """The text of bytes that are compressed, at any depth of compression, or None."""
    seen = set()
    while (key := hashlib.blake2b(raw, digest_size=16).digest()) not in seen:
        seen.add(key)
        found = inflated(raw)
        if found is None:
            break
        if (text := readable(found)) is not None:
            return text
        raw = found
    return None


def _mapped(layer: Layer, pieces: list[tuple[int, int, str, bool]]) -> Layer:
    """The layer with pieces (start, end, new text, whether each of its characters has an equal share) put in."""
    text, out, last = layer.text, [], 0
    starts, ends = array("i"), array("i")

    def plain(a: int, b: int) -> None:
        out.append(text[a:b])
        if layer.whole is not None:
            return
        if layer.starts is None:
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        else:
            starts.extend(layer.starts[a:b])
            ends.extend(layer.ends[a:b])

    for a, b, new, even in pieces:
        plain(last, a)
        out.append(new)
        if layer.whole is None:
            each = (b - a) // len(new) if even and new else 0
            for i in range(len(new)):
                s, e = layer.span(a + i * each, a + (i + 1) * each) if each else layer.span(a, b)
                starts.append(s)
                ends.append(e)
        last = b
    plain(last, len(text))
    return Layer("".join(out), starts, ends) if layer.whole is None else Layer("".join(out), whole=layer.whole)


def _utf8_pieces(a: int, raw: bytes, width: int) -> list[tuple[int, int, str, bool]]:
    """Pieces for escaped bytes, `width` characters each, from place a: one for each character; others stay as they are."""
    pieces, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
        try:
            pieces.append((a + i * width, a + (i + n) * width, raw[i : i + n].decode(), False))
            i += n
        except UnicodeDecodeError:
            i += 1
    return pieces


def _unescaped(layer: Layer, unread: list[tuple[int, int]]) -> Iterator[Layer]:
    """The layer with its percent escapes decoded, with its Unicode escapes decoded, and what escaped bytes hold; runs
    that hold too much are added to unread."""
    text = layer.text

    def compressed(raw: bytes, a: int, b: int) -> Iterator[Layer]:
        try:
            if (inner := contents(raw)) is not None:
                yield Layer(inner, whole=layer.span(a, b))
        except TooLong:
            unread.append(layer.span(a, b))

    if "%" in text:
        pieces = []
        for m in _URL.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            pieces += _utf8_pieces(m.start(), raw, 3)
            yield from compressed(raw, *m.span())
        if pieces:
            yield _mapped(layer, pieces)
    if "\\" in text or "&#" in text:
        pieces = []
        for m in _UNICODE.finditer(text):
            a, b = m.span()
            if text.startswith("\\x", a):
                raw = bytes.fromhex(m[0].replace("\\x", ""))
                pieces += _utf8_pieces(a, raw, 4)
                yield from compressed(raw, a, b)
            elif text.startswith("\\u", a) and m[1] is None:
                units = bytes.fromhex(m[0].replace("\\u", ""))
                new = units.decode("utf-16-be", "surrogatepass")
                if len(new) * 6 == b - a:
                    pieces.append((a, b, new, True))
                else:  # pairs of surrogates are one character of two escapes
                    for c in new:
                        n = 12 if ord(c) > 0xFFFF else 6
                        pieces.append((a, a + n, c, False))
                        a += n
            else:
                code = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
                if code <= 0x10FFFF:
                    pieces.append((a, b, chr(code), False))
        if pieces:
            yield _mapped(layer, pieces)


def _decoded(layer: Layer, start: int, end: int) -> Layer | None:
    """What the base64 run from start to end holds, or None."""
    run = layer.text[start:end]
    letters = run.replace("\r", "").replace("\n", "").rstrip("=")
    if len(letters) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(letters.replace("-", "+").replace("_", "/") + "=" * (-len(letters) % 4), validate=True)
    except binascii.Error:
        return None
    if (text := readable(raw)) is None:
        inner = contents(raw)
        return None if inner is None else Layer(inner, whole=layer.span(start, end))
    if layer.whole is not None:
        return Layer(text, whole=layer.whole)
    # byte b of what is decoded has its bits in letters b * 4 // 3 to (b * 4 + 4) // 3
    places = range(start, start + len(letters)) if len(letters) == len(run.rstrip("=")) else [start + i for i, c in enumerate(run) if c not in "\r\n="]
    starts, ends, b = array("i"), array("i"), 0
    for c in text:
        n = 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        s, e = layer.span(places[b * 4 // 3], places[min((b + n) * 4 + 2, len(letters) * 3) // 3 - 1] + 1)
        starts.append(s)
        ends.append(e)
        b += n
    return Layer(text, starts, ends)


def _held(layer: Layer, unread: list[tuple[int, int]]) -> Iterator[Layer]:
    """What the layer's base64 runs hold; runs that hold too much are added to unread.

    A run that doesn't decode as a whole is tried by its lines, a line by its pieces between /, _ and -: a path or a
    name may stand before what is encoded.
    """
    for m in _RUN.finditer(layer.text):
        tries = [[m.span()]]
        if "\n" in m[0]:
            tries.append([x.span() for x in _LINE.finditer(layer.text, *m.span())])
        tries.append([x.span() for x in _PIECE.finditer(layer.text, *m.span())])
        for spans in tries:
            found = []
            for a, b in spans:
                try:
                    found.append(_decoded(layer, a, b))
                except TooLong:
                    unread.append(layer.span(a, b))
            inner = [x for x in found if x is not None]
            yield from inner
            if inner or len(found) < len(spans):
                break


def unwrapped(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and all spans: base ones and those that decoded layers add, by start, then kind."""
    base = scan(text)
    found, unread = set(base), []
    seen, room = set(), BUDGET * MOST_LAYER
    todo = deque([Layer(text)])
    while todo:
        layer = todo.popleft()
        for inner in chain(_unescaped(layer, unread), _held(layer, unread)):
            if not inner.text or (key := inner.key()) in seen:
                continue
            seen.add(key)
            room -= len(inner.text)
            if room < 0:
                unread.append(inner.span(0, len(inner.text)))
                continue
            found.update((kind, *inner.span(s, e)) for kind, s, e in scan(inner.text))
            todo.append(inner)
    found.update(("unread", *at) for at in unread)
    rank = {k: i for i, k in enumerate((*KINDS, "unread"))}
    return base, sorted(found, key=lambda x: (x[1], rank[x[0]], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base and spans (both kind:start:end, comma-joined), n_decoded (spans added)."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(f"n_{k}" for k in KINDS), "base", "spans", "n_decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                counts: list[list[int]] = [[] for _ in KINDS]
                bases, spans, added = [], [], []
                for value in batch.column(1):
                    base, found = unwrapped(value.as_py() or "")
                    for n, k in zip(counts, KINDS):
                        n.append(sum(s[0] == k for s in base))
                    bases.append(joined(base))
                    spans.append(joined(found))
                    added.append(len(found) - len(base))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(bases, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=names
                )

    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {counted}, base string, spans string, n_decoded long")
