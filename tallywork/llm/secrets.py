"""Secret scans with a worklist of decoded layers.

A text is scanned for three kinds of secrets. What in it looks encoded (URL escapes, Unicode escapes, base64 and, inside
that, gzip, zlib, bzip2 or Zstandard) is decoded and put on a worklist as a layer of its own, which knows the place in the
document that its characters come from. Base64 is decoded at each of its four alignments and over line ends; bytes are
read as UTF-8 and, if they hold zeros, as UTF-16; compressed streams are taken from wherever they begin, all members of
them. Layers are scanned like the text until none is left. A layer already seen at the same place isn't scanned again, so
input that decodes to itself ends.

The worklist is a stack of generators: a layer exists only while it and what lies in it are scanned. Compressed streams
are decompressed as a stream and scanned in pieces of PIECE bytes, streams within streams too, so a bomb takes time but
no memory. A piece begins with the end of the last one: OVERLAP bytes, or the whole unbroken run of characters there if
that has at most LONGEST. Only an encoded run longer than LONGEST inside a compressed stream is decoded in parts.

Nulls and empty texts have no spans. Offsets count code points, ends are exclusive. Repeated rows are scanned one by one;
an empty table gives an empty result; below DEEP escapes in one another the rest is decoded to its end in one pass, so that a
chain of escapes of any length takes time in proportion, and only layers in between aren't scanned; other columns are carried along by redacted(), whatever their names. The time is
linear in the length of a layer, a long text without a blank included. Of two spans with one beginning the kind listed
first comes first.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Least characters: of an assigned value, an access key and a hex string.
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Access keys, hex strings and base64 text all lie in such runs.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: What no run with escapes holds.
BREAK = re.compile(r"[\s<>]")
#: A long chain of escaped escape signs, or escapes in a row. A chain stands for one sign, however often it is decoded.
URL_ESCAPES = re.compile(r"%(?:25){3,}|(?:%(?!252525)[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\(?:(?:u005[Cc]|x5[Cc]){3,}|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
ANY_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2})")
#: Escapes within escapes up to which each layer is scanned; what lies deeper is decoded to its end at once.
DEEP = 12
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, of any width and indent.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Beginnings of gzip, zlib and bzip2 streams and of Zstandard frames, the skippable ones too.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18")
#: Bytes of a decompressed stream that are scanned at once, and what a piece has of the last one: at least, and at most.
PIECE, OVERLAP, LONGEST = 8 << 20, 64 << 10, 4 << 20
#: Compressed bytes given to a decompressor at once, so that what they hold stays small.
STEP = 256

Span = tuple[str, int, int]


#: Where each character of what was decoded begins and ends in the run that it was decoded from.
Bounds = Callable[[], tuple[np.ndarray, np.ndarray]]


class Layer:
    """Decoded text: from [start, end) of the layer above, or the text itself. deep counts the escapes that it lies in, one in the other."""

    def __init__(self, text: str, above: "Layer | None" = None, start: int = 0, end: int = 0, bounds: Bounds | None = None, deep: int = 0):
        self.text, self.above, self.start, self.bounds, self.deep = text, above, start, bounds and cache(bounds), deep
        self.whole = above.place(start, end) if above else (0, len(text))

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The place in the document that characters come from; that of the whole layer where single ones have none."""
        layer = self
        while layer.above:
            if not layer.bounds:
                return layer.whole
            begins, ends = layer.bounds()
            start, end, layer = layer.start + int(begins[start]), layer.start + int(ends[end - 1]), layer.above
        return start, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for run in LONG_RUN.finditer(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def runs(text: str, escape: re.Pattern) -> Iterator[tuple[int, int]]:
    """Where the unbroken runs that hold an escape begin and end: found from the escape on, so that no run is read twice."""
    at = 0
    while m := escape.search(text, at):
        before = text[at : m.start()]
        word = "" if not before or before[-1].isspace() else before.rsplit(None, 1)[-1]
        word = word[max(word.rfind("<"), word.rfind(">")) + 1 :]
        stop = BREAK.search(text, m.end())
        at = stop.start() if stop else len(text)
        yield m.start() - len(word), at


def unescaped(run: str, pattern: re.Pattern, decode) -> tuple[str, Callable[[], tuple[np.ndarray, np.ndarray]]]:
    """run with what the pattern matches decoded, and a function for where each new character begins and ends in run."""
    text, steps, at = [], [], 0
    for m in pattern.finditer(run):
        new, sizes = decode(m)
        text += [run[at : m.start()], new]
        steps += [np.ones(m.start() - at, np.int64), sizes]
        at = m.end()
    text.append(run[at:])
    steps.append(np.ones(len(run) - at, np.int64))

    def places() -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.concatenate(steps))
        return np.concatenate(([0], ends[:-1])), ends

    return "".join(text), places


def url_characters(m: re.Match) -> tuple[str, np.ndarray]:
    """What URL escapes stand for, and how many characters each takes there."""
    if m.group().startswith("%252525"):
        return "%", np.array([m.end() - m.start()])
    text = readable(bytes.fromhex(m.group().replace("%", "")))
    return text, 3 * byte_sizes(text)


def unicode_characters(m: re.Match) -> tuple[str, np.ndarray]:
    return character(int(next((g for g in m.groups() if g), "5c"), 16)), np.array([m.end() - m.start()])


def character(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def readable(data: bytes) -> str:
    """Bytes as text; a byte that isn't UTF-8 is a character of its own."""
    return data.decode("utf-8", "surrogateescape")


def byte_sizes(text: str) -> np.ndarray:
    """How many of the bytes that readable() got each character took."""
    if text.isascii():
        return np.ones(len(text), np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xD800) & (code < 0xE000)] = 1
    return size


def wide(data: bytes) -> Iterator[tuple[int, str]]:
    """Bytes read two at a time, from the first and from the second on: UTF-16 of either order, as far as it is ASCII."""
    if b"\0" in data:
        for skip in (0, 1):
            pairs = np.frombuffer(data[skip:] + b"\0" * ((len(data) - skip) % 2), "<u2")
            yield skip, pairs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def opened(data: bytes):
    """A decompressor for what begins here."""
    if data.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\x78"):
        return zlib.decompressobj()
    return zstandard.ZstdDecompressor().decompressobj()


Source = Callable[[], Iterator[bytes]]


def decompressed(parts: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """What a compressed stream at the beginning of the parts holds; members and frames that follow at once belong to it.

    What comes before a break is kept. used[0] becomes the length of the whole members and frames.
    """
    inner, chunk, fed = None, b"", 0
    try:
        for part in parts:
            chunk += part
            fed += len(part)
            while chunk and (inner or len(chunk) >= 4):
                if inner is None:
                    if not PACKED.match(chunk):
                        return
                    inner = opened(chunk)
                if out := inner.decompress(chunk):
                    yield out
                if inner.eof:
                    chunk, inner = inner.unused_data, None
                    used[0] = fed - len(chunk)
                else:
                    chunk = b""
    except (zlib.error, OSError, zstandard.ZstdError, EOFError, RecursionError):
        return


def pieces(parts: Iterator[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """The parts put together: where a piece begins, its bytes, and whether it is the last; each begins with the end of the one before."""
    held, start = bytearray(), 0
    for part in parts:
        if len(held) >= PIECE:
            yield start, bytes(held), False
            blank = held.rfind(b" ", len(held) - LONGEST)
            keep = OVERLAP if blank < 0 else max(OVERLAP, len(held) - blank - 1)
            start += len(held) - keep
            del held[:-keep]
        held += part
    if held:
        yield start, bytes(held), True


def sliced(data: bytes, at: int) -> Iterator[bytes]:
    for k in range(at, len(data), STEP):
        yield data[k : k + STEP]


def skipped(parts: Iterator[bytes], n: int) -> Iterator[bytes]:
    for part in parts:
        yield from sliced(part, n)
        n = max(0, n - len(part))


def streams(source: Source, fresh: Callable[[bytes], bool]) -> Iterator[tuple[int, bytes | Source]]:
    """For each fresh piece of a source, the piece, then the compressed streams that begin in it, with their places in the source.

    A stream that goes on after its piece is read from a second pass over the source, so nothing waits in memory.
    """
    after = 0
    for start, piece, last in pieces(source()):
        if not fresh(piece):
            continue
        yield start, piece
        stop = len(piece) if last else len(piece) - OVERLAP
        while (m := PACKED.search(piece, max(after - start, 0))) and m.start() < stop:
            at, used = m.start(), [1]

            def rest(piece: bytes = piece, at: int = at, last: bool = last, end: int = start + len(piece)) -> Iterator[bytes]:
                yield from sliced(piece, at)
                if not last:
                    yield from skipped(source(), end)

            yield start + at, lambda rest=rest, used=used: decompressed(rest(), used)
            after = start + at + used[0]


def text_layers(data: bytes) -> Iterator[tuple[int, str]]:
    """Texts in compressed streams in the bytes, and in streams within those, with where the outermost begins."""
    seen: set[tuple[int, bytes]] = set()
    outermost = 0

    def fresh(piece: bytes) -> bool:
        mark = (outermost, hashlib.sha256(piece).digest())
        known = mark in seen
        seen.add(mark)
        return not known

    work = [streams(lambda: iter([data]), lambda _: True)]
    while work:
        at, one = next(work[-1], (0, None))
        if one is None:
            work.pop()
        elif callable(one):
            outermost = at if len(work) == 1 else outermost
            work.append(streams(one, fresh))
        elif len(work) > 1:
            yield outermost, readable(one)
            yield from ((outermost, x) for _, x in wide(one))


def base64_runs(text: str) -> Iterator[re.Match]:
    yield from BASE64.finditer(text)
    if "\n" in text:
        yield from (m for m in WRAPPED.finditer(text) if m.end() - m.start() > 16)


def escaped_layers(layer: Layer, escape: re.Pattern, decode) -> Iterator[Layer]:
    for start, end in runs(layer.text, escape):
        new, bounds = unescaped(layer.text[start:end], escape, decode)
        yield Layer(new, layer, start, end, bounds, layer.deep + 1)


HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def ending(signs: list[str]) -> tuple[int, str] | None:
    """Of an escape that the last sign completes: how many signs it takes, and what it stands for; a byte above 127 as readable() has it."""
    if signs[-1] == "}":
        at = next((k for k in range(2, min(8, len(signs))) if signs[-k] == "{"), 0)
        digits = "".join(signs[-at + 1 : -1]) if at else ""
        if digits and HEX_DIGITS.issuperset(digits) and signs[-at - 2 : -at] == ["\\", "u"]:
            return at + 2, character(int(digits, 16))
        return None
    if signs[-1] not in HEX_DIGITS or len(signs) < 3 or signs[-2] not in HEX_DIGITS:
        return None
    if signs[-3] == "%":
        code = int(signs[-2] + signs[-1], 16)
        return 3, chr(code if code < 128 else 0xDC00 + code)
    if signs[-3] == "x" and signs[-4:-3] == ["\\"]:
        return 4, character(int(signs[-2] + signs[-1], 16))
    if signs[-6:-4] == ["\\", "u"] and HEX_DIGITS.issuperset(signs[-4:]):
        return 6, character(int("".join(signs[-4:]), 16))
    return None


def settled(run: str) -> tuple[str, Bounds]:
    """run with all escapes decoded, those that decoding completes too, in one pass: an escape is over with its last sign."""
    signs: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    for k, c in enumerate(run):
        signs.append(c)
        begins.append(k)
        ends.append(k + 1)
        while found := ending(signs):
            n, new = found
            begin = begins[-n]
            del signs[-n:], begins[-n:], ends[-n:]
            signs.append(new)
            begins.append(begin)
            ends.append(k + 1)
    return "".join(signs), lambda: (np.array(begins), np.array(ends))


def settled_layers(layer: Layer) -> Iterator[Layer]:
    for start, end in runs(layer.text, ANY_ESCAPE):
        new, bounds = settled(layer.text[start:end])
        yield Layer(new, layer, start, end, bounds, layer.deep)


def base64_layers(layer: Layer, m: re.Match) -> Iterator[Layer]:
    run = m.group()
    signs = "".join(run.split())
    body = signs.rstrip("=").replace("-", "+").replace("_", "/")
    at = cache(lambda: np.flatnonzero([not c.isspace() for c in run]) if len(signs) < len(run) else np.arange(len(run)))
    for skip in range(4):  # the payload may begin anywhere in the run, after a path or a prefix
        part = body[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        if not data:
            continue
        plain = readable(data)

        def signs_of(first: np.ndarray, last: np.ndarray, skip: int = skip) -> tuple[np.ndarray, np.ndarray]:
            """Where in the run the signs of bytes first to last (exclusive) begin and end."""
            return at()[skip + first // 3 * 4], at()[np.minimum(skip + (last + 2) // 3 * 4, len(signs)) - 1] + 1

        def bounds(text: str = plain, signs_of=signs_of) -> tuple[np.ndarray, np.ndarray]:
            sizes = byte_sizes(text)
            last = np.cumsum(sizes)
            return signs_of(last - sizes, last)

        yield Layer(plain, layer, m.start(), m.end(), bounds)
        for shift, text in wide(data):

            def pairs(shift: int = shift, n: int = len(text), size: int = len(data), signs_of=signs_of) -> tuple[np.ndarray, np.ndarray]:
                first = shift + 2 * np.arange(n)
                return signs_of(first, np.minimum(first + 2, size))

            yield Layer(text, layer, m.start(), m.end(), pairs)
        for begin, inner in text_layers(data):
            yield Layer(inner, layer, m.start() + int(at()[skip + begin // 3 * 4]), m.end())


def inner_layers(layer: Layer) -> Iterator[Layer]:
    if layer.deep >= DEEP:
        yield from settled_layers(layer)
    elif "%" in layer.text or "\\" in layer.text:
        yield from escaped_layers(layer, URL_ESCAPES, url_characters)
        yield from escaped_layers(layer, UNICODE_ESCAPE, unicode_characters)
    for m in base64_runs(layer.text):
        yield from base64_layers(layer, m)


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans of the text itself, and all spans."""
    text = text or ""
    base = base_spans(text)
    if "%" not in text and "\\" not in text and next(base64_runs(text), None) is None:
        return base, base
    found, seen = set(base), set()
    work = [inner_layers(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text:
            mark = (layer.whole, hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest())
            if mark not in seen:
                seen.add(mark)
                found |= {(kind, *layer.place(s, e)) for kind, s, e in base_spans(layer.text)}
                work.append(inner_layers(layer))
    return base, in_order(list(found))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, base_spans and spans, both as kind:start:end, comma-joined in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([joined(x) for x, _ in found], pa.string()), pa.array([joined(y) for _, y in found], pa.string())], [key, "base_spans", "spans"])

    known = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return known.mapInArrow(scan, f"{key} long, base_spans string, spans string")


def without_secrets(text: str | None, mark: str = "[SECRET]") -> str | None:
    if not text:
        return text
    out, at = [], 0
    for _, s, e in sorted(spans(text)[1], key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", chars: str | None = None) -> DataFrame:
    """docs with each span replaced by a mark; chars names a column that holds the length of the text."""
    at, n = docs.columns.index(text), docs.columns.index(chars) if chars in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [without_secrets(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(new, columns[at].type)
            if n is not None:
                columns[n] = pa.array([None if t is None else len(t) for t in new], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(clean, docs.schema)
