"""Secret scan with a worklist of decoded layers.

Kinds, each matched leftmost and without overlap in every layer:

* ``assign``: a key word, ``=`` or ``:``, and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex``: a run of 32 or more lower-case hexadecimal digits.

The text itself is the first layer. A layer yields further ones: the whole layer
with percent escapes decoded, the whole layer with ``\\uXXXX``, ``\\xXX`` and
``&#N;`` escapes decoded, every base64 run (as latin-1 where it is not UTF-8),
and every gzip, zlib, bzip2, xz or zstd stream in the bytes that these give,
codes under 256 being bytes. Each new layer is scanned and put on the
worklist, until nothing decodes any more. A layer with the content and ranges of one
met before is not entered again, and neither is a stream with the content of one met
before: both are fixpoints of the whole text, whatever the order of decoding, and
streams that unpack to themselves end.

A base64 run goes on over single line breaks, also escaped ones, with up to 64 blanks
around each. If the run does not decode to a stream or to text as a whole, it is also read
from its second, third and fourth character, so that what stands before the code,
up to a ``/``, ``_``, ``-`` or any other character of the alphabet, does not matter.

Spans are code points of the original text, end exclusive. A decoded layer
carries, for each of its characters, the range of its parent that made it (whole
quartets for base64); ranges are taken back
to the original at once. A stream's range is that of the bytes it was read from.

A compressed stream is read to its end, over all members and frames, and scanned in
overlapping pieces together with all that it decodes to; its matches carry the range
of the stream, so only their kinds are kept. Streams of up to ``HELD`` bytes are held,
longer ones made anew from their source at each reading, so memory stays bounded against
archive bombs, whose time is not. ``max_layer`` (a parameter) is how many bytes of
a base64 run inside a stream are held; longer ones are read as streams. Zstandard
frames that ask for a window above 128 MiB are not read, as by its own program.

Edge cases: a null text is an empty one; equal spans found in several layers
count once; repeated rows, empty tables and other columns are no matter.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import map_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
RUN = "[A-Za-z0-9+/_-]"
#: A single line break, also an escaped one, with what indents the lines around it.
BREAK = r"[\x20\t]{0,64}(?:\r\n?|\n|(?:\\{1,8}r)?\\{1,8}n)[\x20\t]{0,64}"
BASE64 = re.compile(rf"(?<!{RUN})(?:{RUN}{{16,}}+|{RUN}++(?={BREAK}{RUN}))(?:{BREAK}{RUN}++)*+={{0,2}}")
BREAKS = re.compile(BREAK)
MAX_LAYER = 16 << 20
UNPACK = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\0", lzma.LZMADecompressor),
    *((bytes([0x78, x]), lambda: zlib.decompressobj(15)) for x in (0x01, 0x5E, 0x9C, 0xDA)),
)

ZSTD = re.compile(rb"\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18", re.DOTALL)
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18|\x78[\x01\x5e\x9c\xda]", re.DOTALL)
#: The patterns over bytes, for streams. An escape at the border of a piece is decoded whole: LONGEST bytes hold any.
ASSIGN_BYTES, ACCESS_BYTES, HEX_BYTES, ESCAPE_BYTES, BASE64_BYTES = (
    re.compile(p.pattern.encode(), p.flags & re.IGNORECASE) for p in (ASSIGN, ACCESS, HEX, ESCAPE, BASE64)
)
PERCENT_BYTES, SPACES, BREAK_BYTES = re.compile(rb"%[0-9A-Fa-f]{2}"), re.compile(rb"\x20+"), re.compile(BREAK.encode())
WORDS = (b"passw", b"secret", b"token", b"api")  # each match of ASSIGN has one, in small letters
CONTINUED = re.compile(rf"(?:{RUN}++|{BREAK}(?={RUN}))*+".encode())
WIDE = re.compile("[^\0-\xff\udc80-\udcff]")
STANDARD = bytes.maketrans(b"-_", b"+/")
#: Bytes of a compressed stream read at a time, of what it gives, of the longest escape, and kept around the end of a base64 run.
STEP, PIECE, LONGEST, EDGE = 64 << 10, 256 << 10, 16, 1024
#: Bytes of a stream's content that are held between its readings.
HELD = 4 << 20

Source = Callable[[], Iterator[bytes]]
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def matches(text: str) -> Iterator[Span]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


class Layer:
    """A decoded text; ``at`` and ``to`` give each character's range in the original, or None for the text itself."""

    def __init__(self, text: str, at=None, to=None):
        self.text, self.at, self.to = text, at, to

    def starts(self, place):
        return place if self.at is None else self.at[place]

    def ends(self, place):
        return place if self.to is None else self.to[place - 1]

    def key(self) -> bytes:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        digest.update(self.at)
        digest.update(self.to)
        return digest.digest()


Add = Callable[[int, int, set[int]], None]


def _spliced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` decoded; None if nothing changes."""
    parts, at, to, upto = [], [], [], 0
    kind = np.int32 if len(layer.text) < 2 ** 31 else np.int64
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        text, starts, ends = new
        plain = np.arange(upto, m.start(), dtype=kind)
        parts += [layer.text[upto:m.start()], text]
        at += [plain, (starts + m.start()).astype(kind)]
        to += [plain + 1, (ends + m.start()).astype(kind)]
        upto = m.end()
    if not parts:
        return None
    plain = np.arange(upto, len(layer.text), dtype=kind)
    at, to = np.concatenate([*at, plain]), np.concatenate([*to, plain + 1])
    return Layer("".join(parts) + layer.text[upto:], layer.starts(at), layer.ends(to))


def _utf8(data: bytes, width: int):
    """Text of bytes that were written with ``width`` characters each, and the range of each of its characters."""
    try:
        text = data.decode()
        first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:  # not UTF-8: a character for each byte
        text, first = data.decode("latin-1"), np.arange(len(data))
    return text, first * width, np.append(first[1:], len(data)) * width


def _percent(found: str):
    return _utf8(bytes.fromhex(found.replace("%", "")), 3)


def _escape(found: str):
    if found.startswith("\\x"):
        return _utf8(bytes.fromhex(found.replace("\\x", "")), 4)
    if found.startswith("\\u") and found[2] != "{":
        units = [int(found[i + 2:i + 6], 16) for i in range(0, len(found), 6)]
        text, starts, ends, i = "", [], [], 0
        while i < len(units):
            n = 1
            code = units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                code, n = 0x10000 + ((code - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
            text += chr(code) if not 0xD800 <= code < 0xE000 else "�"
            starts.append(6 * i)
            i += n
            ends.append(6 * i)
        return text, np.array(starts), np.array(ends)
    digits = found.strip("&#;\\uU{}")
    code = int(digits[1:] if digits[:1] in "xX" else digits, 16 if found[0] == "\\" or digits[:1] in "xX" else 10)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), np.array([0]), np.array([len(found)])


def _raw(found: str, decode):
    """As ``decode``, but with a character for each byte that percent and ``\\x`` escapes write."""
    if found[0] != "%" and not found.startswith("\\x"):
        return decode(found)
    data = bytes.fromhex(found.replace("%", "").replace("\\x", ""))
    width = 3 if found[0] == "%" else 4
    at = np.arange(len(data)) * width
    return data.decode("latin-1"), at, at + width


def _readable(text: str) -> bool:
    return not re.search("[\x00-\x08\x0e-\x1f\x7f]", text)


class _Feed:
    """Pieces of bytes read like a file; what a member leaves is put back."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.given = iter(pieces), b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, b"")):
            self.held += more
        return self.held[:n]

    def read(self, n: int) -> bytes:
        if not self.held:
            self.held = next(self.pieces, b"")
        data, self.held = self.held[:n], self.held[n:]
        self.given += len(data)
        return data

    def exactly(self, n: int) -> bytes:
        data = b""
        while len(data) < n:
            more = self.read(n - len(data))
            if not more:
                raise EOFError
            data += more
        return data

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.given -= len(data)


def _zstd_frame(feed: _Feed) -> Iterator[bytes]:
    """One frame, block by block: a block gives at most 128 KiB."""
    magic = feed.exactly(4)
    if magic[0] != 0x28:  # skippable
        left = int.from_bytes(feed.exactly(4), "little")
        while left:
            data = feed.read(min(left, STEP))
            if not data:
                raise EOFError
            left -= len(data)
        return
    tool = zstandard.ZstdDecompressor().decompressobj()
    kind = feed.exactly(1)
    single, fields = kind[0] >> 5 & 1, kind[0] >> 6
    more = (not single) + (0, 1, 2, 4)[kind[0] & 3] + (single, 2, 4, 8)[fields]
    yield tool.decompress(magic + kind + feed.exactly(more))
    last = 0
    while not last:
        head = feed.exactly(3)
        block = int.from_bytes(head, "little")
        last = block & 1
        yield tool.decompress(head + feed.exactly(1 if block >> 1 & 3 == 1 else block >> 3))
    if kind[0] >> 2 & 1:
        yield tool.decompress(feed.exactly(4))


def _member(feed: _Feed, make) -> Iterator[bytes]:
    tool = make()
    data = feed.read(STEP)
    while True:
        out = tool.decompress(data, PIECE)
        yield out
        if tool.eof:
            feed.back(tool.unused_data)
            return
        data = getattr(tool, "unconsumed_tail", b"")
        if not data and len(out) < PIECE and getattr(tool, "needs_input", True):
            data = feed.read(STEP)
            if not data:
                raise EOFError


class Unpacked:
    """All members and frames of a compressed stream, in pieces; each call reads it anew.

    Zeros may stand between members. After a member that is cut or broken the stream
    ends with what it gave. ``consumed``: bytes read by the last call;
    ``ended``: its last member is whole; ``broken``: it met an error.
    """

    def __init__(self, source: Source):
        self.source, self.consumed, self.ended, self.broken = source, 0, False, False

    def __call__(self) -> Iterator[bytes]:
        feed = _Feed(self.source())
        self.consumed, self.ended, self.broken = 0, False, False
        try:
            while True:
                head = feed.peek(6)
                if head[:1] == b"\0" and self.consumed:
                    while feed.peek(1) == b"\0":
                        data = feed.read(STEP)
                        feed.back(data.lstrip(b"\0"))
                    continue
                if ZSTD.match(head):
                    made = _zstd_frame(feed)
                else:
                    make = next((make for magic, make in UNPACK if head.startswith(magic)), None)
                    if make is None:
                        return
                    made = _member(feed, make)
                self.ended = False
                yield from filter(None, made)
                self.consumed, self.ended = feed.given, True
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError) as error:
            self.broken = not isinstance(error, EOFError)
            self.consumed = feed.given


def _memory(data: bytes, start: int = 0) -> Source:
    return lambda: (data[i:i + PIECE] for i in range(start, len(data), PIECE))


def _skipped(source: Source, start: int) -> Source:
    def pieces():
        left = start
        for piece in source():
            if left < len(piece):
                yield piece[left:] if left else piece
            left = max(0, left - len(piece))

    return pieces


def _replaced(source: Source, pattern: re.Pattern, first: bytes, decode) -> Source:
    """The bytes with every match of ``pattern``, none longer than LONGEST, decoded; ``first`` has the bytes that matches begin with."""

    def pieces():
        held = b""
        for piece in source():
            held += piece
            cut = max(held.rfind(first[i:i + 1], max(0, len(held) - LONGEST)) for i in range(len(first)))
            found = cut >= 0 and pattern.match(held, cut)
            cut = len(held) if cut < 0 or found else cut
            if out := pattern.sub(decode, held[:cut]):
                yield out
            held = held[cut:]
        if held:
            yield pattern.sub(decode, held)

    return pieces


def _run_end(held: bytes) -> tuple[int, bool]:
    """How much of ``held`` surely belongs to a base64 run that goes on at its start, and whether more may come."""
    end = CONTINUED.match(held).end()
    if end <= len(held) - EDGE:
        return end, False
    cut = max(0, min(end, len(held) - EDGE))
    for m in BREAK_BYTES.finditer(held, max(0, cut - EDGE)):
        if m.start() >= cut:
            break
        if m.end() > cut:
            cut = m.start()
            break
    return cut, True


def _run(source: Source, start: int, off: int) -> Source:
    """The bytes of a long base64 run, read from its character ``off`` on."""

    def pieces():
        held, chars, skip, more = b"", b"", off, True
        for piece in _skipped(source, start)():
            held += piece
            end, more = _run_end(held)
            chars += BREAK_BYTES.sub(b"", held[:end])
            held = held[end:]
            if len(chars) > skip:
                whole = skip + (len(chars) - skip) // 4 * 4
                if data := _decoded(chars[skip:whole]):
                    yield data
                chars, skip = chars[whole:], 0
            if not more:
                break
        if more:
            chars += BREAK_BYTES.sub(b"", held[:CONTINUED.match(held).end()])
        if data := _decoded(chars[skip:]):
            yield data

    return pieces


def _decoded(chars):
    """The bytes of base64 characters of either alphabet, without breaks and padding."""
    if isinstance(chars, str):
        chars = chars.encode()
    chars = chars[:len(chars) - (len(chars) % 4 == 1)].translate(STANDARD)
    return base64.b64decode(chars + b"=" * (-len(chars) % 4))


def _narrowed(source: Source) -> Source:
    """UTF-8 with a byte for each character under 256; what is not UTF-8 stays."""

    def pieces():
        decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
        for piece in source():
            if text := decoder.decode(piece):
                yield WIDE.sub("?", text).encode("latin-1", "surrogateescape")
        if text := decoder.decode(b"", True):
            yield WIDE.sub("?", text).encode("latin-1", "surrogateescape")

    return pieces


def _escape_bytes(m: re.Match) -> bytes:
    """Codes under 256 are bytes."""
    new = _escape(m[0].decode("latin-1"))
    if new is None:
        return m[0]
    return new[0].encode("latin-1") if new[0] < "\u0100" else new[0].encode("utf-8", "replace")


class Streams:
    """The compressed streams and long base64 runs met in one text, each content once.

    All patterns are ASCII, so bytes are matched as they are. What decodes is itself a
    stream; only pieces, base64 runs of up to ``most`` bytes and streams of up to
    ``HELD`` bytes are held, longer ones are made anew from their source. A worklist
    goes over contents that were not met yet; each keeps its own kinds and what it
    decodes to, so one that occurs again, or contains itself, costs nothing more.
    """

    def __init__(self, most: int):
        self.most = most
        self.own: dict[bytes, set[int]] = {}
        self.below: dict[bytes, list[bytes]] = {}
        self.work: list[tuple[bytes, Source, int]] = []
        self.held = 0

    def enter(self, source: Source) -> bytes:
        """The digest of a stream; it goes on the worklist if it is new."""
        digest, held, size = hashlib.blake2b(), [], 0
        for piece in source():
            digest.update(piece)
            size += len(piece)
            if size <= HELD:
                held.append(piece)
        name = digest.digest()
        if name not in self.own:
            self.own[name], self.below[name] = set(), []
            kept = size if size <= HELD and self.held + size <= 4 * HELD else 0
            self.held += kept
            self.work.append((name, _memory(b"".join(held)) if kept else source, kept))
        return name

    def kinds(self, source: Source) -> set[int]:
        """Places of the kinds found in a stream and in all that it decodes to."""
        first = self.enter(source)
        while self.work:
            name, held, kept = self.work.pop()
            self.held -= kept
            self.own[name] = _stream_kinds(held, self.most, lambda child, name=name: self.below[name].append(self.enter(child)))
        found, seen, left = set(), {first}, [first]
        while left:
            name = left.pop()
            found |= self.own[name]
            new = [x for x in self.below[name] if x not in seen]
            seen.update(new)
            left += new
        return found


def _stream_kinds(source: Source, most: int, enter: Callable[[Source], object]) -> set[int]:
    """Kinds in the bytes of one stream; what they decode to goes to ``enter``."""
    found: set[int] = set()
    near = tail = held = b""  # for the kinds, for escapes and magics, for base64 runs
    upto = at = 0  # bytes read; the place up to which streams were unpacked
    percent = escape = inside = False
    later: list[Source] = []

    def decoded(run: bytes) -> None:
        chars = BREAK_BYTES.sub(b"", run.rstrip(b"="))
        if len(chars) >= 16:
            for off in range(4):
                enter(_memory(_decoded(chars[off:])))

    for piece in source():
        upto += len(piece)
        near = SPACES.sub(b" ", near + piece)
        done = 0
        low = near.lower()
        for m in ASSIGN_BYTES.finditer(near) if any(word in low for word in WORDS) else ():
            if len(m[2]) >= 8:
                found.add(0)
            if m.end() < len(near):
                done = m.end()
        if b"AKIA" in near and any(len(m[0]) >= 16 for m in ACCESS_BYTES.finditer(near)):
            found.add(1)
        if HEX_BYTES.search(near):
            found.add(2)
        near = near[max(done, len(near) - 64):]

        tail += piece
        percent = percent or b"%" in tail and PERCENT_BYTES.search(tail) is not None
        escape = escape or (b"\\" in tail or b"&#" in tail) and ESCAPE_BYTES.search(tail) is not None
        for m in MAGIC.finditer(tail):
            start = upto - len(tail) + m.start()
            if start < at:
                continue
            at = start + 1
            stream = Unpacked(_memory(tail, m.start()))
            for _ in stream():
                pass
            if not stream.broken and start + stream.consumed == upto:  # it may go on behind this piece
                stream = Unpacked(_skipped(source, start))
                later.append(stream)
                for _ in stream():
                    pass
            else:
                enter(stream)
            if stream.ended:
                at = start + stream.consumed
        tail = tail[-LONGEST:]

        held += piece
        if inside:
            end, inside = _run_end(held)
            held = held[end:]
            if inside:
                continue
        cut, done = max(0, len(held) - EDGE), 0
        for m in BASE64_BYTES.finditer(held):
            if m.end() > len(held) - EDGE:
                cut = m.start()
                if len(held) - cut > most + EDGE:
                    start, inside = upto - len(held) + cut, True
                    later += (_run(source, start, off) for off in range(4))
                    cut += _run_end(held[cut:])[0]
                break
            decoded(m[0])
            done = m.end()
        held = held[max(cut, done):]
    if inside:
        held = held[CONTINUED.match(held).end():]
    for m in BASE64_BYTES.finditer(held):
        decoded(m[0])

    if percent:
        raw = _replaced(source, PERCENT_BYTES, b"%", lambda m: bytes([int(m[0][1:], 16)]))
        later += (raw, _narrowed(raw))
    if escape:
        later.append(_replaced(source, ESCAPE_BYTES, b"\\&", _escape_bytes))
    for child in later:
        enter(child)
    return found


def _joined(m: re.Match) -> tuple[str, np.ndarray]:
    """The characters of a base64 run without its line breaks, and their places; padding has places only."""
    parts, places, upto = [], [], 0
    for gap in BREAKS.finditer(m[0]):
        parts.append(m[0][upto:gap.start()])
        places.append(np.arange(upto, gap.start()))
        upto = gap.end()
    parts.append(m[0][upto:].rstrip("="))
    places.append(np.arange(upto, len(m[0])))
    return "".join(parts), np.concatenate(places) + m.start()


def _base64(layer: Layer, streams: Streams, add: Add) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        chars, places = _joined(m)
        if len(chars) < 16:
            continue
        for off in range(4):
            data = _decoded(chars[off:])
            first, after = _quartets(places, off, np.arange(len(data)))
            first, after = layer.starts(first), layer.ends(after)
            covered = _covered(data, first, after, streams, add)
            for a, b in covered:  # stored parts show through, and have been seen
                data = data[:a] + bytes(b - a) + data[b:]
            text, start, end = _utf8(data, 1)
            if covered != [(0, len(data))] and text:
                yield Layer(text, first[start], after[end - 1])
                if not _readable(text) or len(start) == len(data) and not data.isascii():
                    continue
            if not off:
                break  # all of the run is explained


def _quartets(places: np.ndarray, off: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range in the text of the quartet that each decoded byte comes from."""
    first = off + at // 3 * 4
    return places[first], places[np.minimum(first + 3, len(places) - 1)] + 1


def _covered(data: bytes, first: np.ndarray, after: np.ndarray, streams: Streams, add: Add) -> list[tuple[int, int]]:
    """Adds what the compressed streams in ``data`` hold, and gives the ranges of the whole ones. ``first`` and ``after``: each byte's range in the original."""
    covered, upto = [], 0
    for m in MAGIC.finditer(data):
        start = m.start()
        if start < upto:
            continue
        stream = Unpacked(_memory(data, start))
        found = streams.kinds(stream)
        end = min(start + max(1, stream.consumed), len(data))
        if found:
            add(int(first[start]), int(after[end - 1]), found)
        if stream.ended:
            covered.append((start, end))
            upto = end
    return covered


def layers(layer: Layer, streams: Streams, add: Add) -> Iterator[Layer]:
    """What one layer decodes to; what its compressed streams hold goes to ``add``."""
    text = layer.text
    for marks, pattern, decode in ((("%",), PERCENT, _percent), (("\\", "&#"), ESCAPE, _escape)):
        if any(mark in text for mark in marks) and (new := _spliced(layer, pattern, decode)):
            yield new
            raw = _spliced(layer, pattern, lambda found: _raw(found, decode))
            for one in (raw, new) if new.text != raw.text else (raw,):  # bytes, or characters with their codes
                _covered(one.text.encode("latin-1", "replace"), one.at, one.to, streams, add)
    yield from _base64(layer, streams, add)


def scan(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and those of all layers."""
    top, streams = Layer(text or ""), Streams(max_layer)
    base = sorted(matches(top.text))
    every = set(base)

    def add(start: int, end: int, found: set[int]) -> None:
        every.update((start, kind, end) for kind in found)

    work, seen = [*layers(top, streams, add)], set()
    while work:
        layer = work.pop()
        key = layer.key()
        if key in seen:  # reached in another order: same content, same ranges
            continue
        seen.add(key)
        for start, kind, end in matches(layer.text):
            add(int(layer.starts(start)), int(layer.ends(end)), {kind})
        work += layers(layer, streams, add)
    return base, sorted(every)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in order of start, then kind."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(found: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]

    def make():
        def work(batch: pa.RecordBatch):
            found = [scan(text.as_py(), max_layer) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([listed(x[i]) for x in found], item) for i in (0, 1))], ["doc_id", "base", "spans"]
            )

        return work

    return map_batches(docs.select(id_col, text_col), f"doc_id {kind}, base {span}, spans {span}", make)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


