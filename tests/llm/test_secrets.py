import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import tracemalloc
import urllib.parse
import zlib

import pytest
import zstandard

from codelode.llm import secrets
from codelode.llm.secrets import scan

SECRET = 'password = "hunter2hunter2"'


def brute(text):
    """Base spans by a plain walk over the text."""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789abcdef":
            j += 1
        if j - i >= 32:
            out.append((i, 2, j))
        i = max(j, i + 1)
    return sorted(out)


def test_base_spans():
    rng = random.Random(5)
    parts = ["token=", "API_KEY : '", "apikey", ": ", "=", "abcdef0123456789", "AKIA", "ABCDEF123456", " ", "\n", "é𝄞", "SECRET", '"', "passwd", "ſecret=aaaaaaaaaa", "toKen=aaaaaaaaaa", "x.y-z_"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        base, spans = scan(text)
        assert base == brute(text) and set(base) <= set(spans)


ENCODINGS = {
    "url": lambda b: "".join(f"%{x:02X}" for x in b),
    "quoted": lambda b: urllib.parse.quote(b.decode("latin-1"), safe=""),
    "unicode": lambda b: "".join(f"\\u{x:04x}" for x in b),
    "hex": lambda b: "".join(f"\\x{x:02x}" for x in b),
    "entity": lambda b: "".join(f"&#{x};" for x in b),
    "base64": lambda b: base64.b64encode(b).decode(),
    "urlsafe": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)).decode(),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)).decode(),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)).decode(),
    "zstd": lambda b: base64.b64encode(zstandard.compress(b)).decode(),
}


@pytest.mark.parametrize("outer", ENCODINGS)
@pytest.mark.parametrize("inner", ENCODINGS)
def test_nested_layers(outer, inner):
    coded = ENCODINGS[outer](ENCODINGS[inner](SECRET.encode()).encode())
    text = f"é𝄞 some words, {coded} and more"
    base, spans = scan(text)
    found = [s for s in spans if s[1] == 0]
    start = text.index(coded)
    assert found and all(start <= a < b <= start + len(coded) for a, _, b in found)


def test_span_of_part():
    text = "before " + urllib.parse.quote('x=1&token="abcdefgh12345"&y=2', safe="") + " after"
    a, _, b = scan(text)[1][-1]
    assert urllib.parse.unquote(text[a:b]).strip('"') == 'token="abcdefgh12345'
    coded = base64.b64encode(b"nothing here " * 5 + SECRET.encode() + b" nothing there" * 5).decode()
    a, _, b = scan("x " + coded)[1][-1]
    assert SECRET.encode()[:-1] in base64.b64decode(coded[a - 2:b - 2]) and b - a < len(SECRET) * 4 // 3 + 8


def test_deep_nesting_and_clean_text():
    data = SECRET.encode()
    for _ in range(12):
        data = base64.b64encode(data)
    assert scan(data.decode())[1]
    assert scan("100% sure %zz \\user &# AAAAAAAAAAAAAAAAAAAAAAAA")[1] == []
    assert scan(None) == scan("") == ([], [])


def test_bomb_is_bounded():
    bomb = base64.b64encode(zlib.compress(b"z" * 3_000_000)).decode()
    assert scan(bomb, max_layer=10_000)[1] == []


def test_rows(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (2, None), (3, "x " * 60_000 + "AKIA" + "A" * 16)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    out = secrets.scan_secrets(df).select("doc_id", secrets.count("base", "assign").alias("n"), secrets.joined("spans").alias("s"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, "assign:0:14"), (1, 1, "assign:0:14"), (2, 0, ""), (3, 0, "access:120000:120020")]
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_all_members(pack):
    for data in (pack(b"nothing ") + pack(SECRET.encode()), pack(b"") + b"\0" * 512 + pack(b"nothing ") + pack(b"x" * 300_000 + SECRET.encode())):
        coded = base64.b64encode(data).decode()
        assert scan(f"see {coded} there")[1] == [(4, 0, 4 + len(coded))]
    # a match over the border of two members is whole in what they unpack to
    assert scan(base64.b64encode(pack(SECRET.encode()[:14]) + pack(SECRET.encode()[14:])).decode())[1]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_whole_stream(pack):
    key = b"0123456789abcdef" * 2
    for edge in range(-30, 8, 5):
        data = bytes(secrets.PIECE + edge) + SECRET.encode() + bytes(secrets.PIECE) + b"AKIA" + b"B" * 12 + b" " + key
        assert [k for _, k, _ in scan(base64.b64encode(pack(data)).decode(), max_layer=10_000)[1]] == [0, 1, 2]


def test_beyond_the_old_cut():
    assert scan(base64.b64encode(gzip.compress(b"z" * (17 << 20) + SECRET.encode())).decode())[1]


def test_layers_of_long_streams(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 3000)
    rng = random.Random(3)
    filling = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    plain = filling + SECRET.encode() + filling
    for inner in (base64.b64encode(plain), base64.b64encode(gzip.compress(plain)), ENCODINGS["url"](plain).encode(), ENCODINGS["unicode"](plain).encode(), bytes(300_000) + gzip.compress(plain)):
        for before in (b"", b"x ", b"x" * 255):
            assert scan(base64.b64encode(gzip.compress(before + inner)).decode(), max_layer=5_000)[1]


def test_stream_memory_is_bounded():
    bomb = base64.b64encode(zlib.compress(zlib.compress(bytes(20 << 20), 9), 9)).decode()
    tracemalloc.start()
    scan(bomb, max_layer=10_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 << 20


LINE = b'some words before it, then password = "hunter2hunter2" and some words after'


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    "])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, zstandard.compress])
@pytest.mark.parametrize("columns", [20, 38, 76])
def test_wrapped_base64(gap, pack, columns):
    coded = base64.b64encode(pack(LINE)).decode()
    lines = gap.join(coded[i:i + columns] for i in range(0, len(coded), columns))
    found = scan(f"é see: {lines} there")[1]
    assert found and all(k == 0 and 7 <= a < b <= 7 + len(lines) for a, k, b in found)
    if pack is bytes:  # the quartets of the secret, with the breaks between them
        i = LINE.index(b"password")
        place = lambda n: 7 + n + n // columns * len(gap)
        assert found == [(place(i // 3 * 4), 0, place((i + len(SECRET) - 2) // 3 * 4 + 3) + 1)]
    inside = gzip.compress(b"x " * 300 + lines.encode() + b" there")
    assert scan(base64.b64encode(inside).decode())[1]


@pytest.mark.parametrize("before", ["https://h.example/a/", "user_", "x-", "+", "ab", "abc/", "/"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, zstandard.compress])
def test_base64_behind_its_own_characters(before, pack):
    for data in (LINE, SECRET.encode()):
        coded = base64.b64encode(pack(data)).decode()
        found = [s for s in scan(f"go {before}{coded} on")[1] if s[1] == 0]
        assert found and all(3 <= a < b <= 3 + len(before) + len(coded) for a, _, b in found)
        if pack is not bytes:
            assert found == [(3 + len(before), 0, 3 + len(before) + len(coded))] or before in ("+", "/")


def test_stream_that_unpacks_to_itself(monkeypatch):
    magic = b"\x1f\x8b\x08"
    monkeypatch.setattr(secrets, "_member", lambda feed, make: iter([feed.read(1000)]))
    assert scan(base64.b64encode(magic + SECRET.encode()).decode())[1]


@pytest.mark.parametrize("outer", ["url", "mixed", "quoted", "unicode", "hex", "entity"])
@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_streams_in_escapes(outer, pack):
    data = pack(b"nothing ") + pack(b"x" * 500 + SECRET.encode())
    coded = urllib.parse.quote(data) if outer == "mixed" else ENCODINGS[outer](data)
    found = scan(f"é𝄞 see {coded} there")[1]
    assert found and all(k == 0 and 7 <= a < b <= 7 + len(coded) for a, k, b in found)
    for again in (ENCODINGS["base64"], ENCODINGS["gzip"], ENCODINGS["url"]):
        assert any(k == 0 for _, k, _ in scan("see " + again(b"a " + coded.encode() + b" z"))[1])


def test_base64_of_any_bytes():
    for data in (b"\0user\0" + SECRET.encode(), "é ".encode("latin-1") + SECRET.encode(), bytes(range(256)) + SECRET.encode() + bytes(range(256))):
        coded = base64.b64encode(data).decode()
        found = [(a, b) for a, k, b in scan(f"x {coded} y")[1] if k == 0]
        i = data.index(b"password")
        assert (2 + i // 3 * 4, 2 + (i + len(SECRET) - 2) // 3 * 4 + 4) in found


def nested(text, times, *names):
    for i in range(times):
        text = ENCODINGS[names[i % len(names)]](text.encode("latin-1"))
    return text


def packed(data, times, pack):
    for _ in range(times):
        data = pack(data)
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("make", [
    lambda: packed(SECRET.encode(), 40, zlib.compress), lambda: packed(SECRET.encode(), 40, gzip.compress),
    lambda: packed(SECRET.encode(), 40, bz2.compress), lambda: packed(SECRET.encode(), 40, zstandard.compress),
    lambda: packed(SECRET.encode(), 400, zlib.compress),
    lambda: SECRET.replace("=", "%" + "25" * 40 + "3D"), lambda: SECRET.replace("=", "\\x5c" + "x5c" * 40 + "x3d"),
    lambda: SECRET.replace("=", "%" + "25" * 9 + "3D").replace("p", "\\x5c" + "x5c" * 9 + "x70"),
    lambda: nested(SECRET, 6, "base64", "quoted"), lambda: nested(SECRET, 5, "zlib", "url", "gzip"),
])
def test_deep_nests_take_no_time(make):
    text = make()
    start = time.time()
    spans = scan(text)[1]
    assert any(kind == 0 for _, kind, _ in spans) and time.time() - start < 1


def test_deep_long_streams():
    rng = random.Random(9)
    text = packed(rng.randbytes(400_000) + SECRET.encode(), 6, gzip.compress)
    start = time.time()
    assert any(kind == 0 for _, kind, _ in scan(text)[1]) and time.time() - start < 8


def naive(text, depth=0):
    """Kinds found by decoding every run of each kind by itself, one after the other, again and again."""
    found = {kind for _, kind, _ in secrets.matches(text)}
    if depth > 12:
        return found
    steps = (
        (r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("latin-1")),
        (r"(?:\\x[0-9a-f]{2})+", lambda m: bytes.fromhex(m[0].replace("\\x", "")).decode("latin-1")),
    )
    for pattern, decode in steps:
        new = re.sub(pattern, decode, text)
        if new != text:
            found |= naive(new, depth + 1)
    for run in re.findall(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            data = base64.b64decode(run, validate=True)
        except ValueError:
            continue
        for unpack in (lambda x: x, gzip.decompress, zlib.decompress, bz2.decompress):
            try:
                found |= naive(unpack(data).decode("latin-1"), depth + 1)
            except (OSError, EOFError, ValueError, zlib.error):
                continue
    return found


def test_against_a_naive_decoder():
    rng = random.Random(12)
    names = ["url", "quoted", "hex", "base64", "gzip", "zlib", "bz2"]
    plain = [SECRET, "AKIA" + "B" * 14, "0f" * 20, "nothing", "token=short"]
    for _ in range(150):
        parts = [nested(rng.choice(plain), rng.randrange(4), *rng.sample(names, 3)) for _ in range(rng.randrange(1, 4))]
        text = " , ".join(parts)
        assert naive(text) <= {kind for _, kind, _ in scan(text)[1]}
