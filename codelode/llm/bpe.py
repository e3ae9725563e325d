"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of text is a row of byte positions. Position ``i`` that starts a live
symbol carries the rank of the pair that it forms with its right neighbour; a
segment tree over the positions keeps ``rank * width + position``, so its root is
the leftmost minimum. A merge changes three leaves (the merged symbol, the one it
swallowed and the left neighbour) and walks each of them up to the root.

Most pieces are a few bytes long and repeat: distinct pieces of a chunk are
encoded together, one tree per row of a numpy array, and kept in a table of
bounded size. Pieces of over 64 bytes get a tree of their own.

Edge cases: a null text is an empty one (no ids, empty bytes); ids that are not
in the vocabulary raise an error on decoding; null id lists decode to empty
bytes. Rows are mapped one to one, so repeated rows, empty tables and further
columns pass through unchanged.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import chunks, map_batches

CHUNK_CHARS = 1_000_000
KEPT_PIECES = 250_000
NONE = np.int64(1) << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks of single bytes and of pairs of tokens, as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank_of = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none, as for a missing neighbour (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], NONE)


def encode_many(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Ids (as int32 bytes) of pieces of at most ``width`` bytes; ``width`` is a power of two."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    length = np.array([len(p) for p in pieces], np.int64)
    place = np.arange(width)
    live = place < length[:, None]
    sym = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
    sym[:, :width] = np.where(live, vocab.single[raw], -1)
    right = np.where(place + 1 < length[:, None], place + 1, width)
    left = np.tile(place - 1, (n, 1))
    left[:, 0] = width
    rank = vocab.pair_ranks(sym[:, :width], np.take_along_axis(sym, right, 1))
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, width:] = np.where(rank < NONE, rank * width + place, NONE)
    size = width
    while size > 1:
        size //= 2
        tree[:, size:2 * size] = tree[:, 2 * size:4 * size].reshape(n, size, 2).min(2)
    rows = np.flatnonzero(tree[:, 1] < NONE)

    def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = np.where(rank < NONE, rank * width + at, NONE)
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    while len(rows):
        best = tree[rows, 1]
        at, merged = best % width, best // width
        gone = right[rows, at]
        after = right[rows, gone]
        sym[rows, at], sym[rows, gone] = merged, -1
        right[rows, at] = after
        has = after < width
        left[rows[has], after[has]] = at[has]
        put(rows, gone, np.full(len(rows), NONE))
        put(rows, at, vocab.pair_ranks(merged, sym[rows, after]))
        before = left[rows, at]
        has = before < width
        put(rows[has], before[has], vocab.pair_ranks(sym[rows[has], before[has]], merged[has]))
        rows = rows[tree[rows, 1] < NONE]
    kept = sym[:, :width]
    ids, ends = kept[kept >= 0].astype(np.int32).tobytes(), np.cumsum((kept >= 0).sum(1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encode_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """Ids of one piece of any length, by a tree of its own."""
    n, pairs, none = len(piece), vocab.pairs, int(NONE)
    width = 1 << max(n - 1, 1).bit_length()
    sym = [int(vocab.single[b]) for b in piece] + [-1]
    right, left = [*range(1, n), n], [n, *range(n - 1)]

    def key(i: int) -> int:
        rank = pairs.get(sym[i] << 32 | sym[right[i]]) if right[i] < n else None
        return none if rank is None else rank * width + i

    tree = [none] * (2 * width)
    tree[width:width + n] = map(key, range(n))
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = i + width
        tree[node] = value
        while node > 1:
            node >>= 1
            low = tree[2 * node] if tree[2 * node] < tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == low:
                break
            tree[node] = low

    while tree[1] < none:
        merged, i = divmod(tree[1], width)
        gone = right[i]
        sym[i], sym[gone], right[i] = merged, -1, right[gone]
        if right[i] < n:
            left[right[i]] = i
        put(gone, none)
        put(i, key(i))
        if left[i] < n:
            put(left[i], key(left[i]))
    return np.array([s for s in sym if s >= 0], np.int32).tobytes()


class Encoder:
    """Ids of texts; remembers a bounded number of pieces."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.find, self.known = vocab, regex.compile(pattern), {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > KEPT_PIECES:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            rank = self.vocab.ranks.get(data)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(data) > 64:
                self.known[piece] = encode_long(self.vocab, data)
            else:
                by_width.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for width, items in by_width.items():
            for first in range(0, len(items), 20_000):
                part = items[first:first + 20_000]
                self.known.update(zip((p for p, _ in part), encode_many(self.vocab, [d for _, d in part], width)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [self.find.findall(text) if text else [] for text in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > KEPT_PIECES:
            new = set().union(*found)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in found]


class Speller:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        n = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None,
) -> DataFrame:
    """``docs`` without its text column, with ``out`` array<int>.

    With ``decoded``, a column of that name holds the bytes that the ids decode
    to, made in the same pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    made = [out, *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in (text_col, *made)]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{out}` array<int>", *([f"`{decoded}` binary"] if decoded else [])])

    def make():
        encoder = Encoder(Vocabulary(shared.value), pattern)
        speller = Speller(shared.value) if decoded else None

        def work(batch: pa.RecordBatch):
            texts = batch.column(text_col).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                ids = encoder.encode(texts[a:b])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    cols.append(pa.array([speller.spell(flat[s:e]) for s, e in zip(ends[:-1], ends[1:])], pa.binary()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], [*kept, *made])

        return work

    return map_batches(docs.select(*kept, text_col), schema, make)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out`` binary: the bytes of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` binary"])

    def make():
        speller = Speller(shared.value)

        def work(batch: pa.RecordBatch):
            lists = batch.column(ids_col).fill_null(pa.scalar([], batch.schema.field(ids_col).type))
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            done = [speller.spell(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], [*batch.schema.names, out])

        return work

    return map_batches(rows, schema, make)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
