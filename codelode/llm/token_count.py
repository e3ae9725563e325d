"""Token counts of texts by rank-synchronous merging of ragged arrays.

For a word-level BPE vocabulary file (normalised to NFC and lower case, pieces
by a pattern, byte symbols, the last of which carries the word end). Distinct
pieces of a chunk are one ragged numpy array. Each round looks up the rank of
every adjacent pair, takes each piece's lowest rank and merges all places that
have it at once (of overlapping ones, as in ``aaa``, the left one first); pieces
without a pair leave the array. What survives is counted.

Merging all places of a rank at once equals merging them one by one if no merge
makes a symbol that takes part in a merge of lower rank. That is tested when the
vocabulary is read; if it does not hold only the leftmost place is merged.

Strings of added tokens inside a text are cut out first and count as one token
each; no token is added at the ends. Edge cases: a null text has 0 tokens; rows
map one to one, so repeated rows, empty tables and other columns are no matter.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codelode.llm.common import chunks, map_batches

CHUNK_CHARS = 2_000_000
KEPT_PIECES = 600_000
NONE = np.int64(1) << 60


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Merges:
    """Ids and ranks of a word-level BPE vocabulary."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        symbol = byte_symbols()
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbol[b] + end] for b in range(256)], np.int64)
        table, made = {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            table[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
            made.setdefault(vocab[a + b], rank)
        self.keys = np.array(sorted(table), np.int64)
        self.rank = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.new = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        firsts = {}
        for key, (rank, _) in table.items():
            for part in (key >> 32, key & 0xFFFFFFFF):
                firsts[part] = min(rank, firsts.get(part, rank))
        last_made = {}
        for rank, token in table.values():
            last_made[token] = max(rank, last_made.get(token, rank))
        self.ordered = all(firsts.get(token, rank + 1) > rank for token, rank in last_made.items())

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece (none of them empty)."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(length) - 1
        sym[ends] = self.last[raw[ends]]
        out, row = np.zeros(n, np.int64), np.arange(n)
        while len(row):
            first = np.cumsum(length) - length
            total = len(sym)
            final = np.zeros(total, bool)
            final[first + length - 1] = True
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(total, NONE)
            hit = (self.keys[at] == key) & ~final[:-1]
            rank[:-1][hit] = self.rank[at[hit]]
            low = np.minimum.reduceat(rank, first)
            going = low < NONE
            out[row[~going]] = length[~going]
            owner = np.repeat(np.arange(len(row)), length)
            marked = (rank == low[owner]) & going[owner]
            where = np.flatnonzero(marked)
            if self.ordered:  # of a run of overlapping places, every other one
                fresh = np.ones(len(where), bool)
                fresh[1:] = where[1:] != where[:-1] + 1
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - start) % 2 == 0]
            else:
                where = where[np.diff(owner[where], prepend=-1) > 0]
            sym[where] = self.new[at[where]]
            keep = going[owner]
            keep[where + 1] = False
            length = length - np.bincount(owner[where], minlength=len(row))
            sym, length, row = sym[keep], length[going], row[going]
        return out


class Counter:
    """Token counts of texts; remembers a bounded number of pieces."""

    def __init__(self, merges: Merges):
        self.merges, self.find, self.known = merges, regex.compile(merges.pattern), {}
        self.added = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None

    def pieces(self, text: str | None) -> tuple[int, list[str]]:
        """How many added tokens a text holds, and its other pieces."""
        if not text:
            return 0, []
        parts = self.added.split(text) if self.added else [text]
        found: list[str] = []
        for part in parts:
            plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
            found += self.find.findall(plain.lower())
        return len(parts) - 1, found

    def count(self, texts: list[str | None]) -> list[int]:
        found = [self.pieces(text) for text in texts]
        every = set().union(*(pieces for _, pieces in found))
        new = every.difference(self.known)
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known.clear()
            new = every
        if new:
            order = list(new)
            self.known.update(zip(order, self.merges.count([p.encode() for p in order]).tolist()))
        return [extra + sum(map(self.known.__getitem__, pieces)) for extra, pieces in found]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens; ``vocabulary`` is the text of the vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = Counter(Merges(shared.value))

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            counts: list[int] = []
            for a, b in chunks(texts, CHUNK_CHARS):
                counts += counter.count(texts[a:b])
            octets = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(octets, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

        return work

    return map_batches(docs.select(id_col, text_col), f"doc_id {kind}, n_bytes long, n_tokens long", make)
