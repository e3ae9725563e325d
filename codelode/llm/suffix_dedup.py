"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every byte covered by a ``length``-byte string that also starts somewhere else in
the collection (the same document included) is removed; strings are judged on the
input and never cross documents.

Routing. The key of a window (a ``length``-byte string) is the least hash among
its ``GRAM``-byte substrings, so equal windows have equal keys. A piece is a run
of windows of a document with one key. A piece whose key occurs once, with one
place of the least hash, holds nothing repeated; pieces that are equal as a whole
are repeated as a whole; both are decided from hashes. Of the rest one piece of each content goes on with its text,
dealt by key.

Merging. A task cuts the pieces that it gets into shards. The symbols of a text
are its ``STRIDE``-byte strings, one at each byte, and a suffix reads every
``STRIDE``-th of them; ``length`` is ``depth`` symbols. Each shard sorts its own
suffixes to that depth and keeps the order and its transform (the symbol before
each suffix). Shards are then merged without comparing suffixes: an interleave
vector says which shard each place of the merged order belongs to. A round reads
the next symbol of each shard's transform along the vector and deals the places
stably by symbol, which makes the vector right for one more symbol; block borders
are carried along, and the round in which a border appears is the common prefix
of its neighbours. After ``depth`` rounds the blocks are the intervals of
suffixes with ``length`` bytes in common; those with two or more are repeated.
Windows that hold a symbol of which the task has no second one are left out first.

Crowded keys. A key whose pieces hold over ``GROUP_BYTES`` is dealt to several
tasks. What repeats in one of them is settled there; the other windows, and one
window of each repeated class, go on as two 64-bit hashes each, packed in blocks
dealt by hash, and those that meet their like are repeated. So no task holds a
crowded key, and nothing is dropped.

Edge cases: null texts are empty; texts shorter than ``length`` bytes keep
everything; rows that repeat id and text are documents of their own, so they
remove each other; null ids are kept as they are. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import flat_texts, map_batches, written
from codelode.llm.hashing import Hashes, byte_values
from codelode.session import cut_lineage

GRAM, STRIDE, SHARDS = 16, 50, 4
GROUP_BYTES, PIECE, BATCH_BYTES, BLOCK = 2 << 20, 4096, 1 << 20, 1 << 20
#: Windows of crowded keys that a task holds before it passes them on, and that meet in one task.
HELD_WINDOWS, BUCKET_WINDOWS = 1 << 20, 1 << 21
BYTE_VALUE, SECOND_VALUE = byte_values(88), byte_values(888)
WINDOW = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("piece", "<i4"), ("at", "<i8")])


def byte_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> Hashes:
    return Hashes(values[data])


def pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """key, content hash, start, number of windows and places of the least hash of each piece of one text."""
    m = len(data) - length + 1
    if m <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if m > BLOCK:  # a long text, in blocks of windows
        parts = [(a, pieces(data[a:a + BLOCK + length - 1], length)) for a in range(0, m, BLOCK)]
        moved = [(key, content, start + a, *rest) for a, (key, content, start, *rest) in parts]
        return tuple(np.concatenate([p[i] for p in moved]) for i in range(5))
    hashes = byte_hashes(data)
    gram = min(GRAM, length)
    grams, w = hashes.every(gram), length - gram + 1
    rows = np.append(grams, np.full(-len(grams) % w, ~np.uint64(0))).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    key = np.minimum(after[:m], before[w - 1:w - 1 + m])
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    size = np.diff(np.append(start, m))
    if size.max() > PIECE:  # long runs of one key: equal lengths from the run's start
        parts = -(-size // PIECE)
        first = np.repeat(start, parts)
        at = (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        size = np.minimum(np.repeat(size, parts) - at, PIECE)
        start = first + at
    key = key[start]
    spans = zip(key, start.tolist(), (start + size + w - 1).tolist())
    places = np.array([np.count_nonzero(grams[a:b] == k) for k, a, b in spans], np.int64)
    return key, hashes.of(start, start + size + length - 1), start, size, places


def _sorted_places(key: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small numbers (below ``most``): packed with their places, if they fit, for a faster sort."""
    bits = max(len(key), 2).bit_length()
    if int(most).bit_length() + bits <= 63:
        return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """Order-preserving dense numbers, from 1, of 64-bit symbols."""
    bits = max(len(hashes), 2).bit_length()
    packed = np.sort(hashes >> np.uint64(bits) << np.uint64(bits) | np.arange(len(hashes), dtype=np.uint64))
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    top, whole = packed >> np.uint64(bits), hashes[order]
    if ((top[1:] == top[:-1]) & (whole[1:] != whole[:-1])).any():
        return np.unique(hashes, return_inverse=True)[1] + 1
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(np.append(True, whole[1:] != whole[:-1]))
    return out


class Shard:
    """Suffixes of some texts in order to ``depth`` symbols, and the symbol before each."""

    def __init__(self, symbol: np.ndarray, prior: np.ndarray, depth: int):
        """``symbol[p]`` starts at row ``p`` (0 at a text's end); ``prior[p]`` lies one stride before."""
        n = len(symbol)
        rank, span, most = symbol, 1, int(symbol.max(initial=0)) + 1
        order = _sorted_places(rank, most)
        while span < depth:
            ahead = np.zeros(n, np.int64)
            if n > span * STRIDE:
                ahead[:-span * STRIDE] = rank[span * STRIDE:]
            ahead[rank == 0] = 0
            base = int(rank.max(initial=0)) + 1
            pair = rank * base + ahead
            order = _sorted_places(pair, base * base)
            in_order = pair[order]
            fresh = np.append(in_order[:1] > 0, in_order[1:] != in_order[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)  # the end's pair stays 0
            span *= 2
        self.order, self.transform = order, prior[order]


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shard each place of the merged order belongs to, and the blocks that agree in ``depth`` symbols."""
    owner = np.concatenate([np.full(len(s.order), i, np.int8) for i, s in enumerate(shards)])
    block = np.zeros(len(owner), np.int64)
    most = max((int(s.transform.max(initial=0)) for s in shards), default=0) + 1
    for _ in range(depth):
        before = np.empty(len(owner), np.int64)
        for i, shard in enumerate(shards):
            before[owner == i] = shard.transform
        order = _sorted_places(before, most)
        owner, symbol, held = owner[order], before[order], block[order]
        block = np.cumsum(np.append(False, (symbol[1:] != symbol[:-1]) | (held[1:] != held[:-1])))
    return owner, block


def repeated(texts: list[bytes], length: int, shards: int = SHARDS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the class of each of its windows (-1: it holds a symbol that occurs once), and the size of each class."""
    depth = length // STRIDE
    made, where, data = [], [], np.frombuffer(b"".join(texts), np.uint8)
    hashes = byte_hashes(data)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(data), np.uint64)
    if len(data) >= STRIDE:
        whole[:len(data) - STRIDE + 1] = hashes.every(STRIDE)
    number = _symbols(whole)
    inside = np.arange(len(data)) + STRIDE <= np.repeat(begin + sizes, sizes)
    number[~inside] = 0
    lonely = np.cumsum(np.append(0, (np.bincount(number)[number] < 2) | ~inside))
    reach = length - STRIDE + 1  # symbols that start in a window
    open_ = np.zeros(len(data), bool)
    if len(data) >= reach:
        open_[:len(data) - reach + 1] = lonely[reach:] == lonely[:-reach]
    first, stop = _runs(open_)
    size = stop - first + length - 1
    for i in range(shards):
        at, n = first[i::shards], size[i::shards] + 1  # a row for each byte and one for the end of each run
        if not len(at):
            continue
        row = np.cumsum(n) - n
        local = np.arange(n.sum()) - np.repeat(row, n)
        source = np.repeat(at, n) + local
        full = local + STRIDE < np.repeat(n, n)
        symbol = np.where(full, number[np.minimum(source, len(data) - 1)], 0)
        prior = np.where(local >= STRIDE, number[np.maximum(source - STRIDE, 0)], 0)
        made.append(Shard(symbol, prior, depth))
        where.append(np.where(local + length < np.repeat(n, n), source, -1))
    kind = np.full(len(data), -1, np.int64)
    classes = [kind[b:b + max(s - length + 1, 0)] for b, s in zip(begin.tolist(), sizes.tolist())]
    if not made:
        return classes, np.zeros(0, np.int64)
    owner, block = interleave(made, depth)
    starts = np.empty(len(owner), np.int64)
    for i, shard in enumerate(made):
        starts[owner == i] = where[i][shard.order]
    window = starts >= 0
    starts, block = starts[window], block[window]
    member = np.cumsum(np.append(True, block[1:] != block[:-1])[:len(block)]) - 1
    kind[starts] = member
    return classes, np.bincount(member)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, key, print, start, windows, places."""

    def make():
        def work(batch: pa.RecordBatch):
            data, ends = flat_texts(batch.column(2))
            found = [pieces(data[a:b], length) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c.view(np.int64)) for c in cols)],
                ["doc_id", "mark", "key", "print", "start", "windows", "places"],
            )

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, f"doc_id {kind}, mark long, key long, print long, start long, windows long, places long", make)


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """The text of each listed piece: from doc_id, mark, text, list<struct<key, salt, salts, start, windows, single>>."""

    def make():
        def work(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                lists = part.column(3)
                take = pa.array(np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()))
                items = lists.flatten()
                data, ends = flat_texts(part.column(2))
                at = ends[take.to_numpy()] + items.field("start").to_numpy()
                stop = at + items.field("windows").to_numpy() + length - 1
                texts = [data[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(items.field(n) for n in names), pa.array(texts, pa.binary())],
                    ["doc_id", "mark", *names, "text"],
                )

        return work

    names = ["key", "salt", "salts", "start", "single"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, f"doc_id {kind}, mark long, key long, salt int, salts int, start long, single boolean, text binary", make)


def _merged(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, mark, first, stop: runs of repeated windows; or bucket, block, docs, marks: windows of crowded keys that are left to compare.

    A block packs the hashes and places of many windows into one value; ``docs`` and
    ``marks`` say which pieces they belong to.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, first long, stop long, bucket int, block binary, docs array<{kind}>, marks array<long>"

    def nulls(n: int, of: pa.DataType) -> pa.Array:
        return pa.nulls(n, of)

    class Left:
        """Windows of crowded keys, gathered over the batches of a task."""

        def __init__(self, of: pa.DataType):
            self.of, self.rows, self.docs, self.marks, self.n = of, [], [], [], 0

        def add(self, doc, mark, text: bytes, at: np.ndarray, start: int) -> None:
            if not len(at):
                return
            data = np.frombuffer(text, np.uint8)
            rows = np.empty(len(at), WINDOW)
            rows["f1"], rows["f2"] = (byte_hashes(data, v).of(at, at + length) for v in (BYTE_VALUE, SECOND_VALUE))
            rows["piece"], rows["at"] = len(self.docs), at + start
            self.rows.append(rows)
            self.docs.append(doc)
            self.marks.append(mark)
            self.n += len(at)

        def blocks(self) -> Iterator[pa.RecordBatch]:
            if self.n:
                rows = np.concatenate(self.rows)
                bucket = (rows["f1"] % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket).tolist():
                    one = rows[bucket == b]
                    used, one["piece"] = np.unique(one["piece"], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([
                        nulls(1, self.of), *(nulls(1, pa.int64()) for _ in range(3)), pa.array([b], pa.int32()), pa.array([one.tobytes()], pa.binary()),
                        pa.array([[self.docs[i] for i in used]], pa.list_(self.of)), pa.array([[self.marks[i] for i in used]], pa.list_(pa.int64())),
                    ], NAMES)
            self.rows, self.docs, self.marks, self.n = [], [], [], 0

    NAMES = ["doc_id", "mark", "first", "stop", "bucket", "block", "docs", "marks"]

    def answer(table: pa.Table, left: Left) -> Iterator[pa.RecordBatch]:
        raw = table.column("text").to_pylist()
        start = table.column("start").to_numpy()
        single, salts = (table.column(c).to_numpy(zero_copy_only=False) for c in ("single", "salts"))
        classes, size = repeated(raw, length)
        doc, mark = (table.column(c).combine_chunks() for c in ("doc_id", "mark"))
        take, first, stop = [], [], []
        seen = np.zeros(len(size) + 1, bool)
        for i, own in enumerate(classes):
            twice = np.append(size, 0)[own] > 1
            if single[i]:
                a, b = _runs(twice)
                take += [i] * len(a)
                first += (a + start[i]).tolist()
                stop += (b + start[i]).tolist()
            if salts[i] > 1:  # windows of a crowded key: those not settled, and one of each class
                _, lead = np.unique(own, return_index=True)
                new = np.zeros(len(own), bool)
                new[lead] = ~seen[own[lead]]
                seen[own] = True
                left.add(doc[i].as_py(), mark[i].as_py(), raw[i], np.flatnonzero(~twice | new), int(start[i]))
                if left.n > HELD_WINDOWS:
                    yield from left.blocks()
        take = pa.array(take, pa.int64())
        n = len(take)
        yield pa.RecordBatch.from_arrays([
            doc.take(take), mark.take(take), pa.array(first, pa.int64()), pa.array(stop, pa.int64()), nulls(n, pa.int32()),
            nulls(n, pa.binary()), nulls(n, pa.list_(doc.type)), nulls(n, pa.list_(pa.int64())),
        ], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, left = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            left = left or Left(batch.schema.field("doc_id").type)
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "salt")])
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and (key[:, 0] != [held[-1].column(c)[-1].as_py() for c in ("key", "salt")]).any():
                cuts = np.append(0, cuts)
            begin = 0
            for cut in cuts.tolist():
                upto = int(ends[cut - 1]) if cut else 0
                if size + upto - (int(ends[begin - 1]) if begin else 0) >= BATCH_BYTES:
                    held.append(batch.slice(begin, cut - begin))
                    yield from answer(pa.Table.from_batches([b for b in held if b.num_rows]), left)
                    held, size, begin = [], 0, cut
            held.append(batch.slice(begin))
            size += int(ends[-1]) - (int(ends[begin - 1]) if begin else 0)
            held = [b for b in held if b.num_rows]
        if held:
            yield from answer(pa.Table.from_batches(held), left)
        if left:
            yield from left.blocks()

    return texts.mapInArrow(run, schema)


def _apart(blocks: DataFrame) -> DataFrame:
    """doc_id, mark, first, stop: runs of windows whose hash several places hold, bucket by bucket."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def find(table: pa.Table) -> pa.Table:
        docs, marks = (pa.concat_arrays([c.flatten() for c in table.column(x).chunks]) for x in ("docs", "marks"))
        parts, base = [], 0
        for block, owners in zip(table.column("block").to_pylist(), table.column("docs")):
            rows = np.frombuffer(block, WINDOW).copy()
            rows["piece"] += base
            base += len(owners)
            parts.append(rows)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["f2"], rows["f1"]))]
        same = (rows["f1"][1:] == rows["f1"][:-1]) & (rows["f2"][1:] == rows["f2"][:-1])
        rows = rows[np.append(same, False) | np.append(False, same)]
        rows = rows[np.lexsort((rows["at"], rows["piece"]))]
        cut = np.append(True, (rows["piece"][1:] != rows["piece"][:-1]) | (rows["at"][1:] != rows["at"][:-1] + 1))[:len(rows)]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(rows)) - 1
        take = pa.array(rows["piece"][first].astype(np.int64))
        return pa.table({
            "doc_id": docs.take(take), "mark": marks.take(take), "first": pa.array(rows["at"][first]), "stop": pa.array(rows["at"][last[:len(first)]] + 1),
        })

    return blocks.groupBy("bucket").applyInArrow(find, f"doc_id {kind}, mark long, first long, stop long")


def _kept(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: from doc_id, text, runs of repeated windows."""

    def make():
        def work(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                data, ends = flat_texts(part.column(1))
                out = []
                for a, b, runs in zip(ends[:-1].tolist(), ends[1:].tolist(), part.column(2)):
                    size = b - a
                    edge = np.zeros(size + 1, np.int64)
                    if runs.is_valid and len(runs):
                        np.add.at(edge, runs.values.field("first").to_numpy(), 1)
                        np.add.at(edge, runs.values.field("stop").to_numpy() + length - 1, -1)
                    gone = np.cumsum(edge[:size]) > 0
                    out.append((size, int(gone.sum()), len(_runs(gone)[0]), data[a:b][~gone].tobytes()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.binary()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        return work

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary", make)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay): one row per row of ``docs``."""
    if length % STRIDE:
        raise ValueError(f"length must be a multiple of {STRIDE}")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    who = ["doc_id", "mark"]
    rows = written(_piece_rows(docs.select(*who, "text"), length), "pieces")
    keys = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.max("places").alias("places"),
        ((F.min("print") != F.max("print")) | (F.min("windows") != F.max("windows"))).alias("several"),
    ).where("k > 1 or places > 1").select("key", (F.col("several") | (F.col("places") > 1)).alias("several"))
    shared = written(rows.drop("places").join(keys, "key"), "shared")
    content = ["key", "print", "windows"]
    groups = shared.groupBy(*content).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("start", "mark", "doc_id")).alias("rep"), F.first("several").alias("several")
    )
    groups = cut_lineage(groups)
    whole = shared.join(groups.where("copies > 1").select(*content), content).select(
        *who, F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("stop")
    )
    crowd = cut_lineage(groups.where("several").groupBy("key").agg(
        F.ceil(F.sum(F.col("windows") + length - 1) / GROUP_BYTES).cast("int").alias("salts")
    ))
    listed = groups.where("several").join(crowd, "key").select(
        "rep.doc_id", "rep.mark", F.struct(
            "key", F.pmod(F.xxhash64("print"), F.col("salts")).cast("int").alias("salt"), "salts", "rep.start", "windows",
            (F.col("copies") == 1).alias("single"),
        ).alias("piece"),
    ).groupBy(*who).agg(F.collect_list("piece").alias("pieces"))

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
        return left.alias("l").join(right.alias("r"), same, how)

    texts = _cut_out(met(docs, listed, "inner").select("l.doc_id", "l.mark", "l.text", "r.pieces"), length)
    texts = texts.repartition("key", "salt").sortWithinPartitions("key", "salt")
    left = crowd.where("salts > 1").agg(F.coalesce(F.sum("salts"), F.lit(0)).alias("n")).first()["n"] * GROUP_BYTES
    found = cut_lineage(_merged(texts, length, left // BUCKET_WINDOWS + 1))
    apart = _apart(found.where("bucket is not null").select("bucket", "block", "docs", "marks"))
    runs = whole.union(found.where("bucket is null").select(*who, "first", "stop")).union(apart)
    runs = runs.groupBy(*who).agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    return _kept(met(docs, runs, "left").select("l.doc_id", "l.text", "r.runs"), length)
