"""Removal of repeated word sequences with prefix-partitioned suffix trees.

Words are maximal runs of bytes other than ``\\x20\\x09-\\x0D``; a window is ``length``
consecutive words of one document. A word is removed if a window covers it whose
word sequence also starts in a document with a smaller id. Windows are judged on
the input, and words are compared by 64-bit hashes.

Partition. The suffix that starts at a window is dealt by a variable-length prefix:
its words up to the end of the least ``GRAM``-word hash in the window. Prefixes
that end in the same least gram share a key, so the neighbouring suffixes of a
document mostly stay together: a piece is a run of windows of one document with one
key, and is shipped once. A key that occurs in one document only is a leaf and goes
no further. Pieces that are equal as a whole go on as one content.

Trees. Each task takes whole keys up to ``BATCH_WORDS`` words and builds the suffix
tree of their pieces as suffix array and common prefixes (prefix doubling, then one
binary descent over the doubling ranks). Its internal nodes of depth ``length`` or
more are the repeats; the least document below a node decides who keeps its words.
Suffixes read to depth ``length``: deeper repeats are unions of such windows.

Crowded keys. Where the contents of a key exceed ``GROUP_WORDS`` words, its prefixes
grow to the whole window: each window becomes the leaf group of its own 128-bit
hash, and the groups' least documents come from one aggregation, summed up before
the shuffle. So no task holds a crowded key, and nothing is dropped. A key or a
content with over ``1 / SUPPORT`` of all rows meets its partners by broadcast of
fewer than ``SUPPORT`` rows.

Edge cases: null texts hold no words; texts under ``length`` words stay whole. Rows
with a null id lose what any row with an id holds, and take nothing from others.
Rows that share an id do not affect each other. Ids are whole numbers. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import chunks, flat_texts, map_batches, written
from codelode.llm.hashing import BASE, Hashes, byte_values, mixed, span_hashes, word_spans
from codelode.session import cut_lineage

GRAM, PIECE, BLOCK = 8, 4096, 1 << 20
BATCH_WORDS, GROUP_WORDS = 1 << 19, 1 << 20
CHUNK_CHARS = 1 << 20
SUPPORT = 1024
NO_ID = np.iinfo(np.int64).max
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(9, 14)]] = False
VALUES = byte_values(1313)
WHO = ("doc_id", "mark")
CONTENT = ("key", "print", "windows")


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start, end and document of each word of texts that lie end to end."""
    starts, ends, doc = word_spans(WORD_BYTE[data], offsets)
    return span_hashes(data, starts, ends, VALUES), starts, ends, doc


def pieces(words: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Document, start (word), windows, key and content hash of each piece."""
    m = len(words) - length + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if m > BLOCK:  # long texts, in blocks of windows
        found = []
        for a in range(0, m, BLOCK):
            cut = slice(a, a + BLOCK + length - 1)
            row, start, *rest = pieces(words[cut], doc[cut], length)
            found.append((row, start + a, *rest))
        return tuple(map(np.concatenate, zip(*found)))
    hashes = Hashes(words)
    gram = min(GRAM, length)
    grams, w = hashes.every(gram), length - gram + 1
    rows = np.append(grams, np.full(-len(grams) % w, ~np.uint64(0))).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    key = np.minimum(after[:m], before[w - 1:w - 1 + m])
    whole = doc[:m] == doc[length - 1:]
    edge = np.append(True, (key[1:] != key[:-1]) | (doc[1:m] != doc[:m - 1]) | (whole[1:] != whole[:-1]))
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, m))
    start, size = start[whole[start]], size[whole[start]]
    parts = -(-size // PIECE)  # long runs of one key: equal lengths from the run's start
    if len(parts) and parts.max() > 1:
        at = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        start, size = np.repeat(start, parts) + at, np.minimum(np.repeat(size, parts) - at, PIECE)
    return doc[start], start, size, key[start], hashes.of(start, start + size + length - 1)


class SuffixTree:
    """Suffix array and common prefixes, to ``depth`` words, of the pieces of some groups."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, depth: int):
        """``words`` holds all pieces end to end; only suffixes of ``depth`` words or more are in the tree."""
        n = len(words)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words up to the end of the piece
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        ranks, span = {1: rank}, 1
        while span < depth:
            step = min(span, depth - span)
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:]
            ahead[left <= step] = 0
            pair = rank * (int(rank.max(initial=0)) + 1) + ahead
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
            span += step
            ranks[span] = rank
        place = np.flatnonzero(left >= depth)
        self.depth, self.order = depth, place[np.argsort(rank[place], kind="stable")]
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(len(a), np.int64)
        for span in sorted(ranks, reverse=True):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            same = (ranks[span][x] == ranks[span][y]) & (common + span <= depth)
            common += np.where(same, span, 0)
        self.common = common

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """First place in the order, and number of leaves, of each internal node of full depth."""
        deep = np.concatenate([[False], self.common >= self.depth, [False]])
        first = np.flatnonzero(deep[1:] & ~deep[:-1])
        last = np.flatnonzero(deep[:-1] & ~deep[1:])
        return first, last - first + 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, key, print, start, windows of each piece of ``docs`` (doc_id, mark, text)."""

    def make():
        def work(batch: pa.RecordBatch):
            for a, b in chunks(batch.column(2).to_pylist(), CHUNK_CHARS):
                part = batch.slice(a, b - a)
                data, offsets = flat_texts(part.column(2))
                words, _, _, doc = words_of(data, offsets)
                base = np.searchsorted(doc, np.arange(part.num_rows))  # each document's first word
                row, start, size, key, content = pieces(words, doc, length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array((start - base[row]).astype(np.int32)), pa.array(size.astype(np.int32)),
                ], ["doc_id", "mark", "key", "print", "start", "windows"])

        return work

    return map_batches(docs, "doc_id long, mark long, key long, print long, start int, windows int", make)


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """key, print, windows, low, salts, words (hashes): from text, list<struct<key, print, windows, start, low, salts>>."""
    names = ["key", "print", "windows", "low", "crowded"]

    def make():
        def work(batch: pa.RecordBatch):
            for a, b in chunks(batch.column(0).to_pylist(), CHUNK_CHARS):
                part = batch.slice(a, b - a)
                lists = part.column(1)
                items = lists.flatten()
                data, offsets = flat_texts(part.column(0))
                words, _, _, doc = words_of(data, offsets)
                base = np.searchsorted(doc, np.arange(part.num_rows))
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                start = base[owner] + items.field("start").to_numpy()
                stop = start + items.field("windows").to_numpy() + length - 1
                cut = pa.array([words[i:j].tobytes() for i, j in zip(start.tolist(), stop.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(items.field(n) for n in names), cut], [*names, "words"])

        return work

    return map_batches(rows, "key long, print long, windows int, low long, crowded boolean, words binary", make)


def _tree_runs(texts: DataFrame, length: int) -> DataFrame:
    """key, print, windows, first, stop: runs of a content's windows that also start in a document before its least one."""

    def answer(table: pa.Table) -> pa.RecordBatch:
        raw = table.column("words").combine_chunks()
        sizes = pc.binary_length(raw).to_numpy().astype(np.int64) // 8
        words = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        low = table.column("low").fill_null(NO_ID).to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        tree = SuffixTree(words, sizes, length)
        first, leaves = tree.nodes()
        inside = np.arange(leaves.sum()) - np.repeat(np.cumsum(leaves) - leaves, leaves) + np.repeat(first, leaves)
        at = tree.order[inside]
        least = np.minimum.reduceat(low[owner[at]], np.cumsum(leaves) - leaves) if len(at) else np.zeros(0, np.int64)
        gone = np.zeros(len(words), bool)
        gone[at[np.repeat(least, leaves) < low[owner[at]]]] = True
        begin, stop = _runs(gone)  # windows of two pieces never touch
        take = owner[begin]
        base = (np.cumsum(sizes) - sizes)[take]
        return pa.RecordBatch.from_arrays([
            *(table.column(c).combine_chunks().take(pa.array(take)) for c in CONTENT),
            pa.array((begin - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)),
        ], [*CONTENT, "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy().astype(np.int64) // 8)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and key[0] != held[-1].column("key")[-1].as_py():
                cuts = np.append(0, cuts)
            begin = done = 0
            for cut in cuts.tolist():
                upto = int(ends[cut - 1]) if cut else 0
                if size + upto - done >= BATCH_WORDS:
                    held.append(batch.slice(begin, cut - begin))
                    yield answer(pa.Table.from_batches([b for b in held if b.num_rows]))
                    held, size, begin, done = [], 0, cut, upto
            held.append(batch.slice(begin))
            held = [b for b in held if b.num_rows]
            size += int(ends[-1]) - done
        if held:
            yield answer(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "key long, print long, windows int, first int, stop int")


def _window_runs(texts: DataFrame, length: int) -> DataFrame:
    """The same as ``_tree_runs`` for crowded keys: one aggregation over the hashes of whole windows."""

    def make():
        def work(batch: pa.RecordBatch):
            raw = batch.column("words").to_pylist()
            for row, one in enumerate(raw):
                words = np.frombuffer(one, np.uint64)
                halves = [Hashes(w).every(length).view(np.int64) for w in (words, mixed(words + BASE))]
                n = len(halves[0])
                take = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in (*CONTENT, "low")), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, halves)],
                    [*CONTENT, "low", "at", "f1", "f2"],
                )

        return work

    rows = map_batches(texts.select(*CONTENT, "low", "words"), "key long, print long, windows int, low long, at int, f1 long, f2 long", make)
    rows = written(rows, "windows")
    least = rows.groupBy("f1", "f2").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null")
    gone = met(rows, least, ["f1", "f2"], "n").where("low is null or low > least")
    return gone.select(*CONTENT, F.col("at").alias("first"), (F.col("at") + 1).alias("stop"))


def met(rows: DataFrame, groups: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per value of ``on``).

    Groups whose ``weight`` (rows that they meet) is over 1 / SUPPORT of the sum are
    fewer than SUPPORT and are broadcast; the rest is left to an ordinary join.
    """
    total = groups.agg(F.sum(weight).alias("all")).first()["all"] or 0
    heavy = F.col(weight) * SUPPORT > total
    few = F.broadcast(groups.where(heavy))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(groups.where(~heavy), on))


def _kept(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept: from doc_id, text, runs of removed windows."""

    def make():
        def work(batch: pa.RecordBatch):
            for a, b in chunks(batch.column(1).to_pylist(), CHUNK_CHARS):
                part = batch.slice(a, b - a)
                data, offsets = flat_texts(part.column(1))
                starts, ends, doc = word_spans(WORD_BYTE[data], offsets)
                lists = part.column(2)
                items = lists.flatten()
                base = np.searchsorted(doc, np.arange(part.num_rows + 1))
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, base[owner] + items.field("first").to_numpy(), 1)
                np.add.at(edge, base[owner] + items.field("stop").to_numpy() + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                stay = np.flatnonzero(~gone)
                last = np.append(doc[stay][1:] != doc[stay][:-1], True)[:len(stay)]
                inner = stay[~last]  # kept words that another kept word of the document follows
                mask = np.zeros(len(data) + 1, np.int8)
                mask[starts[stay]] += 1
                mask[ends[stay]] -= 1
                use = np.cumsum(mask[:-1]).astype(bool)
                use[ends[inner]] = True
                out = data.copy()
                out[ends[inner]] = 0x20
                size = np.add.reduceat(np.append(use, False).astype(np.int64), offsets[:-1]) if part.num_rows else np.zeros(0, np.int64)
                size[offsets[1:] == offsets[:-1]] = 0
                ends_out = np.append(0, np.cumsum(size))
                text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(ends_out), pa.py_buffer(out[use])])
                removed = np.bincount(doc[gone], minlength=part.num_rows)
                first, stop = _runs_within(gone, doc)
                at = np.searchsorted(doc[first], np.arange(part.num_rows + 1)) if len(first) else np.zeros(part.num_rows + 1, np.int64)
                pair = pa.StructArray.from_arrays(
                    [pa.array((x - base[doc[first]]).astype(np.int32)) for x in (first, stop)], ["first", "stop"]
                )
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(base)), pa.array(removed.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pair), text.cast(pa.string()),
                ], ["doc_id", "n_words", "n_removed", "spans", "kept"])

        return work

    return map_batches(rows, "doc_id long, n_words long, n_removed long, spans array<struct<first:int,stop:int>>, kept string", make)


def _runs_within(flags: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flagged words, cut at the borders of documents."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = doc[1:] != doc[:-1]
    first = flags & np.append(True, border | ~flags[:-1])
    last = flags & np.append(border | ~flags[1:], True)
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words: first, stop), kept (the other words, one space between): one row per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    shared = _shared_pieces(docs, length)
    contents = cut_lineage(shared.groupBy(*CONTENT).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("start", "mark", "doc_id")).alias("rep"),
        F.first("several").alias("several"),
    ))
    texts = _content_texts(docs, contents, length)
    calm = texts.where("not crowded").repartition("key").sortWithinPartitions("key")
    found = _tree_runs(calm, length).unionByName(_window_runs(texts.where("crowded"), length))
    inner = found.groupBy(*CONTENT).agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    ruled = contents.select(*CONTENT, "copies", "low").join(inner, [*CONTENT], "left").where("copies > 1 or runs is not null")
    ruled = cut_lineage(ruled)
    later = F.col("low").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("low")))
    whole = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("stop")))
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["stop"] + F.col("start")).alias("stop")))
    spans = met(shared, ruled, [*CONTENT], "copies").select(*WHO, F.when(later, whole).otherwise(moved).alias("runs"))
    spans = spans.where("runs is not null").groupBy(*WHO).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    return _kept(docs.alias("l").join(spans.alias("r"), same, "left").select("l.doc_id", "l.text", "r.runs"), length)


def _shared_pieces(docs: DataFrame, length: int) -> DataFrame:
    """The pieces whose key occurs in several documents; ``several``: with more than one content."""
    rows = written(_piece_rows(docs.select(*WHO, "text"), length), "pieces")
    keys = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"),
        (F.min("doc_id").isNotNull() & ((F.min("doc_id") != F.max("doc_id")) | F.max(F.col("doc_id").isNull()))).alias("apart"),
        ((F.min("print") != F.max("print")) | (F.min("windows") != F.max("windows"))).alias("several"),
    ).where("apart")
    return written(met(rows, cut_lineage(keys.drop("apart")), ["key"], "k").drop("k"), "shared")


def _content_texts(docs: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """The word hashes of one piece of each content of the keys that have several."""
    several = contents.where("several")
    sizes = several.groupBy("key").agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("windows") + length - 1) > GROUP_WORDS).alias("crowded"))
    listed = met(several, cut_lineage(sizes), ["key"], "k").select(
        "rep.doc_id", "rep.mark", F.struct(*CONTENT, "rep.start", "low", "crowded").alias("piece")
    ).groupBy(*WHO).agg(F.collect_list("piece").alias("pieces"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    return written(_cut_out(docs.alias("l").join(listed.alias("r"), same).select("l.text", "r.pieces"), length), "contents")
