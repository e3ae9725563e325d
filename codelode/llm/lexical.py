"""Ranked lexical search with K2-treaps over term-document grids.

Terms are maximal runs of letters and digits of ASCII (A-Z lower-cased) and of all
other characters; they are compared by 64-bit hashes. A term's weight is
``floor(1000 * ln((2N + 2) / (2df + 1)))``; its impact in a document is
``(10**9 * tf) div (1000 * tf + 12 * m)`` with ``m = 75 + (25 * n * N) div L``. A
document's score for an item sums weight times impact over the item's terms, repeats
included. ``N`` counts the documents with a term, ``L`` all terms.

Index. Each document becomes a row of its terms and counts. A bitmap of fixed size
over the hashes of the asked terms is sent to all tasks, so that terms nobody asks
for are left out early (``N``, ``L`` and ``n`` count all terms); what it lets through
wrongly meets no item. Documents are dealt evenly to shards of bounded size,
whatever their ids or texts.

Search. A task holds one shard as a treap: rows are its terms, columns its documents,
documents that share their rarest term side by side. A cell of level ``l`` spans
``2**l`` terms and ``2**l`` documents and stores the largest impact inside; empty
cells are not stored, and each cell points to its up to four children. All terms of
an item descend together, each along its own row: a range of documents has the bound
"sum of weight times the maximum of the term's cell". Ranges are taken best first and
dropped once they cannot reach the k-th best score; at level 0 the bound is the
score. The items are the stated query set: blocks of about ``BLOCK_TERMS`` terms go to
every shard. The k best of all shards meet by item.

Edge cases: null and empty texts, and texts without a term, hold none: such documents
do not count in ``N`` and such items get no rows. Repeated document rows are ranked
each; of equal scores the smaller id is first, null ids last. Items that share an id
are ranked each, items equal in id and text once. Only scores above 0 are listed.
Other columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import chunks, flat_texts, map_batches, written
from codelode.llm.hashing import byte_values, span_hashes, word_spans
from codelode.session import cut_lineage

BITS = 24  # of the bitmap of asked terms: 2 MB
CHUNK_CHARS = 1 << 20
SHARD_DOCS, SHARD_TERMS, BLOCK_TERMS = 1 << 14, 1 << 21, 1 << 20
STEP, CELLS = 16, 1 << 18
TERM_BYTE = np.ones(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    TERM_BYTE[low:high + 1] = False
VALUES = byte_values(1111)
VALUES[ord("A"):ord("Z") + 1] = VALUES[ord("a"):ord("z") + 1]


def term_rows(rows: DataFrame, name: str, asked: np.ndarray | None = None) -> DataFrame:
    """``name``, mark, n, terms (hashes of the distinct terms, those in ``asked`` only), counts: one row per row."""
    shift = np.uint64(64 - BITS)

    def make():
        def work(batch: pa.RecordBatch):
            for a, b in chunks(batch.column(2).to_pylist(), CHUNK_CHARS):
                part = batch.slice(a, b - a)
                data, offsets = flat_texts(part.column(2))
                starts, ends, doc = word_spans(TERM_BYTE[data], offsets)
                n = np.bincount(doc, minlength=part.num_rows)
                term = span_hashes(data, starts, ends, VALUES)
                if asked is not None:
                    keep = asked[(term >> shift).astype(np.int64)]
                    term, doc = term[keep], doc[keep]
                order = np.lexsort((term, doc))
                term, doc = term[order], doc[order]
                first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[:len(term)])
                count = np.diff(np.append(first, len(term)))
                at = pa.array(np.searchsorted(doc[first], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(at, pa.array(term[first].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(count.astype(np.int64))),
                ], [name, "mark", "n", "terms", "counts"])

        return work

    kind = rows.schema[name].dataType.simpleString()
    held = rows.select(name, F.xxhash64("text").alias("mark"), "text")
    return map_batches(held, f"{name} {kind}, mark long, n long, terms array<long>, counts array<long>", make)


def asked_terms(items: DataFrame) -> np.ndarray:
    """Flags over the top ``BITS`` bits of the hashes of the items' terms."""
    slot = F.shiftrightunsigned("term", 64 - BITS) + 1
    maps = items.select(F.explode("terms").alias("term")).select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    out = np.zeros(1 << BITS, bool)
    for row in maps.collect():  # at most 2**BITS / 2**15 rows of 4 KB
        at = (row.bucket - 1) << 15
        out[at:at + (1 << 15)] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of ``x`` at every other place."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Treap:
    """Largest impact of every non-empty cell of a grid, level by level; cell 0 of each level is the empty one."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray):
        self.levels = max(int(row.max()).bit_length(), int(column.max()).bit_length())
        code = _spread(row) << 1 | _spread(column)
        order = np.argsort(code)
        code, most = code[order], impact[order]
        self.most, self.children = [np.append(0, most)], []
        for _ in range(self.levels):
            up = code >> 2
            first = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            cell = np.cumsum(np.append(True, up[1:] != up[:-1]))
            below = np.zeros((len(first) + 1, 4), np.int32)
            below[cell, code & 3] = np.arange(1, len(code) + 1)
            self.children.append(below)
            code, most = up[first], np.maximum.reduceat(most, first)
            self.most.append(np.append(0, most))

    def search(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the k best for terms ``rows``; ties by ``ids``, the place of each column in the order of ids."""
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = self.most[-1][1:2] * weights.sum()
        heap = [(-int(whole[0]), 0, self.levels, np.zeros(1, np.int64), np.ones((1, len(rows)), np.int32), whole)]
        made, step = 1, STEP
        most = max(CELLS // len(rows), 1)
        while heap:
            top, _, level, column, cells, bound = heapq.heappop(heap)
            floor = score[-1] if len(score) == k else 1
            if -top < floor:
                break
            if len(bound) > min(step, most):  # the best of the ranges now, the others later
                order = np.argsort(-bound, kind="stable")
                now, later = order[:min(step, most)], order[min(step, most):]
                heapq.heappush(heap, (-int(bound[later[0]]), made, level, column[later], cells[later], bound[later]))
                made += 1
                column, cells = column[now], cells[now]
            if level:
                level -= 1
                half = 2 * (rows >> level & 1)
                cells = np.concatenate([self.children[level][cells, half + side] for side in (0, 1)])
                column = np.concatenate([2 * column, 2 * column + 1])
                bound = self.most[level][cells] @ weights
            else:
                bound = self.most[0][cells] @ weights
            keep = np.flatnonzero(bound >= floor)
            if not len(keep):
                continue
            column, cells, bound = column[keep], cells[keep], bound[keep]
            if level:
                heapq.heappush(heap, (-int(bound.max()), made, level, column, cells, bound))
                made += 1
            else:
                best, score = np.append(best, column), np.append(score, bound)
                pick = np.lexsort((ids[best], -score))[:k]
                best, score = best[pick], score[pick]
                step *= 2  # the first leaves come soon, later ranges many at a time
        return best, score


def _impacts(n: np.ndarray, tf: np.ndarray, docs: int, total: int) -> np.ndarray:
    wide = object if 25 * int(n.max(initial=0)) * docs >= 2 ** 63 else np.int64
    m = (75 + 25 * n.astype(wide) * docs // total).astype(np.int64)
    return 10 ** 9 * tf // (1000 * tf + 12 * m)


def _search_shard(shard: pa.Table, items: list[tuple], docs: int, total: int, k: int) -> pa.Table:
    """Row number of the item, doc_id, score: the k best documents of the shard for each of ``items`` (terms, weights)."""
    terms = shard.column("terms").combine_chunks()
    owner = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy())
    term = terms.flatten().to_numpy()
    tf = shard.column("counts").combine_chunks().flatten().to_numpy()
    names, row, df = np.unique(term, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(names))  # rare terms first
    row = rank[row]
    n = shard.column("n").to_numpy()
    rarest = np.minimum.reduceat(row, np.flatnonzero(np.diff(owner, prepend=-1)))
    order = np.lexsort((n, rarest))
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    treap = Treap(row, column[owner], _impacts(n[owner], tf, docs, total))
    doc = shard.column("doc_id").combine_chunks()
    place = np.empty(1 << treap.levels, np.int64)
    place[:len(order)] = np.argsort(np.lexsort((doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))))[order]
    out = []
    for number, (asked, weights) in enumerate(items):
        at = np.searchsorted(names, asked)
        here = names[np.minimum(at, len(names) - 1)] == asked
        if here.any():
            best, score = treap.search(rank[at[here]], weights[here], place, k)
            out.append((np.full(len(best), number), order[best], score))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"item": cols[0], "doc_id": doc.take(pa.array(cols[1])), "score": cols[2]})


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = cut_lineage(term_rows(items, "item_id").where("n > 0").dropDuplicates(["item_id", "mark"]))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = written(term_rows(docs, "doc_id", asked_terms(asked)).drop("mark"), "terms")
    size = held.agg(
        F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(F.size("terms") > 0).alias("held"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"),
    ).first()
    shards = max(-(-size.held // SHARD_DOCS), -(-size.terms // SHARD_TERMS), 1)
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * size.docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.select("item_id", "mark", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    weighed = weighed.select("item_id", "mark", F.col("t.terms").alias("term"), F.col("t.counts").alias("times")).join(df, "term")
    weighed = cut_lineage(weighed.select("item_id", "mark", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"))
    dealt = held.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    blocks = -(-weighed.count() // BLOCK_TERMS)
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, mark long, doc_id long, score long")
    for block in range(blocks):
        mine = weighed.where(F.pmod(F.xxhash64("item_id", "mark"), F.lit(blocks)) == block)
        rows = mine.groupBy("item_id", "mark").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).collect()
        names = [(r.item_id, r.mark) for r in rows]
        lists = [(np.array(r.terms, np.int64), np.array(r.weights, np.int64)) for r in rows]
        if rows:
            found = found.unionByName(_block(spark, dealt, shards, names, lists, kind, size.docs, size.total, k))
    order = Window.partitionBy("item_id", "mark").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark, dealt: DataFrame, shards: int, names: list[tuple], lists: list[tuple], kind: str, docs: int, total: int, k: int) -> DataFrame:
    """item_id, mark, doc_id, score of the k best documents of each shard for a block of items."""

    def run(shard: pa.Table) -> pa.Table:
        return _search_shard(shard, lists, docs, total, k)

    found = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "item long, doc_id long, score long")
    keys = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], f"item long, item_id {kind}, mark long")
    return found.join(F.broadcast(keys), "item").drop("item")  # at most BLOCK_TERMS rows
