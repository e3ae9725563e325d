"""Exact top-k by inner product over integer vectors.

Vectors become ``floor(scale * x)``; the score is the integer inner product.

* The d x d second-moment matrix of all vectors is summed over partitions; its
  eigenvectors (the right singular vectors of the collection) rotate queries and
  candidates so that the first coordinates carry most of the length.
* Candidates are hashed into blocks of at most about ``block_rows``, queries into
  groups of at most about ``group_rows``; a task holds one block and one group
  whatever the sizes of the tables. That is a stated query set against all rows.
* In a block, candidates come by descending length. A query stops when its length
  times the next candidate's is under its k-th best score. Candidates before that
  are pruned by the partial product over the first ``head`` rotated coordinates
  plus the product of the residual lengths (Cauchy-Schwarz). What is left is
  scored exactly in integers. Float bounds are widened by their rounding error.
* The k best of each block meet by query.

Edge cases: vectors that are null or hold a null, NaN or infinite component take
no part, nor do empty vectors and vectors of another length than the most frequent
one (of equally frequent lengths, the shortest counts). Ties go to the smaller id; rows that share a query's id are
the query's own and are left out; other repeated rows are ranked each. Fewer than k
candidates give fewer rows; an empty table gives none. Products whose sum can
leave 63 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import map_batches

HEAD, STEP = 16, 1024
BLOCK_ROWS, GROUP_ROWS = 16_384, 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and v: array<bigint> of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad)
    return rows.select(
        F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v")
    )


def _matrix(lists) -> np.ndarray:
    if len(lists) == 0:
        return np.zeros((0, 0), np.int64)
    return np.stack([np.asarray(x, np.int64) for x in lists])


def rotation(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the sum of outer products, by descending eigenvalue."""

    def make():
        def work(batch: pa.RecordBatch):
            x = _matrix(batch.column("v").to_pylist()).astype(float)
            if x.size:
                yield pa.RecordBatch.from_arrays([pa.array([(x.T @ x).ravel().tolist()]), pa.array([len(x)])], ["m", "n"])

        return work

    parts = map_batches(rows.select("v"), "m array<double>, n long", make)
    sums = parts.select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    cells = sums.orderBy("at").collect()  # d * d numbers
    d = round(len(cells) ** 0.5)
    moment = np.array([c.x for c in cells]).reshape(d, d)
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def _search(block: pd.DataFrame, group: pd.DataFrame, turn: np.ndarray, k: int, head: int) -> pd.DataFrame:
    ids, cand = block["vec_id"].to_numpy(np.int64), _matrix(block["v"].tolist())
    names, query = group["vec_id"].to_numpy(np.int64), _matrix(group["v"].tolist())
    out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    if not len(ids) or not len(names):
        return out
    length = np.linalg.norm(cand.astype(float), axis=1)
    order = np.lexsort((ids, -length))
    ids, cand, length = ids[order], cand[order], length[order]
    own = np.linalg.norm(query.astype(float), axis=1)
    largest = float(length[0]) * float(own.max())
    if largest >= 2.0 ** 63:
        raise OverflowError("inner products leave 63 bits")
    exact = largest < 2.0 ** 52  # then sums of float products are exact
    slack = 1e-9 * own * length[0] + 1e-6
    c, q = cand.astype(float) @ turn, query.astype(float) @ turn
    c_rest, q_rest = np.linalg.norm(c[:, head:], axis=1), np.linalg.norm(q[:, head:], axis=1)
    best = np.full((len(names), k), -np.iinfo(np.int64).max, np.int64)  # ascending scores
    where = np.full((len(names), k), -1, np.int64)
    alive = np.arange(len(names))
    for first in range(0, len(ids), STEP):
        worst = best[alive, 0].astype(float)
        alive = alive[own[alive] * length[first] + slack[alive] >= worst]
        if not len(alive):
            break
        part = slice(first, first + STEP)
        bound = q[alive, :head] @ c[part, :head].T
        bound += q_rest[alive, None] * c_rest[None, part]
        may = (bound + slack[alive, None] >= best[alive, 0].astype(float)[:, None]) & (names[alive, None] != ids[None, part])
        own_rows, own_cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(own_rows):
            continue
        left, right = query[alive[own_rows]], cand[first + own_cols]
        score = left.astype(float) @ right.T.astype(float) if exact else left @ right.T
        may = may[np.ix_(own_rows, own_cols)]
        low = best[alive[own_rows], 0]
        if len(own_cols) > k:  # at most the k best of the step can enter
            ranked = np.where(may, score, -np.inf if exact else best.min())
            low = np.maximum(low, np.partition(ranked, -k, 1)[:, -k])
        rows, cols = np.nonzero(may & (score >= low[:, None]))
        if not len(rows):
            continue
        score = score[rows, cols].astype(np.int64)
        rows, cols = own_rows[rows], own_cols[cols] + first
        rank = np.lexsort((ids[cols], -score, rows))
        rows, cols, score = rows[rank], cols[rank], score[rank]
        start = np.flatnonzero(np.diff(rows, prepend=-1))
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(rows)]):
            at, hi = alive[rows[lo]], min(hi, lo + k)
            s, w = np.concatenate([score[lo:hi], best[at]]), np.concatenate([cols[lo:hi], where[at]])
            pick = np.lexsort((np.where(w >= 0, ids[w], np.iinfo(np.int64).max), -s))[:k][::-1]
            best[at], where[at] = s[pick], w[pick]
    have = where >= 0
    rows = np.nonzero(have)[0]
    return pd.DataFrame({"query_id": names[rows], "vec_id": ids[where[have]], "score": best[have]})


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    head: int = HEAD, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``."""
    rows = quantised(vectors, id_col, vector_col, scale).where(F.size("v") > 0)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score long"
    if usual is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    else:
        n, rows = usual.n, rows.where(F.size("v") == usual.d)
        turn = rotation(rows)
        blocks = -(-n // block_rows)
        asked = rows.where(F.col("vec_id") % every == 0)
        groups = max(1, -(-asked.count() // group_rows))
        # a task for each pair of block and group; both hold a bounded number of rows
        cand = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).withColumn(
            "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        )
        query = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn(
            "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
        )

        def search(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            return _search(block, group, turn, k, head)

        found = cand.groupBy("b", "g").cogroup(query.groupBy("b", "g")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
