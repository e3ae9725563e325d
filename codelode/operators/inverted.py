"""Inverted index in parts: made and searched by one Arrow function for each part.

A part holds all chunks of some files. One task cuts its texts into tokens, counts them
and turns them round, so no posting is sorted or shuffled by itself: a stored row has a
term of a part with a kind and a role, and arrays of its chunks, their lengths and the
term's counts. A row without a term holds the part's sums. A search sends the rows of its
terms to one task for each part, which adds up the weights of all requests and keeps the
best chunks of each.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.schemas import ORDINAL_BITS

# executors need not find this package: the functions go to them with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = "term string, part int, kind string, role string, chunks array<long>, lengths array<int>, {counted}, total long"
COUNTED = _ROWS.format(counted="counts array<int>")
PLACED = _ROWS.format(counted="ends array<int>, places array<int>")
#: Rows of each batch that a task gives to Spark.
BATCH_ROWS = 4096
_BEYOND = re.compile(r"[^\x00-\x7f]").sub
_RUN, _STRICT, _HUMP = re.compile(r"[^\W_]+").findall, re.compile(r"[a-z0-9]+").findall, re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNLIKE: dict[int, str] = {}


def part_of(file_id: Column, parts: int) -> Column:
    """The part that holds a file, as ``repartition`` deals it."""
    return F.pmod(F.hash(file_id), F.lit(parts))


def unlike(spark: SparkSession) -> dict[int, str]:
    """Characters on which Python's Unicode tables and Spark's differ, and what they become after ``str.lower``.

    Letters and digits that Spark's patterns do not know separate tokens; some capitals only Spark lowers.
    """
    if not _UNLIKE:
        every = [*map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000)))]
        known, cased = "".join(filter(str.isalnum, every)), "".join(c for c in every if c < "\U00020000" and c != "\u0130")
        said = spark.range(1).select(
            F.regexp_replace(F.lit(known), r"[\p{L}\p{N}]+", "").alias("out"), F.lower(F.lit(" ".join(cased))).alias("low")).first()
        _UNLIKE.update({ord(c): low for c, low in zip(cased, said["low"].split(" ")) if c.lower() != low and low != c and c not in "\u03a3"})
        _UNLIKE.update(dict.fromkeys(map(ord, said["out"]), " "))
        _UNLIKE.setdefault(0, " ")  # so that it is asked for once; no letter either
    return _UNLIKE


def folding(spark: SparkSession) -> dict[str, str]:
    """What ``text.fold`` makes of characters beyond ASCII in a string after ``str.lower``."""
    table = dict.fromkeys(tx._FOLD_FROM[len(tx._FOLD_TO):], "") | dict(zip(tx._FOLD_FROM, tx._FOLD_TO))
    return table | {chr(c): to for c, to in unlike(spark).items()}


def tokenizer(changed: dict[str, str]) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """``text.fts_tokens`` of a string, and the words of its ``text.normalize_strict``."""
    fold = lambda m: changed.get(m[0], m[0])

    def plain(s: str) -> list[str]:
        low = s.lower()
        return _RUN(low if low.isascii() else _BEYOND(fold, low))

    def strict(s: str) -> list[str]:
        return _STRICT(_HUMP.sub(" ", s).lower())

    return plain, strict


class _Numbers(dict):
    """Numbers of its keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _packed(places: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of postings as ``fulltext.packed`` has them, the first half of each before the others."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    half = np.repeat((sizes + 1) // 2, sizes)
    at = np.arange(len(places))
    late = at - first >= half
    out = places.copy()
    out[late] = places[late] - places[at[late] - half[late]] - (np.repeat(lengths, sizes)[late] >> 1)
    return out


def _turned(batches: Iterable[pa.RecordBatch], placed: bool, changed: dict[str, str]) -> Iterator[pa.RecordBatch]:
    plain, strict = tokenizer(changed)
    terms, chunks, groups = _Numbers(), _Numbers(), _Numbers()
    of_term, count, of_chunk, spots, widths = array("i"), array("i"), array("i"), array("i"), array("i")
    rows = held = 0
    part = None
    cut: dict[str, tuple[list[str], list[str]]] = {}

    def words_of(text: str) -> tuple[list[str], list[str]]:
        """The tokens of a text and of its strict form. Tokens end with their line, and the lines of the last text of several are kept."""
        if "\n" in text:
            cut.clear()
            for line in text.split("\n"):
                if line not in cut:
                    cut[line] = words_of_line(line)
            found = [cut[line] for line in text.split("\n")]
            body = list(chain.from_iterable([x[0] for x in found]))
            return body, body if all(x[0] is x[1] for x in found) else list(chain.from_iterable([x[1] for x in found]))
        return cut[text] if text in cut else words_of_line(text)

    def words_of_line(line: str) -> tuple[list[str], list[str]]:
        body = plain(line)
        return body, body if line.isascii() and not _HUMP.search(line) else strict(line)

    for batch in batches:
        if pc.count_distinct(batch.column("part")).as_py() > 1 or part is not None and batch.num_rows and batch.column("part")[0].as_py() != part:
            raise ValueError("a task got units of several parts")
        for part, chunk, kind, role, text, name, path in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk_id", "kind", "role", "text", "indexed_name", "path"))):
            rows, held = rows + 1, held + (path is not None)
            if path is None:  # no length, no tokens
                continue
            name = name or ""
            body, again = words_of(text) if text else ([], [])
            same = body is again
            named, after = strict(name), plain(name)
            last = plain(path)
            length = len(body) + len(again) + len(named) + len(after) + len(last)
            if placed:
                found = defaultdict(list)
                for i, t in enumerate(chain(body, again, named, ("",), after, ("",), last)):
                    found[t].append(i)
                del found[""]
                count.extend(map(len, found.values()))
                spots.extend(chain.from_iterable(found.values()))
            else:
                found = Counter(body)
                if same:
                    for t in found:
                        found[t] *= 2
                else:
                    found.update(again)
                for t in chain(named, after, last):
                    found[t] += 1
                count.extend(found.values())
            of_term.extend(map(terms.__getitem__, found))
            of_chunk.append(chunks[chunk, kind, role, length])
            widths.append(len(found))
    if part is None:
        return
    schema = _schema(placed)
    total = sum(count)
    sums = [pa.array([None], pa.string()), pa.array([part], pa.int32()), *[pa.array([None], pa.string())] * 2, pa.array([[rows, held, total]], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays([*sums, *[pa.array([[]], pa.list_(pa.int32()))] * (len(schema) - 6), pa.array([total], pa.int64())], schema=schema)
    if not len(of_term):
        return
    words = list(terms)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    chunk_ids, kinds, roles, lengths = zip(*chunks)
    group = np.array([groups[x] for x in zip(kinds, roles)], np.int64)
    lengths = np.array(lengths, np.int64)
    owner = np.repeat(np.frombuffer(of_chunk, np.int32), np.frombuffer(widths, np.int32))
    sizes = np.frombuffer(count, np.int32).astype(np.int64)
    key = rank[np.frombuffer(of_term, np.int32)] * len(groups) + group[owner]
    order = np.lexsort((owner, key)) if len(chunks) < len(widths) else np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    if placed:
        start = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        begun = np.cumsum(sizes) - sizes
        flat = np.frombuffer(spots, np.int32).astype(np.int64)[np.repeat(start - begun, sizes) + np.arange(total)]
    else:
        sizes = sizes[order]
    if len(chunks) < len(widths):  # chunks that came more than once are counted together
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        if placed:
            posting = np.repeat(np.cumsum(np.isin(np.arange(len(key)), new)), sizes)
            flat = flat[np.lexsort((flat, posting))]
        key, owner, sizes = key[new], owner[new], np.add.reduceat(sizes, new)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    bounds = np.r_[starts, len(key)]
    first = key[starts]
    by_rank = np.empty(len(words), np.int64)
    by_rank[rank] = np.arange(len(words))
    pairs = list(groups)
    summed = np.add.reduceat(sizes, starts)
    columns = [
        pa.array(words, pa.string()).take(pa.array(by_rank[first // len(groups)])), pa.array(np.full(len(starts), part), pa.int32()),
        *(pa.array([p[i] for p in pairs], pa.string()).take(pa.array(first % len(groups))) for i in (0, 1)),
        _lists(pa.array(chunk_ids, pa.int64()).take(pa.array(owner)), bounds), _lists(pa.array(lengths[owner], pa.int32()), bounds),
    ]
    if placed:
        upto = np.cumsum(sizes)
        before = np.repeat(upto[starts] - sizes[starts], np.diff(bounds))
        columns += [_lists(pa.array(upto - before, pa.int32()), bounds), _lists(pa.array(_packed(flat, sizes, lengths[owner]), pa.int32()), np.r_[0, np.cumsum(summed)])]
    else:
        columns.append(_lists(pa.array(sizes, pa.int32()), bounds))
    whole = pa.RecordBatch.from_arrays([*columns, pa.array(summed, pa.int64())], schema=schema)
    for at in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(at, BATCH_ROWS)


def _schema(placed: bool) -> pa.Schema:
    ints = pa.list_(pa.int32())
    counted = {"ends": ints, "places": ints} if placed else {"counts": ints}
    return pa.schema({"term": pa.string(), "part": pa.int32(), "kind": pa.string(), "role": pa.string(), "chunks": pa.list_(pa.int64()), "lengths": ints} | counted | {"total": pa.int64()})


def turned(units: DataFrame, parts: int, placed: bool) -> DataFrame:
    """The rows of all parts (``COUNTED``, or ``PLACED``) of ``units``, which are dealt by file into ``parts``.

    Chunks with the same id, kind, role and length are counted together.
    """
    changed = folding(units.sparkSession)
    columns = units.select(part_of(F.col("file_id"), parts).alias("part"), "chunk_id", "kind", "role", "text", "indexed_name", "path")
    return columns.mapInArrow(lambda batches: _turned(batches, placed, changed), PLACED if placed else COUNTED)


def opened(rows: DataFrame) -> DataFrame:
    """One row per term and chunk: (bucket, term, part, chunk_id, kind, role, dl, tf), and the packed places as head and tail."""
    at = lambda c: F.get(F.col(c), F.col("i"))
    one = rows.filter("term is not null").select("*", F.posexplode("chunks").alias("i", "chunk_id"))
    if "counts" in rows.columns:
        return one.select("bucket", "term", "part", "chunk_id", "kind", "role", at("lengths").cast("long").alias("dl"), at("counts").cast("long").alias("tf"))
    begun = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    found = one.select("bucket", "term", "part", "chunk_id", "kind", "role", at("lengths").cast("long").alias("dl"), (at("ends") - begun).alias("n"), begun.alias("begun"), "places")
    half = F.ceil(F.col("n") / 2).cast("int")
    return found.select(
        "bucket", "term", "part", "chunk_id", "kind", "role", "dl", F.col("n").cast("long").alias("tf"),
        F.slice("places", F.col("begun") + 1, half).alias("head"), F.slice("places", F.col("begun") + half + 1, F.col("n") - half).alias("tail"))


def dictionary(rows: DataFrame) -> DataFrame:
    """``fulltext.dictionary`` of the postings in these rows."""
    return rows.filter("term is not null").groupBy("bucket", "term").agg(F.sum(F.size("chunks")).alias("df"))


def sums(rows: DataFrame) -> DataFrame:
    """(n, avgdl): chunks, and tokens per chunk that has a path, as ``fulltext.corpus_stats``."""
    own = rows.filter("term is null")
    n, held, total = (F.coalesce(F.sum(F.get("chunks", F.lit(i))), F.lit(0)) for i in range(3))
    return own.agg(n.cast("double").alias("n"), held.alias("held"), total.alias("total")).select(
        "n", F.when(F.col("held") > 0, F.col("total") / F.col("held")).cast("double").alias("avgdl"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array, and where each list begins and the last one ends."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(one).to_numpy(zero_copy_only=False)
    return one.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def bm25(n: float, avgdl: float, k1: float, b: float, least: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """``fulltext.weigh`` over arrays of ``df``, ``f`` and ``dl``; ``least`` is the least inverse frequency."""

    def part(df: np.ndarray, f: np.ndarray, dl: np.ndarray) -> np.ndarray:
        raw = np.log((n - df + 0.5) / (df + 0.5))
        idf = np.where(raw <= 0, least, raw)
        f, dl = f.astype(np.float64), dl.astype(np.float64)
        return -(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl)))

    return part


def allowed(request: dict, kind: str | None, role: str | None) -> bool:
    """``fulltext.hard_filter`` of one request."""
    return (
        (not request["kinds"] or kind in request["kinds"]) and (not request["roles"] or role in request["roles"])
        and (not request["exclude_support"] or role == "source")
    )


def searched(asked: list[dict], weigh: Callable, k: int | None, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What finds the best ``k`` chunks (all, if it is None) of each request in one part.

    A request has its number ``q``, phrases, kinds, roles, exclude_support, and ``scope``:
    "all"; "inside", if only the files listed for it count; "both", if those inside and
    outside of these are ranked by themselves.
    """
    schema = pa.schema({"q": pa.int32(), "inside": pa.bool_(), "chunk_id": pa.int64(), "rank": pa.float64()})

    def run(hits: pa.Table, files: pa.Table) -> pa.Table:
        if not hits.num_rows:
            return schema.empty_table()
        chunk, bounds = _flat(hits["chunks"])
        frequency, length = _flat(hits["counts"])[0], _flat(hits["lengths"])[0]
        weight = weigh(np.repeat(hits["df"].to_numpy(), np.diff(bounds)), frequency, length)
        ids, place = np.unique(chunk, return_inverse=True)
        lists = defaultdict(list)
        kinds, roles = hits["kind"].to_pylist(), hits["role"].to_pylist()
        for i, phrase in enumerate(hits["phrase"].to_pylist()):
            lists[phrase].append(i)
        seen = defaultdict(list)
        for q, file in zip(files["q"].to_pylist(), files["file_id"].to_pylist()):
            seen[q].append(file)
        out = []

        def keep(q: int, inside: bool | None, at: np.ndarray, sum_: np.ndarray) -> None:
            rank = np.round(sum_[at], digits)
            if k is not None and len(at) > k:
                near = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
                near = near[np.lexsort((at[near], rank[near]))[:k]]
                at, rank = at[near], rank[near]
            out.append((np.full(len(at), q), np.full(len(at), inside), ids[at], rank))

        for x in asked:
            mine = [i for p in x["phrases"] for i in lists.get(p, ()) if allowed(x, kinds[i], roles[i])]
            if not mine or x["scope"] == "inside" and x["q"] not in seen:
                continue
            sum_ = np.bincount(
                np.concatenate([place[bounds[i]:bounds[i + 1]] for i in mine]), np.concatenate([weight[bounds[i]:bounds[i + 1]] for i in mine]), len(ids))
            at = np.flatnonzero(sum_)
            if x["scope"] == "all":
                keep(x["q"], False, at, sum_)
                continue
            inside = np.isin(ids[at] >> ORDINAL_BITS, np.array(seen.get(x["q"], []), np.int64))
            keep(x["q"], True, at[inside], sum_)
            if x["scope"] == "both":
                keep(x["q"], False, at[~inside], sum_)
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


HITS = "part int, phrase string, kind string, role string, chunks array<long>, lengths array<int>, counts array<int>"
_STEP = 1 << 32


def _places(rows: pa.Table, bounds: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all postings, as they were before ``_packed``, and how many each posting has."""
    ends, packed = _flat(rows["ends"])[0].astype(np.int64), _flat(rows["places"])[0].astype(np.int64)
    sizes = np.diff(np.r_[0, ends])
    sizes[bounds[:-1]] = ends[bounds[:-1]]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    half = np.repeat((sizes + 1) // 2, sizes)
    at = np.arange(len(packed))
    late = at - first >= half
    out = packed.copy()
    out[late] += packed[at[late] - half[late]] + (np.repeat(length, sizes)[late] >> 1)
    return out, sizes


def phrased(phrases: list[str]) -> Callable[[pa.Table], pa.Table]:
    """What finds the chunks of one part that hold each phrase of several words, from the rows (``PLACED``) of their words."""
    ints = pa.list_(pa.int32())
    schema = pa.schema({"part": pa.int32(), "phrase": pa.string(), "kind": pa.string(), "role": pa.string(), "chunks": pa.list_(pa.int64()), "lengths": ints, "counts": ints})

    def run(rows: pa.Table) -> pa.Table:
        chunk, bounds = _flat(rows["chunks"])
        length = _flat(rows["lengths"])[0].astype(np.int64)
        place, sizes = _places(rows, bounds, length)
        codes = _Numbers()
        code = np.array([codes[x] for x in zip(rows["kind"].to_pylist(), rows["role"].to_pylist())], np.int64)
        # chunks are told apart by kind, role and length too, in the order of kind and role
        _, number = np.unique(chunk, return_inverse=True)
        whole = (np.repeat(code, np.diff(bounds)) * len(chunk) + number) * (int(length.max()) + 1) + length
        _, shown, owner = np.unique(whole, return_index=True, return_inverse=True)
        at = np.repeat(owner, sizes) * _STEP + place
        upto = np.r_[0, np.cumsum(sizes)][bounds]
        lists = defaultdict(list)
        for i, term in enumerate(rows["term"].to_pylist()):
            lists[term].append(at[upto[i]:upto[i + 1]])
        of_term = {term: np.unique(np.concatenate(x)) for term, x in lists.items()}
        row_code = np.repeat(code, np.diff(bounds))
        out, found = [], []
        for phrase in phrases:
            words = [of_term.get(w) for w in phrase.split(" ")]
            if any(w is None for w in words):
                continue
            least = min(range(len(words)), key=lambda i: len(words[i]))
            begun = words[least] - least
            for i, w in enumerate(words):
                if i != least:
                    near = np.searchsorted(w, begun + i)
                    begun = begun[(near < len(w)) & (w[np.minimum(near, len(w) - 1)] == begun + i)]
            chunks, counts = np.unique(begun // _STEP, return_counts=True)
            kinds = row_code[shown[chunks]]
            for k in np.unique(kinds):
                mine = kinds == k
                out.append((phrase, *list(codes)[k], int(mine.sum())))
                found.append((chunk[shown[chunks[mine]]], length[shown[chunks[mine]]], counts[mine]))
        if not out:
            return schema.empty_table()
        names, kinds, roles, many = zip(*out)
        starts = np.r_[0, np.cumsum(many)]
        lists = [_lists(pa.array(np.concatenate(x)).cast(t), starts) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32()))]
        part = pa.array(np.full(len(out), rows["part"][0].as_py()), pa.int32())
        return pa.table([part, pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(roles, pa.string()), *lists], schema=schema)

    return run
