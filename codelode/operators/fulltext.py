"""Inverted index and BM25 ranking.

Postings carry the chunk length, the two filter columns most requests use (kind and
role) and the places of the term, so scoring reads one table. They are stored in
parts of some files each, with one row for the postings of a term, sorted by term (see ``inverted``), so building them moves no posting between tasks and a scan
for some terms skips the pages of others; a dictionary, in folders by term bucket, holds
each term's document frequency. A search ranks each part in one task, which gives its
best k chunks per request; the best of all use ``row_number() <= k``, which Spark trims
on each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import inverted
from codelode.session import cut_lineage

# The BM25 constants of the full-text ranking.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
RANK_DIGITS = 9

#: Layout: tokens for each term bucket, and for each salt of postings dealt by bucket.
BUCKET_TOKENS, SALT_TOKENS = 4_000_000, 16_000_000
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
#: Up to so many asked terms are pushed to the scan by name, beside their buckets.
PRUNE_TERMS = 10_000
#: Characters of indexed text for each part of the stored postings, which one task makes.
PART_CHARS = 4_000_000
#: Up to so many (request, phrase) rows are ranked by part; more are joined with the postings.
ASKED_ROWS = 200_000


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def unit_tokens(units: DataFrame) -> DataFrame:
    """One token array per chunk over its three indexed fields.

    An empty token separates the fields, so a phrase cannot run from one field
    into the next; it is not counted in the length.
    """
    gap = F.array(F.lit(""))
    body = tx.fts_tokens(tx.searchable_text(F.col("text"), F.coalesce("indexed_name", F.lit(""))))
    name = tx.fts_tokens(F.coalesce("indexed_name", F.lit("")))
    path = tx.fts_tokens(F.col("path"))
    return units.select(
        "chunk_id", "kind", "role", F.concat(body, gap, name, gap, path).alias("tokens")
    ).withColumn("dl", (F.size("tokens") - 2).cast("long"))


def _terms_of_row(tokens: DataFrame) -> DataFrame:
    """One row per term of each row: its count and places, found within the row by sorting its tokens."""
    keys = ["chunk_id", "kind", "role", "dl"]
    pairs = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: p["t"] != "")
    ordered = tokens.select(*keys, F.sort_array(pairs).alias("p"))  # columns of their own: a lambda would compute them anew
    new = lambda i: (i == 0) | (F.get(F.col("p"), i)["t"] != F.get(F.col("p"), i - 1)["t"])
    at = F.when(F.size("p") > 0, F.filter(F.sequence(F.lit(0), F.size("p") - 1), new)).otherwise(F.array().cast("array<int>"))
    starts = ordered.select(*keys, "p", at.alias("at"))
    held = lambda s, k: F.struct(
        F.get(F.col("p"), s)["t"].alias("term"),
        F.slice(F.col("p"), s + 1, F.coalesce(F.get(F.col("at"), k + 1), F.size("p")) - s)["i"].alias("places"))
    # outer: for the plain form Spark adds a filter that would compute the rows' terms a second time, within a lambda
    opened = starts.select(*keys, F.transform("at", held).alias("held")).select(*keys, F.explode_outer("held").alias("x"))
    return opened.filter("x is not null").select(
        "chunk_id", "x.term", "kind", "role", "dl", F.size("x.places").cast("long").alias("tf"), "x.places")


def postings(tokens: DataFrame, buckets: int = 16, salts: int | None = 1, repeated: bool = True) -> DataFrame:
    """(bucket, term, chunk_id, kind, role, dl, tf, places), one row per term and chunk.

    The terms of a chunk are counted where its tokens are, without a shuffle. With
    ``salts`` the counted rows are dealt by term bucket and, within a bucket, by a
    salt of the chunk, so neither a frequent term nor a long chunk ends up whole in
    one task; without, they stay where they are. Chunks whose id comes more than once
    are counted together; without ``repeated`` none does.
    """
    several = tokens.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id")
    if not repeated or several.isEmpty():
        counted = _terms_of_row(tokens)
    else:
        null = F.col("chunk_id").isNull()  # nulls are one chunk
        together = tokens.join(several, "chunk_id", "left_semi").unionByName(tokens.filter(null))
        merged = _terms_of_row(together).groupBy("chunk_id", "term", "kind", "role", "dl").agg(
            F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        counted = _terms_of_row(tokens.filter(~null).join(several, "chunk_id", "left_anti")).unionByName(merged)
    out = counted.withColumn("bucket", term_bucket(F.col("term"), buckets))
    if salts is not None:
        out = out.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")).repartition(buckets * salts, "bucket", "salt")
    return out.select("bucket", "term", "chunk_id", "kind", "role", "dl", "tf", "places")


def packed(posts: DataFrame) -> DataFrame:
    """Postings as they are stored: the first half of the places, and the others by what they are beyond their
    counterpart there plus half the length. A body holds its text twice, so those are small and alike."""
    half, place = F.ceil(F.size("places") / 2).cast("int"), F.col("places")
    beyond = F.transform(F.slice(place, half + 1, F.size(place) - half), lambda p, i: (p - F.get(place, i) - _half_length()).cast("int"))
    return posts.select("bucket", "term", "chunk_id", "kind", "role", "dl", F.slice(place, 1, half).alias("head"), beyond.alias("tail"))


def unpacked(stored: DataFrame) -> DataFrame:
    """``postings`` again from what ``packed`` made of them."""
    tail = F.transform("tail", lambda d, i: (F.get(F.col("head"), i) + _half_length() + d).cast("int"))
    part = [c for c in stored.columns if c == "part"]
    return stored.select(
        "bucket", "term", *part, "chunk_id", "kind", "role", "dl", (F.size("head") + F.size("tail")).cast("long").alias("tf"),
        F.concat("head", tail).alias("places"))


def _half_length() -> Column:
    return F.shiftright(F.col("dl"), 1)


def dictionary(posts: DataFrame) -> DataFrame:
    """(bucket, term, df): in how many chunks each term occurs."""
    return posts.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))


def layout(total: int) -> tuple[int, int]:
    """Term buckets, and salts in each, for an index of ``total`` tokens."""
    buckets = min(max(MIN_BUCKETS, -(-total // BUCKET_TOKENS)), MAX_BUCKETS)
    return buckets, max(1, -(-total // (buckets * SALT_TOKENS)))


def estimated_tokens(chars: int) -> int:
    """Tokens of so many characters of text, for the layout only: a body holds its text twice, six characters a word."""
    return chars // 3


def corpus_stats(tokens: DataFrame, buckets: int = 16) -> DataFrame:
    return tokens.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").cast("double").alias("avgdl"), F.lit(buckets).alias("buckets")
    )


def pruned(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``table`` (bucket, term, ...) without folders and pages that hold none of the ``asked`` terms.

    The driver gets bucket numbers, at most one per folder, and the terms
    themselves only if they are few; neither changes a result.
    """
    few = asked.select("bucket", "term").distinct().limit(PRUNE_TERMS + 1).collect()
    if len(few) <= PRUNE_TERMS:
        buckets = {r["bucket"] for r in few}
        return table.filter(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(sorted(r["term"] for r in few)))
    buckets = {r["bucket"] for r in asked.select("bucket").distinct().collect()}
    return table.filter(F.col("bucket").isin(sorted(buckets)))


def asked_terms(phrases: DataFrame, buckets: int) -> DataFrame:
    """(phrase, width, place, term, bucket): the words of each distinct phrase; ``phrases`` holds space-joined tokens."""
    split = phrases.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("words"))
    opened = split.select("phrase", F.size("words").alias("width"), F.posexplode("words").alias("place", "term"))
    return opened.withColumn("bucket", term_bucket(F.col("term"), buckets))


def phrase_places(posts: DataFrame, asked: DataFrame) -> DataFrame:
    """Occurrences of phrases of several words: places of their words, moved back by the word's place, that agree."""
    keys = [c for c in posts.columns if c == "part"] + ["chunk_id", "kind", "role", "dl"]
    rows = posts.join(asked, ["bucket", "term"]).select(
        "phrase", "width", *keys, F.transform("places", lambda p: p - F.col("place")).alias("starts"),
    )
    held = rows.groupBy("phrase", "width", *keys).agg(F.collect_list("starts").alias("all")).filter(
        F.size("all") == F.col("width"))
    starts = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
    return held.select("phrase", *keys, F.size(starts).cast("long").alias("f")).filter("f > 0")


def weights(postings: DataFrame, terms: DataFrame, stats: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, chunk_id, kind, role, dl, f, w) of every chunk that holds a phrase; ``w`` is its BM25 part, lower is better.

    One word needs one pruned scan of the postings: its document frequency is in
    the dictionary. Longer phrases intersect the places of their words.
    """
    kept = stats.select("n", "avgdl", "buckets").first()
    asked = cut_lineage(asked_terms(phrases, kept["buckets"]))
    single, longer = asked.filter("width = 1"), asked.filter("width > 1")
    known = pruned(terms, single).join(single, ["bucket", "term"])
    hits = pruned(postings, single).drop("places").join(known, ["bucket", "term"]).withColumnRenamed("tf", "f")
    found = hits.select("phrase", "chunk_id", "kind", "role", "dl", "f", "df")
    if not longer.isEmpty():
        many = cut_lineage(phrase_places(pruned(postings, longer), longer))
        found = found.unionByName(many.join(many.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")), "phrase"))
    return weigh(found, kept["n"], kept["avgdl"])


def weigh(hits: DataFrame, n: float, avgdl: float) -> DataFrame:
    """Add the BM25 part ``w`` of each hit from its ``df``, ``f`` and ``dl``."""
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(MIN_IDF)).otherwise(raw)
    f, dl = F.col("f").cast("double"), F.col("dl").cast("double")
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))
    return hits.withColumn("w", -part).drop("df")


def part_hits(index, phrases: DataFrame, stats, placed: DataFrame | None) -> DataFrame:
    """(part, phrase, kind, role, chunks, lengths, counts, df): the postings of each phrase by part.

    Single words take the stored rows as they are; the places of longer phrases' words, in ``placed``, are intersected.
    """
    asked = cut_lineage(asked_terms(phrases, stats["buckets"]))
    single, longer = asked.filter("width = 1"), asked.filter("width > 1")
    rows = index.count_rows
    counted = F.col("counts")
    if "ends" in rows.columns:
        counted = F.transform("ends", lambda e, i: e - F.coalesce(F.get("ends", i - 1), F.lit(0)))
    known = pruned(index.terms, single).join(single, ["bucket", "term"])
    found = pruned(rows, single).join(known, ["bucket", "term"]).select(
        "part", "phrase", "kind", "role", "chunks", "lengths", counted.alias("counts"), "df")
    if placed is not None:
        words = pruned(placed, longer).join(longer.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        run = inverted.phrased([r["phrase"] for r in longer.select("phrase").distinct().collect()])
        many = cut_lineage(words.select("part", "term", "kind", "role", "chunks", "lengths", "ends", "places").groupBy("part").applyInArrow(run, inverted.HITS))
        found = found.unionByName(many.join(many.groupBy("phrase").agg(F.sum(F.size("chunks")).alias("df")), "phrase"))
    return found.filter("kind is not null")


def best_by_part(index, asked: DataFrame, keys: list[str], k: int | None, files: DataFrame | None = None) -> DataFrame | None:
    """(keys, inside, chunk_id, rank): the best ``k`` matches of each request in every part of the index, at least.

    ``asked`` has the keys of a request, phrase, kinds, roles, exclude_support and scope
    (see ``inverted.searched``), ``files`` the keys and file_id of what a scope looks at.
    None if the index has no parts or more is asked than one task should hold.
    """
    if not hasattr(type(index), "count_rows"):
        return None
    held = asked.limit(ASKED_ROWS + 1).collect()
    if len(held) > ASKED_ROWS:
        return None
    spark, numbers, requests = asked.sparkSession, {}, []
    for r in held:
        q = numbers.setdefault(tuple(r[c] for c in keys), len(numbers))
        if q == len(requests):
            requests.append({"q": q, "phrases": []} | {c: r[c] for c in ("kinds", "roles", "exclude_support", "scope")})
        requests[q]["phrases"].append(r["phrase"])
    schema = ", ".join(["q int", *(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in keys)])
    named = spark.createDataFrame([(q, *key) for key, q in numbers.items()], schema)
    several = any(" " in r["phrase"] for r in held)
    placed = index.placed_rows if several else None  # before the others are asked for: it serves them too
    stats = index.stats.first()
    hits = part_hits(index, asked, stats, placed)
    run = inverted.searched(requests, inverted.bm25(stats["n"], stats["avgdl"], K1, B, MIN_IDF), k, RANK_DIGITS)
    seen = spark.createDataFrame([], "part int, q int, file_id long") if files is None else (
        files.join(named, keys).select(inverted.part_of(F.col("file_id"), stats["parts"]).alias("part"), "q", "file_id"))
    ranked = hits.groupBy("part").cogroup(seen.groupBy("part")).applyInArrow(run, "q int, inside boolean, chunk_id long, rank double")
    return ranked.join(F.broadcast(named), "q").select(*keys, "inside", "chunk_id", F.round("rank", RANK_DIGITS).alias("rank"))


def rank_requests(weights: DataFrame, requests: DataFrame) -> DataFrame:
    """Sum the parts per (query, chunk).

    ``requests`` has query_id, phrase and optionally kinds, roles and
    exclude_support; those hard filters apply before any cut by rank.
    """
    joined = weights.filter("kind is not null").join(requests, "phrase")
    if "kinds" in requests.columns:
        joined = joined.filter(hard_filter(F.col("kind"), F.col("role")))
    return joined.groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), RANK_DIGITS).alias("rank"))


def hard_filter(kind: Column, role: Column) -> Column:
    """Kind, role and support-code conditions carried by a request."""

    def listed(values: str, actual: Column) -> Column:
        c = F.col(values)
        return c.isNull() | (F.size(c) == 0) | F.array_contains(c, actual)

    return (
        listed("kinds", kind)
        & listed("roles", role)
        & (~F.coalesce("exclude_support", F.lit(False)) | (role == "source"))
    )


def best(ranked: DataFrame, keys: list[str], order: list[Column], k) -> DataFrame:
    """The first ``k`` rows per key (all, if it is None) with their 1-based position."""
    window = W.partitionBy(*keys).orderBy(*order)
    numbered = ranked.withColumn("position", F.row_number().over(window))
    return numbered if k is None else numbered.filter(F.col("position") <= k)


def question_phrases(queries: DataFrame, question: str = "question") -> DataFrame:
    """One row per request and search word: tokens and their stems."""
    return queries.select("query_id", F.explode(tx.ranked_tokens(F.col(question))).alias("phrase"))


def raw_phrases(queries: DataFrame, text: Column) -> DataFrame:
    """Whitespace terms of two characters or more, each searched as a phrase."""
    terms = F.filter(F.split(text, r"\s+"), lambda t: F.length(t) >= 2)
    return (
        queries.select("query_id", F.explode(terms).alias("term"))
        .select("query_id", F.array_join(tx.fts_tokens(F.col("term")), " ").alias("phrase"))
        .filter("phrase != ''")
        .distinct()
    )
