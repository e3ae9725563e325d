"""Index relations: binding, cross-file resolution, storage, metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions.classify import ROLES
from codelode.operators import fulltext as ft
from codelode.operators import inverted
from codelode.session import cut_lineage, dropping_shuffles

SCHEMA_VERSION = 1


@dataclass
class Relations:
    """The relational part of an index. ``linked`` are the edges, or what makes them when they are first asked for.

    ``searchable`` makes ``units`` without a join, dealt into so many parts (None: as they
    are), for a source whose file ids do not repeat; it gives None if they do. ``chars``
    tells about how many characters of text those units have.
    """

    files: DataFrame
    symbols: DataFrame
    chunks: DataFrame
    linked: DataFrame | Callable[[], DataFrame]
    searchable: Callable[[int | None], DataFrame | None] | None = None
    chars: Callable[[], int] | None = None

    @property
    def edges(self) -> DataFrame:
        if callable(self.linked):
            self.linked = self.linked()
        return self.linked

    def units(self) -> DataFrame:
        """Searchable rows: chunk, its symbol and its file side by side."""
        s = self.symbols.select(
            "symbol_id", "name", "qualified_name", "kind",
            F.col("start_line").alias("symbol_start"), F.col("end_line").alias("symbol_end"),
        )
        return (
            self.chunks.select(
                "chunk_id", "file_id", "symbol_id", F.col("symbol_name").alias("indexed_name"), "text"
            )
            .join(s, "symbol_id", "left")
            .join(self.files.select("file_id", "path", "role", "language"), "file_id")
        )


@dataclass
class Index:
    """A stored index; every attribute is a lazily read table. ``placed_rows`` are the postings as they are stored."""

    files: DataFrame
    symbols: DataFrame
    chunks: DataFrame
    edges: DataFrame
    units: DataFrame
    placed_rows: DataFrame
    terms: DataFrame
    stats: DataFrame
    metadata: DataFrame

    @property
    def count_rows(self) -> DataFrame:
        return self.placed_rows

    @property
    def postings(self) -> DataFrame:
        return ft.unpacked(inverted.opened(self.placed_rows)).drop("part")

    @property
    def counts(self) -> DataFrame:
        """The postings for searches for single words."""
        return inverted.opened(self.placed_rows).drop("head", "tail", "part")


#: The tables of an index, and the folders they lie in.
TABLES = {name: name.replace("placed_rows", "postings") for name in Index.__dataclass_fields__}


def last_wins(symbols: DataFrame) -> DataFrame:
    """The symbol a qualified name binds to inside its file: the last one."""
    return symbols.groupBy("file_id", "qualified_name").agg(F.max("symbol_id").alias("bound_id"))


def resolve_parents(symbols: DataFrame) -> DataFrame:
    """Bind parent_name to the parent's id within the file."""
    bound = last_wins(symbols).select(
        "file_id", F.col("qualified_name").alias("parent_name"), F.col("bound_id").alias("parent_symbol_id")
    )
    return symbols.drop("parent_symbol_id").join(bound, ["file_id", "parent_name"], "left").drop("parent_name")


def bind_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    bound = last_wins(symbols).select(
        "file_id", F.col("qualified_name").alias("symbol_name"), F.col("bound_id").alias("symbol_id")
    )
    return chunks.join(bound, ["file_id", "symbol_name"], "left")


def bind_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bind both ends of in-file edges; unknown names stay null."""
    bound = last_wins(symbols)
    source = bound.select(
        "file_id", F.col("qualified_name").alias("source_name"), F.col("bound_id").alias("source_symbol_id")
    )
    target = bound.select(
        "file_id", F.col("qualified_name").alias("target_name"), F.col("bound_id").alias("target_symbol_id")
    )
    return edges.join(source, ["file_id", "source_name"], "left").join(
        target, ["file_id", "target_name"], "left"
    )


def resolve_conformance(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Point open conformance edges at the lowest id of that qualified name, else name."""
    qualified = symbols.groupBy(F.col("qualified_name").alias("target_name")).agg(
        F.min("symbol_id").alias("by_qualified")
    )
    named = symbols.groupBy(F.col("name").alias("target_name")).agg(F.min("symbol_id").alias("by_name"))
    edges = cut_lineage(edges)  # read by both branches
    is_open = (F.col("kind") == "symbol_conforms_to") & F.col("target_symbol_id").isNull()
    found = (
        edges.filter(is_open).join(qualified, "target_name", "left").join(named, "target_name", "left")
        .withColumn("target_symbol_id", F.coalesce("by_qualified", "by_name"))
        .drop("by_qualified", "by_name")
    )
    rest = edges.filter(~is_open)
    return rest.unionByName(found)


def implementation_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Methods that implement a same-named member of the type their type conforms to."""
    conform = edges.filter("kind = 'symbol_conforms_to' and target_symbol_id is not null and source_symbol_id is not null")
    classes = symbols.filter("kind = 'class'").select("symbol_id")
    members = symbols.filter("kind in ('function', 'method') and parent_symbol_id is not null")
    required = members.select(
        F.col("parent_symbol_id").alias("target_symbol_id"), "name", F.col("kind").alias("member_kind"),
        F.col("symbol_id").alias("required_id"), F.col("qualified_name").alias("required_name"),
    )
    given = members.select(
        F.col("parent_symbol_id").alias("source_symbol_id"), "name", F.col("kind").alias("member_kind"),
        F.col("symbol_id").alias("given_id"),
    )
    pairs = (
        conform.select("source_symbol_id", "target_symbol_id")
        .join(classes.withColumnRenamed("symbol_id", "source_symbol_id"), "source_symbol_id", "left_semi")
        .join(classes.withColumnRenamed("symbol_id", "target_symbol_id"), "target_symbol_id", "left_semi")
        .join(required, "target_symbol_id")
        .join(given, ["source_symbol_id", "name", "member_kind"])
        .select(
            F.col("given_id").alias("source_symbol_id"),
            F.col("required_id").alias("target_symbol_id"),
            F.col("required_name").alias("target_name"),
        )
    )
    existing = conform.select("source_symbol_id", "target_symbol_id")
    return pairs.join(existing, ["source_symbol_id", "target_symbol_id"], "left_anti").select(
        "source_symbol_id", "target_symbol_id", "target_name",
        F.lit("symbol_conforms_to").alias("kind"), F.lit("name").alias("confidence"),
    )


def role_counts(files: DataFrame) -> DataFrame:
    """Files per role, zero for roles without files."""
    roles = files.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    return roles.join(files.groupBy("role").agg(F.count(F.lit(1)).alias("n")), "role", "left").select(
        "role", F.coalesce("n", F.lit(0)).cast("long").alias("files")
    )


def relation_counts(rel: Relations) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("relation", F.lit(name))
        for name, df in (
            ("files", rel.files), ("symbols", rel.symbols), ("chunks", rel.chunks), ("edges", rel.edges)
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("relation", "row_count")


def metadata_rows(files: DataFrame, root: str, mode: str, created_at: str) -> DataFrame:
    """Key/value description of an index."""
    counts = role_counts(files).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "files")))).alias("m")
    )
    return counts.select(
        F.explode(
            F.create_map(
                F.lit("schema_version"), F.lit(str(SCHEMA_VERSION)),
                F.lit("root"), F.lit(root),
                F.lit("created_at"), F.lit(created_at),
                F.lit("index_mode"), F.lit(mode),
                F.lit("role_counts"), F.to_json("m"),
            )
        ).alias("key", "value")
    )


def index_warnings(metadata: DataFrame | None, target: str, roles: list[str], needs_tests: bool = False) -> list[dict]:
    """Reasons why answers from this index may be incomplete; reads the few metadata rows."""
    import json

    if metadata is None:
        return [{"code": "legacy-index-metadata",
                 "message": "index metadata is missing; rebuild the index to enable root, mode, and role checks"}]
    kv = {r["key"]: r["value"] for r in metadata.collect()}
    found = []
    if kv.get("root") != target:
        found.append(("target-mismatch", f"index target mismatch: index was built for {kv.get('root')}, but query target is {target}"))
    if (needs_tests or "test" in roles) and kv.get("index_mode") == "source-only":
        found.append(("source-only-index", "source-only index: test files were skipped; rebuild without --source-only before asking for tests"))
    counts = json.loads(kv.get("role_counts") or "{}")
    for role in dict.fromkeys([*roles, *(["test"] if needs_tests else [])]):
        if not counts.get(role):
            found.append(("missing-role", f"index has no {role}-role files; {role} queries may be incomplete"))
    return [{"code": code, "message": message} for code, message in dict.fromkeys(found)]


class Stored:
    """An index whose tables are written, as Parquet, when they are first read.

    It has the attributes of ``Index``. ``done`` holds the names of the tables written
    so far and may be shared by several of them. ``buckets`` is the number of term
    buckets, which order the postings and are the folders of the dictionary; by default
    it grows with the number of tokens. Postings stay with their files: parts of
    ``fulltext.PART_CHARS`` characters each are turned round where they are, sorted by
    term, and no posting is shuffled (see ``inverted``). With ``salts`` their rows are dealt
    by bucket and salt instead, and lie in folders by bucket. Token arrays are not stored,
    ``fulltext.unit_tokens`` gives them for the units a reader needs. Postings without places
    have a table of their own, ``counts``, unless those with places are written before.
    Without ``lasting`` the dictionary is not written: the terms asked for are counted in
    the postings.
    """

    def __init__(
        self, rel: Relations, path: str, root: str, mode: str = "all-files", created_at: str = "",
        buckets: int | None = None, salts: int | None = None, done: set[str] | None = None, lasting: bool = True,
    ):
        self._rel, self._path, self._about = rel, path, (root, mode, created_at)
        self._buckets, self._salts, self._done, self._lasting = buckets, salts, set() if done is None else done, lasting

    def _stored(self, name: str, make: Callable[[], DataFrame], *parts: str) -> DataFrame:
        where, spark = f"{self._path}/{name}", self._rel.files.sparkSession
        if name not in self._done:
            table = make()
            with dropping_shuffles(spark):
                table.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet(where)
            self._done.add(name)
        return spark.read.parquet(where)

    @cached_property
    def files(self) -> DataFrame:
        return self._stored("files", lambda: self._rel.files)

    @cached_property
    def symbols(self) -> DataFrame:
        return self._stored("symbols", lambda: self._rel.symbols)

    @cached_property
    def chunks(self) -> DataFrame:
        return self._stored("chunks", lambda: self._rel.chunks)

    @cached_property
    def edges(self) -> DataFrame:
        return self._stored("edges", lambda: self._rel.edges)

    @cached_property
    def _plain_units(self) -> DataFrame | None:
        return self._rel.searchable(None) if self._rel.searchable else None

    @cached_property
    def units(self) -> DataFrame:
        def make() -> DataFrame:
            plain = self._plain_units
            return Relations(self.files, self.symbols, self.chunks, self._rel.linked).units() if plain is None else plain

        return self._stored("units", make)

    @cached_property
    def _layout(self) -> tuple[int, int]:
        """Parts of the postings, and term buckets."""
        if self._plain_units is not None and self._rel.chars:
            chars = self._rel.chars()
        else:
            chars = self.units.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
        return max(1, -(-chars // ft.PART_CHARS)), self._buckets or ft.layout(ft.estimated_tokens(chars))[0]

    def _turned(self, name: str, placed: bool) -> DataFrame:
        def make() -> DataFrame:
            parts, buckets = self._layout
            dealt = None if self._plain_units is None else self._rel.searchable(parts)
            rows = inverted.turned(self.units.repartition(parts, "file_id") if dealt is None else dealt, parts, placed)
            rows = rows.withColumn("bucket", ft.term_bucket(F.col("term"), buckets))
            if self._salts is not None:
                salt = F.pmod("part", F.lit(self._salts)).alias("salt")
                rows = rows.select("*", salt).repartition(buckets * self._salts, "bucket", "salt").drop("salt")
                return rows.sortWithinPartitions("bucket", "term", "kind", "role")
            return rows  # each part comes sorted by term

        return self._stored(name, make, *(["bucket"] if self._salts else []))

    @cached_property
    def placed_rows(self) -> DataFrame:
        return self._turned("postings", True)

    @property
    def count_rows(self) -> DataFrame:
        return self.placed_rows if "postings" in self._done else self._turned("counts", False)

    @cached_property
    def postings(self) -> DataFrame:
        return ft.unpacked(inverted.opened(self.placed_rows)).drop("part")

    @property
    def counts(self) -> DataFrame:
        return inverted.opened(self.count_rows).drop("head", "tail", "part")

    @property
    def terms(self) -> DataFrame:
        counted = inverted.dictionary(self.count_rows)
        if not self._lasting:
            return counted
        return self._stored("terms", lambda: counted.repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket")

    @cached_property
    def stats(self) -> DataFrame:
        parts, buckets = self._layout
        return self._stored("stats", lambda: inverted.sums(self.count_rows).select(
            "*", F.lit(buckets).alias("buckets"), F.lit(parts).alias("parts")))

    @cached_property
    def metadata(self) -> DataFrame:
        return self._stored("metadata", lambda: metadata_rows(self.files, *self._about))


def write_index(
    rel: Relations, path: str, root: str, mode: str = "all-files", created_at: str = "",
    buckets: int | None = None, salts: int | None = None,
) -> None:
    """Store all relations, the search rows and the inverted index as Parquet (see ``Stored``)."""
    stored = Stored(rel, path, root, mode, created_at, buckets, salts)
    for name in TABLES:
        getattr(stored, name)


def open_index(spark: SparkSession, path: str) -> Index:
    try:
        return Index(**{name: spark.read.parquet(f"{path}/{folder}") for name, folder in TABLES.items()})
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no complete index at {path}; build it with the index command first") from error
        raise


def file_ordinals(files: DataFrame) -> DataFrame:
    """Number files by path without one global sort.

    Paths are range-partitioned; the count per partition (a table as small as
    the number of partitions) gives each partition its offset.
    """
    ranged = files.repartitionByRange("path").sortWithinPartitions("path")
    # monotonically_increasing_id counts rows within a sorted partition from the partition's base
    local = ranged.withColumn("pid", F.spark_partition_id()).withColumn(
        "local", F.monotonically_increasing_id() - F.shiftleft(F.col("pid").cast("long"), 33)
    )
    fixed = cut_lineage(local)
    sizes = fixed.groupBy("pid").agg(F.count(F.lit(1)).alias("rows"))
    offsets = sizes.select(
        "pid",
        (F.sum("rows").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("offset"),
    )
    return fixed.join(offsets, "pid").withColumn("file_id", F.col("offset") + F.col("local")).drop("pid", "local", "offset")
