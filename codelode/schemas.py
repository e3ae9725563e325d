"""Schemas of the relations and requests the library exchanges."""

from __future__ import annotations

from dataclasses import dataclass

FILES = "file_id long, path string, hash string, language string, role string"
SYMBOLS = (
    "symbol_id long, file_id long, name string, qualified_name string, kind string, "
    "start_line int, end_line int, parent_symbol_id long"
)
CHUNKS = (
    "chunk_id long, file_id long, symbol_id long, symbol_name string, "
    "start_line int, end_line int, text string"
)
EDGES = (
    "edge_id long, source_symbol_id long, target_symbol_id long, "
    "target_name string, kind string, confidence string"
)
QUERIES = (
    "query_id long, terms array<string>, kinds array<string>, roles array<string>, "
    "exclude_support boolean, path_hints array<string>, path_mode string, "
    "expand array<string>, limit int"
)

KINDS = ("module", "class", "function", "method", "typealias")
EXPANSIONS = ("contains", "imports", "calls", "called_by", "conforms")
MODES = ("symbol", "fts", "hybrid")

# Ids are ordered like the rows they name: the file number in the high bits,
# the position within the file in the low ones. Sorting by id therefore sorts
# by path and then by extraction order, without one global sort of the rows.
ORDINAL_BITS = 24
ORDINAL_SPAN = 1 << ORDINAL_BITS


@dataclass(frozen=True)
class Limits:
    """How many rows each source may contribute to one request; ``None`` is no cut.

    Every cut comes after the request's hard filters. The defaults are the fixed
    values of the ranking; the SQL equivalents take the same ones.
    """

    fts: int | None = 25
    fts_tests: int | None = 100
    exact_terms: int | None = 12
    exact: int | None = 40
    path_hints: int | None = 30
    pool_words: int | None = 8
    pool_word_rows: int | None = 80
    pool_seeds: int | None = 12
    pool_seed_rows: int | None = 120
    pool: int | None = 300
    intents: int | None = 12
    cluster_rows: int | None = 250
    cluster_path_rows: int | None = 1000
    cluster_hint_rows: int | None = 160
    cluster_terms: int | None = 10
    cluster_term_rows: int | None = 80
    cluster_symbols: int | None = 12


DEFAULT_LIMITS = Limits()
