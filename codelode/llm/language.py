"""Language identification by compression.

Each language has a dictionary of raw text. Texts and dictionaries are reduced to
lower-case letters with single spaces between them. A text is cut into blocks of
``BLOCK`` bytes; every block, behind a constant pad that makes the compressor
spend its fixed costs, is compressed once with each dictionary, and the language
with the smallest sum wins. The answer is rejected if the runner-up costs less
than ``margin`` more for each byte, or the same.

Dictionaries come from a sample of labelled rows, the only bounded part: up to
``dictionary_bytes`` of whole texts for each of at most ``languages`` languages
(the most frequent labels), drawn by a hash of the id from texts of at most
``sample_chars`` characters. All other rows are only counted for it.

Edge cases: a null text or a text without a letter is ``und`` with score 0 and
rejected. If nothing was learned everything is ``und``. Equal sums go to the more
frequent label and are rejected. A null id counts as the empty text for the fold.
Repeated rows, empty tables and other columns are no matter.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import map_batches

DICTIONARY_BYTES, LANGUAGES, SAMPLE_CHARS = 128 << 10, 200, 20_000
BLOCK, LEVEL, MARGIN = 2048, 6, 0.002
#: Texts under so many bytes are compressed harder.
SHORT, SHORT_LEVEL = 1024, 12
PAD = bytes(64)
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    return (" " + OTHER.sub(" ", text.lower()).strip() + " ").encode()


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(
    labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, languages: int = LANGUAGES, sample_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """language -> dictionary, from rows (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and length(text) between 1 and %d" % sample_chars)
    size = F.octet_length("text").cast("long")
    stats = rows.groupBy("lang").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    stats = stats.orderBy(F.desc("n"), "lang").limit(languages).collect()
    share = {r.lang: min(1.0, 2 * dictionary_bytes / r.bytes + 4 * sample_chars / r.bytes) for r in stats}
    if not share:
        return {}
    wanted = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("draw", draw).where(F.col("draw") < wanted[F.col("lang")])
    # bounded for each language by itself, so that none competes with another; only ids that repeat reach the bound
    earlier = Window.partitionBy("lang").orderBy("draw", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("lang", "text", "draw", "doc_id", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("before"))
    rows = rows.where(F.col("before") < 4 * (2 * dictionary_bytes + 4 * sample_chars))
    texts: dict[str, list[bytes]] = {lang: [] for lang in share}
    taken = dict.fromkeys(share, 0)
    for row in rows.orderBy("draw", "doc_id", "text").toLocalIterator():
        if taken[row.lang] < dictionary_bytes:
            data = letters(row.text)
            texts[row.lang].append(data)
            taken[row.lang] += len(data)
    return {lang: b"".join(parts)[:dictionary_bytes] for lang, parts in texts.items() if parts}


class Classifier:
    """``dictionaries`` in order of preference between equal sums."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, margin: float = MARGIN):
        self.names, self.block, self.margin = list(dictionaries), block, margin
        self.compressors = {
            level: [self._compressor(data, level) for data in dictionaries.values()] for level in (LEVEL, SHORT_LEVEL)
        }

    @staticmethod
    def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
        # tables sized for a block behind a dictionary, not for the level's default window
        params = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=BLOCK + len(PAD), dict_size=len(data), write_content_size=False, write_dict_id=False
        )
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=own)

    def classify(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, what the runner-up costs more for each byte, rejected."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, None, True
        data = letters(text)
        blocks = [PAD + data[i:i + self.block] for i in range(0, len(data), self.block)]
        tools = self.compressors[SHORT_LEVEL if len(data) < SHORT else LEVEL]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in tools]
        low = min(sizes)
        score = 1 / sum(math.exp(-min(50.0, (s - low) * math.log(2))) for s in sizes)
        if len(sizes) == 1:
            return self.names[0], score, None, False
        gap = (sorted(sizes)[1] - low) / len(data)
        return self.names[sizes.index(low)], score, gap, gap <= 0 or gap < self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    added = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
    kept = [c for c in docs.columns if c not in added]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} {t}" for c, t in added.items())])

    def make():
        classifier = Classifier(shared.value)

        def work(batch: pa.RecordBatch):
            found = [classifier.classify(text.as_py()) for text in batch.column(text_col)]
            new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *added])

        return work

    return map_batches(docs.select(*kept), schema, make)
