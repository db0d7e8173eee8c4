"""Language identification by compression with per-language zstandard dictionaries.

A language's raw-content dictionary is sample text of that language.  Each text is cut into blocks, every block is
compressed with each dictionary, and the language with the smallest total wins; blocks keep the gain per byte the
same along a text of any length, where one long frame would soon become its own dictionary.  The margin is
``1 - smallest / second``; a text with a narrower margin than ``min_margin`` is rejected.

The classifier is fitted on a bounded sample: at most ``sample_rows`` labelled documents, an equal share for each
language (one at least) with the smallest hashes of id and text, and ``dictionary_bytes`` per language.  Prediction covers every whole text.

Defined cases.  Text is lower-cased and everything but letters becomes one space.  A null text or one without a letter
is ``und`` with score 0 and rejected.  Equal sizes go to the alphabetically first language with score 0.  With no
labelled rows every text is ``und``.  Extra columns pass through unless an output column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support

SAMPLE_ROWS = 4_000
DICTIONARY_BYTES = 1 << 16
BLOCK_CHARS = 4_096
LEVEL, MIN_MATCH = 12, 3
MIN_MARGIN = 0.005
OWN = ("lang_pred", "score", "rejected")


def letters_only(text: Column) -> Column:
    """Lower case, runs of anything but letters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES,
        doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample of rows with a label and text."""
    rows = labelled.select(support.col(doc_id).alias("id"), support.col(text).alias("text"),
                           support.col(lang).alias("lang")).filter("lang is not null and text is not null")
    sample = support.bounded_sample_of_each(rows, "lang", ["id", "text"], sample_rows)
    letters = F.substring(letters_only(F.col("text")), 1, dictionary_bytes)  # a dictionary holds no more
    pieces = sample.select("lang", "id", letters.alias("text")).filter("text <> ''").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64("id").alias("h"), "text"))).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for rows in batch.column("rows").to_pylist():
                each = max(256, dictionary_bytes // len(rows))
                content = b" ".join(r["text"].encode()[:each] for r in rows)
                if len(content) < dictionary_bytes:
                    content = b" ".join(r["text"].encode() for r in rows)
                contents.append(content[:dictionary_bytes])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(contents, pa.binary())],
                                             names=["lang", "content"])

    return {r["lang"]: bytes(r["content"]) for r in pieces.mapInArrow(build, "lang string, content binary").collect()}


class CompressionClassifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for language in self.languages:
            content = dictionaries[language]
            settings = zstandard.ZstdCompressionParameters.from_level(
                level, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False,
                source_size=BLOCK_CHARS, dict_size=len(content))
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=words, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        blocks = [text[at:at + BLOCK_CHARS].encode() for at in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and its margin over the second."""
        if not text or not self.languages:
            return "und", 0.0
        sizes = self.sizes(text)
        ranked = sorted(zip(sizes, self.languages))
        return ranked[0][1], (1.0 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN,
             text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x dictionary_bytes

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(shared.value)
        for batch in batches:
            found = [model.classify(t.as_py()) for t in batch.column("letters")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[0] == "und" or f[1] < min_margin for f in found], pa.bool_())],
                names=["row", *OWN])

    source = docs.select(support.packed(docs).alias("row"), letters_only(support.col(text)).alias("letters"))
    kind = source.schema["row"].dataType.simpleString()
    found = source.mapInArrow(classify, f"row {kind}, lang_pred string, score double, rejected boolean")
    return support.unpacked(found, "row", *OWN)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged.

    Without any labelled row outside the held-out part there is no classifier, and every document stays.
    """
    dictionaries = fit(docs.filter(~held_out(support.col(doc_id))), doc_id=doc_id, text=text, lang=lang)
    if not dictionaries:
        return docs
    kept = identify(docs, dictionaries, text=text).filter("not rejected")
    return kept.select(*[support.col(n) for n in docs.columns])
