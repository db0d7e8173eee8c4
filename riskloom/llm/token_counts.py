"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole.  Every token has a span of characters (from the bytes it stands for; a token
that begins or ends inside a character covers that character), and the spans are joined to the sections' intervals
by merging two sorted lists inside the task.  A token that crosses a section boundary is allocated by a rule:
``first`` or ``last`` section it touches, ``majority`` (most characters, the earlier on ties) or ``fraction``
(in proportion to its characters).

Sections are intervals of characters, sorted and disjoint: lines by default, or a column of
``array<struct<name, start, end>>``; ``fields_as_sections`` builds text and column from several fields.  Tokens that
touch no section are left out of the sections and counted in ``n_outside``.

Defined cases.  A null or empty text has one empty line section without tokens.  Null or empty section lists give no
rows.  Rows with equal ids are reported one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.byte_bpe import VOCABULARY, coder_of, shared_coder
from riskloom.llm.textbytes import slices

RULES = ("first", "last", "majority", "fraction")
ROW = "doc_id long, section int, name string, start long, end long, n_tokens double, n_crossing long, n_outside long"


def line_spans(text: str) -> list[tuple[int, int]]:
    """Lines with their line ends."""
    spans, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        spans.append((at, end))
        at = end
    return spans or [(0, 0)]


def token_spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that have ``sizes`` bytes each."""
    stop = np.cumsum(sizes)
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return character[stop - sizes] - 1, character[stop - 1]


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str):
    """``(tokens per section, crossing tokens per section, tokens outside)``; sections are rows (start, end)."""
    low = np.searchsorted(sections[:, 1], start, side="right")
    high = np.searchsorted(sections[:, 0], end, side="left") - 1
    outside = low > high
    crossing = np.flatnonzero(low < high)
    inside = low == high
    counts = np.bincount(low[inside], minlength=len(sections)).astype(np.float64)
    touched = np.zeros(len(sections), np.int64)
    for token in crossing.tolist():
        a, b = int(low[token]), int(high[token])
        overlap = (np.minimum(sections[a:b + 1, 1], end[token]) - np.maximum(sections[a:b + 1, 0], start[token]))
        touched[a:b + 1] += 1
        if rule == "fraction":
            counts[a:b + 1] += overlap / overlap.sum()
        else:
            counts[a if rule == "first" else b if rule == "last" else a + int(overlap.argmax())] += 1
    return counts, touched, int(outside.sum())


def count_by_section(docs: DataFrame, rule: str = "majority", sections: str | None = None,
                     vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and section with its tokens and how many of the tokens it touches cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = shared_coder(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        width = np.array([len(t) for t in coder.tokens], np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                given = part.column("sections").to_pylist() if sections else [None] * len(texts)
                columns: list[list] = [[] for _ in range(8)]
                for name, content, packed, spans in zip(part.column("id").to_pylist(), texts,
                                                        coder.encode_batch(texts), given):
                    if sections:
                        names = [s["name"] for s in spans or ()]
                        bounds = np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
                    else:
                        bounds = np.array(line_spans(content), np.int64)
                        names = [None] * len(bounds)
                    if not len(bounds):
                        continue
                    ids = np.frombuffer(packed, "<u4")
                    if len(ids):
                        counts, crossing, outside = allocate(*token_spans(content.encode(), width[ids]), bounds, rule)
                    else:
                        counts, crossing, outside = np.zeros(len(bounds)), np.zeros(len(bounds), np.int64), 0
                    for column, values in zip(columns, (
                            [name] * len(bounds), range(len(bounds)), names, bounds[:, 0].tolist(),
                            bounds[:, 1].tolist(), counts.tolist(), crossing.tolist(), [outside] * len(bounds))):
                        column.extend(values)
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(),
                         pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "n_outside"])

    source = docs.select(support.col(doc_id).cast("long").alias("id"), support.col(text).alias("text"),
                         *([support.col(sections).alias("sections")] if sections else []))
    return source.mapInArrow(run, ROW.replace(" end ", " `end` "))


def fields_as_sections(df: DataFrame, fields: list[str], separator: str = "\n", text: str = "text",
                       sections: str = "sections") -> DataFrame:
    """Fields joined into one text, with their intervals; a null field is empty."""
    parts = [F.coalesce(support.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for name, part in zip(fields, parts):
        end = at + F.length(part)
        spans.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return df.select(*support.others(df, text, sections), F.concat_ws(separator, *parts).alias(text),
                     F.array(*spans).alias(sections))
