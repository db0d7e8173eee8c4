"""License scans: exact phrases and fuzzy search for short notices.

Words are what lies between ASCII punctuation and control characters, lower-cased in A-Z, joined by one blank.  A
phrase is found where its words stand in a row.  A notice may differ by up to ``errors`` edits: it is split into
``errors + 1`` seeds, of which one must then occur exactly (pigeonhole); an automaton finds all seeds of all notices
in one pass, and only around a seed does bounded-error matching by the regex library verify the edits.

Hits carry the label, the span of words, the span of characters in the original text and the number of edits.

Defined cases.  A null or wordless text has no words, no hits and score 0; an empty table gives no rows; repeated rows
are scanned each by itself.  A text of any length is scanned whole, in time that grows with its length and its hits.
Hits of one notice do not overlap and are taken from left to right, each fitted with as few edits as it can be.  Extra
columns pass through unless an output column has their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskloom.llm import support
from riskloom.llm.textbytes import slices

# fixed values: phrases of the exact search
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: short notices in common use, by label
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0",
                   "distributed on an as is basis without warranties or conditions of any kind"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy",
            "released under the mit license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "gpl": ("this program is free software you can redistribute it and or modify",
            "under the terms of the gnu general public license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("licensed under a creative commons attribution license",),
    "proprietary": ("all rights reserved no part of this publication may be reproduced",),
}
WORDS_PER_ERROR = 3
FOLD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
HIT = "struct<label:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int,exact:boolean>"
OWN = ("n_words", "hits", "score")


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces that cover the notice, with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class LicenseScanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, ...]]):
        self.phrases = [(f" {p} ".encode(), label, p.count(" ") + 1) for p, label in phrases.items()]
        self.notices, pieces = [], {}
        for label, texts in notices.items():
            for notice in texts:
                errors = max(1, (notice.count(" ") + 1) // WORDS_PER_ERROR)
                number = len(self.notices)
                pattern = regex.compile(rf"(?<=^| )(?:{regex.escape(notice)}){{e<={errors}}}(?= |$)", regex.ENHANCEMATCH)
                self.notices.append((label, len(notice), errors, pattern))
                for offset, piece in seeds(notice, errors):
                    pieces.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def _windows(self, text: str, seeds_at: list, blanks: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By notice, merged stretches of the text that hold a seed and all its possible matches."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, owners) in seeds_at:
            for number, offset in owners:
                _, length, errors, _ = self.notices[number]
                begin = last + 1 - size - offset
                lo, after = max(0, begin - errors - 1), int(np.searchsorted(blanks, begin + length + errors))
                hi = int(blanks[after]) if after < len(blanks) else len(text)
                spans = found.setdefault(number, [])
                while spans and lo <= spans[-1][1]:  # a later seed may ask for an earlier start
                    lo, hi = min(lo, spans[-1][0]), max(hi, spans.pop()[1])
                spans.append((lo, hi))
        return found

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        """Number of words and all hits of one text."""
        folded = raw.translate(FOLD)
        words = folded.split()
        plain = b" " + b" ".join(words) + b" "
        hits, before = [], None
        for phrase, label, size in self.phrases:
            at = plain.find(phrase)
            while at >= 0:
                if before is None:
                    before = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                word = int(np.searchsorted(before, at))  # blanks before it
                hits.append((label, word, word + size - 1, 0, True))
                at = plain.find(phrase, at + 1)
        text = plain[1:-1].decode()
        seeds_at = list(self.automaton.iter(text)) if self.any else []
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) if seeds_at else before
        for number, spans in self._windows(text, seeds_at, blanks).items():
            label, _, errors, pattern = self.notices[number]
            for lo, hi in spans:
                at = lo
                while match := pattern.search(text, at, hi):
                    a, b = match.span()
                    if b <= a:
                        break
                    first = int(np.searchsorted(blanks, a))
                    hits.append((label, first, first + text[a:b].strip().count(" "), sum(match.fuzzy_counts), False))
                    at = b
        return len(words), self._placed(raw, folded, sorted(set(hits), key=lambda h: (h[1], h[2], h[0], not h[4])))

    @staticmethod
    def _placed(raw: bytes, folded: bytes, hits: list[tuple]) -> list[dict]:
        if not hits:
            return []
        spans = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
        codes = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
        return [{"label": label, "first_word": first, "last_word": last, "start": int(codes[spans[first][0]]) - 1,
                 "end": int(codes[spans[last][1] - 1]), "edits": edits, "exact": exact}
                for label, first, last, edits, exact in hits]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES,
                  text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``score``: 1 for an exact hit, less with each edit of the best, else 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, notices)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scanner.scan((t or "").encode()) for t in part.column("text").to_pylist()]
                scores = [max([1.0 / (1 + h["edits"]) for h in hits], default=0.0) for _, hits in found]
                kinds = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                   ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()),
                                   ("exact", pa.bool_())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), part.column("text"), pa.array([n for n, _ in found], pa.int64()),
                     pa.array([hits for _, hits in found], pa.list_(kinds)), pa.array(scores, pa.float64())],
                    names=["rest", "text", *OWN])

    source = docs.select(support.packed(docs, text).alias("rest"), support.col(text).alias("text"))
    kind = source.schema["rest"].dataType.simpleString()
    found = source.mapInArrow(run, f"rest {kind}, text string, n_words long, hits array<{HIT}>, score double")
    named = found.withColumnRenamed("text", text) if text != "text" else found
    return support.unpacked(named, "rest", text, *OWN)
