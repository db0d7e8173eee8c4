"""Quality rules as a short-circuit cascade.

Every rule has a measure and a rejection test.  On a bounded sample each rule's cost (seconds of its measure) and
selectivity (share rejected) are estimated; rules run in descending order of rejection per cost, and the first that
rejects a text ends its cascade.  Measures are computed when first asked for and shared by rules.  The order changes
the cost only: a text is kept when no rule rejects it.

The base measures of the report (words, characters in words, symbols, repeated lines, words in repeated three-word
windows) are always computed.

Defined cases.  A null text has no words and fails; so does any text below ``min_words`` words.  Measures cover whole
texts.  Extra columns pass through unless an output column has their name.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.textbytes import SPACES, WordHasher, joined

SAMPLE_ROWS = 2_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = re.compile(rb"[#*$%&|<>]")
OWN = (*BASE, "base_failed", "kept")


class Measures:
    """Measures of one text, each computed at most once."""

    def __init__(self, raw: bytes, hasher: WordHasher):
        self.raw, self.hasher = raw, hasher

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        data = np.frombuffer(self.raw, np.uint8)
        return int((self.hasher.inside[data] & ((data & 0xC0) != 0x80)).sum())

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.raw))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < 3:
            return 0
        words, _, _, _ = self.hasher.words(*joined([self.raw]))
        _, which, counts = np.unique(self.hasher.runs(words, 3), return_inverse=True, return_counts=True)
        again = np.zeros(self.n_words, bool)
        repeated = counts[which] > 1
        for shift in range(3):
            again[shift:shift + len(repeated)] |= repeated
        return int(again.sum())

    @cached_property
    def n_shouted(self) -> int:
        return sum(word.isupper() and len(word) > 1 for word in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def production_rules(min_words: int = 50) -> list[Rule]:
    """Rules by name; thresholds are shares of words or lines."""
    return [
        Rule("too_few_words", lambda m: m.n_words < min_words),
        Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
        Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
        Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
        Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 12 * m.n_words),
        Rule("shouting", lambda m: 2 * m.n_shouted > m.n_words),
    ]


def rule_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id",
               text: str = "text") -> list[str]:
    """Rule names by rejection per second, estimated on ``sample_rows`` rows; each rule is timed on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES)
        cost, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for value in batch.column("text").to_pylist():
                raw = (value or "").encode()
                seen += 1
                for number, rule in enumerate(rules):
                    start = time.perf_counter()
                    rejected[number] += rule.rejects(Measures(raw, hasher))
                    cost[number] += time.perf_counter() - start
        if seen:
            yield pa.RecordBatch.from_pydict({"name": [r.name for r in rules], "cost": cost, "rejected": rejected})

    rows = docs.select(support.col(doc_id).alias("id"), support.col(text).alias("text"))
    sample = support.bounded_sample(rows, F.col("id"), sample_rows).select("text")
    stats = sample.mapInArrow(run, "name string, cost double, rejected long").groupBy("name").agg(
        F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()  # a row per rule
    gain = {s["name"]: s["rejected"] / max(s["cost"], 1e-9) for s in stats}
    return sorted((r.name for r in rules), key=lambda name: (-gain.get(name, 0.0), name))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, order: list[str] | None = None,
                min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``kept`` and ``rejected_by`` (the rule that ended it)."""
    rules = production_rules(min_words) if rules is None else rules
    order = rule_order(docs, rules, doc_id=doc_id, text=text) if order is None else order
    by_name = {rule.name: rule for rule in rules}
    cascade = [by_name[name] for name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES)
        for batch in batches:
            verdicts, rows = [], []
            for value in batch.column("text"):
                measured = Measures((value.as_py() or "").encode(), hasher)
                verdicts.append(next((rule.name for rule in cascade if rule.rejects(measured)), None))
                rows.append(tuple(getattr(measured, name) for name in BASE))
            base = list(zip(*rows)) if rows else [()] * len(BASE)
            failed = [n < min_words or 100 * again > 50 * n for n, again in zip(base[0], base[4])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), batch.column("text"), *[pa.array(b, pa.int64()) for b in base],
                 pa.array(failed, pa.bool_()), pa.array([v is None and not f for v, f in zip(verdicts, failed)],
                                                        pa.bool_()), pa.array(verdicts, pa.string())],
                names=["rest", "text", *OWN, "rejected_by"])

    source = docs.select(support.packed(docs, text).alias("rest"), support.col(text).alias("text"))
    kind = source.schema["rest"].dataType.simpleString()
    found = source.mapInArrow(run, f"rest {kind}, text string, " + "".join(f"{n} long, " for n in BASE)
                              + "base_failed boolean, kept boolean, rejected_by string")
    named = found.withColumnRenamed("text", text) if text != "text" else found
    return support.unpacked(named, "rest", text, *OWN, "rejected_by")
