"""Case search for transactions over a persisted index: built once, probed by batches and micro-batches alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import ivf, similar

Encoder = Callable[[list[str]], np.ndarray]
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"


def symbol_counts(texts: list[str]) -> np.ndarray:
    """A plain encoder: how often each letter (A-Z as a-z) and digit occurs.  Any function of a list of texts will do."""
    return np.array([[t.count(s) + (t.count(s.upper()) if s.isalpha() else 0) for s in SYMBOLS] for t in texts], np.float64)


def build_library(cases: DataFrame, path: str, encoder: Encoder = symbol_counts, cells: int | None = None) -> ivf.Index:
    """The index of a case library; cases are embedded once, here."""
    texts = similar.case_text(cases).select("case_id", F.coalesce("case_text", F.lit("")).alias("case_text"))
    return ivf.build(similar.embed(texts, "case_text", encoder).select("case_id", "vector"), path, cells=cells)


def search_library(enriched: DataFrame, index: ivf.Index, encoder: Encoder = symbol_counts, k: int = 5,
                   probes: int | None = None) -> DataFrame:
    """``transaction_id``, ``kb_score`` and ``similar_cases``: each distinct text is embedded and searched once."""
    texts = similar.txn_text(enriched).select("transaction_id", "txn_text", F.unhex(F.sha2("txn_text", 256)).alias("query_id"))
    asked = similar.embed(texts.select("query_id", "txn_text").dropDuplicates(["query_id"]), "txn_text", encoder)
    hits = ivf.best(asked, index, k) if probes is None else ivf.search(asked, index, k, probes)[0]
    return texts.select("transaction_id", "query_id").join(similar.kb_score(hits, k), "query_id").drop("query_id")
