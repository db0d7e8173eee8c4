"""Ranked lexical search: best-first intervals of documents, bounded by range maxima of posting lists.

Each document is tokenised once; of its terms only those leave that fall on a bit map of the items' terms (fixed size;
the exact join follows).  Counts over all documents give every posting its impact, an integer.  Documents are dealt by
hash to shards of about ``SHARD_POSTINGS`` postings.  A task holds one shard and one block of items: every posting list
has a sparse table, with which the largest impact of any interval of documents takes two look-ups.

A search starts with all documents of the shard.  The sum of an interval's maxima, one for each term, bounds every
score in it.  Intervals are taken by falling bound (a batch at a time) and split at the document with the largest
impact; the same binary searches that divide the lists give that document's exact score.  What cannot enter the best k
any more is left; at equal bounds only documents with smaller ids than the last of the list are still looked at.  Lists
of shards are merged 256 at a time.

Defined cases.  A null or wordless text has no terms: such documents are neither counted nor found, such items have no
rows.  Every row is a document, and an item, of its own, so a repeated item id has a list for each of its rows.  Equal
scores go by ascending document id, a null id last.  Words weigh nothing where floor gives 0 and are then no hit.
Without documents or items there are no rows.  Texts are read in pieces of a megabyte.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.llm.textbytes import PIECE

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
BITS = 1 << 20
SHARD_POSTINGS = 1_000_000
BLOCK_TERMS = 100_000      # terms of the items that a task holds at once
VOCABULARY_BYTES = 32 << 20  # largest table of terms that is sent to every executor
MERGED = 256               # lists that are merged in one step
COUNTED = "row long, id long, n long, terms array<binary>, counts array<int>"
HIT = "item_row long, item_id long, shard long, row long, doc_id long, score long"


def term_counts(text: bytes) -> tuple[Counter, int]:
    """Terms of a text, A-Z in lower case, and their number with repeats."""
    text, counts, n, at = text.lower(), Counter(), 0, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = BREAK.search(text, end)
            end = gap.start() if gap else len(text)
        found = TERM.findall(text, at, min(end, len(text)))
        counts.update(found)
        n += len(found)
        at = end
    return counts, n


def counted(texts: DataFrame, id_column: str, text: str, bits: list[int] | None = None) -> DataFrame:
    """``row`` (a number of its own), ``id``, number of terms, and the distinct terms on ``bits`` with their counts."""
    packed = None
    if bits is not None:
        table = np.zeros(BITS, np.uint8)
        table[bits] = 1
        packed = np.packbits(table).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).tobytes()
        row, mask = TaskContext.get().partitionId() << 33, BITS - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, ends, terms, counts = [], [0], [], []
                for text in part.column("text").to_pylist():
                    found, n = term_counts((text or "").encode())
                    for term, times in found.items():
                        if wanted is None or wanted[crc32(term) & mask]:
                            terms.append(term)
                            counts.append(times)
                    sizes.append(n)
                    ends.append(len(terms))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(part.num_rows)), part.column("id"), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.binary())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32()))],
                    names=["row", "id", "n", "terms", "counts"])
                row += part.num_rows

    narrow = texts.select(support.col(id_column).cast("long").alias("id"), support.col(text).alias("text"))
    return narrow.mapInArrow(run, COUNTED)


# --- one shard -----------------------------------------------------------------------------------

class Shard:
    """Posting lists of one shard with their sparse tables.

    Postings are sorted by term and document; ``best[k][i]`` is the place of the largest of the 2**k impacts from i on.
    """

    def __init__(self, term: np.ndarray, row: np.ndarray, doc_id: np.ndarray, known: np.ndarray, impact: np.ndarray):
        rows, first, inverse = np.unique(row, return_index=True, return_inverse=True)
        by_id = np.lexsort((rows, doc_id[first], ~known[first]))
        self.rows, self.ids, self.known = rows[by_id], doc_id[first][by_id], known[first][by_id]
        place = np.empty(len(rows), np.int64)
        place[by_id] = np.arange(len(rows))
        doc = place[inverse]
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.width = len(rows) + 1
        self.key = term[order] * self.width + self.doc
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        longest = int(np.diff(self.bounds).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(1, longest.bit_length()):
            self.log[1 << k:] = k
        self.best = [np.arange(len(order), dtype=np.int32)]
        for k in range(longest.bit_length() - 1):
            half = self.best[-1]
            self.best.append(self._larger(half[:-(1 << k)], half[1 << k:]))

    def _larger(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def largest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each [left, right) of a list; none is empty."""
        out, level = np.empty(len(left), np.int64), self.log[right - left]
        for k in np.unique(level).tolist():
            mine = np.flatnonzero(level == k)
            out[mine] = self._larger(self.best[k][left[mine]], self.best[k][right[mine] - (1 << k)])
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Local documents and scores of the best ``k``, by falling score and ascending id."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, times, terms = at[held], times[held], terms[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.visited = 0
        if not len(at):
            return docs, scores
        front = self._intervals(np.zeros(1, np.int64), np.zeros(len(at), np.int64), np.arange(len(at)),
                                self.bounds[at], self.bounds[at + 1], times)
        while len(front["low"]):
            if len(docs) == k:
                limit, last = scores[-1], docs[-1]
                alive = (front["bound"] > limit) | ((front["bound"] == limit) & (front["low"] < last))
                if not alive.all():
                    front = self._only(front, alive)
                if not len(front["low"]):
                    break
            chosen = np.ones(len(front["low"]), bool)
            if len(chosen) > batch:
                chosen[np.argpartition(-front["bound"], batch)[batch:]] = False
            taken, front = self._only(front, chosen), self._only(front, ~chosen)
            batch = min(2 * batch, 512)

            owner, which, split = taken["owner"], taken["which"], taken["split"]
            middle = np.searchsorted(self.key, terms[which] * self.width + split[owner])
            inside = middle < taken["right"]
            inside[inside] = self.doc[middle[inside]] == split[owner[inside]]
            gain = np.zeros(len(owner), np.int64)
            gain[inside] = times[which[inside]] * self.impact[middle[inside]]
            score = np.add.reduceat(gain, np.searchsorted(owner, np.arange(len(split))))
            self.visited += len(split)
            docs, scores = np.concatenate([docs, split]), np.concatenate([scores, score])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]

            below, above = taken["left"] < middle, middle + inside < taken["right"]
            children = self._intervals(
                np.concatenate([taken["low"], split + 1]), np.concatenate([owner[below], owner[above] + len(split)]),
                np.concatenate([which[below], which[above]]), np.concatenate([taken["left"][below], (middle + inside)[above]]),
                np.concatenate([middle[below], taken["right"][above]]), times)
            front = self._joined(front, children)
        return docs, scores

    def _intervals(self, low, owner, which, left, right, times) -> dict[str, np.ndarray]:
        """Intervals with a row for each list that has postings there; ``owner`` ascends.  Empty ones are left out."""
        names, owner = np.unique(owner, return_inverse=True)
        if not len(names):
            return {n: np.zeros(0, np.int64) for n in ("low", "bound", "split", "owner", "which", "left", "right")}
        top = self.largest(left, right)
        gain = times[which] * self.impact[top]
        starts = np.searchsorted(owner, np.arange(len(names)))
        most = np.maximum.reduceat(gain, starts)
        peak = np.flatnonzero(gain == most[owner])
        _, first = np.unique(owner[peak], return_index=True)
        return {"low": low[names], "bound": np.add.reduceat(gain, starts), "split": self.doc[top[peak[first]]],
                "owner": owner, "which": which, "left": left, "right": right}

    @staticmethod
    def _only(front: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
        rows = keep[front["owner"]]
        number = np.cumsum(keep) - 1
        return {n: front[n][keep] for n in ("low", "bound", "split")} | {
            "owner": number[front["owner"][rows]], **{n: front[n][rows] for n in ("which", "left", "right")}}

    @staticmethod
    def _joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {n: np.concatenate([a[n], b[n] + len(a["low"]) if n == "owner" else b[n]]) for n in a}


def _shard_search(k: int):
    def run(postings: pa.Table, items: pa.Table) -> pa.Table:
        if not postings.num_rows or not items.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("item_row", "item_id", "shard", "row", "doc_id", "score")})
        column = {n: postings.column(n) for n in postings.column_names}
        known = column["doc_id"].is_valid().to_numpy()
        ids = column["doc_id"].fill_null(0).to_numpy()
        shard = Shard(column["term"].to_numpy().astype(np.int64), column["row"].to_numpy(), ids, known,
                      column["impact"].to_numpy())
        number = column["shard"][0].as_py()
        rows, names, held, docs, known, scores = [], [], [], [], [], []
        for item in items.column("items")[0].as_py():
            found, score = shard.search(np.array(item["terms"], np.int64), np.array(item["counts"], np.int64), k)
            rows += [item["row"]] * len(found)
            names += [item["id"]] * len(found)
            held.append(shard.rows[found])
            docs.append(shard.ids[found])
            known.append(shard.known[found])
            scores.append(score)
        return pa.table({
            "item_row": pa.array(rows, pa.int64()), "item_id": pa.array(names, pa.int64()),
            "shard": pa.array(np.full(len(rows), number, np.int64)), "row": np.concatenate(held),
            "doc_id": pa.array(np.concatenate(docs), pa.int64(), mask=~np.concatenate(known)), "score": np.concatenate(scores)})
    return run


# --- the whole search ------------------------------------------------------------------------------

def _pairs(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip("terms", "counts")).alias("t")) \
        .select(*keep, F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("times"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id",
                  text: str = "text", shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS,
                  vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    scratch = support.Scratch(spark)
    try:
        asked = scratch.table(counted(items, item_id, text), "items")
        total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        blocks = max(1, -(-total // block_terms))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        wanted = _pairs(asked, "block", "row", "id")
        bits = wanted.select(F.crc32("term").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).distinct().collect()
        hits = scratch.table(counted(docs, doc_id, text, [b["bit"] for b in bits]), "term-hits")  # BITS at most
        n, words, postings = hits.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
        if not total or not postings:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

        terms = wanted.select("block", "term").distinct()
        spread = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
        number = F.row_number().over(Window.partitionBy("block").orderBy("term")).cast("int")
        vocabulary = scratch.table(
            terms.join(spread, "term").withColumns({"w": weight, "number": number}).filter("w > 0"), "vocabulary")
        rows, size = vocabulary.agg(F.count("*"), F.sum(F.length("term"))).first()
        weighed = F.broadcast(vocabulary) if 64 * rows + (size or 0) <= vocabulary_bytes else vocabulary
        shards = -(-postings // shard_postings)
        length = F.expr(f"75 + (25 * n * {n}L) div {words}L")
        found = _pairs(hits.withColumn("m", length), "row", "id", "m").join(weighed, "term").select(
            "block", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.col("number").alias("term"), "row",
            F.col("id").alias("doc_id"), F.expr("w * ((1000000000 * times) div (1000 * times + 12 * m))").alias("impact")) \
            .filter("impact > 0")

        lists = wanted.join(vocabulary.select("block", "term", "number"), ["block", "term"]).groupBy("block", "row", "id") \
            .agg(F.collect_list(F.struct("number", "times")).alias("t"))  # an item's own terms
        packed = lists.groupBy("block").agg(F.collect_list(F.struct(
            "row", "id", F.col("t.number").alias("terms"), F.col("t.times").alias("counts"))).alias("items"))
        packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        by = ["block", "shard"]
        best = found.groupBy(*by).cogroup(packed.groupBy(*by)).applyInArrow(_shard_search(k), HIT)
        best = scratch.table(best, "shard-lists")
        while shards > MERGED:
            shards = -(-shards // MERGED)
            best = _first(best.withColumn("shard", F.expr(f"shard div {MERGED}")), ["item_row", "shard"], k).drop("rank")
        ranked = _first(best, ["item_row"], k)
        return scratch.kept(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    finally:
        scratch.clear()


def _first(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k)
