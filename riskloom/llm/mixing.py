"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised.  The exponent is found by bisection on the lattice
of 2**-20: the largest one whose weights reach the target entropy, but not below the smallest one that keeps every
source within ``max_epochs`` repetitions.  Each round cuts the interval into 32 parts and evaluates them in one
aggregation over the table of sources, so the sources never leave Spark.

The weights become token budgets.  A source is read in whole random permutations (epochs) until its budget is spent;
the last one stops inside.  Where a document starts in its source's sequence decides the block it falls into, so
every block holds each source at its weight; the order inside a block is a permutation of its own.  Running sums
come from totals of hash ranges of about ``RANGE_ROWS`` documents, so a source of any size is dealt over many tasks.

Defined cases.  A null source is the source ``''``.  A token is a run of non-space characters; a null text has none.
Sources without tokens get no budget and their documents are left out.  A document is taken if it starts before its
source's budget is spent.  A budget above ``max_epochs`` times all tokens is lowered to that.  A row's place in a
permutation comes from a digest of its id, text and number among equal rows, so rows without id, or of one id, are
spread like others and equal rows each stand for themselves.  A text of any length is one document.  An empty table
gives no rows.  Extra columns pass through ``mixed_documents`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import support
from riskloom.session import materialise

TARGET_ENTROPY = 0.95
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 1_000_000
RANGE_ROWS = 20_000
MOST_RANGES = 200_000  # ranges of hashes that are sent to every task
SECTIONS, ROUNDS = 32, 4
SEED = "mix"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, target_entropy: float, max_epochs: float, budget_share: float) -> float:
    """The exponent for ``shares`` (column ``p``, positive, summing to 1).

    ``target_entropy`` is a share of the largest possible entropy; ``budget_share`` the budget over all tokens.
    """
    def evaluate(points: list[float]) -> list[tuple[float, float]]:
        sums = [column for a in points for column in (F.sum(F.pow("p", F.lit(a))),
                                                      F.sum(F.pow("p", F.lit(a)) * F.log("p")))]
        row = shares.agg(F.count("*"), F.min("p"), *sums).first()
        out = []
        for number, a in enumerate(points):
            z, weighted = row[2 + 2 * number], row[3 + 2 * number]
            entropy = math.log(z) - a * weighted / z
            reached = entropy / math.log(row[0]) if row[0] > 1 else 1.0
            out.append((reached, budget_share / z * row[1] ** (a - 1.0)))
        return out

    low_e, low_r, width = 0.0, 0.0, 1.0
    for number in range(ROUNDS):
        step = width / SECTIONS
        cuts = [i * step for i in range(SECTIONS + 1)]
        found = evaluate([low_e + c for c in cuts] + [low_r + c for c in cuts])
        reached = [i for i in range(SECTIONS + 1) if found[i][0] >= target_entropy - 1e-12]
        allowed = [i for i in range(SECTIONS + 1) if found[SECTIONS + 1 + i][1] <= max_epochs + 1e-12]
        if not number:
            even, free = SECTIONS in reached, 0 in allowed  # no change needed, or no limit felt
        low_e += step * min(max(reached, default=0), SECTIONS - 1)
        low_r += step * max(min(allowed, default=SECTIONS) - 1, 0)
        width = step
    return max(1.0 if even else low_e, 0.0 if free else low_r + width)


def source_budgets(sources: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (``source``, ``n_docs``, ``tokens``) with ``weight``, ``budget`` and the exponent ``alpha``."""
    used = sources.filter("tokens > 0")
    total = used.agg(F.sum("tokens")).first()[0] or 0
    wanted = min(total if budget is None else budget, math.floor(max_epochs * total))
    shares = used.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    alpha = exponent(shares.select("p"), target_entropy, max_epochs, wanted / total) if total else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0] or 1.0
    weight = F.pow("p", F.lit(alpha)) / F.lit(z)
    return shares.select("source", "n_docs", "tokens", F.lit(alpha).alias("alpha"), weight.alias("weight"),
                         F.floor(weight * wanted + 0.5).alias("budget"))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY,
        max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, doc_id: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """The mixture's sequence: ``doc_id, source, n_tokens, epoch, block, slot``.

    The budget is that of all tokens unless given.
    """
    rows = docs.select("*", F.monotonically_increasing_id().alias("_row"))
    places, _, _ = _plan(rows, doc_id, source, text, budget, target_entropy, max_epochs, block_tokens, seed)
    return places.select("doc_id", "source", "n_tokens", "epoch", "block", "slot")


def _plan(docs: DataFrame, doc_id: str, source: str, text: str, budget: int | None = None,
          target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS,
          seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sequence with the ``row`` (column ``_row`` of ``docs``) that stands at each place, its ``order_key`` and
    ``range``; the sources with a budget and their ``epochs``; the rows that have an equal one before them."""
    scratch = support.Scratch(docs.sparkSession)
    try:
        sequence, budgets, narrow = _sequence(docs, scratch, doc_id, source, text, budget, target_entropy, max_epochs,
                                              block_tokens, seed)
        return (scratch.kept(sequence, "mixture"),
                scratch.kept(budgets.select("source", "n_docs", F.expr("(budget - 1) div tokens + 1").alias("epochs")),
                             "mix-epochs"),
                scratch.kept(narrow.filter("copy > 1").select("row"), "mix-copies"))
    finally:
        scratch.clear()


def _name(doc_id: Column, text: Column) -> Column:
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), content)


def _source(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` (with ``name``, ``copy``, ``n_docs`` and ``epochs``) once an epoch, with their place in its permutation."""
    name = F.concat_ws(":", F.lit(seed), "epoch", "name", "copy")
    return (rows.withColumn("epoch", F.explode(F.expr("sequence(0, cast(epochs - 1 as int))")))
            .withColumn("order_key", F.md5(name.cast("binary")))
            .withColumn("range", F.expr("cast(conv(substring(order_key, 1, 8), 16, 10) as long) * "
                                        f"((n_docs + {RANGE_ROWS - 1}) div {RANGE_ROWS}) div 4294967296")))


def _sequence(docs: DataFrame, scratch: support.Scratch, doc_id: str, source: str, text: str, budget: int | None,
              target_entropy: float, max_epochs: float, block_tokens: int,
              seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = docs.select(F.col("_row").alias("row"), support.col(doc_id).cast("long").alias("doc_id"),
                        _source(support.col(source)).alias("source"),
                        token_count(support.col(text)).alias("n_tokens"),
                        _name(support.col(doc_id), support.col(text)).alias("name"))
    # equal rows are numbered, however many there are
    narrow = scratch.table(support.placed(named, "name", [F.col("source")], scratch, "mix-names").select(
        "row", "doc_id", "source", "n_tokens", "name", (F.col("position") + 1).alias("copy")), "mix-rows")
    sources = scratch.table(narrow.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")),
                          "mix-sources")
    budgets = source_budgets(sources, budget, target_entropy, max_epochs).filter("budget > 0")
    blocks = max(1, -(-(budgets.agg(F.sum("budget")).first()[0] or 0) // block_tokens))

    drawn = _drawn(narrow.join(budgets, "source").withColumn("epochs", F.expr("(budget - 1) div tokens + 1")), seed)
    keys = ["source", "epoch", "range"]
    totals = drawn.groupBy(*keys).agg(F.sum("n_tokens").alias("in_range"))
    earlier = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys).orderBy("order_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (drawn.join(starts, keys)
              .withColumn("at", F.col("epoch") * F.col("tokens") + F.col("before")
                          + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .filter("at < budget and n_tokens > 0")
              .withColumn("block", F.expr(f"cast(at * {blocks} div budget as int)")))
    shuffled = Window.partitionBy("block").orderBy(_in_block(), "row")
    return placed.select("row", "doc_id", "source", "n_tokens", "epoch", "block", F.row_number().over(shuffled).alias("slot"),
                         "order_key", "range"), budgets, narrow


def _in_block() -> Column:
    return F.md5(F.concat_ws(":", "block", "order_key").cast("binary"))


def _looked_up(rows: DataFrame, places: DataFrame, budgets: DataFrame, doc_id: str, source: str, text: str,
               seed: str) -> DataFrame | None:
    """``rows`` without equal ones, at their places: a row's digest tells its range, the range where blocks begin.

    So the texts need not meet the places in a shuffle.  What goes to every task has a row per source and per
    ``RANGE_ROWS`` documents; None if that is more than ``MOST_RANGES``.
    """
    keys = ["source", "epoch", "range"]
    begins = places.groupBy(*keys, "block").agg(F.min("order_key").alias("begin"), F.max("order_key").alias("end"))
    ranges = materialise(begins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "block"))).alias("begins"),
                                                   F.max("end").alias("last")), "mix-ranges")
    if ranges.count() + budgets.count() > MOST_RANGES:
        return None
    named = rows.withColumns({"source": _source(F.col("row").getField(source)),
                              "name": _name(F.col("row").getField(doc_id), F.col("row").getField(text)), "copy": F.lit(1)}) \
        .filter(token_count(F.col("row").getField(text)) > 0)
    drawn = _drawn(named.join(F.broadcast(budgets), "source"), seed)  # a row per source
    return drawn.join(F.broadcast(ranges), keys).filter("order_key <= last") \
        .withColumn("block", F.expr("element_at(filter(begins, b -> b.begin <= order_key), -1).block"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                    seed: str = SEED, **settings) -> DataFrame:
    """The documents of the mixture in its order, columns unchanged; a repeated document is a repeated row.

    The rows are written once with numbers of their own, by which the places of the sequence find those that have
    an equal row; that table stays, because the result reads it.  All others find their place by themselves.
    """
    stored = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("row")), "mix-documents")
    fields = stored.select("_row", *[F.col("row").getField(c).alias(c) for c in dict.fromkeys((doc_id, source, text))])
    places, budgets, copies = _plan(fields, doc_id, source, text, seed=seed, **settings)
    numbered, alone = support.parted_by_ids(stored, F.col("_row"), copies)
    found = _looked_up(alone, places, budgets, doc_id, source, text, seed)
    met = (stored if found is None else numbered).join(places.withColumnRenamed("row", "_row"), "_row")
    both = [part.select("_row", "row", "block", _in_block().alias("at")) for part in (met, found) if part is not None]
    whole = both[0] if found is None else both[0].unionByName(both[1])
    ordered = whole.repartitionByRange("block", "at", "_row").sortWithinPartitions("block", "at", "_row")
    return ordered.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
