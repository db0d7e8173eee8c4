"""Similar-case search: case texts, vectors, exact and approximate top-k, text search.

Top-k never forms query-case pairs as rows.  Similarities are computed a block of queries
against a block of cases at a time inside a task, and only each block's best ``k`` leave
it; a final group limit merges the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import fixed_values as fv
from riskloom.session import materialise

BROADCAST_BYTES = 256 << 20  # largest vector set shipped whole to the executors
BLOCK_ROWS = 20000           # rows of one side of a block held by a task
BLOCK_BYTES = 4 << 20        # vectors of a block of the exact search
PART_BYTES = 64 << 20        # compressed blocks of cases that a task of the exact search holds
TASK_PAIRS = 1 << 30         # pairs that a task of the exact search compares
SIGNED_ROWS = 512            # rows whose signatures of all tables are held at once
SAMPLE = 64                  # queries whose exact hits set the number of LSH tables and measure the recall
MAX_TABLES = 64              # largest number of LSH tables; neighbours that need more are searched exactly
TASK_TERMS = 500_000         # terms of cases that a task of the text search weighs
FEW_PAIRS = 1 << 13          # pairs compared in double precision at once
ROUNDING = 6                 # similarities are compared at this many places, ties by id

Similarity = Callable[[pd.Series, pd.Series], np.ndarray]


# --- texts ---------------------------------------------------------------------------------------

def case_text(df: DataFrame, output: str = "case_text") -> DataFrame:
    """Six labelled lines per case."""
    def with_default(column, default):
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    values = (F.col("case_title"), F.col("case_type"), with_default("fraud_pattern", fv.TEXT_UNKNOWN),
              with_default("modus_operandi", fv.TEXT_NONE), F.col("case_description"),
              with_default("resolution", fv.TEXT_NONE))
    lines = [F.concat(F.lit(f"{label}: "), v) for label, v in zip(fv.CASE_TEXT_LABELS, values)]
    return df.withColumn(output, F.concat_ws("\n", *lines))


def txn_text(df: DataFrame, output: str = "txn_text") -> DataFrame:
    """Twelve labelled lines per transaction, used as the search query."""
    def value(column, default):
        return F.coalesce(F.col(column).cast("string"), F.lit(default)) if column in df.columns else F.lit(default)

    sources = (("amount", "N/A"), ("transaction_type", "N/A"), ("channel_code", "N/A"), ("transaction_time", "N/A"),
               ("count_1h", "0"), ("count_24h", "0"), ("is_first_device", "False"), ("is_cross_border", "False"),
               ("ip_risk_level", "NORMAL"), ("device_count_30d", "0"), ("city_count_30d", "0"), ("amount_deviation", "0"))
    lines = []
    for label, (column, default) in zip(fv.TRANSACTION_TEXT_LABELS, sources):
        text = value(column, default)
        if column in ("is_first_device", "is_cross_border"):
            text = F.initcap(text)
        lines.append(F.concat(F.lit(f"{label}: "), text))
    return df.withColumn(output, F.concat_ws("\n", *lines))


# --- embedding -----------------------------------------------------------------------------------

def fit_encoder(df: DataFrame, text: str, dimension: int = 512) -> PipelineModel:
    """Default encoder: hashed term frequencies, inverse document frequency, unit length."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\s:,.;]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(df.select(text))


def embed(df: DataFrame, text: str, encoder: PipelineModel | Callable[[list[str]], np.ndarray],
          output: str = "vector") -> DataFrame:
    """Unit vectors of a text column, from a fitted pipeline or a batch function."""
    if isinstance(encoder, PipelineModel):
        # the pipeline reads the column it was fitted on
        source = encoder.stages[0].getInputCol()
        named = df if source == text else df.withColumn(source, F.col(text))
        vectors = encoder.transform(named).withColumn(output, vector_to_array("_unit", "float32"))
        return vectors.select(*df.columns, output)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            matrix = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
            yield pd.Series(list(unit.astype(np.float32)))

    return df.withColumn(output, encode(F.col(text)))


# --- exact top-k ---------------------------------------------------------------------------------

def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def dot(queries: pd.Series, cases: pd.Series) -> np.ndarray:
    return _matrix(queries) @ _matrix(cases).T


def _best(query_ids: np.ndarray, case_ids: np.ndarray, similarity: np.ndarray, k: int) -> pd.DataFrame:
    """The k best cases of every query, ties by case id."""
    k = min(k, similarity.shape[1])
    # only what can be among the best is rounded: equal places can differ by no more than one unit of the last
    kth = -np.partition(-similarity, k - 1, axis=1)[:, k - 1]
    rows, cols = np.divmod(np.flatnonzero(similarity >= (kth - 2 * 10.0 ** -ROUNDING)[:, None]), similarity.shape[1])
    return _ranked(query_ids, case_ids, rows, cols, similarity[rows, cols], k)


def _ranked(query_ids: np.ndarray, case_ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, similarity: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of some pairs of every query."""
    rounded = np.round(similarity, ROUNDING)
    order = np.lexsort((case_ids[cols], -rounded, rows))
    rows, cols, rounded = rows[order], cols[order], rounded[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k
    rows, cols, rounded = rows[keep], cols[keep], rounded[keep]
    # text ids stay objects: pandas' own strings may come in chunks, of which no batch can be made
    return pd.DataFrame({"query_id": pd.Series(query_ids[rows], dtype=query_ids.dtype),
                         "case_id": pd.Series(case_ids[cols], dtype=case_ids.dtype), "similarity": rounded})


def _nearest(query_ids: np.ndarray, case_ids: np.ndarray, queries: np.ndarray, cases: np.ndarray, k: int) -> pd.DataFrame:
    """``_best`` by inner product: products in single precision leave few pairs, which are compared in double precision."""
    about = queries.astype(np.float32) @ cases.astype(np.float32, copy=False).T
    last = min(k, about.shape[1]) - 1
    kth = -np.partition(-about, last, axis=1)[:, last].astype(np.float64)
    # more than single precision can be off
    longest = np.sqrt(np.einsum("ij,ij->i", cases, cases, dtype=np.float64).max())
    off = (queries.shape[1] + 4) * 2.0 ** -23 * np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * longest + 2.0 ** -22 * np.abs(kth)
    able = about >= (kth - 2 * off - 2 * 10.0 ** -ROUNDING)[:, None].astype(np.float32)
    rows, cols = np.divmod(np.flatnonzero(able), about.shape[1])
    if not np.isfinite(off).all() or len(rows) * 16 > about.size + 16 * k * len(queries):  # copies, or nothing to tell them apart by
        return _best(query_ids, case_ids, queries.astype(np.float64) @ cases.astype(np.float64, copy=False).T, k)
    exact = np.concatenate([np.zeros(0), *[
        np.einsum("ij,ij->i", queries[rows[at:at + FEW_PAIRS]].astype(np.float64), cases[cols[at:at + FEW_PAIRS]].astype(np.float64))
        for at in range(0, len(rows), FEW_PAIRS)]])
    return _ranked(query_ids, case_ids, rows, cols, exact, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("case_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _result_schema(queries: DataFrame, cases: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("case_id", cases.schema["case_id"].dataType),
                         T.StructField("similarity", T.DoubleType())])


def _blocks(df: DataFrame, columns: list[str], block_rows: int, marks: str | None = None) -> DataFrame:
    """Blocks of at most ``block_rows`` rows and ``BLOCK_BYTES``: ``n`` rows as one compressed Arrow stream.

    ``marks`` names a column whose distinct values in a block leave beside it.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, min(block_rows, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part, sink = batch.slice(at, step), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_batch(part)
                values = {"n": pa.array([part.num_rows], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
                if marks:
                    values["marks"] = pa.array([part.column(marks).unique().to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    return df.select(*columns).mapInArrow(pack, "n long, rows binary" + (", marks array<int>" if marks else ""))


def _packed(df: DataFrame, key: str, payload: str, block_rows: int, name: str) -> DataFrame:
    """Table of blocks of ``df``."""
    return materialise(_blocks(df, [key, payload], block_rows).withColumn("block", F.monotonically_increasing_id()), name)


def _every_pair(queries: DataFrame, cases: DataFrame, k: int, similarity: Similarity, payload: str,
                block_rows: int) -> DataFrame:
    """Best ``k`` of each query in every part of the cases: each block of queries meets each block of cases.

    Blocks are written once and met by a cross join, so no vector is copied for the blocks it meets.  What leaves a
    task has ``k`` rows a query at most if the blocks of queries are its outer loop.
    """
    left = _packed(queries, "query_id", payload, block_rows, "query-blocks")
    right = _packed(cases, "case_id", payload, block_rows, "case-blocks")
    sums = [F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("rows")), F.lit(0))]
    (blocks, asked, _), (_, known, stored) = left.agg(*sums).first(), right.agg(*sums).first()
    wanted = 4 * left.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(blocks, max(wanted, asked * known // TASK_PAIRS)))
    # a task holds a part of the cases, and each part sends the best hits of every query: no more parts than it takes
    parts = max(1, -(-stored // PART_BYTES), -(-wanted // tasks))
    pairs = left.select("block", F.col("rows").alias("q")).repartition(tasks).crossJoin(
        right.select(F.col("rows").alias("c")).coalesce(parts))

    def unpacked(rows: pa.BinaryScalar) -> tuple[pa.DataType, np.ndarray, pd.Series]:
        ids, vectors = pa.ipc.open_stream(rows.as_buffer()).read_all().columns
        return ids.type, ids.to_pandas().to_numpy(), vectors.to_pandas()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(found["query_id"].to_numpy(), kinds[0], from_pandas=True),
                 pa.array(found["case_id"].to_numpy(), kinds[1], from_pandas=True),
                 pa.array(found["similarity"].to_numpy(), pa.float64())], names=["query_id", "case_id", "similarity"])

        block = found = kinds = None
        for batch in batches:
            for number, q, c in zip(batch.column("block").to_pylist(), batch.column("q"), batch.column("c")):
                if number != block:
                    if found is not None:
                        yield out()
                    block, found = number, None
                    query_kind, query_ids, asked = unpacked(q)
                case_kind, case_ids, known = unpacked(c)
                kinds = query_kind, case_kind
                step = max(1, (32 << 20) // (8 * len(known)))  # bounds the similarity matrix in memory
                if similarity is dot:
                    one, other = (np.array(v.tolist()) for v in (asked, known))
                    hits = [_nearest(query_ids[i:i + step], case_ids, one[i:i + step], other, k) for i in range(0, len(asked), step)]
                else:
                    hits = [_best(query_ids[i:i + step], case_ids, similarity(asked.iloc[i:i + step], known), k)
                            for i in range(0, len(asked), step)]
                found = pd.concat(hits if found is None else [found, *hits], ignore_index=True).sort_values(
                    ["similarity", "case_id"], ascending=[False, True], kind="stable").groupby(
                    "query_id", sort=False, dropna=False).head(k)
        if found is not None:
            yield out()

    return pairs.mapInArrow(best, _result_schema(queries, cases))


def blocked_topk(queries: DataFrame, cases: DataFrame, k: int, similarity: Similarity, payload: str,
                 bucket: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k with both sides cut into blocks and every block pair met in one task.

    Without ``bucket`` the result is exact.  With it, only equal buckets meet; the number
    of blocks follows each bucket's own size, so a bucket holding a third of the cases is
    spread over as many tasks as its size asks for.
    """
    if bucket is None:
        return _merged(_every_pair(queries, cases, k, similarity, payload, block_rows), k)
    query_side = queries.select("query_id", payload, bucket)
    case_side = cases.select("case_id", payload, bucket)

    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int")

    # one row per bucket: bounded by the number of distinct signatures
    sizes = (case_side.groupBy(bucket).agg(blocks.alias("case_blocks"))
             .join(query_side.groupBy(bucket).agg(blocks.alias("query_blocks")), bucket))
    query_side, case_side = query_side.join(sizes, bucket), case_side.join(sizes, bucket)

    def spread(df, key, own, other):
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).alias(f"{own}_block")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return df.select(key, payload, bucket, mine.cast("int").alias(f"{own}_block"), every)

    left = spread(query_side, "query_id", "query", "case")
    right = spread(case_side, "case_id", "case", "query")

    def best_of_block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "case_id": [], "similarity": []})
        step = max(1, (32 << 20) // (8 * len(c)))  # bounds the similarity matrix in memory
        parts = [_best(q["query_id"].to_numpy()[i:i + step], c["case_id"].to_numpy(),
                       similarity(q[payload].iloc[i:i + step], c[payload]), k) for i in range(0, len(q), step)]
        return pd.concat(parts, ignore_index=True)

    group = [bucket, "query_block", "case_block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best_of_block, _result_schema(queries, cases))
    return _merged(found.distinct(), k)


def vector_topk(queries: DataFrame, cases: DataFrame, k: int = 5, payload: str = "vector",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top-k by inner product (cosine on unit vectors); any ``k`` from 1.

    A case library that fits ``broadcast_bytes`` (its size is counted, not assumed) is
    shipped to the executors and the queries stream past it without a shuffle.  Beyond
    that both sides are blocked.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    count, dimension = cases.agg(F.count("*"), F.max(F.size(payload))).first()
    if not count or count * (dimension or 0) * 8 > broadcast_bytes:
        return blocked_topk(queries, cases, k, dot, payload)

    library = cases.select("case_id", payload).toPandas()
    shared = cases.sparkSession.sparkContext.broadcast((library["case_id"].to_numpy(), np.array(library[payload].tolist())))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case_ids, matrix = shared.value
        step = max(1, (32 << 20) // (8 * len(case_ids)))
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i:i + step]
                best = _nearest(part["query_id"].to_numpy(), case_ids, np.array(part[payload].tolist()), matrix, k)
                best["rank"] = best.groupby("query_id", sort=False).cumcount().add(1).astype("int32")
                yield best

    schema = _result_schema(queries, cases).add("rank", T.IntegerType())
    return queries.select("query_id", payload).mapInPandas(search, schema)


# --- approximate top-k ---------------------------------------------------------------------------

def signatures(df: DataFrame, key: str, payload: str, dimension: int, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per hash table with the sign pattern of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((dimension, tables * bits))
    schema = T.StructType([df.schema[key], df.schema[payload], T.StructField("bucket", T.LongType())])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), SIGNED_ROWS):
                part = batch.iloc[at:at + SIGNED_ROWS]
                positive = (_matrix(part[payload]) @ planes > 0).reshape(len(part), tables, bits)
                pattern = positive @ powers + (np.arange(tables, dtype=np.int64) << bits)
                out = part.loc[part.index.repeat(tables), [key, payload]]
                yield out.assign(bucket=pattern.ravel())

    return df.select(key, payload).mapInPandas(sign, schema)


def lsh_settings(similarities: np.ndarray, cases: int, recall: float) -> tuple[int, int] | None:
    """Tables and bits with which neighbours at these cosines meet with a mean probability of ``recall``.

    The most bits that ``MAX_TABLES`` allow, and about eight cases a bucket at least; None if no number does.
    """
    agree = 1 - np.arccos(np.clip(similarities, -1, 1)) / np.pi
    tables = np.arange(1, MAX_TABLES + 1)
    for bits in range(int(np.clip(np.log2(max(cases, 1)) - 3, 1, 16)), 0, -1):
        meet = (1 - (1 - agree[:, None] ** bits) ** tables).mean(axis=0) if len(agree) else np.ones(len(tables))
        if meet[-1] >= recall:
            return int(tables[np.argmax(meet >= recall)]), bits
    return None


def vector_topk_lsh(queries: DataFrame, cases: DataFrame, k: int = 5, payload: str = "vector", tables: int | None = None,
                    bits: int | None = None, seed: int = 11, block_rows: int = BLOCK_ROWS,
                    recall: float = 0.9) -> DataFrame:
    """Approximate top-k of unit vectors: only those sharing a random-projection signature are compared.

    The exact hits of ``SAMPLE`` queries, without copies of the query, set ``tables`` and ``bits`` unless both are
    given, and measure the share that was found: column ``recall``.  If that is below ``recall`` with
    settings chosen here, all queries are searched exactly; queries with fewer than ``k`` hits always are.
    """
    count, dimension = cases.agg(F.count("*"), F.max(F.size(payload))).first()
    sampled = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE)
    known = vector_topk(sampled, cases, k).collect()  # at most SAMPLE x k rows
    wanted = [r for r in known if r["similarity"] < 1 - 10 ** -ROUNDING]
    chosen = tables is None or bits is None
    if chosen:
        settings = lsh_settings(np.array([r["similarity"] for r in wanted]), count, min(recall + 0.03, 0.995))
        if settings is None:
            return vector_topk(queries, cases, k).withColumn("recall", F.lit(1.0))
        tables, bits = settings
    left = signatures(queries, "query_id", payload, dimension or 0, tables, bits, seed)
    right = signatures(cases, "case_id", payload, dimension or 0, tables, bits, seed)
    found = materialise(blocked_topk(left, right, k, dot, payload, bucket="bucket", block_rows=block_rows), "lsh-hits")

    ids = list({r["query_id"] for r in known})
    hits = {(r["query_id"], r["case_id"]) for r in found.filter(F.col("query_id").isin(ids)).collect()}
    measured = float(np.mean([(r["query_id"], r["case_id"]) in hits for r in wanted])) if wanted else 1.0
    if chosen and measured < recall:
        return vector_topk(queries, cases, k).withColumn("recall", F.lit(1.0))
    full = found.filter(F.col("rank") == min(k, count)).select("query_id").distinct()
    rest = queries.join(full, "query_id", "left_anti")
    if not rest.isEmpty():
        found = found.join(full, "query_id", "left_semi").unionByName(vector_topk(rest, cases, k))
    return found.withColumn("recall", F.lit(measured))


# --- use of the hits -----------------------------------------------------------------------------

def kb_score(hits: DataFrame, keep: int = 5) -> DataFrame:
    """Mean similarity x 100 over all returned cases, and the best ``keep`` of them.

    ``hits`` has a row per hit, or a row per query with ``case_ids`` and ``similarities``, best first.
    """
    if "case_ids" in hits.columns:
        total = F.aggregate("similarities", F.lit(0.0), lambda s, x: s + x)
        return hits.filter(F.size("case_ids") > 0).select(
            "query_id", (total / F.size("similarities") * 100).alias("kb_score"),
            F.slice("case_ids", 1, keep).cast("array<string>").alias("similar_cases"))
    best = F.array_sort(F.collect_list(F.struct("rank", "case_id", "similarity")))  # at most 20 per query
    return hits.groupBy("query_id").agg(
        (F.avg("similarity") * 100).alias("kb_score"),
        F.transform(F.slice(best, 1, keep), lambda h: h["case_id"].cast("string")).alias("similar_cases"))


def rag_context(hits: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """Context document of the ``k`` best cases, one numbered section each."""
    top = hits.filter(F.col("rank") <= k).join(cases, "case_id")
    title = F.concat(F.lit("### 案例"), F.col("rank"), F.lit(": "), F.col("case_title"), F.lit(" (相似度: "),
                     (F.col("similarity").cast("decimal(10,6)") * 100).cast("decimal(10,2)"), F.lit("%)"))
    values = ("case_type", "fraud_pattern", "modus_operandi", "resolution")
    lines = [F.concat(F.lit(f"- **{label}**: "), F.coalesce(F.col(c), F.lit("")))
             for label, c in zip(fv.CONTEXT_LABELS, values)]
    lines.append(F.concat(F.lit(f"- **{fv.CONTEXT_LABELS[-1]}**: "),
                          F.coalesce(F.nullif(F.col("resolution_effect"), F.lit("")), F.lit(fv.TEXT_NONE))))
    sections = top.select("query_id", "rank", F.concat_ws("\n", title, *lines, F.lit("")).alias("section"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "section")))  # at most k per query
    return sections.groupBy("query_id").agg(
        F.concat_ws("\n", F.lit(fv.CONTEXT_HEADER), F.transform(ordered, lambda s: s["section"])).alias("context"))


def case_search(enriched: DataFrame, cases: DataFrame, k: int = 5, dimension: int = 512) -> DataFrame:
    """``transaction_id``, ``kb_score`` and ``similar_cases`` for every transaction."""
    texts = case_text(cases)
    encoder = fit_encoder(texts, "case_text", dimension)
    library = embed(texts.select("case_id", "case_text"), "case_text", encoder).select("case_id", "vector")
    queries = embed(txn_text(enriched).select(F.col("transaction_id").alias("query_id"), "txn_text"), "txn_text", encoder)
    found = kb_score(vector_topk(queries, library, k))
    return found.withColumnRenamed("query_id", "transaction_id")


# --- index maintenance ---------------------------------------------------------------------------

def with_position(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """Running position in key order, for keys of any type.

    The rows are range-sorted once and written with their place in their partition; the counts
    of the partitions, a row each, give the offsets.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialise(df.repartitionByRange(key).sortWithinPartitions(key)
                          .withColumns({"_part": F.spark_partition_id(), "_row": place}), "positions")
    offsets, before = [], start
    for part, rows in sorted(map(tuple, ordered.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += rows
    parts = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return ordered.join(F.broadcast(parts), "_part").select(  # one row per partition
        *df.columns, (F.col("_offset") + F.col("_row")).alias("position"))


def case_index_append(index: DataFrame | None, vectors: DataFrame, key: str, payload: str, dimension: int) -> DataFrame:
    """Index rows followed by new vectors; a vector of another dimension is an error."""
    wrong = vectors.filter(F.size(payload) != dimension).count()
    if wrong:
        raise ValueError(f"vector dimension mismatch: {wrong} rows are not {dimension} long")
    start = 0 if index is None else index.count()
    added = with_position(vectors, key, start)
    return added if index is None else index.unionByName(added)


def case_index_rebuild(vectors: DataFrame, key: str, payload: str, dimension: int) -> DataFrame:
    """A new index over all vectors, positions from 0 in key order; what was appended in between moves into place."""
    return case_index_append(None, vectors, key, payload, dimension)


# --- text search ---------------------------------------------------------------------------------

def tokens(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def text_search(cases: DataFrame, queries: DataFrame, k: int = 5, category: str | None = None) -> DataFrame:
    """Top-k cases per query by term frequency x squared inverse document frequency.

    ``cases`` has ``case_id``, ``case_type`` and the searched ``text``; ``queries`` has
    ``query_id`` and ``text``.  Inverted lists: the terms of the queries meet the weighted
    terms of the cases on the term, so only pairs that share a term with a weight exist.
    A term that most cases have is dealt over all tasks, because the terms of the cases stay
    together by case: a task adds up its cases' weights itself, and only its best ``k`` of a
    query leave it.  Terms that all cases have weigh nothing and are left out; scores of
    zero are not hits.
    """
    pool = cases if category is None else cases.filter(F.col("case_type") == category)
    asked = materialise(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "asked-terms")
    frequency = materialise(pool.select("case_id", F.explode(tokens(F.col("text"))).alias("term"))
                            .join(asked.select("term").distinct(), "term", "left_semi")
                            .groupBy("case_id", "term").agg(F.count("*").alias("tf")), "case-terms")
    total = pool.select(F.count("*")).scalar()
    rarity = (frequency.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
              .select("term", F.pow(F.log10(total / F.col("df")), 2).alias("idf2")).filter("idf2 > 0"))
    # tables, so that joins are planned by their sizes
    weighted = materialise(asked.join(rarity, "term"), "weighted-terms")
    tasks = max(cases.sparkSession.sparkContext.defaultParallelism, -(-frequency.count() // TASK_TERMS))
    found = (frequency.repartition(tasks, "case_id").join(weighted, "term").groupBy("query_id", "case_id")
             .agg(F.round(F.sum(F.col("tf") * F.col("idf2")), ROUNDING).alias("similarity")).filter("similarity > 0"))
    return _merged(found, k)
