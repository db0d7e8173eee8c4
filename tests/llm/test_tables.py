"""Mixing, sharding and the pipeline against brute force and SQL."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from llm_rows import EDGE
from riskloom.llm import byte_bpe, language_id, mixing, oracles, sharding
from test_dedup import cut_by_hand, groups_by_hand


# --- mixing ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A hot source with more than half of all tokens, small ones, and one without a name."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        source = "hot" if i % 5 < 3 else rng.choice(["b", "c", "d", None]) if i % 50 else "tiny"
        rows.append((i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute_alpha(shares, target, max_epochs, budget_share=1.0):
    """The exponent by plain bisection."""
    def weights(a):
        w = [p ** a for p in shares]
        return [x / sum(w) for x in w]

    def entropy(a):
        return -sum(x * math.log(x) for x in weights(a)) / math.log(len(shares)) if len(shares) > 1 else 1.0

    def repeats(a):
        return max(budget_share * w / p for w, p in zip(weights(a), shares))

    low, high = 0.0, 1.0
    if entropy(1.0) >= target:
        low = 1.0
    else:
        for _ in range(20):
            middle = (low + high) / 2
            low, high = (middle, high) if entropy(middle) >= target else (low, middle)
    need, top = 0.0, 1.0
    if repeats(0.0) > max_epochs:
        for _ in range(20):
            middle = (need + top) / 2
            need, top = (middle, top) if repeats(middle) > max_epochs else (need, middle)
        need = top
    return max(low, need)


@pytest.mark.parametrize("target, epochs", [(0.95, 4.0), (0.99, 1.5), (1.0, 100.0), (0.1, 2.0)])
def test_exponent_equals_bisection(spark, target, epochs):
    tokens = [100_000, 2_000, 1_500, 900, 40]
    shares = [t / sum(tokens) for t in tokens]
    found = mixing.exponent(spark.createDataFrame([(p,) for p in shares], "p double"), target, epochs, 1.0)
    assert found == pytest.approx(brute_alpha(shares, target, epochs), abs=3e-6)


def test_mixture_holds_weights_in_every_block(skewed):
    rows = mixing.mix(skewed, block_tokens=2_000).collect()
    tokens = collections.Counter()
    for r in skewed.collect():
        tokens[r["source"] or ""] += len(r["text"].split())
    total = sum(tokens.values())
    alpha = brute_alpha([t / total for t in tokens.values()], mixing.TARGET_ENTROPY, mixing.MAX_EPOCHS)
    z = sum((t / total) ** alpha for t in tokens.values())
    blocks = collections.defaultdict(collections.Counter)
    for r in rows:
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    for source, t in tokens.items():
        budget = math.floor((t / total) ** alpha / z * total + 0.5)
        drawn = sum(b[source] for b in blocks.values())
        assert budget <= drawn < budget + 40
        for b in blocks.values():
            assert abs(b[source] - budget / len(blocks)) < 80
    epochs = collections.defaultdict(list)
    for r in rows:
        epochs[r["source"], r["doc_id"]].append(r["epoch"])
    last = {s: max(e for (x, _), es in epochs.items() if x == s for e in es) for s in tokens}
    for (source, _), seen in epochs.items():
        assert sorted(seen) in (list(range(last[source])), list(range(last[source] + 1)))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["block"]].append(r["slot"])
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in slots.values())


def test_mixture_equals_sql_on_skewed_sources(skewed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 37)  # many ranges of the hash order
    names = ["doc_id", "source", "n_tokens", "epoch", "block", "slot"]
    got = sorted(tuple(r[n] for n in names) for r in mixing.mix(skewed).collect())
    con = duckdb.connect()
    con.register("documents", skewed.toArrow())
    sql = con.execute(f"select {', '.join(names)} from ({oracles.ORACLES['op1_temperature_mixing']})").fetchall()
    assert got == sorted(sql)


def test_mixture_edge_rows(edge, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(edge, block_tokens=100).collect()
    assert {r["source"] for r in rows} <= {"", "a", "b", "c", "d"} and all(r["n_tokens"] > 0 for r in rows)
    mixed = mixing.mixed_documents(edge, target_entropy=0.1)
    assert mixed.columns == edge.columns
    # with natural weights each row with words comes once, repeated rows included
    assert mixed.count() == sum(1 for r in EDGE if (r[1] or "").strip())


@pytest.mark.parametrize("most", [mixing.MOST_RANGES, 0])
def test_mixed_documents_are_in_the_order_of_the_plan_and_only_copies_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    monkeypatch.setattr(mixing, "MOST_RANGES", most)
    rows = [(i if i % 9 else None, f"s{i % 3 if i % 4 else 0}" if i % 31 else None, " ".join(["w"] * (i % 23)) + f" {i % 700}", f"x{i}")
            for i in range(900)] + [(5, "s1", "same text here", f"y{i % 2}") for i in range(40)] + [(7, "s2", None, "z"), (8, "s2", " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra string").repartition(3)
    plan = [r["doc_id"] for r in mixing.mix(docs, block_tokens=300).orderBy("block", "slot").collect()]
    mixed = mixing.mixed_documents(docs, block_tokens=300)
    text = mixed._jdf.queryExecution().optimizedPlan().toString()
    # the texts meet narrow tables that go to every task; only equal rows meet the places
    assert ("Union" in text and text.count("strategy=broadcast") >= 4) == (most > 0)
    got = mixed.collect()
    assert [r["doc_id"] for r in got] == plan and len(plan) > 500
    assert set(map(tuple, got)) <= set(rows)
    assert sum(r["text"] == "same text here" for r in got) == sum(i == 5 for i in plan) - sum(r["doc_id"] == 5 and r["text"] != "same text here" for r in got)


def test_mixed_documents_follow_the_plan(skewed):
    plan = collections.Counter(r["doc_id"] for r in mixing.mix(skewed).collect())
    docs = mixing.mixed_documents(skewed)
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == plan
    assert docs.exceptAll(skewed.join(docs.select("doc_id"), "doc_id").select(*skewed.columns)).count() == 0


# --- sharding ----------------------------------------------------------------------------------------

def shards_by_hand(rows, shards, overhead=8):
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + overhead)
                    for i, t in rows))
    total, before, out, slots = sum(s[3] for s in sized), 0, [], collections.Counter()
    for known, i, crc, size in sized:
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def test_shards_equal_brute_force(documents, edge):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[4])
    for df, shards in ((documents, 24), (edge, 24), (edge, 3), (documents.repartition(9), 5)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sharding.balanced_shards(df, shards).collect()
        assert sorted((tuple(r[n] for n in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in got), key=key) \
            == sorted(shards_by_hand(rows, shards), key=key)


def test_shards_are_near_equal(documents):
    sizes = sharding.balanced_shards(documents).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    largest = sharding.balanced_shards(documents).agg(F.max("size")).first()[0]
    mean = sum(r["n"] for r in sizes) / 24
    assert all(abs(r["n"] - mean) <= largest for r in sizes)


def test_shards_empty_and_written(spark, empty, documents, tmp_path):
    assert sharding.balanced_shards(empty).count() == 0
    plan = sharding.balanced_shards(documents, 4)
    sharding.write_shards(documents, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and set(documents.columns) < set(back.columns)


def test_rows_without_id_and_equal_rows_are_spread(spark, monkeypatch, tmp_path):
    """Rows of one id fall into many ranges, and m equal rows come out m times without meeting each other."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    rows = [(None, f"word{i} two", "s", i) for i in range(10_000)] + [(3, "same text here", "s", 1)] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    plan = mixing.mix(docs, block_tokens=4_000)
    assert plan.count() == 12_000 and plan.select("block", "slot").distinct().count() == 12_000
    starts = plan.filter("doc_id is null").groupBy("block").count().collect()
    assert len(starts) == 7 and min(r["count"] for r in starts) > 1_000
    assert sorted(map(tuple, mixing.mixed_documents(docs).collect()), key=repr) == sorted(rows, key=repr)
    sharding.write_shards(docs, sharding.balanced_shards(docs, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "text", "source").exceptAll(docs.select("doc_id", "text", "source")).count() == 0
    assert back.count() == 12_000 and back.select("shard", "slot").distinct().count() == 12_000


# --- pipeline ----------------------------------------------------------------------------------------

def test_stages_equal_brute_force(spark, documents, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "mixing", "byte_bpe"]

    def rows(df):
        return [tuple(r) for r in df.collect()]

    told = stages["language_id"](spark, documents, sf_dir)
    assert told.columns == documents.columns and told.exceptAll(documents).count() == 0
    model = language_id.CompressionClassifier(language_id.fit(documents.filter(~language_id.held_out(F.col("doc_id")))))
    letters = documents.select("doc_id", language_id.letters_only(F.col("text")).alias("t")).collect()
    clear = {r["doc_id"] for r in letters if (c := model.classify(r["t"]))[0] != "und" and c[1] >= language_id.MIN_MARGIN}
    assert {r["doc_id"] for r in told.collect()} == clear

    near = stages["near_dedup"](spark, told, sf_dir)
    groups = groups_by_hand([(r["doc_id"], r["text"]) for r in told.collect()], 5)
    assert sorted(rows(near)) == sorted(r for r in rows(told) if groups[r[0]] == r[0])

    cut = stages["substring_dedup"](spark, near, sf_dir)
    before = [(r["doc_id"], r["text"]) for r in near.collect()]
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == documents.columns
    for (name, text), (_, gone, kept) in zip(before, cut_by_hand(before)):
        assert re.findall(r"[^\x20\x09-\x0D]+", after[name]) == kept.split(" ") if kept else not after[name].strip()
        assert gone or after[name] == text

    mixed = stages["mixing"](spark, cut, sf_dir)
    plan = collections.Counter(r["doc_id"] for r in mixing.mix(cut).collect())
    assert mixed.columns == documents.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == plan

    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                  mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coded = stages["byte_bpe"](spark, mixed, sf_dir).collect()
    assert len(coded) == mixed.count()
    for r in coded:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == reference.encode_ordinary(after[r["doc_id"]])


def test_stages_take_odd_rows(spark, edge, empty, sf_dir):
    for df in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
            df.collect()


def test_stages_send_long_texts_in_small_batches(spark, empty, sf_dir):
    """Each batch of 10,000 texts stood several times in the memory of an executor and its workers."""
    docs = spark.range(40, numPartitions=1).select(F.expr("repeat('ab cd ', 100000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        try:
            stage(spark, empty, sf_dir)
            found = docs.mapInArrow(sizes, "n long, bytes long").collect()
            spark.conf.set(name, "1m")  # a smaller setting stays
            stage(spark, empty, sf_dir)
            assert spark.conf.get(name) == "1m"
        finally:
            spark.conf.unset(name)
        assert sum(r.n for r in found) == 40 and max(r.bytes for r in found) <= corpus_pipeline.BATCH_BYTES + 700_000
