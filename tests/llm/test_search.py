"""Inner-product search, Merkle manifest and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import inner_products, lexical, merkle

VECTORS = "vec_id long, embedding array<float>, label int, score string, block int"


def products_by_hand(rows, k, scale=1024):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (query, q) in enumerate(usable):
        if query % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for m, (i, v) in enumerate(usable) if m != n)
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vector_rows(n, width, seed):
    random.seed(seed)
    base = [[random.gauss(0, 1) * 0.8 ** j for j in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [x + random.gauss(0, 0.2) for x in random.choice(base)]
        rows.append((i, [x * random.choice([0.1, 1, 3]) for x in v], 1, "s", 2))
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_rows": 7, "query_rows": 3, "stripe_rows": 20}])
def test_products_equal_brute_force(spark, settings):
    rows = vector_rows(700, 9, 1)
    rows += [(100, rows[0][1], 1, "s", 2), (100, rows[100][1], 1, "s", 2), (100, rows[100][1], 1, "s", 2)]  # repeated ids
    rows += [(3, rows[3][1], 1, "s", 2)] * 40 + [(None, rows[5][1], 1, "s", 2), (800, None, 1, "s", 2), (801, [], 1, "s", 2)]
    rows += [(900, [], None, None, None), (901, [1.0, None], 1, "s", 2), (902, [float("nan")] * 9, 1, "s", 2),
             (903, [float("-inf")] * 9, 1, "s", 2), (904, [0.5, 0.25], 1, "s", 2), (1000, [0.0] * 9, 1, "s", 2)]
    found = inner_products.top_inner_products(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0", k=10, **settings)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == products_by_hand(rows, 10)


def test_products_of_few_huge_and_equal_rows(spark):
    few = [(0, [1.0, 2.0], 1, "s", 2), (7, [3.0, -1.0], 1, "s", 2)]
    huge = [(0, [1e30, 1.0], 1, "s", 2), (1, [-1e30, 5.0], 1, "s", 2), (2, [3e7, 2e7], 1, "s", 2), (100, [2e7, 7.0], 1, "s", 2)]
    equal = [(i, [0.5, 0.5, 0.1], 1, "s", 2) for i in range(400)]
    for rows in (few, equal):
        found = inner_products.top_inner_products(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0")
        assert sorted(map(tuple, found.collect())) == products_by_hand(rows, 10)
    found = inner_products.top_inner_products(spark.createDataFrame(huge, VECTORS), "vec_id % 100 = 0").collect()
    bound = (1 << 63) - 1
    assert sorted(map(tuple, found)) == sorted(
        (q, r, i, min(max(s, -bound - 1), bound)) for q, r, i, s in products_by_hand(huge, 10))
    for rows in ([], [(1, [1.0], 1, "s", 2)]):
        assert inner_products.top_inner_products(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0").count() == 0
    with pytest.raises(ValueError):
        inner_products.top_inner_products(spark.createDataFrame(few, VECTORS), "vec_id = 0", k=0)


def test_bounds_prune_and_long_vectors_come_first():
    """Vectors that fall off in length end the search early, and the rotation leaves few pairs to score."""
    random.seed(2)
    turn = np.eye(16)
    lengths = [1000 * 0.98 ** i for i in range(600)]
    rows = np.array([[x * random.gauss(0, 1) * 0.5 ** j for j in range(16)] for x in lengths]).round()
    rows = rows[np.argsort(-np.sqrt((rows ** 2).sum(axis=1)))]
    query = np.array([[random.gauss(0, 100) * 0.5 ** j for j in range(16)] for _ in range(4)]).round()
    group = inner_products.QueryGroup([{"block": 0, "size": 4, "width": 16, "kind": 3, "ids": np.arange(4).tobytes(),
                                        "vectors": query.tobytes()}], turn, 5)
    met = 0
    for at in range(0, 600, 50):
        if group.done(float(np.sqrt((rows[at] ** 2).sum()))):
            break
        group.meet(np.arange(at, at + 50), rows[at:at + 50])
        met += 1
    assert met < 12 and group.compared < group.pairs / 2
    for i in range(4):
        best = sorted((-int(s), j) for j, s in enumerate(rows @ query[i]))[:5]
        assert [(-s, j) for s, j in zip(group.scores[i].tolist(), group.found[i].tolist())] == best


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_levels(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest(*rows[-1][i:i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def manifest_by_hand(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        fields = [doc_id, source, lang, n_chars, text]
        return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def siblings(levels, place):
        for level in levels[:-1]:
            yield place & 1, level[place ^ 1] if place ^ 1 < len(level) else ""
            place >>= 1

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = mine, tree_levels([leaf(*r) for r in mine])
    top = tree_levels([trees[lang][1][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        mine, levels = trees[lang]
        for place, r in enumerate(mine):
            path = [*siblings(levels, place), *siblings(top, number)]
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                changed = (*r[:4], r[4] + 1)
            node = leaf(*changed)
            for at_right, other in path:
                node = digest(other, node) if at_right else digest(node, other)
            out.append((r[0], leaf(*r), levels[-1][0], top[-1][0], digest(*[s for _, s in path]), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_equals_brute_force(spark, edge, levels):
    rows = [tuple(r) for r in edge.collect()]
    rows += [(i, f"text {i}", random.Random(i).choice(["en", "en", "en", "de", "é", "z", "", None]), "s", i) for i in range(100, 160)]
    df = spark.createDataFrame(rows, edge.schema).withColumns({"LEAF": F.lit(1), "tree": F.lit("x"), "n": F.lit(3)})
    found = merkle.tampered_documents(df, levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == manifest_by_hand(rows)


def test_manifest_of_small_and_repeated_tables(spark, empty, edge):
    assert merkle.tampered_documents(empty).count() == 0
    one = [(1, "only", "en", "a", 4)]
    same = [(5, "again", "en", "a", 5)] * 1000
    for rows in (one, same, [(i, "x", None, None, None) for i in range(33)]):
        found = merkle.tampered_documents(spark.createDataFrame(rows, edge.schema), 3)
        assert sorted(map(tuple, found.collect()), key=repr) == manifest_by_hand(rows)
    (r,) = merkle.tampered_documents(spark.createDataFrame(one, edge.schema)).collect()
    assert r["leaf"] == r["root"] == r["subroot"] and r["proof_sha256"] == digest()


def ranked_by_hand(docs, items, k):
    def terms(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]

    counted = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, n_terms = len(counted), sum(c[2] for c in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"shard_postings": 40, "block_terms": 5, "vocabulary_bytes": 0}])
def test_ranked_search_equals_brute_force(spark, edge, settings, monkeypatch):
    if settings:
        monkeypatch.setattr(lexical, "MERGED", 3)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)]
    docs = [(r[0], r[1]) for r in edge.collect()]
    docs += [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(100, 400)]
    docs += [(900 + i, docs[40][1]) for i in range(60)] + [(900, docs[41][1])] * 3  # ties, repeated ids
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(0, "The QUICK fox, ŻÓŁW żółw; word word"), (20, None), (21, " -- "), (None, "w1 w2"), (22, docs[40][1]), (23, "absent")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "ROW": F.lit(2), "n": F.lit(3)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    found = lexical.ranked_search(df, asked, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked_by_hand(docs, items, 20)


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, spark.createDataFrame([(1, "z")], items.schema))):
        assert lexical.ranked_search(d, i).count() == 0


def test_intervals_leave_most_documents_unvisited():
    """A rare pair of words is found without a look at the documents that have only the common one."""
    rng = np.random.default_rng(3)
    n = 5000
    common = (np.zeros(n, np.int64), np.arange(n), rng.integers(90, 100, n))
    rare = rng.choice(n, 60, replace=False)
    lists = [common, (np.ones(60, np.int64), rare, rng.integers(900, 1000, 60)),
             (np.full(30, 2), rare[:30], rng.integers(900, 1000, 30))]
    term, doc, impact = (np.concatenate(c) for c in zip(*lists))
    shard = lexical.Shard(term, doc, doc * 3, np.ones(len(doc), bool), impact)
    docs, scores = shard.search(np.array([0, 1, 2, 9]), np.array([1, 2, 1, 1]), 10, batch=1)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact * np.array([1, 2, 1])[term])
    best = sorted((-t, d) for d, t in enumerate(total.tolist()))[:10]
    assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == best
    assert shard.visited < 500


def test_terms_of_long_texts_come_in_pieces(monkeypatch):
    text = ("Ab-ab żó " * 50 + "x" * 300 + " ,").encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text) == whole
    assert whole[1] == 151 and whole[0][b"ab"] == 100
