"""Substring dedup and near-dedup against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import near_dedup, substring_dedup, support
from riskloom.llm.textbytes import WordHasher, joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def cut_by_hand(rows, width=20):
    """Kept words of (id, text) rows; ids may repeat or be None."""
    words = [(i if i is not None else -(1 << 63), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for name, w in words:
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            first[key] = min(first.get(key, (name, p)), (name, p))
    out = []
    for name, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < (name, p):
                gone[p:p + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check_cut(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"])
                 for r in substring_dedup.remove_repeats(df, "words").collect())
    want = sorted((i is not None, i or 0, *c) for (i, _), c in zip(rows, cut_by_hand(rows)))
    assert got == want


def test_cut_edge_rows(edge):
    check_cut(edge)


def test_cut_documents(documents):
    check_cut(documents)


def test_cut_random_alignments(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))]
        a = rng.randint(0, 40)
        w += passage[a:a + rng.choice([8, 19, 20, 21, 33, 60])]
        w += [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        if i % 7 == 0:
            w += w[:25]
        rows.append((i, " ".join(w)))
    check_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_cover_aligns_any_two_positions():
    cover, period = set(substring_dedup.COVER), substring_dedup.PERIOD
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))
    assert period - 1 + substring_dedup.ANCHOR <= substring_dedup.WINDOW


def test_cut_small_flushes(documents, monkeypatch):
    # many flushes: judgement between flushes and between tasks
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", 300)
    check_cut(documents.repartition(5))


def test_text_form_keeps_clean_texts(documents):
    cut = {r["doc_id"]: r for r in substring_dedup.remove_repeats(documents).collect()}
    words = {r["doc_id"]: r for r in substring_dedup.remove_repeats(documents, "words").collect()}
    for r in documents.collect():
        assert WORD.findall(cut[r["doc_id"]]["text"]) == words[r["doc_id"]]["text"].split()
        if not cut[r["doc_id"]]["n_removed"]:
            assert cut[r["doc_id"]]["text"] == r["text"]


def test_cut_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", 7)], "doc_id long, text string, N_Words long, rest string, id long")
    out = substring_dedup.remove_repeats(df)
    assert out.columns == ["text", "n_words", "n_removed", "doc_id", "rest", "id"]
    assert out.first()["n_words"] == 2 and out.first()["rest"] == "x" and out.first()["id"] == 7


def test_cut_unlike_lengths_under_one_id(spark):
    # places of the long texts lie far behind the end of the short ones; the last row repeats all of them
    def own(name, n):
        return [f"{name}{i}" for i in range(n)]

    passage = own("p", 40)
    long_one, long_null = own("a", 900) + passage + own("b", 30), own("c", 700) + passage
    short_one, short_null = own("d", 25) + passage[:5], passage[5:30]
    rows = [(7, long_one), (7, short_one), (7, own("e", 20)), (None, long_null), (None, short_null), (None, own("f", 21)),
            (None, short_null), (9, long_one[880:930] + short_one + own("f", 21))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for parts in (1, 3):
        check_cut(df.repartition(parts))


def test_cut_empty_table(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups_by_hand(rows, k=4, percent=80):
    """Component of each id by all pairs; rows of one id are one document."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in parent}


def check_groups(df, k=4):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = groups_by_hand(rows, k)
    expected = sorted((i is not None, i or 0, len(shingles(t, k)), want.get(i) is not None, want.get(i) or 0,
                       i is None or want[i] == i) for i, t in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] is not None,
                  r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(df, k).collect())
    assert got == expected


def test_groups_edge_rows(edge):
    check_groups(edge)


def test_groups_documents(documents):
    check_groups(documents)


def test_groups_chain_and_threshold(spark):
    """A chain in which only neighbours are similar enough, and pairs just above and below the limit."""
    rng = random.Random(11)
    text = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(text)))
        at = rng.randrange(len(text))
        text = text[:at] + [f"n{i}"] + text[at + 1:]
    for edits in range(0, 14):
        base = [f"b{edits}_{i}" for i in range(153)]
        other = list(base)
        for e in range(edits):
            other[e * 10 + 4] = f"z{e}"
        rows += [(2000 + 2 * edits, " ".join(base)), (2001 + 2 * edits, " ".join(other))]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_groups_empty_table(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_drop_keeps_columns_and_smallest(documents):
    kept = near_dedup.drop_near_duplicates(documents)
    want = groups_by_hand([(r["doc_id"], r["text"]) for r in documents.collect()], 5)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    sketch = near_dedup.SetSketch(252)
    a, b = rng.integers(0, 2**64, 900, dtype=np.uint64), rng.integers(0, 2**64, 700, dtype=np.uint64)
    both = np.concatenate([a, b])
    assert (near_dedup.merge_registers(sketch.registers(a), sketch.registers(b)) == sketch.registers(both)).all()
    for shared in (0, 300, 600, 800):
        left, right = both[:1000], both[1000 - shared:1000 - shared + 1000 - 400 + shared]
        true = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
        found = near_dedup.likely_resemblance(sketch.registers(left)[None], sketch.registers(right)[None],
                                              np.array([len(left)]), np.array([len(right)]))[0]
        assert abs(found - true) < 0.12


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, size):
    from riskloom.llm import textbytes
    texts = [b"alpha beta", b"", b" gamma", b"alpha", b"x" * 9000 + b" beta"]
    whole = WordHasher().words(*joined(texts))
    monkeypatch.setattr(textbytes, "PIECE", size)
    parts = WordHasher().words(*joined(texts))
    assert all((x == y).all() for x, y in zip(whole, parts))
    assert whole[0][0] == whole[0][3] and whole[0][1] == whole[0][5] and len(whole[0]) == 6


def test_counts_by_shared_shingles(documents):
    """Every linked pair of different texts is in one component (found through shared shingles)."""
    rows = documents.select("doc_id", "text").collect()
    held = collections.defaultdict(list)
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in rows}
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = collections.Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    component = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents).collect()}
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            assert component[a] == component[b]


def test_window_count_is_per_row(documents):
    assert near_dedup.near_duplicates(documents).agg(F.count("*")).first()[0] == documents.count()


def thue_morse(letters):
    """A word of 2048 letters; a polynomial hash modulo 2**64 cannot tell it from its complement."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return "".join(letters[b] for b in bits)


def test_words_are_told_apart(spark):
    one, two = thue_morse("ab"), thue_morse("ba")
    hashes, _, _, _ = WordHasher().words(*joined([f"{one} {two}".encode()]))
    assert hashes[0] != hashes[1]
    again, _, _, _ = WordHasher(seed=1).words(*joined([f"{one} {two}".encode()]))
    assert len({*hashes.tolist(), *again.tolist()}) == 4
    rest = " ".join(f"w{i}" for i in range(25))
    cut = substring_dedup.remove_repeats(spark.createDataFrame(
        [(1, f"{rest[:60]} {one} {rest[60:]}"), (2, f"{rest[:60]} {two} {rest[60:]}")], "doc_id long, text string"))
    assert [r["n_removed"] for r in cut.collect()] == [0, 0]
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    # runs of two words in the same pattern differ as well
    texts = [thue_morse(["x ", "y "]).encode(), thue_morse(["y ", "x "]).encode()]
    hasher = WordHasher()
    words, _, _, first = hasher.words(*joined(texts))
    for k in (16, 512):
        assert hasher.runs(words[:first[1]], k)[0] != hasher.runs(words[first[1]:], k)[0]


def test_strangers_meet_a_large_component_once(spark):
    """A bucket of one large component and a stranger costs its members, not their pairs."""
    facts = ["n long", "own long", *[f"{s} long" for s in near_dedup.SIGNATURE]]
    rows = [(0, 7, i, 1) for i in range(1, 3001)] + [(0, 7, 0, 0), (0, 7, 4000, 4000), (1, 8, 5, 1), (1, 8, 6, 6)]
    df = spark.createDataFrame([(*r, 5, 0, *[0] * 8) for r in rows], f"band int, key long, id long, component long, {', '.join(facts)}")
    met = near_dedup._met(df)
    assert met.count() == 2 * 3000 + 1 + 1
    pairs = {(max(r["id"], r["id_v"]), min(r["id"], r["id_v"])) for r in met.collect()}
    assert len(pairs) == 6002 and {(4000, 0), (6, 5), (1, 0), (4000, 3000)} <= pairs


@pytest.mark.parametrize("bits", [support.SIEVE_BITS, 15])
def test_rows_are_parted_by_ids_without_a_shuffle_of_the_others(spark, monkeypatch, bits):
    monkeypatch.setattr(support, "SIEVE_BITS", bits)  # also with more ids than bits
    rows = [(i % 30_000 - 5_000 if i % 11 else None, f"t{i}") for i in range(40_000)]
    wanted = set(range(-5_000, 25_000, 40)) if bits > 15 else set(range(-5_000, 25_000))
    df = spark.createDataFrame(rows, "`a.id` long, text string")
    ids = spark.createDataFrame([(i,) for i in wanted], "id long")
    near, far = support.parted_by_ids(df, support.col("a.id"), ids)
    assert near.columns == far.columns == df.columns
    near, far = near.collect(), far.collect()
    assert collections.Counter(map(tuple, near + far)) == collections.Counter(rows)
    assert not wanted & {r[0] for r in far} and None not in {r[0] for r in near}
    if bits > 15:
        assert sum(r[0] not in wanted for r in near) < 0.1 * len(rows)


def test_documents_alone_in_their_buckets_are_not_shuffled(spark, monkeypatch):
    """Only the texts that share a bucket, and the rows that may be dropped, meet others."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[3]), (1001, texts[7] + " more"), (None, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    table = support.Scratch.table

    def recorded(self, df, name):
        out = table(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(support.Scratch, "table", recorded)
    kept = near_dedup.drop_near_duplicates(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftAnti") == 1  # the others stand beside the join
    assert seen["bucket-sketches"] < 20 and seen["texts"] < 20
    # a row without id takes no part, whatever its text
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(
        [(i, t) for i, t in rows if i not in (1000, 1001)])
