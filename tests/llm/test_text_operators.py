"""BPE, token counts, licenses, fingerprints, quality rules and languages."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_rows import EDGE
from riskloom.llm import byte_bpe, fingerprints, language_id, license_scan, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def reference():
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


# --- byte-level BPE ---------------------------------------------------------------------------------

def check_bpe(df, reference):
    rows = byte_bpe.encode(df, decoded=True).collect()
    assert len(rows) == df.count()
    for r in rows:
        if len(r["text"] or "") > 40_000:
            continue
        ids = reference.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_equals_the_reference_tokenizer(documents, reference):
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    check_bpe(documents, reference)


def test_bpe_edge_rows(edge, reference):
    check_bpe(edge, reference)
    whole = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.encode(edge, decoded=True).collect()}
    assert whole[6] == EDGE[5][1].encode() and whole[11] == b"a" * 50_000


def test_bpe_odd_characters(spark, reference):
    rng = np.random.default_rng(4)
    parts = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", " ", " ", "1", "!", "é", "ß", "漢", "🙂", "A",
             "'s", "'LL", "\r\n", "́", "٣", "½", "\x1c", "‍"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(3000)]
    check_bpe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), reference)


def test_bpe_decode_and_unpack(documents, reference):
    coded = byte_bpe.encode(documents.limit(20))
    back = byte_bpe.decode(coded)
    for r in back.select("text", "decoded", byte_bpe.unpack_ids().alias("ids")).collect():
        assert bytes(r["decoded"]).decode() == r["text"] and r["ids"] == reference.encode_ordinary(r["text"])


def test_bpe_empty_and_clash(empty, spark):
    assert byte_bpe.encode(empty).count() == 0
    df = spark.createDataFrame([("x", "a b")], "N_Tokens string, text string")
    assert byte_bpe.encode(df).columns == ["text", "n_tokens", "token_ids"]


def test_model_gives_each_token_itself():
    data = byte_bpe.coder_data(byte_bpe.VOCABULARY)
    coder = byte_bpe.ByteBpe(data)
    for rank in range(0, len(data["tokens"]), 97):
        mapped = data["tokens"][rank].decode("latin-1").translate(coder.letters)
        assert coder.processor.encode(mapped) == [rank]


# --- token counts ------------------------------------------------------------------------------------

def counts_by_hand(text, sections, rule, tokenizer):
    counts = [0.0] * len(sections)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        overlap = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if not sum(overlap):
            continue
        touched = [i for i, o in enumerate(overlap) if o]
        if rule == "fraction":
            for i in touched:
                counts[i] += overlap[i] / sum(overlap)
        else:
            best = {"first": touched[0], "last": touched[-1], "majority": overlap.index(max(overlap))}[rule]
            counts[best] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_equal_tokenizer_offsets(documents, rule):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = documents.filter("doc_id % 3 = 0").select("doc_id", "text").union(
        documents.sparkSession.createDataFrame(
            [(-1, "naïve 🙂🙂\n\n\n  żółw\n \n漢字漢字\n\n"), (-2, "\n\n\na"), (-3, ""), (-4, None)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = {}
    for r in token_counts.count_by_section(df, rule, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = ((r["start"], r["end"]), r["n_tokens"])
    assert set(got) == set(texts)
    for name, text in texts.items():
        sections = [got[name][i][0] for i in range(len(got[name]))]
        assert "".join(text[a:b] for a, b in sections) == text
        want = counts_by_hand(text, sections, rule, tokenizer)
        assert [got[name][i][1] for i in range(len(sections))] == pytest.approx(want)


def test_counts_for_fields(spark):
    df = spark.createDataFrame([(1, "A title", "Body text here.\n\n", None), (2, None, None, "z")],
                               "doc_id long, title string, body string, foot string")
    built = token_counts.fields_as_sections(df, ["title", "body", "foot"], separator="\n\n")
    rows = token_counts.count_by_section(built, "majority", "sections").collect()
    assert [(r["doc_id"], r["name"]) for r in rows] == [(1, "title"), (1, "body"), (1, "foot"), (2, "title"), (2, "body"), (2, "foot")]
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [0, 0, 1]
    assert all(r["n_outside"] >= 0 for r in rows)


def test_counts_edge_rows(edge, empty):
    assert token_counts.count_by_section(empty).count() == 0
    total = token_counts.count_by_section(edge).agg(F.sum("n_tokens")).first()[0]
    assert total == byte_bpe.encode(edge).agg(F.sum("n_tokens")).first()[0]


# --- license scans -----------------------------------------------------------------------------------

def base_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    hits = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(hits)


LICENSED = [
    (1, "Released under the MIT License, MIT license."), (2, "GNU General-Public_License; apache LICENSE mit licenses"),
    (3, "Licensed under the Apache Licence, Version 2.0 (the x)"), (4, "éMIT license mit licenseé MIT\nLicense"),
    (5, "Permision is hereby granted, free of charge, to any persn obtaining a copy of this"), (6, None), (7, "mit"),
    (8, "Redistribution and use in sourse and binary forms, with or without modification, are permited provided"),
    (9, "license mit license mit license"), (10, ""),
]


def test_license_base_equals_brute_force(spark, documents, edge):
    own = spark.createDataFrame(LICENSED, "doc_id long, text string")
    for df in (own, documents.select("doc_id", "text"), edge.select("doc_id", "text")):
        for r in license_scan.scan_licenses(df).collect():
            n, hits = base_by_hand(r["text"])
            found = sorted((h["first_word"], h["label"]) for h in r["hits"] if h["exact"])
            assert (r["n_words"], found) == (n, hits)


def test_license_fuzzy_spans(spark):
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(LICENSED, "doc_id long, text string")).collect()}
    fuzzy = {i: [(h["label"], h["edits"], r["text"][h["start"]:h["end"]]) for h in r["hits"] if not h["exact"]]
             for i, r in rows.items()}
    assert ("apache-2.0", 1, "Licensed under the Apache Licence, Version 2.0") in fuzzy[3]
    assert ("mit", 2, "Permision is hereby granted, free of charge, to any persn obtaining a copy") in fuzzy[5]
    assert fuzzy[8][0][0] == "bsd" and fuzzy[8][0][1] == 2
    assert not fuzzy[7] and rows[7]["score"] == 0 and rows[1]["score"] == 1


def test_license_seeds_lose_nothing():
    """Any text within the allowed edits holds a seed: the scanner finds what whole-text matching finds."""
    rng = np.random.default_rng(2)
    scanner = license_scan.LicenseScanner({}, license_scan.NOTICES)
    for notices in license_scan.NOTICES.values():
        for notice in notices:
            errors = max(1, (notice.count(" ") + 1) // license_scan.WORDS_PER_ERROR)
            for _ in range(5):
                letters = list(notice)
                for at in rng.choice(len(letters), rng.integers(0, errors + 1), replace=False):
                    letters[at] = rng.choice(list("qxz")) if letters[at] != " " else " "
                text = "before it " + "".join(letters) + " and after"
                whole = regex.search(rf"(?:{regex.escape(notice)}){{e<={errors}}}", text)
                assert bool(whole) == bool(scanner.scan(text.encode())[1])


def test_license_notices_that_repeat_their_words():
    """A later seed may stand earlier in its notice; nothing that a search of the whole text finds is lost."""
    rng = np.random.default_rng(8)
    notice = "free to use free to copy free to use and free to share free to use"
    scanner = license_scan.LicenseScanner({}, {"own": (notice,)})
    (_, _, errors, pattern), = scanner.notices
    found = 0
    for _ in range(300):
        words = notice.split()
        letters = list(" ".join(words[rng.integers(0, 3):]) if rng.random() < 0.3 else notice)
        for at in rng.choice(len(letters), rng.integers(0, errors + 2), replace=False):
            letters[at] = rng.choice(list("qxz"))
        text = " ".join(rng.choice(words, rng.integers(0, 8))) + " " + "".join(letters) + " " + " ".join(rng.choice(words, rng.integers(0, 8)))
        text = " ".join(text.split())
        whole, at = [], 0
        while (match := pattern.search(text, at)) and match.end() > match.start():
            whole.append(text.count(" ", 0, match.start()))
            at = match.end()
        assert [h["first_word"] for h in scanner.scan(text.encode())[1]] == whole
        found += len(whole)
    assert found > 200


def test_license_of_a_long_text():
    """Time grows with the length, also where all of it is hits."""
    scanner = license_scan.LicenseScanner(license_scan.PHRASES, license_scan.NOTICES)
    began = time.time()
    n, hits = scanner.scan(b"MIT license, " * 150_000)
    assert n == 300_000 and len(hits) == 150_000 and hits[-1]["first_word"] == 299_998 and hits[-1]["end"] == 13 * 150_000 - 2
    assert time.time() - began < 60


# --- fingerprints ------------------------------------------------------------------------------------

def test_neighbours_equal_brute_force(documents, edge, spark):
    for df in (documents, edge.filter("doc_id is not null").dropDuplicates(["doc_id"]), documents.limit(1)):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), reverse=True)
        got = {r["doc_id"]: r for r in fingerprints.edited_neighbours(df).collect()}
        assert len(got) == len(rows)
        prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
        for n, (name, text) in enumerate(rows):
            other = rows[(n + 1) % len(rows)]
            third = len(text) // 3
            edited = text[:len(text) - third] + other[1][:third]
            r = got[name]
            assert r["n_chars"] == len(text) and r["fingerprint"] == prints[name]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b = (fingerprints.from_text(r[c]) for c in ("fingerprint", "edited_fingerprint"))
            assert r["near_edited"] == fingerprints.resemblance(a, b)
            assert r["near_next"] == fingerprints.resemblance(a, fingerprints.from_text(prints[other[0]]))


def test_neighbours_of_many_rows_without_id(spark):
    """Rows that share an id, or have none, are dealt over ranges and still form one ring."""
    rows = [(None if i % 3 else (7 if i % 2 else i), f"text {i % 997} " * 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_neighbours(df).collect()
    hashed = df.withColumn("h", F.xxhash64("text")).collect()
    ring = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = collections.Counter()
    for r, other in zip(ring, ring[1:] + ring[:1]):
        third = len(r["text"]) // 3
        edited = r["text"][:len(r["text"]) - third] + other["text"][:third]
        want[r["doc_id"], hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    keyed = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("hash"))
    cuts = fingerprints.Cuts(keyed, 32)
    places = keyed.toPandas()
    assert np.bincount(cuts.ranges(places["key"].to_numpy(), places["hash"].to_numpy())).max() < 400


def test_neighbours_odd_rows(edge, empty):
    assert fingerprints.edited_neighbours(empty).count() == 0
    assert fingerprints.edited_neighbours(edge).count() == len(EDGE)


def grams(text, k=5):
    w = WORD.findall(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprint_estimates(documents):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint(documents).collect()}
    ids = sorted(rows)[:60]
    for i in ids:
        true, sketch = grams(rows[i]["text"]), fingerprints.from_text(rows[i]["fingerprint"])
        assert abs(rows[i]["n_distinct"] - len(true)) <= 0.5 * len(true)
        for j in ids:
            other = grams(rows[j]["text"])
            union = len(true | other)
            real = len(true & other) / union if union else 1.0
            assert abs(fingerprints.resemblance(sketch, fingerprints.from_text(rows[j]["fingerprint"])) - real) < 0.2


def test_fingerprint_merge(documents):
    found = fingerprints.fingerprint(documents).select("source", "fingerprint")
    merged = {r["source"]: r["fingerprint"] for r in fingerprints.merged(found, ["source"]).collect()}
    by_hand = {}
    for r in found.collect():
        sketch = fingerprints.from_text(r["fingerprint"])
        by_hand[r["source"]] = fingerprints.merge(by_hand.get(r["source"], sketch[:0]), sketch)
    assert {s: fingerprints.to_text(v) for s, v in by_hand.items()} == merged
    one = fingerprints.from_text(found.first()["fingerprint"])
    assert fingerprints.containment(one, one) == 1.0 and fingerprints.containment(one[:0], one) == 1.0


# --- quality rules -----------------------------------------------------------------------------------

def measures_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again = {}, [False] * len(w)
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                again[p:p + 3] = [True] * 3
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(again))


def test_quality_measures_equal_brute_force(documents, edge):
    for df in (documents, edge):
        for r in quality_rules.apply_rules(df).collect():
            base = measures_by_hand(r["text"])
            assert tuple(r[n] for n in quality_rules.BASE) == base
            assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"])


def test_quality_order_does_not_change_the_verdict(documents):
    names = [r.name for r in quality_rules.production_rules()]
    one = quality_rules.apply_rules(documents, order=names).select("doc_id", "kept").collect()
    two = quality_rules.apply_rules(documents, order=names[::-1]).select("doc_id", "kept").collect()
    assert sorted(one) == sorted(two)


def test_quality_order_follows_rejection_per_cost(documents, empty):
    rules = [quality_rules.Rule("never", lambda m: False), quality_rules.Rule("always", lambda m: True),
             quality_rules.Rule("dear", lambda m: sum(range(20_000)) > 0)]
    assert quality_rules.rule_order(documents, rules) == ["always", "dear", "never"]
    assert len(quality_rules.rule_order(empty, rules)) == 3
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_keeps_good_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id")
    good, bad = judged.filter("quality = 1 and not base_failed"), judged.filter("quality = 0")
    assert good.filter("kept").count() >= 0.97 * good.count()
    assert bad.filter("kept").count() <= 0.5 * bad.count()


# --- language identification ---------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(F.col("doc_id"))
    rows = docs.select("doc_id", out.alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    found = language_id.identify(docs, language_id.fit(docs.filter(~out))).filter(out).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.03
    assert (found.lang == found.lang_pred)[~found.rejected].mean() > 0.99


def test_language_edge_rows(spark, edge, empty, documents):
    dictionaries = language_id.fit(documents)
    assert set(dictionaries) == {r["lang"] for r in documents.select("lang").distinct().collect()}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "é")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_id.identify(odd, dictionaries).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] in dictionaries
    assert all(rows[i]["rejected"] and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert language_id.identify(edge, dictionaries).count() == len(EDGE)
    assert language_id.fit(empty) == {} and language_id.identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_language_sample_is_bounded(documents):
    small = language_id.fit(documents, sample_rows=20, dictionary_bytes=500)
    assert all(len(v) <= 500 for v in small.values())


def test_language_sample_holds_every_language(spark):
    # two labelled rows of 10 000, and a language whose rows have no id
    rows = spark.range(9_990).select("id", F.concat(F.lit("the word number "), F.col("id").cast("string")).alias("text"),
                                     F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(10_001, "zażółć gęślą jaźń", "pl"), (10_002, "święto łąki", "pl"),
                                  *[(None, f"ein deutscher satz {i}", "de") for i in range(8)]],
                                 "id long, text string, lang string")
    docs = rows.unionByName(rare).withColumnRenamed("id", "doc_id")
    assert set(language_id.fit(docs, sample_rows=30)) == {"en", "pl", "de"}


def test_language_sizes_equal_fresh_compressors(spark, documents, edge):
    """Prediction and margin of every text from a new compressor for each block and language."""
    labelled = documents.filter(~language_id.held_out(F.col("doc_id")))
    dictionaries = language_id.fit(labelled)
    df = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text")).limit(60)
    letters = {(r["doc_id"], r["text"]): r["t"] for r in df.withColumn("t", language_id.letters_only(F.col("text"))).collect()}
    for r in language_id.identify(df, dictionaries).collect():
        text, sizes = letters[r["doc_id"], r["text"]], {}
        if not text:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        for language, content in dictionaries.items():
            sizes[language] = 0
            for at in range(0, len(text), language_id.BLOCK_CHARS):
                settings = zstandard.ZstdCompressionParameters.from_level(
                    language_id.LEVEL, min_match=language_id.MIN_MATCH, write_content_size=False, write_checksum=False,
                    write_dict_id=False, source_size=language_id.BLOCK_CHARS, dict_size=len(content))
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                fresh = zstandard.ZstdCompressor(dict_data=words, compression_params=settings)
                sizes[language] += len(fresh.compress(text[at:at + language_id.BLOCK_CHARS].encode()))
        first, second = sorted((n, language) for language, n in sizes.items())[:2]
        assert r["lang_pred"] == first[1] and r["score"] == 1.0 - first[0] / second[0]
        assert r["rejected"] == (r["score"] < language_id.MIN_MARGIN)
