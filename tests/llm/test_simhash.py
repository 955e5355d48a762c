import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.docs import ENGLISH, documents, empty, odd, rows, with_extra
from weftline.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\W_]+", text.lower())
    digests = [int.from_bytes(hashlib.md5(w.encode()).digest(), "big") for w in set(words)]
    return sum(1 << b for b in range(128) if 2 * sum(d >> b & 1 for d in digests) > len(digests)), len(words)


def brute_groups(texts, max_bits=simhash.MAX_BITS, ratio=simhash.MIN_LENGTH_RATIO):
    prints = {i: fingerprint(t) for i, t in texts if i is not None and t and re.search(r"[^\W_]", t)}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, n), (y, m) = prints[a], prints[b]
            if (x ^ y).bit_count() <= max_bits and min(n, m) >= ratio * max(n, m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in ids if find(i) != i}


def corpus(seed=0, base=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 300))] for _ in range(base)]
    for _ in range(base):
        words = list(rng.choice(texts[:base]))
        for k in range(len(words)):
            if rng.random() < rng.choice([0.0, 0.02, 0.05]):
                words[k] = rng.choice(vocabulary)
        texts.append(words)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def test_fingerprints_match_their_definition():
    for text in (ENGLISH, "one", "Ünïcode ça và 12", "a a b"):
        got, n = simhash.Fingerprinter().of(text)
        assert (int.from_bytes(got, "big"), n) == fingerprint(text)
    assert simhash.Fingerprinter().of(" ?! ") is None and simhash.Fingerprinter().of(None) is None


def test_groups_match_brute_force(spark):
    texts = corpus()
    found = simhash.near_duplicates(documents(spark, [(i, t, "en", "a") for i, t in texts]))
    assert {tuple(r) for r in found.collect()} == brute_groups(texts)


def close_pairs(hi, lo, words, max_bits, ratio):
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    far = np.bitwise_count(hi[:, None] ^ hi).astype(int) + np.bitwise_count(lo[:, None] ^ lo)
    return np.argwhere(np.triu((far <= max_bits) & (np.minimum(words[:, None], words) >= ratio * np.maximum(words[:, None], words)), 1))


def plain_roots(hi, lo, words, max_bits, ratio):
    plain = simhash.Forest(len(hi))
    pairs = close_pairs(hi, lo, words, max_bits, ratio)
    plain.join(pairs[:, 0], pairs[:, 1])
    return plain.root


def ring_roots(hi, lo, words, max_bits, ratio):
    forest = simhash.Forest(len(hi))
    for start, (half, shift, size) in enumerate(simhash.parts_of(max_bits)):
        bucket = (((hi, lo)[half].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.int64)
        root = simhash.link(bucket, np.full(len(hi), start), np.ones(len(hi), np.int8), hi, lo, words, max_bits, ratio)
        forest.join(np.arange(len(hi)), root)
    return forest.root


def planted(rng, groups, size, most):
    """Fingerprints in chains whose links differ in up to ``most`` bits."""
    rows = []
    for _ in range(groups):
        bits = rng.integers(0, 2, 128, dtype=np.uint8)
        for _ in range(size):
            bits = bits.copy()
            bits[rng.permutation(128)[: rng.integers(0, most + 1)]] ^= 1
            rows.append(np.packbits(bits))
    halves = np.stack(rows).view(">i8").astype(np.int64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), rng.integers(50, 80, len(rows)).astype(np.int32)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 5, 12, 20, 25])
def test_ring_of_tries_is_exact(max_bits):
    rng = np.random.default_rng(max_bits)
    hi, lo, words = planted(rng, 60, 8, max_bits + 6)
    assert (ring_roots(hi, lo, words, max_bits, 0.8) == plain_roots(hi, lo, words, max_bits, 0.8)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 24))
def test_any_pair_within_the_budget_has_a_chain(seed, max_bits):
    rng = np.random.default_rng(seed)
    parts = simhash.parts_of(max_bits)
    assert sum(p[2] for p in parts) == 128 and all(s + n <= 64 for _, s, n in parts)
    hi, lo, words = planted(rng, 1, 2, 0)
    flips = np.zeros(128, np.uint8)
    flips[rng.permutation(128)[:max_bits]] = 1
    other = np.packbits(flips).view(">i8").astype(np.int64)
    hi[1], lo[1] = hi[0] ^ other[0], lo[0] ^ other[1]
    assert (ring_roots(hi, lo, np.ones(2, np.int32), max_bits, 0.5) == 0).all()


def test_large_groups_are_split(monkeypatch):
    monkeypatch.setattr(simhash, "_PAIRS", 64)
    rng = np.random.default_rng(1)
    hi, lo, words = planted(rng, 3, 150, 9)
    assert (ring_roots(hi, lo, words, 20, 0.9) == plain_roots(hi, lo, words, 20, 0.9)).all()


@pytest.mark.parametrize("most", [1 << 19, 8, 1])
def test_every_depth_of_the_buckets_is_exact(spark, monkeypatch, most):
    """Also where buckets overflow, so that nodes of two and three parts are spread."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
    monkeypatch.setattr(simhash.depth_for, "__defaults__", (most,))
    rng = np.random.default_rng(4)
    hi, lo, words = planted(rng, 50, 6, 24)
    hi[100:200] = hi[0] ^ (rng.integers(0, 2**20, 100) & rng.integers(0, 2**20, 100))  # a bucket that is hot
    prints = spark.createDataFrame(list(zip(range(len(hi)), hi.tolist(), lo.tolist(), words.tolist())), "id bigint, hi bigint, lo bigint, n_words int").dropDuplicates(["hi", "lo", "n_words"])
    kept = np.array(sorted(r["id"] for r in prints.select("id").collect()))
    found = simhash.Forest(len(hi))
    edges = simhash.near_edges(prints, 20, 0.75).collect()
    found.join(np.array([e["x"] for e in edges]), np.array([e["y"] for e in edges]))
    want = plain_roots(hi[kept], lo[kept], words[kept], 20, 0.75)
    assert (found.root[kept] == kept[want]).all() and (want != np.arange(len(kept))).sum() > 50


def test_depth_follows_the_largest_bucket():
    assert [simhash.depth_for(n) for n in (0, simhash.BUCKET_ROWS, simhash.BUCKET_ROWS + 1, simhash.BUCKET_ROWS * 65, 10**15)] == [1, 1, 2, 3, 3]


def test_ids_of_another_type_and_columns_without_an_order(spark):
    texts = corpus(3, 20)
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts])
    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    want = {(f"d{a:05d}", f"d{b:05d}") for a, b in brute_groups(texts)}
    assert {tuple(r) for r in simhash.near_duplicates(named).collect()} == want
    mapped = named.unionByName(named.where("doc_id = 'd00000'")).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = simhash.drop_near_duplicates(mapped)
    assert kept.columns == mapped.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({f"d{i:05d}" for i, _ in texts} - {a for a, _ in want})


def test_thousands_of_copies(spark):
    texts = [(k, ENGLISH + (" extra" if k % 3 == 0 else "")) for k in range(3000)] + [(9000, "something else entirely with other words in it")]
    found = simhash.near_duplicates(documents(spark, [(i, t, "en", "a") for i, t in texts])).collect()
    assert len(found) == 2999 and {r["duplicate_of"] for r in found} == {0}


def test_odd_documents(spark):
    docs = odd(spark)
    want = {(9, 1)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want | brute_groups([(r[0], r[1]) for r in docs.collect()])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 6, 7, *([] if (8, 2) in brute_groups([(2, docs.where("doc_id = 2").first()[1]), (8, docs.where("doc_id = 8").first()[1])]) else [8]), None, None]
    assert rows(simhash.drop_near_duplicates(with_extra(docs)).select(docs.columns)) == rows(kept)
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_length_ratio_keeps_unlike_lengths_apart(spark):
    docs = documents(spark, [(1, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta " * 9, "en", "a"), (3, "alpha beta gamma delta", "en", "a")])
    assert [tuple(r) for r in simhash.near_duplicates(docs).collect()] == [(3, 1)]
