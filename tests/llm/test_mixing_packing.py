import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.docs import documents, empty, odd, rows, with_extra
from weftline.llm import mixing, packing


def brute_mix(docs, weights, budget=None, seed=mixing.SEED):
    tokens = defaultdict(int)
    for _, text, _, source, _ in docs:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values()) if budget is None else budget
    share = {s: math.sqrt(t) if weights is None else weights.get(s, 0.0) for s, t in tokens.items()}
    out = []
    for d in docs:
        t = tokens[d[3]]
        rate = total * share[d[3]] / sum(share.values()) / t if t else 1.0
        key = f"{seed}:{'' if d[0] is None else d[0]}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        out += [tuple(d)] * n
    return sorted(out, key=repr)


@pytest.mark.parametrize(("weights", "budget"), [(None, None), ({"a": 3.0, "b": 1.0}, None), ({"a": 1.0, None: 1.0}, 100_000), ({}, None)])
def test_mix_against_brute_force(spark, weights, budget):
    docs = odd(spark)
    found = mixing.mix(docs, weights, budget, detail=False)
    if weights == {}:
        assert rows(found) == sorted(rows(docs), key=repr)  # no weight at all: every rate is 1
    else:
        assert rows(found) == brute_mix([tuple(r) for r in docs.collect()], weights, budget)


def test_mix_reaches_the_weights(spark):
    rng = random.Random(1)
    docs = documents(spark, [(k, "w " * rng.randint(20, 60), "en", "ab"[k % 4 == 0]) for k in range(4000)])
    found = mixing.mix(docs, {"a": 1.0, "b": 1.0}).groupBy("source").sum("n_tokens").collect()
    a, b = (r[1] for r in found)
    assert abs(a - b) / (a + b) < 0.03


def test_mix_columns_and_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
    wide = mixing.mix(with_extra(odd(spark)))
    assert {"copy": "string", "rate": "string", "_copy": "bigint", "_rate": "double", "_n_tokens": "bigint"}.items() <= dict(wide.dtypes).items() and "mix_n" in wide.columns
    assert wide.count() == mixing.mix(odd(spark)).count()


def checked(docs, capacity, found):
    """Every token of every copy lies in exactly one piece, and no bin overflows."""
    bins, by = defaultdict(int), defaultdict(list)
    for bin_, doc, copy, piece, start, n in (tuple(r) for r in found.collect()):
        bins[bin_] += n
        by[doc, copy].append((start, n, piece))
    assert all(n <= capacity for n in bins.values())
    lengths = defaultdict(list)
    for doc, text in ((r[0], r[1]) for r in docs.collect()):
        if text and text.split():
            lengths[doc].append(len(text.split()))
    got = defaultdict(list)
    for (doc, _), pieces in by.items():
        at = 0
        for k, (start, n, piece) in enumerate(sorted(pieces)):
            assert start == at and piece == k
            at += n
        got[doc].append(at)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in lengths.items()}
    return len(bins)


def test_pack_odd_documents(spark):
    docs = odd(spark)
    checked(docs, 64, packing.pack(docs, capacity=64))
    checked(docs, 64, packing.pack(with_extra(docs), capacity=64))
    assert packing.pack(empty(spark)).count() == 0
    assert rows(packing.pack(docs, capacity=64)) == rows(packing.pack(docs, capacity=64))


def least_bins(sizes, capacity):
    """Exact minimum by search, for a few pieces."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i, b in enumerate(bins):
            if b + sizes[k] <= capacity and b not in bins[:i]:
                place(k + 1, bins[:i] + [b + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_pack_finds_the_fewest_bins(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(3, 15) for _ in range(9)), reverse=True)
        docs = documents(spark, [(k, "w " * n, "en", "a") for k, n in enumerate(sizes)])
        assert checked(docs, 20, packing.pack(docs, capacity=20)) == least_bins(sizes, 20)


def test_genetic_search_beats_best_fit():
    rng = np.random.default_rng(3)
    better = 0
    for seed in range(6):
        sizes = rng.integers(200, 520, 120)
        start = np.full(len(sizes), -1)
        packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), [], start, 0, 1000)
        best = packing.evolve((seed,), sizes, [], 1000, 12, 6)[0]
        assert np.bincount(best, sizes).max() <= 1000 and (best >= 0).all()
        assert packing.fitness(sizes, best, 1000) >= packing.fitness(sizes, start, 1000)
        better += packing.fitness(sizes, best, 1000) > packing.fitness(sizes, start, 1000)
    assert better


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 80)
    one, two = packing.first_population(rng, sizes, 100, 2)
    for _ in range(20):
        child = packing.cross(rng, sizes, one, two, 100)
        assert (child >= 0).all() and np.bincount(child, sizes).max() <= 100
        one, two = two, child
    assert len(list(itertools.chain(sizes))) == len(child)
