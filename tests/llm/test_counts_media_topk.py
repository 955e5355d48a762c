import io
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.docs import documents, empty, odd, rows, with_extra
from weftline.llm import media, quality, sharding, token_counts, topk

# ---- token counts


def greedy(word, pieces, longest=None):
    n = at = 0
    longest = longest or max(map(len, pieces))
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces or k == 1)
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=20), min_size=1, max_size=10))
def test_automaton_is_greedy_longest_match(pieces, words):
    pieces = {p.encode() for p in pieces} | {b"a"}
    words = [w.encode() for w in words]
    assert token_counts.Automaton(pieces).count(words).tolist() == [greedy(w, pieces) for w in words]


def test_counts_with_the_public_vocabulary(spark):
    pieces = set(token_counts.read_vocabulary())
    longest = max(map(len, pieces))
    docs = odd(spark)
    want = sorted(((i, None, None) if t is None else (i, len(t.split()), sum(greedy(b" " + w.encode(), pieces, longest) for w in t.split())) for i, t in ((r[0], r[1]) for r in docs.collect())), key=repr)
    assert rows(token_counts.token_counts(docs)) == want
    assert rows(token_counts.token_counts(with_extra(docs))) == want
    assert token_counts.token_counts(empty(spark)).count() == 0
    long = documents(spark, [(1, "x" * 200_000 + " ünï", "en", "a")])
    assert token_counts.token_counts(long).first()["n_words"] == 2


# ---- media


@pytest.mark.parametrize(("kind", "channels"), [("P5", 1), ("P6", 3), ("BMP8", 1), ("BMP24", 3)])
def test_images_round_trip(kind, channels):
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (3, 5), (17, 64), (40, 33)):
        image = rng.integers(0, 256, (h, w, channels), np.uint8)
        back = media.decode(media.encode(image, kind))
        assert (back[:, :, :channels] == image).all() and (back == back[:, :, :1]).all() | (channels == 3)


def test_other_formats():
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 9 1\n\x80\x80")[0, :, 0].tolist() == [0] + [255] * 7 + [0]
    assert media.decode(b"P5 1 2 65535\n\xff\xff\x00\x00")[:, 0, 0].tolist() == [255, 0]
    for broken in (b"", b"P5 2 2 255\n\0", b"P5 x", b"BM", b"GIF89a", b"P6 0 1 255\n", b"BM" + bytes(60)):
        with pytest.raises((ValueError, IndexError)):
            media.decode(broken)


def exact_area(image, h, w):
    H, W = image.shape
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            total = Fraction(0)
            for y in range(H):
                dy = min(Fraction((i + 1) * H, h), y + 1) - max(Fraction(i * H, h), y)
                for x in range(W):
                    dx = min(Fraction((j + 1) * W, w), x + 1) - max(Fraction(j * W, w), x)
                    if dy > 0 and dx > 0:
                        total += dy * dx * int(image[y, x])
            out[i, j] = float(total / (Fraction(H, h) * Fraction(W, w)))
    return out


def test_resize_averages_exact_areas():
    rng = np.random.default_rng(5)
    for (H, W), (h, w) in (((7, 5), (3, 2)), ((4, 4), (4, 4)), ((3, 2), (5, 7)), ((10, 1), (4, 3))):
        image = rng.integers(0, 256, (H, W, 1), np.uint8)
        assert np.allclose(media.resize(image, h, w)[:, :, 0], exact_area(image[:, :, 0], h, w))


def test_difference_hash_by_definition():
    image = np.random.default_rng(6).integers(0, 256, (40, 45, 1), np.uint8)
    cells = media.resize(image, 8, 9)[:, :, 0]
    bits = "".join("1" if cells[i, j] < cells[i, j + 1] else "0" for i in range(8) for j in range(8))
    assert media.difference_hash(image) & (2**64 - 1) == int(bits, 2)
    assert media.difference_hash(np.full((9, 9, 3), 7, np.uint8)) == 0


def test_tiles_of_odd_documents(spark):
    docs = odd(spark)
    made = media.pictures(docs)
    found = media.tiles(made, "doc_id", F.col("media"))
    assert found.count() == docs.count()
    for r in found.collect():
        if r["tile"] is not None:
            tile = np.load(io.BytesIO(r["tile"]))
            assert tile.shape == (32, 32, r["channels"]) and tile.dtype == np.uint8 and r["error"] is None
    assert found.where("tile IS NULL").count() == 3 and found.where("error IS NOT NULL").count() == 0
    bad = spark.createDataFrame([(1, b"nothing"), (None, None)], "media int, data binary")
    got = {r["media"]: r["error"] for r in media.tiles(bad, "media", F.col("data")).collect()}
    assert got[1] and got[None] is None
    text = "Ünïcode text, whole. " * 3000
    for number in range(4):
        raw = media.decode(media.picture_of(text, number)).tobytes() if number in (0, 1, 3) else media.decode(media.picture_of(text, number))[:, :, 0].tobytes()
        assert raw.rstrip(b"\0") == text.encode()
    assert media.tiles(media.pictures(empty(spark)), "doc_id", F.col("media")).count() == 0


# ---- exact top-k


def brute_top(vectors, k):
    out = []
    for q, a in vectors.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)
        out += [(q, i, r + 1) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_nearest_is_exact(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "PER_TASK", 25)
    monkeypatch.setattr(topk, "_WIDEST", 7)
    rng = np.random.default_rng(dims)
    vectors = {i: [float(x) for x in rng.integers(-6, 7, dims) / 4] for i in range(130)}
    vectors |= {200 + i: vectors[i] for i in range(8)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    assert sorted((r[0], r[1], r[2]) for r in topk.nearest(df, 5).collect()) == brute_top(vectors, 5)
    asked = topk.nearest(df, 5, queries=F.col("vec_id") % topk.EVERY == 0)
    assert sorted((r[0], r[1], r[2]) for r in asked.collect()) == [x for x in brute_top(vectors, 5) if x[0] % 20 == 0]


def test_nearest_with_ids_of_text(spark):
    vectors = {f"v{i:03d}": [float(i % 7), float(-i % 5)] for i in range(40)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id string, embedding array<double>")
    assert sorted((r[0], r[1], r[2]) for r in topk.nearest(df, 3).collect()) == brute_top(vectors, 3)


def test_index_arithmetic():
    rng = np.random.default_rng(9)
    rows_ = rng.normal(size=(150, 6))
    index = topk.BitSlicedIndex(np.arange(150), rows_)
    weights = np.array([3, -5, 0, 63, -1, 17])
    slices = index.sums(weights)
    unsigned = np.rint(index.rows / index.scale).astype(int) + index.offset
    full = (1 << index.bits) - 1
    want = sum(abs(w) * (unsigned[:, d] if w > 0 else full - unsigned[:, d]) for d, w in enumerate(weights))
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(int) << j for j, s in enumerate(slices))
    assert (got == want).all()
    for k in (1, 7, 150):
        assert index.kth(slices, k) == sorted(want, reverse=True)[k - 1]
    for bound in (-1, 0, int(np.median(want)), int(want.max()), 10**9):
        assert index.at_least(slices, bound).tolist() == np.flatnonzero(want >= bound).tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (None, [1.0, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (8, [None, 1.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit("y"))
    got = sorted((r[0], r[1], r[2]) for r in topk.nearest(df, 2).collect())
    assert got == brute_top({1: (1.0, 0.0), 2: (0.5, 0.5), 9: (0.0, 0.0)}, 2)
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.where("vec_id = 1")).count() == 0


# ---- sharding


def brute_ring(keys, ring, slack):
    """Keys one by one, round the ring."""
    arcs = ring.arc(np.array([h for h, _ in keys], np.int64))
    limit = -(-int(np.ceil(len(keys) * (1 + slack))) // len(ring.shards))
    room, out = [limit] * len(ring.shards), []
    for arc, h, key in sorted((int(a), h, k) for a, (h, k) in zip(arcs, keys)):
        at = arc
        while not room[ring.owner[at]]:
            at = (at + 1) % len(ring.points)
        room[ring.owner[at]] -= 1
        out.append((key, int(ring.owner[arc]), int(ring.owner[at])))
    return sorted(out)


def test_sharding_against_brute_force(spark):
    docs = documents(spark, [(k, "t", "en", "a") for k in range(3000)])
    ring = sharding.Ring(range(7), 20)
    hashed = docs.selectExpr("xxhash64(CAST(doc_id AS STRING)) & 9223372036854775807 AS h", "doc_id").collect()
    found = sharding.assign(docs, 7, 20, 0.05)
    assert sorted((r["doc_id"], r["home"], r["shard"]) for r in found.collect()) == brute_ring([(r["h"], r["doc_id"]) for r in hashed], ring, 0.05)
    loads = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert max(loads) <= -(-int(np.ceil(3000 * 1.05)) // 7)
    assert found.where("home = shard").count() == found.where("hops = 0").count()


def test_a_new_shard_moves_few_keys(spark):
    docs = documents(spark, [(k, "t", "en", "a") for k in range(8000)])
    before, after = (sharding.assign(docs, n, 64, 0.1).select("doc_id", "shard") for n in (16, 17))
    moved = before.join(after.withColumnRenamed("shard", "now"), "doc_id").where("shard <> now").count()
    assert moved / 8000 < 3 / 17


def test_sharding_odd_documents(spark):
    docs = odd(spark)
    found = sharding.assign(with_extra(docs), 3)
    assert found.count() == docs.count() and found.columns == ["doc_id", "home", "shard", "hops"]
    assert max(r["count"] for r in found.groupBy("shard").count().collect()) <= -(-int(np.ceil(docs.count() * 1.05)) // 3)
    same = documents(spark, [(5, "t", "en", "a")] * 90)
    assert [r["count"] for r in sharding.assign(same, ["x", "y", "z"]).groupBy("shard").count().collect()] and sharding.assign(same, ["x", "y", "z"]).count() == 90
    assert sharding.assign(empty(spark)).count() == 0


# ---- quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    index, value = np.array([3, 99, 16000, 5]), rng.normal(size=4)
    pairs = sum(value[a] * value[b] * (machine.factors[index[a]] @ machine.factors[index[b]]) for a in range(4) for b in range(a))
    assert machine.margin(index, value) == pytest.approx(0.3 + value @ machine.linear[index] + pairs)


def good_or_bad(rng, good):
    words = rng.choices(["river", "fence", "farmer", "morning", "letter", "garden", "window", "story"], k=rng.randint(20, 60))
    return " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["!!", "%%%"]) for w in words)


def test_quality_on_held_out_documents(spark):
    rng = random.Random(8)
    data = [(k, good_or_bad(rng, k % 3 > 0), "en", "a") for k in range(400)]
    docs = documents(spark, data)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    machine = quality.train(docs, labels)
    found = {r["doc_id"]: r["keep"] for r in quality.classify(docs, machine).collect()}
    assert np.mean([found[k] == (k % 3 > 0) for k in range(300, 400)]) > 0.97


def test_quality_of_odd_documents(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (77, 0)], "doc_id bigint, quality int")
    machine = quality.train(docs, labels)
    found = quality.classify(docs, machine)
    assert found.count() == docs.count() and found.where("score IS NULL OR keep IS NULL").count() == 0
    assert rows(quality.classify(with_extra(docs), machine)) == rows(found)
    none = quality.train(docs, labels.limit(0))
    assert quality.classify(docs, none).where("score BETWEEN 0.3 AND 0.7").count() == docs.count()
    assert quality.classify(empty(spark), machine).count() == 0
    assert quality.train(empty(spark), labels).bias == 0
