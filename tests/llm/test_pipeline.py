"""The five stages in a row against brute-force versions of each."""

import random

import numpy as np
import pytest

from tests.llm.docs import ENGLISH, documents, odd
from tests.llm.test_hard_inputs import brute_candidates
from tests.llm.test_mixing_packing import brute_mix, checked
from tests.llm.test_simhash import brute_groups
from weftline.llm import langid, mixing, packing, secret_scan

corpus_pipeline = pytest.importorskip("corpus_pipeline")

TOKEN = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ENGLISH.split() + ["harbour", "winter", "garden", "letter", "music", "window", "silver", "market", "yellow", "mountain"]
    docs = [(100 + k, " ".join(rng.choices(words, k=rng.randint(20, 200))) + (f' token = "{TOKEN}" end' if k % 7 == 0 else ""), "en", rng.choice("abb")) for k in range(60)]
    docs += [(200 + k, docs[k][1] + " indeed", "en", "b") for k in range(15)] + [(300, "zxqj kvwq " * 40, None, "a")]
    path = tmp_path_factory.mktemp("sf")
    odd(spark).unionByName(documents(spark, docs)).write.parquet(str(path / "documents.parquet"))
    return str(path)


def key(row):
    return tuple((x is None, x) for x in row)


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "source mixing", "best-fit packing"]
    made = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, docs, folder)
        assert k == 4 or now.columns == columns
        now.write.parquet(f"{folder}/out/{k}")
        docs = spark.read.parquet(f"{folder}/out/{k}")
        made.append(sorted((tuple(r) for r in docs.collect()), key=key))
    given = sorted((tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=key)
    # language ID, whose posterior has a test of its own: what it accepts stays, the rest goes
    said = langid.of_documents(spark.createDataFrame(given, spark.read.parquet(f"{folder}/documents.parquet").schema)).collect()
    assert made[0] == sorted((tuple(r)[: len(columns)] for r in said if r["accepted"]), key=key)
    assert 300 not in {r[0] for r in made[0]} and len(made[0]) > 60
    # near duplicates: the least id of each group, one of repeated rows
    gone = {i for i, _ in brute_groups([(r[0], r[1]) for r in made[0]])}
    left = [r for r in made[0] if r[0] not in gone]
    assert made[1] == sorted([*{r for r in left if r[0] is not None}, *(r for r in left if r[0] is None)], key=key)
    assert len(gone) >= 10
    # secrets
    forest = secret_scan._own_forest(secret_scan.VOCABULARY)

    def clean(row):
        text, out, at = row[1], "", 0
        for a, b, _ in brute_candidates(text or ""):
            x = secret_scan.features(text[a:b], text[max(0, a - 40) : a], text[b : b + 12], row[3])
            if forest.scores(np.array([x]))[0] >= secret_scan.THRESHOLD:
                out, at = out + text[at:a] + secret_scan.MASK, b
        return row if not at else (row[0], out + text[at:], row[2], row[3], len(out + text[at:]))

    assert made[2] == sorted((clean(r) for r in made[1]), key=key) and any(secret_scan.MASK in (r[1] or "") for r in made[2]) and not any(TOKEN in (r[1] or "") for r in made[2])
    # mixing: rows of each document as often as its source's rate and its draw say
    mixed = brute_mix(made[2], None, None)
    assert made[3] == sorted((r[:5] for r in mixed), key=key)
    # packing
    checked(spark.read.parquet(f"{folder}/out/3"), packing.CAPACITY, docs)


def test_run_gives_what_the_stages_give(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    by_hand = spark.read.parquet(f"{folder}/out/4")
    assert whole.columns == by_hand.columns
    assert sorted((tuple(r) for r in whole.collect()), key=key) == sorted((tuple(r) for r in by_hand.collect()), key=key)


def test_run_on_an_empty_table(spark, tmp_path):
    odd(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rates_are_those_of_the_mixing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/out/2")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}
    assert set(rates) == {r["source"] for r in docs.select("source").distinct().collect()} and all(r >= 0 for r in rates.values())
