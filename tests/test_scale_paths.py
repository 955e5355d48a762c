"""The ways that large inputs take, on small ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import cluster, connectivity
from weftline.plans import projection, settle


@pytest.mark.parametrize("seed", [2])
def test_coloured_components_are_tarjans(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(50)} | {(100, 101), (101, 100), (200, 200), (40, 41)}
    df = spark.createDataFrame(list(pairs), "src bigint, dst bigint")
    small = {tuple(r) for r in connectivity.strong_components(df).collect()}
    assert {tuple(r) for r in connectivity.strong_components(df, most_pairs=0).collect()} == small
    assert len(small) == len({x for p in pairs for x in p})


def test_components_without_any_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src bigint, dst bigint")
    assert {tuple(r) for r in connectivity.strong_components(df).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_a_component_too_large_for_a_task_is_refused(spark):
    ties = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src bigint, dst bigint, weight double")
    assert cluster.detect(ties, most_pairs=2).count() == 3
    with pytest.raises(ValueError, match="tied pairs"):
        cluster.detect(ties, most_pairs=1)


def test_rows_in_sequence_across_groups(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(40), rng.randrange(5)) for k in range(150)]
    df = spark.createDataFrame(rows, "id bigint, t bigint, v bigint")
    own = Window.orderBy("t", "id")
    want = {tuple(r) for r in df.select("id", F.lag("v").over(own), F.lead("v").over(own), F.row_number().over(own) - 1).collect()}
    got = projection.in_sequence(df, F.floor(F.col("t") / 7), F.col("t"), F.col("id"), value="v").select("id", "before_", "after_", "at_")
    assert {tuple(r) for r in got.collect()} == want
    assert projection.in_sequence(df.limit(0), F.col("t"), F.col("t"), value="v").count() == 0


def test_numbers_without_a_single_task(spark):
    rows = [((k * 37) % 101, k % 3) for k in range(101)]
    df = spark.createDataFrame(rows, "x bigint, y bigint").repartition(7)
    got = settle.numbered(df, F.desc("y"), F.col("x"), name="n").collect()
    assert [(r["x"], r["y"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r["n"] for r in got) == list(range(101))
    assert settle.numbered(df.limit(0), F.col("x"), name="n").count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_likeness_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(projection, "_BLOCK", block)
    rng = random.Random(5)
    vectors = {k: [rng.gauss(0, 1) for _ in range(6)] for k in range(25)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(a, b) for a in vectors for b in vectors if a < b and round(dot(vectors[a], vectors[b]) / (dot(vectors[a], vectors[a]) * dot(vectors[b], vectors[b])) ** 0.5, 4) >= 0.35}
    assert {(r["src"], r["dst"]) for r in projection.likeness_pairs(df).collect()} == want


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError):
        settle.checkpoint_folder(Session)
