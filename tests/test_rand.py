import hashlib

import numpy as np
from pyspark.sql import functions as F

from pairloom.functions.rand import normal_vector, uniform, uniform_int, uniform_vector


def test_uniform_is_the_digest_of_its_keys(spark):
    rows = spark.range(50).select("id", uniform(3, "id", F.lit("x")).alias("u")).collect()
    for r in rows:
        digest = hashlib.md5(f"3:{r.id}:x".encode()).hexdigest()
        assert r.u == int(digest[:13], 16) / 2**52


def test_same_draws_on_any_partitioning(spark):
    df = spark.range(200)
    one = df.coalesce(1).select("id", normal_vector(1, 6, "id").alias("e")).collect()
    many = df.repartition(7).select("id", normal_vector(1, 6, "id").alias("e")).collect()
    assert sorted(one) == sorted(many)


def test_uniform_int_reaches_both_ends(spark):
    values = {r[0] for r in spark.range(500).select(uniform_int(1, 5, 8, "id")).collect()}
    assert values == {5, 6, 7, 8}


def test_vectors_have_the_asked_width_and_distribution(spark):
    rows = spark.range(400).select(
        normal_vector(2, 10, "id").alias("e"), uniform_vector(2, 5, "id").alias("u")
    ).collect()
    e, u = np.array([r.e for r in rows]), np.array([r.u for r in rows])
    assert e.shape == (400, 10) and u.shape == (400, 5)
    assert abs(e.mean()) < 0.06 and abs(e.std() - 1) < 0.05
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
    assert abs(np.corrcoef(e[:, 0], e[:, 1])[0, 1]) < 0.2
