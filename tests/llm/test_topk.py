from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stargauge.llm import topk


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return topk.quantized(df.selectExpr("*", "1 AS block", "2 AS part", "3 AS v", "'x' AS level"))


def brute_force(rows, asked, k):
    usable = [
        (key, [math.floor(256 * x) for x in vector])
        for key, vector in rows
        if key is not None and vector is not None
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for query in sorted({key for key, _ in usable if asked(key)}):
        mine = min(vector for key, vector in usable if key == query)
        scored = sorted(
            (-sum(a * b for a, b in zip(mine, vector)), key) for key, vector in usable if key != query
        )
        out += [(query, rank + 1, key, -score) for rank, (score, key) in enumerate(scored[:k])]
    return out


def found(spark, rows, asked="vec_id % 7 = 0", k=5, **blocks):
    usable = vectors(spark, rows)
    return sorted(map(tuple, topk.top_k(usable, usable.where(asked), k, **blocks).collect()))


def made(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [float(rng.choice([-1, 1]) * rng.random() ** 3 * spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "spread"), [(600, 16, 1.0), (300, 3, 0.02), (50, 64, 100.0)])
def test_equals_brute_force(n, dims, spread, spark):
    rows = [(key, [math.ldexp(round(math.ldexp(x, 12)), -12) for x in v]) for key, v in made(n, dims, n, spread)]
    assert found(spark, rows, block_rows=64, query_rows=16) == brute_force(rows, lambda k: k % 7 == 0, 5)


def test_awkward_vectors(spark):
    rows = [
        (0, [0.5, 0.25]), (1, None), (2, [0.5, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]), (5, []), (6, [0.5]), (7, [0.5, 0.25]), (8, [0.5, 0.25]),
        (8, [0.5, 0.25]), (None, [1.0, 1.0]), (14, [-0.5, -0.25, 1.0]), (15, [0.0, 0.0]),
    ]
    assert found(spark, rows) == brute_force(rows, lambda k: k % 7 == 0, 5)


def test_many_equal_vectors_tie_to_smaller_keys(spark):
    rows = [(i, [0.5, -0.5]) for i in range(500)]
    got = found(spark, rows, "vec_id = 3", block_rows=32)
    assert [(rank, key) for _, rank, key, _ in got] == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5)]


def test_rounding_of_single_precision(spark):
    rows = made(400, 32, 5)
    single = [(key, [float(np.float32(x)) for x in vector]) for key, vector in rows]
    assert found(spark, rows, block_rows=400) == brute_force(single, lambda k: k % 7 == 0, 5)


def test_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, [0.5])]) == [] and found(spark, [(7, [0.5])]) == []
