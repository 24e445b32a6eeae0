"""Strassen's products and mined rows against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 70), (65, 33, 129), (40, 0, 3), (0, 4, 4), (70, 71, 73)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    for leaf in (5, 8, 32):
        assert (hn.strassen(a, b, leaf) == a @ b).all()


def test_strassen_wraps_inside_but_not_in_the_result():
    a = np.full((40, 40), 2**31, dtype=np.int64)
    b = np.where(np.arange(40)[:, None] % 2 == 0, 2**31, -(2**31)) * np.ones((1, 40), dtype=np.int64)
    assert (hn.strassen(a, b, 4) == 0).all()


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, label, [math.floor(256 * x) for x in vector]))
    out = []
    for at, (i, label, v) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other == label, k) for k, (j, other, w) in enumerate(kept) if k != at]
        for score, j, _, _ in sorted(s for s in scored if s[2])[:positives]:
            p = -score
            inside = sorted((s, n) for s, n, same, _ in scored if not same and low * p <= -100 * s <= high * p)[:negatives]
            out += [(i, j, rank, n, p, -s) for rank, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hn.mine(df.withColumns({"uid": F.lit(0), "part": F.lit("x")}), F.col("vec_id") % 4 == 0, **options)
    return sorted(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()
    )


def test_mine_with_odd_rows(spark):
    rng = random.Random(5)
    near = lambda: [float(np.float32(rng.gauss(0.3, 0.5))) for _ in range(6)]
    rows = [(i, near(), rng.choice([0, 0, 0, 1, 2])) for i in range(90)]
    rows += [(i, rows[3][1], label) for i, label in ((200, 0), (201, 0), (204, 1), (205, 1))]  # ties
    rows += [rows[8], rows[8], rows[9]]  # repeated rows, an anchor among them
    rows += [(300, near(), None), (304, None, 1), (308, [None, 1.0], 1), (312, [math.nan], 0), (316, [math.inf], 0), (None, near(), 0)]
    rows += [(320, [], 0), (324, [1.0, 2.0], 0), (328, near() * 3, 1), (332, near(), 77)]
    want = brute(rows, lambda i: i % 4 == 0)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, strip=7) == want  # many strips of anchors and rows
    narrow = brute(rows, lambda i: i % 4 == 0, 2, 3, 10, 50)
    assert mined(spark, rows, positives=2, negatives=3, low=10, high=50, strip=16) == narrow


def test_empty_and_negative_scores(spark):
    assert mined(spark, []) == []
    rows = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.5], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0) == []


def test_one_hot_vector(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(120)] + [(200 + i, [0.5, 0.25], 1) for i in range(120)]
    assert mined(spark, rows, strip=50) == brute(rows, lambda i: i % 4 == 0)
