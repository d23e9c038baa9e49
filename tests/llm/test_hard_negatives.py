"""Hard negatives against brute force with whole numbers."""

import math
import random

import numpy as np
import pytest

from tallyscope.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank int, block int"


def brute(rows, positives=5, negatives=10):
    used = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * x) for x in vector])
        used[key] = min(used[key], row) if key in used else row
    out = set()
    for a, (label, u) in used.items():
        if a % 100:
            continue
        scores = {b: sum(x * y for x, y in zip(u, v, strict=True)) for b, (_, v) in used.items() if b != a and len(v) == len(u)}
        order = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in order if used[b][0] == label][:positives]:
            inside = [b for b in order if used[b][0] != label and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out |= {(a, p, k + 1, b, scores[p], scores[b]) for k, b in enumerate(inside[:negatives])}
    return out


def vectors(seed, count, width, scale=1.0):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(k * 10, [scale * (c + 0.8 * pick.gauss(0, 1)) for c in centres[pick.randrange(6)]], pick.randrange(4)) for k in range(count)]


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return [tuple(r) for r in hard_negatives.mine_hard_negatives(frame).collect()]


@pytest.mark.parametrize(("small", "step", "scale"), [(4096, 8, 0.2), (60, 3, 0.01), (25, 1, 5.0)])
def test_negatives_by_brute_force(spark, monkeypatch, small, step, scale):
    monkeypatch.setattr(hard_negatives, "SMALL_BLOCK_ROWS", small)
    monkeypatch.setattr(hard_negatives, "STEP", step)
    rows = vectors(small, 300, 20, scale)
    got = mined(spark, rows)
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want and len(want) > 300


def test_scan_drops_rows_early():
    pick = np.random.default_rng(1)
    columns = (pick.normal(size=(64, 5_000)) * (400 / (1 + np.arange(64)))[:, None]).astype(np.int64)
    block = hard_negatives.Block(np.arange(5_000), np.zeros(5_000, dtype=np.int64), columns)
    left = []

    def narrow(scores, least, most):
        kth = np.partition(scores, -5)[-5]
        keep = scores + most >= kth + least
        left.append(int(keep.sum()))
        return keep

    at, scores = block.scan(columns[:, 7], np.arange(5_000), narrow)
    every = columns[:, 7] @ columns
    assert (scores == every[at]).all() and {*np.argsort(-every)[:5].tolist()} <= {*at.tolist()}
    assert left[2] < 2_500 and left[-1] < 10


def test_exact_beyond_doubles(spark):
    rows = [(k * 20, [pick * 2.0**18 + k, 2.0**19 - k], k % 2) for k, pick in enumerate([1.0, 2.0, 3.0, 1.5, 0.5, 0.7, 2.5, 0.2] * 4)]
    assert set(mined(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.6, 0.3], 2), (3, [0.6, 0.3], 2), (4, [0.5, nan], 2), (5, [0.5, inf], 2),
        (6, [0.5, None], 2), (7, None, 2), (8, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (9, [0.7], 2), (100, [0.4], 2), (101, [0.9], 2),
        (102, [0.5], 3), (200, [], 1), (201, [], 1), (202, [], 2), (2, [0.6, 0.3], 2), (3, [0.1, 0.3], 1), (300, [-1.0, 0.0], 5), (301, [1.0, 0.0], 5),
    ]
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    # Empty vectors score 0, and 0 is in the window of 0.
    assert (200, 201, 1, 202, 0, 0) in got
    assert mined(spark, [(7, None, 1)]) == []
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine_hard_negatives(none).count() == 0
