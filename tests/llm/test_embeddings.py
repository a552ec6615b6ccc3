"""Operators 12 and 13 against plain NumPy over the same rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.llm import vector_codes, whitening
from stationwise.llm.vector_codes import SLACK, Bounds, CodesConfig, compressed, lower, squared, upper
from stationwise.llm.whitening import WhiteningConfig, whitened

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed, n, width, copies=0):
    draw = np.random.default_rng(seed)
    values = draw.normal(0, 0.2, (n, width)) @ np.diag(np.linspace(2, 0.5, width))
    if copies:
        values[draw.permutation(n)[:copies]] = values[0]
    return values


def whole(values):
    return np.floor(256 * np.asarray(values, float)).astype(np.int64)


def plain_whitening(x, k):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("blocks", [(1_024, 1_024), (7, 5)])
def test_whitening_equals_plain_algebra(spark, blocks):
    values = vectors(1, 120, 12, copies=40)
    rows = [(k % 110, v.tolist(), k % 3) for k, v in enumerate(values)]
    bad = [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 12, 1), (203, [float("-inf")] * 12, 1)]
    frame = spark.createDataFrame(rows + bad, SCHEMA).withColumn("index", F.lit(1)).withColumn("x", F.lit(2))
    config = WhiteningConfig(block_rows=blocks[0], block_cols=blocks[1])
    found = whitened(frame, config=config).collect()
    x = whole(values)
    n, deviation, projected, explained = plain_whitening(x, 4)
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-9
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    for c in range(4):
        signs = []
        for k, (vec_id, _, _) in enumerate(rows):
            own = by_row[(vec_id, deviation[k], c + 1)]
            signs.append([s for s in (1, -1) if any(abs(s * w - projected[k, c]) < 1e-8 for w in own)])
        assert all(1 in s for s in signs) or all(-1 in s for s in signs)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(k, [0.5, 0.25], None) for k in range(5)], SCHEMA)
    assert whitened(same).count() == 0 and whitened(same.limit(0)).count() == 0
    assert whitened(spark.createDataFrame([(1, [], 1)], SCHEMA)).count() == 0
    line = spark.createDataFrame([(None, [float(k), 2.0 * k, 0.0], None) for k in range(4)] + [(9, [7.0], 1)], SCHEMA)
    assert {r.component for r in whitened(line).collect()} == {1, 2}
    large = spark.createDataFrame([(1, [3e38], 1), (2, [0.0], 1), (3, [-1e300], 1)], SCHEMA)
    assert whitened(large).count() == 3


def test_deviation_beyond_a_long_is_null(spark):
    frame = spark.createDataFrame([(k, [1e6 * k, -1e6], 1) for k in range(3)], SCHEMA)
    rows = frame.select(whitening.whole_numbers(F.col("embedding")).alias("x"))
    wide = whitening.deviation(1 << 20, [0, 0], whitening.MOST)
    assert rows.select(wide.alias("d")).collect()[2].d is None
    assert rows.select(whitening.deviation(3, [0, 0], 5).alias("d")).collect()[0].d == 9 * 256_000_000**2


def plain_codes(ids, x, size, parts, rounds):
    width = x.shape[1] // parts
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, x[k].tolist()))[:size]
    cut = lambda p: x[:, p * width : (p + 1) * width]
    books = [cut(p)[order].copy() for p in range(parts)]
    nearest = lambda: [((cut(p)[:, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)]
    for _ in range(rounds):
        for p, own in enumerate(nearest()):
            for e in range(len(books[p])):
                if (members := own == e).any():
                    books[p][e] = cut(p)[members].sum(0) // members.sum()
    codes = np.stack(nearest(), 1)
    error = sum(((cut(p) - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
    flat = ",".join(str(c) for book in books for entry in book for c in entry)
    return [bytes(c.astype(np.uint8)).hex() for c in codes], error, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes_equal_plain_assignment(spark, rounds):
    values = vectors(rounds, 400, 8, copies=130)
    ids = [None if k % 50 == 3 else k // 2 for k in range(400)]
    labels = [None if k % 3 == 0 else k % 4 for k in range(400)]
    rows = [(i, v.tolist(), label) for i, v, label in zip(ids, values, labels)]
    bad = [(0, None, 1), (0, [None] * 8, 1), (0, [float("inf")] * 8, 1)]
    frame = spark.createDataFrame(bad + rows, SCHEMA).withColumn("state", F.lit(1)).withColumn("code", F.lit(2))
    config = CodesConfig(parts=4, entries=20, rounds=rounds, bounds=6, least_bounds=2)
    found = compressed(frame, config=config).collect()
    codes, error, digest = plain_codes(ids, whole(values), 20, 4, rounds)
    by_label = {label: sum(int(e) for e, x in zip(error, labels) if x == label) for label in set(labels)}
    expected = [(i, c, int(e), by_label[x], digest) for i, c, e, x in zip(ids, codes, error, labels)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_few_rows_ragged_vectors_and_none(spark):
    rows = [(2, [0.5] * 5, 1), (1, [0.25], None), (1, [], None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    padded = [whole(v + [0.0] * (16 - len(v))) for _, v, _ in rows]
    codes, error, digest = plain_codes([r[0] for r in rows], np.array(padded), 64, 16, 2)
    found = {tuple(r)[1:3] + (r.codebooks_sha256,) for r in compressed(frame).collect()}
    assert found == {(c, int(e), digest) for c, e in zip(codes, error)}
    assert compressed(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_bounds_stay_bounds(seed):
    draw = np.random.default_rng(seed)
    size, width, scale = int(draw.integers(1, 20)), int(draw.integers(1, 4)), int(draw.choice([2, 50, 3_000, 10**6]))
    x = draw.integers(-scale, scale + 1, (200, width))
    book = x[:size].copy()
    bounds = Bounds.fresh(x, book, min(size - 1, int(draw.integers(0, 6))))
    everyone = np.arange(len(x))
    for step in range(4):
        bounds.above, bounds.below = upper(bounds.above).astype(float), lower(bounds.below).astype(float)
        moved = book + draw.integers(-max(1, scale // 10), max(1, scale // 10) + 1, book.shape)
        bounds.moved(np.sqrt(squared(moved, book).astype(float)) * (1 + SLACK))
        book = moved
        bounds.assign(x, book)
        exact = squared(x[:, None], book[None])
        distance = np.sqrt(exact.astype(float))
        assert (bounds.entry == exact.argmin(1)).all()
        assert (bounds.above >= distance[everyone, bounds.entry]).all()
        assert (bounds.below <= np.take_along_axis(distance, bounds.others, 1)).all()
        np.put_along_axis(distance, bounds.others, np.inf, 1)
        distance[everyone, bounds.entry] = np.inf
        assert (bounds.outer <= distance.min(1)).all()
        if step == 2:
            bounds.cut(1)


def test_bounds_spare_distances(spark):
    """After small moves most rows keep their entry without comparing all of them."""
    draw = np.random.default_rng(3)
    book = draw.integers(-100, 100, (64, 4))
    x = book[draw.integers(0, 64, 5_000)] + draw.integers(-5, 6, (5_000, 4))
    bounds = Bounds.fresh(x, book, 16)
    bounds.moved(np.full(64, 1.8))
    depth = bounds.assign(x, book + 1)
    assert (depth == 17).mean() < 0.01 and (depth == 0).mean() > 0.5
    assert vector_codes.codebooks_digest(np.array([[[1, -2]]])) == hashlib.sha256(b"1,-2").hexdigest()
