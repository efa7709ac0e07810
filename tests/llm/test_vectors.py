"""Vector codes against a plain loop, and whitening against a dense eigensolver; odd vectors; bounds that no entry may break."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import CLASHING

from sonarium.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHED = (*CLASHING, "code", "error", "flat", "order", "total", "width", "component", "whitened", "dim", "low", "high")
BAD = [None, [], [None] * 16, [math.nan] + [0.0] * 15, [math.inf] + [0.0] * 15, [1.0] * 12]


def rows(seed, n, width=16, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, width)) * scale
    vectors = (centres[rng.integers(0, 7, n)] + rng.standard_normal((n, width)) * scale / 4).astype(np.float32)
    labels = [None if k % 9 == 0 else k % 4 for k in range(n)]
    return [(int(i), [float(x) for x in v], label) for i, v, label in zip(rng.permutation(n), vectors, labels)]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def plain_codes(data, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in data]
    wide = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][p * wide : (p + 1) * wide] for r in order] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                part = r[1][p * wide : (p + 1) * wide]
                groups.setdefault(best(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [best(v[p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, c, e, sums[label], digest) for i, c, e, label in out)


@pytest.mark.parametrize("n, entries", [(700, 256), (700, 8), (90, 256), (1, 256)])
def test_codes_match_a_plain_loop(spark, n, entries):
    data = rows(n + entries, n)
    got = vector_codes.compress_vectors(frame(spark, data), entries=entries)
    assert sorted(map(tuple, got.collect())) == plain_codes(data, entries=entries)


def test_ties_repeats_and_bad_vectors(spark):
    base = rows(4, 40)
    data = [(i, v, label) for i, v, label in base for _ in range(20)] + [(1000 + k, [0.0] * 16, None) for k in range(300)]
    odd = [(2000 + k, v, 1) for k, v in enumerate(BAD)]
    df = frame(spark, data + odd).select("*", *[F.lit("x").alias(c) for c in CLASHED if c != "label"])
    assert sorted(map(tuple, vector_codes.compress_vectors(df).collect())) == plain_codes(data)


def test_null_ids_and_layouts(spark):
    data = [(None if i < 5 else i, v, label) for i, v, label in rows(8, 120)]
    first = [tuple(r) for r in vector_codes.compress_vectors(frame(spark, data, 1), entries=16).collect()]
    second = [tuple(r) for r in vector_codes.compress_vectors(frame(spark, data, 7), entries=16).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(first, key=key) == sorted(second, key=key) and len(first) == 120


@pytest.mark.parametrize("make", [vector_codes.compress_vectors, whitening.whiten])
def test_no_vectors(spark, make):
    assert make(frame(spark, [])).count() == 0
    assert make(frame(spark, [(1, None, 1), (2, [], 1), (3, [None], 1)])).count() == 0


def test_shortlists_keep_every_winner_and_every_tie():
    rng = np.random.default_rng(2)
    for scale in (3, 400, 1 << 27):
        values, entries = rng.integers(-scale, scale, (1000, 5)), rng.integers(-scale, scale, (60, 5))
        values = values[vector_codes.curve_order(values, values.min(axis=0), values.max(axis=0))]
        low, high, total = vector_codes.cut_blocks(values, 10)
        apart = ((values[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        for k, a, b, index, distance in vector_codes.assign(values, low, high, total, entries, 10):
            assert (np.broadcast_to(index, b - a) == apart[a:b].argmin(axis=1)).all()
            assert distance is None or (distance == apart[a:b].min(axis=1)).all()
            assert (total[k] == values[a:b].sum(axis=0)).all()
    one = np.zeros((64, 5), np.int64)
    blocks = list(vector_codes.assign(one, *vector_codes.cut_blocks(one), np.array([[9] * 5, [0] * 5, [0] * 5])))
    assert [np.unique(b[3]).tolist() for b in blocks] == [[1]]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (16, 1)])
def test_hilbert_curve_visits_every_cell_once_by_steps_of_one(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="not supported"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e30] * 16, 1)])).collect()


# --- whitening ----------------------------------------------------------------------------------------------------------------


def plain_whitening(data, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in data], object)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]
    return n, deviation, y @ vectors / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("n, width, most", [(500, 40, 32), (300, 16, 5)])
def test_whitening_matches_a_dense_solver(spark, n, width, most):
    data = rows(n, n, width, scale=2.0)
    got = whitening.whiten(frame(spark, data + [(5000 + k, v, 1) for k, v in enumerate(BAD)]), most).collect()
    count, deviation, expected, explained = plain_whitening(data, most)
    place = {i: k for k, (i, _, _) in enumerate(data)}
    assert len(got) == n * min(most, width)
    found = np.zeros_like(expected)
    for r in got:
        assert r.n == count and r.deviation == deviation[place[r.vec_id]] and r.identity_error <= 1e-10
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        found[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(found * np.sign((found * expected).sum(axis=0)) - expected).max() < 1e-8


def test_whitening_of_flat_repeated_and_crowded_rows(spark):
    same = [(k % 3, [1.0, 2.0, 3.0], None) for k in range(9)]
    assert whitening.whiten(frame(spark, same)).count() == 0  # no variance, no components
    line = [(None, [float(k), 2.0 * k, 0.0], 1) for k in range(10)]
    df = frame(spark, line).select("*", *[F.lit("x").alias(c) for c in CLASHED if c != "label"])
    got = whitening.whiten(df).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    assert math.isclose(sum(r.whitened**2 for r in got) / 10, 1)


def spectrum(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = q * np.array(values, float) @ q.T
    return (a + a.T) / 2


SPECTRA = [
    [5, 5, 5, 4, 4, 1, 1, 1, 1, 0, 0, 0], [1e9, 1, 1 - 1e-9, 1e-3, 0], [1.0] * 40 + [0.0] * 24, list(np.linspace(1, 2, 64)), [2.0**-k for k in range(64)], [3.0], [2.0, 1.0],
]


@pytest.mark.parametrize("values", SPECTRA)
def test_contours_miss_no_eigenvalue(values):
    v = spectrum(values)
    found, vectors = [], []
    for low, high, count in whitening.intervals(v, 32):
        w, x = whitening.contour_eigenpairs(v, low, high, count)
        assert len(w) == count and np.abs(v @ x - x * w).max() <= 1e-11 * max(values)
        found += list(w)
        vectors.append(x)
    expected = np.sort(np.array(values, float))[::-1]
    assert len(found) >= min(32, len(values)) and np.abs(np.array(found) - expected[: len(found)]).max() <= 1e-12 * max(values)


@pytest.mark.parametrize("values", SPECTRA)
def test_inertia_counts(values):
    v = spectrum(values)
    diagonal, off = whitening.tridiagonal(v)
    exact = np.linalg.eigvalsh(v)
    points = np.random.default_rng(1).uniform(-1, 1.2 * max(values), 50)
    points = points[np.abs(points[:, None] - exact[None]).min(axis=1) > 1e-9 * max(values)]
    assert (whitening.eigenvalues_below(diagonal, off, points) == (exact[None] < points[:, None]).sum(axis=1)).all()


def test_a_wrong_count_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.contour_eigenpairs(spectrum([3.0, 2.0, 1.0, 0.5]), 1.5, 3.5, 3)
