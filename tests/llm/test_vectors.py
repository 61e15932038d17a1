"""Whitening and near-duplicate embeddings against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import vector_duplicates, whitening
from llm.vector_duplicates import least_count, plan, same_range

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<float>, label int, n int, x string, links string, cell int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def frame(spark, rows):
    """Rows (id, vector, label) with columns whose names the operators use."""
    return spark.createDataFrame([(i, v, c, 1, "x", "y", 2) for i, v, c in rows], KINDS)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


# ---- whitening --------------------------------------------------------------


def plain_whitening(rows, most=4):
    """{(id, component): (n, deviation, |whitened|, explained)} by LAPACK on all rows."""
    good = [(i, v) for i, v in rows if usable(v)]
    sizes = Counter(len(v) for _, v in good)
    dims = max(sizes, key=lambda d: (sizes[d], d), default=0)
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in good if len(v) == dims]
    if not good:
        return []
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    v = np.cov(fit.T, bias=True).reshape(dims, dims)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = int((e[:most] > dims * 1e-15 * max(e[0], 0)).sum()) if e[0] > 0 else 0
    out = []
    for i, x in good:
        for j in range(k):
            z = (np.array(x) - np.array(sums) / n) @ axes[:, j] / math.sqrt(e[j])
            out.append((i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(z), e[j] / np.trace(v)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[4]))


def check_whitening(df, rows):
    got = sorted(
        ((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[4]),
    )
    want = plain_whitening(rows)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-10)


def test_whitening_equals_plain(spark, embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    df = whitening.whitened(embeddings)
    check_whitening(df, rows)
    assert df.agg(F.max("identity_error")).first()[0] < 1e-9


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).astype("f4").tolist(), 0) for i in range(40)]
    rows += [(100 + i, rows[7][1], 0) for i in range(60)]  # copies weigh once
    rows += [
        (7, rows[7][1], 0), (7, [9.0, 9.0, 9.0], 1), (None, [0.1, -0.2, 0.3], None), (200, None, 1), (201, [], 1), (202, [1.0, None, 2.0], 1),
        (203, [1.0, NAN, 2.0], 1), (204, [1.0, -INF, 2.0], 1), (205, [0.0, 0.0, 0.0], 1), (206, [1.0, 2.0], 1), (207, [-1e-6, 0.0, 0.0], 1),
    ]
    check_whitening(whitening.whitened(frame(spark, rows)), [(i, v) for i, v, _ in rows])


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_whitening_without_spread(spark, rows):
    """Nothing to fit, or one vector alone, whose covariance is 0."""
    assert whitening.whitened(frame(spark, rows)).count() == 0


def test_whitening_keeps_components_with_spread(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)]
    assert {r.component for r in whitening.whitened(frame(spark, rows)).collect()} == {1}


def test_deviation_is_exact_beyond_doubles():
    model = whitening.Whitening(2, 3, [1, 2], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[700_000_001, -5], [900_000_003, 11]])
    assert model.deviation(x).tolist() == [sum((3 * a - s) ** 2 for a, s in zip(row, [1, 2])) for row in x.tolist()]


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 40), [1, 1 + 1e-10, 1 + 2e-10, 0.5, 0.5 + 1e-6, *np.linspace(2, 3, 20)], [2] * 5 + [1] * 3 + [0.3, 0.1],
        [1, 0, 0, 0], [5] * 6, [3], 1 + 1e-12 * np.arange(20), np.geomspace(1, 1e-12, 25),
    ],
)
def test_eigenvectors(values):
    """Far, clustered and equal eigenvalues: small residuals, orthonormal vectors, values as given."""
    rng = np.random.default_rng(1)
    values = np.array(values, np.longdouble)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    turn = turn @ (1.5 * np.eye(len(values)) - 0.5 * turn.T @ turn)  # orthogonal beyond doubles
    matrix = ((turn * values) @ turn.T).astype(float)
    got, vectors = whitening.eigen((matrix + matrix.T) / 2)
    size = float(values.max())
    assert np.abs(matrix @ vectors - vectors * got).max() < 2e-15 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(got - np.sort(np.asarray(values, float))[::-1]).max() < 1e-14 * size


def test_refinement_beats_its_start():
    """Clustered eigenvalues are told apart beyond what float32 and double solvers give."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        turn = turn @ (1.5 * np.eye(12) - 0.5 * turn.T @ turn)
    values = np.array([1 + 2.0**-20 * k for k in range(6)] + [0.5, 0.25, 0.2, 0.1, 0.05, 0.01], np.longdouble)
    matrix = (turn * values) @ turn.T
    wide = np.array(matrix, np.longdouble)
    got, vectors = whitening.eigen(wide)
    order = np.argsort(-values)
    error = np.abs(np.abs(vectors) - np.abs(turn[:, order].astype(float))).max()
    assert error < 1e-12
    single = np.linalg.eigh(wide.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs(single) - np.abs(turn[:, order].astype(float))).max() > 1e-3


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 33)).astype(np.longdouble) / 3
    b = rng.standard_normal((33, 7)).astype(np.longdouble) / 7
    assert np.abs(whitening.product(a, b) - a @ b).max() < 1e-17


# ---- near-duplicate vectors -------------------------------------------------


def plain_duplicates(rows, least=0.98):
    good = [
        k for k, (_, v, c) in enumerate(rows) if c is not None and usable(v) and any(v)
    ]
    near = {k: {k} for k in range(len(rows))}
    unit = {k: np.array(rows[k][1], float) / np.abs(np.array(rows[k][1], float)).max() for k in good}
    norm = {k: math.sqrt(float(unit[k] @ unit[k])) for k in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / (norm[a] * norm[b]) >= least:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen]
        least_id = None if None in ids else min(ids)
        out.append((i, len(near[k]) - 1, least_id, i == least_id))
    return Counter(out)


def spread(rng, base, cosine, m):
    """``m`` vectors at this cosine from ``base``."""
    out = []
    for _ in range(m):
        side = rng.standard_normal(len(base))
        side -= side @ base * base
        out.append((cosine * base + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)).astype("f4").tolist())
    return out


def made_vectors(seed=5, dims=32):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for cosine, m in [(0.999, 12), (0.991, 30), (0.985, 20), (0.98, 10), (0.97, 10), (0.3, 60)]:
            base = rng.standard_normal(dims)
            for v in spread(rng, base / np.linalg.norm(base), cosine, m):
                rows.append((i, v, label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(50)] + [(i + 60, rows[0][1], 1)]  # copies, and one of another label
    rows += [(i + 70, [float(np.float32(3e37)) * c for c in rows[0][1]], 0), (i + 71, [1e-30 * c for c in rows[0][1]], 0)]
    rows += [
        (i + 80, None, 0), (i + 81, [], 0), (i + 82, [0.0] * dims, 0), (i + 83, [0.0] * dims, 0), (i + 84, [NAN] * dims, 0), (i + 85, [INF] * dims, 0),
        (i + 86, [1.0, None], 0), (i + 87, [1.0, 2.0], 0), (i + 88, [1.0, 2.0], 0), (i + 89, [1.0, 2.0, 0.0], 0), (3, rows[4][1], 0), (3, rows[40][1], 0),
    ]
    return rows


def test_duplicates_equal_brute_force(spark):
    rows = made_vectors()
    got = Counter(tuple(r) for r in vector_duplicates.vector_duplicates(frame(spark, rows)).collect())
    assert got == plain_duplicates([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], c) for i, v, c in rows])


def test_duplicates_without_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i if i != 3 else None, v, 0) for i, v in enumerate(spread(rng, base / np.linalg.norm(base), 0.999, 6))] + [(None, [1.0] * 16, 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vector_duplicates.vector_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(None, 5, None), (None, 0, None)] + [(i, 5, None) for i in (0, 1, 2, 4, 5)])


def test_duplicates_in_crowded_cells(spark, monkeypatch):
    """Cells cut into blocks give the same links."""
    rows = made_vectors(seed=6)
    whole = Counter(tuple(r) for r in vector_duplicates.vector_duplicates(frame(spark, rows)).collect())
    monkeypatch.setattr(vector_duplicates, "BLOCK", 7)
    assert Counter(tuple(r) for r in vector_duplicates.vector_duplicates(frame(spark, rows)).collect()) == whole


def test_duplicates_empty(spark, embeddings):
    assert vector_duplicates.vector_duplicates(embeddings.limit(0)).count() == 0
    assert vector_duplicates.vector_duplicates(frame(spark, [(1, None, 0), (2, [0.0], None)])).count() == 2


def test_collisions_equal_plain():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-40, 40, (30, 6)).astype(np.int8), rng.integers(-40, 40, (50, 6)).astype(np.int8)
    want = (np.abs(a[:, None].astype(int) - b[None].astype(int)) <= 5).sum(axis=2)
    assert (vector_duplicates.collisions(a, b, 5) == want).all()


def test_plan_is_calibrated():
    """Pairs at the threshold meet and pass as often as the plan says, by simulation."""
    assert abs(same_range(2.0, 0.2) - 0.9202) < 1e-3
    assert least_count(10, 0.5, 1e-9) == 0 and least_count(10, 0.5, 0.2) == 4
    for largest in (100, 10**4, 10**9):
        p = plan(largest, 0.98)
        near = same_range(vector_duplicates.RANGE * p.distance, p.distance) ** p.per_table
        assert (1 - near) ** p.tables <= vector_duplicates.MISS / 2
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    others = np.array(spread(rng, base, 0.98, 3000))
    p = plan(5000, 0.98)
    where, offsets = vector_duplicates.directions(64, p)
    h = np.vstack([base, others]) @ where
    cells = np.floor((h[:, : len(offsets)] + offsets) / (vector_duplicates.RANGE * p.distance)).reshape(len(h), p.tables, p.per_table)
    met = (cells[1:] == cells[0]).all(axis=2).mean()
    assert abs(met - same_range(2.0, 0.2) ** p.per_table) < 0.1
    sketch = np.clip(np.rint(h[:, len(offsets) :] * vector_duplicates.STEPS), -127, 127).astype(np.int8)
    assert (vector_duplicates.collisions(sketch[:1], sketch[1:], p.reach) >= p.least).all()
