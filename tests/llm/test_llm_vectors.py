"""Vector operators against dense linear algebra on small tables."""

import math

import numpy as np
import pytest

from ebbtide.llm import lattice_dedup, whitening

CLASHING = "vec_id long, embedding array<double>, label int, id long, node string, unit string, keys string, n long, x string, cell string, component string, whitened string, key string, count long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, "n", "u", "k", 2, "x", "c", "m", "w", "y", 3) for i, v, g in rows], CLASHING).repartition(4)


# --- lattice ------------------------------------------------------------------------------------------


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    points = rng.uniform(-1, 1, (400, 8))
    steps = lattice_dedup._shortest()
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose(np.square(steps).sum(1), 2)
    near = lattice_dedup.nearest(points)
    assert np.allclose(lattice_dedup.nearest(near), near)
    assert ((2 * near) % 2 == (2 * near[:, :1]) % 2).all() and (near.sum(1) % 2 == 0).all()
    distance = np.square(points - near).sum(1)
    around = np.square((points - near)[:, None] - steps).sum(2)  # Voronoi cells are bounded by shortest vectors
    assert (distance <= 1 + 1e-12).all() and (distance[:, None] <= around + 1e-12).all()


def test_more_vectors_get_finer_cells_and_as_sure_tables():
    for most in (0, 1000, 10**6, 10**9):
        scheme = lattice_dedup.lattice(most)
        assert (1 - scheme.meet) ** scheme.tables <= 1e-4
    assert lattice_dedup.lattice(10**9).blocks > lattice_dedup.lattice(10**6).blocks > 1


def planted(rng, dims=64, pairs=300, cosine=0.9301):
    """Pairs a little above the threshold beside unrelated vectors."""
    rows, wanted = [], []
    for i in range(pairs):
        x, y = rng.normal(size=(2, dims))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)
        rows += [(2 * i, (x * 3).tolist(), 1), (2 * i + 1, (y / 7).tolist(), 1)]
        wanted.append((2 * i, 2 * i + 1))
    return rows, wanted


def dense(rows, similar=0.93):
    """{row number: (links, smallest reachable id)} by comparing all pairs."""
    def usable(i, v, g):
        return i is not None and g is not None and bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    fine = [k for k, r in enumerate(rows) if usable(*r)]
    units = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in fine}
    units = {k: u / np.linalg.norm(u) for k, u in units.items()}
    links = {k: [j for j in fine if j != k and rows[j][2] == rows[k][2] and len(units[j]) == len(units[k]) and units[j] @ units[k] >= similar] for k in fine}
    label = {k: r[0] for k, r in enumerate(rows)}
    for _ in rows:
        new = {k: min([label[k], *(label[j] for j in links[k])]) if k in links else label[k] for k in label}
        if new == label:
            break
        label = new
    return sorted(((r[0], len(links.get(k, ())), label[k], r[0] is None or label[k] == r[0]) for k, r in enumerate(rows)), key=repr)


def linked(df, **kwargs):
    return sorted((tuple(r) for r in lattice_dedup.near_vectors(df, **kwargs).collect()), key=repr)


def test_links_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows, _ = planted(rng, 16, 40, 0.95)
    base = rng.normal(size=16)
    rows += [(1000 + i, (base + 0.05 * rng.normal(size=16)).tolist(), 1 + i % 2) for i in range(60)]  # a crowd in two labels
    rows += [(2000 + i, base.tolist(), 1) for i in range(40)] + [(2000, base.tolist(), 1)]  # copies, one row twice
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [math.nan] * 16, 1), (3004, [None, *base[1:].tolist()], 1),
             (3005, [math.inf, *base[1:].tolist()], 1), (3006, base.tolist(), None), (None, base.tolist(), 1), (None, None, None),
             (3007, (base * 1e200).tolist(), 1), (3008, (base * 1e-200).tolist(), 1), (3009, base[:8].tolist(), 1), (3010, [0.0, -0.0, 1.0], 3),
             (3011, [-0.0, 0.0, 2.0], 3)]
    assert linked(frame(spark, rows)) == dense(rows)
    assert linked(frame(spark, rows[:1]).limit(0)) == []


def test_recall_at_the_threshold(spark):
    rows, wanted = planted(np.random.default_rng(3))
    got = {r[0]: r for r in linked(frame(spark, rows))}
    assert sum(got[a][2] == got[b][2] == a for a, b in wanted) == len(wanted)


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.1 * rng.normal(size=8)).tolist(), 1) for i in range(300)]
    monkeypatch.setattr(lattice_dedup, "BLOCK", 16)
    assert linked(frame(spark, rows)) == dense(rows)


# --- whitening ----------------------------------------------------------------------------------------


def plain_whitening(rows, k=8):
    fine = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in fine], n, deviation, centred, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def held(spark, rows, **kwargs):
    ids, n, deviation, centred, values, axes, trace = plain_whitening(rows)
    got = {r["vec_id"]: r for r in whitening.whiten(frame(spark, rows), **kwargs).collect()}
    assert sorted(got) == sorted(ids)
    wanted = centred @ axes / np.sqrt(values)
    found = np.array([got[i]["whitened"] for i in ids])
    signs = np.sign((found * wanted).sum(0))
    assert np.allclose(found * signs, wanted, rtol=0, atol=1e-8)
    for i, d in zip(ids, deviation):
        assert int(got[i]["deviation"]) == d and got[i]["n"] == n
    assert np.allclose(got[ids[0]]["explained"], values / trace, rtol=1e-9) and got[ids[0]]["identity_error"] < 1e-9


@pytest.mark.parametrize("dims", [8, 40])
def test_components_are_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    spread = rng.normal(size=(dims, dims)) / dims
    held(spark, [(i, (v @ spread).tolist(), 0) for i, v in enumerate(rng.normal(size=(700, dims)))])


def test_flat_spectra_take_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i, v in enumerate(rng.normal(size=(900, 64)))]
    held(spark, rows)
    vectors, dims = whitening.whole_vectors(frame(spark, rows))
    model = whitening.fit(vectors, dims)
    assert model.residual <= 1e-13 and model.passes > 9


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(7)
    held(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(50, 9)) * 1e9)])


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(60, 9)))]
    odd = [(100, None, 0), (101, [], 0), (102, [math.nan] * 9, 0), (103, [math.inf] * 9, 0), (104, [None] * 9, 0), (None, rows[0][1], None)]
    found = whitening.long_rows(whitening.whiten(frame(spark, rows + odd))).collect()
    assert len(found) == 61 * 8 and {r["n"] for r in found} == {61} and {r["component"] for r in found} == set(range(1, 9))
    assert whitening.long_rows(whitening.whiten(frame(spark, rows).limit(0))).collect() == []
    assert whitening.long_rows(whitening.whiten(frame(spark, odd[:5]))).collect() == []
    same = whitening.whiten(frame(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).collect()
    assert [(r["whitened"], r["n"]) for r in same] == [([], 5)] * 5
    line = whitening.whiten(frame(spark, [(i, [i * 1.0, i * 2.0, 3.0], 0) for i in range(20)])).collect()
    assert {len(r["whitened"]) for r in line} == {1} and line[0]["identity_error"] < 1e-9
