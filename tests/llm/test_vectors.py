"""Whitening and vector codes against numpy on whole small tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest

from civicspan.llm import queries, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x string, also string, code string, deviation string"
EXTRA = ("x",) * 5


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, label, *EXTRA) for i, v, label in rows], schema)


def random_vectors(n=300, d=8, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 0.2, d)).astype(np.float32)


def flawed_rows():
    """Equal vectors, equal and null ids, and vectors that can't be used; their number is the last."""
    made = random_vectors(40).tolist()
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(made)]
    rows += [(3, made[3], 0), (90, made[3], None), (None, made[4], 1), (None, [0.5] * 8, None), (-5, [-0.0] * 8, 2)]
    flawed = [
        (91, None, 1),
        (92, [], 1),
        (93, [1.0] * 7 + [None], 1),
        (94, [1.0] * 7 + [float("nan")], 1),
        (95, [float("-inf")] * 8, None),
        (96, [1.0] * 3, 1),
    ]
    return rows + flawed, len(flawed)


def plain_whitening(x):
    distinct = np.unique(x, axis=0).astype(np.float64)
    centred = distinct - distinct.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(distinct))
    return len(distinct), distinct.sum(axis=0), values[::-1], vectors[:, ::-1]


def check_whitening(found, keys, x):
    n, sums, values, axes = plain_whitening(x)
    assert len(found) == 4 * len(x) and (found.n == n).all()
    exact = {}
    for key, row in zip(keys, x.tolist(), strict=True):
        exact.setdefault(key, []).append(sum((n * c - int(s)) ** 2 for c, s in zip(row, sums, strict=True)))
    made = found[found.component == 1].groupby("vec_id", dropna=False).deviation.apply(lambda s: sorted(s.tolist()))
    assert {None if pd.isna(k) else int(k): v for k, v in made.items()} == {k: sorted(v) for k, v in exact.items()}
    for k in range(4):
        part = found[found.component == k + 1]
        assert np.allclose(part.explained, values[k] / values.sum(), rtol=1e-9)
        expected = sorted(np.abs((x - sums / n) @ axes[:, k] / np.sqrt(values[k])))
        assert np.allclose(sorted(part.whitened.abs()), expected, atol=1e-7)
        assert (part.identity_error < 1e-9).all()


def test_whitening_equals_numpy(spark, small):
    source = pd.read_parquet(f"{small}/embeddings.parquet")
    x = np.floor(256 * np.stack(source.embedding).astype(np.float64)).astype(np.int64)
    found = queries.queries()["op11_embedding_whitening"](spark, small).toPandas()
    assert list(found) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found, source.vec_id.tolist(), x)
    _, sums, values, axes = plain_whitening(x)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[source.vec_id].to_numpy()
    whole = (x - sums / len(x)) @ axes[:, :4] / np.sqrt(values[:4])
    assert np.allclose(wide * np.sign((wide * whole).sum(axis=0)), whole, atol=1e-7)


def test_whitening_of_flawed_rows(spark, tmp_path):
    rows, flawed = flawed_rows()
    frame(spark, rows).coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.queries()["op11_embedding_whitening"](spark, str(tmp_path)).toPandas()
    good = rows[:-flawed]
    x = np.floor(256 * np.array([v for _, v, _ in good], np.float32).astype(np.float64)).astype(np.int64)
    check_whitening(found, [i for i, _, _ in good], x)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]])
def test_without_variance_there_are_no_components(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.queries()["op11_embedding_whitening"](spark, str(tmp_path)).count() == 0


def test_fewer_components_than_dimensions(spark):
    base = np.floor(random_vectors(50, 2) * 64) / 64
    flat = np.concatenate([base, base[:, :1] * 2, np.zeros((50, 3))], axis=1)
    model = whitening.fit(frame(spark, [(i, v, 0) for i, v in enumerate(flat.tolist())]))
    assert len(model.components) == 2 and model.identity_error < 1e-9


def test_a_deviation_that_fits_no_long_is_null():
    model = whitening.Whitening(1 << 31, np.zeros(2, np.int64), np.ones(1), np.ones((1, 2)), 1.0)
    assert model.deviations(np.array([[1 << 20, 0], [1, 1]])) == [None, None]


@pytest.mark.parametrize("spread", [1.0, 1e-6])
def test_axes_to_double_precision(spread):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = np.concatenate(([100.0, 100 - spread, 3, 1], np.geomspace(0.5, 1e-6, 20)))
    scatter = (q * values) @ q.T
    scatter = (scatter + scatter.T) / 2
    found, axes = whitening.principal_axes(scatter)
    assert np.allclose(found, values, rtol=1e-9)
    assert np.abs(axes @ axes.T - np.eye(24)).max() < 1e-13
    assert np.abs(scatter @ axes.T - axes.T * found).max() < 1e-11


def test_cholesky_of_a_singular_scatter():
    rng = np.random.default_rng(1)
    half = rng.normal(size=(9, 4))
    factor = whitening.pivoted_cholesky(half @ half.T)
    assert factor.shape == (9, 4) and np.allclose(factor @ factor.T, half @ half.T)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def plain_codes(keys, x, parts=4, entries=256, rounds=4):
    """All distances, in int64."""
    order = sorted(range(len(x)), key=lambda i: (keys[i] is None, keys[i] or 0, x[i].tolist()))[:entries]
    books = [b.copy() for b in np.array_split(x[order], parts, axis=1)]
    cut = np.array_split(x, parts, axis=1)

    def assign():
        far = [((c[:, None, :] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books, strict=True)]
        return [f.argmin(axis=1) for f in far], sum(f.min(axis=1) for f in far)

    for _ in range(rounds):
        homes, _ = assign()
        for c, b, home in zip(cut, books, homes, strict=True):
            for e in np.unique(home):
                b[e] = c[home == e].sum(axis=0) // (home == e).sum()
    homes, error = assign()
    codes = ["".join(f"{e:02x}" for e in each) for each in zip(*homes, strict=True)]
    return codes, error, ",".join(str(v) for b in books for v in b.ravel().tolist())


def test_codes_equal_brute_force_on_flawed_rows(spark, tmp_path):
    rows, flawed = flawed_rows()
    frame(spark, rows).coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.queries()["op12_gnat_vector_codes"](spark, str(tmp_path)).collect()
    good = rows[:-flawed]
    x = np.floor(1024 * np.array([v for _, v, _ in good], np.float32).astype(np.float64)).astype(np.int64)
    codes, error, text = plain_codes([i for i, _, _ in good], x)
    of_label = {}
    for (_, _, label), e in zip(good, error.tolist(), strict=True):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(text.encode()).hexdigest()
    expected = [
        (i, code, e, of_label[label], digest) for (i, _, label), code, e in zip(good, codes, error.tolist(), strict=True)
    ]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_codes_of_no_rows(spark, tmp_path):
    frame(spark, [(1, None, 1)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.queries()["op12_gnat_vector_codes"](spark, str(tmp_path))
    assert found.collect() == [] and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_stand_for_near_vectors(spark):
    vectors = frame(spark, [(i, v, 0) for i, v in enumerate(random_vectors(400).tolist())])
    books = vector_codes.train(vectors, entries=64)
    coded = vector_codes.encode(vectors, books)
    back = {r["code"]: np.array(r["vector"]) for r in vector_codes.decode(coded, books).collect()}
    original = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    apart = [np.linalg.norm(back[r["code"]] - original[r["key"]]) for r in coded.collect()]
    plain = [np.linalg.norm(v) for v in original.values()]
    assert np.mean(apart) < 0.5 * np.mean(plain)


@pytest.mark.parametrize("degree", [2, 3, 16])
@pytest.mark.parametrize("spread", [2, 40, 1 << 25])
def test_search_equals_brute_force_with_ties(degree, spread):
    """Small grids give many ties and equal entries; large values need the exact integers."""
    rng = np.random.default_rng(degree * 7 + spread)
    points = rng.integers(-spread, spread, (200, 3))
    points = np.concatenate([points, points[:40]])
    asked = np.concatenate([rng.integers(-spread, spread, (500, 3)), points])
    search = vector_codes.Search(points, vector_codes.grow(points, degree=degree))
    entry, square = search.nearest(asked)
    every = np.stack([((asked - p) ** 2).sum(axis=1) for p in points], axis=1)
    assert (square == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()


def test_search_leaves_subtrees_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-10_000, 10_000, (16, 16))
    points = (centres[:, None] + rng.integers(-100, 100, (16, 16, 16))).reshape(-1, 16)
    asked = points[rng.integers(0, len(points), 1000)] + rng.integers(-50, 50, (1000, 16))
    search = vector_codes.Search(points, vector_codes.grow(points))
    entry, _ = search.nearest(asked)
    assert (entry == ((asked[:, None] - points[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert search.measured < 0.25 * len(asked) * len(points)


def test_too_large_vectors_are_refused():
    with pytest.raises(ValueError, match="too large"):
        vector_codes.squared_distances(np.array([[1 << 40]]), np.array([[0]]))
