"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import types as T

from loomdex.llm.whitening import Spectrum, WhiteningSettings, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(parts)


def by_hand(rows):
    """{vec_id: (deviation, whitened)}, explained."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64.0 * float(np.float32(c)))) + 1000000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1], q[:, ::-1]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in kept], deviations, y @ q / np.sqrt(values), values / values.sum()


def some_rows(n=400, seed=2):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 6)) * [9, 5, 3, 1, 0.5, 0.25] + 3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(data)]
    rows += [(n, None), (n + 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (n + 2, [float("nan")] * 6), (n + 3, [float("inf")] * 6)]
    return rows + [(n + 4, [1.0]), (n + 5, []), (None, rows[3][1]), rows[4], rows[4]]


@pytest.mark.parametrize("settings", [WhiteningSettings(), WhiteningSettings(batch_rows=3, fan_in=2), WhiteningSettings(components=2)])
@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, settings, parts):
    rows = some_rows()
    ids, deviations, white, explained = by_hand(rows)
    found = whiten(vectors(spark, rows, parts), settings).toPandas()
    count = min(settings.components, 6)
    assert len(found) == len(ids) * count and set(found.n) == {len(ids)}
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-10
    assert sorted(found.groupby("component").explained.first()) == pytest.approx(sorted(explained[:count]), rel=1e-12)
    got = found.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first")
    first = {i: k for k, i in reversed(list(enumerate(ids)))}
    for c in range(count):
        expected = np.array([white[first[i], c] for i in got.index])
        sign = np.sign(got[c + 1].to_numpy() @ expected)
        assert got[c + 1].to_numpy() * sign == pytest.approx(expected, abs=1e-9)
    of_id = dict(zip(ids, deviations, strict=True))
    assert all(of_id[None if i != i else int(i)] == d for i, d in zip(found.vec_id, found.deviation, strict=True))


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # One direction of variance gives one component.
    line = whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(10)]))
    assert sorted(r.component for r in line.collect()) == [1] * 10
    assert line.schema["vec_id"].dataType == T.LongType()


@pytest.mark.parametrize("kind", ["plain", "repeated", "flat", "few"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 12)) * 7
    if kind == "repeated":
        rows = np.floor(rows / 9)
    if kind == "flat":
        rows[:, 5:] = 0
    if kind == "few":
        rows = rows[:5]
    whole = Spectrum(12)
    for part in np.array_split(rows, 4):
        local = Spectrum(12)
        for row in part:
            local.add_rows(row[None])
        whole.add_spectrum(local)
    scatter = (rows - rows.mean(0)).T @ (rows - rows.mean(0))
    scale = np.abs(scatter).max()
    assert (whole.vectors * whole.values) @ whole.vectors.T == pytest.approx(scatter, abs=1e-12 * scale)
    assert whole.vectors.T @ whole.vectors == pytest.approx(np.eye(12), abs=1e-12)
    assert whole.mean == pytest.approx(rows.mean(0), abs=1e-12) and whole.n == len(rows)


def test_secular_roots_lie_between_the_poles():
    d = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0, 1e6])
    z = np.array([1e-3, 2.0, 1e-6, 3.0, 100.0])
    origin, x = secular_roots(d, z)
    roots = d[origin] + x
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] > d[-1]
    assert np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)) == pytest.approx(roots, rel=1e-9, abs=1e-9)
