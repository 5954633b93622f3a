"""Tensors in tiles against numpy: views, contractions over any axes, tiles at the edges."""

import numpy as np
import pytest

from gridloom.operators import blocks, tiles
from gridloom.operators.tensor import Tensor, contract_axes
from gridloom.operators.tiles import Tiled

RNG = np.random.default_rng(6)


def put(spark, x):
    cells = [(*map(int, at), float(x[at])) for at in np.ndindex(x.shape)]
    return Tensor(spark.createDataFrame(cells, ", ".join(f"a{k} long" for k in range(x.ndim)) + ", v double"), x.shape)


def get(t):
    t = t.to_tensor() if isinstance(t, Tiled) else t
    out = np.zeros(t.shape)
    for r in t.df.collect():
        out[tuple(r[k] for k in range(len(t.shape)))] += r["v"]
    return out


def test_sides():
    assert tiles.sides((7, 16, 12)) == (7, 16, 12)
    assert np.prod(tiles.sides((1000, 1000, 3))) <= tiles.CELLS and tiles.sides((1000, 1000, 3))[2] == 3
    assert tiles.sides((10**6,)) == (tiles.CELLS,)


def test_views_move_nothing(spark):
    x = RNG.normal(size=(5, 7, 4))
    t = Tiled.of(put(spark, x), (2, 3, 4)).written()
    view = t.permute([2, 0, 1]).slice(1, 3)
    assert view.df is t.df and view.shape == (4, 7) and view.strides() == (1, 4) and not view.is_contiguous() and t.is_contiguous()
    want = x.transpose(2, 0, 1)[:, 3]
    assert np.allclose(get(view), want) and np.allclose(get(view.contiguous()), want) and view.contiguous().is_contiguous()
    assert np.allclose(get(t.slice(0, 4).slice(0, 6)), x[4, 6])
    assert np.allclose(get(view.zip(view.scaled(2.0), np.subtract)), -want)
    with pytest.raises(IndexError):
        t.slice(0, 5)


@pytest.mark.parametrize("small", [0, blocks.SMALL])
@pytest.mark.parametrize("shape_a, shape_b, axes_a, axes_b", [((5, 7, 4), (4, 6), [2], [0]), ((4, 6), (5, 7, 4), [0], [2]), ((5, 7, 4), (7, 5, 3), [0, 1], [1, 0]), ((5, 7), (5, 7), [0, 1], [0, 1])])
def test_contractions(spark, shape_a, shape_b, axes_a, axes_b, small, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL", small)
    monkeypatch.setattr(tiles, "CELLS", 12)
    monkeypatch.setattr(tiles.sides, "__defaults__", (12,))
    a, b = RNG.normal(size=shape_a), RNG.normal(size=shape_b)
    got = get(contract_axes(put(spark, a), put(spark, b), axes_a, axes_b))
    assert np.allclose(got, np.tensordot(a, b, (axes_a, axes_b)).reshape(got.shape))


def test_contraction_of_views(spark):
    a, b = RNG.normal(size=(5, 4, 6)), RNG.normal(size=(6, 3))
    t = Tiled.of(put(spark, a), (2, 2, 4)).permute([1, 2, 0]).slice(2, 3)
    u = Tiled.of(put(spark, b), (4, 2))
    assert np.allclose(get(tiles.contract(t, u, [1], [0])), a[3] @ b)
    with pytest.raises(ValueError):
        tiles.contract(t, u, [0], [1])
