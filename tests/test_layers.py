"""Network layers against loops over single cells, and tiles against the whole grid."""

import itertools

import numpy as np
import pytest

from terracell.operators import layers
from terracell.operators.layers import attention, conv, encoder_decoder, folded, joined, load_weights, pool, predict, shapes, tile_tensors, up_conv, weight_table

RNG = np.random.default_rng(4)


def weights_of(wanted, scale=0.4):
    return {n: RNG.normal(size=s) * scale for n, s in wanted.items()}


def test_convolution_cell_by_cell():
    x, kernel, bias = RNG.normal(size=(3, 5, 6)), RNG.normal(size=(2, 3, 3, 3)), RNG.normal(size=2)
    out = conv(x, kernel, bias)
    for o, r, c in itertools.product(range(2), range(5), range(6)):
        want = bias[o] + sum(kernel[o, i, a + 1, b + 1] * x[i, r + a, c + b] for i in range(3) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= r + a < 5 and 0 <= c + b < 6)
        assert np.isclose(out[o, r, c], want)


def test_up_convolution_and_pooling_cell_by_cell():
    x, kernel, bias = RNG.normal(size=(3, 4, 5)), RNG.normal(size=(3, 2, 2, 2)), RNG.normal(size=2)
    out = up_conv(x, kernel, bias)
    assert out.shape == (2, 8, 10)
    for o, r, c in itertools.product(range(2), range(8), range(10)):
        assert np.isclose(out[o, r, c], bias[o] + sum(kernel[i, o, r % 2, c % 2] * x[i, r // 2, c // 2] for i in range(3)))
    assert np.array_equal(pool(out)[1], [[out[1, 2 * r : 2 * r + 2, 2 * c : 2 * c + 2].max() for c in range(5)] for r in range(4)])


def test_attention_and_batch_normalisation():
    gate, skip = RNG.normal(size=(2, 3, 3)), RNG.normal(size=(4, 3, 3))
    w = {"a.gate": RNG.normal(size=(5, 2, 1, 1)), "a.gate.bias": RNG.normal(size=5), "a.skip": RNG.normal(size=(5, 4, 1, 1)), "a.skip.bias": RNG.normal(size=5), "a.psi": RNG.normal(size=(1, 5, 1, 1)), "a.psi.bias": RNG.normal(size=1)}
    out = attention(gate, skip, w, "a")
    for r, c in itertools.product(range(3), range(3)):
        both = np.maximum(w["a.gate"][:, :, 0, 0] @ gate[:, r, c] + w["a.gate.bias"] + w["a.skip"][:, :, 0, 0] @ skip[:, r, c] + w["a.skip.bias"], 0)
        assert np.allclose(out[:, r, c], skip[:, r, c] / (1 + np.exp(-(w["a.psi"][0, :, 0, 0] @ both + w["a.psi.bias"][0]))))
    x, kernel, bias, mean, var, gamma, beta = RNG.normal(size=(2, 4, 4)), RNG.normal(size=(3, 2, 3, 3)), *(RNG.random(3) + 0.5 for _ in range(5))
    scaled = (conv(x, kernel, bias) - mean[:, None, None]) / np.sqrt(var + 1e-5)[:, None, None] * gamma[:, None, None] + beta[:, None, None]
    assert np.allclose(conv(x, *folded(kernel, bias, mean, var, gamma, beta)), scaled)


def test_skips_reach_the_merge_and_gates_change_them():
    w, x = weights_of(shapes(3, [2, 3, 4])), RNG.normal(size=(3, 8, 8))
    assert joined(x, x[:1]).shape == (4, 8, 8) and shapes(3, [2, 3, 4])["merge0.0"] == (2, 4, 3, 3)
    out = encoder_decoder(x, w)
    assert out.shape == (8, 8) and (0 < out).all() and (out < 1).all()
    cut = dict(w, **{"merge0.0": w["merge0.0"] * (np.arange(4) >= 2)[None, :, None, None]})  # without the skip's channels
    assert not np.allclose(encoder_decoder(x, cut), out)
    gated = dict(w, **{f"attention0.{n}": RNG.normal(size=s) for n, s in {"gate": (2, 2, 1, 1), "gate.bias": (2,), "skip": (2, 2, 1, 1), "skip.bias": (2,), "psi": (1, 2, 1, 1), "psi.bias": (1,)}.items()})
    assert not np.allclose(encoder_decoder(x, gated), out)


def cells_of(spark, a, b):
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c]), float(b[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, a double, b double")


def test_tiles_of_a_grid_with_holes(spark):
    """Every tile on its own, zeros for missing cells and beyond the edge, merged by maximum."""
    a, b = RNG.normal(size=(19, 23)), RNG.normal(size=(19, 23))
    a[2, 3] = a[18, 22] = np.nan
    w, side, step = weights_of(shapes(2, [2, 2])), 8, 6
    got = {(r["r"], r["c"]): r["score"] for r in predict(cells_of(spark, a, b), ["a", "b"], w, side, step, levels=1).collect()}
    want = np.zeros((19, 23))
    for r0, c0 in itertools.product(range(0, 19, step), range(0, 23, step)):
        x = np.zeros((2, side, side))
        for k, band in enumerate((a, b)):
            part = np.nan_to_num(band[r0 : r0 + side, c0 : c0 + side])
            x[k, : part.shape[0], : part.shape[1]] = part
        score = encoder_decoder(x, w, 1)
        rows, cols = min(side, 19 - r0), min(side, 23 - c0)
        want[r0 : r0 + rows, c0 : c0 + cols] = np.maximum(want[r0 : r0 + rows, c0 : c0 + cols], score[:rows, :cols])
    assert len(got) == a.size and np.allclose([got[k] for k in np.ndindex(a.shape)], want.ravel())
    one = next(t for t in tile_tensors(cells_of(spark, a, b), ["a", "b"], side, step).collect() if (t["pr"], t["pc"]) == (0, 0))
    assert np.allclose(np.frombuffer(one["tensor"][0]).reshape(side, side), np.nan_to_num(a[:8, :8]))
    with pytest.raises(ValueError, match="pooled"):
        predict(cells_of(spark, a, b), ["a", "b"], w, 6, 6)
    assert predict(cells_of(spark, a, b).limit(0), ["a", "b"], w, side, step, levels=1).collect() == []


def test_weights_are_checked(spark, monkeypatch):
    wanted = shapes(1, [2, 2], convs=1)
    size = sum(int(np.prod(s)) for s in wanted.values())
    numbers = spark.range(size + 5).selectExpr("id as k", "id / 10.0D as value")
    got = load_weights(weight_table(numbers, wanted), wanted)
    assert np.allclose(np.concatenate([got[n].ravel() for n in wanted]), np.arange(size) / 10)
    with pytest.raises(ValueError, match="missing"):
        load_weights(weight_table(numbers.filter("k < 10"), wanted), wanted)
    monkeypatch.setattr(layers, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError, match="more than"):
        load_weights(weight_table(numbers, wanted))
